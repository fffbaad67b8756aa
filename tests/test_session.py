"""Intermediate tables go when their scope ends, whatever happens inside."""

import os

import pytest
from pyspark.sql import functions as F
from table_dirs import SF_SMALL

from botsift.plans import catalog
from botsift.session import materialize, scratch_scope, shared_dir


def _folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


@pytest.mark.parametrize("key", ["compare_with_ensemble", "encode_ids", "assign_batches", "fit_text_lr", "stream_metrics", "read_posts_semicolon", "save_model"])
def test_nothing_stays_behind_a_query(spark, key):
    before = _folders(spark)
    with scratch_scope(spark) as scope:
        rows = catalog.QUERIES[key](spark, SF_SMALL).collect()
        made = _folders(spark) - before
    assert rows and made and scope.paths and _folders(spark) == before


def test_kept_tables_and_errors(spark):
    before = _folders(spark)
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            table = inner.keep(materialize(spark.range(5), "t-kept"))
            materialize(spark.range(9), "t-gone")
        assert table.agg(F.sum("id")).first()[0] == 10 and len(_folders(spark) - before) == 1
    assert _folders(spark) == before and outer.paths
    with pytest.raises(RuntimeError), scratch_scope(spark):
        materialize(spark.range(5), "t-error")
        raise RuntimeError
    assert _folders(spark) == before
