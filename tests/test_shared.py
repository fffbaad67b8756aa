"""A model of a gigabyte is scored by several workers within the memory of one copy."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from botsift.operators.registry import external_model
from botsift.operators.shared import SharedArrays
from botsift.operators.textmodels import score_models

WIDE, ROWS = 64, 4_194_304          # 64 x 4M float32: 1 GiB


def test_one_copy_for_all_workers(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="botsift-weights-"), "table.npy")
    table = np.lib.format.open_memmap(path, "w+", np.float32, (ROWS, WIDE))
    table[::1000, 0] = 1.0                  # the rest stays a hole of the file
    table.flush()
    del table
    weights = SharedArrays(spark, {"table": path})

    rows, touched = ROWS, len(range(0, ROWS, 1000))

    def private_mb():
        """Memory of this process that no other shares and no file backs."""
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    def make(arrays):
        table = arrays["table"]

        def predict(ids):
            at = ids.astype(np.int64).ravel()
            total = sum(float(table[a : a + 65_536].sum()) for a in range(0, rows, 65_536))    # touches all of it
            assert total == touched
            return table[at % rows, 0] * 0.5 + (0.25 if private_mb() < 400 else 9.0)

        return predict

    model = external_model("large", make, ("post",), input_tensor_shapes=[[1]], weights=weights)
    df = spark.range(0, 8000, 1, 8).select(F.col("id").cast("string").alias("post_id"), F.lit("x").alias("text"), F.array(F.col("id").cast("float")).alias("post"))
    got = {int(r.post_id): r.p_large for r in score_models(df, [model]).collect()}
    assert got == {i: 0.75 if i % 1000 == 0 else 0.25 for i in range(8000)}


def test_names_must_differ(spark):
    with pytest.raises(ValueError, match="different names"):
        SharedArrays(spark, {"a": "/x/w.npy", "b": "/y/w.npy"})
    with pytest.raises(ValueError, match="npy"):
        SharedArrays(spark, {"a": "/x/w.bin"})
