"""Metric edge cases on hand-made prediction tables."""

import pytest
from pyspark.sql import functions as F

from botsift.functions.numeric import predict_threshold, safe_sigmoid
from botsift.operators import metrics as mt
from botsift.operators.predict import ensemble_mean


def _m(spark, pairs):
    df = spark.createDataFrame([("m", y, p) for y, p in pairs], "model string, label int, predicted int")
    r = mt.compare_models(df).collect()[0]
    cm = {(c.actual, c.predicted): c.n for c in mt.confusion_matrix(df).collect()}
    return r, cm


@pytest.mark.parametrize("pairs,acc,prec,rec,f1,cells", [
    ([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], 0.6, 2 / 3, 2 / 3, 2 / 3, (1, 1, 1, 2)),
    ([(1, 0), (0, 0)], 0.5, 0, 0, 0, (1, 0, 1, 0)),
    ([(0, 1), (0, 0)], 0.5, 0, 0, 0, (1, 1, 0, 0)),
    ([(0, 0), (0, 0)], 1.0, 0, 0, 0, (2, 0, 0, 0)),
])
def test_metric_cases(spark, pairs, acc, prec, rec, f1, cells):
    r, cm = _m(spark, pairs)
    assert r.accuracy == pytest.approx(acc) and r.precision == pytest.approx(prec)
    assert r.recall == pytest.approx(rec) and r.f1 == pytest.approx(f1)
    assert (cm[(0, 0)], cm[(0, 1)], cm[(1, 0)], cm[(1, 1)]) == cells


def test_empty_input(spark):
    df = spark.createDataFrame([], "model string, label int, predicted int")
    assert mt.compare_models(df).collect() == []


def test_threshold_and_ensemble(spark):
    df = spark.createDataFrame([(0.5, 0.9, 0.4, 0.4)], "p double, p_a double, p_b double, p_c double")
    assert df.select(predict_threshold("p")).first()[0] == 0
    e = ensemble_mean(df, ["a", "b", "c"]).select("p_ENSEMBLE").first()[0]
    assert e == pytest.approx(0.5666666, abs=1e-6)
    assert df.select(predict_threshold(F.lit(e))).first()[0] == 1
    with pytest.raises(ValueError):
        ensemble_mean(df, [])


def test_safe_sigmoid_extremes(spark):
    r = spark.createDataFrame([(-9000.0,), (9000.0,), (0.0,)], "z double").select(safe_sigmoid("z").alias("p")).collect()
    assert [x.p for x in r] == [0.0, 1.0, 0.5]


def test_report_and_rank(spark):
    df = spark.createDataFrame([("a", 0.5, 0.25, 1.0, 0.4), ("b", 0.75, 0.5, 0.5, 0.5)],
                               "model string, accuracy double, precision double, recall double, f1 double")
    rep = {r.model: r for r in mt.metrics_report(df).collect()}
    assert rep["a"].precision == "0.2500"
    rk = {r.model: r["rank"] for r in mt.rank_models(df).collect()}
    assert rk == {"b": 1, "a": 2}
