"""Finished batches: visible as a whole, each in one run, few files however many batches."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from botsift.session import scratch_path
from botsift.sinks import publish
from botsift.streaming import stream as st
from botsift.streaming.runlog import Run, RunLog


def _count_row(batch):
    return [{"model": "m", "tp": 1, "fp": batch, "fn": 0, "tn": 2}]


def _totals(spark, path):
    return {r.model: (r.tp, r.fp, r.fn, r.tn) for r in st.stream_metrics(spark, path).collect()}


def test_ten_thousand_batches_leave_few_files(spark):
    path = scratch_path(spark, "t-log")
    log = st.count_log(spark, path)
    # the state after 9,990 batches as merging them one by one leaves it, then the last ones in full
    n, first = 9_990, 0
    for level in range(6, -1, -1):
        width = log.fan ** level
        while first + width <= n - 1 or (level == 0 and first < n):
            batches = range(first, first + width)
            log._write(Run(first, first + width - 1, level), [{"model": "m", "tp": width, "fp": sum(batches), "fn": 0, "tn": 2 * width}])
            first += width
    for batch in range(n, 10_000):
        assert log.append(batch, _count_row(batch))
    assert _totals(spark, path) == {"m": (10_000, sum(range(10_000)), 0, 20_000)}
    assert len(publish.names(spark, path)) <= 7 * 2 * log.fan


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_every_batch_is_in_one_run(spark, fan):
    path = scratch_path(spark, "t-log")
    log = RunLog(spark, path, st.COUNTS_SCHEMA, st._added, fan)
    for batch in range(70):
        log.append(batch, _count_row(batch))
        covered = [b for r in log.runs() for b in range(r.first, r.last + 1)]
        assert covered == list(range(batch + 1))
        assert sum(r["fp"] for run in log.runs() for r in log.rows(run)) == sum(range(batch + 1))
    assert len(log.runs()) <= fan * 7


def test_a_replay_before_and_after_merging_changes_nothing(spark):
    path = scratch_path(spark, "t-log")
    log = st.count_log(spark, path)
    for batch in range(30):
        log.append(batch, _count_row(batch))
        before = _totals(spark, path) if batch % 10 == 9 else None
        log.append(batch, _count_row(batch))             # the newest batch again
        if before:
            assert _totals(spark, path) == before
    for batch in (0, 7, 12):                             # batches that merged runs hold
        assert not log.append(batch, _count_row(batch))
    assert _totals(spark, path) == before


def test_a_crash_at_any_step_of_a_merge(spark, monkeypatch):
    """Every write and every deletion fails once: the log stays whole, and goes on."""
    import botsift.streaming.runlog as module

    rng = random.Random(2)
    path = scratch_path(spark, "t-log")
    log = RunLog(spark, path, st.COUNTS_SCHEMA, st._added, 2)
    put, remove = module.put, module.remove
    batch = crashes = 0
    while batch < 40:
        armed = rng.random() < 0.5
        left = [rng.randint(1, 3)]

        def fail(step):
            def run(*args):
                left[0] -= 1
                if armed and left[0] < 0:
                    raise OSError("the writer dies")
                return step(*args)
            return run

        monkeypatch.setattr(module, "put", fail(put))
        monkeypatch.setattr(module, "remove", fail(remove))
        try:
            log.append(batch, _count_row(batch))
        except OSError:
            crashes += 1
        done = max((r.last for r in log.runs()), default=-1)
        assert [b for r in log.runs() for b in range(r.first, r.last + 1)] == list(range(done + 1))
        assert sum(r["fp"] for run in log.runs() for r in log.rows(run)) == sum(range(done + 1))
        batch = done + 1
    assert crashes > 5


def _rows(spark, n, value):
    return spark.range(n).select(F.col("id").cast("string").alias("post_id"), F.lit("m").alias("model"), F.lit(1).alias("label"),
                                 F.lit(value).alias("p"), F.lit(1).alias("predicted"), F.lit("bot").alias("prediction"))


def _seen(spark, out):
    return {(r.batch, r.p, r["count"]) for r in st.read_predictions(spark, out).groupBy("batch", "p").count().collect()}


def test_a_reader_between_the_two_writes_finds_the_old_batch(spark, monkeypatch):
    out = scratch_path(spark, "t-out")
    assert _seen(spark, out) == set()
    st.finish_batch(spark, out, 0, _rows(spark, 50, 0.1))
    st.finish_batch(spark, out, 1, _rows(spark, 60, 0.1))
    old = {(0, 0.1, 50), (1, 0.1, 60)}
    assert _seen(spark, out) == old
    # the batch is run again: its rows are written, but not published yet
    found = []
    append = RunLog.append
    monkeypatch.setattr(RunLog, "append", lambda log, b, rows: found.append(_seen(spark, out)) or append(log, b, rows))
    st.finish_batch(spark, out, 1, _rows(spark, 60, 0.9))
    assert found == [old] and _seen(spark, out) == {(0, 0.1, 50), (1, 0.9, 60)}
    # the writer dies between the two
    monkeypatch.setattr(RunLog, "append", lambda *a: (_ for _ in ()).throw(OSError("dies")))
    with pytest.raises(OSError):
        st.finish_batch(spark, out, 2, _rows(spark, 70, 0.5))
    assert _seen(spark, out) == {(0, 0.1, 50), (1, 0.9, 60)}
    monkeypatch.setattr(RunLog, "append", append)
    st.finish_batch(spark, out, 2, _rows(spark, 70, 0.6))
    st.finish_batch(spark, out, 3, _rows(spark, 10, 0.7))
    assert _seen(spark, out) == {(0, 0.1, 50), (1, 0.9, 60), (2, 0.6, 70), (3, 0.7, 10)}
    assert len(publish.names(spark, f"{out}/data")) == 4                # folders of earlier tries are gone


def test_a_reader_while_batches_are_replaced(spark):
    """A reader in another thread sees whole batches at every moment."""
    out = scratch_path(spark, "t-out")
    st.finish_batch(spark, out, 0, _rows(spark, 500, 0.0))
    stop, seen, wrong = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                got = _seen(spark, out)
            except Exception as e:  # a reader must never fail either
                wrong.append(e)
                return
            seen.append(got)
            if len(got) != 1 or next(iter(got))[2] != 500:
                wrong.append(got)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 2):
        st.finish_batch(spark, out, 0, _rows(spark, 500, float(k)))
    stop.set()
    reader.join()
    assert not wrong and _seen(spark, out) == {(0, 1.0, 500)} and seen


def test_small_files_are_replaced_as_a_whole(spark):
    path = scratch_path(spark, "t-put")
    assert publish.get(spark, f"{path}/a") is None and publish.names(spark, path) == []
    for text in ("one", "", "zwei ö\nlines\n"):
        publish.put(spark, f"{path}/a", text)
        assert publish.get(spark, f"{path}/a") == text and publish.names(spark, path) == ["a"]


def test_prediction_folders_are_rewritten_in_few(spark):
    """Twenty batches, merged entries rewritten as one folder each: the same rows at every step, few folders in the end, and a
    reader of before keeps its files until unpublished folders are deleted."""
    out = scratch_path(spark, "t-out")
    for batch in range(20):
        st.finish_batch(spark, out, batch, _rows(spark, 5, batch / 100))
    before = _seen(spark, out)
    opened = st.read_predictions(spark, out)
    assert len(before) == 20 and len(publish.names(spark, f"{out}/data")) == 20
    assert st.compact_predictions(spark, out) == 2 and st.compact_predictions(spark, out) == 0
    assert _seen(spark, out) == before and opened.count() == 100
    st.finish_batch(spark, out, 19, _rows(spark, 5, 0.19))          # the newest batch once more
    assert len(st.delete_unpublished(spark, out)) >= 16
    assert _seen(spark, out) == before and len(publish.names(spark, f"{out}/data")) == 2 + 4
    for batch in range(20, 70):
        st.finish_batch(spark, out, batch, _rows(spark, 5, batch / 100))
    st.compact_predictions(spark, out)
    st.delete_unpublished(spark, out)
    assert len(_seen(spark, out)) == 70 and len(publish.names(spark, f"{out}/data")) == len(st.batch_log(spark, out).runs()) <= 15


def test_readers_while_the_log_is_merged(spark):
    """Batches come, runs are merged and deleted: a reader in another thread always finds a whole number of batches."""
    path = scratch_path(spark, "t-log")
    log = RunLog(spark, path, st.COUNTS_SCHEMA, st._added, 2)
    stop, seen, wrong = threading.Event(), [0], []

    def read():
        while not stop.is_set():
            try:
                rows = RunLog(spark, path, st.COUNTS_SCHEMA, st._added, 2).snapshot()
            except Exception as e:
                wrong.append(e)
                return
            n, total = sum(r["tp"] for r in rows), sum(r["fp"] for r in rows)
            if total != n * (n - 1) // 2 or n < seen[-1]:
                wrong.append((n, total))
            seen.append(n)

    reader = threading.Thread(target=read)
    reader.start()
    for batch in range(60):
        log.append(batch, _count_row(batch))
    stop.set()
    reader.join()
    assert not wrong and len(seen) > 10
