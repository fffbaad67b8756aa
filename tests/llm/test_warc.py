import base64
import hashlib

import numpy as np

from botsift.llm import warc
from botsift.session import scratch_path

BIG = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>" * 9000
PAGES = [(5, "http://a.example.com/x", "same"), (3, "https://b.example.com/Y?q#f", "same"), (9, None, "same"), (1, "no scheme", None), (2, "http://a.example.com/x", ""),
         (7, "http://a b\r\n.example.org/", BIG), (8, "http://z.org", BIG), (None, "http://n.org", "alone"), (None, "http://n.org", "same"), (3, "http://again.org", "same"),
         (4, "http://a.example.com/x", "other\r\n\r\n"), (6, "http://a.example.com/x", "\x00\u2028"), (10, "http://a.example.com/x", "10\r\n")]


def want(pages, least=0):
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        same = [p for p, _, x in pages if (x or "") == (h or "") and p is not None]
        revisit = len(body) >= least and len([1 for _, _, x in pages if (x or "") == (h or "")]) > 1 and bool(same) and (i is None or i > min(same))
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, frame, monkeypatch):
    pages = frame(PAGES, "page_id long, url string, html string")
    for least, shared in ((0, 10**6), (10, 10**6), (0, -1)):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", shared)
        path = scratch_path(spark, "warc-test")
        rows = warc.archive_and_index(pages, least, path).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == want(PAGES, least)
    # each index row points at its record in a plain WARC file
    for r in rows:
        with open(f"{path.removeprefix('file://').removeprefix('file:')}/{r.archive}", "rb") as f:
            f.seek(r.offset)
            record = f.read(r.length)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        assert f"WARC-Payload-Digest: sha1:{r.payload_digest}".encode() in record


def test_index_is_ordered_as_a_whole(frame):
    rng = np.random.default_rng(6)
    pages = [(int(i), f"http://h{rng.integers(3)}.example.com/{rng.integers(4)}", f"p{rng.integers(40)}") for i in rng.permutation(600)]
    table = frame(pages, "page_id long, url string, html string", 7)
    path = warc.write_archives(table, scratch_path(table.sparkSession, "warc-test"))
    rows = warc.merge_runs(warc.read_runs(table.sparkSession, path), range_rows=50).collect()
    rows.sort(key=lambda r: (r.range_no, r.place))
    keys = [(r.url_key, r.timestamp, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == 600 and len({r.archive for r in rows}) > 3 and len({r.range_no for r in rows}) > 3


def test_huge_records_among_small_ones(spark, frame, monkeypatch):
    """Files are rolled by bytes: a few records of megabytes in a row don't make a file of them all."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 18)
    rows = [(i, f"http://s.example.com/{i}", f"small page {i}") for i in range(3000)]
    rows += [(10_000 + i, f"http://huge.example.com/{i}", f"{i} " + "x" * (1 << 20)) for i in range(40)] + [(20_000, "http://mid.example.com/", "y" * 30_000)]
    path = scratch_path(spark, "warc-test")
    got = warc.archive_and_index(frame(rows, "page_id long, url string, html string", 1), 0, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.archive, []).append(r.length)
    assert all(sum(s) <= 4 * (1 << 18) + 2000 or len(s) == 1 for s in sizes.values()) and len(sizes) > 40


def test_the_merge_sorts_nothing_again(spark, frame):
    import re as _re

    table = frame([(i, f"http://h{i % 5}.org/{i % 3}", f"p{i}") for i in range(200)], "page_id long, url string, html string", 4)
    runs = warc.read_runs(spark, warc.write_archives(table, scratch_path(spark, "warc-test")))
    merged = warc.merge_runs(runs, range_rows=40)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not _re.search(r"\bSort\b", plan)
    # runs that come in pieces and out of turn are merged all the same
    mixed = warc.merge_runs(runs.repartition(9, "offset"), range_rows=40).collect()
    mixed.sort(key=lambda r: (r.range_no, r.place))
    keys = [(r.url_key, r.timestamp, r.page_id) for r in mixed]
    assert keys == sorted(keys) and len(keys) == 200


def test_loser_tree():
    rng = np.random.default_rng(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        lists = [sorted(rng.integers(0, 50, int(rng.integers(0, 30))).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(lists, lambda x: x)) == sorted(sum(lists, []))


def test_empty(frame):
    assert warc.archive_and_index(frame([], "page_id long, url string, html string")).collect() == []
