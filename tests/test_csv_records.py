"""Files whose quoted fields hold line breaks: many tasks read the rows that one task reads with ``multiLine``."""

import random

import pytest
from pyspark.sql import functions as F
from table_dirs import SF_SMALL

from botsift.sources.csv import read_posts_csv
from botsift.sources.records import ends_inside, survey


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records cross their ends."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)

    yield size
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _file(tmp_path, text, name="f.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _field(rng, sep):
    kind = rng.random()
    if kind < 0.3:
        return rng.choice(["plain", "", "NA", " spaced ", 'stray"quote', 'two""stray', 'end"', "é😀"])
    text = "".join(rng.choice(["a", " ", '""', "\n", sep, "line\nbreak", '""' + sep, "\n\n", "x" * 9]) for _ in range(rng.randint(0, 6)))
    return f'"{text}"'


def _made_up(seed, n, sep, long=0):
    rng = random.Random(seed)
    lines = [f"id{sep}text{sep}label"]
    for i in range(n):
        fields = [str(i), _field(rng, sep), _field(rng, sep)]
        if rng.random() < 0.1:
            fields.append(rng.choice(["", "more", '"x\ny"']))
        if rng.random() < 0.05:
            fields = fields[:2]
        lines.append(sep.join(fields))
    if long:
        lines.insert(n // 2, f'{n}{sep}"' + "many\nlines " * long + f'"{sep}bot')
    return "\n".join(lines) + "\n"


def plain_end(line, sep, inside=False):
    """Where a line ends, character by character; None where something follows a closing quote (how such a malformed
    field is read is the parser's own)."""
    at, start = 0, not inside
    while at < len(line):
        c = line[at]
        if inside:
            if c == '"':
                if line[at + 1 : at + 2] == '"':
                    at += 1
                elif line[at + 1 : at + 2] not in ("", sep):
                    return None
                else:
                    inside = False
            start = False
        elif c == '"' and start:
            inside, start = True, False
        else:
            start = c == sep
        at += 1
    return inside


def test_maps_of_lines(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choice(['"', '"', ",", "a", '""']) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ['"' * k for k in range(8)]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    got = df.select("s", ends_inside(F.col("s"), ",").alias("e0"), ends_inside(F.concat(F.lit('"'), "s"), ",").alias("e1")).collect()
    judged = 0
    for r in got:
        for end, inside in ((r.e0, False), (r.e1, True)):
            want = plain_end(r.s, ",", inside)
            judged += want is not None
            assert want is None or end == want, (r.s, inside)
    assert judged > 3000


@pytest.mark.parametrize("seed,n,block,long", [(1, 60, 40, 0), (2, 200, 333, 0), (3, 300, 1000, 300), (4, 30, 7, 0), (5, 400, 1 << 20, 0)])
def test_same_rows_as_whole_files(spark, tmp_path, small_blocks, seed, n, block, long):
    path = _file(tmp_path, _made_up(seed, n, ";", long))
    want = _rows(read_posts_csv(spark, path, sep=";", multi_line=True))
    small_blocks(block)
    got = read_posts_csv(spark, path, sep=";")
    assert _rows(got) == want and len(want) > n * 0.8
    assert _rows(got.select("label")) == sorted([(r[2],) for r in want], key=repr)


def test_many_tasks_read_one_file(spark, tmp_path, small_blocks):
    path = _file(tmp_path, _made_up(7, 3000, ","))
    small_blocks(8_000)
    df = read_posts_csv(spark, path)
    tasks = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 0.25 * sum(t["count"] for t in tasks)
    starts = survey(spark, path, ",").collect()
    assert len(starts) > 8 and any(s.inside for s in starts) and any(s.crosses for s in starts)


def test_header_over_blocks_carriage_returns_and_last_line(spark, tmp_path, small_blocks):
    long_names = ["n" * 50, "m" * 60]
    for end in ("\n", "\r\n"):
        text = end.join([",".join(long_names), '1,"a' + end + 'b"', "", '2,c', '"3 "",""",d']) + end * 0
        path = _file(tmp_path, text, f"f{len(end)}.csv")
        want = _rows(read_posts_csv(spark, path, multi_line=True))
        small_blocks(16)
        got = read_posts_csv(spark, path)
        assert _rows(got) == want == [("1", "a\nb"), ("2", "c"), ('3 ","', "d")] and got.columns == long_names
        small_blocks(1 << 20)
    path = _file(tmp_path, "a,b\r1,x\r2,y\r", "returns.csv")
    assert _rows(read_posts_csv(spark, path)) == _rows(read_posts_csv(spark, path, multi_line=True))


def test_many_files_with_columns_in_any_order(spark, tmp_path, small_blocks):
    """More orders than any fixed number of branches, with line breaks in fields, matched by name."""
    rng, want = random.Random(3), []
    names = ["a", "b", "c", "d"]
    folder = tmp_path / "files"
    folder.mkdir()
    for f in range(30):
        order = rng.sample(names, 4)
        rows = [{c: f"{c}{f}.{i}" + ("\nmore" if rng.random() < 0.3 else "") for c in names} for i in range(20)]
        want += [tuple(r[c] for c in names) for r in rows]
        (folder / f"{f}.csv").write_text("\n".join([",".join(order), *[",".join(f'"{r[c]}"' for c in order) for r in rows]]) + "\n")
    small_blocks(200)
    got = read_posts_csv(spark, str(folder))
    assert got.columns == names and _rows(got) == sorted(want, key=repr)
    (folder / "z.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError, match="different columns"):
        read_posts_csv(spark, str(folder))


def test_bad_lines_in_records(spark, tmp_path):
    path = _file(tmp_path, 'tweet,label\n"two\nlines",1\nok,0\n"a\nb",1,extra\n')
    assert _rows(read_posts_csv(spark, path)) == [("ok", "0"), ("two\nlines", "1")]
    assert len(_rows(read_posts_csv(spark, path, on_bad="keep"))) == 3
    with pytest.raises(Exception, match="too many fields"):
        read_posts_csv(spark, path, on_bad="fail").collect()


def test_changed_splits_are_an_error(spark, tmp_path, small_blocks):
    path = _file(tmp_path, _made_up(11, 200, ","))
    small_blocks(500)
    df = read_posts_csv(spark, path)
    small_blocks(300)
    with pytest.raises(Exception, match="split differently"):
        df.withColumn("more", F.lit(1)).collect()


def test_records_are_told_apart_and_scored_without_a_copy(spark, tmp_path, small_blocks):
    """Identities of records: one each, the same in every job and behind any shuffle; scoring writes no copy of the texts."""
    from botsift.operators.registry import fit_all_models
    from botsift.operators.textmodels import score_models
    from botsift.plans import catalog
    from botsift.sources.csv import write_csv
    from botsift.sources.rows import ROW

    path = _file(tmp_path, _made_up(13, 500, ","))
    small_blocks(700)
    df = read_posts_csv(spark, path, row_id=True)
    rows = df.collect()
    assert len({tuple(r[ROW]) for r in rows}) == len(rows) and any(r[ROW].at == -1 for r in rows)
    again = {tuple(r[ROW]): r.id for r in df.repartition(7).collect()}
    assert again == {tuple(r[ROW]): r.id for r in rows}
    assert _rows(df.drop(ROW)) == _rows(read_posts_csv(spark, path))
    small_blocks(1 << 20)
    sp = catalog.split_posts(spark, SF_SMALL)
    models = fit_all_models(sp.filter("split = 'train'"))
    folder = str(tmp_path / "posts")
    write_csv(sp.select("post_id", "text", "label").withColumn("text", F.concat("text", F.lit("\nmore"))), folder)
    posts = read_posts_csv(spark, folder, row_id=True)
    scored = score_models(posts, models)
    assert "numbered-" not in scored._jdf.queryExecution().executedPlan().toString()
    plain = score_models(posts.drop(ROW), models)
    key = lambda d: sorted((r.post_id, round(r.p_nb_word, 9)) for r in d.collect())
    assert key(scored) == key(plain) and scored.count() == sp.count()
    with pytest.raises(ValueError, match="told apart"):
        read_posts_csv(spark, path, multi_line=True, row_id=True)
