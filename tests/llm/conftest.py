import duckdb
import pytest

SF = "/root/testdata/sf0.01"

# extra columns whose names the operators use inside
EXTRA = {"fp": 1, "salt": "s", "th": 2, "w": "w", "y": 3, "kind": "text", "block": 4, "shard": 5, "payload": "p", "score": 0.5, "ids": "x",
         "spans": "z", "kept": "k", "pos": 6, "n": 7, "component": 8, "text_hash": 9, "v": "v", "dim": 10, "norm": 1.5,
         "none": True, "id": 11, "hash": 12, "number": 13, "_hash": 14, "__hash": 15, "__none": 16, "__id": 17, "__number": 18, "part": 19, "parts": 20,
         "carried_0": "c", "rank": 22, "numbered": "x", "path": "y", "words": "w"}


@pytest.fixture(scope="session")
def sf_docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def frame(spark):
    """(rows, columns, types) as a table with clashing extra columns, over several partitions."""

    def make(rows, columns, parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, columns)
        return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items() if k not in df.columns]).repartition(parts)

    return make


LONG = "lorem ipsum dolor " * 12_000
HARD = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \t\n "), (None, "a null id"), (None, None),
        (5, "repeated row " * 30), (5, "repeated row " * 30), (6, "repeated row " * 30), (7, LONG), (8, LONG + "end"), (9, "é ñ 中文 😀 \x00 \x1c"),
        (-3, "UPPER Case and lower case"), (5, "same id, other text")]


@pytest.fixture(scope="session")
def hard_rows():
    return HARD


@pytest.fixture(scope="session")
def hard(frame):
    return frame(HARD, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(frame):
    return frame([], "doc_id long, text string")
