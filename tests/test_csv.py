"""Hand-made delimited-file cases (bad lines, quotes, null words, line breaks)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from botsift.sources.csv import read_posts_csv, read_prepared_test, write_csv
from botsift.sources.columns import normalize_columns, detect_columns, select_text_label

CASES = (
    'a;text;account.type;extra\n'
    '1;hello;human;x\n'
    '2;"a;b";bot\n'
    '3;too;bot;x;more\n'
    '4;too;bot;x;more;evenmore\n'
    '5\n'
    '6;;bot;\n'
    '7;t;bot;x;\n'
    '8;t;bot;x;;z\n'
    '9;NA;bot;x\n'
    '10;"q""q";bot;x\n'
    '11;"multi\nline";bot;x\n'
)


def _file(content, name="f.csv"):
    d = tempfile.mkdtemp(prefix="botsift-csv-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_bad_lines_and_values(spark):
    rows = {r.a: r for r in read_posts_csv(spark, _file(CASES), sep=";").collect()}
    assert set(rows) == {"1", "2", "5", "6", "9", "10", "11"}        # 3, 4, 7, 8 have too many fields
    assert rows["2"].text == "a;b" and rows["2"].extra is None
    assert rows["5"].text is None and rows["6"].text is None
    assert rows["9"].text is None                                     # a null word
    assert rows["10"].text == 'q"q'
    assert rows["11"].text == "multi\nline"


def test_pruned_read_keeps_the_rule(spark):
    df = read_posts_csv(spark, _file(CASES), sep=";").select("a")
    assert sorted(r.a for r in df.collect()) == sorted(["1", "2", "5", "6", "9", "10", "11"])


def test_prepared_file_fails_on_long_line(spark):
    p = _file("tweet,label\nhello,1\nbad,1,extra\n")
    with pytest.raises(Exception):
        read_prepared_test(spark, p).collect()
    ok = read_prepared_test(spark, _file("tweet,label\nhello,1\n,0\n")).collect()
    assert [(r.tweet, r.label) for r in ok] == [("hello", "1"), (None, "0")]


def test_round_trip_keeps_text(spark):
    texts = ["  lead and trail  ", 'quote " inside', "semi;colon", "line\nbreak", "tab\there", " sep"]
    df = spark.createDataFrame([(str(i), t, "bot") for i, t in enumerate(texts)], "post_id string, text string, `account.type` string")
    d = tempfile.mkdtemp(prefix="botsift-rt-")
    write_csv(df, d + "/out", sep=";")
    back = {r.post_id: r.text for r in read_posts_csv(spark, d + "/out", sep=";").collect()}
    assert back == {str(i): t for i, t in enumerate(texts)}


def test_column_handling(spark):
    df = spark.createDataFrame([("1", "x", "bot")], "` ID `  string, `Tweet` string, ` Account.Type ` string")
    n = normalize_columns(df)
    assert n.columns == ["id", "tweet", "account.type"]
    assert detect_columns(n.columns) == ("tweet", "account.type")
    assert select_text_label(n, keep=("id",)).columns == ["id", "text", "label"]
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([("a", "b")], "`A` string, `a ` string"))
    with pytest.raises(ValueError):
        detect_columns(["id", "body"])


def test_surplus_fields_counted_outside_quotes(spark):
    """Empty surplus fields and separators inside quoted fields (also spanning lines)."""
    content = ('a,text,label\n'
               '1,"x,y,z",bot\n'            # separators inside quotes: 3 fields, kept
               '2,t,bot,,\n'                # two empty surplus fields: skipped
               '3,"p ""q"", r",bot,,z\n'    # doubled quotes inside a quoted field, 5 fields: skipped
               '4,"two\nlines,here",bot\n'  # quoted line break and separator: kept
               '5,a"b,bot\n')               # a quote inside an unquoted field is a character: kept
    rows = {r.a: r for r in read_posts_csv(spark, _file(content), sep=",").collect()}
    assert set(rows) == {"1", "4", "5"}
    assert rows["1"].text == "x,y,z" and rows["4"].text == "two\nlines,here"


def test_long_quoted_text_counts_without_deep_regex_recursion(spark):
    long_text = ('word, "quoted" ; ' * 20000)
    quoted = '"' + long_text.replace('"', '""') + '"'
    content = f"a,text,label\n1,{quoted},bot\n2,{quoted},bot,,\n"
    rows = {r.a: r for r in read_posts_csv(spark, _file(content), sep=",").collect()}
    assert set(rows) == {"1"} and rows["1"].text == long_text


def test_regex_special_separator(spark):
    content = 'a|text|label\n1|"x|y"|bot\n2|t|bot||\n3|u|human\n'
    rows = {r.a: r for r in read_posts_csv(spark, _file(content), sep="|").collect()}
    assert set(rows) == {"1", "3"} and rows["1"].text == "x|y"


def _write(folder, **files):
    import os

    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as f:
            f.write(text)
    return folder


def test_files_with_columns_in_another_order_are_matched_by_name(spark, tmp_path):
    path = _write(str(tmp_path / "a"), one="text,label\nhello,bot\n", two="label,text\nhuman,world\nbot,NA\n")
    rows = read_posts_csv(spark, path).collect()
    assert sorted((r.text or "", r.label) for r in rows) == [("", "bot"), ("hello", "bot"), ("world", "human")]
    path = _write(str(tmp_path / "b"), one="text,label\nhello,bot\n", two="label,body\nhuman,world\n")
    with pytest.raises(ValueError, match="different columns"):
        read_posts_csv(spark, path)


def test_a_large_file_without_quoted_line_breaks_is_split(spark, tmp_path):
    rows = "".join(f'{i};"text; ""{i}""";bot\n' if i % 3 else f"{i};plain;bot;surplus;x\n" for i in range(20_000))
    path = _write(str(tmp_path / "a"), one="a;text;label\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = read_posts_csv(spark, path, sep=";")
        whole = read_posts_csv(spark, path, sep=";", multi_line=True)
        parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
        assert parts(split) > 3 and parts(whole) == 1
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
        assert split.count() == sum(i % 3 > 0 for i in range(20_000))
        broken = _write(str(tmp_path / "b"), one='a;text;label\n1;"two\nlines";bot\n' + rows)
        read = read_posts_csv(spark, broken, sep=";")
        assert parts(read) > 3 and read.filter("text = 'two\nlines'").count() == 1
        whole = read_posts_csv(spark, broken, sep=";", multi_line=True)
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
