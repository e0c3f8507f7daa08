import csv
import io
import random

import pytest

from tablecheck.sources import csvrecords, files
from tablecheck.sources.files import SourceFiles

FIELDS = ["", "a", "b c", "x\ny", 'say "hi"', "\n", '"', ",", 'end"', "\r\n", "é\n,\"", "  ", '""', "a\n\nb"]


def text_of(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=end).writerows(rows)
    return out.getvalue()


def counted(spark, folder, name="a.csv", **how):
    row = files.count_by_file(spark, SourceFiles(str(folder), name, multiline=True, **how)).collect()
    return [(r.rows, r.malformed_rows) for r in row]


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(8))
def test_ranges_of_a_few_bytes_count_like_a_parser(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    rows = [[rng.choice(FIELDS) for _ in range(3)] for _ in range(rng.randint(0, 40))]
    rows = [r for r in rows if r != [""]]
    wide = rng.sample(range(len(rows)), min(len(rows), 3)) if seed % 2 else []
    for i in wide:
        rows[i] = [*rows[i], rng.choice(FIELDS)]
    end = rng.choice(["\n", "\r\n"])
    data = text_of([["k", "l", "m"], *rows], rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), end)
    if rng.random() < 0.5:
        data = data.rstrip("\r\n") if not data.endswith(('"\n', '"\r\n')) else data
    (tmp_path / "a.csv").write_bytes(data.encode())
    assert counted(spark, tmp_path) == [(len(rows), len(wide))]


@pytest.mark.parametrize(
    ("data", "rows", "wide"),
    [
        ("k\n", 0, 0), ("k", 0, 0), ("k\n\n\nx\n\ny\n", 2, 0), ('k,l\n5" pipe,x\n"a",b\n', 2, 0),
        ('k,l\n"never closed,\nx\ny', 1, 0), ('k,l\n"a\n\n\nb",c\n,,\n', 2, 1), ('"k\nl",m\n1,2\n', 1, 0),
    ],
)
def test_plain_cases(spark, tmp_path, small_ranges, data, rows, wide):
    (tmp_path / "a.csv").write_text(data)
    assert counted(spark, tmp_path) == [(rows, wide)]


def test_several_files_and_another_separator(spark, tmp_path, small_ranges):
    for name, n in (("x 1.csv", 5), ("y+2.csv", 0), ("z.csv", 30)):
        (tmp_path / name).write_text(text_of([["k", "l"], *([["a\nb", "c|d;e"]] * n)]).replace(",", "|"))
    got = files.count_by_file(spark, SourceFiles(str(tmp_path), "*.csv", multiline=True, options={"sep": "|"}))
    assert sorted((r.path.rpartition("/")[2], r.rows, r.malformed_rows) for r in got.collect()) == [
        ("x 1.csv", 5, 5), ("y+2.csv", 0, 0), ("z.csv", 30, 30)]  # the separator is not quoted here
    with pytest.raises(files.SourceError, match="35 rows have more fields"):
        files.row_count(spark, SourceFiles(str(tmp_path), "*.csv", multiline=True, options={"sep": ";"}))


def test_texts_as_one_file_are_counted_by_several_tasks(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs.coalesce(1).write.option("header", "true").option("escape", '"').csv(f"{tmp_path}/one")
    source = SourceFiles(f"{tmp_path}/one", "*.csv", multiline=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = files.count_by_file(spark, source)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" in plan
        lines = spark.read.text(f"{tmp_path}/one")
        assert lines.rdd.getNumPartitions() >= 4
        assert [(r.rows, r.malformed_rows) for r in found.collect()] == [(docs.count(), 0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_quotes_and_encodings_take_the_parser(spark, tmp_path):
    assert csvrecords.can_split({}) and csvrecords.can_split({"sep": ";"})
    assert not any(csvrecords.can_split({k: v}) for k, v in
                   (("quote", "'"), ("encoding", "UTF-16"), ("lineSep", "|"), ("sep", "||"), ("header", "false")))
    (tmp_path / "a.csv").write_text("k,l\n'a\nb',c\n")
    assert counted(spark, tmp_path, options={"quote": "'"}) == [(1, 0)]


def test_long_quoted_fields(spark, tmp_path):
    long = 'x" ,\n' * 20_000
    (tmp_path / "a.csv").write_text(text_of([["k", "l"], [long, "1"], ["2", long.replace("\n", "")]]))
    assert counted(spark, tmp_path) == [(2, 0)]
