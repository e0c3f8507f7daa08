from pathlib import Path

import pytest

from tablecheck.sources import files, tables as T
from tablecheck.sources.files import SourceError, SourceFiles
from workload import loads


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def count(spark, folder, path, **options):
    return files.row_count(spark, SourceFiles(str(folder), path, **options))


def test_quoted_newlines_need_multiline(spark, tmp_path):
    write(tmp_path, "a.csv", 'id,t\n1,"x\ny"\n2,"say ""hi"""\n3,z\n')
    assert count(spark, tmp_path, "a.csv", multiline=True) == 3
    source = SourceFiles(str(tmp_path), "a.csv", multiline=True)
    assert [r.t for r in files.read(spark, source).orderBy("id").collect()] == [
        "x\ny", 'say "hi"', "z"
    ]


@pytest.mark.parametrize("multiline", [False, True])
def test_blank_lines_short_rows_and_empty_fields(spark, tmp_path, multiline):
    write(tmp_path, "a.csv", "id,t\n1,a\n\n,\n2\n3,c\n")
    assert count(spark, tmp_path, "a.csv", multiline=multiline) == 4


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("extra", ["2,b,c", "2,b,c,d", "2,b,"])
def test_rows_with_extra_fields_are_an_error(spark, tmp_path, extra, multiline):
    write(tmp_path, "a.csv", f"id,t\n1,a\n{extra}\n")
    with pytest.raises(SourceError, match="more fields"):
        count(spark, tmp_path, "a.csv", multiline=multiline)


def test_header_only_empty_and_missing_files(spark, tmp_path):
    write(tmp_path, "h.csv", "id,t\n")
    write(tmp_path, "e.csv", "")
    assert count(spark, tmp_path, "h.csv") == 0
    with pytest.raises(SourceError, match="empty"):
        count(spark, tmp_path, "e.csv")
    with pytest.raises(Exception):
        count(spark, tmp_path, "missing.csv")
    with pytest.raises(Exception):
        count(spark, tmp_path, "none_*.csv")


@pytest.fixture
def wildcard_folder(tmp_path):
    for name in ("d/cust_1.csv", "d/cust_2.csv", "d/cust_2xcsv", "d/sub/cust_3.csv", "d/other.csv"):
        write(tmp_path, name, "id\n" + "1\n" * (3 if "2.csv" in name else 1))
    return tmp_path


def names(spark, folder, path, **options):
    listed = files.list_files(spark, SourceFiles(str(folder), path, **options))
    return sorted(r.path.rsplit("/d/", 1)[1] for r in listed.collect())


def test_star_as_glob_and_as_regex(spark, wildcard_folder):
    assert names(spark, wildcard_folder, "d/cust_*.csv") == ["cust_1.csv", "cust_2.csv"]
    assert names(spark, wildcard_folder, "d/cust_*.csv", pattern_mode="regex") == [
        "cust_1.csv", "cust_2.csv", "cust_2xcsv"
    ]
    assert names(spark, wildcard_folder, "d/*.csv", pattern_mode="regex") == [
        "cust_1.csv", "cust_2.csv", "cust_2xcsv", "other.csv", "sub/cust_3.csv"
    ]


def test_root_with_a_scheme(spark, wildcard_folder):
    source = SourceFiles(f"file://{wildcard_folder}/", "/d/cust_*.csv", pattern_mode="regex")
    assert files.list_files(spark, source).count() == 3
    assert files.row_count(spark, source) == 5


def test_all_files_or_the_first(spark, wildcard_folder):
    assert count(spark, wildcard_folder, "d/cust_*.csv") == 4
    assert count(spark, wildcard_folder, "d/cust_*.csv", files="first") == 1
    by_file = files.count_by_file(spark, SourceFiles(str(wildcard_folder), "d/cust_*.csv"))
    assert sorted(r.rows for r in by_file.collect()) == [1, 3]
    with pytest.raises(SourceError, match="no files match"):
        count(spark, wildcard_folder, "d/zzz*.csv", pattern_mode="regex")


def test_file_names_with_spaces_and_plus_signs(spark, tmp_path):
    write(tmp_path, "d/a b+c%1.csv", "id\n1\n2\n")
    by_file = files.count_by_file(spark, SourceFiles(str(tmp_path), "d/*.csv")).collect()
    assert [r.rows for r in by_file] == [2]


def test_json_and_parquet(spark, tmp_path):
    df = spark.range(25)
    df.write.json(str(tmp_path / "j"))
    df.write.parquet(str(tmp_path / "p"))
    assert count(spark, tmp_path, "j", format="json") == 25
    assert count(spark, tmp_path, "p/*.parquet", format="parquet") == 25
    write(tmp_path, "lines/a.json", '{"id": 1}\n\n{"id": 2}\n')
    assert count(spark, tmp_path, "lines/a.json", format="json") == 2
    write(tmp_path, "lines/b.json", '{"id": 1}\n{"id"')
    with pytest.raises(SourceError, match="do not parse"):
        count(spark, tmp_path, "lines/*.json", format="json")
    write(tmp_path, "multi/a.json", '[{"id": 1},\n {"id": 2}]')
    assert count(spark, tmp_path, "multi/a.json", format="json", multiline=True) == 2


def test_unknown_options_are_refused():
    for bad in ({"format": "xml"}, {"files": "last"}, {"pattern_mode": "like"}):
        with pytest.raises(SourceError):
            SourceFiles("/x", "y", **bad)


def test_columns_and_head(spark, tmp_path):
    write(tmp_path, "a.csv", "id,t\n" + "".join(f"{i},x\n" for i in range(20)))
    source = SourceFiles(str(tmp_path), "a.csv")
    assert files.columns(spark, source) == ["id", "t"]
    assert files.head(spark, source, 5).count() == 5


def test_catalog_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tc_ds")
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("tc_ds.t")
    assert T.table_names(spark, ["tc_ds", "no_such_database"]) == ["tc_ds.t"]
    table = T.from_catalog(spark)
    assert table("my-project.tc_ds.t").count() == 3
    size = T.metadata(table, ["tc_ds.t"]).first()
    assert (size.num_columns, size.num_rows) == (1, 3) and size.modified is not None
    columns = T.columns(spark, table, ["tc_ds.t", "tc_ds.gone"], {"tc_ds.t": ["ID"]}).collect()
    assert [(c.column_name, c.kind, c.mode) for c in columns] == [("id", "INTEGER", "REQUIRED")]
    spark.sql("DROP TABLE tc_ds.t")
    spark.sql("DROP DATABASE tc_ds")


def test_metadata_of_a_frame_without_files(spark):
    size = T.metadata(T.from_frames({"x": spark.range(4)}), ["x"]).first()
    assert size.num_rows == 4 and size.created is None


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("row, wrong", [
    ("3,4,,9", True), ("3,4,,", True), ('"a,b",c', False), ('"a ""x"", b",c', False),
    ('"a,b",c,"d,e"', True), ("5", False), (",", False), (",,", True),
])
def test_surplus_fields_are_counted_outside_quotes(spark, tmp_path, row, wrong, multiline):
    write(tmp_path, "a.csv", f"a,b\n1,2\n{row}\n")
    found = files.count_by_file(spark, SourceFiles(str(tmp_path), "a.csv", multiline=multiline)).first()
    assert (found.rows, found.malformed_rows) == (2, int(wrong))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "id,name\n1,x\n")
    write(tmp_path, "b.csv", "name,id\ny,2\n")
    source = SourceFiles(str(tmp_path), "*.csv")
    for read in (lambda: files.read(spark, source).collect(), lambda: files.row_count(spark, source)):
        with pytest.raises(Exception, match="(?i)header"):
            read()


def test_a_source_without_a_place_is_refused():
    for bad in ((None, "x"), ("x", None), (3, "x")):
        with pytest.raises(SourceError, match="needs a"):
            SourceFiles(*bad)


def test_much_text_makes_several_files_of_the_ranges_query(spark, tmp_path, monkeypatch):
    """No task writes all documents; all are counted."""
    rows = [(k, f'line {k}\n"quoted", {k}' + "x" * 50, "en") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    roots = []
    shared = loads.shared_dir
    monkeypatch.setattr(loads, "shared_dir", lambda s, name: roots.append(shared(s, name)) or roots[-1])
    for limit, expected in ((1 << 20, 1), (8_000, 4)):
        monkeypatch.setattr(loads, "ONE_FILE_BYTES", limit)
        assert tuple(loads.source_multiline_ranges(spark, str(tmp_path)).first()) == (400, 0)
        files_there = [f for f in Path(roots[-1].removeprefix("file:")).iterdir() if f.suffix == ".csv"]
        assert len(files_there) == expected
