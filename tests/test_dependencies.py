import itertools
import random

import pandas as pd
import pytest

from tablecheck.operators import dependencies as dep

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents pages benchmark"
    " labels conversations"
).split()


def keyed(row, columns):
    return tuple(row[c] for c in columns)


def rows_of(df):
    def plain(v):
        return "nan" if isinstance(v, float) and v != v else v

    return [{c: plain(r[c]) for c in df.columns} for r in df.collect()]


def brute_keys(rows, columns, size):
    found = []
    for k in range(1, size + 1):
        for own in itertools.combinations(columns, k):
            if not any(set(f) <= set(own) for f in found):
                if rows and len({keyed(r, own) for r in rows}) == len(rows):
                    found.append(own)
    return sorted(found)


def brute_dependencies(rows, columns, size, error):
    keys = brute_keys(rows, columns, size)
    found = {}
    for k in range(1, size + 1):
        for own in itertools.combinations(columns, k):
            if any(set(f) <= set(own) for f in keys):
                continue
            parts = {}
            for r in rows:
                parts.setdefault(keyed(r, own), []).append(r)
            for c in columns:
                if c in own or any(d == c and set(s) <= set(own) for s, d in found):
                    continue
                bad = sum(len(p) for p in parts.values() if len({r[c] for r in p}) > 1)
                if bad <= error * len(rows):
                    found[own, c] = bad
    return sorted((s, c, n) for (s, c), n in found.items())


def keys_of(df, **how):
    return sorted(tuple(r.key_columns) for r in dep.minimal_keys(df, **how).collect())


def dependencies_of(df, **how):
    return sorted((tuple(r.determinant), r.dependent, r.violating_rows) for r in dep.dependencies(df, **how).collect())


def test_keys_of_every_given_table(spark, monkeypatch):
    monkeypatch.setattr(dep, "SAMPLE_ROWS", 100)
    for table in TABLES:
        df = spark.read.parquet(f"{SF}/{table}.parquet")
        assert keys_of(df) == brute_keys(rows_of(df), df.columns, 3), table


def joined(spark):
    load = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    part = load("part").select("p_partkey", "p_name", "p_brand", "p_size")
    supplier = load("supplier").select("s_suppkey", "s_name", "s_nationkey")
    lines = load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    both = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    planted = "CASE WHEN l_orderkey % 700 = 3 THEN 'Brand#?' ELSE p_brand END AS p_brand"
    return both.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", planted, "s_name", "s_nationkey")


@pytest.mark.parametrize(("error", "sample"), [(0.0, 500), (0.4, 500)])
def test_dependencies_of_a_joined_table(spark, monkeypatch, error, sample):
    monkeypatch.setattr(dep, "SAMPLE_ROWS", sample)
    df = joined(spark)
    got = dependencies_of(df, error=error)
    assert got == brute_dependencies(rows_of(df), df.columns, 2, error)
    assert (("l_suppkey",), "s_name", 0) in got
    planted = [n for s, c, n in got if s == ("l_partkey",) and c == "p_brand"]
    assert bool(planted) == (error > 0) and all(n > 0 for n in planted)


@pytest.mark.parametrize("seed", range(2))
def test_small_tables_with_nulls_and_odd_values(spark, monkeypatch, seed):
    monkeypatch.setattr(dep, "SAMPLE_ROWS", 8)
    rng = random.Random(seed)
    rows = [
        (rng.choice([1, 2, None]), rng.choice(["x", "y", "", None]), rng.choice([0.0, -0.0, float("nan"), 1.5]),
         rng.choice([True, None]), rng.choice([b"a", b"b"]), k // 3)
        for k in range(25)
    ]
    schema = "`a.b` int, t string, f double, o boolean, y binary, k long"
    df = spark.createDataFrame(rows, schema)
    plain = [{c: (bytes(v) if isinstance(v, bytearray) else v) for c, v in r.items()} for r in rows_of(df)]
    assert keys_of(df) == brute_keys(plain, df.columns, 3)
    assert dependencies_of(df) == brute_dependencies(plain, df.columns, 2, 0)


def test_empty_single_and_repeated_rows(spark):
    schema = "a int, b string"
    assert keys_of(spark.createDataFrame([], schema)) == []
    assert dependencies_of(spark.createDataFrame([], schema)) == []
    assert keys_of(spark.createDataFrame([(1, "x")], schema)) == [("a",), ("b",)]
    twice = spark.createDataFrame([(1, "x"), (1, "x")], schema)
    assert keys_of(twice) == []
    assert dependencies_of(twice) == [(("a",), "b", 0), (("b",), "a", 0)]
    with pytest.raises(ValueError, match="cannot be compared"):
        dep.minimal_keys(spark.createDataFrame([([1],)], "v array<int>"), ["v"])


def test_sets_ruled_out_are_not_grouped(spark, monkeypatch):
    """One aggregate for each level, and in it only the sets that are still open."""
    monkeypatch.setattr(dep, "SAMPLE_ROWS", 1_000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    table = dep._Table(lines, None)
    search = dep._Search(table, 3, 0.0).run(dependencies=False)
    sets = sum(1 for k in (1, 2, 3) for _ in itertools.combinations(table.names, k))
    assert search.grouped_sets < sets / 3
    frame = pd.DataFrame([r.asDict() for r in lines.collect()])
    assert all(not frame.duplicated(list(k)).any() for k in search.keys) and search.keys


def test_repeated_values_of_many_columns_in_one_shuffle(spark):
    rng = random.Random(6)
    rows = [tuple(rng.choice([None, *range(k + 2)]) for k in range(60)) for _ in range(50)]
    names = [f"v{k}" for k in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    expected = {
        n: sum(c > 1 for c in pd.Series([r[k] for r in rows]).value_counts(dropna=False)) for k, n in enumerate(names)
    }
    assert dep.repeated_values(df, names) == expected
    assert dep.repeated_values(df, []) == {}
    assert dep.repeated_values(df.limit(0), ["v3"]) == {"v3": 0}


@pytest.mark.parametrize("error", [0.0, 0.2])
def test_only_sets_of_values_with_many_rows_are_grouped_by_grouping_sets(spark, monkeypatch, error):
    """The others are grouped at their home, from one shuffle for many sets."""
    monkeypatch.setattr(dep, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(dep, "TASK_ROWS", 40)
    monkeypatch.setattr(dep, "SLICED_FROM", 10)
    rng = random.Random(5)
    rows = [
        (k // 2, rng.choice([None, "x", "y"]), k % 2, str(k // 6), None if k % 5 == 0 else k // 3, rng.choice([1, 2]))
        for k in range(300)
    ]
    df = spark.createDataFrame(rows, "a int, b string, c long, d string, e int, f int")
    table = dep._Table(df, None)
    hot = {"b", "c", "e", "f"}  # NULL is the value of 60 rows of e
    grouped = dep._grouped

    def watched(own, frame, wanted):
        assert frame is not own.rows or all(set(s) <= hot for s in wanted), wanted
        return grouped(own, frame, wanted)

    monkeypatch.setattr(dep, "_grouped", watched)
    rows = rows_of(df)
    assert keys_of(df) == brute_keys(rows, table.names, 3) and ("a", "c") in keys_of(df)
    assert dependencies_of(df, error=error) == brute_dependencies(rows, table.names, 2, error)
