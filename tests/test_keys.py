import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablecheck.operators.duplicates import full_row_duplicates, no_duplicates_pk
from tablecheck.operators.inclusion import implied_composite_keys, implied_foreign_keys
from tablecheck.operators.referential import orphan_values, referential_integrity
from tablecheck.operators.rowcount import row_count_match
from tablecheck.sources.tables import from_frames


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_keys_are_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, 2)], "a int, b int")
    assert rows(no_duplicates_pk(df, ["a", "b"])) == [(None, 1, 2)]
    assert rows(no_duplicates_pk(df, ["a"]).na.fill(-1)) == [(-1, 2), (1, 2)]


def test_unknown_key_column_is_refused(spark):
    with pytest.raises(ValueError, match="no column"):
        no_duplicates_pk(spark.range(1), ["nope"])


def hot(n=3000):
    """A third of the rows share one key."""
    rng = random.Random(5)
    return [(7 if i % 3 == 0 else rng.randrange(50_000), f"t{i % 4}") for i in range(n)]


def test_duplicates_with_a_hot_key_against_brute_force(spark):
    data = hot()
    df = spark.createDataFrame(data, "k int, t string").repartition(16)
    expected = sorted((k, n) for k, n in Counter(k for k, _ in data).items() if n > 1)
    assert rows(no_duplicates_pk(df, ["k"])) == expected


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_full_row_duplicates_in_any_plan(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    data = hot()
    df = spark.createDataFrame(data, "k int, t string")
    jobs = spark.sparkContext.statusTracker()
    before = max(jobs.getJobIdsForGroup(None), default=-1)
    found = full_row_duplicates(df)
    assert max(jobs.getJobIdsForGroup(None), default=-1) == before  # building starts no job
    assert rows(found) == sorted((*row, n) for row, n in Counter(data).items() if n > 1)
    with_null = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "k int, t string")
    assert rows(full_row_duplicates(with_null)) == [(None, "a", 2)]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orphans_ignore_null_and_count_occurrences(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "c int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "p bigint")
    assert rows(orphan_values(child, "c", parent, "p")) == [("c", "2", 2)]


def test_null_in_the_parent_does_not_hide_orphans(spark):
    child = spark.createDataFrame([(5,)], "c int")
    parent = spark.createDataFrame([(None,)], "p int")
    assert rows(orphan_values(child, "c", parent, "p")) == [("c", "5", 1)]


def test_orphans_with_hot_value_on_both_sides(spark):
    data = hot()
    child = spark.createDataFrame(data, "k int, t string")
    parent = spark.createDataFrame([(k,) for k, _ in data[:1500]], "k int")
    known = {k for k, _ in data[:1500]}
    counts = Counter(k for k, _ in data if k not in known)
    expected = sorted(("k", str(k), n) for k, n in counts.items())
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert rows(orphan_values(child, "k", parent, "k")) == expected
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixed_types_compare_as_string_only_for_ids(spark):
    child = spark.createDataFrame([(1,), (2,)], "user_id int")
    parent = spark.createDataFrame([("1",), ("x",)], "code string")
    assert rows(orphan_values(child, "user_id", parent, "code")) == [("user_id", "2", 1)]
    with pytest.raises(ValueError, match="cannot compare"):
        orphan_values(child.withColumnRenamed("user_id", "n"), "n", parent, "code")


def test_several_foreign_keys_of_different_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    tables = from_frames({"ds.nums": spark.createDataFrame([(1,)], "v int"),
                          "words": spark.createDataFrame([("b",)], "v string")})
    checks = {"n": {"table": "project.ds.nums", "column": "v"},
              "s": {"table": "words", "column": "v"}}
    assert rows(referential_integrity(df, checks, tables)) == [("n", "2", 1), ("s", "a", 1)]


def test_row_counts(spark):
    result = row_count_match(spark.range(5), spark.range(7)).first()
    assert tuple(result) == (5, 7, 2, "FAIL")
    assert row_count_match(spark.range(0), spark.range(0)).first().status == "PASS"


def brute_inclusion(columns, children, parents):
    out = []
    for c in children:
        for p in parents:
            if c == p:
                continue
            cv = {v for v in columns[c] if v is not None}
            pv = [v for v in columns[p] if v is not None]
            matched = len(cv & set(pv))
            if matched:
                out.append((*c, *p, len(cv), matched, matched / len(cv), len(pv) == len(set(pv))))
    return sorted(out)


def test_implied_foreign_keys_against_brute_force(spark):
    rng = random.Random(1)
    a = [(rng.randrange(40), rng.choice([None, *range(100)]), 1) for _ in range(400)]
    b = [(i, i * 2) for i in range(60)]
    frames = {"a": spark.createDataFrame(a, "x int, y bigint, z int"),
              "b": spark.createDataFrame(b, "k bigint, twice int")}
    columns = {("a", n): [r[i] for r in a] for i, n in enumerate("xyz")}
    columns |= {("b", n): [r[i] for r in b] for i, n in enumerate(["k", "twice"])}
    children = [("a", "x"), ("a", "y"), ("a", "z"), ("b", "twice")]
    parents = [("b", "k"), ("b", "twice"), ("a", "z")]
    got = rows(implied_foreign_keys(from_frames(frames), children, parents))
    assert got == brute_inclusion(columns, children, parents)
    full = rows(implied_foreign_keys(from_frames(frames), children, parents, 1.0))
    assert full == [r for r in got if r[6] == 1.0]


def test_implied_foreign_keys_of_more_columns_than_one_word_holds(spark):
    wide = spark.range(20).select(*((F.col("id") + i).alias(f"c{i}") for i in range(70)))
    frames = from_frames({"w": wide, "k": spark.range(200).withColumnRenamed("id", "key")})
    children = [("w", f"c{i}") for i in range(70)]
    got = rows(implied_foreign_keys(frames, children, [("k", "key"), ("w", "c69")]))
    assert len([r for r in got if r[2] == "k"]) == 70
    assert all(r[4:] == (20, 20, 1.0, True) for r in got if r[2] == "k")
    assert {r[1] for r in got if r[2] == "w"} == {f"c{i}" for i in range(50, 69)}


def test_text_and_number_columns_pair_only_by_id(spark):
    frames = from_frames({"n": spark.createDataFrame([(1,), (2,)], "user_id int"),
                          "m": spark.createDataFrame([(1,)], "amount int"),
                          "t": spark.createDataFrame([("1",)], "code string")})
    got = rows(implied_foreign_keys(frames, [("n", "user_id"), ("m", "amount")], [("t", "code")]))
    assert got == [("n", "user_id", "t", "code", 2, 1, 0.5, True)]
    with pytest.raises(ValueError, match="cannot be a key"):
        implied_foreign_keys(from_frames({"d": spark.range(1).select(F.lit(1.5).cast("double")
                                                                     .alias("v"))}),
                             [("d", "v")], [("d", "v")])


def test_pruning_changes_no_row_and_keeps_columns_from_the_shuffle(spark, tmp_path):
    spark.range(50).selectExpr("id AS near", "id + 5000 AS far", "id * 2 AS even").write.parquet(f"{tmp_path}/c")
    spark.range(60).selectExpr("id AS k", "2 * id + 1 AS odd").write.parquet(f"{tmp_path}/p")
    tables = from_frames({t: spark.read.parquet(f"{tmp_path}/{t}") for t in "cp"})
    children = [("c", "near"), ("c", "far"), ("c", "even")]
    for parents in ([("p", "k"), ("p", "odd")], [("p", "odd")]):
        whole = implied_foreign_keys(tables, children, parents, prune="none")
        pruned = implied_foreign_keys(tables, children, parents, prune="sketches")
        assert rows(pruned) == rows(whole)
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert "far" in whole._jdf.queryExecution().executedPlan().toString()
        assert "far#" not in plan, "by its bounds"
        if parents == [("p", "odd")]:
            assert "even#" not in plan, "by the bitmaps of its hashes"
    assert rows(implied_foreign_keys(tables, [("c", "far")], [("p", "k")])) == []
    bounds = implied_foreign_keys(tables, children, [("p", "k"), ("p", "odd")])
    assert "far#" not in bounds._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="prune must be"):
        implied_foreign_keys(tables, children, [("p", "k")], prune="all")


def brute_composite(tables, children, parents, size):
    out = []
    for k in range(2, size + 1):
        for table in sorted({t for t, _ in children}):
            own = sorted(c for t, c in children if t == table)
            for names in itertools.combinations(own, k):
                values = {v for v in (tuple(r[c] for c in names) for r in tables[table]) if None not in v}
                for parent in sorted({t for t, _ in parents}):
                    for keys in itertools.permutations([c for t, c in parents if t == parent], k):
                        found = [v for v in (tuple(r[c] for c in keys) for r in tables[parent]) if None not in v]
                        matched = len(values & set(found))
                        same = any((table, c) == (parent, d) for c, d in zip(names, keys))
                        if matched and not same:
                            out.append((table, ",".join(names), parent, ",".join(keys), len(values), matched,
                                        matched / len(values), len(found) == len(set(found))))
    return sorted(out)


@pytest.mark.parametrize(("seed", "prune"), [(0, "bounds"), (1, "sketches"), (1, "none")])
def test_composite_keys_against_brute_force(spark, seed, prune):
    rng = random.Random(seed)
    pick = lambda *extra: rng.choice([*range(6), *extra])
    frames = {
        "c": spark.createDataFrame([(pick(None), pick(), pick(77), pick(None)) for _ in range(40)], "a int, b long, d int, e int"),
        "p": spark.createDataFrame([(pick(), pick(None), pick(), 900 + pick()) for _ in range(30)], "x int, y int, z long, w int"),
    }
    plain = {t: [r.asDict() for r in f.collect()] for t, f in frames.items()}
    children = [("c", c) for c in "abde"]
    parents = [("p", c) for c in "xyzw"]
    got = rows(implied_composite_keys(from_frames(frames), children, parents, size=3, prune=prune))
    assert got == brute_composite(plain, children, parents, 3)
    assert any(r[1].count(",") == 2 for r in got)
    high = rows(implied_composite_keys(from_frames(frames), children, parents, 0.5))
    assert high == [r for r in got if r[6] >= 0.5 and r[1].count(",") == 1]
    nothing = implied_composite_keys(from_frames(frames), [("c", "a")], [("p", "w")])
    assert nothing.collect() == []
