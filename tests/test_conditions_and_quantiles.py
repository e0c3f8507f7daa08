import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import quantiles
from tablecheck.operators.conditions import conditions, evidence, items_of
from tablecheck.operators.quantiles import column_quantiles, robust_outliers, robust_ranges
from tablecheck.plans.suggestions import suggest_checks

SF = "/root/testdata/sf0.001"
TESTS = {
    "=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b,
}


def strongest(pairs, error, ordered=True):
    for operator, test in TESTS.items():
        if not ordered and operator != "=":
            continue
        bad = sum(not test(a, b) for a, b in pairs)
        if pairs and bad <= error * len(pairs) and bad < len(pairs):
            return operator, bad
    return None


def brute(rows, items, error, support=None):
    """(condition, only_where): (rows checked, violating) with the columns as dict keys."""
    value = lambda r, side: 0 if side == "0" else r[side.strip("`")]

    def known(chosen, item):
        pairs = [(value(r, item.left), value(r, item.right)) for r in chosen]
        return [p for p in pairs if all(v is not None and v == v for v in p)]

    out, single = {}, {}
    for item in items:
        pairs = known(rows, item)
        best = strongest(pairs, error, item.ordered)
        if best:
            single[item] = best[0]
            out[item.condition(best[0]), None] = (len(pairs), best[1])
    if support is None:
        return out
    for one, then in itertools.permutations(items, 2):
        for at in ("=", "<", ">"):
            test = TESTS[at]
            chosen = [r for r in rows if (p := known([r], one)) and test(*p[0])]
            pairs = known(chosen, then)
            if len(pairs) < max(1, support * len(rows)) or len(chosen) == len(known(rows, one)):
                continue
            best = strongest(pairs, error, then.ordered)
            states = {"=": "=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "<>": "<>"}
            if best and not (then in single and set(STATES[single[then]]) <= set(STATES[best[0]])):
                out[then.condition(states[best[0]]), one.condition(at)] = (len(pairs), best[1])
    return out


STATES = {"=": "e", "<": "l", ">": "g", "<=": "le", ">=": "ge", "<>": "lg"}


@pytest.mark.parametrize(("seed", "error"), [(0, 0.0), (2, 0.1)])
def test_conditions_are_those_of_every_row(spark, seed, error):
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        a = rng.choice([0, 1, 5, None])
        b = None if a is None else a + rng.choice([0, 1, 2, 3 if rng.random() < 0.97 else -4])
        rows.append((a, b, rng.choice([-1.5, 0.0, float("nan"), 2.0]), rng.choice("xy"), rng.choice("xyz"),
                     rng.choice([True, None])))
    schema = "a int, `b.c` long, f double, s string, t string, o boolean"
    df = spark.createDataFrame(rows, schema).repartition(3)
    plain = [r.asDict() for r in df.collect()]
    got = {(r.condition, r.only_where): (r.rows_checked, r.violating_rows) for r in
           conditions(df, error=error, implied=True, min_support=0.1).collect()}
    assert got == brute(plain, items_of(df), error, 0.1)
    df.createOrReplaceTempView("some_rows")
    for r in conditions(df, error=error, implied=True, min_support=0.1).collect():
        checked = spark.table("some_rows").withColumn("f", spark_nan_to_null("f"))
        assert checked.where(r.violation).count() == r.violating_rows


def spark_nan_to_null(name):
    from pyspark.sql import functions as F

    return F.nanvl(F.col(name), F.lit(None))


def test_evidence_is_small_and_whole(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    items = items_of(lines)
    assert len(items) > 31, "the states take more than one word"
    found = evidence(lines, items)
    total = found.groupBy().sum("n").first()[0]
    assert total == lines.count() and found.count() < total / 10


def test_no_rows_and_nothing_to_compare(spark):
    assert conditions(spark.createDataFrame([], "a int, b int")).collect() == []
    assert conditions(spark.createDataFrame([("x",)], "a string")).collect() == []
    all_null = spark.createDataFrame([(None, None)], "a int, b int")
    assert conditions(all_null, implied=True).collect() == []


def test_suggested_conditions_and_robust_ranges(spark):
    source = spark.createDataFrame([(k % 50, k % 50 + 5, "n") for k in range(500)] + [(3, 90_000, "n")], "low int, high int, s string")
    target = source.union(spark.createDataFrame([(9, 4, "n"), (7, 600, "n")], source.schema))
    rows = suggest_checks("m", target, "t", learn_from=source, learn_conditions=True, robust=True).collect()
    by_name = {r.test_name: r.estimated_failures for r in rows}
    assert by_name["`low` < `high`"] == 1
    assert by_name["high stays in its range"] == 3, "the far value of the source is outside as well"
    plain = suggest_checks("m", target, "t", learn_from=source).collect()
    assert {r.test_name: r.estimated_failures for r in plain}["high stays in its range"] == 1


@pytest.mark.parametrize("accuracy", [100])
def test_rank_error_of_quantiles(spark, accuracy):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 3) for _ in range(20_000)] + [7.0] * 5_000
    rng.shuffle(values)
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double").repartition(11)
    ps = (0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0)
    for r in column_quantiles(df, probabilities=ps, accuracy=accuracy).collect():
        own = [v if r.column_name == "a" else -v for v in values]
        below, upto = sum(v < r.quantile for v in own), sum(v <= r.quantile for v in own)
        slack = len(own) / accuracy + 1
        assert below - slack <= r.probability * len(own) <= upto + slack


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, "x"), (float("nan"), "y")], "v double, s string")
    assert {r.quantile for r in column_quantiles(df).collect()} == {None}
    assert column_quantiles(df.select("s")).collect() == []
    assert robust_ranges(df, ["v"]) == {}
    assert robust_outliers(df, ["v"]).collect() == []


def test_outliers_do_not_hide_each_other(spark):
    values = [float(k % 10) for k in range(1000)] + [1e9] * 60
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert robust_outliers(df, ["v"]).count() == 60
    constant = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    assert robust_outliers(constant, ["v"]).count() == 0
    with pytest.raises(ValueError):
        robust_outliers(spark.createDataFrame([("x",)], "s string"), ["s"])


def test_quantiles_of_high_accuracy_are_exact_without_a_large_sketch(spark, monkeypatch):
    """Also where the first bracket misses, and among repeated, infinite and missing values."""
    rng = random.Random(3)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    rows = [(rng.choice([None, float("nan"), rng.gauss(0, 1), 5.0, math.inf]), k % 7, None) for k in range(2_000)]
    df = spark.createDataFrame(rows, "v double, w int, x double")
    ps = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)

    def refuse(column, p, accuracy):
        assert accuracy <= quantiles.SKETCHED
        return approximate(column, p, accuracy)

    approximate = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", refuse)
    for margin in (3.0, 0.0):
        monkeypatch.setattr(quantiles, "MARGIN", margin or 1e-6)
        got = {(r.column_name, r.probability): r.quantile for r in column_quantiles(df, probabilities=ps, accuracy=2_000_000).collect()}
        for name, at in (("v", 0), ("w", 1)):
            own = sorted(float(r[at]) for r in rows if r[at] is not None and r[at] == r[at])
            assert [got[name, p] for p in ps] == [own[max(math.ceil(p * len(own)), 1) - 1] for p in ps]
        assert {got["x", p] for p in ps} == {None}
    assert robust_outliers(df, ["w"], accuracy=2_000_000).count() == 0
