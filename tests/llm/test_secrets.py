import base64
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tablecheck.llm import secrets as S

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A,
)
BASE = (
    ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base(text):
    found = [
        (m.start(), k, name, m.end())
        for k, (name, pattern, fits) in enumerate(BASE)
        for m in pattern.finditer(text or "")
        if fits(m)
    ]
    listed = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
    return (*(sum(x[2] == n for x in found) for n, *_ in BASE),
            hashlib.sha256(listed.encode()).hexdigest(), listed)


def agrees(spark, docs):
    rows = S.secrets(spark, docs).collect()
    assert len(rows) == docs.count()
    want = sorted(str((r.doc_id, *base(r.text)[:4])) for r in docs.collect())
    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in rows) == want
    return rows


def test_whole_table(spark):
    rows = agrees(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r.n_assign for r in rows) > 5


def test_odd_rows(spark, odd, none):
    agrees(spark, odd)
    assert S.secrets(spark, none).collect() == []


def test_base_spans_of_hard_texts(spark):
    rng = random.Random(4)
    parts = ["token", "Secret", "=", ": ", "'", "a", "abcdef", "api_key", "AKIA", "AKIA" + "Z" * 16,
             "0" * 24, "f" * 23, "\U0001f600", "é", "\n", "passwd", "token=token:xxxxxx", "TOKEN='"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    agrees(spark, docs)


def planted(n, seed=5):
    """Prose, long words and names of things, and random base64 strings."""
    rng = random.Random(seed)
    words = ["the", "house", "of", "many", "windows", "shone", "while", "rain", "fell", "softly"]
    rows, places = [], {}
    for i in range(n):
        text = " ".join(rng.choices(words, k=60)) + " "
        text += "".join(rng.choices(["under", "stand", "able", "ness", "house"], k=6)) + " "
        text += "getUserNameFromTheRequestHeader "
        if i % 2:
            start = len(text)
            key = base64.b64encode(rng.randbytes(30)).decode()
            text += key
            places[i] = f"random:{start}:{start + len(key)}"
        rows.append((i, text + " end"))
    return rows, places


def test_random_strings_are_told_from_long_words(spark):
    rows, places = planted(200)
    found = S.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hits = sum(r.spans == places.get(r.doc_id, "none") for r in found)
    false = sum("random" in r.spans for r in found if r.doc_id not in places)
    assert hits >= 0.85 * len(places)
    assert false <= 0.1 * len(rows)


@pytest.mark.parametrize("n", [2, 8, 38, 40, 400])
def test_the_number_of_documents_decides_nothing(spark, n):
    """The same kind of table with one key, with 19, 20 and with many."""
    rows, places = planted(n)
    found = S.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hits = sum(r.spans == places.get(r.doc_id, "none") for r in found)
    assert hits >= (0.85 if n > 8 else 0.7) * len(places)
    assert sum("random" in r.spans for r in found if r.doc_id not in places) <= 0.1 * n


def test_repeating_a_table_changes_no_verdict(spark):
    rows, _ = planted(20)
    seen = []
    for copies in (1, 3, 25):
        again = [(1000 * k + i, t) for k in range(copies) for i, t in rows]
        found = S.secrets(spark, spark.createDataFrame(again, "doc_id long, text string")).collect()
        seen.append(sorted((r.doc_id, r.spans) for r in found if r.doc_id < 1000))
    assert seen[0] == seen[1] == seen[2]


def test_chances_fall_with_length_and_randomness():
    by_length = [S.chance(n, 0.1, 0, 0) for n in S.LENGTHS]
    by_score = [S.chance(28, r / 100, 0, 0) for r in range(101)]
    assert by_length == sorted(by_length, reverse=True)
    assert by_score == sorted(by_score, reverse=True)
    # Controls that look random raise a chance, others don't lower it.
    assert S.chance(40, 0.5, 0, 10**6) == S.chance(40, 0.5, 0, 0)
    assert S.chance(40, 0.5, 500, 1000) > 0.4


def test_stepping_up_is_the_largest_rank_that_fits():
    rng = random.Random(8)
    for _ in range(300):
        tested = [(rng.random() ** rng.choice([1, 4]), rng.randint(1, 5)) for _ in range(rng.randint(0, 12))]
        each = sorted(p for p, n in tested for _ in range(n))
        fits = [p for k, p in enumerate(each, 1) if p * len(each) <= S.FALSE_SHARE * k]
        assert S.stepped_up(tested) == (max(fits) if fits else -1.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 2000])
def test_running_sums_and_maxima(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 1000) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        S.running(F.col("v"), lambda a, b: a + b).alias("sums"),
        S.running(F.col("v"), lambda a, b: F.when(a.isNotNull(), F.greatest(a, b))).alias("most"),
    ).first()
    assert row.sums == list(itertools.accumulate(values))
    assert row.most == list(itertools.accumulate(values, max))


def test_runs_apart_from_base_spans(spark):
    rng = random.Random(12)
    cases = []
    for _ in range(300):
        base = [(a, rng.randint(0, 2), a + rng.randint(1, 30)) for a in rng.sample(range(300), rng.randint(0, 8))]
        runs, at = [], 0
        while at < 300 and len(runs) < 8:
            at += rng.randint(0, 30)
            runs.append((at, at + rng.randint(20, 40)))
            at = runs[-1][1]
        cases.append((sorted(base), runs))
    schema = "b array<struct<start:int,kind:int,end:int>>, r array<struct<start:int,end:int>>"
    rows = spark.createDataFrame(cases, schema).select("b", "r", S.apart(F.col("b"), F.col("r")).alias("free"))
    for row in rows.collect():
        assert row.free == [not any(b.start < r.end and b.end > r.start for b in row.b) for r in row.r]


def test_one_text_with_very_many_matches(spark):
    rng = random.Random(3)
    key = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30))
    text = " ".join(f"token={i:06d}x {key}" for i in range(15_000))
    agrees(spark, spark.createDataFrame([(1, text), (2, "token=abcdef")], "doc_id long, text string"))


@pytest.mark.parametrize("run, low, high", [
    ("0123456789abcdef" * 3, 0.0, 0.9),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", 0.0, 1e-3),
    ("abababababababababababababab", 0.0, 1e-3),
    ("7fcb6e114d01bf579d79a237201ad3e39e793795", 0.05, 1.0),
])
def test_the_battery(spark, run, low, high):
    row = spark.createDataFrame([(run,)], "s string").select(S.randomness(F.col("s")).alias("p")).first()
    assert low <= row.p <= high


def test_no_python_runs(spark, docs):
    plan = S.with_runs(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
