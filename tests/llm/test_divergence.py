import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import divergence as D

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    hit = {k for i, x in enumerate(windows) if x in often for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def agrees(spark, docs):
    rows = D.quality_rules(spark, docs).collect()
    assert len(rows) == docs.count()
    want = sorted(str((r.doc_id, *base(r.text))) for r in docs.collect())
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                       r.n_repeat_words, r.base_failed)) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_whole_table_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in agrees(spark, docs)}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality == 1]
    bad = [rows[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.99
    assert np.mean([not r.kept for r in bad]) > 0.55


def test_odd_rows(spark, odd, none):
    agrees(spark, odd)
    agrees(spark, odd.select("doc_id", "text"))
    assert D.quality_rules(spark, none).collect() == []


def test_repeats_in_many_places(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(200)]
    texts += ["x\n x\nx\n\n \nx", "a b c d e a b c d e", "a a a a a a", "a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    agrees(spark, docs)


def js(p, q):
    def part(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)

    return math.sqrt(max(0.0, 0.5 * part(p, q) + 0.5 * part(q, p)))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("docs", [0.0, 1.0, 50.0, 1e9])
def test_distances_are_jensen_shannon(spark, seed, docs):
    rng = np.random.default_rng(seed)
    words, classes = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(len(D.CLASSES)))
    bins = [5] * D.BUCKETS
    for i in range(5):
        bins[100 * i + 7] = i
    buckets = rng.choice([7, 107, 207, 900, 1000], size=50).tolist()
    counts = rng.integers(0, 50, size=len(D.CLASSES)).tolist()
    schema = "b array<int>, c array<bigint>, bins array<tinyint>, w array<double>, r array<double>, n double"
    row = spark.createDataFrame([(buckets, counts, bins, words.tolist(), classes.tolist(), docs)], schema).select(
        D.word_distance(F.col("b"), F.col("bins"), F.col("w"), F.col("n")).alias("w"),
        D.class_distance(F.col("c"), F.col("r"), F.col("n")).alias("c"),
    ).first()
    share = np.bincount([bins[b] for b in buckets], minlength=6) / 50
    m = docs / (docs + D.PRIOR_DOCUMENTS)
    assert row.w == pytest.approx(js(share, m * words + (1 - m) * share), abs=1e-6)
    mixed = [m * classes + (1 - m) * np.array(s) for s in D.SCRIPTS]
    assert row.c == pytest.approx(min(js(np.array(counts) / sum(counts), q) for q in mixed), abs=1e-6)


def test_scripts_are_shares():
    assert all(sum(s) == pytest.approx(1) and len(s) == len(D.CLASSES) for s in D.SCRIPTS)


def test_references_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = D.profiles(spark, docs)
    refs = {r.lang: r for r in D.references(rows).collect()}
    seen = {(r.lang, r.key): r for r in rows.collect() if not r.base_failed}
    assert set(refs) == {lang for lang, _ in seen}
    for lang, ref in refs.items():
        mine = [r for (x, _), r in seen.items() if x == lang]
        assert ref.docs == pytest.approx(sum(min(r.n_words, 40) for r in mine) / 40)
        count, classes = Counter(), np.zeros(len(D.CLASSES))
        for r in mine:
            for b in r.buckets:
                count[b] += min(r.n_words, 40) / r.n_words
            classes += min(r.n_words, 40) * np.array(r.classes) / sum(r.classes)
        assert list(ref.ref_classes) == pytest.approx(list(classes / classes.sum()), abs=1e-5)
        placed = {b: i for b, i in enumerate(ref.bins) if i < D.COMMON}
        assert len(placed) == D.COMMON == len(ref.ref_words) - 1
        whole = sum(count.values())
        for b, i in placed.items():
            assert ref.ref_words[i] == pytest.approx(count[b] / whole, abs=1e-5)
        assert min(count[b] for b in placed) >= max(n for b, n in count.items() if b not in placed) - 1e-4


def test_more_languages_than_are_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(str, D.quality_rules(spark, docs).collect()))
    monkeypatch.setattr(D, "BROADCAST_LANGUAGES", 1)
    assert sorted(map(str, D.quality_rules(spark, docs).collect())) == want


def test_no_python_runs(spark, docs):
    rows = D.profiles(spark, docs)
    plan = rows._jdf.queryExecution().toString() + D.quality_rules(spark, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_a_document_is_judged_by_its_own_language(spark):
    rng = random.Random(5)
    english = [f"{a}{b}" for a in "bcdfghlmnp" for b in ("at", "en", "ir", "ost", "und", "aver")]
    greek = [f"{a}{b}" for a in "βγδζθκλμνπ" for b in ("ατ", "εν", "ιρ", "οστ", "υνδ", "αβερ")]
    rows = [(i, prose(rng, english, 300), "en") for i in range(80)]
    noise = " ".join("".join(rng.choices("#$%&|0123456789", k=7)) for _ in range(5000))
    rows += [(1000, prose(rng, greek, 500), "el"), (1001, prose(rng, greek, 500), "en"),
             (1002, noise, None), (1003, noise, "en"), (1004, prose(rng, greek, 5000), "xx")]
    rows += [(2000 + i, noise + " end", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in D.quality_rules(spark, docs).collect()}
    # A language with one document is judged by its script, and mildly by its words.
    assert found[1000].kept and found[1004].kept
    # Neither a long document nor many copies of it make noise a reference of others.
    assert not any(found[i].kept for i in (1001, 1002, 1003, 2000))
    assert all(found[i].kept for i in range(80))


def test_no_number_of_documents_makes_a_verdict_jump(spark):
    """One text of each kind beside 0, 5, 49, 50 and 500 others of its language."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghlmnp" for b in ("at", "en", "ir", "ost", "und", "aver")]
    good = prose(rng, words, 300)
    noise = " ".join("".join(rng.choices("#$%&|0123456789", k=7)) for _ in range(300))
    rows, sizes = [], (0, 5, 49, 50, 500)
    for n in sizes:
        rows += [(f"good {n}", good, f"l{n}"), (f"noise {n}", noise, f"l{n}")]
        rows += [(f"{n} {i}", prose(random.Random(i), words, 60), f"l{n}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    found = {r.doc_id: r for r in D.quality_rules(spark, docs).collect()}
    for n in sizes:
        assert found[f"good {n}"].kept and not found[f"noise {n}"].kept
    for kind in ("good", "noise"):
        for by in ("class_distance", "word_distance"):
            assert abs(found[f"{kind} 49"][by] - found[f"{kind} 50"][by]) < 0.01
