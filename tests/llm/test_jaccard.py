import random
import re

import numpy as np
import pandas as pd
import pytest

from tablecheck.llm import jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def expected(sets):
    """Smallest reachable id of every id, comparing all pairs."""
    names = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and names[i] != names[j] and linked(sets[i], sets[j]):
                low, high = sorted((names[i], names[j]))
                names = {k: low if v == high else v for k, v in names.items()}
    return names


def agrees(spark, docs):
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect() if r.doc_id is not None}
    want = expected(sets)
    rows = J.jaccard_components(spark, docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
            continue
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want[r.doc_id], r
        same = [i for i in sets if sets[i] == sets[r.doc_id]] if sets[r.doc_id] else [r.doc_id]
        assert r.class_id == min(same)
    return want


def copies(seed, groups=6, size=40):
    """Copies of copies with random edits, so that similarities lie around the limit."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = rng.choices(vocabulary, k=60)
    rows, made = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(20, 160))
        texts = [base]
        for _ in range(size):
            text = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text[: rng.randint(len(text) * 7 // 10, len(text))]
            if rng.random() < 0.2:
                text = shared + text
            texts.append(text)
        for text in texts:
            rows.append((made * 7919 % 100_003, " ".join(text).upper() if made % 9 == 0 else " ".join(text)))
            made += 1
    return rows


@pytest.mark.parametrize("limits", ["usual", "small"])
def test_components_are_exact(spark, monkeypatch, limits):
    if limits == "small":  # many blocks, cells and frequent shingles
        for name, value in (("BLOCK_DOCS", 7), ("LEAF", 4), ("PIVOTS", 3), ("FREQUENT", 4),
                            ("COUNTED_AT_ONCE", 500)):
            monkeypatch.setattr(J, name, value)
    docs = spark.createDataFrame(copies(1), "doc_id long, text string").repartition(4)
    want = agrees(spark, docs)
    assert 1 < len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed", range(8))
def test_region_recursion_is_exact(seed, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 5)
    monkeypatch.setattr(J, "PIVOTS", 4)
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(10_000, size=rng.integers(3, 80), replace=False)
        for _ in range(10):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.1, 0.3])]
            more = rng.integers(10_000, 10_400, size=rng.integers(0, 6))
            sets.append(np.unique(np.concatenate([keep, more, [20_000]])))
    rng.shuffle(sets)
    links = J.region_links(pd.DataFrame({"doc_id": range(len(sets)), "set": sets}))
    names = {i: i for i in range(len(sets))} | dict(zip(links["b"], links["a"]))
    assert names == expected({i: frozenset(s.tolist()) for i, s in enumerate(sets)})


def test_linked_sets_share_enough_first_shingles():
    rng = random.Random(3)
    for _ in range(3000):
        size = rng.randint(1, 120)
        universe = rng.sample(range(1000), size + 60)
        a = set(universe[:size])
        b = set(rng.sample(sorted(a), rng.randint(size * 7 // 10, size)))
        b |= set(rng.sample(universe[size:], rng.randint(0, min(60, size // 4))))
        if not linked(a, b):
            continue
        one, other = (sorted(x)[: J.first_count(len(x))] for x in (a, b))
        common = len(set(one) & set(other))
        assert common >= max(1, J.extra_count(len(a)), J.extra_count(len(b)))


def test_odd_rows(spark, odd, none):
    agrees(spark, odd)
    assert J.jaccard_components(spark, none).collect() == []
    left = J.one_of_each(spark, odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_chains_are_followed_to_the_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    found = {r.doc_id: r.component for r in J.components(spark, links).collect()}
    assert found == {i: 0 for i in range(41)} | {80: 80, 90: 80}
    assert J.components(spark, links.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    agrees(spark, docs)
