import math
import re
from collections import Counter

import numpy as np
import pytest

from tablecheck.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, limit):
    """Every document for every item, one by one."""
    vectors = [(i, Counter(terms_of(t))) for i, t in docs]
    vectors = [(i, v, sum(v.values())) for i, v in vectors if v]
    total, length = len(vectors), sum(n for _, _, n in vectors)
    df = Counter(t for _, v, _ in vectors for t in v)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, query in queries.items():
        scored = []
        for doc_id, v, n in vectors:
            m = 100 - 25 + 25 * n * total // length
            score = 0
            for term, times in query.items():
                if tf := v[term]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                    score += times * w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, x[2], -x[0]) for k, x in enumerate(scored[:limit])]
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def pairs(frame, key):
    return [(r[key], r["text"]) for r in frame.collect()]


@pytest.fixture
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.mark.parametrize("postings", [400_000, 700])
def test_whole_tables(spark, docs, benchmark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", postings)
    got = rows(lexical.ranked(spark, docs, benchmark, 5))
    assert got == sorted(brute(pairs(docs, "doc_id"), pairs(benchmark, "item_id"), 5), key=str)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "token ABC123xyz three"), (1, "w5 w6 W7"), (None, "mail two"), (3, None), (4, " ,;")],
        "item_id long, text string",
    )
    expected = brute(pairs(odd, "doc_id"), pairs(items, "item_id"), 20)
    assert rows(lexical.ranked(spark, odd, items)) == sorted(expected, key=str)
    assert {r[0] for r in expected} == {1, None}
    assert lexical.ranked(spark, none, items).collect() == []
    empty = items.limit(0)
    assert lexical.ranked(spark, odd, empty).collect() == []


def test_ties_are_ranked_by_doc_id(spark):
    docs = spark.range(300).selectExpr("299 - id AS doc_id", "'same words here' AS text")
    more = spark.createDataFrame([(300 + i, f"other text {i}") for i in range(400)], docs.schema)
    items = spark.createDataFrame([("a", "words"), ("b", "other 7")], "item_id string, text string")
    got = lexical.ranked(spark, docs.union(more), items, 20)
    assert dict(got.dtypes)["item_id"] == "string"
    ranked = sorted((r.rank, r.doc_id) for r in got.where("item_id = 'a'").collect())
    assert ranked == [(k + 1, k) for k in range(20)]
    best = sorted((r.rank, r.doc_id) for r in got.where("item_id = 'b'").collect())
    assert best[0] == (1, 307) and best[1:] == [(k + 2, 300 + i) for k, i in enumerate([*range(7), *range(8, 20)])]


def test_queries_in_several_blocks(spark, docs, benchmark, monkeypatch):
    whole = rows(lexical.ranked(spark, docs, benchmark, 3))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 1000)
    assert rows(lexical.ranked(spark, docs, benchmark, 3)) == whole


def test_blocks_are_skipped_and_bounds_hold(spark, monkeypatch):
    """Every list holds documents of several topics; only one topic has most terms of the
    query. Blocks of the others are skipped, and no summary is below a document's score."""
    monkeypatch.setattr(lexical, "SEED_DOCS", 50)
    rng = np.random.default_rng(3)
    subsets = [range(12), *(sorted(rng.choice(12, 5, replace=False)) for _ in range(7))]
    docs = []
    for i in range(4000):
        own = rng.permutation(subsets[i % 8])[:9]
        docs.append((i, " ".join([*(f"x{j}" for j in own), *(f"f{k}" for k in rng.integers(50, size=8))])))
    items = [(1, " ".join(f"x{j}" for j in range(12))), (2, "x1 x2 f3")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = lexical.read_queries(
        lexical.query_terms(spark.createDataFrame(items, "item_id long, text string")), 0, 1
    )
    seen = {}
    found = lexical.searched(spark, frame, asked, 10, seen)
    names = dict(enumerate(asked.item_ids))
    got = [(names[r["query"]], r["rank"], r["doc_id"], r["score"]) for r in found.collect()]
    assert sorted(got) == sorted(brute(docs, items, 10))
    plan = seen["plan"]
    batches = seen["index"].toArrow().to_batches()
    skipped = visited = 0
    for segment in lexical.read_segments(batches, len(plan.weights)):
        row = {c: segment.row[c].to_numpy() for c in segment.row if c != "doc_ids"}
        for query, own in enumerate(plan.terms):
            worth = np.zeros(segment.size, np.int64)
            worth[own] = plan.worth[query]
            for k in np.flatnonzero(np.isin(row["block_terms"], plan.visits[query])):
                members = row["block_docs"][row["block_starts"][k] : row["block_starts"][k + 1]]
                at = slice(row["sum_starts"][k], row["sum_starts"][k + 1])
                if at.start == at.stop:
                    assert len(members) < lexical.SMALL
                    continue
                bound = (worth[row["sum_terms"][at]] * row["sum_values"][at]).sum()
                assert bound >= segment.scores(members, worth).max()
                visited += 1
                skipped += bound < plan.floors[query]
    assert skipped > visited / 3, (skipped, visited)


def test_similar_documents_share_blocks():
    sketches = np.repeat(np.eye(4, 16), 40, axis=0)[np.random.default_rng(1).permutation(160)]
    order, starts = lexical.clustered(np.arange(160), sketches)
    assert sorted(order.tolist()) == list(range(160))
    for begin, end in zip(starts, [*starts[1:], 160], strict=True):
        assert end - begin <= lexical.BLOCK
        assert len({sketches[i].argmax() for i in order[begin:end]}) == 1
