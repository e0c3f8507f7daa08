import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import suffixtree as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_rows(rows):
    """The contract's base, document by document."""
    train = [[*words_of(t), None] for i, t in rows if not is_held(i)]
    counts = Counter(w for words in train for w in words)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        words = [*words_of(text), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        known = sum(counts[w] > 0 for w in words)
        out.append((i, is_held(i), len(words), known, n, base))
    return out


def check_base(got, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, wanted = sorted(map(tuple, got), key=key), sorted(base_rows(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in wanted], rel=1e-9)
    assert all(r[6] <= 0 and math.isfinite(r[6]) for r in got)


def test_whole_table(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = st.scored(spark, docs)
    assert f"{', '.join(f'{c} {t}' for c, t in found.dtypes)}" == (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
        " base_score double, score double"
    )
    check_base(found.collect(), rows)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = (
        st.scored(spark, docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"))
    ).first()
    assert (total[0] - total[1]) / total[2] > 0.1


def test_odd_rows(spark, odd, none):
    check_base(st.scored(spark, odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert st.scored(spark, none).collect() == []
    nothing_learnt = st.scored(spark, odd, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing_learnt)
    unknown = st.scored(spark, odd, F.lit(None).cast("boolean")).collect()
    assert not any(r.held_out for r in unknown)


def test_chunks_do_not_change_scores(spark, docs, monkeypatch):
    def rounded(frame):
        return sorted((r.doc_id, round(r.base_score, 6), round(r.score, 6)) for r in frame.collect())

    whole = rounded(st.scored(spark, docs))
    monkeypatch.setattr(st, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(st, "HELD_GRAMS", 500)
    assert rounded(st.scored(spark, docs.repartition(5))) == whole


def dependent(spark):
    """Texts in which a word depends on the two before it, more than on the one."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [rng.choice("ab"), rng.choice("ab")]
        for _ in range(120):
            same = words[-1] == words[-2]
            words.append(rng.choices("ab", (0.9, 0.1) if same else (0.1, 0.9))[0])
        rows.append((i, " ".join([*words, *(f"rare{rng.randrange(5000)}" for _ in range(3))])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def model_of(spark, docs):
    return st.fitted(spark, docs, st.one_in_seven())


def test_contexts_are_kept_where_they_tell_something(spark):
    ready, model = model_of(spark, dependent(spark))
    tree = model.tree
    a, b = st.FIRST_WORD, st.FIRST_WORD + 1
    two = {(int(c) >> st.BITS, int(c) & (2**st.BITS - 1)) for c in tree.levels[1].contexts}
    assert {(a, a), (a, b), (b, a), (b, b)} <= two
    three = [int(c) for c in tree.levels[2].contexts]
    pure = [c for c in three if all((c >> st.BITS * k) & (2**st.BITS - 1) in (a, b) for k in range(3))]
    assert not pure, "a third word back tells nothing"


def test_every_state_is_a_distribution(spark, docs):
    for frame in (docs, dependent(spark)):
        _, model = model_of(spark, frame)
        tree = model.tree
        symbols = np.arange(len(tree.root))
        assert len(tree.parents) > 3
        for node in range(len(tree.parents)):
            total = tree.chance(np.full(len(symbols), node), symbols).sum()
            assert total == pytest.approx(1, abs=1e-9)


def brute_score(chunk, doc, tree, model):
    """One document, word by word, with its contexts looked up in dictionaries."""
    nodes = {}
    for depth, level in enumerate(tree.levels, 1):
        for k, c in enumerate(level.contexts.tolist()):
            nodes[tuple((c >> st.BITS * j) & (2**st.BITS - 1) for j in reversed(range(depth)))] = level.first + k
    begin, size = chunk.begin[doc], chunk.sizes[doc]
    x = chunk.x[begin : begin + size + 2].tolist()
    words = chunk.words[chunk.places.searchsorted(begin) :][:size].tolist()
    total = 0.0
    for i in range(1, len(x)):
        node = next(
            (nodes[tuple(x[i - d : i])] for d in range(min(i, st.DEPTH), 0, -1) if tuple(x[i - d : i]) in nodes), 0
        )
        total += math.log10(tree.chance(np.array([node]), np.array([x[i]]))[0])
        if i <= size and x[i] < st.FIRST_WORD:
            c = chunk.counts[words[i - 1]]
            total += math.log10((c + 1) / model.class_mass[x[i] - st.FIRST_CLASS])
    return total


def test_scores_are_those_of_the_longest_states(spark, docs):
    ready, model = model_of(spark, docs)
    got = {r.doc_id: r.score for r in st.scores(ready, spark.sparkContext.broadcast(model)).collect()}
    seen = 0
    for chunk in st.read_chunks(ready.toArrow().to_batches()):
        for doc, doc_id in enumerate(chunk.doc_ids.to_pylist()):
            if chunk.sizes[doc] < 60:
                assert got[doc_id] == pytest.approx(brute_score(chunk, doc, model.tree, model))
                seen += 1
    assert seen > 5


def whole_scores(chunks, model):
    """(score, held out) of each document, with all contexts in dictionaries."""
    docs = []
    for chunk in chunks:
        for doc, (begin, size) in enumerate(zip(chunk.begin, chunk.sizes, strict=True)):
            words = chunk.words[chunk.places.searchsorted(begin) :][:size]
            inside = sum(
                math.log10((chunk.counts[w] + 1) / model.class_mass[chunk.symbols[w] - st.FIRST_CLASS])
                for w in words
                if chunk.symbols[w] < st.FIRST_WORD
            )
            docs.append((chunk.x[begin : begin + size + 2].tolist(), inside, bool(chunk.held[doc])))
    seen = {}
    for x, _, held in docs:
        for i in range(1, 0 if held else len(x)):
            for d in range(1, min(i, st.DEPTH) + 1):
                seen.setdefault(tuple(x[i - d : i]), Counter())[x[i]] += 1
    kept = {}

    def chance(context, symbol):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return model.tree.root[symbol]
        n, total = seen[context], seen[context].total()
        passed = 1 - (total - st.DISCOUNT * len(n)) / (total + st.MASS)
        own = (n[symbol] - st.DISCOUNT) / (total + st.MASS) if n[symbol] else 0
        return own + passed * chance(context[1:], symbol)

    for context in sorted(seen, key=len):
        n = seen[context]
        before = {s: chance(context[1:], s) for s in n}
        kept[context] = True
        gain = sum(n[s] * math.log(chance(context, s) / before[s]) for s in n)
        if gain <= 0.5 * len(n) * math.log(max(n.total(), 2)):
            del kept[context]
    return kept, [
        (inside + sum(math.log10(chance(tuple(x[max(0, i - st.DEPTH) : i]), x[i])) for i in range(1, len(x))), held)
        for x, inside, held in docs
    ]


@pytest.mark.parametrize("frequent", [1e-9, 1e-3, 0.02, 1.0])
def test_all_contexts_tell(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(st, "FREQUENT", frequent)
    monkeypatch.setattr(st, "BUCKET_PLACES", 5_000)
    some = docs.where("doc_id % 10 = 3").repartition(3)
    ready, model = model_of(spark, some)
    kept, wanted = whole_scores(st.read_chunks(ready.toArrow().to_batches()), model)
    assert any(len(c) == st.DEPTH for c in kept)
    got = sorted((r.score, r.held_out) for r in st.scored(spark, some).collect())
    assert [g[0] for g in got] == pytest.approx([w[0] for w in sorted(wanted)], rel=1e-9)
    assert [g[1] for g in got] == [w[1] for w in sorted(wanted)]


def test_a_passage_seen_twice_tells_in_a_large_corpus(spark):
    """Its contexts are far below any share of the corpus."""
    rng = random.Random(5)
    filler = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(i, " ".join(rng.choices(filler, k=700))) for i in range(600)]
    passage = " ".join(rng.choices(filler, k=50))
    learnt = next(i for i in range(1000, 2000) if not is_held(i))
    held = next(i for i in range(2000, 3000) if is_held(i))
    other = next(i for i in range(3000, 4000) if is_held(i))
    again = passage.split()
    rng.shuffle(again)
    rows += [(learnt, passage), (held, passage), (other, " ".join(again))]
    found = st.scored(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    score = {r.doc_id: r.score for r in found.where(f"doc_id IN ({learnt}, {held}, {other})").collect()}
    assert score[held] == pytest.approx(score[learnt], abs=1e-9)
    assert score[held] > score[other] + 20


@pytest.mark.parametrize("numbers", [[], [0], [0, 0, 0], [255, 256, 1], list(range(70_000)), [2**24, 5]])
def test_numbers_come_back(numbers):
    numbers = np.array(numbers, np.int64)
    assert st.unsqueezed(st.squeezed(numbers), len(numbers)).tolist() == numbers.tolist()
