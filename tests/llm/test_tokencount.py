import random

import public_tokenizers
import pytest
import sentencepiece

from tablecheck.llm import tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("chunk", [1, 3, 7, 65_536])
def test_counts_are_the_library_s_for_any_chunks(library, chunk):
    counter = tokencount.Counter(tokencount.bpe_ranks(MODEL), chunk=chunk)
    rng = random.Random(chunk)
    for _ in range(800):
        text = "".join(rng.choices("abcthe  \n\t▁é<s>0x.\U0001f600\x00", k=rng.randint(0, 40)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_a_full_table_of_states_changes_nothing(library, docs):
    counter = tokencount.Counter(tokencount.bpe_ranks(MODEL))
    counter.transducer.max_states, counter.words.max_words = 50, 20
    for row in docs.limit(20).collect():
        assert counter.count(row.text) == len(library.encode(row.text))


def test_maps_compose_in_any_grouping(library):
    counter = tokencount.Counter(tokencount.bpe_ranks(MODEL))
    parts = [counter.map_of(x) for x in ("  the", " an", "d  ", "  of", "", " a\nb ", "x")]
    left = counter.scanned(parts)[-1]
    assert left == counter.total(parts)
    assert left == counter.joined(counter.total(parts[:3]), counter.total(parts[3:]))


def test_whole_table(spark, docs, library):
    rows = tokencount.token_counts(docs, MODEL, 500).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))
        assert r.n_bytes == len(texts[r.doc_id].encode())
        assert r.over_limit == (r.n_tokens > 500)


def test_odd_rows(odd, none, library):
    rows = tokencount.token_counts(odd, MODEL).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 4, 5, 7, 8, 9]
    expected = {(r.doc_id, len(library.encode(r.text or ""))) for r in odd.collect()}
    assert {(r.doc_id, r.n_tokens) for r in rows} == expected
    assert tokencount.token_counts(none, MODEL).collect() == []
