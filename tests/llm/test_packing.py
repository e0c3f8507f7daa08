import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecheck.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing as it is defined; the number of bins."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(bins) if room >= length]
        if fitting:
            best = min(fitting, key=lambda i: bins[i])
            bins[best] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_bulk_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 16, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    runs = packing.best_fit_decreasing(Counter(lengths), capacity)
    filled = defaultdict(list)
    placed = Counter()
    for run in runs:
        placed[run.length] += run.bins * run.each
        for b in range(run.bins):
            for k in range(run.each):
                filled[run.sequence + b].append((run.offset + k * run.length, run.length))
    assert placed == Counter(lengths)
    rooms = []
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        rooms.append(capacity - end)
    assert sorted(rooms) == one_by_one(lengths, capacity)


def check(packed, texts, capacity, library):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        parts = sorted(pieces.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids)
        assert all(r.length == capacity for r in parts[1:])
        for r in parts:
            part = ids[r.start : r.start + r.length]
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert not pieces


def test_whole_table(spark, docs):
    library = Tokenizer.from_file(PATH)
    packed = packing.pack(spark, docs, PATH, 512).collect()
    check(packed, {r.doc_id: r.text for r in docs.collect()}, 512, library)
    lengths = [r.length for r in packed]
    assert len({r.sequence_id for r in packed}) == len(one_by_one(lengths, 512))


def test_odd_rows(spark, odd, none):
    library = Tokenizer.from_file(PATH)
    single = odd.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    packed = packing.pack(spark, single, PATH, 2048)
    texts = {r.doc_id: r.text or "" for r in single.collect()}
    check(packed.collect(), texts, 2048, library)
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(single, packed, PATH).collect()}
    for r in packed.collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        part = ids[r.start : r.start + r.length]
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == part
    both = packing.pack(spark, odd, PATH, 2048).collect()
    assert sum(r.doc_id == 4 for r in both) == 2 and sum(r.doc_id is None for r in both) == 1
    assert packing.pack(spark, none, PATH).collect() == []


def test_special_strings_and_long_gaps():
    library = Tokenizer.from_file(PATH)
    for text in ("a<|endoftext|> b", "x" * 5000, " " * 5000 + "x", "\n" * 3000, "a\x00퟿"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert packing.token_ids(PATH, text).tolist() == [*ids, 0]


def test_a_frequent_length_is_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rows = spark.range(300).selectExpr("id AS doc_id", "'same text' AS text")
    packed = packing.pack(spark, rows, PATH, 10).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == 300
    assert len({r.sequence_id for r in packed}) == 100
