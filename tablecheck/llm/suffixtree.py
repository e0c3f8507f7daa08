"""Scores texts with a probabilistic suffix tree: contexts of variable length, learnt from
the corpus, predict the next symbol.

Symbols are the frequent words, classes of the other words by their last characters, and
the end of a text. Every context, a sequence of up to `DEPTH` symbols, of the training
texts is a candidate, with all its next symbols; it is kept if these diverge from
those of its longest kept suffix by more than their number would explain. A text is
scored symbol by symbol from the state that is the longest kept suffix of what came
before. A state's counts are discounted and smoothed with the distribution of the next
shorter state; below the root every symbol has been seen once more than it has. A word
of a class is then chosen within it by its own count, so every word's count in the whole
corpus tells, and an unknown word has a share too.

The corpus is coded once, in chunks of about `CHUNK_BYTES` with a dictionary each. Counts
of words come from one shuffle of the dictionaries and come to each chunk by a join.
Contexts with a share of `FREQUENT` make the tree that is sent to the tasks: at most
1 / FREQUENT a level, each with at most one transition a symbol; their counts come from one
shuffle a level. The others are too many to be sent. Places with such contexts are shuffled
by the shortest of them, which brings all places of the longer ones along: a bucket has all
that these contexts need, and returns by how much they change each document's score. What is
frequent decides where contexts are counted, not what a text scores.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import kept, texts

#: Fixed values of the model.
DEPTH = 3
SHARE = 5e-5
CLASSES = 1024
DISCOUNT = 0.5
MASS = 5.0

#: Contexts with this share of all documents are counted in the tree, others in buckets, of which
#: none has more than this share besides its `BUCKET_PLACES` or so.
FREQUENT = 1e-3
BUCKET_PLACES = 1_250_000
#: Up to so many chances of the tree are kept as a table as well.
TABLE_CELLS = 4_000_000
#: A symbol's bits in a packed context; 1 / SHARE + CLASSES + 2 symbols at most.
BITS = 15
SYMBOL = (1 << BITS) - 1
START, END = 0, 1
FIRST_CLASS = 2
FIRST_WORD = FIRST_CLASS + CLASSES
CHUNK_BYTES = 6_000_000
#: Different packed contexts that a task adds up before it sends them.
HELD_GRAMS = 1_000_000

LOWER = bytes(range(256)).lower()

CHUNK = (
    "chunk long, doc_ids array<long>, held array<boolean>, starts array<int>,"
    " sequence binary, words array<string>, counts array<int>, tokens long, trained long"
)
GRAMS = "gram long, n long, seen long"
BLOCKS = "bucket long, chunk long, size int, symbols binary, places binary"
BLOCK_PARTS = "chunk long, places binary, parts array<double>"
PARTS = "chunk long, place int, part double"
SCORES = (
    "chunk long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers first by their low bytes, then by the next, and so on, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return zlib.compress(planes[:used].tobytes(), 1)


def unsqueezed(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, count) if count else []
    out = np.zeros(count, np.int64)
    for place, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * place)
    return out


def coded(docs: DataFrame) -> DataFrame:
    """The documents in chunks: each document's words as numbers in the chunk's own
    dictionary, frequent words first, which has every word's number of occurrences in
    training documents."""

    def of_chunk(number: int, ids: list, held: list, raws: list[bytes]) -> pa.RecordBatch:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        number_of = known.__getitem__
        sequences = [
            np.fromiter(map(number_of, raw.translate(LOWER).split()), np.int32) for raw in raws
        ]
        starts = np.append(0, np.cumsum([len(s) for s in sequences]))
        train = [s for s, h in zip(sequences, held, strict=True) if not h]
        counts = np.bincount(np.concatenate([np.empty(0, np.int32), *train]), minlength=len(known))
        sequence = np.concatenate(sequences)
        order = np.argsort(-np.bincount(sequence, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        words = list(known)
        row = {
            "doc_ids": pa.array(ids, pa.int64()),
            "held": pa.array(held, pa.bool_()),
            "starts": pa.array(starts, pa.int32()),
            "sequence": squeezed(rank[sequence]),
            "words": pa.array([words[i] for i in order.tolist()], pa.binary()).cast(pa.string()),
            "counts": pa.array(counts[order], pa.int32()),
        }
        lists = [
            pa.array([a], pa.binary())
            if isinstance(a, bytes)
            else pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            for a in row.values()
        ]
        totals = (int(counts.sum()) + len(train), len(train))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *lists, *(pa.array([t], pa.int64()) for t in totals)],
            names=["chunk", *row, "tokens", "trained"],
        )

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list = []
        raws: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, own, text in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield of_chunk(number, ids, held, raws)
                    number, ids, held, raws, size = number + 1, [], [], [], 0
                ids.append(doc_id.as_py())
                held.append(own.as_py())
                raws.append(raw)
                size += len(raw) + 64
        if ids:
            yield of_chunk(number, ids, held, raws)

    return docs.mapInArrow(of_batches, CHUNK)


def counted_words(chunks: DataFrame, frequent: int) -> DataFrame:
    """For each word of each chunk: its number there (`at`), its count in all training
    documents (c), its class, whether this row stands for the word (`first`), and the
    word itself if its count is at least `frequent`."""
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    by_word = Window.partitionBy("word")
    return (
        words.select("chunk", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        .withColumn("c", F.sum("n").over(by_word))
        .withColumn("first", F.row_number().over(by_word.orderBy("chunk")) == 1)
        .select(
            "chunk",
            "at",
            "c",
            F.pmod(F.crc32(F.expr("right(word, 3)")), F.lit(CLASSES)).cast("int").alias("class"),
            "first",
            F.when(F.col("c") >= frequent, F.col("word")).alias("word"),
        )
    )


def with_dictionaries(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The chunks with each word's count and symbol instead of the word."""
    own = known.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", "c", "symbol"))).alias("known")
    )
    return chunks.drop("words", "counts").join(own, "chunk", "left").select(
        "chunk", "doc_ids", "held", "starts", "sequence",
        F.col("known.c").alias("c"), F.col("known.symbol").alias("symbol"),
    )


class Chunk:
    """A coded chunk: its symbols with a START before and an END after each document."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        def values(name: str) -> np.ndarray:
            column = batch[name][k]
            return column.values.to_numpy(zero_copy_only=False) if column.is_valid else np.empty(0, np.int64)

        self.number = batch["chunk"][k].as_py()
        self.doc_ids = batch["doc_ids"][k].values
        self.held = values("held").astype(bool)
        self.counts = values("c").astype(np.int64)
        self.symbols = values("symbol").astype(np.int64)
        starts = values("starts").astype(np.int64)
        self.words = unsqueezed(batch["sequence"][k].as_py(), int(starts[-1]))
        docs = len(self.held)
        self.sizes = np.diff(starts)
        #: where each document's START is, and the places of its words
        self.begin = starts[:-1] + 2 * np.arange(docs)
        self.places = np.arange(len(self.words)) + np.repeat(2 * np.arange(docs) + 1, self.sizes)
        self.x = np.empty(len(self.words) + 2 * docs, np.int64)
        self.x[self.places] = self.symbols[self.words]
        self.x[self.begin] = START
        self.x[self.begin + self.sizes + 1] = END
        self.offset = np.arange(len(self.x)) - np.repeat(self.begin, self.sizes + 2)
        self.trained = np.repeat(~self.held, self.sizes + 2)

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with so many symbols before them, START included, and those packed."""
        at = np.flatnonzero(self.offset >= max(depth, 1))
        packed = np.zeros(len(at), np.int64)
        for back in range(depth, 0, -1):
            packed = (packed << BITS) | self.x[at - back]
        return at, packed

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All places but the STARTs, and each with the `DEPTH` symbols before it, packed;
        before a START are more of them."""
        packed = self.x.copy()
        for back in range(1, DEPTH + 1):
            packed[back:] |= np.where(self.offset[back:] >= back, self.x[:-back], START) << (BITS * back)
        at = np.flatnonzero(self.offset > 0)
        return at, packed[at]


def read_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Chunk(batch, k)


def among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the keys is in the sorted `wanted`, and whether it is there."""
    if not len(wanted):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if wanted[-1] <= SYMBOL and keys.max(initial=0) <= SYMBOL:
        table = np.full(SYMBOL + 1, -1)
        table[wanted] = np.arange(len(wanted))
        at = table[keys]
        return at, at >= 0
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return at, wanted[at] == keys


def level_counts(chunks: DataFrame, depth: int, contexts) -> DataFrame:
    """gram, n, seen: how often each given context of `depth` symbols is followed by each
    symbol in training documents, and in all; both packed. `contexts` is a broadcast sorted
    array."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
            keys, inverse = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inverse, counts, minlength=len(keys)).astype(np.int64)

        def sent(found: list) -> pa.RecordBatch:
            keys, counts = counted(*(np.concatenate(each) for each in zip(*found, strict=True)))
            first = np.flatnonzero(np.diff(keys >> 1, prepend=-1) != 0)
            sums = [np.add.reduceat(each, first) for each in (counts * (keys & 1), counts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[first] >> 1), *map(pa.array, sums)], names=["gram", "n", "seen"]
            )

        found: list = []
        for chunk in read_chunks(batches):
            at, packed = chunk.contexts(depth)
            if depth:
                given = among(packed, contexts.value)[1]
                at, packed = at[given], packed[given]
            keys = (((packed << BITS) | chunk.x[at]) << 1) | chunk.trained[at]
            found.append(np.unique(keys, return_counts=True))
            if sum(len(keys) for keys, _ in found) > HELD_GRAMS:
                yield sent(found)
                found = []
        if any(len(keys) for keys, _ in found):
            yield sent(found)

    found = chunks.mapInArrow(of_batches, GRAMS)
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def lengths(packed: np.ndarray) -> np.ndarray:
    """How long contexts of `DEPTH` symbols, padded by STARTs, are without the padding."""
    out = np.full(len(packed), DEPTH, np.int8)
    for depth in range(DEPTH - 1, 0, -1):
        out[(packed >> (BITS * (depth - 1))) & SYMBOL == START] = depth
    return out


def joined(grams: np.ndarray, bits: int) -> np.ndarray:
    """Grams with `bits` bits a symbol, as rows of so many bytes as needed."""
    out = np.zeros(len(grams), "<i8")
    for back in range(DEPTH, -1, -1):
        out = (out << bits) | ((grams >> (BITS * back)) & SYMBOL)
    return out.view(np.uint8).reshape(-1, 8)[:, : -(-bits * (DEPTH + 1) // 8)]


def unjoined(data: bytes, count: int, bits: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(count, -1)
    packed = np.zeros((count, 8), np.uint8)
    packed[:, : rows.shape[1]] = rows
    packed = packed.view("<i8").ravel()
    out = np.zeros(count, np.int64)
    for back in range(DEPTH, -1, -1):
        out = (out << BITS) | ((packed >> (bits * back)) & ((1 << bits) - 1))
    return out


def compared(of: np.ndarray, n: np.ndarray, before: np.ndarray, size: int) -> tuple:
    """For transitions seen `n` times, of the contexts numbered `of`, whose parents give
    them the chances `before`: their chances; and for each of the `size` contexts the share
    that its parent gets, and whether the context is kept."""
    totals = np.bincount(of, n, minlength=size)
    own = np.where(n > 0, n - DISCOUNT, 0) / (totals[of] + MASS)
    passed = 1 - np.bincount(of, own, minlength=size)
    chances = own + passed[of] * before
    gain = np.bincount(of, n * np.log(chances / before), minlength=size)
    successors = np.bincount(of, n > 0, minlength=size)
    return chances, passed, gain > 0.5 * successors * np.log(np.maximum(totals, 2))


class Level(NamedTuple):
    """The kept contexts of one length, sorted; of each the number of its parent, the
    share its parent gets, and its transitions as sorted `node << BITS | symbol`."""

    contexts: np.ndarray
    first: int
    grams: np.ndarray
    chances: np.ndarray


class Tree:
    """The frequent contexts. Node 0 is the root; `levels[d - 1]` has the nodes whose
    context has d symbols, `frequent[d - 1]` all frequent contexts of d symbols, sorted,
    with the node of the longest kept suffix of each."""

    def __init__(self, symbols: np.ndarray, places: int):
        self.table: np.ndarray | None = None
        self.places = places  # of training documents and others
        self.bits = (len(symbols) - 1).bit_length()
        self.root = (symbols + 1) / (symbols.sum() + len(symbols) - 1)
        self.root[START] = 0  # nothing goes back to the start
        self.levels: list[Level] = []
        self.frequent: list[tuple[np.ndarray, np.ndarray]] = []
        self.parents = np.zeros(1, np.int64)
        self.passed = np.ones(1)

    def chance(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The chance of each symbol in each state."""
        if self.table is not None:
            return self.table[nodes * len(self.root) + symbols]
        out = np.ones(len(nodes))
        rest = np.arange(len(nodes))
        for level in reversed(self.levels):
            own = nodes[rest] >= level.first
            deep = rest[own]
            at, stored = among((nodes[deep] << BITS) | symbols[deep], level.grams)
            out[deep[stored]] *= level.chances[at[stored]]
            missed = deep[~stored]
            out[missed] *= self.passed[nodes[missed]]
            nodes = nodes.copy()
            nodes[missed] = self.parents[nodes[missed]]
            rest = np.concatenate([rest[~own], missed])
        out[rest] *= self.root[symbols[rest]]
        return out

    def finish(self) -> None:
        """Looks all chances up at once, if these are few enough."""
        nodes, symbols = len(self.parents), len(self.root)
        if nodes * symbols <= TABLE_CELLS:
            self.table = self.chance(np.repeat(np.arange(nodes), symbols), np.tile(np.arange(symbols), nodes))

    def states(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts of `DEPTH` symbols, padded by STARTs: how long their longest
        frequent suffix is, and the node of their longest kept one."""
        lengths, nodes = np.zeros(len(packed), np.int8), np.zeros(len(packed), np.int64)
        rest = np.arange(len(packed))
        for depth, (contexts, own) in enumerate(self.frequent, 1):  # suffixes of frequent ones are frequent
            where, found = among(packed[rest] & ((1 << (BITS * depth)) - 1), contexts)
            rest = rest[found]
            lengths[rest], nodes[rest] = depth, own[where[found]]
        return lengths, nodes

    def suffixes(self, packed: np.ndarray) -> np.ndarray:
        """The node of the longest kept proper suffix of contexts one longer than the
        deepest level."""
        nodes = np.zeros(len(packed), np.int64)
        for depth, level in enumerate(self.levels, 1):
            where, found = among(packed & ((1 << (BITS * depth)) - 1), level.contexts)
            nodes[found] = level.first + where[found]
        return nodes

    def grow(self, contexts: np.ndarray, grams: np.ndarray, n: np.ndarray) -> None:
        """Adds the level of the frequent contexts (sorted) that diverge from their
        parents. `grams` (sorted) are all their transitions."""
        of = np.searchsorted(contexts, grams >> BITS)
        symbols = grams & SYMBOL
        parents = self.suffixes(contexts)
        before = self.chance(parents[of], symbols)
        chances, passed, kept_ones = compared(of, n, before, len(contexts))
        first = len(self.parents)
        numbers = first + np.cumsum(kept_ones) - 1
        own = kept_ones[of]
        self.levels.append(
            Level(contexts[kept_ones], first, (numbers[of[own]] << BITS) | symbols[own], chances[own])
        )
        self.frequent.append((contexts, np.where(kept_ones, numbers, parents)))
        self.parents = np.concatenate([self.parents, parents[kept_ones]])
        self.passed = np.concatenate([self.passed, passed[kept_ones]])

    def change(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The chance of the last symbol of each gram (sorted, seen `n` times) as a multiple
        of its chance in the tree, if contexts that are not frequent tell too. All grams with
        the same such context have to be given."""
        frequent, nodes = self.states(grams >> BITS)
        whole = lengths(grams >> BITS)
        before = self.chance(nodes, grams & SYMBOL)
        chances = before.copy()
        for depth in range(1, DEPTH + 1):
            own = np.flatnonzero((frequent < depth) & (depth <= whole))
            keys, at = grams[own], np.arange(len(own))
            if depth < DEPTH:
                keys, at = np.unique(keys & ((1 << (BITS * (depth + 1))) - 1), return_inverse=True)
            shorter = np.empty(len(keys))
            shorter[at] = chances[own]
            of = np.cumsum(np.diff(keys >> BITS, prepend=-1) != 0) - 1
            size = int(of[-1]) + 1 if len(of) else 0
            longer, _, kept_ones = compared(of, np.bincount(at, n[own], minlength=len(keys)), shorter, size)
            chances[own] = np.where(kept_ones[of], longer, shorter)[at]
        return chances / before


def learnt(spark: SparkSession, chunks: DataFrame, symbols: int) -> Tree:
    """Grows the tree of the frequent contexts level by level; those of a level extend those
    of the one before. The other contexts are for `parts`."""
    counts, seen = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    single = level_counts(chunks, 0, None).toArrow()
    counts[single["gram"].to_numpy()] = single["n"].to_numpy()
    seen[single["gram"].to_numpy()] = single["seen"].to_numpy()
    least = max(1, math.ceil(FREQUENT * seen.sum()))
    tree = Tree(counts, int(seen.sum()))
    seen[START], seen[END] = seen[END], 0
    contexts = np.flatnonzero(seen >= least)
    for depth in range(1, DEPTH + 1):
        if not len(contexts):
            break
        sent = spark.sparkContext.broadcast(contexts)
        table = level_counts(chunks, depth, sent).toArrow()  # one row at most for each context and symbol
        order = np.argsort(table["gram"].to_numpy())
        grams, n, seen = (table[name].to_numpy()[order] for name in ("gram", "n", "seen"))
        tree.grow(contexts, grams, n)
        contexts = grams[(seen >= least) & (grams & SYMBOL != END)]
    tree.finish()
    return tree


def blocks(chunks: DataFrame, model, buckets: int) -> DataFrame:
    """For each chunk and bucket the places that have contexts which are not frequent and
    the shortest of these in the bucket: the symbols up to there, and the document's number
    in the chunk, twice, plus one if held out."""

    def of_chunk(chunk: Chunk, tree: Tree) -> pa.RecordBatch:
        at, grams = chunk.grams()
        frequent, _ = tree.states(grams >> BITS)
        rare = frequent < lengths(grams >> BITS)
        at, grams = at[rare], grams[rare]
        shortest = (grams >> BITS) & ((1 << (BITS * (frequent[rare].astype(np.int64) + 1))) - 1)
        mixed = (shortest + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        symbols = joined(grams[order], tree.bits)
        doc = np.repeat(2 * np.arange(len(chunk.held)) + chunk.held, chunk.sizes + 2)[at[order]]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
        rows = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], pa.int64()),
                pa.array([chunk.number] * len(rows), pa.int64()),
                pa.array([b - a for _, a, b in rows], pa.int32()),
                pa.array([symbols[a:b].tobytes() for _, a, b in rows], pa.binary()),
                pa.array([squeezed(np.diff(doc[a:b], prepend=0)) for _, a, b in rows], pa.binary()),
            ],
            names=["bucket", "chunk", "size", "symbols", "places"],
        )

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in read_chunks(batches):
            yield of_chunk(chunk, model.value.tree)

    return chunks.mapInArrow(of_batches, BLOCKS)


def parts(chunks: DataFrame, model, buckets: int) -> DataFrame:
    """chunk, place, part: what the contexts that are not frequent add to the score of the
    document with that number in the chunk."""

    def of_bucket(table: pa.Table) -> pa.Table:
        tree = model.value.tree
        sizes = table["size"].to_numpy()
        grams, places = np.empty(sizes.sum(), np.int64), np.empty(sizes.sum(), np.int64)
        end = 0
        for size, symbols, docs in zip(sizes.tolist(), table["symbols"], table["places"], strict=True):
            own = slice(end, end := end + size)
            grams[own] = unjoined(symbols.as_buffer(), size, tree.bits)
            places[own] = np.cumsum(unsqueezed(docs.as_buffer(), size))
        different, at = np.unique(grams, return_inverse=True)
        n = np.bincount(at, places & 1 == 0)
        logs = np.log10(tree.change(different, n))[at]
        starts = np.append(0, np.cumsum(sizes))
        new = np.diff(places, prepend=-1) != 0
        new[starts[:-1]] = True
        first = np.flatnonzero(new)
        offsets = np.searchsorted(first, starts)
        numbers, sums = places[first] >> 1, pa.array(np.add.reduceat(logs, first))
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return pa.table(
            {
                "chunk": table["chunk"],
                "places": pa.array([squeezed(np.diff(numbers[a:b], prepend=0)) for a, b in spans], pa.binary()),
                "parts": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), sums),
            }
        )

    def of_chunk(table: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(table["parts"]).to_pylist()
        places = [
            np.cumsum(unsqueezed(diffs.as_buffer(), size))
            for diffs, size in zip(table["places"], sizes, strict=True)
        ]
        part = np.bincount(np.concatenate(places), pc.list_flatten(table["parts"]).to_numpy())
        return pa.table(
            {
                "chunk": pa.array(np.full(len(part), table["chunk"][0].as_py(), np.int64)),
                "place": pa.array(np.arange(len(part)), pa.int32()),
                "part": pa.array(part),
            }
        )

    in_blocks = blocks(chunks, model, buckets).groupBy("bucket").applyInArrow(of_bucket, BLOCK_PARTS)
    return in_blocks.groupBy("chunk").applyInArrow(of_chunk, PARTS)


class Model(NamedTuple):
    tree: Tree
    tokens: int
    types: int
    trained: int
    class_mass: np.ndarray


def scores(chunks: DataFrame, model) -> DataFrame:
    """A row for each document: its chunk, its number in it, and what `scored` returns with
    the frequent contexts alone. `model` is a broadcast `Model`."""

    def of_chunk(chunk: Chunk, m: Model) -> pa.RecordBatch:
        places, grams = chunk.grams()
        _, nodes = m.tree.states(grams >> BITS)
        logs = np.zeros(len(chunk.x))
        logs[places] = np.log10(m.tree.chance(nodes, grams & SYMBOL))
        # a word within its class
        classed = chunk.symbols < FIRST_WORD
        inside = np.zeros(len(chunk.symbols))
        mass = m.class_mass[chunk.symbols[classed] - FIRST_CLASS]
        inside[classed] = np.log10((chunk.counts[classed] + 1) / mass)
        logs[chunk.places] += inside[chunk.words]
        base, known = np.zeros(len(chunk.x)), np.zeros(len(chunk.x), np.int64)
        base[chunk.places] = np.log10(chunk.counts + 1)[chunk.words]
        known[chunk.places] = (chunk.counts > 0)[chunk.words]
        ends = chunk.begin + chunk.sizes + 1
        base[ends] = math.log10(m.trained + 1)
        known[ends] = m.trained > 0
        base[places] -= math.log10(m.tokens + m.types + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(chunk.held), chunk.number, np.int64)),
                pa.array(np.arange(len(chunk.held)), pa.int32()),
                chunk.doc_ids,
                pa.array(chunk.held),
                pa.array(chunk.sizes + 1),
                pa.array(np.add.reduceat(known, chunk.begin)),
                pa.array(np.full(len(chunk.held), m.tokens, np.int64)),
                pa.array(np.add.reduceat(base, chunk.begin)),
                pa.array(np.add.reduceat(logs, chunk.begin)),
            ],
            names=[
                "chunk", "place",
                "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
            ],
        )

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in read_chunks(batches):
            yield of_chunk(chunk, model.value)

    return chunks.mapInArrow(of_batches, SCORES)


def one_in_seven() -> Column:
    """The documents that are held out of training; one without doc_id is not."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    return F.coalesce(remainder == 2, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, held_out: Column) -> tuple[DataFrame, Model]:
    """The coded corpus and the model learnt from its documents that are not held out."""
    rows = texts(docs, held_out.alias("held")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "held"
    )
    chunks = kept(spark, coded(rows), "suffixtree-chunks")
    totals = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("trained").alias("trained")).first()
    tokens, trained = totals["tokens"] or 0, totals["trained"] or 0

    least = max(2, math.ceil(SHARE * tokens))
    words = kept(spark, counted_words(chunks, least), "suffixtree-words")
    # at most 1 / SHARE words have so large a share
    frequent = words.where("first AND word IS NOT NULL").select("word").toArrow()["word"].to_pylist()
    numbers = spark.createDataFrame(
        [(w, FIRST_WORD + k) for k, w in enumerate(sorted(frequent))], "word string, number int"
    )
    classes = (
        words.where("first AND c > 0")
        .groupBy("class")
        .agg(
            F.count("*").alias("types"),
            F.count_if(F.col("word").isNull()).alias("rare"),
            F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("c"),
        )
        .collect()
    )
    mass = np.ones(CLASSES)
    for row in classes:
        mass[row["class"]] += (row["c"] or 0) + row["rare"]
    types = sum(row["types"] for row in classes) + (trained > 0)

    known = words.join(F.broadcast(numbers), "word", "left").select(
        "chunk", "at", "c", F.coalesce("number", F.col("class") + FIRST_CLASS).alias("symbol")
    )
    ready = kept(spark, with_dictionaries(chunks, known), "suffixtree-coded")
    tree = learnt(spark, ready, FIRST_WORD + len(frequent))
    return ready, Model(tree, tokens, types, trained, mass)


def scored(spark: SparkSession, docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (single words, one added to each count) and
    score, the model's log10 probability of the document's words and its end.

    A text is its words, A-Z lower-cased, and an end, so a NULL, empty or blank one is
    just an end. Rows whose `held_out` (default `one_in_seven`; NULL is false) is
    true are not learnt from; without any to learn from, all symbols
    are equally likely. Repeated rows count each and get the same scores; a NULL doc_id
    stays; other columns are not read. A text is held by one task.
    """
    held_out = one_in_seven() if held_out is None else F.coalesce(held_out, F.lit(False))
    ready, model = fitted(spark, docs, held_out)
    sent = spark.sparkContext.broadcast(model)
    buckets = 1 + model.tree.places // BUCKET_PLACES
    rows = scores(ready, sent).join(parts(ready, sent, buckets), ["chunk", "place"], "left")
    score = F.col("score") + F.coalesce("part", F.lit(0.0))
    return rows.withColumn("score", score).drop("chunk", "place", "part")
