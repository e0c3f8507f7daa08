"""Packs documents into token sequences by best-fit decreasing.

Best-fit decreasing only looks at lengths, and there are at most `capacity` different
ones. So the driver packs a histogram: all pieces of one length meet the same open bins,
are placed many at a time, and the plan has a few runs for each length, whatever the
number of documents. Executors number the pieces of each length and look up their run.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import kept, texts

#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
END_ID = 0
GROUP_ROWS = 1000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class SegmentTree:
    """Numbers of open bins by remaining capacity; finds the tightest that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity).bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        node = remaining + self.leaves
        while node:
            self.sums[node] += bins
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity >= length of an open bin."""
        node = length + self.leaves
        if self.sums[node]:
            return length
        while node > 1:
            if not node & 1 and self.sums[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self.sums[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return None


class Run(NamedTuple):
    """Pieces of `length` numbered from `first` on fill `bins` sequences from `sequence`
    on, `each` of them into every one, the first at `offset`."""

    length: int
    first: int
    bins: int
    each: int
    sequence: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place `counts[length]` pieces of every length.

    The same as piece by piece: the tightest bin that takes a piece is, once chosen, the
    tightest for the next of that length as well, until it can't take another.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # first, how many
    tree = SegmentTree(capacity)
    runs: list[Run] = []
    sequences = 0

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            open_bins[remaining].append((first, bins))
            tree.add(remaining, bins)

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, sequences, -(-left // (capacity // length))
                sequences += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            each = room // length
            full = min(bins, left // each)
            if full:
                runs.append(Run(length, number, full, each, first, capacity - room))
                put(room - each * length, first, full)
                number, left = number + full * each, left - full * each
            if left and full < bins:  # fewer than `each` are left: they share one bin
                runs.append(Run(length, number, 1, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, bins - full)
    return runs


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level BPE of a tokenizers file, run by a library with the same merges."""
    if path not in _TOKENIZERS:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        ranks = {
            bytes(byte[c] for c in token): number
            for token, number in described["model"]["vocab"].items()
            if token not in special
        }
        _TOKENIZERS[path] = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _TOKENIZERS[path]


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text and the id that ends it, as unsigned 32-bit numbers."""
    ids = tokenizer(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(path, text)
                rows += [
                    (doc_id, number, start, length,
                     zlib.crc32(ids[start : start + length].tobytes()))
                    for number, (start, length) in enumerate(cuts(len(ids), capacity))
                ]
            out = pd.DataFrame(rows, columns=PIECES.names)
            yield out.astype({"doc_id": "Int64"})

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(
        cut, PIECES
    )


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    A NULL or empty text is its end id alone. Repeated rows are packed as often as they
    occur; which of several pieces of one length goes where is settled by doc_id and
    piece, and has no effect on the number of sequences. A NULL doc_id stays NULL. Other
    columns are not read. An empty table gives an empty result.
    """
    parts = kept(spark, pieces(docs, path, capacity), "pieces")
    by_length = {
        r["length"]: r["count"] for r in parts.groupBy("length").count().collect()
    }  # at most `capacity` rows
    runs = spark.createDataFrame(
        best_fit_decreasing(by_length, capacity),
        "length long, first long, bins long, each long, sequence long, at long",
    ).coalesce(1)
    shares = spark.createDataFrame(
        [(k, math.ceil(n / GROUP_ROWS)) for k, n in by_length.items()],
        "length long, shares long",
    ).coalesce(1)

    # Pieces of a frequent length are numbered in groups, each after those before it.
    dealt = parts.join(F.broadcast(shares), "length").withColumn(
        "share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))
    )
    before = Window.partitionBy("length").orderBy("share")
    bases = (
        dealt.groupBy("length", "share")
        .agg(F.count("*").alias("rows"))
        .select("length", "share",
                (F.sum("rows").over(before) - F.col("rows")).alias("base"))
    )
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        dealt.withColumn("within", F.row_number().over(within) - 1)
        .join(bases, ["length", "share"])
        .withColumn("number", F.col("base") + F.col("within"))
    )
    r, run = F.col("number") - F.col("first"), F.broadcast(runs.withColumnRenamed("length", "run_length"))
    return numbered.join(
        run,
        (F.col("length") == F.col("run_length"))
        & (r >= 0)
        & (r < F.col("bins") * F.col("each")),
    ).select(
        *PIECES.names,
        (F.col("sequence") + F.floor(r / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + r % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str) -> DataFrame:
    """sequence_id and ids: the packed token sequences themselves.

    `docs` must have one row for each doc_id. A sequence holds `capacity` ids at most.
    """

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [
                [token_ids(path, text)[a : a + n] for a, n in zip(starts, lengths)]
                for text, starts, lengths in zip(batch["text"], batch["starts"], batch["lengths"])
            ]
            yield pd.DataFrame(
                {"sequence_id": batch["sequence_ids"], "offset": batch["offsets"], "ids": ids}
            ).explode(["sequence_id", "offset", "ids"])

    places = packed.groupBy("doc_id").agg(
        *(F.collect_list(c).alias(f"{c}s") for c in ("start", "length", "sequence_id", "offset"))
    )
    return (
        texts(docs)
        .join(places, "doc_id")
        .mapInPandas(taken, "sequence_id long, offset long, ids array<long>")
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]
        )).alias("ids"))
    )
