"""Ranked lexical search: the best documents for each query by an integer BM25.

Documents become sparse vectors of impacts, one for each query term they hold, and are
dealt out by a random-projection signature, so that similar ones meet in one segment of
bounded size. In a segment each posting list is cut into blocks of similar documents:
pivots are taken from the list and every document joins its nearest pivot. A block's
summary holds, for each term, the greatest impact of any of its documents.

A search needs no document that can't reach the k-th best score. A first pass scores the
documents of each query's rarest lists, whose k-th best score is a floor. Then a query's
most frequent terms, which together stay below the floor, need no visit: what can reach
the floor is in one of the other lists. Of those a block is skipped only if the sum of
its summary over the query's terms stays below the floor; that sum is no estimate but at
least each document's score, so results are exact. What is left is scored exactly.

Queries are taken in blocks whose terms fit into memory; all documents are indexed for
each block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import ascii_lower, kept, texts, words_of

#: Fixed value: a term is what holds no ASCII sign other than letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of a query block, in terms of 16 bytes; queries beyond it come in further blocks.
BLOCK_TERMS = 200_000
#: Postings of a segment, which a task holds in memory.
SEGMENT_POSTINGS = 400_000
#: Documents of a block; a block with fewer than `SMALL` is scored rather than summarised.
BLOCK, SMALL = 32, 6
#: The first pass scores lists, rarest first, until they hold so many documents.
SEED_DOCS = 2_000
CHUNK_BYTES = 2_000_000
SIGNATURE_BITS = 16
SHARES = 64

#: Bytes of a term stay, letters lower-cased; others become spaces.
FOLDED = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()
)

FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>, signature int, salt int"
SEGMENT = (
    "doc_ids array<long>, starts array<int>, terms array<int>, impacts array<int>,"
    " top_terms array<int>, top_impacts array<int>"
)
BLOCKS = (
    ", block_terms array<int>, block_starts array<int>, block_docs array<int>,"
    " sum_starts array<int>, sum_terms array<int>, sum_values array<int>"
)
HITS = "query int, doc_id long, score long"


class Queries(NamedTuple):
    """A block of queries as the tasks need it; query k is item `item_ids[k]`."""

    item_ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


@cache
def directions(size: int, width: int) -> np.ndarray:
    """A random sign vector for each term."""
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (max(size, 1), width))


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term and how often the item has it; rows of one item_id are one item."""
    words = words_of(ascii_lower(F.coalesce("text", F.lit(""))), TERM)
    return (
        queries.select("item_id", F.explode(words).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("times"))
    )


def read_queries(terms: DataFrame, block: int, blocks: int) -> Queries:
    own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
    table = own.toArrow()
    words = [w.encode() for w in table["term"].to_pylist()]
    vocabulary = {w: i for i, w in enumerate(sorted(set(words)))}
    by_item: dict = {}
    for item, word, times in zip(
        table["item_id"].to_pylist(), words, table["times"].to_pylist(), strict=True
    ):
        by_item.setdefault(item, []).append((vocabulary[word], times))
    return Queries(
        list(by_item),
        vocabulary,
        [np.array([t for t, _ in x], np.int64) for x in by_item.values()],
        [np.array([c for _, c in x], np.int64) for x in by_item.values()],
    )


def forward(docs: DataFrame, queries) -> DataFrame:
    """The vector of each document with at least one term: n counts all its terms, `terms`
    are those of the queries. `queries` is a broadcast `Queries`."""

    def of_chunk(ids: list, raws: list[bytes]) -> pa.RecordBatch:
        vocabulary = queries.value.vocabulary
        size = len(vocabulary)
        n, known = [], []
        for raw in raws:
            words = raw.translate(FOLDED).split()
            n.append(len(words))
            known.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)))
        at = np.repeat(np.arange(len(raws)), [len(k) for k in known])
        flat = np.concatenate(known)
        keys, tfs = np.unique((at * size + flat)[flat >= 0], return_counts=True)
        terms = keys % max(size, 1)
        starts = np.searchsorted(keys, np.arange(len(raws) + 1) * size)
        signs = directions(size, SIGNATURE_BITS)
        sums = row_sums(signs[terms] * np.sqrt(tfs)[:, None], starts)
        bits = (sums > 0) @ (1 << np.arange(SIGNATURE_BITS))
        salt = [zlib.crc32(str(i).encode()) >> 1 for i in ids]  # parts equal signatures
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tfs, pa.int32())),
                pa.array(bits, pa.int32()),
                pa.array(salt, pa.int32()),
            ],
            names=["doc_id", "n", "terms", "tfs", "signature", "salt"],
        )
        return batch.filter(pa.array(np.array(n) > 0))

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            raws: list[bytes] = []
            size = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield of_chunk(ids, raws)
                    ids, raws, size = [], [], 0
                ids.append(doc_id.as_py())
                raws.append(raw)
                size += len(raw)
            if ids:
                yield of_chunk(ids, raws)

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of_batches, FORWARD)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches between `starts`, 0 for empty ones."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *parts])


def stretch(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all the half-open ranges, one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def impacts(tfs: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one occurrence of a term of weight 1 in a query adds, rounded down."""
    m = 100 - 25 + (25 * n * documents) // length
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)


def segments(vectors: DataFrame, documents: int, length: int, postings: int) -> DataFrame:
    """The documents in segments of similar ones, each a row of flat arrays."""

    def of_rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        terms = lists.flatten().to_numpy()
        starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        n = np.repeat(table["n"].to_numpy(), np.diff(starts))
        made = impacts(tfs.flatten().to_numpy().astype(np.int64), n, documents, length)
        top_terms, inverse = np.unique(terms, return_inverse=True)
        top = np.zeros(len(top_terms), np.int64)
        np.maximum.at(top, inverse, made)
        columns = {
            "doc_ids": pa.array(table["doc_id"].to_pylist(), pa.int64()),
            "starts": pa.array(starts, pa.int32()),
            "terms": pa.array(terms, pa.int32()),
            "impacts": pa.array(made, pa.int32()),
            "top_terms": pa.array(top_terms, pa.int32()),
            "top_impacts": pa.array(top, pa.int32()),
        }
        return one_row(columns)

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = batch["terms"].value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                room = np.cumsum(sizes[at:]) + size
                end = at + max(1, int(np.searchsorted(room, SEGMENT_POSTINGS, "right")))
                parts.append(batch.slice(at, end - at))
                size += int(sizes[at:end].sum())
                if end < batch.num_rows or size >= SEGMENT_POSTINGS:
                    yield of_rows(parts)
                    parts, size = [], 0
                at = end
        if parts:
            yield of_rows(parts)

    pieces = max(1, math.ceil(postings / SEGMENT_POSTINGS))
    return (
        vectors.where(F.size("terms") > 0)
        .repartitionByRange(pieces, "signature", "salt")
        .sortWithinPartitions("signature", "salt")
        .mapInArrow(of_batches, SEGMENT)
    )


def one_row(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in columns.values()],
        names=list(columns),
    )


class Segment:
    """A segment read back: its documents' vectors and their posting lists."""

    def __init__(self, row: dict[str, pa.Array], size: int):
        self.row = row
        self.doc_ids = row["doc_ids"]
        self.starts, self.terms, self.impacts = (
            row[c].to_numpy().astype(np.int64) for c in ("starts", "terms", "impacts")
        )
        self.size = size

    def inverted(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents by term, and where each term's list begins."""
        of = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        cuts = np.searchsorted(self.terms[order], np.arange(self.size + 1))
        return of[order], cuts

    def scores(self, found: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Of the documents: the sum of impact times worth over their terms."""
        begin, end = self.starts[found], self.starts[found + 1]
        at = stretch(begin, end)
        parts = worth[self.terms[at]] * self.impacts[at]
        return row_sums(parts, np.append(0, np.cumsum(end - begin)))

    def sketches(self, weights: np.ndarray) -> np.ndarray:
        signs = directions(self.size, SIGNATURE_BITS)
        values = signs[self.terms] * (weights[self.terms] * self.impacts)[:, None]
        sums = row_sums(values, self.starts)
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def read_segments(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment({c: batch[c][k].values for c in batch.schema.names}, size)


def clustered(own: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in the order of its blocks, and where each block begins.

    Pivots are taken from the list at equal distances; each document joins the pivot whose
    sketch is nearest, and a pivot with more than `BLOCK` documents has several blocks.
    """
    if len(own) <= BLOCK:
        return own, np.array([0])
    pivots = own[:: BLOCK]
    nearest = np.empty(len(own), np.int64)
    for at in range(0, len(own), 4096):
        nearest[at : at + 4096] = (sketches[own[at : at + 4096]] @ sketches[pivots].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    nearest = nearest[order]
    new = np.append(True, np.diff(nearest) != 0)
    first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return own[order], np.flatnonzero((np.arange(len(own)) - first) % BLOCK == 0)


def summary(
    segment: Segment, docs: np.ndarray, starts: np.ndarray, asked: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of one list: how many terms each summary has, the terms and their
    greatest impacts. Only terms `asked` for together with the list are kept, and a small
    block has no summary."""
    sizes = np.diff(np.append(starts, len(docs)))
    block = np.repeat(np.arange(len(starts)), sizes)
    large = sizes[block] >= SMALL
    docs, block = docs[large], block[large]
    begin, end = segment.starts[docs], segment.starts[docs + 1]
    at = stretch(begin, end)
    kept_terms = asked[segment.terms[at]]
    at = at[kept_terms]
    keys = np.repeat(block, end - begin)[kept_terms] * segment.size + segment.terms[at]
    order = np.argsort(keys)
    keys, values = keys[order], segment.impacts[at[order]]
    first = np.flatnonzero(np.append(True, np.diff(keys) != 0)[: len(keys)])
    values = np.maximum.reduceat(values, first) if len(first) else values
    keys = keys[first]
    counts = np.bincount(keys // segment.size, minlength=len(starts))
    return counts, keys % segment.size, values


def blocked(rows: DataFrame, plan) -> DataFrame:
    """Adds to each segment the blocks of the posting lists that some query visits.

    `plan` is a broadcast `Plan`.
    """

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, together = plan.value.visited()
        asked = np.zeros(len(plan.value.weights), bool)
        for segment in read_segments(batches, len(plan.value.weights)):
            docs, cuts = segment.inverted()
            sketches = segment.sketches(plan.value.weights)
            order, starts, terms, sums, before = [], [], [], [], 0
            for term, near in zip(wanted, together, strict=True):
                if cuts[term] == cuts[term + 1]:
                    continue
                own, begin = clustered(docs[cuts[term] : cuts[term + 1]], sketches)
                asked[near] = True
                sums.append(summary(segment, own, begin, asked))
                asked[near] = False
                order.append(own)
                starts.append(begin + before)
                terms.append(np.full(len(begin), term))
                before += len(own)
            order, starts, terms = flat(order), flat(starts), flat(terms)
            counts, sum_terms, sum_values = (flat([x[k] for x in sums]) for k in range(3))
            columns = {
                "block_terms": terms,
                "block_starts": np.append(starts, len(order)),
                "block_docs": order,
                "sum_starts": np.append(0, np.cumsum(counts)),
                "sum_terms": sum_terms,
                "sum_values": sum_values,
            }
            yield one_row(segment.row | {k: pa.array(v, pa.int32()) for k, v in columns.items()})

    return rows.mapInArrow(of_batches, SEGMENT + BLOCKS)


class Plan(NamedTuple):
    """For each query the terms with their worth, the lists to visit and its floor: scores
    below it are not asked for."""

    weights: np.ndarray
    terms: list[np.ndarray]
    worth: list[np.ndarray]
    visits: list[np.ndarray]
    floors: list[int]

    def visited(self) -> tuple[list[int], list[np.ndarray]]:
        """All lists that a query visits, and the terms that are asked for with each."""
        near: dict[int, list[np.ndarray]] = {}
        for own, lists in zip(self.terms, self.visits, strict=True):
            for term in lists.tolist():
                near.setdefault(term, []).append(own)
        order = sorted(near)
        return order, [np.unique(np.concatenate(near[term])) for term in order]


def seed_plan(queries: Queries, weights: np.ndarray, holding: np.ndarray) -> Plan:
    """Visits each query's rarest lists; `holding` is how many documents hold a term."""
    terms, worth, visits = [], [], []
    for own, times in zip(queries.terms, queries.counts, strict=True):
        useful = (weights[own] > 0) & (holding[own] > 0)
        own, times = own[useful], times[useful]
        rarest = own[np.argsort(holding[own], kind="stable")]
        enough = int(np.searchsorted(np.cumsum(holding[rarest]), SEED_DOCS)) + 1
        terms.append(own)
        worth.append(times * weights[own])
        visits.append(rarest[:enough])
    return Plan(weights, terms, worth, visits, [0] * len(terms))


def full_plan(seeds: Plan, most: np.ndarray, floors: list[int]) -> Plan:
    """Leaves out the lists of the terms that together stay below the floor; `most` is
    the greatest impact of each term."""
    visits = [
        own[needed(worth * most[own], 0, floor)]
        for own, worth, floor in zip(seeds.terms, seeds.worth, floors, strict=True)
    ]
    return seeds._replace(visits=visits, floors=floors)


def needed(bounds: np.ndarray, others: int, floor: int) -> np.ndarray:
    """Which lists to visit: `others` and the smallest bounds that stay below the floor
    together are left out."""
    order = np.argsort(bounds, kind="stable")
    out = np.zeros(len(bounds), bool)
    out[order] = np.cumsum(bounds[order]) + others >= max(floor, 1)
    return out


def of_lists(lists: np.ndarray, inverted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    docs, cuts = inverted
    return np.unique(docs[stretch(cuts[lists], cuts[lists + 1])])


def of_blocks(lists: np.ndarray, blocks: dict, worth: np.ndarray, floor: int) -> np.ndarray:
    """Documents of the blocks whose summary reaches the floor."""
    at = stretch(blocks["low"][lists], blocks["low"][lists + 1])
    starts = blocks["sum_starts"]
    begin, end = starts[at], starts[at + 1]
    where = stretch(begin, end)
    parts = worth[blocks["sum_terms"][where]] * blocks["sum_values"][where]
    bounds = row_sums(parts, np.append(0, np.cumsum(end - begin)))
    at = at[(bounds >= floor) | (begin == end)]
    begin, end = blocks["block_starts"][at], blocks["block_starts"][at + 1]
    return np.unique(blocks["block_docs"][stretch(begin, end)])


def best_of(segment: Segment, plan: Plan, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best documents of the segment, ties at the end included."""
    blocks = inverted = None
    top = np.zeros(segment.size, np.int64)
    top[segment.row["top_terms"].to_numpy()] = segment.row["top_impacts"].to_numpy()
    if "block_terms" in segment.row:
        names = ("block_terms", "block_starts", "block_docs", "sum_starts", "sum_terms", "sum_values")
        blocks = {c: segment.row[c].to_numpy().astype(np.int64) for c in names}
        blocks["low"] = np.searchsorted(blocks["block_terms"], np.arange(segment.size + 1))
    else:
        inverted = segment.inverted()
    worth = np.zeros(segment.size, np.int64)
    for query, lists in enumerate(plan.visits):
        own, floor = plan.terms[query], plan.floors[query]
        worth[own] = plan.worth[query]
        bounds = worth[lists] * top[lists]
        others = int((worth[own] * top[own]).sum() - bounds.sum())
        lists = lists[needed(bounds, others, floor)] if blocks else lists
        found = of_blocks(lists, blocks, worth, floor) if blocks else of_lists(lists, inverted)
        scores = segment.scores(found, worth)
        worth[own] = 0
        good = scores >= max(plan.floors[query], 1)
        found, scores = found[good], scores[good]
        if len(found) > limit:
            least = np.partition(scores, -limit)[-limit]
            found, scores = found[scores >= least], scores[scores >= least]
        if len(found):
            yield query, found, scores


def search(rows: DataFrame, plan, limit: int) -> DataFrame:
    """query, doc_id and score of the best `limit` documents of each segment."""

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in read_segments(batches, len(plan.value.weights)):
            for query, found, scores in best_of(segment, plan.value, limit):
                ids = segment.doc_ids.take(pa.array(found))
                table = pa.table({"id": ids, "score": scores})
                order = [("score", "descending"), ("id", "ascending")]
                best = table.sort_by(order).slice(0, limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(best), query), pa.int32()),
                        best["id"].combine_chunks(),
                        best["score"].combine_chunks(),
                    ],
                    names=["query", "doc_id", "score"],
                )

    return rows.mapInArrow(of_batches, HITS)


def best_rows(hits: DataFrame, limit: int) -> DataFrame:
    """The best rows of each query with their rank, first by shares of the tasks."""

    def cut(frame: DataFrame, *by: Column | str) -> DataFrame:
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        ranked = frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col("rank") <= limit)

    shares = hits.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    return cut(cut(shares, "query", "share").drop("rank", "share"), "query")


def searched(
    spark: SparkSession, docs: DataFrame, queries: Queries, limit: int, seen: dict | None = None
) -> DataFrame:
    """query, doc_id, score and rank for one block of queries; `seen`, if given, gets the
    index and the plan."""
    asked = spark.sparkContext.broadcast(queries)
    vectors = kept(spark, forward(docs, asked), "lexical-vectors")
    totals = vectors.agg(
        F.count("*").alias("n"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")
    ).first()
    size = len(queries.vocabulary)
    holding, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    holding[held["term"].to_numpy()] = held["count"].to_numpy()
    weights = np.array(
        [math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * df + 1))) for df in holding.tolist()],
        np.int64,
    )
    built = segments(vectors, totals["n"], totals["terms"] or 1, totals["postings"] or 0)
    built = kept(spark, built, "lexical-segments")
    tops = built.select(F.explode(F.arrays_zip("top_terms", "top_impacts")).alias("x"))
    tops = tops.groupBy("x.top_terms").agg(F.max("x.top_impacts").alias("most")).toArrow()
    most[tops["top_terms"].to_numpy()] = tops["most"].to_numpy()

    seeds = seed_plan(queries, weights, holding)
    first = best_rows(search(built, spark.sparkContext.broadcast(seeds), limit), limit)
    floors = [0] * len(queries.terms)
    for row in first.where(F.col("rank") == limit).select("query", "score").collect():
        floors[row["query"]] = row["score"]
    plan = full_plan(seeds, most, floors)
    sent = spark.sparkContext.broadcast(plan)
    index = kept(spark, blocked(built, sent), "lexical-blocks")
    if seen is not None:
        seen.update(index=index, plan=plan)
    return best_rows(search(index, sent, limit), limit)


def ranked(
    spark: SparkSession, docs: DataFrame, queries: DataFrame, limit: int = 20
) -> DataFrame:
    """item_id, rank, doc_id and score of the `limit` best documents of every item.

    Equal scores are ranked by doc_id, a NULL doc_id last; fewer documents with a score
    above 0 give fewer rows. NULL and empty texts have no terms: such documents are not
    counted, such items have no rows. Rows with one item_id (NULL too) are one item with
    the terms of all; repeated rows of `docs` are documents of their own. Other columns
    are not read.
    """
    terms = kept(spark, query_terms(queries), "lexical-queries")
    total = terms.agg(F.sum(1 + F.length("term") / 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_TERMS))
    key = T.StructType([T.StructField("query", T.IntegerType()), terms.schema["item_id"]])
    parts = []
    for block in range(blocks):
        asked = read_queries(terms, block, blocks)
        items = spark.createDataFrame(list(enumerate(asked.item_ids)), key)
        found = searched(spark, docs, asked, limit).join(F.broadcast(items), "query")
        parts.append(
            found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        )
    return reduce(DataFrame.unionByName, parts)


ORACLE_SQL = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), item_terms AS (
    SELECT item_id, term, count(*) AS times FROM item_words GROUP BY ALL
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc_words WHERE len(w) > 0
), postings AS (
    SELECT doc_id, n, term, count(*) AS tf
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc_words)
    GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings CROSS JOIN totals GROUP BY term, n_docs
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
        // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item_terms JOIN weights USING (term) JOIN postings USING (term) CROSS JOIN totals
    GROUP BY item_id, doc_id
), placed AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place,
           doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20
"""
