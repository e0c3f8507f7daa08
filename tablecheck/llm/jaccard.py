"""Exact Jaccard join of documents' shingle sets in the metric space of 1 - similarity.

A document is its set of distinct five-word shingles. Documents with equal sets form a
class, of which one stands for all. Two sets within distance `TAU` share one of their
first shingles in any common order (rare before frequent, else by hash); how many count
as first follows from the set's size. The smallest class among those that have a shingle
first is a pivot, and all of them belong to its region: two linked documents are in one
region at least, and documents that share no first shingle with another are in none.

Regions are joined where their sets are gathered. `region_links` takes pivots of the
region, assigns every document to the nearest (Voronoi cells), lets a document also join
the cells of pivots that are at most 2 * TAU further away (by the triangle inequality no
link crosses a cell border outside that window), and does the same in every cell until
cells are small; there, and where cells do not get smaller, pairs whose distances to the
pivots differ by more than TAU are left out and the others are counted.

What is wanted is which documents are connected. So pairs known to be connected are not
counted again, and a region too large for one task is dealt out in blocks: first every
block by itself with the region's pivot, then only the blocks of documents that were not
connected with the pivot against all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, bound, kept, steps, texts, words_of

#: Fixed value: documents link at a similarity of 75 in 100.
PERCENT = 75
TAU = 1 - PERCENT / 100
SHINGLE = 5
#: Frequent shingles go last in the order. Which count as frequent has no effect on the
#: result, so the list sent to the tasks may be bounded.
FREQUENT = 32
FREQUENT_LISTED = 100_000
COUNTED_AT_ONCE = 4_000_000
#: Of a set's shingles are first in addition to the least number needed; documents that
#: share less than that with all others can't be linked.
EXTRA_PERCENT = 7
#: Sizes of linked sets are within one level: a little more than 100 / PERCENT.
LEVEL = 1.34
#: The same in millionths of a logarithm, in which sizes are compared; one for rounding.
NEAR = math.ceil(1e6 * math.log(100 / PERCENT)) + 1
#: A block of a region has this many documents and shingles at most (or one document).
BLOCK_DOCS = 1000
BLOCK_SHINGLES = 1_000_000
#: Assignments of documents to tasks up to which they are broadcast (about 50 bytes each),
#: so that only the texts that are sent are shuffled.
BROADCAST_TASKS = 500_000
LEAF = 48
PIVOTS = 8


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Sorted hashes of the distinct shingles; the whole text if it has fewer words."""

    def hashed(w: Column) -> Column:
        windows = F.transform(
            steps(F.size(w) - (size - 1)),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))),
        )
        return (
            F.when(F.size(w) >= size, F.sort_array(F.array_distinct(windows)))
            .when(F.size(w) > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return bound(words_of(ascii_lower(text)), hashed)


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """Shingles of many sets, rarest first, at most FREQUENT_LISTED.

    Tasks count what they hold and pass on what they met three times or more, so a
    shingle is missed only if it is spread thinly; it then merely stands earlier.
    """

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 3
        return pa.RecordBatch.from_arrays(
            [pa.array(values[often]), pa.array(counts[often])], names=["shingle", "n"]
        )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append(values)
            size += len(values)
            if size > COUNTED_AT_ONCE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    rows = (
        sets.select("set")
        .mapInArrow(local, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT_LISTED)
        .collect()
    )
    return np.array([r["shingle"] for r in rows[::-1]], dtype=np.int64)


def extra_count(size):
    """At least so many of its first shingles a set shares with any set linked to it."""
    return EXTRA_PERCENT * size // 100


def first_count(size: int) -> int:
    """How many of a set's shingles are its first: those that a linked set can't all miss,
    and extra ones, which make it miss fewer."""
    return size - -(-PERCENT * size // 100) + 1 + extra_count(size)


def with_first(sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Adds `first`, a set's first shingles in the common order, and `rare`, how many of
    them are not frequent; drops `set`."""
    order = np.argsort(frequent, kind="stable")
    known = frequent[order]

    def firsts(values: np.ndarray) -> tuple[np.ndarray, int]:
        count = first_count(len(values)) if len(values) else 0
        if not len(known):
            return values[:count], count
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        often = known[at] == values
        rare = values[~often]
        if len(rare) >= count:
            return rare[:count], count
        last = values[often][np.argsort(order[at[often]], kind="stable")]
        return np.concatenate([rare, last])[:count], len(rare)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("set")
            values = arrays.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(arrays.value_lengths().to_numpy(zero_copy_only=False))
            found = [firsts(x) for x in np.split(values, ends[:-1])] if len(ends) else []
            parts = [x for x, _ in found]
            rare = pa.array([n for _, n in found], pa.int32())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            flat = np.concatenate(parts) if parts else np.array([], dtype=np.int64)
            first = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())
            )
            others = [batch.column(c) for c in ("doc_id", "n", "key_a", "key_b")]
            yield pa.RecordBatch.from_arrays(
                [*others, first, rare],
                names=["doc_id", "n", "key_a", "key_b", "first", "rare"],
            )

    return sets.mapInArrow(
        cut, "doc_id long, n long, key_a long, key_b long, first array<long>, rare int"
    )


class Region:
    """Finds which of some sets are connected, all in memory."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        dense = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
        self.sets = np.split(dense, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(int(dense.max()) + 1, dtype=bool)
        self.component = np.arange(len(sets))
        self.counted = 0

    def joined(self) -> np.ndarray:
        self.join(np.argsort(self.sizes, kind="stable"))
        return self.component

    def shared(self, doc: int, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        self.mark[self.sets[doc]] = True
        out = np.add.reduceat(self.mark[values], starts, dtype=np.int64)
        self.mark[self.sets[doc]] = False
        self.counted += len(starts)
        return out

    def gathered(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum(self.sizes[docs])[:-1]])
        return np.concatenate([self.sets[i] for i in docs]), starts

    def connect(self, doc: int, others: np.ndarray) -> None:
        names = np.unique(self.component[np.append(others, doc)])
        if len(names) > 1:
            self.component[np.isin(self.component, names[1:])] = names[0]

    def links(self, doc: int, others: np.ndarray, shared: np.ndarray) -> np.ndarray:
        union = self.sizes[doc] + self.sizes[others] - shared
        return 100 * shared >= PERCENT * union

    def join(self, docs: np.ndarray) -> None:
        if len(np.unique(self.component[docs])) < 2:
            return
        if len(docs) <= LEAF:
            self.sweep(docs, np.zeros((0, len(docs))))
            return
        values, starts = self.gathered(docs)
        pivots = docs[np.linspace(0, len(docs) - 1, PIVOTS).astype(int)]
        distances = np.empty((len(pivots), len(docs)))
        for row, pivot in enumerate(pivots):
            shared = self.shared(pivot, values, starts)
            self.connect(pivot, docs[self.links(pivot, docs, shared)])
            distances[row] = 1 - shared / (self.sizes[pivot] + self.sizes[docs] - shared)
        window = distances.min(axis=0) + 2 * TAU + 1e-9
        cells = [np.flatnonzero(row <= window) for row in distances]
        if max(map(len, cells)) > 0.7 * len(docs):
            self.sweep(docs, distances)
            return
        for cell in cells:
            if len(cell):
                self.join(docs[cell])

    def sweep(self, docs: np.ndarray, distances: np.ndarray) -> None:
        """Counts every pair that may link and is not connected yet; docs by size."""
        sizes = self.sizes[docs]
        for at, doc in enumerate(docs):
            end = np.searchsorted(sizes, 100 * sizes[at] // PERCENT, side="right")
            near = np.arange(at + 1, end)
            near = near[self.component[docs[near]] != self.component[doc]]
            if len(near) and len(distances):
                gap = np.abs(distances[:, near] - distances[:, [at]]).max(axis=0)
                near = near[gap <= TAU + 1e-9]
            if len(near):
                others = docs[near]
                shared = self.shared(doc, *self.gathered(others))
                self.connect(doc, others[self.links(doc, others, shared)])


def region_links(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b) for each document b and another, a, that it is connected with."""
    group = group.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)
    ids = group["doc_id"].to_numpy()
    component = Region([np.asarray(x) for x in group["set"]]).joined()
    first = pd.Series(ids).groupby(component).transform("min").to_numpy()
    linked = first != ids
    return pd.DataFrame({"a": first[linked], "b": ids[linked]})


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """doc_id and component (the smallest doc_id it is connected with) from links a, b.

    Labels pass to neighbours and then to the label's own label, until none changes.
    Every round is a written table.
    """
    links = kept(spark, links.distinct(), "links")
    both = links.select("a", "b").union(links.select("b", "a")).toDF("doc_id", "other")
    labels = both.select("doc_id").distinct().withColumn("component", F.col("doc_id"))
    while True:
        seen = (
            both.join(labels.toDF("other", "label"), "other")
            .groupBy("doc_id")
            .agg(F.min("label").alias("label"))
        )
        better = labels.join(seen, "doc_id").select(
            "doc_id", F.least("component", "label").alias("label"),
            F.col("component").alias("old"),
        )
        jumps = better.select(F.col("doc_id").alias("label"), F.col("label").alias("jump"))
        new = kept(
            spark,
            better.join(jumps, "label").select("doc_id", F.col("jump").alias("component"), "old"),
            "labels",
        )
        labels = new.select("doc_id", "component")
        if new.where(F.col("component") != F.col("old")).isEmpty():
            return labels


def counted_broadcast(frame: DataFrame) -> DataFrame:
    """A written frame, marked to be broadcast if it has few rows."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_TASKS else frame


def copies(spark: SparkSession, heads: DataFrame) -> DataFrame:
    """doc_id, key_a, key_b and class_id of the documents whose set is that of a document
    with a smaller doc_id. Sets that no other document has are not joined with anything."""
    key = ["key_a", "key_b"]
    several = heads.groupBy(*key).agg(
        F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last")
    )
    several = several.where(F.col("last") > F.col("class_id")).drop("last")
    several = counted_broadcast(kept(spark, several, "several"))
    found = heads.select("doc_id", *key).join(several, key)
    return kept(spark, found.where(F.col("doc_id") > F.col("class_id")).distinct(), "copies")


def region_members(spark: SparkSession, heads: DataFrame) -> DataFrame:
    """doc_id, n, pivot: the documents and the pivots of their regions; `heads` has no two
    rows with equal sets.

    Linked sets differ in size by a third at most. So a first shingle counts for a set if
    one of such a size has it too, and documents with too few of those are left out. Sizes
    are part of a region as well: a set is in the regions of its own size level and of the
    next, so neighbouring levels meet.
    """
    size = F.floor(F.log(F.col("n")) * 1e6).cast("long")
    rows = heads.select(
        "doc_id", F.col("n").cast("int").alias("n"), "rare", F.posexplode("first").alias("at", "shingle")
    )
    # Most shingles are in one set only and go at once. A frequent one is never alone, and
    # might be too many rows for one task, so it isn't asked.
    near = Window.partitionBy("shingle").orderBy(size).rangeBetween(-NEAR, NEAR)
    rare = (
        rows.where(F.col("at") < F.col("rare"))
        .select("doc_id", "n", "shingle")
        .withColumn("near", F.count("*").over(near))
        .where(F.col("near") > 1)
        .select("doc_id", "n", "shingle")
    )
    often = rows.where(F.col("at") >= F.col("rare")).select("doc_id", "n", "shingle")
    shared = kept(spark, rare.union(often), "shared")
    enough = F.col("met") >= F.greatest(F.floor(F.col("n") * EXTRA_PERCENT / 100), F.lit(1))
    active = kept(
        spark,
        shared.groupBy("doc_id", "n").agg(F.count("*").alias("met")).where(enough).select("doc_id"),
        "active",
    )
    level = F.floor(F.log(F.col("n")) / math.log(LEVEL)).cast("int")
    left = shared.join(counted_broadcast(active), "doc_id", "left_semi").select(
        "*", F.explode(F.array(level, level + 1)).alias("level")
    )
    pivots = (
        left.groupBy("shingle", "level")
        .agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
        .where(F.col("last") > F.col("pivot"))
        .select("shingle", "level", "pivot")
    )
    return left.join(pivots, ["shingle", "level"]).select("doc_id", "n", "pivot").distinct()


def blocks_of(members: DataFrame) -> DataFrame:
    """Adds `blocks`, into how many its region is dealt out, and the member's `block`."""
    sizes = members.groupBy("pivot").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)
        ).alias("blocks")
    )
    return members.join(sizes, "pivot").withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    )


def gathered_links(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Links within every task; `tasks` has doc_id and task, a struct."""
    sent = kept(
        docs.sparkSession,
        tasks.groupBy("doc_id").agg(F.collect_set("task").alias("tasks")),
        "sent",
    )
    if (sent.agg(F.sum(F.size("tasks"))).first()[0] or 0) <= BROADCAST_TASKS:
        sent = F.broadcast(sent)
    return (
        docs.join(sent, "doc_id")
        .select("doc_id", shingles(F.col("text")).alias("set"), "tasks")
        .select("doc_id", "set", F.explode("tasks").alias("task"))
        .groupBy("task")
        .applyInPandas(region_links, "a long, b long")
    )


def task(pivot: Column, one: Column, other: Column) -> Column:
    return F.struct(
        pivot.alias("pivot"), one.cast("long").alias("one"), other.cast("long").alias("other")
    ).alias("task")


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id for every row of `docs`.

    class_id is the smallest doc_id with the same set of shingles, component_id the
    smallest that a chain of links reaches. A NULL, empty or blank text has no shingles,
    is linked with nothing and keeps its own doc_id as both. Repeated rows are repeated in
    the result; rows that share a doc_id are one node. A row without doc_id links nothing
    and has a NULL component. Other columns are not read.
    """
    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = rows.select("doc_id", shingles(F.col("text")).alias("set"))
    frequent = frequent_shingles(sets)
    keyed = sets.select(
        "doc_id",
        F.size("set").cast("long").alias("n"),
        F.xxhash64("set").alias("key_a"),
        F.xxhash64(F.lit(1), "set").alias("key_b"),
        "set",
    )
    heads = kept(spark, with_first(keyed, frequent), "heads")
    filled = heads.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    own = ["doc_id", "key_a", "key_b"]
    same = copies(spark, filled)
    unique = unique_ids(heads)
    firsts = filled.join(counted_broadcast(same.select(*own)), own, "left_anti")
    firsts = firsts if unique else firsts.dropDuplicates(own)

    members = kept(spark, blocks_of(region_members(spark, firsts)), "members")
    pivot, block, blocks = F.col("pivot"), F.col("block"), F.col("blocks")
    whole = rows.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    whole = rows if unique else whole
    alone = members.select("doc_id", task(pivot, block, block))
    hubs = (
        members.where((blocks > 1) & (F.col("doc_id") == pivot))
        .withColumn("each", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("doc_id", task(pivot, F.col("each"), F.col("each")))
    )
    links = kept(spark, gathered_links(whole, alone.union(hubs)), "found")
    found = components(spark, links)

    # Regions of several blocks: who is not connected with the pivot meets everybody.
    many = members.where(blocks > 1)
    if not many.isEmpty():
        named = many.join(found, "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id")
        )
        centre = named.where(F.col("doc_id") == pivot).select(
            "pivot", F.col("component").alias("main")
        )
        named = named.join(centre, "pivot").withColumn(
            "apart", (F.col("component") != F.col("main")).cast("int")
        )
        named = kept(spark, named.select("doc_id", "pivot", "blocks", "block", "apart"), "apart")
        apart = named.where("apart = 1")
        # Those apart have odd block numbers, the others even ones.
        groups = apart.select("pivot", (2 * block + 1).alias("one")).distinct()
        places = named.select("pivot", (2 * block + F.col("apart")).alias("other")).distinct()
        pairs = groups.join(places, "pivot").where(
            (F.col("other") % 2 == 0) | (F.col("other") > F.col("one"))
        )
        mine = named.select("doc_id", "pivot", (2 * block + F.col("apart")).alias("mine"))
        tasks = mine.join(pairs.withColumnRenamed("one", "mine"), ["pivot", "mine"]).select(
            "doc_id", task(pivot, F.col("mine"), F.col("other"))
        ).union(
            mine.join(pairs.withColumnRenamed("other", "mine"), ["pivot", "mine"]).select(
                "doc_id", task(pivot, F.col("one"), F.col("mine"))
            )
        )
        if not tasks.isEmpty():
            found = components(spark, links.union(gathered_links(whole, tasks)))

    return (
        heads.select("n", *own)
        .join(same, own, "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .join(found.toDF("class_id", "component"), "class_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "class_id").alias("component_id"),
            "class_id",
        )
    )


def unique_ids(rows: DataFrame) -> bool:
    return rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with only the smallest doc_id of each component, columns as they were.

    Rows without a doc_id stay. Of rows that share a doc_id one stays.
    """
    found = jaccard_components(spark, docs).where("doc_id != component_id")
    dropped = kept(spark, found.select(F.col("doc_id").alias("__dropped")), "dropped")
    left = docs.join(dropped, docs["doc_id"] == F.col("__dropped"), "left_anti")
    if unique_ids(docs.where(F.col("doc_id").isNotNull())):
        return left
    named = left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.union(left.where(F.col("doc_id").isNull()))
