"""Finds benchmark passages in documents by the word windows they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, bound, kept, row_key, steps, texts, words_of

#: Fixed value: a word is what holds no ASCII sign other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows up to which the benchmark's set of windows is broadcast (about 100 bytes each);
#: above it Spark joins by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Bits of the filter that spares most windows the building of their text. Its size is
#: fixed; a benchmark that fills it costs time and changes no result.
FILTER_BITS = 1 << 18


def window_text(words: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, at + k) for k in range(length)))


def slot(words: Column, at: Column, length: int) -> Column:
    """The filter bit of a window: of its first two words, or its only one."""
    pair = [F.get(words, at + k) for k in range(min(2, length))]
    return F.pmod(F.xxhash64(*pair), F.lit(FILTER_BITS)).cast("int")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words in the window), window and slot, without repeats.

    An item of fewer than `WINDOW` words, but not none, is one window.
    """
    items = benchmark.select(
        "item_id",
        words_of(ascii_lower(F.coalesce("text", F.lit(""))), WORD).alias("words"),
    ).where(F.size("words") > 0)
    w = F.col("words")
    whole = F.struct(
        F.array_join(w, " ").alias("window"), slot(w, F.lit(0), 2).alias("slot")
    )
    full = F.transform(
        steps(F.size(w) - (WINDOW - 1)),
        lambda i: F.struct(
            window_text(w, i, WINDOW).alias("window"),
            slot(w, i, WINDOW).alias("slot"),
        ),
    )
    short = F.size(w) < WINDOW
    return (
        items.select(
            "item_id",
            F.least(F.size(w), F.lit(WINDOW)).alias("n"),
            F.explode(F.when(short, F.array(whole)).otherwise(full)).alias("x"),
        )
        .select("item_id", "n", "x.window", "x.slot")
        .distinct()
    )


def bits_of(slots: DataFrame) -> list[int]:
    """The filter as 64-bit numbers, FILTER_BITS / 64 of them at most."""
    rows = (
        slots.groupBy((F.col("slot") / 64).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
        .collect()
    )
    out = [0] * (FILTER_BITS // 64)
    for row in rows:
        out[row["at"]] = row["bits"]
    return out


def found_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key_a, key_b, at, n, window of the documents' windows that are benchmark windows.

    `wanted` has n, window and slot. Hits are verified by the join itself, which compares
    the windows' texts.
    """
    lengths = [r["n"] for r in wanted.select("n").distinct().collect()]  # 10 at most
    distinct = wanted.select("n", "window").distinct()
    if not lengths:
        return docs.select(
            *row_key("doc_id", "text"), F.lit(0).alias("at"), F.lit(0).alias("n"),
            F.lit("").alias("window"),
        ).limit(0)
    if distinct.count() <= BROADCAST_WINDOWS:
        distinct = F.broadcast(distinct)

    bits = F.expr(f"array({', '.join(f'{x}L' if x >= 0 else f'-{-x}L' for x in bits_of(wanted))})")

    def passes(x: Column) -> Column:
        word = F.get(bits, F.shiftright(x["slot"], 6))
        return F.getbit(word, x["slot"].bitwiseAND(F.lit(63))) == 1

    def of_length(words: Column, n: int) -> Column:
        places = F.transform(
            steps(F.size(words) - (n - 1)),
            lambda i: F.struct(i.alias("at"), slot(words, i, n).alias("slot")),
        )
        return F.transform(
            F.filter(places, passes),
            lambda x: F.struct(
                F.lit(n).alias("n"),
                x["at"].alias("at"),
                window_text(words, x["at"], n).alias("window"),
            ),
        )

    def candidates(words: Column) -> Column:
        return F.concat(*(of_length(words, n) for n in sorted(lengths)))

    return (
        docs.select(
            *row_key("doc_id", "text"),
            F.explode(bound(words_of(ascii_lower(F.col("text")), WORD), candidates)).alias("x"),
        )
        .select("key_a", "key_b", "x.*")
        .join(distinct, ["n", "window"])
    )


def covered(spans: Column) -> Column:
    """Words inside any of the (at, n) spans, which are sorted."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["at"] + span["n"])
        new = end - F.greatest(state["end"], span["at"])
        return F.struct((state["total"] + F.greatest(new, F.lit(0))).alias("total"), end.alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["total"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, and spans, the merged (at, end) word ranges that were hit.

    A NULL or empty text, on either side, has no words. Repeated rows get the same
    result; items that share an item_id count as one; a NULL item_id is not listed. A
    NULL doc_id stays. Other columns are not read.
    """
    rows = texts(docs)
    wanted = benchmark_windows(benchmark)
    # written, as both aggregates below would look through all documents again
    hits = kept(docs.sparkSession, found_windows(rows, wanted), "windows-found")
    key = ["key_a", "key_b"]
    spans = hits.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans")
    )
    items = (
        hits.select(*key, "n", "window")
        .distinct()
        .join(wanted.select("item_id", "n", "window"), ["n", "window"])
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    counted = rows.select(
        *row_key("doc_id", "text"),
        "doc_id",
        F.size(words_of(ascii_lower(F.col("text")), WORD)).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    listed = F.coalesce("items", none)
    return (
        counted.join(spans, key, "left")
        .join(items, key, "left")
        .select(
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
            (hit > 0).alias("contaminated"),
            merged(F.col("spans")).alias("spans"),
        )
    )


def merged(spans: Column) -> Column:
    """Sorted (at, n) spans as ranges `at-end` that don't touch, comma-joined."""
    empty = F.array().cast("array<struct<at:int,end:int>>")

    def add(out: Column, span: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        end = span["at"] + span["n"]
        grown = F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(F.struct(last["at"].alias("at"), F.greatest(last["end"], end).alias("end"))),
        )
        new = F.concat(out, F.array(F.struct(span["at"].alias("at"), end.alias("end"))))
        return F.when((F.size(out) > 0) & (last["end"] >= span["at"]), grown).otherwise(new)

    ranges = F.aggregate(F.coalesce(spans, F.array().cast("array<struct<at:int,n:int>>")), empty, add)
    return F.array_join(
        F.transform(ranges, lambda r: F.concat_ws("-", r["at"].cast("string"), r["end"].cast("string"))),
        ",",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark window, columns as they were."""
    hits = found_windows(texts(docs), benchmark_windows(benchmark)).select(
        F.col("key_a").alias("__hit_a"), F.col("key_b").alias("__hit_b")
    ).distinct()
    a, b = row_key("doc_id", "__text")
    return (
        docs.withColumn("__text", F.coalesce("text", F.lit("")))
        .select("*", a.alias("__key_a"), b.alias("__key_b"))
        .join(
            hits,
            (F.col("__key_a") == F.col("__hit_a")) & (F.col("__key_b") == F.col("__hit_b")),
            "left_anti",
        )
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
