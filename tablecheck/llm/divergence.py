"""Quality rules: counts, and how far a document's histograms are from its language's.

Two histograms are compared with references by Jensen-Shannon distance: the classes of a
document's characters, and its common words. The references are the sums over all
different documents of a language that pass the base rules, each of which counts for few
words however long it is. A document is held against the reference of its own language.

A reference of few documents says little. That of the characters is therefore drawn
towards the nearest of a few fixed profiles of scripts, that of the words towards the
document itself, as if PRIOR_DOCUMENTS more had been seen. So a language of one document
is judged like any other, only more leniently by its words, and no number of documents
makes a verdict jump.

Words are counted by hash in a fixed number of buckets, so references take bounded memory
and a small shuffle; common words stand far out of what rare words add to a bucket. Short
documents are not judged: their histograms are far from any reference by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACES, ascii_lower, bound, kept, steps, words_of

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
#: The base rules.
LEAST_WORDS = 10
MOST_REPEATED = 20
BUCKETS = 4096
COMMON = 64
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "other")
#: Shares of CLASSES in prose of letters a-z, of another alphabet and of a
#: script without spaces.
SCRIPTS = (
    (0.76, 0.03, 0.01, 0.16, 0.03, 0.0, 0.01),
    (0.01, 0.0, 0.01, 0.16, 0.03, 0.0, 0.79),
    (0.03, 0.01, 0.02, 0.02, 0.01, 0.0, 0.91),
)
PRIOR_DOCUMENTS = 10
#: A document counts in its reference for so many words at most.
DOCUMENT_WORDS = 40
#: A reference takes under 6 KB; so many are broadcast, more are joined by a shuffle in
#: which each language has SALTS keys.
BROADCAST_LANGUAGES = 2000
SALTS = 32
#: Parts of a word that references are summed in: sums of whole numbers have no order.
PARTS = 1 << 24
#: A document needs so many words to be judged by its characters, by its words.
CLASS_WORDS = 30
COMMON_WORDS = 100
CLASS_DISTANCE = 0.33
#: Plus WORD_NOISE / sqrt(words): few words are further from a reference by chance.
WORD_DISTANCE = 0.42
WORD_NOISE = 0.6


def taken_out(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def repeated_words(w: Column) -> Column:
    """Words inside windows of five that occur twice or more in the document."""
    size = REPEAT_WINDOW
    hashes = F.transform(
        steps(F.size(w) - (size - 1)),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))),
    )

    def places(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: (F.get(s, j - 1)["h"] == x["h"])
                        | (F.get(s, j + 1)["h"] == x["h"]),
                    ),
                    lambda x: x["i"],
                )
            )

        return bound(placed, repeated)

    def covered(p: Column) -> Column:
        gaps = F.transform(
            p, lambda at, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - at, F.lit(size)))
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("long")).otherwise(bound(places(h), covered))

    return bound(hashes, counted)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def class_counts(text: Column, rest: Column) -> Column:
    """Characters in each of CLASSES; `rest` is the text without a-z."""
    counts = {
        "upper": taken_out(rest, "[A-Z]+"),
        "digit": taken_out(rest, "[0-9]+"),
        "space": taken_out(rest, SPACES + "+"),
        "stop": taken_out(rest, "[.,;:?'\"()-]+"),
        "other": taken_out(rest, r"[^\x00-\x7F]+"),
    }
    named = F.struct(
        (F.char_length(text) - F.char_length(rest)).alias("lower"),
        F.char_length(rest).alias("rest"),
        *(count.alias(name) for name, count in counts.items()),
    )

    def all_classes(x: Column) -> Column:
        mark = x["rest"] - sum((x[name] for name in counts), F.lit(0))
        return F.array(*(mark if c == "mark" else x[c] for c in CLASSES)).cast("array<bigint>")

    return bound(named, all_classes)


def profiles(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A written table of doc_id, lang, the base counts and both histograms."""
    text = F.col("text")

    def measured(t: Column) -> Column:
        return F.struct(
            words_of(t).alias("words"), F.regexp_replace(t, "[a-z]+", "").alias("rest"), t.alias("t")
        )

    def counted(x: Column) -> Column:
        w, rest, t = x["words"], x["rest"], x["t"]
        buckets = F.transform(
            w, lambda word: F.pmod(F.xxhash64(ascii_lower(word)), F.lit(BUCKETS)).cast("short")
        )
        return F.struct(
            F.xxhash64(t).alias("key"),
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(rest) - F.char_length(F.translate(rest, SYMBOLS, "")))
            .cast("long").alias("n_symbols"),
            duplicate_lines(t).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            class_counts(t, rest).alias("classes"),
            buckets.alias("buckets"),
        )

    lang = F.coalesce(docs["lang"], F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return kept(
        spark,
        rows.select("doc_id", "lang", bound(bound(text, measured), counted).alias("x"))
        .select("doc_id", "lang", "x.*")
        .withColumn("base_failed", failed),
        "profiles",
    )


def references(rows: DataFrame) -> DataFrame:
    """A row for each language with a document that passes the base rules, copies once:
    lang, docs (how many whole documents it is made of), ref_classes (shares of CLASSES),
    ref_words (shares of its common words and of all others) and bins (the place of each
    bucket in ref_words)."""
    weight = F.least("n_words", F.lit(DOCUMENT_WORDS)) * F.lit(float(PARTS))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    passing = (
        rows.where(~F.col("base_failed"))
        .select("lang", "key", "n_words", "classes", "buckets")
        .dropDuplicates(["lang", "key"])
        .withColumn("per_word", F.floor(weight / F.col("n_words")).cast("long"))
        .withColumn("chars", chars)
    )
    sums = passing.groupBy("lang").agg(
        (F.sum(F.least("n_words", F.lit(DOCUMENT_WORDS))) / DOCUMENT_WORDS).alias("docs"),
        F.sum(F.col("n_words") * F.col("per_word")).alias("weight"),
        F.array(
            *(
                F.sum(F.floor(weight * F.get("classes", F.lit(i)) / F.col("chars")).cast("long"))
                for i in range(len(CLASSES))
            )
        ).alias("classes"),
    )
    counts = (
        passing.select("lang", "per_word", F.explode("buckets").alias("bucket"))
        .groupBy("lang", "bucket").agg(F.sum("per_word").alias("count"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "bucket")
    common = (  # at most COMMON rows of a language
        counts.withColumn("place", F.row_number().over(order) - 1)
        .where(F.col("place") < COMMON)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "bucket", "count"))).alias("common"))
    )
    parts = F.greatest(F.lit(1), F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))
    shares = F.transform("common", lambda c: c["count"] / F.col("weight"))
    entries = F.transform("common", lambda c: F.struct(c["bucket"], c["place"]))
    place = bound(
        F.map_from_entries(entries),
        lambda m: F.transform(
            steps(F.lit(BUCKETS)),
            lambda b: F.coalesce(F.try_element_at(m, b.cast("short")), F.size("common")).cast("byte"),
        ),
    )
    return sums.join(common, "lang").select(
        "lang",
        "docs",
        bound(parts, lambda n: F.transform("classes", lambda x: x / n)).alias("ref_classes"),
        bound(shares, lambda s: F.concat(s, F.array(1 - total(s)))).alias("ref_words"),
        place.alias("bins"),
    )


def with_references(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Every row with the reference of its language, NULL where there is none."""
    if refs.count() <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(refs), "lang", "left")
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")
    spread = refs.withColumn("salt", F.explode(steps(F.lit(SALTS))))
    return rows.withColumn("salt", salt).join(spread, ["lang", "salt"], "left").drop("salt")


def divergence_term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits."""

    def half(x: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(0.0)

    return half(p) + half(q)


def distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def drawn(own: Column, docs: Column, prior: Column) -> Column:
    """A share in a reference of `docs` documents, drawn towards a prior one."""
    return (docs * own + PRIOR_DOCUMENTS * prior) / (docs + PRIOR_DOCUMENTS)


def class_distance(classes: Column, own: Column, docs: Column) -> Column:
    """Distance of the character classes to the language's reference, drawn towards the
    script that makes it nearest. Without a reference `docs` is 0."""

    def nearest(shares: Column) -> Column:
        def to(script: tuple[float, ...]) -> Column:
            fixed = F.array(*map(F.lit, script))
            ref = F.zip_with(own, fixed, lambda q, s: drawn(q, docs, s))
            return distance(total(F.zip_with(shares, ref, divergence_term)))

        return F.least(*map(to, SCRIPTS))

    sums = F.aggregate(classes, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = bound(sums, lambda n: F.transform(classes, lambda x: x / F.greatest(n, F.lit(1))))
    return bound(shares, nearest)


def word_distance(buckets: Column, bins: Column, own: Column, docs: Column) -> Column:
    """Distance of the histogram of common words to the language's reference, drawn
    towards the document; NULL without a reference."""
    found = F.sort_array(F.transform(buckets, lambda b: F.get(bins, b.cast("int"))))

    def starts(s: Column) -> Column:
        return F.filter(steps(F.size(s)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def present(s: Column) -> Column:
        def shares(at: Column) -> Column:
            end = F.size(s)
            return F.transform(
                at,
                lambda i, j: F.struct(
                    F.get(own, F.get(s, i).cast("int")).alias("q"),
                    ((F.coalesce(F.get(at, j + 1), end) - i) / end).alias("p"),
                ),
            )

        return bound(starts(s), shares)

    def apart(seen: Column) -> Column:
        both = F.transform(
            seen, lambda x: F.struct(x["p"].alias("p"), drawn(x["q"], docs, x["p"]).alias("q"))
        )

        def summed(pairs: Column) -> Column:
            here = total(F.transform(pairs, lambda x: divergence_term(x["p"], x["q"])))
            absent = 1 - total(F.transform(pairs, lambda x: x["q"]))
            return distance(here + 0.5 * absent)

        return bound(both, summed)

    return F.when(bins.isNotNull(), bound(bound(found, present), apart))


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept, for every row.

    A NULL or empty text has no words and fails the base rules. Repeated rows get the same
    result and count once in the references; a NULL doc_id stays, a NULL or missing lang is
    a language of its own. A distance is NULL where the document is too short, that of the
    words also where no document of its language passes the base rules; then it rejects
    nothing. Of other columns none is read.
    """
    rows = profiles(spark, docs)
    rows = with_references(rows, kept(spark, references(rows), "references"))
    docs_seen = F.coalesce("docs", F.lit(0.0))
    own = F.coalesce("ref_classes", F.array(*(F.lit(0.0) for _ in CLASSES)))
    by_class = class_distance(F.col("classes"), own, docs_seen)
    by_word = word_distance(F.col("buckets"), F.col("bins"), F.col("ref_words"), docs_seen)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rows.select(
        "doc_id", *counts, "base_failed",
        F.when(F.col("n_words") >= CLASS_WORDS, by_class).alias("class_distance"),
        F.when(F.col("n_words") >= COMMON_WORDS, by_word).alias("word_distance"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_DISTANCE) | (
        F.coalesce("word_distance", F.lit(0.0))
        > WORD_DISTANCE + WORD_NOISE / F.sqrt(F.col("n_words").cast("double"))
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
