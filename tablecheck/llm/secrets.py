"""Secrets: patterns with checks, and a battery of randomness tests for other long runs.

A run of letters, digits and a few signs is read in the encoding its characters allow. Its
symbols are tested for what random ones would show: equal use of the alphabet (chi-squared
over eight parts of it), as many changes between its halves as by chance (runs test) and
no correlation of neighbours. The three p-values make one (Cauchy combination).

How random must a run look to be reported? Ordinary text and long names are the null
hypothesis: `chance` says how often a run of some length that is no secret looks as random
as this one. It comes from a fixed reference and from controls, ordinary text of the same
length taken from before each run, pooled over neighbouring lengths. A step-up rule over
all runs apart from base spans then bounds the expected share of false ones by
FALSE_SHARE. What counts is the share of runs that look random, not their number: one
document is judged like a thousand of its kind. Short runs look random more easily, and so
need more.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bound, kept, steps, texts

#: Patterns of the base spans; `assign` needs LEAST_VALUE characters in its
#: second group. The others' least lengths are part of the pattern, which changes nothing
#: as their matches are whole runs.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

RUN = "[A-Za-z0-9+/_=-]{20,}"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: Encodings in the order they are tried: what a run must look like, and the alphabet.
ENCODINGS = (
    ("hex", "^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$", DIGITS + "abcdef"),
    ("upper_hex", "^(?=.*[A-F])(?=.*[0-9])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", LOWER.upper() + "234567"),
    ("base64", "^(?=.*[A-Za-z])[A-Za-z0-9+/]+=*$", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[A-Za-z])[A-Za-z0-9_-]+=*$", LOWER.upper() + LOWER + DIGITS + "-_"),
)
PARTS = 8
FALSE_SHARE = 0.05
LENGTHS = (20, 24, 28, 34, 40, 48, 64, 96)
BINS = 1000
#: The reference: of texts (three parts) and of names made of words (one part) a share of
#: AT_ONE * exp((15 - length) / DECAY) / sqrt(r) has a p-value of r or more in the battery.
#: Fitted once by eye, to 700 of each at each of LENGTHS, before MOST_P was set: a quarter
#: of the share of names; texts show fewer.
AT_ONE = 0.025
DECAY = 9.5
#: So many controls count as much as the reference.
WEIGHT = 100
#: No test of a battery can outweigh a failed one: p-values count as this at most.
MOST_P = 0.95


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The results of `add` over all whole numbers up to each place, `add` associative.

    An array that grows by an element is copied, which is quadratic; so the values are
    cut in blocks of about the root of their number, and blocks are put together after.
    """

    def grown(array: Column, initial: Column, value: Callable[[Column], Column]) -> Column:
        def step(done: Column, x: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            return F.concat(done, F.array(F.coalesce(add(last, value(x)), value(x))))

        return F.aggregate(array, initial, step)

    empty = F.array().cast("array<int>")

    def in_blocks(v: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")

        def together(blocks: Column) -> Column:
            ends = grown(blocks, empty, lambda b: F.get(b, F.size(b) - 1))
            return bound(
                ends,
                lambda e: F.flatten(
                    F.transform(
                        blocks,
                        lambda b, k: F.transform(
                            b, lambda x: F.coalesce(add(F.get(e, k - 1), x), x)
                        ),
                    )
                ),
            )

        def cut(n: Column) -> Column:
            places = steps(F.ceil(F.size(v) / n).cast("int"))
            block = F.transform(
                places, lambda k: grown(F.slice(v, k * n + 1, n), empty, lambda x: x)
            )
            return bound(block, together)

        return bound(size, cut)

    return bound(values, in_blocks)


def matches(text: Column, pattern: str, group: Column | None = None) -> Column:
    """start, end, match, value (the group) and the text before, of the leftmost matches
    in code points.

    The pieces between matches and the matches alternate, so their lengths add up to
    the places.
    """

    def laid_out(x: Column) -> Column:
        found, between = x["found"], x["between"]
        lengths = F.transform(
            found, lambda m, i: F.char_length(F.get(between, i)) + F.char_length(m)
        )
        return bound(
            running(lengths, lambda a, b: a + b),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.char_length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("match"),
                    F.get(between, i).alias("before"),
                    F.get(x["value"], i).alias("value"),
                ),
            ),
        )

    everything = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = everything if group is None else F.regexp_extract_all(text, F.lit(pattern), group)
    parts = F.struct(
        everything.alias("found"),
        F.split(text, pattern, -1).alias("between"),
        value.alias("value"),
    )
    none = F.array().cast(
        "array<struct<start:int,end:int,match:string,before:string,value:string>>"
    )
    return F.when(text.rlike(pattern), bound(parts, laid_out)).otherwise(none)


def base_spans(text: Column) -> Column:
    """start, kind (its place in KINDS) and end of the base spans, sorted."""

    def of(kind: int, found: Column) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")
            ),
        )

    long_enough = F.filter(
        matches(text, ASSIGN, F.lit(2)), lambda m: F.char_length(m["value"]) >= LEAST_VALUE
    )
    return F.sort_array(
        F.concat(
            of(0, long_enough), of(1, matches(text, ACCESS)), of(2, matches(text, HEX))
        )
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic form (error below 0.0002)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), 1.5976 * z + 0.07056 * z * z * z))))


def uniformity(v: Column, size: Column) -> Column:
    """p-value of equal use of the alphabet: chi-squared with PARTS - 1 degrees."""
    n = F.size(v)

    def cell(part: Column) -> Column:
        # Symbols of a part: those whose index times PARTS / size falls in it.
        low, high = F.ceil(part * size / PARTS), F.ceil((part + 1) * size / PARTS)
        expected = n * (high - low) / size
        seen = F.size(F.filter(v, lambda x: (x >= low) & (x < high)))
        return (seen - expected) * (seen - expected) / expected

    degrees = PARTS - 1
    chi = total(F.transform(steps(F.lit(PARTS)), cell))
    z = (F.cbrt(chi / degrees) - (1 - 2 / (9 * degrees))) / (2 / (9 * degrees)) ** 0.5
    return upper_tail(z)


def runs_test(v: Column, size: Column) -> Column:
    """p-value of the number of changes between the alphabet's halves, two-sided."""
    n = F.size(v).cast("double")
    high = F.transform(v, lambda x: (x * 2 >= size).cast("int"))

    def tested(h: Column) -> Column:
        ones = F.aggregate(h, F.lit(0), lambda a, x: a + x).cast("double")
        both = 2 * ones * (n - ones)
        changes = F.size(F.filter(steps(F.size(h) - 1), lambda i: F.get(h, i) != F.get(h, i + 1)))
        variance = both * (both - n) / (n * n * (n - 1))
        z = F.abs(changes + 1 - (both / n + 1)) / F.sqrt(variance)
        return F.when(variance > 0, 2 * upper_tail(z)).otherwise(0.0)

    return bound(high, tested)


def serial_test(v: Column) -> Column:
    """p-value of the correlation of neighbouring symbols, two-sided."""
    n = F.size(v).cast("double")

    def tested(d: Column) -> Column:
        square = total(F.transform(d, lambda x: x * x))
        product = total(F.transform(steps(F.size(d) - 1), lambda i: F.get(d, i) * F.get(d, i + 1)))
        z = F.abs(product / square + 1 / n) * F.sqrt(n)
        return F.when(square > 0, 2 * upper_tail(z)).otherwise(0.0)

    mean = bound(total(F.transform(v, lambda x: x.cast("double"))), lambda s: F.transform(v, lambda x: x - s / n))
    return bound(mean, tested)


def combined(p_values: list[Column]) -> Column:
    """One p-value of several dependent ones, by the mean of their Cauchy quantiles."""
    inside = [F.greatest(F.lit(1e-12), F.least(F.lit(MOST_P), p)) for p in p_values]
    mean = sum((F.tan((0.5 - p) * pi) for p in inside), F.lit(0.0)) / len(p_values)
    return 0.5 - F.atan(mean) / pi


def randomness(run: Column) -> Column:
    """The battery's p-value; NULL if no encoding fits, as for words or numbers alone."""
    alphabet = F.lit(None).cast("string")
    for _, pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(run.rlike(pattern), F.lit(symbols)).otherwise(alphabet)

    def tested(x: Column) -> Column:
        v, size = x["v"], F.char_length(x["alphabet"])
        return combined([uniformity(v, size), runs_test(v, size), serial_test(v)])

    def read(symbols: Column) -> Column:
        signs = F.filter(F.split(F.rtrim(run, F.lit("=")), ""), lambda c: c != "")
        v = F.transform(signs, lambda c: F.position(c, symbols) - 1)
        whole = F.struct(symbols.alias("alphabet"), v.alias("v"))
        return F.when(symbols.isNotNull(), bound(whole, tested))

    return bound(alphabet, read)


def apart(base: Column, runs: Column) -> Column:
    """For each run, both sorted by start, whether no base span overlaps it.

    Of the spans that start no later the one that reaches furthest decides; of the others
    the next one, as runs don't overlap each other.
    """
    flat = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("run"), b["end"].alias("end"))),
        F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("run"), r["end"].alias("end"))),
    )

    def judged(x: Column) -> Column:
        reach = running(
            F.transform(x, lambda s: F.when(s["run"] == 0, s["end"]).otherwise(F.lit(0))),
            lambda a, b: F.when(a.isNotNull(), F.greatest(a, b)),
        )

        def flags(ends: Column) -> Column:
            def free(s: Column, i: Column) -> Column:
                after = F.get(x, i + 1)
                met = (after["run"] == 0) & (after["start"] < s["end"])
                return F.struct(
                    s["run"].alias("run"),
                    ((F.get(ends, i) <= s["start"]) & ~F.coalesce(met, F.lit(False))).alias("free"),
                )

            return F.transform(
                F.filter(F.transform(x, free), lambda s: s["run"] == 1), lambda s: s["free"]
            )

        return bound(reach, flags)

    return bound(F.sort_array(flat), judged)


def with_runs(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans) and runs: start, end, whether apart from base spans, the
    battery's p and that of the control text."""
    text = F.col("text")

    def measured(x: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            length = m["end"] - m["start"]
            plain = F.regexp_replace(m["before"], "[^A-Za-z0-9+/_=-]+", "")
            control = F.when(
                F.char_length(plain) >= length,
                F.substring(plain, F.char_length(plain) - length + 1, length),
            )
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.get(x["apart"], i).alias("apart"),
                randomness(m["match"]).alias("p"),
                bound(control, lambda c: F.coalesce(randomness(c), F.when(c.isNotNull(), 0.0))).alias("control"),
            )

        return F.transform(x["found"], one)

    spans = texts(docs).select(
        "doc_id", base_spans(text).alias("base"), matches(text, RUN).alias("found")
    )
    free = F.struct(F.col("found").alias("found"), apart(F.col("base"), F.col("found")).alias("apart"))
    none = F.array().cast(
        "array<struct<start:int,end:int,apart:boolean,p:double,control:double>>"
    )
    runs = F.when(F.size("found") > 0, bound(free, measured)).otherwise(none)
    return spans.select("doc_id", "base", runs.alias("runs"))


def length_range(length: Column) -> Column:
    return sum(((length >= low).cast("int") for low in LENGTHS), F.lit(0))


def chance(length: int, r: float, above: int, controls: int) -> float:
    """How often what is no secret looks as random as `r`: the reference, or more if of
    the controls more do. Without controls it is the reference."""
    reference = min(1.0, AT_ONE * exp((15 - length) / DECAY) / sqrt(max(r, 1e-9)))
    return max(reference, (WEIGHT * reference + above) / (WEIGHT + controls))


def stepped_up(tested: list[tuple[float, int]]) -> float:
    """The highest chance that is still reported, of (chance, number of runs), by the rule
    of Benjamini and Hochberg; below 0 if none is."""
    total, seen, cut = sum(n for _, n in tested), 0, -1.0
    for p, n in sorted(tested):
        seen += n
        if p * total <= FALSE_SHARE * seen:
            cut = p
    return cut


def cuts(rows: DataFrame) -> dict[int, float]:
    """The least p-value that is reported, for each range of lengths that has one."""
    runs = rows.select(F.explode("runs").alias("r")).select(
        length_range(F.col("r.end") - F.col("r.start")).alias("lengths"), "r.*"
    )

    def binned(p: str, run: int) -> DataFrame:
        return runs.where(F.col(p).isNotNull() & (F.lit(run == 0) | F.col("apart"))).select(
            "lengths",
            F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).alias("bin"),
            F.lit(run).alias("run"),
            F.lit(1 - run).alias("control"),
        )

    counts = (
        binned("p", 1).union(binned("control", 0)).groupBy("lengths", "bin")
        .agg(F.sum("run").alias("run"), F.sum("control").alias("control"))
    )
    found = counts.collect()  # at most a row for each bin of each range
    tested = []
    for lengths in sorted({c["lengths"] for c in found}):
        near = [c for c in found if abs(c["lengths"] - lengths) <= 1]
        controls = sum(c["control"] for c in near)
        upwards = [0] * BINS
        for c in near:
            upwards[c["bin"]] += c["control"]
        for b in range(BINS - 2, -1, -1):
            upwards[b] += upwards[b + 1]
        for c in found:
            if c["lengths"] == lengths and c["run"]:
                r = c["bin"] / BINS
                p = chance(LENGTHS[lengths - 1], r, upwards[c["bin"]], controls)
                tested.append((lengths, r, p, c["run"]))
    limit = stepped_up([(p, n) for *_, p, n in tested])
    least: dict[int, float] = {}
    for lengths, r, p, _ in tested:
        if p <= limit:
            least[lengths] = min(r, least.get(lengths, 1.0))
    return least


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, n_random, base_sha256 and spans.

    A NULL or empty text has no spans. A run that overlaps a base span adds none. Repeated
    rows get the same result and count as often as they occur; a NULL doc_id stays. Other
    columns are not read.
    """
    rows = kept(spark, with_runs(docs), "runs")
    found = cuts(rows)

    def is_secret(run: Column) -> Column:
        lengths = length_range(run["end"] - run["start"])
        cut = F.lit(2.0)
        for name, p in found.items():
            cut = F.when(lengths == name, F.lit(p)).otherwise(cut)
        return run["apart"] & F.coalesce(run["p"] >= cut, F.lit(False))

    added = F.transform(
        F.filter("runs", is_secret),
        lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")),
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.withColumn("added", added).select(
        "doc_id",
        *(count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])),
        F.size("added").cast("long").alias("n_random"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
