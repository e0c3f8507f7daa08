"""Document quality by Bradley-Terry ranking of preference pairs.

A labelled good document is preferred to a labelled bad one. The chance of that is the
logistic function of the difference of their scores, a score is linear in a document's
features, so the weights minimise the logistic loss of feature differences. The threshold
is the quantile of the scores of the labelled documents that splits them best.

All pairs of all labelled documents count. The chance of a pair depends on its two scores
alone, so a Newton step needs of each label, for each small range of scores, the number of
documents and the sums of their features and products of features: every task adds those
of its documents, and what comes back is as long as there are ranges. A range stands at
its mean score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, bound, kept, steps, texts, words_of

#: Ranges of scores told apart in a step, and in how many deviations of the
#: scores around their mean; beyond them there is one more on each side.
RANGES, DEVIATIONS = 126, 4.0
#: Fixed value: ranges of scores at whose limits the threshold can be.
FINE = 1 << 16
#: Tasks that add up, each sending a few hundred rows a step.
ADDING_TASKS = 64
RIDGE = 1e-4
#: Fixed value: the score from which a document is predicted to be good.
PREDICTED_FROM = 0.3
SYMBOLS = "#*$%&|<>"


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def removed(text: Column, pattern: str) -> Column:
    """How many characters the pattern takes out of the text."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def features_of(text: Column) -> Column:
    """An array of shares and logarithms, all finite, also for an empty text."""

    def counted(t: Column) -> Column:
        return F.struct(
            F.char_length(t).alias("chars"),
            # Without lower-case letters little is left, so the other counts are cheap.
            F.regexp_replace(t, "[a-z]+", "").alias("rest"),
            bound(words_of(ascii_lower(t)), word_counts).alias("words"),
            line_counts(F.split(t, "\n")).alias("lines"),
        )

    return bound(bound(text, counted), vector)


def vector(x: Column) -> Column:
    rest, chars, w, lines = x["rest"], x["chars"], x["words"], x["lines"]
    symbols = F.char_length(rest) - F.char_length(F.translate(rest, SYMBOLS, ""))
    marks = r"[^\x00-\x20A-Za-z0-9.,\x7F-\x{10FFFF}]+"
    values = {
        "long": F.log1p(w["n"].cast("double")),
        "short": F.exp(-w["n"] / 10.0),
        "not_lower": share(F.char_length(rest), chars),
        "upper": share(removed(rest, "[A-Z]+"), chars),
        "digits": share(removed(rest, "[0-9]+"), chars),
        "spaces": share(removed(rest, r"[\x20\x09-\x0D]+"), chars),
        "beyond_ascii": share(removed(rest, r"[^\x00-\x7F]+"), chars),
        "symbols": share(symbols, w["n"]),
        "shouts": share(removed(rest, "!+"), w["n"]),
        "other_marks": share(removed(rest, marks), w["n"]),
        "sentence_marks": share(removed(rest, "[.,]+"), w["n"]),
        "word_length": F.log1p(share(chars, w["n"])),
        "distinct_words": share(w["distinct"], w["n"]),
        "distinct_pairs": share(w["pairs"], w["n"] - 1),
        "same_next": share(w["same_next"], w["n"]),
        "repeated_lines": share(lines["n"] - lines["distinct"], lines["n"]),
        "line_words": F.log1p(share(w["n"], lines["n"])),
    }
    return F.array(*values.values())


def word_counts(w: Column) -> Column:
    pairs = F.transform(
        steps(F.size(w) - 1),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)),
    )
    same = F.filter(steps(F.size(w) - 1), lambda i: F.get(w, i) == F.get(w, i + 1))
    return F.struct(
        F.size(w).alias("n"),
        F.size(F.array_distinct(w)).alias("distinct"),
        F.size(F.array_distinct(pairs)).alias("pairs"),
        F.size(same).alias("same_next"),
    )


def line_counts(lines: Column) -> Column:
    return bound(
        F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(
            F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")
        ),
    )


@dataclass(frozen=True)
class Ranker:
    """Score weights, and what turns scores into numbers between 0 and 1."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    quantile: float

    def score(self, features: Column) -> Column:
        """The logistic function of the score, PREDICTED_FROM at the threshold."""
        slopes = [w / s for w, s in zip(self.weights, self.scale)]
        at_zero = -sum(m * k for m, k in zip(self.mean, slopes)) - self.threshold
        at_zero += math.log(PREDICTED_FROM / (1 - PREDICTED_FROM))
        total = F.lit(at_zero)
        for i, slope in enumerate(slopes):
            total = total + F.get(features, F.lit(i)) * slope
        return 1 / (1 + F.exp(-total))


@dataclass(frozen=True)
class Sums:
    """Of each label (0, 1) and range: documents, and the sums of their features and of
    products of features."""

    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray

    @classmethod
    def of(cls, label: np.ndarray, x: np.ndarray, ranges: np.ndarray, size: int) -> Sums:
        out = cls(np.zeros((2, size)), np.zeros((2, size, x.shape[1])), np.zeros((2, size) + (x.shape[1],) * 2))
        for k in (0, 1):
            for at in np.unique(ranges[label == k]):
                own = x[(label == k) & (ranges == at)]
                out.n[k, at], out.x[k, at], out.xx[k, at] = len(own), own.sum(axis=0), own.T @ own
        return out


@dataclass(frozen=True)
class Scoring:
    """Linear scores, and the ranges they are put in: equal ones between `low` and `high`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    size: int

    def standard(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale

    def ranges(self, scores: np.ndarray) -> np.ndarray:
        width = (self.high - self.low) / (self.size - 2)
        at = np.floor((scores - self.low) / width) + 1 if width > 0 else np.zeros(len(scores))
        return np.clip(at, 0, self.size - 1).astype(int)

    def sums(self, label: np.ndarray, features: np.ndarray) -> Sums:
        x = self.standard(features)
        return Sums.of(label, x, self.ranges(x @ self.weights), self.size)


def fit(width: int, added: Callable[[Scoring], Sums], counted: Callable[[Scoring], tuple]) -> Ranker:
    """A ranker from what `added` and `counted` tell of all labelled documents: their sums,
    and (lowest and highest score, documents of each label and fine range)."""
    plain = added(Scoring(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, 3))
    n = plain.n.sum(axis=1)
    if not n.all():  # nothing to prefer: every document is as good
        keep = -1.0 if n[0] else 1.0
        return Ranker([0.0] * width, [1.0] * width, [0.0] * width, -keep, 0.0)
    mean = plain.x.sum(axis=(0, 1)) / n.sum()
    centred = added(Scoring(mean, np.ones(width), np.zeros(width), 0.0, 0.0, 3)).xx.sum(axis=(0, 1)) / n.sum()
    scale = np.sqrt(np.diag(centred))
    scale[scale < 1e-9] = 1.0
    spread = centred / np.outer(scale, scale)
    weights = np.zeros(width)
    for _ in range(25):  # Newton steps of the logistic loss
        reach = DEVIATIONS * math.sqrt(max(weights @ spread @ weights, 0.0))
        s = added(Scoring(mean, scale, weights, -reach, reach, RANGES + 2))
        # the chance that the good one is preferred, for every two ranges
        at = (s.x @ weights) / np.maximum(s.n, 1)
        chance = 1 / (1 + np.exp(-np.clip(at[1][:, None] - at[0][None, :], -30, 30)))
        pairs = n[0] * n[1]
        gradient = ((chance - 1) @ s.n[0]) @ s.x[1] - (s.n[1] @ (chance - 1)) @ s.x[0]
        bend = chance * (1 - chance)
        cross = s.x[1].T @ bend @ s.x[0]
        curve = np.tensordot(bend @ s.n[0], s.xx[1], 1) + np.tensordot(s.n[1] @ bend, s.xx[0], 1) - cross - cross.T
        step = np.linalg.solve(
            curve / pairs + RIDGE * np.eye(width), gradient / pairs + RIDGE * weights
        )
        weights = weights - step
        if np.abs(step).max() < 1e-6 * max(1.0, np.abs(weights).max()):
            break
    low, high, counts = counted(Scoring(mean, scale, weights, 0.0, 0.0, 3))
    quantile, threshold = best_quantile(low, high, counts)
    return Ranker(mean.tolist(), scale.tolist(), weights.tolist(), threshold, quantile)


def fit_ranker(good: np.ndarray, bad: np.ndarray) -> Ranker:
    """Weights from the features of good and of bad documents, one row for each."""
    both = np.concatenate([good, bad])
    label = np.repeat([1, 0], [len(good), len(bad)])

    def counted(scoring: Scoring) -> tuple:
        scores = scoring.standard(both) @ scoring.weights
        low, high = scores.min(), scores.max()
        at = np.minimum((scores - low) * (FINE / max(high - low, 1e-300)), FINE - 1).astype(int)
        return low, high, np.stack([np.bincount(at[label == k], minlength=FINE) for k in (0, 1)])

    return fit(both.shape[1], lambda scoring: scoring.sums(label, both), counted)


def best_quantile(low: float, high: float, counts: np.ndarray) -> tuple[float, float]:
    """The quantile of all scores, and the score there, that parts good from bad best;
    `counts` has the documents of each label in equal ranges from `low` to `high`.

    Best is the highest mean of both labels' shares on the right side; of quantiles that
    are equally good, the middle.
    """
    grid = np.linspace(0.002, 0.998, 499)
    every = np.cumsum(counts.sum(axis=0))
    # as far between the ranges of two documents next to each other as the quantile is
    place = grid * (every[-1] - 1)
    one, next_one = (np.searchsorted(every, f(place), side="right") for f in (np.floor, np.ceil))
    cuts = np.ceil(one + (place - np.floor(place)) * (next_one - one)).astype(int)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(counts, axis=1)], axis=1)[:, cuts]
    bad, good = below / counts.sum(axis=1)[:, None]
    right = bad - good
    best = np.flatnonzero(right >= right.max() - 1e-9)
    at = best[len(best) // 2]
    return float(grid[at]), float(low + cuts[at] * (high - low) / counts.shape[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(features: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from all labelled rows that are not held out."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .join(features.dropDuplicates(["doc_id"]), "doc_id")
        .select(F.col("quality").cast("int").alias("quality"), "features")
    )
    known = kept(features.sparkSession, known, "labelled").coalesce(ADDING_TASKS)
    first = known.select(F.size("features").alias("width")).first()
    width = first["width"] if first else 0

    def added(scoring: Scoring) -> Sums:
        def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, scoring.size))
            x, xx = np.zeros((*n.shape, width)), np.zeros((*n.shape, width, width))
            for batch in batches:
                if batch.num_rows:
                    values = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    s = scoring.sums(batch["quality"].to_numpy(zero_copy_only=False), values)
                    n, x, xx = n + s.n, x + s.x, xx + s.xx
            label, at = np.nonzero(n)
            rows = [np.concatenate([n[k, i : i + 1], x[k, i], xx[k, i].ravel()]) for k, i in zip(label, at)]
            sums = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), pa.array(at, pa.int32()), sums], names=["label", "at", "sums"]
            )

        out = Sums(
            np.zeros((2, scoring.size)), np.zeros((2, scoring.size, width)),
            np.zeros((2, scoring.size, width, width)),
        )
        table = known.mapInArrow(of_batches, "label int, at int, sums array<double>").collect()
        for row in sorted(table):  # so that sums don't depend on which task was first
            values = np.array(row["sums"])
            out.n[row["label"], row["at"]] += values[0]
            out.x[row["label"], row["at"]] += values[1 : 1 + width]
            out.xx[row["label"], row["at"]] += values[1 + width :].reshape(width, width)
        return out

    def counted(scoring: Scoring) -> tuple:
        slopes = scoring.weights / scoring.scale
        score = F.lit(float(-(scoring.mean @ slopes)))
        for i, slope in enumerate(slopes.tolist()):
            score = score + F.get("features", F.lit(i)) * slope
        scored = known.select("quality", score.alias("score"))
        low, high = scored.agg(F.min("score"), F.max("score")).first()
        at = F.least(F.floor((F.col("score") - low) * (FINE / max(high - low, 1e-300))), F.lit(FINE - 1))
        counts = np.zeros((2, FINE))
        for row in scored.groupBy("quality", at.alias("at")).count().collect():  # FINE of each label at most
            counts[row["quality"], row["at"]] = row["count"]
        return low, high, counts

    return fit(width, added, counted)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Every whole text is scored, a NULL one as an empty one; nothing but the text goes
    into a score. Repeated rows get the same score. A row without doc_id counts as held
    out. Labels other than 0 and 1 and without document are not used, a document with two
    labels has the higher. Without labels of both kinds all documents are good, or all
    bad if only bad ones are known. Other columns are not read.
    """
    features = features_table(spark, docs)
    ranker = learn(features, labels)
    return features.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"),
        ranker.score(F.col("features")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def features_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    return kept(spark, rows.select("doc_id", features_of(F.col("text")).alias("features")), "features")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted to be good, columns as they were."""
    ranker = learn(features_table(spark, docs), labels)
    text = F.coalesce(docs["text"], F.lit(""))
    score = bound(features_of(text), lambda f: ranker.score(f))
    return docs.where(score >= PREDICTED_FROM)
