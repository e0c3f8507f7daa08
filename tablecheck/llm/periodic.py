"""Finds periodic runs of words: stretches that repeat themselves back to back.

A run with period q is a longest stretch whose words equal those q places before. Periods
below `DIRECT` are found by comparing the text with itself at that lag. Longer ones come
from minimizers, at one scale for each power of two: the smallest of the hashed k-grams
of a window is chosen by the window's words alone, so inside a run of period q the choice
repeats q places on. Equal minimizers that far apart are seeds, and a seed is extended
word by word to the ends of its run.

k-grams that are periodic themselves (`aaaa`) would be minimizers everywhere. They lie in
runs of a shorter period, known from the scales before, and are not hashed; the ends of
those runs stand in for them, and where two such runs of one period touch, the lags that
map the one onto the other.

A document is found in one piece by one task; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts

#: A run has at least so many words, and at least two periods.
SHORTEST = 12
#: Periods below it are found by direct comparison; a power of two.
DIRECT = 64
#: Texts are taken together up to so many bytes; a longer one is taken alone.
CHUNK_BYTES = 2_000_000
#: An odd factor for hashes of k-grams modulo 2**64.
BASE = 0x9E3779B97F4A7C15
NO_HASH = np.uint64(2**64 - 1)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLUMNS = (
    "doc_id long, n_words long,"
    " runs array<struct<start: long, length: long, period: long>>, collapsed string"
)

Words = list[bytes]
#: start, end and period of each run.
Runs = np.ndarray


def stretches(x: np.ndarray, lag: int) -> Runs:
    """Runs at a short lag, by comparing the whole text with itself."""
    same = np.flatnonzero(x[lag:] == x[:-lag])
    if not len(same):
        return np.empty((0, 3), np.int64)
    ends = np.append(np.flatnonzero(np.diff(same) != 1), len(same) - 1)
    starts = np.append(0, ends[:-1] + 1)
    first, last = same[starts], same[ends] + 1
    enough = last - first >= max(lag, SHORTEST - lag)
    first, last = first[enough], last[enough]
    return np.stack([first, last + lag, np.full(len(first), lag)], axis=1)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Codes spread over 64 bits, so that sums of them seldom agree by chance."""
    z = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(31)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


class Grams:
    """Hashes of the k-grams of one text, any k: equal k-grams have equal hashes."""

    def __init__(self, x: np.ndarray):
        n = len(x) + 1
        inverse = pow(BASE, -1, 2**64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, inverse, np.uint64)))
        powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(x) * powers[:-1], dtype=np.uint64))

    def all(self, k: int) -> np.ndarray:
        """Of the k-grams from each word on."""
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]

    def at(self, starts: np.ndarray, k: int) -> np.ndarray:
        return (self.sums[starts + k] - self.sums[starts]) * self.down[starts]


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each window; `width` is a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of a window that holds them, ties included."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    least = sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero((most == hashes) & (hashes != NO_HASH))


def equal_pairs(keys: np.ndarray, places: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """(place, lag) of places with one key whose lag is in [low, high)."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    step = 1
    while step < len(keys):
        lags = places[step:] - places[:-step]
        near = (keys[step:] == keys[:-step]) & (lags < high)
        if not near.any():
            return
        hits = np.flatnonzero(near & (lags >= low))
        yield np.stack([places[hits], lags[hits]], axis=1)
        step += 1


def agreeing(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from i and j on, to the right (step 1) or the left (-1)."""
    total, chunk = 0, 64
    while True:
        if step > 0:
            a, b = x[i + total : i + total + chunk], x[j + total : j + total + chunk]
            size = min(len(a), len(b))
            a, b = a[:size], b[:size]
        else:
            size = max(0, min(chunk, i - total + 1))
            a = x[i - total + 1 - size : i - total + 1][::-1]
            b = x[j - total + 1 - size : j - total + 1][::-1]
        differ = a != b
        first = int(differ.argmax()) if size else 0
        if size and differ[first]:
            return total + first
        total += size
        if size < chunk:
            return total
        chunk *= 2


def extended(x: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs around the seeds, (place, lag) each."""
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    last_lag = last_end = -1
    for at, lag in seeds.tolist():
        if lag == last_lag and at < last_end:
            continue
        right = at + agreeing(x, at, at + lag, 1)
        if right == at:
            continue
        left = at - agreeing(x, at - 1, at + lag - 1, -1)
        last_lag, last_end = lag, right
        if right - left >= lag:
            yield left, right + lag, lag


def touching(x: np.ndarray, known: Runs, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Seeds of runs whose one half lies in a known run and whose other half lies in the
    next known run of the same period, where the two touch or overlap."""
    ordered = known[np.lexsort((known[:, 0], known[:, 2]))]
    one, two = ordered[:-1], ordered[1:]
    meet = (one[:, 2] == two[:, 2]) & (two[:, 0] <= one[:, 1]) & (one[:, 1] < two[:, 1])
    for k in np.flatnonzero(meet):
        (start, end, period), (start2, end2, _) = ordered[k], ordered[k + 1]
        period = int(period)
        target = x[end : end + period]
        most = min(high - 1, int(end - start), int(end2 - start2) + period)
        for lag in range(low, min(low + period, most + 1)):
            if np.array_equal(x[end - lag : end - lag + period], target):
                for q in range(lag, most + 1, period):
                    inside = min(end, end2 - q) - max(start, start2 - q)
                    if inside >= q - period:
                        yield int(end - q), q
                break


def scale_runs(x: np.ndarray, grams: Grams, known: Runs, low: int) -> Runs:
    """Runs with a period in [low, 2 * low). `known` holds all runs of shorter ones."""
    k, width, high = low // 4, low // 2, 2 * low
    hashes = grams.all(k)
    inner = known[(known[:, 2] <= k // 2) & (known[:, 1] - known[:, 0] >= k)]
    if len(inner):
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, inner[:, 0], 1)
        np.add.at(depth, inner[:, 1] - k + 1, -1)
        hashes = np.where(np.cumsum(depth[:-1]) > 0, NO_HASH, hashes)
    places = minimizers(hashes, width)
    seeds = [np.empty((0, 2), np.int64), *equal_pairs(hashes[places], places, low, high)]
    if len(inner):
        tails = np.unique(inner[:, 1]) - k
        for found in equal_pairs(grams.at(tails, k), tails, low, high):
            seeds.append(found)
        pairs = list(touching(x, inner, low, high))
        if pairs:
            seeds.append(np.array(pairs, np.int64))
    runs = list(extended(x, np.concatenate(seeds)))
    return np.array(runs, np.int64).reshape(-1, 3)


def smallest_periods(runs: Runs) -> Runs:
    """A stretch found at several lags has the smallest of them as its period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if not len(runs):
        return runs
    new = np.append(True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0))
    return runs[new]


def coded(word_lists: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, a number of its own after each text, so that no run crosses
    it; and where each text begins, the end last."""
    known: dict[bytes, int] = {}
    x: list[int] = []
    starts = [0]
    for k, words in enumerate(word_lists):
        x.extend([known.setdefault(w, len(known)) for w in words])
        x.append(-1 - k)
        starts.append(len(x))
    return np.array(x, np.int64), np.array(starts, np.int64)


def runs_of(word_lists: list[Words]) -> list[Runs]:
    """For each text its runs as rows of start, length and period, by start and period."""
    x, starts = coded(word_lists)
    longest = int(np.diff(starts).max(initial=0)) - 1
    narrow = x.astype(np.int32)
    found = [np.empty((0, 3), np.int64)]
    for lag in range(1, min(DIRECT - 1, longest // 2) + 1):
        found.append(stretches(narrow, lag))
    runs = smallest_periods(np.concatenate(found))
    low = DIRECT
    while 2 * low <= longest:
        sizes = np.diff(starts)
        enough = sizes > 2 * low
        taken = np.repeat(enough, sizes)
        old = np.flatnonzero(taken)
        # the texts that are long enough, one after the other
        shift = np.cumsum(~taken)[old]
        part = x[old]
        new_at = np.cumsum(taken) - 1
        inside = taken[runs[:, 0]] if len(runs) else np.empty(0, bool)
        known = runs[inside].copy()
        known[:, :2] -= (known[:, 0] - new_at[known[:, 0]])[:, None]
        more = scale_runs(part, Grams(part), known, low)
        more[:, :2] += shift[more[:, 0]][:, None]
        runs = smallest_periods(np.concatenate([runs, more]))
        low *= 2
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    runs[:, 1] -= runs[:, 0]
    cuts = np.searchsorted(runs[:, 0], starts)
    out = []
    for k in range(len(word_lists)):
        own = runs[cuts[k] : cuts[k + 1]].copy()
        own[:, 0] -= starts[k]
        out.append(own)
    return out


def collapsed(words: Words, runs: Runs) -> str:
    """The words without the repeats of any run, joined by one space."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
        words = [words[i] for i in kept.tolist()]
    return b" ".join(words).decode()


def planted(doc_id: int | None, words: Words) -> Words:
    """Makes the text periodic from some word on for about a tenth of the doc_ids; a text
    without doc_id stays."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(
    docs: DataFrame, rewrite: Callable[[int | None, Words], Words] | None = None
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, runs (start and length in words,
    period; by start, then period) and collapsed, the words that no run repeats.

    A run has `SHORTEST` words and two periods at least, and its smallest period. A NULL,
    empty or blank text has no words, no runs and an empty collapsed text. A NULL doc_id
    stays; repeated rows get the same result; other columns are not read. `rewrite` may
    change the words before runs are looked for. A text is held by one task, with about
    thirty times its size.
    """

    def of_chunk(ids: list, word_lists: list[Words]) -> pa.RecordBatch:
        if rewrite:
            word_lists = [rewrite(i, w) for i, w in zip(ids, word_lists, strict=True)]
        found = runs_of(word_lists)
        each = np.concatenate(found)
        cuts = np.cumsum([0, *map(len, found)])
        runs = pa.ListArray.from_arrays(
            pa.array(cuts, pa.int32()),
            pa.StructArray.from_arrays([pa.array(each[:, k]) for k in range(3)], fields=list(RUN)),
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(w) for w in word_lists], pa.int64()),
                runs,
                pa.array(
                    [collapsed(w, r) for w, r in zip(word_lists, found, strict=True)], pa.string()
                ),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            word_lists: list[Words] = []
            size = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield of_chunk(ids, word_lists)
                    ids, word_lists, size = [], [], 0
                ids.append(doc_id.as_py())
                word_lists.append(raw.split())  # at the same six characters as the contract
                size += len(raw)
            if ids:
                yield of_chunk(ids, word_lists)

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of_batches, COLUMNS)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of
    all runs and of the collapsed text, from the rows of `periodic_runs`."""
    best = F.array_max(
        F.transform(
            "runs",
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("left"), (-r["period"]).alias("short")
            ),
        )
    )
    lines = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))),
            F.lit("\n"),
        ),
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.left")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
