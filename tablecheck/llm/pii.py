"""Personal data by a skip-chain conditional random field.

Patterns with checks give base spans. They also label the tokens the field is learnt from:
a token is what stands between white space, its label the kind of the span that covers it,
or none. A token that holds neither a digit nor an at sign has no label in the patterns
and in the field, so it is no node; it is seen as the word before or after one. Nodes next
to each other are linked in the chain; nodes of one document with the same, or a similar
(equal digits), text are linked by skip edges, each with the one before it. Loopy
sum-product messages over both kinds of edges give every node its label probabilities.

Base spans are evidence: their nodes keep their labels. What the field labels beyond them,
repeats without the form the pattern asks for in most cases, is added; a card or a phone
number of several nodes next to each other is one span.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import kept, texts

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # A match never begins inside a run of digits; saying so keeps long runs linear.
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NODE_SIGN = re.compile("[0-9@]")
GAP = re.compile(r"[\x20\x09-\x0D]")
GAPS = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
EDGE_MARKS = "\"'`.,;:!?()[]{}<>*#$%&|"
#: Documents with base spans that the field is learnt from, those with the smallest hash,
#: and as many with nodes but without base spans.
SAMPLE_DOCS = 1000
#: A field label is added only from this probability.
SURE = 0.95
#: Least and most digits of the kinds that may stand in several nodes.
SPACED = {"card": (13, 19), "phone": (9, 15)}
LETTER = re.compile("[A-Za-z]")
JOINT = re.compile(r"[\x20\x09-\x0D().-]*")
ROUNDS = 12
SKIP_WEIGHT = 2.0
OTHER = 0
LABELS = ("other", *KINDS)
FEATURE_BITS = 14
CONTEXT = 40


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether what the pattern matched is of the kind."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))
    if kind == "card":
        digits = re.sub("[^0-9]", "", text) if len(text) <= 40 else ""
        return 13 <= len(digits) <= 19 and passes_luhn(digits)
    if kind == "phone":
        return 9 <= sum("0" <= c <= "9" for c in text) <= 15
    return True


def email_matches(text: str) -> Iterator[re.Match]:
    """The pattern's matches; looks only where there is an at sign.

    A match begins with the local part's run of letters before an at sign, which can't
    hold an at sign; so a search from the start of that run finds what a search of the
    whole text does.
    """
    pattern, local = PATTERNS["email"], _LOCAL
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        found = pattern.match(text, start) if start < at else None
        if found:
            yield found
            done = found.end()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then start."""
    out = []
    for kind in KINDS:
        found = email_matches(text) if kind == "email" else PATTERNS[kind].finditer(text)
        out += [Span(kind, m.start(), m.end()) for m in found if holds(kind, m[0])]
    return out


def shape(token: str) -> str:
    out = re.sub("[a-zà-ÿ]+", "a", re.sub("[A-Z]+", "A", token))
    return re.sub("[0-9]+", "0", out)


def digits_of(token: str) -> str:
    """What similar tokens share: their digits, or their letters if they have none."""
    found = re.sub("[^0-9]", "", token)
    return found if len(found) >= 7 else token.lower()


def features(token: str, before: str, after: str) -> list[int]:
    """Numbers of the features of a node, below 2 ** FEATURE_BITS."""
    bare = token.strip(EDGE_MARKS)
    digits = sum("0" <= c <= "9" for c in bare)
    names = (
        f"shape {shape(bare)[:24]}",
        f"digits {min(digits, 20)}",
        f"at {'@' in bare} dots {min(bare.count('.'), 4)} dashes {min(bare.count('-'), 4)}",
        f"plus {bare.startswith('+')} length {min(len(bare), 24) // 4}",
        f"before {shape(before)[:12]}",
        f"after {shape(after)[:12]}",
        f"word before {before.lower().strip(EDGE_MARKS)[:12]}",
    )
    mask = (1 << FEATURE_BITS) - 1
    return [int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "little") & mask for x in names]


class Nodes(NamedTuple):
    starts: list[int]
    ends: list[int]
    tokens: list[str]
    numbers: list[list[int]]
    chained: list[bool]


def nodes_of(text: str) -> Nodes:
    """The nodes of a text; `chained` tells whether the one before stands next to it."""
    out = Nodes([], [], [], [], [])
    last = -1
    for start, end in node_places(text):
        left = text[max(0, start - CONTEXT) : start].split()
        right = text[end : end + CONTEXT].split(None, 1)
        token = text[start:end]
        out.starts.append(start)
        out.ends.append(end)
        out.tokens.append(token.strip(EDGE_MARKS))
        out.numbers.append(
            features(token[:200], left[-1] if left else "", right[0] if right else "")
        )
        out.chained.append(last >= 0 and not text[last:start].strip())
        last = end
    return out


def node_places(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each token with a digit or an at sign."""
    end = 0
    while found := NODE_SIGN.search(text, end):
        start, floor = found.start(), end
        while start > floor and text[start - 1] not in GAPS:
            start -= 1
        gap = GAP.search(text, found.start())
        end = gap.start() if gap else len(text)
        yield start, end


def labels_of(nodes: Nodes, spans: Iterable[Span]) -> np.ndarray:
    """The label of each node: the kind of the first base span that overlaps it."""
    labels = np.zeros(len(nodes.starts), dtype=np.int64)
    starts, ends = np.array(nodes.starts), np.array(nodes.ends)
    for span in spans:
        a, b = np.searchsorted(ends, span.start, "right"), np.searchsorted(starts, span.end)
        free = labels[a:b] == OTHER
        labels[a:b][free] = 1 + KINDS.index(span.kind)
    return labels


@dataclass(frozen=True)
class Field:
    """Learnt potentials: of features, of neighbours in the chain, of skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def learn(documents: Iterable[str], passes: int = 6, rate: float = 0.5) -> Field:
    """A field from base spans: a maximum-entropy model of nodes, and label pair counts."""
    count = len(LABELS)
    rows, targets = [], []
    chain = np.ones((count, count))
    skip = np.ones((count, count))
    for text in documents:
        nodes = nodes_of(text)
        labels = labels_of(nodes, base_spans(text))
        rows += nodes.numbers
        targets += labels.tolist()
        for i, chained in enumerate(nodes.chained):
            if chained:
                chain[labels[i - 1], labels[i]] += 1
        for i, j in skip_edges(nodes):
            skip[labels[i], labels[j]] += 1
            skip[labels[j], labels[i]] += 1
    unary = np.zeros((1 << FEATURE_BITS, count))
    if rows:
        x, y = np.array(rows), np.array(targets)
        squares = np.full(unary.shape, 1e-8)
        rng = np.random.default_rng(3)
        for _ in range(passes):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                scores = unary[x[part]].sum(axis=1)
                chance = np.exp(scores - scores.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                chance[np.arange(len(part)), y[part]] -= 1
                change = np.zeros_like(unary)
                np.add.at(change, x[part].ravel(), np.repeat(chance, x.shape[1], axis=0))
                change = change / len(part) + 1e-6 * unary
                squares += change**2
                unary -= rate * change / np.sqrt(squares)
    return Field(unary, association(chain), np.maximum(association(skip), 0) + same(SKIP_WEIGHT))


def same(weight: float) -> np.ndarray:
    return weight * np.eye(len(LABELS))


def association(counts: np.ndarray) -> np.ndarray:
    """Log of how much more often two labels meet than by chance, kept small."""
    share = counts / counts.sum()
    apart = share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)
    return np.clip(np.log(share / apart), -2, 2)


def skip_edges(nodes: Nodes) -> list[tuple[int, int]]:
    """Each node with the last one before it whose text is the same or similar.

    Linking neighbours in the list of repeats spreads a label over all of them and takes
    one edge a node, where all pairs would take the square.
    """
    seen: dict[str, int] = {}
    edges = []
    for i, token in enumerate(nodes.tokens):
        name = digits_of(token)
        if name in seen:
            edges.append((seen[name], i))
        seen[name] = i
    return edges


def marginals(field: Field, nodes: Nodes, evidence: np.ndarray) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product; `evidence` holds the base
    labels, which are fixed where they are not OTHER."""
    size = len(nodes.starts)
    local = field.unary[np.array(nodes.numbers)].sum(axis=1)
    known = np.flatnonzero(evidence != OTHER)
    local[known] = -30.0
    local[known, evidence[known]] = 30.0
    chain = [(i - 1, i) for i in range(1, size) if nodes.chained[i]]
    skips = skip_edges(nodes)
    edges = np.array([*chain, *skips], dtype=np.int64).reshape(-1, 2)
    tables = np.concatenate([
        np.repeat(field.chain[None], len(chain), axis=0),
        np.repeat(field.skip[None], len(skips), axis=0),
    ])
    sources = np.concatenate([edges[:, 0], edges[:, 1]])
    targets = np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    messages = np.zeros((len(sources), len(LABELS)))
    back = np.roll(np.arange(len(sources)), -len(edges))
    belief = local.copy()
    for _ in range(ROUNDS if len(edges) else 0):
        arriving = belief[sources] - messages[back]
        new = np.logaddexp.reduce(arriving[:, :, None] + tables, axis=1)
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        belief = local.copy()
        np.add.at(belief, targets, messages)
        if change < 1e-3:
            break
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def digit_count(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def plausible(kind: str, text: str) -> bool:
    """What a span added by the field must look like at least."""
    if kind == "email":
        return "@" in text.strip("@") and len(text) >= 5
    if kind == "ip":
        return text.count(".") >= 3 and digit_count(text) >= 4
    return digit_count(text) >= SPACED[kind][0] and not LETTER.search(text)


def joined(kind: str, text: str, places: list[tuple[int, int]]) -> Iterator[Span]:
    """Spans of a stretch of nodes with one label.

    The stretch is one span if it has no more digits than the kind allows. Else it holds
    several, each as soon as it has the digits the kind needs; what is left at the end
    belongs to the last one, so that no part of the stretch is lost.
    """
    least, most = SPACED[kind]
    whole = digit_count(text[places[0][0] : places[-1][1]])
    parts: list[list[int]] = []
    for start, end in places:
        if parts and (whole <= most or digit_count(text[slice(*parts[-1])]) < least):
            parts[-1][1] = end
        else:
            parts.append([start, end])
    if len(parts) > 1 and digit_count(text[slice(*parts[-1])]) < least:
        end = parts.pop()[1]
        parts[-1][1] = end
    for start, end in parts:
        # The sign in front was cut off with the other marks at the node's edge.
        inside = text[start:end]
        if inside.count(")") > inside.count("(") and text[start - 1 : start] == "(":
            start -= 1
        if plausible(kind, text[start:end]):
            yield Span(kind, start, end)


def find(field: Field, text: str) -> tuple[list[Span], list[Span]]:
    """(base spans by kind and start, spans added by the field)."""
    base = base_spans(text)
    nodes = nodes_of(text)
    if not nodes.starts:
        return base, []
    evidence = labels_of(nodes, base)
    if (evidence != OTHER).all():
        return base, []
    chances = marginals(field, nodes, evidence)
    best = chances.argmax(axis=1)
    added: list[Span] = []
    stretch: list[tuple[int, int]] = []
    last, label = -2, OTHER
    for i in np.flatnonzero((evidence == OTHER) & (best != OTHER)):
        if chances[i, best[i]] < SURE:
            continue
        kind, token = KINDS[best[i] - 1], nodes.tokens[i]
        start = text.index(token, nodes.starts[i])
        place = (start, start + len(token))
        if kind not in SPACED:
            if plausible(kind, token):
                added.append(Span(kind, *place))
            continue
        if LETTER.search(token):
            continue
        goes_on = (
            bool(stretch) and last == i - 1 and label == best[i] and nodes.chained[i]
            and JOINT.fullmatch(text, stretch[-1][1], start)
        )
        if stretch and not goes_on:
            added += joined(KINDS[label - 1], text, stretch)
            stretch = []
        stretch.append(place)
        last, label = i, best[i]
    if stretch:
        added += joined(KINDS[label - 1], text, stretch)
    return base, added


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def in_order(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def surroundings(text: str) -> str:
    """The nodes of a text with the words next to them, a line for each stretch."""
    out, last = [], -1
    for start, end in node_places(text):
        start, end = max(0, start - CONTEXT), end + CONTEXT
        if start <= last:
            out[-1] += text[last:end]
        else:
            out.append(text[start:end])
        last = end
    return "\n".join(out)


def field_from(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """Learns from at most `sample` documents with base spans and as many without, those
    with the smallest hash of their nodes' surroundings."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for x in map(surroundings, batch["text"]) if x]
            if not found:  # a frame without rows has no type for Arrow
                continue
            yield pd.DataFrame({"near": found, "based": [bool(base_spans(x)) for x in found]})

    rows = texts(docs).select("text").mapInPandas(cut, "near string, based boolean")
    rows = kept(spark, rows.withColumn("hash", F.xxhash64("near")), "surroundings")

    def take(based: bool) -> list[str]:
        part = rows.where(F.col("based") == based).select("hash").distinct()
        last = part.orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
        chosen = rows.where((F.col("based") == based) & (F.col("hash") <= F.lit(last)))
        return [r["near"] for r in chosen.select("hash", "near").distinct().orderBy("hash").collect()]

    return learn([*take(True), *take(False)])


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_added", T.LongType()),
    ]
)


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, their digest, all spans and how many of
    them the field added, for every row of `docs`.

    A NULL or empty text has no spans. Repeated rows get the same result; a NULL doc_id
    stays. If no document has a base span, the field adds none. Other columns are not
    read.
    """
    field = spark.sparkContext.broadcast(field_from(spark, docs))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, added = find(field.value, text)
                kinds = Counter(s.kind for s in base)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc_id, *(kinds[k] for k in KINDS), digest,
                             listed(in_order([*base, *added])), len(added)))
            yield pd.DataFrame(rows, columns=RESULT.names).astype({"doc_id": "Int64"})

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(scan, RESULT)


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans by the first's."""
    out, done = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            out += [text[done : span.start], f"<{span.kind.upper()}>"]
        done = max(done, span.end)
    return "".join([*out, text[done:]])


def without_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with personal data masked in `text`, all rows and columns kept.

    A column n_chars is set to the new length. A NULL text stays NULL.
    """
    field = spark.sparkContext.broadcast(field_from(spark, docs))

    @F.pandas_udf(T.StringType())
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda t: None if t is None else masked(t, sum(find(field.value, t), []))
            ).astype(object)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


