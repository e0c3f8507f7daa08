"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A token sequence is the encoding of its text exactly if each pair of neighbours is the
encoding of the pair's text. So the encoding of every prefix has one last token, and what
matters of a prefix is finite: the pending suffixes that may still grow into a vocabulary
piece, each with the last token before it. Those are the states; a transition reads one
character and carries how many tokens the encoding gains (or loses).

Transitions are compiled when first needed and kept in a table of bounded size. A space
starts a new token whatever came before, so from there on a run no longer depends on the
state it began in. The map of a chunk of text from incoming states to (state, tokens) is
therefore: a head that waits for the incoming state, the tokens after it, and the state
at its end. Maps are associative and are composed by a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import texts

SPACE = "▁"
MAX_STATES = 200_000
MAX_WORDS = 200_000
CHUNK = 65_536


class Chunk(NamedTuple):
    """The state map of a chunk: `head` still runs from the incoming state; if there is
    a boundary after it, `tokens` were emitted from there and `tail` is what is open."""

    head: str
    bounded: bool
    tokens: int
    tail: str


class State:
    """A state with the transitions compiled so far."""

    __slots__ = ("key", "steps")

    def __init__(self, key: tuple):
        self.key = key
        self.steps: dict[str, tuple[State, int]] = {}


class Transducer:
    """Counts BPE tokens of normalised text, in which spaces are `SPACE`."""

    def __init__(self, ranks: dict[str, float], max_states: int = MAX_STATES):
        self.score = ranks
        self.max_states = max_states
        self.starts = {piece[:i] for piece in ranks for i in range(len(piece))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.proper: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state's key is a tuple of (pending suffix, last token before it, tokens more
        # than at that place); the empty suffix, for the present place, is the last.
        self.states: dict[tuple, State] = {}
        self.first = self.state((("", "", 0),))

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key)
        return found

    def merged(self, text: str) -> list[str]:
        """The plain merge loop, on the short strings of one or two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                range(len(parts) - 1),
                key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i),
            )
            pair = parts[best] + parts[best + 1]
            if pair not in self.score:
                break
            parts[best : best + 2] = [pair]
        return parts

    def follows(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            whole = [left, right] if left else [right]
            known = self.pairs[key] = self.merged(left + right) == whole
        return known

    def compile(self, state: State, char: str) -> tuple[State, int]:
        """(next state, tokens gained) after `char`."""
        if char not in self.score:  # falls back to bytes; nothing joins across it
            return self.first, len(char.encode("utf-8"))
        last, gained = None, 0
        for suffix, before, more in state.key:
            piece = suffix + char
            if piece in self.score and self.follows(before, piece):
                last, gained = piece, 1 - more
                break
        assert last is not None, "every text has one encoding"
        pending = [
            (suffix + char, before, more + gained)
            for suffix, before, more in state.key
            if suffix + char in self.starts
        ]
        return self.state((*pending, ("", last, 0))), gained

    def run(self, state: State, text: str) -> tuple[State, int]:
        if len(self.states) > self.max_states:
            self.reset()  # states in use live on and are compiled anew
        total = 0
        for char in text:
            step = state.steps.get(char)
            if step is None:
                step = state.steps[char] = self.compile(state, char)
            state, gained = step
            total += gained
        return state, total

    def count(self, text: str) -> int:
        return self.run(self.first, text)[1]


class Words(dict):
    """Transitions over whole words from a boundary, kept for the words met so far."""

    def __init__(self, transducer: Transducer, max_words: int = MAX_WORDS):
        super().__init__()
        self.transducer = transducer
        self.max_words = max_words

        self.bare: dict[str, int] = {}
        self.splits = "\n" not in transducer.score

    def __missing__(self, word: str) -> int:
        if self.splits and "\n" in word:  # a line end is a token that nothing joins
            first, *rest = word.split("\n")
            return self[first] + len(rest) + sum(map(self.within, rest))
        if len(self) >= self.max_words:
            self.clear()
        found = self[word] = self.transducer.count(SPACE + word)
        return found

    def within(self, word: str) -> int:
        """The tokens of a word that no space comes before."""
        found = self.bare.get(word)
        if found is None:
            if len(self.bare) >= self.max_words:
                self.bare.clear()
            found = self.bare[word] = self.transducer.count(word)
        return found


class Counter:
    """Counts the tokens of texts as the model's library does."""

    def __init__(self, ranks: dict[str, float], chunk: int = CHUNK):
        self.transducer = Transducer(ranks)
        self.words = Words(self.transducer)
        self.chunk = chunk

    def map_of(self, text: str) -> Chunk:
        """The state map of a chunk of text that is not normalised."""
        head, *words = text.split(" ")
        if not words:
            return Chunk(head, False, 0, "")
        # The run of spaces before a word belongs to it: it may hold pieces of its own,
        # and may have begun in the chunk before.
        tail = words.pop()
        if not tail or "" in words or SPACE in text:
            return self.map_with_runs(text)
        if not head:
            if not words:
                return Chunk(SPACE + tail, False, 0, "")
            head = SPACE + words.pop(0)
        return Chunk(head, True, sum(map(self.words.__getitem__, words)), SPACE + tail)

    def map_with_runs(self, text: str) -> Chunk:
        """The same where spaces stand next to each other or at the end."""
        text = text.replace(" ", SPACE)
        cuts = [i for i in range(1, len(text)) if text[i] == SPACE != text[i - 1]]
        if not cuts:
            return Chunk(text, False, 0, "")
        count = self.transducer.count
        inner = sum(count(text[a:b]) for a, b in zip(cuts, cuts[1:]))
        return Chunk(text[: cuts[0]], True, inner, text[cuts[-1] :])

    def joined(self, left: Chunk, right: Chunk) -> Chunk:
        """The map of the two chunks' text: `right` goes on in the state left open.

        If a chunk begins with a space, what is open before it is closed, unless that
        ends with a space itself.
        """
        head = right.head
        if not left.bounded:
            return self.opened(left.head + head, right)
        open_text = left.tail + head
        whole = self.map_with_runs(open_text) if head else Chunk(open_text, False, 0, "")
        if whole.bounded:
            count, rest = self.transducer.count(whole.head) + whole.tokens, whole.tail
        else:
            count, rest = 0, whole.head
        if right.bounded:
            count, rest = count + self.transducer.count(rest) + right.tokens, right.tail
        return Chunk(left.head, True, left.tokens + count, rest)

    def opened(self, head: str, right: Chunk) -> Chunk:
        first = self.map_with_runs(head)
        if not first.bounded:
            return Chunk(head, right.bounded, right.tokens, right.tail)
        if not right.bounded:
            return first
        inner = first.tokens + self.transducer.count(first.tail) + right.tokens
        return Chunk(first.head, True, inner, right.tail)

    def scanned(self, maps: Sequence[Chunk]) -> list[Chunk]:
        """Inclusive prefix scan: entry i is the map of chunks 0 to i."""
        out = list(maps)
        step = 1
        while step < len(out):
            out = [
                self.joined(out[i - step], out[i]) if i >= step else out[i]
                for i in range(len(out))
            ]
            step *= 2
        return out

    def total(self, maps: Sequence[Chunk]) -> Chunk:
        """The last entry of the scan, by its up-sweep alone."""
        out = list(maps)
        while len(out) > 1:
            pairs = [self.joined(a, b) for a, b in zip(out[::2], out[1::2])]
            out = pairs + out[len(out) - len(out) % 2 :]
        return out[0]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        # The library puts a space before every text.
        text = " " + text
        size = self.chunk
        parts = [self.map_of(text[i : i + size]) for i in range(0, len(text), size)]
        whole = self.total(parts)
        count = self.transducer.count
        return count(whole.head.replace(" ", SPACE)) + whole.tokens + count(whole.tail)


def bpe_ranks(model_path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece BPE model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    if not any(map(model.is_byte, ids)):
        raise ValueError("the model has no byte fallback")
    ranks = {
        model.id_to_piece(i): model.get_score(i)
        for i in ids
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    if any(SPACE in piece.lstrip(SPACE) for piece in ranks):
        raise ValueError("a piece goes on after a space, so spaces are no boundaries")
    if model.encode("  ﬁ  ", out_type=str)[-1].strip(SPACE) or "ﬁ" not in ranks | {"ﬁ": 0}:
        raise ValueError("the model changes its input")
    return ranks


_COUNTERS: dict[str, Counter] = {}


def counter(model_path: str) -> Counter:
    """One counter for each Python worker; the file is read where it is used."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = Counter(bpe_ranks(model_path))
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of `docs`.

    A NULL or empty text has no bytes and no tokens. Rows are counted one by one:
    repeated rows give repeated results, a NULL doc_id stays. Other columns are not read.
    The counts are those of the model's library without begin, end or special tokens.
    """

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model_path).count
        for batch in batches:
            yield batch.map(count, na_action=None).astype("int64")

    tokens = F.pandas_udf(counted, T.LongType())
    return (
        texts(docs)
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                tokens("text").alias("n_tokens"))
        .select("*", (F.col("n_tokens") > limit).alias("over_limit"))
    )
