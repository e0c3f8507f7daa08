import hashlib
import random
import re
import zlib

import pytest

from tablecheck.llm import periodic


def brute(words):
    """Every lag, word by word: (start, length, period) by start, then period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def found(word_lists):
    return [[tuple(r) for r in runs.tolist()] for runs in periodic.runs_of(word_lists)]


def power(rng, letters, root_length, total):
    root = [rng.choice(letters) for _ in range(root_length)]
    return [root[i % root_length] for i in range(total)]


def noisy(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice([b"x", b"y", b"a"])
    return words


def made(seed):
    """Texts of a few letters, with powers inside powers, so that runs of all scales meet."""
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice(letters) for _ in range(rng.randint(0, 400))]
    if kind == 1:
        return noisy(rng, power(rng, letters, rng.randint(1, 150), rng.randint(130, 700)), rng.randint(0, 2))
    if kind == 2:  # long roots made of short powers
        root = []
        for _ in range(rng.randint(1, 5)):
            root += power(rng, letters, rng.randint(1, 8), rng.randint(8, 90))
        total = int(len(root) * rng.uniform(2, 3.4))
        return noisy(rng, [root[i % len(root)] for i in range(total)], rng.randint(0, 1))
    if kind == 3:  # two powers of rotations of one root touch
        root = power(rng, letters, rng.randint(1, 9), rng.randint(2, 9))
        cut = rng.randrange(len(root))
        left, right = rng.randint(60, 300), rng.randint(60, 300)
        one = [root[i % len(root)] for i in range(left)]
        return one + [root[(i + cut) % len(root)] for i in range(right)]
    if kind == 4:
        a, b = b"a", b"b"
        for _ in range(rng.randint(5, 12)):
            a, b = (a + b" " + b, a) if rng.random() < 0.8 else (a + b" " + a + b" " + b, a)
        return a.split()[:600]
    words = []
    for _ in range(rng.randint(1, 4)):
        words += made(rng.random())[:250]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_made_texts(seed):
    texts = [made(seed * 1000 + k) for k in range(6)]
    assert found(texts) == [brute(t) for t in texts]


def test_long_periods():
    rng = random.Random(5)
    words = [str(rng.randrange(3000)).encode() for _ in range(20_000)]
    text = words[:700] + words[1000:7000] * 3 + words[:13]
    runs = found([text])[0]
    assert (700, 18_000, 6000) in [(s, n, q) for s, n, q in runs]


def test_many_nested_runs_where_two_touch():
    text = [b"a", b"b"] * 250 + [b"b", b"a"] * 250
    assert found([text]) == [brute(text)]


def test_collapsed_text():
    words = b"p q r p q r p q r p q r s t".split()
    runs = periodic.runs_of([words])[0]
    assert [tuple(r) for r in runs.tolist()] == [(0, 12, 3)]
    assert periodic.collapsed(words, runs) == "p q r s t"


def expected(doc_id, text):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (
        doc_id, len(runs), *best, milli,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(),
    )


def digests(docs):
    return periodic.run_digests(periodic.periodic_runs(docs, periodic.planted))


def test_whole_table(spark, docs):
    short = docs.where("length(text) < 6000")
    got = digests(short)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        "collapsed_sha256",
    ]
    assert {c: t for c, t in got.dtypes if c.endswith("sha256")} == {
        "runs_sha256": "string", "collapsed_sha256": "string",
    }
    wanted = sorted(expected(r.doc_id, r.text) for r in short.collect())
    assert sorted(tuple(r) for r in got.collect()) == wanted
    assert any(r[4] and r[4] >= periodic.DIRECT for r in wanted), "long periods are met"


def test_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in digests(odd).collect()), key=str)
    rows = odd.where("length(text) < 20000 OR text IS NULL").collect()
    for r in rows:
        assert expected(r.doc_id, r.text) in got
    assert len(got) == odd.count()
    assert digests(none).collect() == []


def test_chunks_give_the_same_runs(spark, docs, monkeypatch):
    whole = sorted(tuple(r) for r in digests(docs).collect())
    monkeypatch.setattr(periodic, "CHUNK_BYTES", 1)
    texts = [split(r.text) for r in docs.collect()]
    each = [found([t])[0] for t in texts[:40]]
    assert found(texts[:40]) == each
    assert sorted(tuple(r) for r in digests(docs.repartition(13)).collect()) == whole
