import hashlib
import random
import re

import numpy as np
import pytest

from tablecheck.llm import pii as P

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if fits(kind, m[0])
    ]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "x.y", "@", ".", "-", " ", "+1", "(499) ", "555", "10.2.3.4", "300.1.1.1", "1.2.3",
             "4111 1111 1111 1111", "0", "é", "\n", "%", "6011000990139424", "+49 30 123456", "b@c"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert [tuple(s) for s in P.base_spans(text)] == plain(text), repr(text)


def agrees(spark, docs):
    rows = P.personal_data(spark, docs).collect()
    assert len(rows) == docs.count()

    def row(doc_id, spans):
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in P.KINDS]
        return str((doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest()))

    want = sorted(row(r.doc_id, plain(r.text)) for r in docs.collect())
    assert sorted(
        str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in rows
    ) == want
    return rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = agrees(spark, docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id])).split(",")) <= set(
            r.spans.split(",")
        )
    clean = [r for r in rows if not re.search("[0-9@]", texts[r.doc_id])]
    assert clean and not any(r.spans for r in clean)


def test_odd_rows(spark, odd, none):
    agrees(spark, odd)
    assert P.personal_data(spark, none).collect() == []
    masked = P.without_personal_data(spark, odd)
    assert masked.columns == odd.columns
    rows = {r.doc_id: r.text for r in masked.collect()}
    assert rows[1] is None and rows[2] == "" and rows[None] == "mail <EMAIL> now"


def test_a_sure_label_reaches_distant_repeats():
    prose = "some plain words between them " * 20
    train = [f"{prose} write to ann{i}@mail.org soon {prose} room {i} here" for i in range(200)]
    field = P.learn(train)
    text = f"write to zed9@mail.org now {prose} see zed9@mail again {prose} or zed9@mail there"
    nodes = P.nodes_of(text)
    evidence = P.labels_of(nodes, P.base_spans(text))
    assert evidence.tolist() == [1, 0, 0]
    joint = P.marginals(field, nodes, evidence)[:, 1]
    alone = P.marginals(
        P.Field(field.unary, field.chain, np.zeros_like(field.skip)), nodes, evidence
    )[:, 1]
    # The two that repeat each other agree, whatever their surroundings say.
    assert abs(joint[1] - joint[2]) <= abs(alone[1] - alone[2]) + 1e-6
    assert joint[1] >= alone[1] and joint[2] >= alone[2]


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.2." * 50_000, "x@" * 50_000, "+1 " * 50_000):
        assert P.base_spans(text) is not None
        P.nodes_of(text)


def test_overlapping_spans_are_masked_once():
    spans = [P.Span("email", 2, 9), P.Span("ip", 4, 12), P.Span("card", 14, 15)]
    assert P.masked("ab1234567890cd9e", spans) == "ab<EMAIL>cd<CARD>e"


def numbered(rng):
    """A phone number and a card, both with spaces."""
    card = "".join(rng.choices("0123456789", k=15))
    card += next(c for c in "0123456789" if luhn(card + c))
    phone = f"(0{rng.randint(10, 99)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    return phone, " ".join(card[i : i + 4] for i in range(0, 16, 4))


def test_repeats_of_several_nodes_are_added_whole():
    rng = random.Random(1)
    prose = "some plain words between them " * 20
    train = []
    for _ in range(200):
        phone, card = numbered(rng)
        train.append(f"{prose} call +1 {phone} now {prose} pay {card} today {prose} room {rng.randint(1, 99)}")
    field = P.learn(train)

    def added(text):
        base, more = P.find(field, text)
        return len(base), [(s.kind, text[s.start : s.end]) for s in more]

    assert added(f"call +1 (017) 555-7713 now {prose} call (017) 555-7713 now") == (
        1, [("phone", "(017) 555-7713")])
    assert added(f"pay 4111 1111 1111 1111 today {prose} pay 4111 1111 1111 1112 today") == (
        1, [("card", "4111 1111 1111 1112")])
    assert added(f"pay 4111 1111 1111 1111 today {prose} pay 4111  1111  1111  1111 today") == (
        1, [("card", "4111  1111  1111  1111")])


def test_no_part_of_a_labelled_stretch_is_lost():
    def spans(kind, text):
        places = [m.span() for m in re.finditer("[0-9-]+", text)]
        return [text[s.start : s.end] for s in P.joined(kind, text, places)]

    assert spans("phone", "(017) 555-7713") == ["(017) 555-7713"]
    assert spans("phone", "017 555-7713 018 555-7714") == ["017 555-7713", "018 555-7714"]
    assert spans("phone", "49 30 123456 78 49 30 123456 78") == ["49 30 123456", "78 49 30 123456 78"]
    assert spans("card", "4111 1111 1111 1111 4111 1111 1111 1111") == ["4111 1111 1111 1111"] * 2
    assert spans("phone", "017 555") == []


@pytest.mark.parametrize("parts", [1, 211])
def test_prose_without_any_node(spark, parts):
    """No text has a digit or an at sign, so no batch has anything to learn from."""
    docs = spark.range(40).selectExpr("id AS doc_id", "'only plain words here' AS text")
    found = P.personal_data(spark, docs.repartition(parts)).collect()
    assert len(found) == 40 and all(r.spans == "" for r in found)
    masked = P.without_personal_data(spark, docs.repartition(parts))
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, docs.collect()))
