import pytest

from tablecheck.llm import chat, licenses as L

MIT = next(text for name, text in L.KNOWN if name == "MIT" and "Permission" in text)


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.license_scan(spark, docs).collect()}


def test_a_licence_is_known_however_it_is_set(spark):
    flowed = " ".join(MIT.split("\n")[2:])
    variants = [
        MIT,
        MIT.upper(),
        MIT.replace("\n", "\n\n   * "),
        MIT.replace("<year> <copyright holders>", "2019, 2021 Ann Example <ann@example.com>"),
        "Copyright © 2020 A. Body\nAll rights reserved.\n" + "MIT Licence\n" + flowed,
        MIT.replace("sublicense", "sublicence").replace('"', "''"),
    ]
    rows = scan(spark, [*variants, MIT + " but no warranty", MIT.replace("free of charge", "for a fee")])
    assert [rows[i].license_id for i in range(8)] == ["MIT"] * 6 + [None, None]


def test_notices_stand_on_their_own_line(spark):
    rows = scan(spark, ["prose\nreleased under the MIT licence!\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
                        "it is not Released under the MIT License. at all", "# SPDX-License-Identifier: MIT"])
    assert (rows[0].notices, rows[0].n_notices) == ("CC-BY-NC-4.0,MIT", 3)
    assert rows[1].notices == "" and rows[2].license_id == "MIT"


def test_whole_licences_and_spdx_lines_are_known(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0",
             "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    bodies = [(L.FOLDER / f"{name}.txt").read_text() for name in names]
    cut = bodies[5][: bodies[5].index("END OF TERMS")]
    bsd = "Copyright (c) 2020, Ann\n" + bodies[1].split("\n", 1)[1].replace("1. ", "* ").replace("2. ", "* ")
    lines = [f"SPDX-License-Identifier: {x}" for x in ("LGPL-2.1-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "GPL-2.0+")]
    rows = scan(spark, [*bodies, cut, bsd, *lines])
    assert [rows[i].license_id for i in range(len(rows))] == [
        *names, "GPL-3.0", "BSD-2-Clause", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "ISC", "GPL-2.0"]


def test_odd_rows_and_own_registry(spark, odd, none):
    known = spark.createDataFrame([("three", "One, two: three"), ("also", "one two three"), ("no", None)],
                                  "license_id string, text string")
    rows = L.license_scan(spark, odd, known).collect()
    assert len(rows) == 10
    assert {r.license_id for r in rows if r.doc_id == 4} == {"also"}
    assert {r.digest for r in rows if r.doc_id in (1, 2, 3)} == {None}
    assert L.license_scan(spark, none).collect() == []
    assert L.license_scan(spark, odd, known.limit(0)).count() == 10


SCHEMA = "conv_id long, turn long, role string, text string, speaker int, mask int"


def parts(row):
    if not row.mask:
        return []
    return [row.rendered[int(a) : int(b)] for a, b in (x.split(":") for x in row.mask.split(","))]


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 2, "bob", "é\U0001f600!", 0, 0), (1, 0, "system", "be kind", 0, 0),
            (1, 1, "ann", "hi", 0, 0), (1, 3, "cy", "", 0, 0), (1, 4, "ann", "bye", 0, 0)]
    found = {r.speaker: r for r in chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {"ann", "bob", "cy"}
    assert parts(found["ann"]) == ["hi<|end|>\n", "bye<|end|>\n"]
    assert parts(found["bob"]) == ["é\U0001f600!<|end|>\n"]
    assert found["bob"].rendered == (
        "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\né\U0001f600!<|end|>\n"
        "<|user name=cy|>\n<|end|>\n<|user name=ann|>\nbye<|end|>\n"
    )


def test_odd_turns(spark):
    rows = [(1, None, None, None, 0, 0), (1, 0, "a", "x", 0, 0), (1, 0, "a", "x", 0, 0),
            (2, 0, "system", "alone", 0, 0), (None, 5, "b", "y", 0, 0), (3, 1, "c", "z" * 100_000, 0, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {(r.conv_id, r.speaker): r for r in chat.perspectives(frame).collect()}
    assert set(found) == {(1, "unknown"), (1, "a"), (None, "b"), (3, "c")}
    assert parts(found[1, "a"]) == ["x<|end|>\n"] * 2 and found[1, "a"].n_turns == 3
    assert chat.perspectives(frame.limit(0)).collect() == []


@pytest.mark.parametrize("turns", [255, 256, 700])
def test_long_conversations_go_on_in_blocks(spark, turns):
    frame = spark.range(turns).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "cast(id AS string) AS text")
    found = [r for r in chat.perspectives(frame).collect() if r.speaker == "a"]
    assert sorted(r.block for r in found) == list(range(-(-turns // 256)))
    assert sum(r.n_turns for r in found) == turns
    assert sum(r.n_targets for r in found) == -(-turns // 2)


def test_many_rows_without_conversation_and_turn(spark):
    """A third of all rows, alike but for a few, have neither; no row gathers more than a
    block of them, and places are exact."""
    frame = spark.range(60_000).selectExpr(
        "CAST(IF(id % 3 = 0, NULL, id % 500) AS LONG) AS conv_id",
        "CAST(IF(id % 3 = 0, NULL, id) AS LONG) AS turn",
        "IF(id % 2 = 0, 'a', 'b') AS role", "IF(id % 3000 = 0, CAST(id AS STRING), 'same') AS text",
    ).repartition(7)
    found = chat.perspectives(frame).where("conv_id IS NULL AND speaker = 'a'").collect()
    assert sorted(r.block for r in found) == list(range(-(-20_000 // 256)))
    assert max(r.n_turns for r in found) == 256 and sum(r.n_turns for r in found) == 20_000
    assert sum(r.n_targets for r in found) == 10_000
    said = "".join(r.rendered for r in sorted(found, key=lambda r: r.block))
    assert said.count("<|assistant|>") == 10_000 and said.index("<|user name=b|>") > said.rindex("<|assistant|>")


def test_copies_of_speakers_lose_no_block(spark, monkeypatch):
    monkeypatch.setattr(chat, "SHARE_BLOCKS", 2)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    frame = spark.range(90).selectExpr("id % 2 AS conv_id", "id AS turn", "concat('r', id % 3) AS role", "'x' AS text")
    found = chat.perspectives(frame).collect()
    assert len(found) == 2 * 12 * 3
    assert sum(r.n_targets for r in found) == 90
