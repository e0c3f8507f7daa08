import hashlib
import re

from tablecheck.llm import decontamination as D

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(text, items):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        x = words(item)
        n = min(10, len(x))
        wanted = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit)


def agrees(spark, docs, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.item_id is not None]
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted(str((i, *expected(t, items))) for i, t in texts)
    rows = D.contamination(docs, benchmark).collect()
    got = sorted({str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
                  for r in rows})
    assert got == want
    assert len(rows) == docs.count()


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    agrees(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_odd_rows_and_short_items(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "two"), (2, "One, TWO three!"), (3, None), (4, ""), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"),
         (6, "字"), (5, "mail a b c org now"), (7, "two"), (None, "漢字")],
        "item_id long, text string",
    )
    agrees(spark, odd, items.where("item_id IS NOT NULL"))
    assert D.contamination(none, items).collect() == []
    empty = D.contamination(odd, items.limit(0)).collect()
    assert len(empty) == odd.count() and not any(r.contaminated for r in empty)


def test_overlapping_windows_make_one_span(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y a b")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d e f g h i j k"), (8, "a b")], "item_id long, text string")
    row = D.contamination(docs, items).first()
    assert (row.spans, row.n_hit, row.n_items) == ("1-12,13-15", 13, 2)


def test_the_join_by_shuffle_finds_the_same(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(str, D.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, D.contamination(docs, benchmark).collect())) == whole


def test_only_contaminated_documents_go_and_columns_stay(spark, odd):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    left = D.without_contaminated(odd, items)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]


def test_windows_are_looked_up_once(spark, monkeypatch):
    """The rows found are written; what follows only counts the documents' words again."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "c d e f g h i j k l")], "item_id string, text string")
    looked = []
    kept = D.kept
    monkeypatch.setattr(D, "kept", lambda s, frame, name: looked.append(name) or kept(s, frame, name))
    found = D.contamination(docs, items)
    assert looked == ["windows-found"] and found.first().n_hit == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("getbit") == 0
