import numpy as np
import pytest

from tablecheck.llm import quality as Q

SF = "/root/testdata/sf0.01"


def area(good, bad):
    return (np.array(good)[:, None] > np.array(bad)[None]).mean()


def test_held_out_documents_are_ranked_right(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = Q.quality_scores(spark, docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert area(good, bad) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.8
    assert found.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn(
        "quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality"))
    )
    scores = [sorted(map(str, Q.quality_scores(spark, docs, x).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_pairs_recover_an_order():
    rng = np.random.default_rng(0)
    true = np.array([2.0, -1.0, 0.0])
    x = rng.normal(size=(600, 3))
    good = x @ true + rng.logistic(size=600) > 0
    ranker = Q.fit_ranker(x[good], x[~good])
    learnt = np.array(ranker.weights) / np.array(ranker.scale)
    assert np.corrcoef(learnt, true)[0, 1] > 0.98
    kept = (x[good] @ learnt - np.array(ranker.mean) @ learnt >= ranker.threshold).mean()
    assert kept > 0.75


@pytest.mark.parametrize("labelled", ["both", "good", "bad", "none"])
def test_odd_rows(spark, odd, none, labelled):
    rows = {"both": [(2, 0), (5, 1), (7, 1), (4, 0), (99, 1), (8, None), (8, 7), (None, 1)],
            "good": [(5, 1)], "bad": [(5, 0)], "none": []}[labelled]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    found = Q.quality_scores(spark, odd, labels).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    if labelled != "both":
        assert {r.predicted for r in found} == {0 if labelled == "bad" else 1}
    assert Q.quality_scores(spark, none, labels).collect() == []
    left = Q.good_documents(spark, odd, labels)
    assert left.columns == odd.columns
    assert left.count() == sum(r.predicted for r in found)


def test_all_labelled_rows_and_pairs_are_learnt_from(spark):
    """Tasks add up what one fit of all rows gives, and the last row tells like the first."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(25_000, 2))
    good = x @ [1.5, -1.0] + rng.logistic(size=len(x)) > 0
    rows = [(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(x, good))]
    frame = spark.createDataFrame(rows, "doc_id long, features array<double>, quality int").repartition(6)
    ranker = Q.learn(frame.drop("quality"), frame.drop("features"))
    used = np.array([r.doc_id for r in frame.where(~Q.held_out(frame.doc_id)).collect()])
    local = Q.fit_ranker(x[used][good[used]], x[used][~good[used]])
    assert np.allclose(ranker.mean, x[used].mean(axis=0)) and np.allclose(ranker.scale, x[used].std(axis=0))
    assert np.allclose(ranker.weights, local.weights) and np.isclose(ranker.threshold, local.threshold)


def test_fit_of_all_pairs_against_every_pair():
    rng = np.random.default_rng(6)
    g, b = rng.normal(0.7, 1, size=(60, 2)), rng.normal(0, 1, size=(80, 2))
    ranker = Q.fit_ranker(g, b)
    both = np.concatenate([g, b])
    d = ((g[:, None] - b[None]) / both.std(axis=0)).reshape(-1, 2)
    w = np.array(ranker.weights)
    gradient = d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + Q.RIDGE * w
    assert np.abs(gradient).max() < 1e-3
