"""The corpus pipeline, stage by stage, against what each operator says of its input."""

import public_tokenizers

import __spark_entry__ as registered
import corpus_pipeline
from tablecheck.llm import decontamination, jaccard, pii, quality

from .test_packing import check

SF = "/root/testdata/sf0.01"


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(after) == ids(quality.quality_scores(spark, before, labels).where("predicted = 1"))
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(jaccard.jaccard_components(spark, before).where("doc_id = component_id"))
    before, after = seen["decontamination"]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(after) == ids(decontamination.contamination(before, benchmark).where("NOT contaminated"))
    before, after = seen["personal_data"]
    assert ids(after) == ids(before)
    for r in after.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    before, after = seen["packing"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    check(after.collect(), {r.doc_id: r.text for r in before.collect()}, 2048, Tokenizer.from_file(path))

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in whole) == sorted(r.doc_id for r in after.collect())


def test_every_operator_has_its_query():
    names = registered.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
