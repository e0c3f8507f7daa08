"""The registered queries of the text operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    decontamination,
    divergence,
    jaccard,
    lexical,
    licenses,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    suffixtree,
    tokencount,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The vocabularies and limits that the queries are defined with.
PACK_TOKENIZER = "byte_bpe_50k.json"
COUNT_MODEL = "piece_bpe_32k.model"


ROOT = str(Path(__file__).resolve().parents[2])


def query(function: Query) -> Query:
    """Registers a query; its Python workers find this package also if only the driver's
    path has it."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, table(spark, sf_dir, "documents"))


ORACLE["op1_license_scan"] = licenses.oracle_sql()


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(spark, table(spark, sf_dir, "documents"))


@query
def op4_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(spark, table(spark, sf_dir, "documents"))


@query
def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


ORACLE["op5_perspective_rotation"] = chat.ORACLE_SQL


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(spark, docs, public_tokenizers.path(PACK_TOKENIZER), capacity=2048)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(spark, table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokencount.token_counts(docs, public_tokenizers.path(COUNT_MODEL), limit=4096)


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), limit=20
    )


ORACLE["op11_lexical_search"] = lexical.ORACLE_SQL


@query
def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scored(spark, table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.run_digests(periodic.periodic_runs(docs, periodic.planted))


ORACLE["op10_benchmark_decontamination"] = r"""
WITH word_lists AS (
    SELECT 'doc' AS side, doc_id AS id, text FROM documents
    UNION ALL SELECT 'item', item_id, text FROM benchmark
), split AS (
    SELECT side, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM word_lists
), item_windows AS (
    SELECT DISTINCT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (
        SELECT id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM split WHERE side = 'item' AND len(w) > 0
    )
), sizes AS (
    SELECT DISTINCT n FROM item_windows
), places AS (
    SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM split CROSS JOIN sizes WHERE side = 'doc' AND len(w) >= n
), hits AS (
    SELECT p.id, p.i, p.n, p.win
    FROM (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p
    WHERE (p.n, p.win) IN (SELECT (n, win) FROM item_windows)
), hit_words AS (
    SELECT id, count(DISTINCT p) AS n_hit
    FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id
), hit_items AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (
        SELECT DISTINCT h.id, CAST(w.item_id AS VARCHAR) AS item
        FROM hits h JOIN item_windows w ON h.n = w.n AND h.win = w.win
    ) GROUP BY id
), ends AS (
    SELECT id, i, i + n - 1 AS last, max(i + n - 1) OVER (
        PARTITION BY id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT DISTINCT id, i, n FROM hits)
), runs AS (
    SELECT *, sum(CASE WHEN before IS NULL OR i > before + 1 THEN 1 ELSE 0 END) OVER (
        PARTITION BY id ORDER BY i, last) AS run FROM ends
), ranges AS (
    SELECT id, string_agg((first - 1) || '-' || last, ',' ORDER BY first) AS spans
    FROM (SELECT id, run, min(i) AS first, max(last) AS last FROM runs GROUP BY id, run)
    GROUP BY id
)
SELECT s.id AS doc_id, CAST(len(s.w) AS BIGINT) AS n_words,
       coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
       sha256(coalesce(x.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(r.spans, '') AS spans
FROM split s LEFT JOIN hit_words h ON s.id = h.id LEFT JOIN hit_items x ON s.id = x.id
LEFT JOIN ranges r ON s.id = r.id
WHERE s.side = 'doc'
"""
