"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import conversation_repair, conversation_sql, conversation_trie, decontaminate, exact_dedup, fingerprints, jaccard, mixing, pii, repeats, secrets, sharding, token_output, toxicity
from leadloom.llm.common import conversations, documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(documents(spark, sf_dir), special=True)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(documents(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.mark_repeats(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_prefixes(conversations(spark, sf_dir)).drop("prefix")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversations(spark, sf_dir))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_token_output": op4_token_output,
    "op5_sharding": op5_sharding,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_repeats": op7_repeats,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_source_mixing": op10_source_mixing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS kept,
       text_sha256
FROM t
""",
    "op10_source_mixing": """
WITH c AS (
  SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1
), r AS (
  SELECT s, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c
), k AS (
  SELECT s, rate, unnest(range(0, 1 + CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM r
), p AS (
  SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM k
), cdf AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p
), d AS (
  SELECT *, coalesce(source, '') AS s,
         (('0x' || substr(md5(concat_ws('/', '17', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents
), n AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
         any_value(d.n_chars) AS n_chars, count(*)::INTEGER AS n_copies
  FROM d JOIN cdf ON cdf.s = d.s AND cdf.cdf <= d.u GROUP BY d.doc_id
), e AS (
  SELECT *, unnest(range(0, n_copies))::INTEGER AS copy_no FROM n
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy_no,
       md5(concat_ws('/', '17', coalesce(doc_id::VARCHAR, 'null'), copy_no::VARCHAR)) AS mix_key
FROM e
""",
    "op11_conversation_trie": conversation_sql.TRIE,
    "op12_conversation_repair": conversation_sql.REPAIR,
}
