"""A corpus from raw documents to token files: one operator of leadloom.llm in each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import decontaminate, jaccard, mixing, token_output, toxicity
from leadloom.llm.common import documents
from leadloom.shared import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, finds toxic go.

    Null and empty texts are scored as texts without terms, very long ones whole; rows with a null or repeated id are each
    scored by their own text. Without labels nothing is toxic; an id with both labels counts as toxic. An empty table stays
    empty. Columns pass as they are, whatever they are called.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of links connect (80 of 100 five-word shingles shared), the smallest doc_id stays.

    Documents without words, null texts among them, and rows with a null id stay. A repeated id is one document, of which
    one row stays: that with the least hash of its columns. Ties can't arise between different ids. An empty table stays
    empty; columns pass as they are.
    """
    return jaccard.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go.

    Null and empty texts have no words and stay; whole texts are searched. Rows with null or repeated ids are each judged by
    their own text; items with a null item_id count, null or empty items match nothing. Columns pass as they are.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources have the weights wanted, shuffled globally.

    A null source is one of its own. Rows with one id, and those with a null id, have the same draw. Columns pass as they
    are; those that the operator adds aren't kept. An empty table stays empty.
    """
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, written, read again and summed up.

    Ascending by doc_id, null first; copies and other rows of one id stand side by side, by a hash of the text. Null texts
    have the end id alone. An empty table gives an empty result.
    """
    return token_output.round_trip(docs, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token-ID output", write_token_files),
]

#: SQL can't express the first stage, a fitted model, nor the last, a tokenizer; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's is written as Parquet and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
