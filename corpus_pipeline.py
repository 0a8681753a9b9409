"""A corpus pipeline in stages: toxic documents go, then copies, then near copies; the rest is mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the
last returns the tokens. Rows are told apart by id and text, so that repeated and missing ids lose
nothing; extra columns are carried along, whatever their names. An empty table gives an empty one of
the same columns. ORACLE_SQL is None: SQL can't express these stages; the tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, exact_dedup, mixing, neardup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below the threshold, learnt from docs and labels; a null text is scored as empty, a long one whole. Repeated rows all stay or all go."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (lower-cased A-Z; null is the empty text): that of the largest doc_id, one without an id only if no other has the text."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 80% of their five-word shingles: that of the smallest doc_id. Texts without words all stay, one row for each id and text."""
    return neardup.kept_documents(docs, percent=80, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times; a null source is a source. Rows without words stay once."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, decoded_sha256 (of what the ids decode to): one row per row; null texts have no ids."""
    return bpe.tokenized(docs, keep=("doc_id", "source", "lang"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
