"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat, exact_dedup, langid, mixing, neardup, ngram_join, periodic, quality, sharding, token_counts, toxicity, whitening
from paperloom.llm.common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: A user's and an assistant's turn that say what a template might say.
ODD_TEXT = r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    return chat.read_back(chat.format_events(chat.turns_as_events(table.unionByName(odd))))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85, width=3)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("host_rate")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_chat, op3_neardup, op4_sharding, op5_token_counts, op6_bpe, op7_quality, op8_exact_dedup, op9_language, op10_toxicity, op11_whitening, op12_ngram_join, op13_periodic_runs)}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), g AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
                sum(length('<turn >' || chr(10) || '</turn>' || chr(10)) + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\e'), '<', '\l'))) AS chars
            FROM c GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
    """,
    "op7_quality": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        t AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t),
        p AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE n > 1) GROUP BY r),
        m AS (
            SELECT doc_id, source, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM w LEFT JOIN p USING (r)
        ), f AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols >= n_words OR 3 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS fails
            FROM m
        ), h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (fails) AS DOUBLE) AS bad FROM f GROUP BY source),
        s AS (SELECT sum(n) AS n, (sum(bad) + 0.5) / (sum(n) + 1) AS mean, sum(bad) AS bad, count(*) AS k, sum(bad * bad / n) AS q FROM h),
        v AS (SELECT *, greatest(0, (q - bad * bad / n) / n - mean * (1 - mean) * (k - 1) / n) AS spread FROM s),
        a AS (SELECT mean, CASE WHEN spread > 0 THEN least(n, greatest(1, mean * (1 - mean) / spread - 1)) ELSE n END AS strength FROM v),
        j AS (SELECT source, (bad + mean * strength) / (n + strength) > 0.6 AS rejected FROM h, a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
        FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
    """,
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)
    """,
}
