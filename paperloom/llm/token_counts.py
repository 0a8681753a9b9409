"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; everything asked about lengths is then answered from
the histogram, whose rows are bounded by the number of distinct lengths: totals, quantiles, and the
tokens that remain if every document is cut at a context limit (a suffix sum).

Suffix sums are taken in two steps, over blocks of lengths and within each block, so that no task
holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.bpe import count_tokens
from paperloom.llm.common import Scratch

BLOCK = 2048


def length_histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """length, n_docs: exact. Null lengths count as 0."""
    return counts.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs: n_docs, n_tokens, docs_at_most, docs_longer, tokens_longer, truncated_tokens.

    docs_longer and tokens_longer cover documents above the length; truncated_tokens is the total if
    the length were the context limit: the tokens of those within it, plus the limit for each longer one.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("block"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    offsets = sums.select("block", zero(F.sum("d").over(above)).alias("d_above"), zero(F.sum("t").over(above)).alias("t_above"), zero(F.sum("d").over(below)).alias("d_below"), zero(F.sum("t").over(below)).alias("t_below"))
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(offsets, "block")
    docs_longer = F.col("d_above") + zero(F.sum("n_docs").over(longer))
    tokens_upto = F.col("t_below") + F.sum("n_tokens").over(upto)
    return out.select(
        "length", "n_docs", "n_tokens",
        (F.col("d_below") + F.sum("n_docs").over(upto)).alias("docs_at_most"),
        docs_longer.alias("docs_longer"),
        (F.col("t_above") + zero(F.sum("n_tokens").over(longer))).alias("tokens_longer"),
        (tokens_upto + docs_longer * F.col("length")).alias("truncated_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: limit, total_tokens if every document is cut at `limit`, for any limit, also one between lengths."""
    at = F.max(F.when(F.col("length") <= limit, F.struct("length", "truncated_tokens", "docs_longer")))
    docs = F.coalesce(F.sum("n_docs"), F.lit(0))
    total = F.when(at.isNull(), docs * limit).otherwise(at["truncated_tokens"] + at["docs_longer"] * (limit - at["length"]))
    return sums.agg(F.lit(limit).cast("long").alias("limit"), total.cast("long").alias("total_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: q, length: the smallest length with at least a share q of documents at or below it; null if there are none."""
    enough = F.col("docs_at_most") >= F.ceil(F.lit(q) * (F.col("docs_at_most") + F.col("docs_longer")))
    return sums.agg(F.lit(q).alias("q"), F.min(F.when(enough, F.col("length"))).alias("length"))


def token_histogram(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """suffix_sums over the encoded length of every whole text.

    Null and empty texts have length 0; long ones are encoded whole. Rows count one by one, repeated ids
    and texts too. An empty table gives an empty result. Columns but doc_id and text are never looked
    at. The histogram is saved, as two branches read it: each text is encoded once.
    """
    return suffix_sums(Scratch(docs.sparkSession, "token-counts").save(length_histogram(count_tokens(docs, ranks))))
