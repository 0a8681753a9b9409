"""Quality rules with verdicts by host (native).

Each document is measured by rules. Failures are added up by host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to the hosts (method of moments), and hosts whose
shrunk rate passes the limit are rejected: all of their documents go, as do documents that fail a
base rule themselves. Small hosts stay near the corpus rate, so a host falls only on evidence.

Measures are computed within each row by built-in functions; nothing is shuffled but one count for
each host and task. Repeated 3-word windows are found by sorting a text's own window hashes (64 bits,
compared within one text only), n log n in the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import GAPS, Scratch, rows_of

SYMBOLS = "#*$%&|<>"
#: A host goes if its shrunk failure rate is above this.
HOST_LIMIT = 0.6


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; null text has no words."""
    base = rows_of(docs, id_col, host_col, text_col).toDF("doc_id", "host", "text").withColumn("text", F.coalesce("text", F.lit("")))
    flat: Column = F.col("text")
    for c in GAPS:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    a = base.select("doc_id", "host", F.split("text", "\n").alias("raw_lines"), flat.alias("flat"))
    b = a.select(
        "doc_id", "host", F.filter(F.split("flat", " "), lambda w: w != "").alias("w"),
        F.filter("raw_lines", lambda x: F.trim(x, F.lit(" " + GAPS)) != "").alias("lines"),
        F.replace("flat", F.lit(" "), F.lit("")).alias("solid"),
    )
    c = b.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), F.char_length("solid").cast("long").alias("word_chars"),
        (F.char_length("solid") - F.char_length(_without(F.col("solid"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))).alias("h"),
    )
    kept = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    d = c.select(*kept, F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    again = lambda x, k: (x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"])
    e = d.select(*kept, F.size("s").alias("n_s"), F.sort_array(F.transform(F.filter("s", again), lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.sequence(F.lit(2), F.size("p")), F.lit(3), lambda acc, k: acc + F.least(F.lit(3), F.element_at("p", k) - F.element_at("p", k - 1)))
    return e.select(*kept, F.when(F.size("p") > 1, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fails_a_rule() -> Column:
    """A base rule, one symbol or more for ten words, a third of lines repeated, or a mean word length outside 2 to 15."""
    n = F.col("n_words")
    return base_failed() | (10 * F.col("n_symbols") >= n) | (3 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed: exact counts over all documents; a null host is a host."""
    return measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("fails")).alias("failed"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments over the hosts; between-host variance has the sampling variance taken off.

    With one host, or no variance beyond sampling, the prior is as strong as the whole corpus.
    """
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q")).first()
    n, f, k = float(m["n"] or 0), float(m["f"] or 0), m["k"]
    if n == 0:
        return 1.0, 1.0
    mean = (f + 0.5) / (n + 1)
    spread = max(0.0, (m["q"] - f * f / n) / n - mean * (1 - mean) * (k - 1) / n)
    strength = min(n, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else n
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected."""
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > limit).alias("rejected"))


def quality(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, host_rate, kept: one row per row of docs.

    A document is kept if no base rule fails and its host isn't rejected. Null texts fail; documents
    without a host share one. Repeated rows are judged, and counted for their host, each on its own.
    Texts count whole, however long; an empty table gives an empty result; other columns are never looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()).withColumn("fails", fails_a_rule()))
    verdicts = host_verdicts(scratch.save(host_rates(measured)), limit).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "rejected")
    out = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))
