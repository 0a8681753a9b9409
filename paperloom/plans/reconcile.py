"""Queries of reconciliation: digest trees, batches of a canonical store, interval joins on long keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.io import table
from paperloom.operators import provenance, reconcile
from paperloom.plans.documents import LINES_SQL, _lines
from paperloom.plans.registry import query
from paperloom.sources import canonical


def _lineitems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as they should be; and as found: a fortieth of the orders is gone, others have another number or quantity."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    moved = F.when(F.col("l_orderkey") % 41 == 2, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    more = F.when((F.col("l_orderkey") % 50 == 3) & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return e, e.filter("l_orderkey % 40 != 1").select(moved.alias("l_orderkey"), "l_linenumber", more.alias("l_quantity"))


_SIDES_SQL = """WITH e AS (SELECT l_orderkey AS k, list(l_linenumber * 1000 + CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT CASE WHEN l_orderkey % 41 = 2 THEN -l_orderkey ELSE l_orderkey END AS k,
list(l_linenumber * 1000 + CAST(l_quantity AS DOUBLE) + CASE WHEN l_orderkey % 50 = 3 AND l_linenumber = 1 THEN 1 ELSE 0 END ORDER BY l_linenumber, l_quantity) AS v, count(*) AS n FROM lineitem WHERE l_orderkey % 40 <> 1 GROUP BY 1),
j AS (SELECT coalesce(e.k, o.k) AS k, e.n AS en, o.n AS rn, CASE WHEN o.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN e.v <> o.v THEN 'changed' END AS status FROM e FULL OUTER JOIN o ON e.k = o.k)"""


@query(f"{_SIDES_SQL} SELECT k AS l_orderkey, status FROM j WHERE status IS NOT NULL")
def tree_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ, found by digest trees."""
    return reconcile.reconcile(*_lineitems(spark, sf_dir), "l_orderkey")


@query(f"""{_SIDES_SQL} SELECT CAST(sum(en) AS BIGINT) AS expected, CAST(sum(rn) AS BIGINT) AS observed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected,
count(*) FILTER (status = 'changed') AS changed, count(status) = 0 AS publishable FROM j""")
def tree_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of the same tables; `opened` depends on hashes, so it is tested and not compared."""
    return reconcile.receipt(*_lineitems(spark, sf_dir), "l_orderkey").drop("opened")


@query("""WITH e AS (SELECT l_partkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1),
r AS (SELECT l_linenumber AS batch, l_suppkey AS v, e.v AS old, row_number() OVER w AS i, first_value(l_suppkey) OVER w AS fresh FROM lineitem LEFT JOIN e ON l_partkey = e.k WINDOW w AS (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey))
SELECT batch, count(*) AS offered, count(*) FILTER (old IS NULL AND i = 1) AS written, count(*) FILTER (NOT (old IS NULL AND i = 1) AND v = coalesce(old, fresh)) AS same, count(*) FILTER (NOT (old IS NULL AND i = 1) AND v <> coalesce(old, fresh)) AS divergent FROM r GROUP BY batch""")
def batch_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as batches by their number, each offering a part's supplier; a fifth of the parts is stored before."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("batch"), "l_orderkey", "l_partkey", "l_suppkey")
    stored = b.filter("l_partkey % 5 = 0").groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    return canonical.replay_outcomes(stored, b, "l_partkey", "batch", "l_orderkey")


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, 500 * unnest(range(length(text) // 500 + 1)) AS lo, 700 AS wide FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT doc_id, lo, lo + wide AS hi FROM r)
SELECT doc_id, n AS span, greatest(start, lo) AS start, least(stop, hi) AS stop, 1000 + greatest(start, lo) AS source_start, 1000 + least(stop, hi) AS source_stop FROM lines JOIN q USING (doc_id) WHERE greatest(start, lo) < least(stop, hi)""")
def binned_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document against windows of 700 characters, 500 apart, and the whole text."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    lines = _lines(docs).select("doc_id", F.col("n").alias("span"), "start", "stop", (F.col("start") + 1000).alias("source_start"))
    length = F.char_length("text")
    windows = F.transform(F.sequence(F.lit(0), F.floor(length / 500).cast("int")), lambda i: F.struct((500 * i).alias("lo"), (500 * i + 700).alias("hi")))
    whole = F.array(F.struct(F.lit(0).alias("lo"), length.alias("hi")))
    requests = docs.select("doc_id", F.inline(F.concat(windows, whole))).distinct()
    return provenance.clip_binned(lines, requests, "doc_id")


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, n AS mapping, start, stop, start + CASE WHEN n % 11 = 4 THEN 1 ELSE 0 END AS a, stop + CASE WHEN n % 13 = 5 THEN 1 ELSE 0 END AS b FROM lines WHERE stop > start + 1)
SELECT doc_id, mapping, 'outside' AS defect FROM m WHERE NOT EXISTS (SELECT 1 FROM lines s WHERE s.doc_id = m.doc_id AND s.start <= m.a AND m.b <= s.stop)
UNION ALL SELECT doc_id, mapping, 'length' FROM m WHERE b - a <> stop - start""")
def mapping_span_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two characters or more as identity mappings of themselves; some start or stop one character late."""
    lines = _lines(table(spark, sf_dir, "documents"))
    late = lambda c, k, i: F.col(c) + F.when(F.col("n") % k == i, 1).otherwise(0)
    m = lines.filter("stop > start + 1").select("doc_id", F.col("n").alias("mapping"), F.lit("identity").alias("kind"), "start", "stop", late("start", 11, 4).alias("source_start"), late("stop", 13, 5).alias("source_stop"))
    return provenance.mapping_defects(m, lines.select("doc_id", F.col("start").alias("lo"), F.col("stop").alias("hi")), "doc_id")
