"""A canonical store: batches of immutable records, replayed without effect, refused where a replay differs.

The store is a folder that Spark writes and reads, in any file system:

    records/batch=<id>/    the new rows of a batch
    receipts/<id>          one row, written last: batch, position, offered, written

A batch counts from the moment its receipt is there. A job that dies before leaves rows that nobody reads, and the
same batch written again overwrites them. One writer at a time (the holder of the document's lease) is assumed, as
fencing is the lease's work.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = "batch string, position long, offered long, written long"


class DivergentReplay(ValueError):
    """A batch holds a key that is stored, or stands twice in the batch, with another content. Nothing was written."""


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """batch, position, offered, written of the batches that count. A store that isn't there has none."""
    try:
        return spark.read.schema(RECEIPT).option("recursiveFileLookup", "true").parquet(f"{path}/receipts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECEIPT)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records that count, with batch. Batches without new rows have no folder to read."""
    done = [r.batch for r in receipts(spark, path).filter("written > 0").select("batch").collect()]  # a name for each batch, not for each record
    if not done:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    parts = [f"{path}/records/batch={b}" for b in done]
    return spark.read.schema(schema + ", batch string").option("basePath", f"{path}/records").parquet(*parts)


def divergent_keys(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Keys whose records, of both tables, have more than one content. One grouping over both, so a key that is offered many times makes no pairs."""
    names = sorted(c for c in incoming.columns if c != key)
    body = (F.struct(*names) if names else F.lit(0)).alias("b")
    both = existing.select(key, body).union(incoming.select(key, body))
    return both.groupBy(key).agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter(~F.col("lo").eqNullSafe(F.col("hi"))).select(key)


def write_batch(incoming: DataFrame, path: str, batch: str, key: str, *, first_wins: str | None = None) -> DataFrame:
    """Writes a batch and returns its receipt.

    A batch whose receipt is there is a replay by name: nothing is written and the old receipt is returned, unless a row of
    it isn't stored, which diverges. Rows whose key is stored with equal content are skipped. Any key with another content
    raises DivergentReplay before anything is written. With first_wins, the name of a column of arrival, other
    contents are no error: the stored row stays, and of new rows of a key the first to arrive, by equal arrival the least one.

    A null key is refused. An empty batch writes a receipt with zeros. Columns can't be maps, which have no order.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,200}", batch):
        raise ValueError("a batch's name has letters, digits, _ and - only")
    spark = incoming.sparkSession
    if not incoming.filter(F.col(key).isNull()).isEmpty():
        raise ValueError("a record has no key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in incoming.schema)
    log = receipts(spark, path)
    known = log.filter(F.col("batch") == batch).collect()
    # of the store only records with an incoming key are grouped; a batch's keys are broadcast where Spark finds them small
    old = stored(spark, path, schema).drop("batch").join(incoming.select(key).distinct(), key, "left_semi")
    wrong = [] if first_wins else divergent_keys(old, incoming, key).limit(5).collect()
    fresh = incoming.join(old.select(key), key, "left_anti")
    if known and not wrong:
        wrong = fresh.select(key).limit(5).collect()
    if wrong:
        raise DivergentReplay(f"{batch}: other contents of {[r[0] for r in wrong]}")
    if known:
        return spark.createDataFrame(known, RECEIPT)
    order = [first_wins] * bool(first_wins) + sorted(c for c in incoming.columns if c not in (key, first_wins))
    rows = fresh.groupBy(key).agg(F.min(F.struct(*order)).alias("r")).select(key, "r.*") if order else fresh.distinct()
    target = f"{path}/records/batch={batch}"
    rows.select(*incoming.columns).write.mode("overwrite").parquet(target)
    written = spark.read.schema(schema).parquet(target).count()
    position = log.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("p")).first().p + 1
    spark.createDataFrame([(batch, position, incoming.count(), written)], RECEIPT).coalesce(1).write.mode("overwrite").parquet(f"{path}/receipts/{batch}")
    return receipts(spark, path).filter(F.col("batch") == batch)


def replay_outcomes(existing: DataFrame, batches: DataFrame, key: str, batch: str, *order: str) -> DataFrame:
    """batch, offered, written, same, divergent (rows) of batches (batch, key, columns) offered after the rows of existing, first writer first: batches by their number, rows of one batch by order.

    order names the columns of arrival within a batch; of rows that it doesn't tell apart the one of the least content is first, and of equal
    rows one. A batch is never null, and rows without a key are left out.
    A row is written if its key is new, `same` if its content is that of the key's first row, else divergent. One grouping
    finds the first row of each key, a join by key brings it to the others; no state goes from batch to batch.
    """
    names = sorted(c for c in existing.columns if c != key)
    body, low = F.struct(*names), F.lit(None).cast(batches.schema[batch].dataType)
    at = [F.col(c) for c in order]
    old = existing.select(key, body.alias("b"), F.struct(low.alias("batch"), *[F.lit(None).cast(batches.schema[c].dataType).alias(c) for c in order]).alias("at"))
    new = batches.select(key, body.alias("b"), F.struct(F.col(batch).alias("batch"), *at).alias("at"))
    both = old.union(new)  # null is the least batch, so stored rows come first
    first = both.groupBy(key).agg(F.min(F.struct("at", "b")).alias("f"))
    # rows of equal arrival and content are one with a count: only one of them can be the first
    j = new.groupBy(key, "at", "b").agg(F.count("*").alias("n")).join(first, key)
    own = (F.col("at").eqNullSafe(F.col("f.at")) & F.col("b").eqNullSafe(F.col("f.b"))).cast("long")
    alike = F.col("b").eqNullSafe(F.col("f.b"))
    return j.groupBy(F.col("at.batch").alias("batch")).agg(F.sum("n").alias("offered"), F.sum(own).alias("written"), F.sum(F.when(alike, F.col("n") - own).otherwise(0)).alias("same"), F.sum(F.when(alike, 0).otherwise(F.col("n"))).alias("divergent"))
