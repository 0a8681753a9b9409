"""Exact dedup by deterministic block naming (native).

A text is normalised, cut into blocks of a fixed number of bytes, and each distinct block is named
by an integer: distinct blocks are sorted within their hash range and numbered. Then adjacent names
of a document are paired, distinct pairs are sorted and numbered, and so on until one name is left.
Two documents get the same (level, name) exactly if their texts are equal, as each level maps
distinct contents one to one to integers.

Scale: the text is shuffled once, reduced to distinct blocks before the shuffle. Names go back to
the documents by a 64-bit route computed from the block; should two distinct blocks share a route,
which is looked for, the join goes by the block's bytes instead, so names never collide. Later
levels move a few integers for each 4 KB of text. A group of copies is one row for each task after
the partial aggregate; joins back to its members are plain equi-joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, ascii_lower, repeated_ids, rows_of, text_tag

BLOCK_BYTES = 4096
KEY = ["doc_id", "tag", "n_bytes"]


def _numbered(distinct: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Distinct rows, sorted within their partition and numbered: partition number, then position."""
    return distinct.sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def name_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, route=F.xxhash64) -> DataFrame:
    """One row per document row: doc_id, text_sha256, level, name, copies.

    Null text counts as empty. Rows that agree in id and text are one document with `copies` rows
    (or several rows of one copy each). `route` may be any deterministic hash of the block; a poor
    one costs time, never correctness.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    base = rows_of(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", norm.alias("t"))
    base = base.select("doc_id", F.xxhash64("t").alias("tag"), F.octet_length("t").cast("long").alias("n_bytes"), F.col("t").cast("binary").alias("bin"))
    cut: Column = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n_bytes") - 1) / block_bytes).cast("int"))), lambda i: F.substring(F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))
    sha = F.when(F.col("pos") == 0, F.sha2("bin", 256))
    blocks = base.select(*KEY, "bin", F.posexplode(cut).alias("pos", "block"))
    pieces = blocks.select(*KEY, "pos", sha.alias("text_sha256"), route(F.col("block")).cast("long").alias("route"), "block")

    named = _numbered(pieces.select("route", "block").distinct(), ["block"])
    names = scratch.save(named.select("route", "name"))
    clash = names.groupBy("route").count().filter("count > 1").limit(1).count() > 0
    if clash:
        full = scratch.save(named)
        first = pieces.join(full, ["route", "block"])
    else:
        first = pieces.drop("block").join(names, "route")
    level = scratch.save(first.select(*KEY, "pos", "text_sha256", "name"))
    single = F.col("n_bytes") <= block_bytes
    done = [level.filter(single).select("doc_id", "text_sha256", F.lit(0).alias("level"), "name", F.lit(1).cast("long").alias("copies"))]
    rest = level.filter(~single).withColumn("copies", F.lit(None).cast("long"))
    widest = rest.agg(F.max("pos")).first()[0]
    n = 0
    while widest:
        n += 1
        even = F.col("pos") % 2 == 0
        pairs = rest.groupBy(*KEY, F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.max("text_sha256").alias("text_sha256"),
            F.coalesce(F.max("copies"), F.count_if(even)).alias("copies"),
        )
        pairs = scratch.save(pairs.withColumnRenamed("at", "pos"))
        numbered = scratch.save(_numbered(pairs.select("a", "b").distinct(), ["a", "b"]))
        joined = scratch.save(pairs.join(numbered, ["a", "b"]).select(*KEY, "pos", "text_sha256", "copies", "name"))
        scratch.drop(pairs, numbered)
        span = block_bytes << n
        single = F.col("n_bytes") <= span
        done.append(joined.filter(single).select("doc_id", "text_sha256", F.lit(n).alias("level"), "name", "copies"))
        rest = joined.filter(~single)
        widest = widest // 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, route=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts
    the largest doc_id stays. Null ids lose to any id. Repeated rows of one id and text count in
    group_size and share their verdict. An empty table gives an empty result. Other columns of
    docs are never looked at.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = scratch.save(name_documents(docs, scratch, id_col, text_col, block_bytes, route))
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    rows = named.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows repeating an id and a text are reduced to one.

    Rows are told apart by id and text: texts under one id, and rows without an id, each keep their own verdict.
    """
    kept = exact_dedup(docs).filter("kept")
    if not repeated_ids(docs):
        return keep_ids(docs, kept)
    return keep_texts(docs, kept.withColumnRenamed("text_sha256", "tag"), text_tag(ascii_lower(F.coalesce(F.col("text"), F.lit("")))))


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs, whose ids are unique, with a doc_id in ids."""
    once = ids.select(F.col("doc_id").alias("keep_id__")).distinct()
    return docs.join(once, docs["doc_id"].eqNullSafe(once["keep_id__"]), "left_semi")


def keep_texts(docs: DataFrame, kept: DataFrame, tag: Column) -> DataFrame:
    """Rows of docs whose doc_id and tag of the text are in kept (doc_id, tag), one row for each."""
    once = kept.select(F.col("doc_id").alias("keep_id__"), F.col("tag").alias("keep_tag__")).distinct()
    tagged = docs.withColumn("tag__", tag)
    out = tagged.join(once, tagged["doc_id"].eqNullSafe(once["keep_id__"]) & (tagged["tag__"] == once["keep_tag__"]), "left_semi")
    return out.dropDuplicates(["doc_id", "tag__"]).drop("tag__")
