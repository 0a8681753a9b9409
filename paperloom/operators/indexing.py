"""A positional inverted index in blocks, and many questions answered by joins with it.

The index is written once. A posting block holds up to about BLOCK documents of one term, of about
the same impact (what the term adds to a BM25 score, but for its rarity), with the places where the
term stands, and the block's largest impact. Blocks lie in folders by a hash of the term and are
sorted by it, so a question opens only the folders and row groups of its own terms. Frequent terms
have many blocks: none of them is gathered in one place.

A top-k reads fewer still: the scores of the documents that are best by a question's rarest terms are a bound from below. A document
with those terms only that stay under it together can't be in the result, so candidates come from the other
terms; those that can still reach the bound get the rest of their exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import terms
from paperloom.io import saved

BUCKETS, BLOCK = 64, 128
#: Tasks that write one bucket.
PARTS = 4
#: The rarest terms that give the first bound have this share of all documents together, or the last of them more.
SHARE = 1 / 64
#: So many times k documents are scored for the bound.
TRIED = 4
#: A question's weak terms add up to this share of the bound at most, so that the others must reach what is left of it.
WEAK = 1 / 2
#: Impacts are below k1 + 1; so many levels for each unit.
LEVELS = 8
#: Scores are rounded to six digits; a block is left out only if it is lower by more than that.
MARGIN = 1e-5


class Index(NamedTuple):
    """postings (bucket, term, level, chunk, max_impact, docs array<struct<doc_id, scope, impact, places>>), terms (bucket, term, df, max_impact), n documents."""

    postings: DataFrame
    terms: DataFrame
    n: int


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, scope, len, term, places: the places of each term of a document's terms t; within the document, so without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                lengths = pc.list_value_length(b.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
                words = b.column("t").flatten().dictionary_encode()
                doc = np.repeat(np.arange(b.num_rows), lengths)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                key = doc * max(1, len(words.dictionary)) + words.indices.to_numpy()
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[by], prepend=-1))
                of = pa.array(doc[by][first])
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(by)).astype(np.int32)), pa.array(place[by].astype(np.int32)))
                term = words.dictionary.take(words.indices.take(pa.array(by[first])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("scope").take(of), pa.array(lengths.astype(np.int32)).take(of), term, places], names=["doc_id", "scope", "len", "term", "places"])

    return docs.select("doc_id", "scope", "t").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, scope string, len int, term string, places array<int>")


def build_index(docs: DataFrame, path: str, scope: str | None = None, k1: float = 1.5, b: float = 0.75, buckets: int = BUCKETS) -> Index:
    """Writes the index of docs (doc_id, text) to path. Ids must be unique; rows without a text are not in it.

    scope: the column that questions can be confined to. An empty table gives an index without terms.
    """
    spark = docs.sparkSession
    of = docs.select("doc_id", (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"), terms(F.col("text")).alias("t")).filter("t IS NOT NULL")
    stats = of.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len")).first()  # one row
    f = F.size("places")
    impact = f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg_len"] or 1.0)))
    rows = _places(of).select(_bucket("term", buckets), "term", "doc_id", "scope", "places", impact.alias("impact")).withColumn("level", F.floor(F.col("impact") * LEVELS).cast("int"))
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    # most terms fit into one block; the table of those that don't is small beside the rows, and Spark broadcasts it while it is
    many = rows.groupBy("term", "level").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK)
    many.write.mode("overwrite").parquet(f"{path}/many")
    many = spark.read.schema("term string, level int, c long").parquet(f"{path}/many")
    chunk = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / BLOCK)).cast("int"), F.lit(0)).alias("chunk")
    dealt = rows.join(many, ["term", "level"], "left").select("bucket", "term", "level", chunk, F.struct("doc_id", "scope", "impact", "places").alias("d"))
    # one shuffle for blocks and folders; a bucket's terms and a frequent term's blocks are dealt to several tasks
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("term", "level", "chunk"), F.lit(PARTS))).repartition("bucket", "part")
    blocks = dealt.groupBy("bucket", "part", "term", "level", "chunk").agg(F.max("d.impact").alias("max_impact"), F.collect_list("d").alias("docs")).drop("part")
    blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    heads = _read(spark, f"{path}/postings", POSTINGS).groupBy("bucket", "term").agg(F.sum(F.size("docs")).alias("df"), F.max("max_impact").alias("max_impact"))
    heads.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(stats["n"],)], "n long").write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(_read(spark, f"{path}/postings", POSTINGS), _read(spark, f"{path}/terms", "term string, df long, max_impact double, bucket int"), spark.read.parquet(f"{path}/stats").first()["n"])


POSTINGS = "term string, level int, chunk int, max_impact double, docs array<struct<doc_id:bigint,scope:string,impact:double,places:array<int>>>, bucket int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def question_terms(index: Index, questions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """question, scope, bucket, term, wanted (distinct terms of the question), df, idf, most (the largest score that the term can add); df is 0 for terms that no document has."""
    scope = F.col("scope").cast("string") if "scope" in questions.columns else F.lit(None).cast("string")
    q = questions.select("question", scope.alias("scope"), F.array_distinct(terms(F.col("text"))).alias("t"))
    q = q.select("question", "scope", F.size("t").alias("wanted"), F.explode("t").alias("term")).withColumn("bucket", _bucket("term", buckets))
    j = q.join(index.terms, ["bucket", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return j.select("question", "scope", "bucket", "term", "wanted", "df", idf.alias("idf"), (idf * F.coalesce("max_impact", F.lit(0.0))).alias("most"))


def _hits(blocks: DataFrame, *keep: str) -> DataFrame:
    """keep..., doc_id, part, places of the documents of joined blocks that are in the question's scope."""
    d = blocks.select("scope", "idf", *keep, F.explode("docs").alias("d")).filter(F.col("scope").isNull() | (F.col("scope") == F.col("d.scope")))
    return d.select(*keep, "d.doc_id", (F.col("idf") * F.col("d.impact")).alias("part"), "d.places")


def _parts(index: Index, wanted: DataFrame) -> DataFrame:
    """question, doc_id, part of rows (question, doc_id, bucket, term, idf): each term's postings are opened once, whatever the number of questions."""
    opened = index.postings.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"]).select("term", F.explode("docs").alias("d")).select("term", "d.doc_id", "d.impact")
    return opened.join(wanted, ["term", "doc_id"]).select("question", "doc_id", (F.col("idf") * F.col("impact")).alias("part"))


def _bounds(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """question, bound: the k-th best score of the documents that are best by a question's rarest terms; no document of the result has less. None without k documents."""
    rarest = Window.partitionBy("question").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    few = asked.filter("df > 0").withColumn("ahead", F.coalesce(F.sum("df").over(rarest), F.lit(0))).filter(F.col("ahead") < max(k, index.n * SHARE))
    parts = _hits(few.join(index.postings.select("bucket", "term", "docs"), ["bucket", "term"]), "question").groupBy("question", "doc_id").agg(F.sum("part").alias("part"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("part")))
    best = parts.withColumn("place", place).filter(F.col("place") <= TRIED * k).select("question", "doc_id")
    tried = saved(best.join(asked.select("question", "bucket", "term", "idf"), "question"), "tried")
    full = _parts(index, tried).groupBy("question", "doc_id").agg(F.sum("part").alias("part"))
    return full.withColumn("place", place).filter(F.col("place") == k).select("question", F.col("part").alias("bound"))


def blocks_to_read(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The posting blocks of question_terms() rows that may hold one of the k best documents, with the question's columns and `bound`."""
    kth = _bounds(index, asked, k)
    total = asked.groupBy("question").agg(F.sum("most").alias("total"))
    bounded = asked.join(total, "question").join(kth, "question", "left")
    j = bounded.join(index.postings.withColumnRenamed("max_impact", "block_impact"), ["bucket", "term"])
    reach = F.col("idf") * F.col("block_impact") + F.col("total") - F.col("most")
    return j.filter(F.col("bound").isNull() | (reach >= F.col("bound") - MARGIN))


def search(index: Index, questions: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """question, rank, doc_id, score: for each question (question, text; scope, if it has one) the k documents of the highest BM25 scores, ties by id.

    Words count once. Statistics are those of the whole index, whatever the scope. A question without known terms has no rows.
    """
    asked = saved(question_terms(index, questions, buckets).filter("df > 0"), "asked")
    bounds = saved(_bounds(index, asked, k), "bounds")
    # a document with a question's weakest terms only, which stay under the bound together, isn't in the result
    weakest = Window.partitionBy("question").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = asked.join(bounds, "question", "left").withColumn("upto", F.sum("most").over(weakest))
    ranked = saved(ranked.withColumn("weak", F.coalesce(F.col("upto") < WEAK * F.col("bound") - MARGIN, F.lit(False))), "ranked")
    rest = ranked.groupBy("question", "bound").agg(F.coalesce(F.max(F.when(F.col("weak"), F.col("upto"))), F.lit(0.0)).alias("rest"))
    hits = _hits(ranked.filter("NOT weak").join(index.postings.select("bucket", "term", "docs"), ["bucket", "term"]), "question")
    strong = hits.groupBy("question", "doc_id").agg(F.sum("part").alias("part")).join(rest, "question")
    found = saved(strong.filter(F.col("bound").isNull() | (F.col("part") + F.col("rest") >= F.col("bound") - MARGIN)).select("question", "doc_id", "part"), "found")
    # what can still be in the result gets the parts of the weak terms
    wanted = saved(found.select("question", "doc_id").join(ranked.filter("weak").select("question", "bucket", "term", "idf"), "question"), "wanted")
    more = _parts(index, wanted)
    scores = found.union(more).groupBy("question", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("question", "rank", "doc_id", "score")


def covered(index: Index, questions: DataFrame, k: int, reach: int = 16, buckets: int = BUCKETS) -> DataFrame:
    """question, rank, doc_id, score: the k documents with all words of a question that hold them closest together.

    The score is that of cover_density(): each minimal stretch with all words adds 1, or reach / length beyond the reach. A question
    with a word that no document has, or without words, has no rows. A fold over the places of one document's words.
    """
    asked = question_terms(index, questions, buckets)
    number = F.row_number().over(Window.partitionBy("question").orderBy("term")) - 1
    whole = asked.withColumn("number", number)
    hits = _hits(whole.join(index.postings.select("bucket", "term", "docs"), ["bucket", "term"]), "question", "wanted", "number")
    of = hits.groupBy("question", "wanted", "doc_id").agg(F.count("*").alias("found"), F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("number").alias("number"))))).alias("at"))
    start = F.struct(F.array_repeat(F.lit(-1), F.col("wanted")).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == x["number"], x["place"]).otherwise(p))
        first = F.array_min(last)
        new = first > acc["before"]  # -1 until all words have come
        score = acc["score"] + F.when(new, F.least(F.lit(1.0), F.lit(float(reach)) / (x["place"] - first + 1))).otherwise(0.0)
        return F.struct(last.alias("last"), F.greatest(acc["before"], first).alias("before"), score.alias("score"))

    scores = of.filter("found = wanted").select("question", "doc_id", F.round(F.aggregate(F.sort_array("at"), start, step)["score"], 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("question", "rank", "doc_id", "score")
