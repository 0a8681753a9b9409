"""A partitioned vector index: cells around drawn centers, exact top-k by triangle bounds, and a log of upserts.

Centers are at most MOST_CENTERS vectors drawn by a hash of their ids; every vector lies in the cell of its
nearest one, and a cell knows its radius and its largest norm. A vector x of a cell is at least d(q, center) - radius
away from q, which bounds q.x from above; cells under the k-th best score of the cells nearest to q
can't hold a result and aren't read. So results are exact, and how much is skipped depends on the data only.

The index is a log: an upsert appends rows with a number, and the last row of an id holds, so that a replay
changes nothing. Cells are folders of the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.io import saved
from paperloom.operators.retrieval import dot, scored_vectors, valid_vectors

MOST_CENTERS = 1024
#: Cells nearest to a query that give the first bound.
PROBES = 3
#: Queries of one cell that are multiplied at once, about.
QUERIES = 4096
MARGIN = 1e-6
LOG = "vec_id long, scope string, embedding array<float>, batch long, removed boolean, distance double, norm2 double, cell int"


class VectorIndex(NamedTuple):
    path: str
    dim: int
    centers: np.ndarray


def _nearest(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """The columns of vectors with distance, norm2 and cell: the nearest center, of equal ones the first. Rows that are removed may have no vector and lie in cell 0."""
    names = vectors.columns
    squares = (centers**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(names.index("embedding"))
            held = v.is_valid().to_numpy(zero_copy_only=False)
            x = v.drop_null().flatten().to_numpy().astype(float).reshape(-1, centers.shape[1])
            d2 = squares - 2 * x @ centers.T
            best = d2.argmin(axis=1)
            n2 = (x**2).sum(axis=1)
            cell, distance, norm2 = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.zeros(b.num_rows)
            cell[held], norm2[held] = best, n2
            distance[held] = np.linalg.norm(x - centers[best], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(distance), pa.array(norm2), pa.array(cell)], names=[*names, "distance", "norm2", "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, distance double, norm2 double, cell int")


def create(vectors: DataFrame, path: str, dim: int) -> VectorIndex:
    """A new index at path with the valid ones of vectors (vec_id, embedding; scope, if there is one) as its first batch. Without any, one center stands at 0."""
    ok = valid_vectors(vectors, dim).filter("ok")
    n = ok.count()
    drawn = ok.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_CENTERS, int(np.ceil(np.sqrt(n))))).collect()  # bounded
    centers = np.array([r["embedding"] for r in drawn], dtype=float) if drawn else np.zeros((1, dim))
    index = VectorIndex(path, dim, centers)
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").write.parquet(f"{path}/centers")
    upsert(index, vectors, 0)
    return index


def open_index(spark: SparkSession, path: str, dim: int) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
    return VectorIndex(path, dim, np.array([r["center"] for r in rows]))


def upsert(index: VectorIndex, vectors: DataFrame, batch: int, removed: bool = False) -> None:
    """Appends the valid ones of vectors, or that their ids are removed, as a batch; batches of higher numbers hold over lower ones. Of an id that a batch repeats the row of the larger vector, by its entries, holds."""
    scope = F.col("scope").cast("string") if "scope" in vectors.columns else F.lit(None).cast("string")
    rows = vectors if removed else valid_vectors(vectors, index.dim).filter("ok")
    vector = F.lit(None).cast("array<float>") if removed else F.col("embedding").cast("array<float>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scope.alias("scope"), vector.alias("embedding"), F.lit(batch).cast("long").alias("batch"), F.lit(removed).alias("removed"))
    _nearest(rows, index.centers).repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/log")


def current(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """vec_id, scope, embedding, distance, norm2, cell: what the log holds now. Rows are reduced before the shuffle."""
    log = spark.read.schema(LOG).parquet(f"{index.path}/log")
    last = log.groupBy("vec_id").agg(F.max(F.struct("batch", "removed", "embedding", "scope", "distance", "norm2", "cell")).alias("r"))
    return last.filter("NOT r.removed").select("vec_id", "r.scope", "r.embedding", "r.distance", "r.norm2", "r.cell")


def exact_count(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """scope, n: the number of vectors of each scope, exact."""
    return current(spark, index).groupBy("scope").agg(F.count("*").alias("n"))


def scroll(spark: SparkSession, index: VectorIndex, after: int | None, page: int = 4) -> DataFrame:
    """The next `page` vectors after an id, by id; `after` None starts."""
    rows = current(spark, index).select("vec_id", "scope", "embedding")
    return (rows if after is None else rows.filter(F.col("vec_id") > after)).orderBy("vec_id").limit(page)


def cell_bounds(rows: DataFrame) -> DataFrame:
    """cell, radius, most (the largest squared norm), n: a row for each cell that isn't empty, MOST_CENTERS at most."""
    return rows.groupBy("cell").agg(F.max("distance").alias("radius"), F.max("norm2").alias("most"), F.count("*").alias("n"))


def _reaches(queries: DataFrame, centers: np.ndarray) -> DataFrame:
    """query_id, q, cell, away (distance of the cell's center): rows of queries times centers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                x = b.column(1).flatten().to_numpy().astype(float).reshape(-1, centers.shape[1])
                away = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * x @ centers.T))
                take = pa.array(np.repeat(np.arange(b.num_rows), len(centers)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.tile(np.arange(len(centers), dtype=np.int32), b.num_rows)), pa.array(away.ravel())], names=["query_id", "q", "cell", "away"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", F.col("q").cast("array<float>").alias("q")).filter(F.size("q") == centers.shape[1]).mapInArrow(run, f"query_id {kind}, q array<float>, cell int, away double")


def _best_of_cells(rows: DataFrame, asked: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, vec_id, score: of each cell asked for (query_id, q, cell, kth) the vectors that may be among the k best of it and reach kth, if there is one.

    Products of a cell's vectors and queries are one of matrices; what comes near gets the exact score.
    """

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            v = np.stack(vectors.embedding.to_numpy()).astype(float)
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                q = np.stack(some.q.to_numpy()).astype(float)
                score = q @ v.T
                low = np.nan_to_num(some.kth.to_numpy(dtype=float, na_value=np.nan), nan=-np.inf)
                if len(v) > k:
                    low = np.fmax(low, np.partition(score, len(v) - k, axis=1)[:, len(v) - k])
                i, j = np.nonzero(score >= (low - MARGIN * np.maximum(1, np.linalg.norm(q, axis=1)))[:, None])
                found.append(pd.DataFrame({"query_id": some.query_id.to_numpy()[i], "q": some.q.to_numpy()[i], "vec_id": vectors.vec_id.to_numpy()[j], "embedding": vectors.embedding.to_numpy()[j]}))
        found = [f for f in found if len(f)]
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "q", "vec_id", "embedding")})

    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("cell", "vec_id", "embedding", part.alias("part")).groupBy("cell", "part")
    right = asked.select("cell", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "q", F.col("kth").cast("double").alias("kth")).groupBy("cell", "part")
    kind = asked.schema["query_id"].dataType.simpleString()
    near = left.cogroup(right).applyInPandas(run, f"query_id {kind}, q array<float>, vec_id long, embedding array<float>")
    return scored_vectors(near, "query_id")


def cells_to_read(rows: DataFrame, queries: DataFrame, centers: np.ndarray, k: int, parts: int = 1) -> DataFrame:
    """query_id, q, cell, kth, read: every cell that isn't empty for every query (query_id, q), and whether it may hold one of the k best."""
    reach = _reaches(queries, centers).join(F.broadcast(cell_bounds(rows)), "cell")  # MOST_CENTERS rows at most
    near = F.row_number().over(Window.partitionBy("query_id").orderBy("away", "cell"))
    probes = reach.withColumn("near", near).filter(F.col("near") <= PROBES).select("query_id", "q", "cell", F.lit(None).cast("double").alias("kth"))
    scored = _best_of_cells(rows, probes, k, parts)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = scored.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("kth"))
    apart: Column = F.greatest(F.lit(0.0), F.col("away") - F.col("radius") - MARGIN)
    best = (dot(F.col("q"), F.col("q")) + F.col("most") - apart * apart) / 2
    return reach.join(kth, "query_id", "left").select("query_id", "q", "cell", "kth", (F.col("kth").isNull() | (best >= F.col("kth") - MARGIN)).alias("read"))


def search(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, cells_read, cells: for each of queries (query_id, q) the k vectors of the largest product among all, ties by id; exact.

    A query without a vector of the index's dimension has no rows; vectors that aren't valid are never in the index.
    """
    rows = saved(current(spark, index), "current")
    parts = -(-queries.count() // QUERIES) or 1
    cells = saved(cells_to_read(rows, queries, index.centers, k, parts), "cells")
    counts = cells.groupBy("query_id").agg(F.count_if("read").alias("cells_read"), F.count("*").alias("cells"))
    scored = _best_of_cells(rows, cells.filter("read"), k, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id")
    return top.join(counts, "query_id")
