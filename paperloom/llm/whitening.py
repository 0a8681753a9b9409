"""Whitening of embeddings by a tall-skinny QR.

Entries are whole multiples of 1/256 (x = floor(256 * entry)), so sums over the distinct vectors are
exact. Rows are centred by these sums, each task reduces its rows to one triangular factor, and
factors merge as a tree of fixed fan-in until one is left. Its singular values and right vectors give
the components: the covariance matrix, which would square the condition number, is never formed.

What reaches the driver is bounded by the dimension: its sums and one factor. A factor is the same
size however many rows it stands for, and a lost task makes only its own again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, map_batches

SCALE, COMPONENTS = 256, 4
#: Factors that merge in one task.
FAN_IN = 16
#: Rows that are reduced at a time.
BLOCK = 2048
_LIMIT = 2**62


class Whitening(NamedTuple):
    """n distinct vectors with per-dimension sums; eigenvalues fall; a row of `vectors` is a unit eigenvector."""

    n: int
    sums: list[int]
    reach: int
    eigenvalues: np.ndarray
    vectors: np.ndarray


def quantised(table: DataFrame, id_col: str, vector_col: str, dim: int | None) -> tuple[DataFrame, int]:
    """vec_id, x array<long> of the rows that count, and the dimension.

    Without `dim` it is the length that most vectors have, of two the larger.
    """
    v = table.select(table[id_col].alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    # |256 c| below 2^62 leaves out infinities and NaN, which sorts above all numbers
    usable = v.filter(F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c * SCALE) < float(_LIMIT), F.lit(False))), F.lit(False)) & (F.size("v") > 0))
    if dim is None:
        most = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = most["d"] if most else 0
    return usable.filter(F.size("v") == dim).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x")), dim


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, dim)


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """Number of rows of x, sums by dimension, and the largest absolute entry: exact, one small row for each task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, reach = [0] * dim, 0, 0
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0), dim)
                most = max(abs(int(m.max())), abs(int(m.min())))
                sums = m.sum(axis=0) if most * len(m) < _LIMIT else m.astype(object).sum(axis=0)
                total, n, reach = [t + int(s) for t, s in zip(total, sums)], n + len(m), max(reach, most)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * dim, pa.int64()), pa.array([reach] * dim, pa.int64())], names=["pos", "s", "n", "reach"])

    parts = map_batches(fit.select("x"), run, "pos int, s decimal(38,0), n long, reach long")
    rows = parts.groupBy("pos").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"), F.max("reach").alias("reach")).orderBy("pos").collect()  # dim rows
    return (rows[0]["n"], [int(r["s"]) for r in rows], rows[0]["reach"]) if rows else (0, [0] * dim, 0)


def deviations(x: np.ndarray, n: int, sums: list[int], reach: int) -> np.ndarray:
    """n * x - sums, exact: long where they fit for sure, else whole numbers of any size."""
    if n * reach + max(map(abs, sums)) < _LIMIT:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _packed(r: np.ndarray, dim: int) -> np.ndarray:
    """The upper triangle, row by row; a factor of fewer rows is filled up with zeros."""
    full = np.zeros((dim, dim))
    full[: len(r)] = r
    return full[np.triu_indices(dim)]


def _unpacked(values: np.ndarray, dim: int) -> np.ndarray:
    out = np.zeros((dim, dim))
    out[np.triu_indices(dim)] = values
    return out


def triangular_factor(scratch: Scratch, fit: DataFrame, dim: int, n: int, sums: list[int], reach: int) -> np.ndarray:
    """R of the centred rows of fit: one factor for each task, then FAN_IN of them at a time."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                centred = (deviations(_matrix(b.column(0).slice(at, BLOCK), dim), n, sums, reach) / n).astype(float)
                r = np.linalg.qr(np.vstack([r, centred]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(r, dim)], pa.list_(pa.float64()))], names=["r"])

    def merge(group: pa.Table) -> pa.Table:
        stacked = np.vstack([_unpacked(r.values.to_numpy(), dim) for chunk in group.column("r").chunks for r in chunk])
        return pa.table({"part": group.column("part").slice(0, 1), "r": pa.array([_packed(np.linalg.qr(stacked, mode="r"), dim)], pa.list_(pa.float64()))})

    factors = map_batches(fit.select("x"), reduce_rows, "r array<double>").select(F.spark_partition_id().alias("part"), "r")
    factors = scratch.save(factors)
    width = factors.agg(F.max("part")).first()[0] + 1
    while width > 1:
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        merged = scratch.save(factors.select(group.alias("part"), "r").groupBy("part").applyInArrow(merge, "part int, r array<double>"))
        scratch.drop(factors)
        factors, width = merged, -(-width // FAN_IN)
    return _unpacked(np.array(factors.first()["r"]), dim)


def fit_whitening(scratch: Scratch, fit: DataFrame, dim: int) -> Whitening:
    n, sums, reach = exact_sums(fit, dim)
    if not n:
        return Whitening(0, sums, 0, np.zeros(0), np.zeros((0, dim)))
    _, s, vt = np.linalg.svd(triangular_factor(scratch, fit, dim, n, sums, reach))
    s[s <= s[0] * 16 * dim * np.finfo(float).eps] = 0  # what rounding leaves of a direction without spread
    signs = np.sign(vt[np.arange(dim), np.abs(vt).argmax(axis=1)])
    return Whitening(n, sums, reach, s**2 / n, vt * signs[:, None])


def projected(rows: DataFrame, w: Whitening, keep: int) -> DataFrame:
    """The columns of rows but x, then deviation long, whitened array<double>: null entries for components without spread."""
    dim, scale = w.vectors.shape[1], np.sqrt(w.eigenvalues[:keep])
    others = [f for f in rows.schema.fields if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(0, b.num_rows, BLOCK):
                d = deviations(_matrix(b.column("x").slice(at, BLOCK), dim), w.n, w.sums, w.reach)
                most = w.n * w.reach + max(map(abs, w.sums))
                squares = (d * d).sum(axis=1) if most * most * dim < _LIMIT else (d.astype(object) ** 2).sum(axis=1)
                scores = (d / w.n).astype(float) @ w.vectors[:keep].T
                out += [(int(q) if q < 2**63 else None, [float(v / s) if s else None for v, s in zip(row, scale)]) for q, row in zip(squares, scores)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], pa.array([q for q, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))], names=[*[f.name for f in others], "deviation", "whitened"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "deviation long", "whitened array<double>"])
    return map_batches(rows.select(*[f.name for f in others], "x"), run, schema)


def identity_error(scratch: Scratch, fit: DataFrame, w: Whitening, keep: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity, centred first; over components with spread."""
    use = [i for i in range(min(keep, len(w.eigenvalues))) if w.eigenvalues[i] > 0]
    if not use:
        return 0.0
    white = scratch.save(projected(fit, w, keep).select(*[F.col("whitened")[i].alias(f"w{i}") for i in use]))
    means = white.agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in use]).first()
    off = {i: F.col(f"w{i}") - F.lit(means[f"w{i}"]) for i in use}
    pairs = [(i, j) for i in use for j in use if i <= j]
    cov = white.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    scratch.drop(white)
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(table: DataFrame, components: int = COMPONENTS, dim: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row of the table that counts and component.

    Rows count whose vector has no null and no entry that isn't finite, or is beyond 2^62 / 256 in
    size (its multiple would not be a long), and the dimension that most have, or `dim`. They are fitted on
    each distinct vector of whole multiples once, and all of them are returned, repeated rows and rows
    without an id as often as they stand. Signs are such that a component's largest weight is positive;
    components of equal spread are some basis of theirs. A component without spread has null as its
    whitened value, explains 0 and isn't in identity_error; a table of one distinct vector has no spread at all
    and null for what is explained. A deviation beyond a long is null. There are no more components than
    dimensions. An empty table, or one where no row counts, gives an empty result. Other columns are never looked at.
    """
    scratch = Scratch(table.sparkSession, "whitening")
    rows, dim = quantised(table, id_col, vector_col, dim)
    fit = scratch.save(rows.select("x").distinct())
    w = fit_whitening(scratch, fit, dim)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not w.n:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    keep, total = min(components, dim), float(w.eigenvalues.sum())
    error = identity_error(scratch, fit, w, keep)
    scratch.drop(fit)
    shares = F.array(*[F.lit(float(e) / total if total else None).cast("double") for e in w.eigenvalues[:keep]])
    out = projected(rows, w, keep).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
