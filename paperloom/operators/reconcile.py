"""Reconciling two tables by a tree of digests: only the rows of buckets that differ are compared.

A row falls into a leaf by its key's hash. A node's digest is its number of rows and the sums of four words of
their digests, so it does not depend on order, its rows are added up before they are shuffled, and equal rows don't
cancel. Two trees are compared from the root down; children are looked at only under a node that differs. A tree can be
written once, when its table is published, and read instead of the table.

Rows are compared by SHA-256 of their JSON text. Two tables must have the same columns of the same types; maps,
whose order is not defined, are refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

FANOUT, DEPTH = 64, 3
_WORDS = ("d0", "d1", "d2", "d3")
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_JSON = {"ignoreNullFields": "false", "timestampFormat": _MICROS + "XXX", "timestampNTZFormat": _MICROS}


def _has_map(t: DataType) -> bool:
    if isinstance(t, ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, MapType) or isinstance(t, StructType) and any(_has_map(f.dataType) for f in t.fields)


def _digested(rows: DataFrame, key: str, leaves: int) -> DataFrame:
    """key, node (leaf), d0 to d3 (32 bits each of the row's digest)."""
    if _has_map(rows.schema):
        raise ValueError("maps have no order, so no digest")
    digest = rows.select(F.col(key), F.sha2(F.to_json(F.struct(*sorted(rows.columns)), _JSON), 256).alias("h"))
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(d) for i, d in enumerate(_WORDS)]
    return digest.select(key, F.pmod(F.xxhash64(key), F.lit(leaves)).alias("node"), *words)


def _added() -> list[Column]:
    return [F.sum("n").alias("n"), *[F.sum(d).cast("decimal(38,0)").alias(d) for d in _WORDS]]


def digest_tree(rows: DataFrame, key: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """level (0 is the root), node, n, d0 to d3: at most fanout^depth leaves, whatever the number of rows. An empty table has no nodes."""
    leaves = _digested(rows, key, fanout**depth).withColumn("n", F.lit(1).cast("long"))
    leaves = leaves.groupBy("node").agg(*_added())
    up = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col("node") / fanout ** (depth - level)).alias("node")) for level in range(depth + 1)])
    return leaves.select(F.inline(up), "n", *_WORDS).groupBy("level", "node").agg(*_added())


def differing_leaves(expected: DataFrame, observed: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """node of each leaf whose digests in two trees differ, found from the root down."""
    at = lambda t, level: t.filter(F.col("level") == level).select("node", F.struct("n", *_WORDS).alias("d"))
    found = None
    for level in range(depth + 1):
        e, o = at(expected, level), at(observed, level)
        if found is not None:
            parents = F.broadcast(found.withColumnRenamed("node", "parent"))  # at most fanout^depth numbers
            e, o = (t.join(parents, F.floor(t["node"] / fanout) == parents["parent"], "left_semi") for t in (e, o))
        j = e.withColumnRenamed("d", "e").join(o.withColumnRenamed("d", "o"), "node", "full_outer")
        found = j.filter(~F.col("e").eqNullSafe(F.col("o"))).select("node")
    return found


def _opened(expected: DataFrame, observed: DataFrame, key: str, fanout: int, depth: int, trees: tuple[DataFrame | None, DataFrame | None]) -> DataFrame:
    """key, e, o (rows of each side), same: one row for each key that lies in a differing leaf. Keys are grouped, not joined, so a repeated key makes no pairs, and null is a key like others."""
    sides = [t if t is not None else digest_tree(rows, key, fanout, depth) for t, rows in zip(trees, (expected, observed), strict=True)]
    leaves = F.broadcast(differing_leaves(*sides, fanout=fanout, depth=depth))
    read = [_digested(rows, key, fanout**depth).join(leaves, "node", "left_semi").withColumn("side", F.lit(i)) for i, rows in enumerate((expected, observed))]
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    n = lambda side: F.count_if(F.col("side") == side)
    same = reduce(lambda a, b: a & b, [F.sum(F.col(d) * sign) == 0 for d in _WORDS]) & (n(0) == n(1))
    return read[0].unionByName(read[1]).groupBy(key).agg(n(0).alias("e"), n(1).alias("o"), same.alias("same"))


def reconcile(expected: DataFrame, observed: DataFrame, key: str, fanout: int = FANOUT, depth: int = DEPTH, trees: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """key, status (missing from observed, unexpected in it, or changed) of keys whose rows differ as multisets.

    trees: a `digest_tree` of each side with the same fanout and depth, if there is one already. Rows without a key
    count as rows of the key null. Two empty tables give no rows.
    """
    k = _opened(expected, observed, key, fanout, depth, trees)
    status = F.when(F.col("o") == 0, "missing").when(F.col("e") == 0, "unexpected").otherwise("changed")
    return k.filter(~F.col("same")).select(key, status.alias("status"))


def receipt(expected: DataFrame, observed: DataFrame, key: str, fanout: int = FANOUT, depth: int = DEPTH, trees: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """One row: expected and observed (rows), missing, unexpected and changed (keys), opened (rows of both sides that lie in differing leaves), publishable (no difference, and something is there)."""
    e, o = (t if t is not None else digest_tree(rows, key, fanout, depth) for t, rows in zip(trees, (expected, observed), strict=True))
    size = lambda t, name: t.filter("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name))
    k = _opened(expected, observed, key, fanout, depth, (e, o))
    absent, extra, differs = F.col("o") == 0, F.col("e") == 0, ~F.col("same")
    found = k.agg(F.count_if(differs & absent).alias("missing"), F.count_if(differs & extra).alias("unexpected"), F.count_if(differs & ~absent & ~extra).alias("changed"), F.coalesce(F.sum(F.col("e") + F.col("o")), F.lit(0)).alias("opened"))
    r = size(e, "expected").join(F.broadcast(size(o, "observed"))).join(F.broadcast(found))  # one row each
    return r.withColumn("publishable", (F.col("missing") + F.col("unexpected") + F.col("changed") == 0) & (F.col("expected") > 0))
