"""Sharding by a K-d tree over document metadata (native).

Equal texts are one point, whose weight is the sum of their bytes; its coordinates are the text's
size and the least source and language among its rows (as their hash, so that each is a number).
Starting from all points, a node is split along its widest dimension at the weighted median of its
bytes, until each leaf has reached its target: `shards` leaves, or as many as target_bytes asks for.
All nodes of a level are split at once, by three aggregates: a histogram along the dimension, one of
the points' hashes inside the bin where the median lies, and one of further bits of the hash inside
that. A cut passes between points and never through one, so equal texts stay together. Only where one
text's rows outweigh a shard is it dealt out by the hash of its rows, as many points.

The driver holds the tree only: some numbers for each shard. Aggregates are combined before they are
shuffled. Rows find their point by a join; texts with a thousandth of all rows or more are at most a
thousand, and are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch

BINS = 4096
DIMENSIONS = ("d_size", "d_source", "d_lang")
#: A text that outweighs a shard is dealt out in parts of about this share of a shard.
PART = 0.005
#: Rows numbered together when slots are given.
SLOT_ROWS = 1000


def _by_node(of: dict[int, object], otherwise: object = None) -> Column:
    """The node's entry as a column, through a literal map whose size is the number of nodes."""
    items = [F.lit(x) for kv in of.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*items), F.col("node")), F.lit(otherwise)) if items else F.lit(otherwise)


def _crossing(points: DataFrame, key: str, goal: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node (key, weight before it, its weight): where the running weight in order of key reaches the goal."""
    sums = points.groupBy("node", key).agg(F.sum("weight").alias("w"))
    run = F.sum("w").over(Window.partitionBy("node").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))  # at most BINS rows a node
    at = sums.withColumn("run", run).withColumn("goal", _by_node(goal)).filter((F.col("run") >= F.col("goal")) & (F.col("run") - F.col("w") < F.col("goal")))
    return {r["node"]: (r[key], r["run"] - r["w"], r["w"]) for r in at.collect()}


def split_level(points: DataFrame, leaves: dict[int, int], spans: list[float]) -> tuple[Column, dict[int, int]]:
    """(column that is true for points that go left, leaves of the new nodes); node i has children 2i + 1 and 2i + 2."""
    open_ = [n for n, k in leaves.items() if k > 1]
    rows = points.filter(F.col("node").isin(open_))
    stats = rows.groupBy("node").agg(F.sum("weight").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()
    dim, low, width, goal = {}, {}, {}, {}
    for s in stats:
        wide = max(range(len(DIMENSIONS)), key=lambda i: (s[f"max_{DIMENSIONS[i]}"] - s[f"min_{DIMENSIONS[i]}"]) / max(spans[i], 1e-12))
        n, d = s["node"], DIMENSIONS[wide]
        dim[n], low[n], width[n] = wide, float(s[f"min_{d}"]), max(float(s[f"max_{d}"] - s[f"min_{d}"]), 1e-12)
        goal[n] = s["w"] * (leaves[n] // 2) / leaves[n]
    x = F.element_at(F.array(*DIMENSIONS), _by_node(dim, 0) + 1)
    bin_ = F.least(F.lit(BINS - 1), F.floor((x - _by_node(low, 0.0)) / _by_node(width, 1.0) * BINS)).cast("int")
    # in order of (bin, coarse, fine); of the last bin the nearer side is taken
    place, left, cuts = {"bin": bin_, "coarse": F.col("coarse"), "fine": F.col("fine")}, dict(goal), []
    inside = rows.withColumn("bin", bin_)
    for key in place:
        found = _crossing(inside, key, left)
        if key == "fine":
            cuts.append({n: k if left[n] - before >= w / 2 else k - 1 for n, (k, before, w) in found.items()})
        else:
            cuts.append({n: k for n, (k, _, _) in found.items()})
            left = {n: left[n] - before for n, (_, before, _) in found.items()}
            inside = inside.filter(F.col(key) == _by_node(cuts[-1], -1))
    cut = [_by_node(c, -1) for c in cuts]
    first, second, third = place.values()
    goes_left = (first < cut[0]) | ((first == cut[0]) & ((second < cut[1]) | ((second == cut[1]) & (third <= cut[2]))))
    grown = {n: k for n, k in leaves.items() if k == 1}
    for n in open_:
        grown |= {2 * n + 1: leaves[n] // 2, 2 * n + 2: leaves[n] - leaves[n] // 2}
    return goes_left, grown


def shard_documents(docs: DataFrame, shards: int = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs.

    The law is `bytes`: shards are near equal in bytes (a text's UTF-8 bytes plus 1; a null text is an
    empty one, with only the 1), by half of the heaviest text's rows at each of the tree's levels at
    most. Equal texts share a shard unless they outweigh one. With target_bytes, there are as many
    shards as the total needs. Null sources and languages are values of their own; long texts count
    whole; ties are cut by hash, and rows that agree in id and text share a shard. Slots run from 0 in
    each shard. An empty table gives an empty result; with fewer texts than shards, some stay empty. A
    table without source or language has nulls for it; other columns are never looked at.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    t, number = F.coalesce("text", F.lit("")), lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) / 2.0**32, F.lit(-0.1))
    meta = [docs[c] if c in docs.columns else F.lit(None) for c in (source_col, lang_col)]
    base = docs.select(docs[id_col], docs[text_col], *meta).toDF("doc_id", "text", "source", "lang")
    base = base.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("point"), number("source").alias("d_source"), number("lang").alias("d_lang"))
    base = scratch.save(base)
    texts = scratch.save(base.groupBy("point").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.max("size").alias("size"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang")))
    total, count = texts.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, math.ceil(total / target_bytes)) if target_bytes else shards
    target = total / shards
    heavy = {r["point"]: max(1, math.ceil(r["weight"] / (PART * target))) for r in texts.filter(F.col("weight") > target).collect()}  # fewer than there are shards
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in heavy.items() for x in kv]), F.col("point")), F.lit(1)) if heavy else F.lit(1)
    base = base.select("doc_id", "size", "text_crc32", "point", F.pmod(F.xxhash64("doc_id", F.lit(17)), parts).cast("int").alias("part"))
    light, split = texts.filter(~F.col("point").isin(list(heavy))), texts.filter(F.col("point").isin(list(heavy)))
    dealt = base.filter(F.col("point").isin(list(heavy))).groupBy("point", "part").agg(F.sum("size").alias("weight"))
    points = light.withColumn("part", F.lit(0)).unionByName(dealt.join(F.broadcast(split.drop("weight")), "point"))
    hashed = lambda seed: F.pmod(F.xxhash64("point", "part", F.lit(seed)), F.lit(BINS)).cast("int")
    cur = scratch.save(points.select("point", "part", "weight", "n", F.log2("size").alias("d_size"), "d_source", "d_lang", hashed(1).alias("coarse"), hashed(2).alias("fine"), F.lit(0).alias("node")))
    ends = cur.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    spans = [float((ends[f"max_{d}"] or 0) - (ends[f"min_{d}"] or 0)) for d in DIMENSIONS]
    leaves = {0: shards}
    while count and max(leaves.values()) > 1:
        goes_left, grown = split_level(cur, leaves, spans)
        done = F.col("node").isin([n for n, k in leaves.items() if k == 1])
        then = cur.withColumn("node", F.when(done, F.col("node")).when(goes_left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2))
        cur, old, leaves = scratch.save(then), cur, grown
        scratch.drop(old)
    path = lambda n: [] if n == 0 else [*path((n - 1) // 2), 1 - n % 2]
    numbers = {n: i for i, n in enumerate(sorted(leaves, key=path))}
    home = cur.select("point", "part", "n", _by_node(numbers, 0).alias("shard"))
    # the parts of heavy texts, and texts of a thousandth of the rows or more: both bounded
    common = F.broadcast(home.filter(F.col("point").isin(list(heavy)) | (F.col("n") * 1000 >= count)).drop("n"))
    found = base.join(common, ["point", "part"], "left")
    rest = found.filter("shard IS NULL").drop("shard").join(home.drop("n"), ["point", "part"])
    cur = found.filter("shard IS NOT NULL").unionByName(rest).drop("point", "part")
    part = max(1, math.ceil(count / shards / SLOT_ROWS))
    cur = cur.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(5)), F.lit(part)).alias("part"))
    counts = cur.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", offset.alias("offset"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    out = cur.withColumn("at", at).join(offsets, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
