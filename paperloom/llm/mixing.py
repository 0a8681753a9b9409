"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are added up by membership pattern; a flow
network then routes the patterns' words to the sources' quotas. Repeating is convex: a pattern's
words cost nothing the first time, more the second, most the third, and there is no fourth. Last,
each pattern takes its documents: whole passes over all of them, and for the rest documents in the
order of a seeded hash; the words that a pattern takes are laid end to end and dealt to its sources
as the flow grants them.

The driver holds the network: one node for each pattern and source, whatever the documents, solved
by connected parts. Choosing documents up to a number of words needs running sums over a pattern;
they are taken over ranges of the hash, then over ranges of the one range where the sum is reached,
and last over that range's few rows: no task holds a pattern and no document is shuffled, but for
those of several sources, which are summed by ranges.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, rows_of

SEED = 20240517
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Cost of a word's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
#: Rows of a range of the hash that are ordered together, and how many bits more each step of ranges looks at.
RANGE_ROWS, RANGE_BITS = 2000, 12
#: Tables with a row for each pattern are broadcast up to so many (some 200 bytes each).
FEW_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None) -> dict[str | None, float]:
    """Shares of the total by weight, each at most MAX_REPEATS times the source's size; the excess is shared out anew.

    Without weights: sources by code point, null last, weigh 5, 2, 1 and so on.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {s: 0.0 for s in order}
    free, left = [s for s in order if w.get(s, 0) > 0], float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total > MAX_REPEATS * sizes[s]]
        if not full:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in full:
            out[s] = float(MAX_REPEATS * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def min_cost_flow(capacity: dict[tuple, int], quotas: dict[str | None, int], costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern (a tuple of sources) gives to each source. Quotas that the members can't fill stay short.

    Parts of the network that share no source are solved apart; one pattern with one source needs no search.
    """
    part: dict[str | None, list[tuple]] = {}
    for p in capacity:
        joined = {id(part[s]): part[s] for s in p if s in part}
        merged = [q for group in joined.values() for q in group] + [p]
        part |= {s: merged for q in merged for s in q}
    out: dict[tuple, dict[str | None, int]] = {p: {} for p in capacity}
    for group in {id(g): g for g in part.values()}.values():
        if len(group) == 1 and len(group[0]) == 1:
            s = group[0][0]
            out[group[0]] = {s: min(quotas[s], capacity[group[0]] * len(costs))} if s in quotas else {}
        else:
            out |= _shortest_paths({p: capacity[p] for p in group}, {s: quotas[s] for s in quotas if any(s in p for p in group)}, costs)
    return out


def _shortest_paths(capacity: dict[tuple, int], quotas: dict[str | None, int], costs: tuple[int, ...]) -> dict[tuple, dict[str | None, int]]:
    """Successive shortest paths from the patterns' words to the quotas: every augmentation takes the
    cheapest words left, along paths that may hand over earlier grants to another source."""
    patterns, sources = list(capacity), list(quotas)
    first_source = 2 + len(patterns)
    graph: list[list[list]] = [[] for _ in range(first_source + len(sources))]  # edge: [to, left, cost, index of its reverse]

    def edge(u: int, v: int, cap: int, cost: int) -> list:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])
        return graph[u][-1]

    at = {s: first_source + i for i, s in enumerate(sources)}
    grants = {}
    for i, p in enumerate(patterns):
        for c in costs:
            edge(0, 2 + i, capacity[p], c)
        grants[p] = {s: edge(2 + i, at[s], capacity[p] * len(costs), 0) for s in p if s in at}
    for s in sources:
        edge(at[s], 1, quotas[s], 0)
    while True:
        dist, came, queue, queued = [math.inf] * len(graph), [None] * len(graph), deque([0]), {0}
        dist[0] = 0
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in graph[u]:
                if e[1] > 0 and dist[u] + e[2] < dist[e[0]]:
                    dist[e[0]], came[e[0]] = dist[u] + e[2], (u, e)
                    if e[0] not in queued:
                        queue.append(e[0])
                        queued.add(e[0])
        if dist[1] == math.inf:
            break
        path, v = [], 1
        while v:
            u, e = came[v]
            path.append(e)
            v = u
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    return {p: {s: graph[e[0]][e[3]][1] for s, e in by.items()} for p, by in grants.items()}


def _edges(sized: DataFrame, limits: dict[tuple[str, ...], int], most: int, bits: int) -> tuple[int, dict[tuple[str, ...], tuple[int, int]]]:
    """(shift, {pattern: (range, words left in it)}): in order of u, where the running size passes the pattern's limit; a range is u >>> shift."""
    spark = sized.sparkSession
    few = F.broadcast if len(limits) <= FEW_PATTERNS else lambda d: d
    steps = max(1, math.ceil(math.log(max(1, most / RANGE_ROWS), 2**bits)))
    at: dict[tuple[str, ...], tuple[int, int]] = {}
    shift = 64
    for step in range(steps):
        rows, shift = sized, shift - bits
        if step:
            inside = spark.createDataFrame([(list(p), r) for p, (r, _) in at.items()], "members array<string>, inside long")
            rows = rows.join(few(inside), "members").filter(F.shiftrightunsigned("u", shift + bits) == F.col("inside"))
        left = spark.createDataFrame([(list(p), n) for p, n in limits.items()], "members array<string>, left long")
        run = F.sum("w").over(Window.partitionBy("members").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        sums = rows.groupBy("members", F.shiftrightunsigned("u", shift).alias("range")).agg(F.sum("size").alias("w")).withColumn("upto", run)
        found = sums.join(few(left), "members").filter((F.col("upto") - F.col("w") <= F.col("left")) & (F.col("upto") > F.col("left")))
        at = {tuple(r["members"]): (r["range"], r["left"] - r["upto"] + r["w"]) for r in found.collect()}
        limits = {p: n for p, (_, n) in at.items()}
    return shift, at


@dataclass
class Plan:
    """What a row is taken for: by its pattern, by its range of the hash, and, in one range of each pattern, by itself."""

    patterns: DataFrame  # members, passes, edge, source_size, target, shares
    few: Callable[[DataFrame], DataFrame]  # broadcast, if there are few patterns
    special: DataFrame  # members, doc_id, size: rows of the edge and single ones that are taken once more; some thousands a pattern
    shift: int
    longest: int  # rows of the largest pattern of several sources

    def taken(self, sized: DataFrame) -> DataFrame:
        """Adds passes, source_size, target, shares and times to rows (doc_id, size, members, u, ...): no row is shuffled."""
        s = self.special.select(F.col("members").alias("s_members"), F.col("doc_id").alias("s_id"), F.col("size").alias("s_size"), F.lit(1).alias("once_more"))
        rows = sized.join(self.few(self.patterns), "members")
        rows = rows.join(self.few(s), (F.col("members") == F.col("s_members")) & F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("size") == F.col("s_size")), "left")
        early = F.coalesce(F.shiftrightunsigned("u", self.shift) < F.col("edge"), F.lit(False))
        times = F.when(F.col("size") > 0, F.col("passes") + F.greatest(early.cast("long"), F.coalesce("once_more", F.lit(0)))).otherwise(0)
        return rows.withColumn("times", times).drop("s_members", "s_id", "s_size", "once_more", "edge", "passes")


def _sized(docs: DataFrame, members: Column, size: Column, seed: int, *more: Column) -> DataFrame:
    """doc_id, size, members (the sorted set of sources; a null is kept, as a marked value), u, more."""
    marked = F.transform(F.coalesce(members, F.array().cast("array<string>")), lambda s: F.when(s.isNull(), "n").otherwise(F.concat(F.lit("s"), s)))
    sized = docs.select(docs["doc_id"], size.alias("size"), F.array_sort(F.array_distinct(marked)).alias("members"), *more)
    return sized.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "size"))


def _planned(scratch: Scratch, sized: DataFrame, weights: dict[str | None, float] | None, bits: int) -> Plan:
    spark = sized.sparkSession
    name = lambda m: None if m == "n" else m[1:]
    mark = lambda s: "n" if s is None else "s" + s
    totals = {tuple(map(name, r["members"])): (r["w"], r["n"]) for r in sized.groupBy("members").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()}
    capacity = {p: w for p, (w, _) in totals.items()}
    sizes: dict[str | None, int] = {}
    for p, w in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + w
    goal = targets(sizes, weights)
    flow = min_cost_flow(capacity, {s: round(t) for s, t in goal.items()})
    words = {p: sum(flow[p].values()) for p in capacity}
    shift, at = _edges(sized, {tuple(map(mark, p)): words[p] % w for p, w in capacity.items() if w}, max([n for _, n in totals.values()], default=0), bits)
    plan = []
    for p, w in capacity.items():
        edge, room = at.get(tuple(map(mark, p)), (None, None))
        only = p[0] if len(p) == 1 else None
        ends = [sum(list(flow[p].values())[: i + 1]) for i in range(len(flow[p]))]
        share = list(zip(flow[p], [0, *ends[:-1]], [*ends[:-1], 2**62])) if ends else []
        plan.append((list(map(mark, p)), words[p] // w if w else 0, words[p] % w if w else 0, edge, room, sizes[only] if len(p) == 1 else None, goal[only] if len(p) == 1 else None, share))
    plans = spark.createDataFrame(plan, "members array<string>, passes long, rest long, edge long, room long, source_size long, target double, shares array<struct<source:string,lo:long,hi:long>>")
    few = F.broadcast if len(plan) <= FEW_PATTERNS else lambda d: d
    rows = sized.join(few(plans.select("members", "rest", "edge", "room")), "members").withColumn("range", F.shiftrightunsigned("u", shift))
    # documents of earlier ranges are taken, those of the edge while they fit
    order = Window.partitionBy("members").orderBy("u", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)
    inside = scratch.save(rows.filter(F.col("range") == F.col("edge")).withColumn("extra", F.sum("size").over(order) <= F.col("room")))
    fitting = inside.filter("extra AND size > 0")
    # of all that aren't taken, the one whose size is nearest to what is still missing
    got = inside.groupBy("members").agg((F.max("room") - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).alias("gap"))
    free = rows.filter((F.col("range") > F.col("edge")) & (F.col("size") > 0)).select("members", "u", "doc_id", "size").unionByName(inside.filter("NOT extra AND size > 0").select("members", "u", "doc_id", "size"))
    best = free.join(few(got), "members").groupBy("members").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "u", "doc_id", "size", "gap")).alias("b"))
    best = best.filter(F.col("b.off") < F.abs("b.gap")).select("members", "b.doc_id", "b.size")
    special = scratch.save(fitting.select("members", "doc_id", "size").unionByName(best).distinct())
    return Plan(plans.drop("rest", "room"), few, special, shift, max([n for p, (_, n) in totals.items() if len(p) > 1], default=0))


def mix(docs: DataFrame, members: Column, size: Column, weights: dict[str | None, float] | None = None, seed: int = SEED, bits: int = RANGE_BITS) -> DataFrame:
    """doc_id, size, members, taken, granted; plus target and source_size by `targets` for one-source documents: one row per row of docs.

    `members` is an array of sources (null or empty: the document belongs to none and isn't taken).
    taken is 0 to MAX_REPEATS times the size; granted (source, words) says for which sources. What a
    pattern takes differs from the words that the flow wants of it by at most half a document, where
    documents of that size are left: after the seeded documents that fit, the one whose size is nearest
    to the rest is added if that brings the sum nearer. So a source is off by half a document for each
    pattern it is in. Rows that agree in id and size in one pattern are dealt alike. Texts count as
    whole, without words a size is 0 and nothing is taken. An empty table gives an empty result.
    Columns that `members` and `size` don't name are never looked at.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_sized(docs, members, size, seed))
    plan = _planned(scratch, sized, weights, bits)
    out = plan.taken(sized).withColumn("taken", F.col("size") * F.col("times"))
    one = F.filter(F.transform("shares", lambda x: F.struct(x["source"].alias("source"), F.col("taken").alias("words"))), lambda x: x["words"] > 0)
    if plan.longest:
        dealt = _dealt(out.filter(F.size("members") > 1), plan.longest)
        out = out.filter(F.size("members") <= 1).withColumn("granted", one).unionByName(dealt)
    else:
        out = out.withColumn("granted", one)
    plain = F.transform("members", lambda m: F.when(m != "n", F.substring(m, 2, 2**31 - 1)))
    return out.select("doc_id", "size", plain.alias("members"), "source_size", "target", "taken", "granted")


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Adds granted: a pattern's taken words, end to end in order of u, meet the stretches of its sources. Sums go by ranges of u, then by ranges of ranges."""
    bits = max(1, math.ceil(math.log2(max(2, most / RANGE_ROWS))))
    r = rows.withColumn("range", F.shiftrightunsigned("u", 64 - bits)).withColumn("wide", F.shiftrightunsigned("u", 64 - bits // 2 - 1))
    before = lambda c, by, o: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = r.groupBy("members", "wide", "range").agg(F.sum("taken").alias("w"))
    wide = sums.groupBy("members", "wide").agg(F.sum("w").alias("w")).select("members", "wide", before("w", ["members"], ["wide"]).alias("ahead"))
    ranges = sums.select("members", "wide", "range", before("w", ["members", "wide"], ["range"]).alias("inner")).join(wide, ["members", "wide"])
    start = F.col("ahead") + F.col("inner") + before("taken", ["members", "range"], ["u", "doc_id", "size"])
    placed = r.drop("wide").join(ranges.select("members", "range", "ahead", "inner"), ["members", "range"]).withColumn("start", start)
    met = F.transform("shares", lambda x: F.struct(x["source"].alias("source"), (F.least(x["hi"], F.col("start") + F.col("taken")) - F.greatest(x["lo"], F.col("start"))).alias("words")))
    return placed.withColumn("granted", F.filter(met, lambda x: x["words"] > 0)).select(*rows.columns, "granted")


def mix_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED) -> DataFrame:
    """mix() of a documents table by its source column (null is a source); a null text has no words."""
    d = rows_of(docs, "doc_id", "text", "source")
    return mix(d, F.array("source"), n_words(F.col("text")), weights, seed)


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with all its columns.

    Documents without words are not part of a mix by words and stay once. Rows that repeat an id, or
    have none, are told apart by source and size, as in mix(). Texts stay where they are read: what is
    taken is decided by the plan, which is broadcast.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = lambda d: n_words(d["text"])
    sized = scratch.save(_sized(docs, F.array(docs["source"]), size(docs), seed))
    plan = _planned(scratch, sized, weights, RANGE_BITS)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    taken = plan.taken(_sized(docs, F.array(docs["source"]), size(docs), seed, whole))
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(1).cast("int")
    copies = taken.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select("row.*")
