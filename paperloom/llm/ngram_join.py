"""N-gram Jaccard join by prefixes of tokens and token combinations.

A document is the set of its hashed word n-grams (tokens); equal sets are one node. Two sets of n
tokens with a similarity of at least p have at least ceil(p * n) tokens in common, so of the first
tokens of either in any common order, all but n - ceil(p * n) are shared. Index.signatures() makes an index of that:

* Tokens are classed by how many sets hold them. A rare token is a key by itself. Frequent tokens are
  dealt to classes by their hash, about sixteen tokens of a set for one class, and two tokens of a class are one key.
* A prefix ends as soon as the tokens that would have to be missing to spoil all its keys, one for each rare
  token and all but one of each class, are more than may be missing. So prefixes are extended by one
  token for each class of frequent tokens, and linked sets always have a key in common.
* Keys hold the power of two that the larger set's size lies in; a set has keys for its own and, if
  partners can reach it, the next one.

The index is used twice:

1. Tokens in the order of their hashes, of which only the head of each set is kept. Each list of a key links its
   members to its first one and to the one whose tokens are the most common; each set verifies the link with most keys in common. Here two
   neighbours of a class are a key, which is enough to join most copies, and rows stay in proportion to the heads.
2. Sets that may have partners in another component, by the number of their head's tokens that several
   components hold, are looked at in whole. Tokens of one component alone come first and need no key, the others
   from rare to frequent; how many there are of each bounds what two sets can share. So a passage shared by many texts is in no prefix that can do without it,
   and texts that differ in more than it leaves room for don't meet.
   Of each list the members outside its most frequent component first verify a drawn member of that one, some rounds long;
   then all sets of components that are still different and have a key in common are verified, but for
   those that a bitmap of each set, in which every token flips a bit, shows to differ in too many tokens.

All links between components are found, at any size of sets, lists or components; what is verified is
compared as whole sets. Nothing is capped, and no set of pairs within a component is listed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, map_batches, repeated_ids, rows_of, text_tag
from paperloom.llm.components import components
from paperloom.llm.neardup import _lists, shingle_sets

WIDTH, PERCENT = 5, 80
#: A token of more sets than this is frequent.
RARE = 32
#: Tokens of a set for each class of frequent ones.
PER_CLASS = 16
#: So many members are compared with one copy of their hub's set.
HUB_BLOCK = 256
#: Members of a list that are looked for together, and rounds of drawn hubs before all pairs that are left.
CHUNK, DRAWS = 256, 3
_MASK = 2**64 - 1
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


class Index(NamedTuple):
    """The rules of the index; PER_CLASS of 4 or more leaves fewer classes than tokens that are shared."""

    percent: int = PERCENT
    rare: int = RARE
    per_class: int = PER_CLASS

    def shared(self, n: int) -> int:
        """A set of n tokens and a partner have so many in common at least."""
        return -(-self.percent * n // 100)

    def needed(self, n: int) -> int:
        """One more than the tokens of a set of n that a partner may lack."""
        return n - self.shared(n) + 1

    def bands(self, n: int) -> range:
        """The powers of two that hold the size of a partner that is at least as large."""
        return range(n.bit_length() - 1, (100 * n // self.percent).bit_length())

    def classes(self, band: int) -> int:
        return max(1, (1 << band) // self.per_class)

    def head_length(self, n: int) -> int:
        """So many tokens are enough for the prefix of any band: each class costs one."""
        return min(n, self.needed(n) + self.classes(self.bands(n)[-1]))

    def least_common(self, n: int) -> int:
        """The heads of a set of n and any partner have so many tokens in common at least."""
        least = max(1, self.shared(n))
        return self.head_length(least) - self.needed(least) + 1

    def least_common_column(self, n: str) -> Column:
        """least_common() of a column."""
        least = f"greatest(1, ({self.percent} * {n} + 99) div 100)"
        need = f"({least} - ({self.percent} * {least} + 99) div 100 + 1)"
        kinds = f"greatest(1, shiftleft(1L, length(bin(100 * {least} div {self.percent})) - 1) div {self.per_class})"
        return F.expr(f"least({least}, {need} + {kinds}) - {need} + 1")

    def signatures(self, n: int, met: list[tuple[int, int, int]], every: bool) -> list[int]:
        """The keys of a set of n tokens, of which `met` (place from 1, number of sets, token), in order, may be in other sets; `every`: all pairs of a class, else neighbours."""
        out: set[int] = set()
        need = self.needed(n)
        for band in self.bands(n):
            salt, kinds, got, place = (band + 1) * _C3, self.classes(band), 0, 0
            of: dict[int, list[int]] = {}
            for at, often, token in met:
                got += at - place - 1  # tokens that no other set has
                place = at
                if got >= need:
                    break
                h = ((token & _MASK) ^ salt) * _C1 & _MASK
                if often <= self.rare:
                    out.add(h)
                    got += 1
                else:
                    mates = of.setdefault((h >> 20) % kinds, [])
                    got += bool(mates)
                    out.update((m * _C2 ^ h) & _MASK for m in (mates if every else mates[-1:]))
                    mates.append(h)
                if got >= need:
                    break
        return [k - 2**64 if k >> 63 else k for k in out]


def keys(grouped: DataFrame, index: Index, every: bool) -> DataFrame:
    """key and all columns of grouped but met: a row for each key of each row (..., n, met array<struct<at,often,v>>)."""
    others = [f for f in grouped.schema.fields if f.name != "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                found = []
                for n, met in zip(b.column("n").to_pylist(), b.column("met")):
                    at, often, v = (met.values.field(k).to_pylist() for k in range(3))
                    found.append(index.signatures(n, list(zip(at, often, v)), every))
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([k for f in found for k in f], pa.int64()), *[b.column(f.name).take(rows) for f in others]], names=["key", *[f.name for f in others]])

    schema = ", ".join(["key long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in others]])
    return map_batches(grouped.select(*[f.name for f in others], "met"), run, schema)


def heads(docs: DataFrame, index: Index, width: int) -> DataFrame:
    """doc_id, n, print (128-bit digest of the set), head (its first tokens by hash), tag if docs has it."""
    tagged = ["tag"] if "tag" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                sets = shingle_sets(b.column(1).to_pylist(), width)
                head = [s[: index.head_length(len(s))] if len(s) > 1 else s[:0] for s in sets]  # one token: linked with equal sets only
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(head), *b.columns[2:]], names=["doc_id", "n", "print", "head", *tagged])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows_of(docs, "doc_id", "text", *tagged), run, f"doc_id {kind}, n long, print binary, head array<long>" + ", tag string" * len(tagged))


def _sets_of(texts: DataFrame, width: int) -> DataFrame:
    """hub, block, role, node, items (in unsigned order) of rows with text."""
    names = ["hub", "block", "role", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(shingle_sets(b.column(4).to_pylist(), width))], names=[*names, "items"])

    return map_batches(texts.select(*names, "text"), run, "hub long, block int, role int, node long, items array<long>")


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, items, bits: whole sets, and four words in which each token flips the bit that its hash names."""

    def flipped(items: np.ndarray) -> np.ndarray:
        odd = np.bincount((items.view(np.uint64) >> np.uint64(24) & np.uint64(255)).astype(np.int64), minlength=256) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                sets = shingle_sets(b.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets), _lists([flipped(s) for s in sets])], names=["node", "items", "bits"])

    return map_batches(texts.select("node", "text"), run, "node long, items array<long>, bits array<long>")


def _hub_links(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: the members that are linked with their hub, of rows sorted by (hub, block, role); a hub's own set, role 0, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for b in batches:
            links = []
            items, offsets = b.column(4).values.to_numpy().view(np.uint64), b.column(4).offsets.to_numpy()
            for i, (h, role, node) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
                own = items[offsets[i] : offsets[i + 1]]
                if role == 0:
                    hub, hub_set = h, own.copy()
                    continue
                assert hub == h
                common = len(np.intersect1d(own, hub_set, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(hub_set) - common):
                    links.append((node, h))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of rows (..., first_doc_id, first_tag if ids are repeated), with all columns of both."""
    same = docs["doc_id"].eqNullSafe(F.col("first_doc_id"))
    if "tag" in docs.columns:
        same &= docs["tag"] == F.col("first_tag")
    return docs.join(chosen, same)


def verified(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The (a, b) of pairs that are links, by their whole sets: those with one b, HUB_BLOCK at a time, meet the set of b."""
    tagged = ["tag"] if "tag" in docs.columns else []
    pairs = scratch.save(pairs)
    hubs = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / HUB_BLOCK).cast("int").alias("blocks"))
    members = pairs.join(hubs, F.col("b") == F.col("hub")).select("hub", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("a").alias("node"))
    wanted = members.union(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(0), "hub"))
    chosen = scratch.save(wanted.join(nodes.select("node", *[F.col(c).alias(f"first_{c}") for c in ["doc_id", *tagged]]), "node"))
    texts = _texts_of(docs, chosen)
    texts = texts.dropDuplicates(["hub", "block", "role", "node"]) if tagged else texts
    dealt = _sets_of(texts, width).repartition("hub", "block").sortWithinPartitions("hub", "block", "role")
    out = scratch.save(_hub_links(dealt, percent))
    scratch.drop(pairs, chosen)
    return out


def _compatible(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Can sets a and b, structs of n, most and bits, be linked? `most` tokens at most are in sets of other components; bits that differ are tokens that only one set has."""
    apart = sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(4)), F.lit(0))
    common = F.least(a["most"], b["most"], F.floor((a["n"] + b["n"] - apart) / 2))
    return 100 * common >= percent * (a["n"] + b["n"] - common)


_SET = ("n", "most", "bits")


def _weight(met: str, often: str) -> Column:
    """How common a set's tokens are on average; tokens that no other set has count nothing. The text that many edited copies come from has the largest weight of them."""
    return (F.aggregate(met, F.lit(0).cast("long"), lambda s, x: s + x[often]) / F.col("n")).alias("weight")


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: for each node a of rows (key, node, n, weight) the first node, or the one of the largest weight, of its lists with which it has most keys in common, of those of a fitting size."""
    member = F.struct("weight", "node", "n")
    ends = lists.groupBy("key").agg(F.count("*").alias("c"), F.min_by(member, "node").alias("low"), F.max(member).alias("high")).filter("c > 1")
    j = lists.join(ends, "key").select("node", "n", F.explode(F.array_distinct(F.array("low", "high"))).alias("end")).filter(F.col("node") != F.col("end.node"))
    fit = j.filter(_compatible(F.col("n"), F.col("end.n"), percent))
    times = fit.groupBy("node", F.col("end.node").alias("end")).count()
    best = times.groupBy("node").agg(F.max(F.struct("count", (-F.col("end")).alias("end"))).alias("best"))
    low, high = F.least("node", -F.col("best.end")), F.greatest("node", -F.col("best.end"))
    return best.groupBy(low.alias("low"), high.alias("high")).agg(F.max("node").alias("a")).select("a", (F.col("low") + F.col("high") - F.col("a")).alias("b"))


def _split_lists(lists: DataFrame) -> DataFrame:
    """key, node, n, most, bits, weight, label, top, others: the rows of lists of several labels, with the label of most members and the number of all others."""
    lists = lists.drop("top", "others")
    counts = lists.groupBy("key", "label").agg(F.count("*").alias("c"))
    tops = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("s")).filter("s > m.c")
    return lists.join(tops.select("key", F.col("m.label").alias("top"), (F.col("s") - F.col("m.c")).alias("others")), "key")


def hub_pairs(split: DataFrame, percent: int, salt: int) -> DataFrame:
    """a, b: for each node a that isn't of its lists' most frequent label, of the members of that label that a list draws, by weight (salt 0) or a salted hash, the one with which it has most keys in common."""
    draw = F.xxhash64(F.lit(salt), "node").cast("double") if salt else F.col("weight")
    drawn = split.filter("label = top").groupBy("key").agg(F.max(F.struct(draw.alias("draw"), "node", *_SET)).alias("hub"))
    j = split.filter("label != top").join(drawn, "key").filter(_may_link(F.struct(*_SET), F.col("hub"), percent))
    times = j.groupBy("node", F.col("hub.node").alias("hub")).count()
    return times.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("count", "hub")).alias("best")).select("a", F.col("best.hub").alias("b"))


def cross_pairs(split: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of nodes of different labels with a key in common and fitting sizes, once each.

    The members that aren't of a list's most frequent label come in chunks, and every member takes the chunks of its
    lists; the partners of a member are united where its rows lie, so a pair's many common keys are never listed.
    """
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("others") / CHUNK)).alias("chunk")
    chunks = split.filter("label != top").groupBy("key", chunk).agg(F.collect_list(F.struct("node", "label", *_SET)).alias("rest"))
    own = F.col("label") != F.col("top")
    met = split.join(chunks, "key")
    fits = lambda x: (x["label"] != F.col("label")) & _may_link(F.struct(*_SET), x, percent) & (~own | (F.col("node") < x["node"]))
    rows = met.select("node", F.transform(F.filter("rest", fits), lambda x: x["node"]).alias("rest")).filter(F.size("rest") > 0)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, partners = None, np.zeros(0, np.int64)
        pair = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(partners), node, np.int64)), pa.array(partners)], names=["a", "b"])
        for b in batches:
            lists = b.column(1)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            nodes = b.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else []
            for i, z in zip(starts, [*starts[1:], len(nodes)]):
                if nodes[i] != node:
                    if len(partners):
                        yield pair()
                    node, partners = nodes[i], np.zeros(0, np.int64)
                partners = np.union1d(partners, values[offsets[i] : offsets[z]])
        if len(partners):
            yield pair()

    return map_batches(rows.repartition("node").sortWithinPartitions("node"), unite, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs; sets of `width` words, links of at least `percent`.

    component_id is the smallest doc_id reachable over links (100 * intersection >= percent * union;
    a pair of exactly `percent` is one). A text of fewer words is one sequence; null and blank texts are empty sets, linked with
    nothing, and their own component. Null ids are reachable but never the smallest unless alone.
    Repeated rows are equal sets. Whole texts of any length count. An empty table gives an empty
    result. Other columns are never looked at. Percentages of 50 and less are refused: two tokens
    of a class would not have to be shared. rare and per_class change the index, not the result.
    """
    if not 50 < percent <= 100 or per_class < 4:
        raise ValueError("links are of more than 50%, classes of four tokens at least")
    index = Index(percent, rare, per_class)
    scratch = Scratch(docs.sparkSession, "ngram-join", free_shuffles=True)
    docs = rows_of(docs, id_col, text_col).toDF("doc_id", "text")
    if repeated_ids(docs):
        docs = docs.withColumn("tag", text_tag(F.col("text")))
    tagged = ["tag"] if "tag" in docs.columns else []
    first = scratch.save(heads(docs, index, width))
    rows = scratch.save(first.drop("head"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *tagged))
    groups = first.filter("n > 0").groupBy("print", "n").agg(least.alias("least"), F.first("head").alias("head"))
    headed = scratch.save(groups.select("print", "n", *[F.col(f"least.{c}").alias(c) for c in ["doc_id", *tagged]], "head").withColumn("node", F.monotonically_increasing_id()))
    nodes = scratch.save(headed.drop("head"))

    # 1. heads by hash order
    tokens = headed.select("node", "n", F.posexplode("head").alias("at", "v"))
    often = tokens.groupBy("v").agg(F.count("*").alias("often")).filter("often > 1")
    met = scratch.save(tokens.join(often, "v").select("node", "n", "v", (F.col("at") + 1).alias("at"), F.col("often").cast("int").alias("often")))
    scratch.drop(first, headed)
    grouped = met.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("at", "often", "v"))).alias("met"))  # a set's own head
    grouped = grouped.select("node", "n", _weight("met", "often"), "met")
    lists = scratch.save(keys(grouped, index, every=False))
    labels = components(scratch, verified(scratch, star_pairs(lists, percent), nodes, docs, percent, width))
    scratch.drop(lists)

    # 2. sets that may have partners in another component
    known = scratch.save(met.join(labels, "node", "left").select("node", "n", "v", F.coalesce("label", "node").alias("label")))
    scratch.drop(met)
    mixed = known.groupBy("v").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("v")
    shared = known.join(mixed, "v").groupBy("node", "n", "label").agg(F.count("*").alias("shared"))
    left = scratch.save(shared.filter(F.col("shared") >= index.least_common_column("n")).select("node", "n", "label"))
    scratch.drop(known)
    if not left.isEmpty():
        texts = _texts_of(docs, nodes.join(left.select("node"), "node").select("node", "print", *[F.col(c).alias(f"first_{c}") for c in ["doc_id", *tagged]]))
        texts = texts.dropDuplicates(["node"]) if tagged else texts
        whole = scratch.save(_whole_sets(texts, width).join(left, "node"))
        tokens = whole.select("node", "n", "label", F.explode("items").alias("v"))
        often = tokens.groupBy("v").agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("v", F.col("often").cast("int").alias("often"))
        own = tokens.join(often, "v").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("own"))
        free = (F.col("n") - F.size("own")).cast("int")
        placed = own.join(whole.select("node", "bits"), "node").select("node", "n", "label", "bits", F.size("own").cast("long").alias("most"), _weight("own", "often"), F.transform("own", lambda x, i: F.struct((free + i + 1).alias("at"), x["often"].alias("often"), x["v"].alias("v"))).alias("met"))
        lists = scratch.save(keys(placed, index, every=True))
        found = []
        for salt in range(DRAWS):
            before, lists = lists, scratch.save(_split_lists(lists))  # labels only merge, so a list of one label is done
            scratch.drop(before)
            links = verified(scratch, hub_pairs(lists, percent, salt), nodes, docs, percent, width)
            if links.isEmpty():
                break
            found.append(links)
            of = lambda x: left.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
            merged = components(scratch, links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
            now = lambda t: t.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
            before, lists, left = lists, scratch.save(now(lists)), scratch.save(now(left))
            scratch.drop(before)
        found.append(verified(scratch, cross_pairs(_split_lists(lists), percent), nodes, docs, percent, width))
        scratch.drop(whole, lists)
        links = functools.reduce(DataFrame.union, found)
        if not links.isEmpty():
            labels = components(scratch, labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
    placed = nodes.select("print", "n", "node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = placed.join(smallest, "label").select("print", "n", "component_id")
    out = rows.filter("n > 0").select("doc_id", "n", "print").join(known, ["print", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
