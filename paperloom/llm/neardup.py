"""Near-duplicates by bottom-k sketches of one hash function.

Every text is the set of its word shingles, each hashed once; the k smallest hashes, in order, are
its sketch. Equal sets are one node from the start. Then:

1. Inverted lists. The keys of a node are the runs of successive retained values (lists of single
   values would grow with every passage that documents share, and their overlaps with the square of
   that). The hash spreads values at random, so that two sets of similarity p share each of the first
   K values of their union with chance p: run_length() takes the longest run that fails to occur among
   them with a chance of at most MISS (1.01e-8 for runs of four at 85%, 1.3e-10 for runs of three at
   80%). Where sketches hold whole sets, key_runs() gives lengths that can't fail.
2. Each list links its members to its first and its last node: rows in proportion to the lists.
   Candidates pass if the sizes allow the similarity and the sketch of the union, which the two
   sketches give exactly, has enough values in common (a true link fails with a chance of at most
   DOUBT); those left are verified on full sets.
3. Lists that are not in one component yet take a second center, the medoid: the member whose values
   are the most common in the list, found in blocks and then among the blocks' medoids. It is what
   many copies of one text, each edited in its own way, have in common.
4. Members of lists that are still in different components meet by the prefix filter: their values
   are ordered from rare to frequent; of a linked pair, the smaller set's first values and the larger
   one's share one whose places leave room for the overlap that is needed. So texts that share a
   passage don't meet on the passage, however many they are, but on what is rare among them. For sets
   of up to WIDE values nothing is lost; larger ones are represented by their WIDE least values, and
   fail with a chance of at most DOUBT. Sets meet in blocks, by array operations: a bitmap of each, in which
   every value flips a bit, shows most pairs to differ in too many values, and a pair is a candidate under the
   first of its common values only. Candidates are verified as in 2. Copies of one text that are all
   just short of a link are still compared with each other; that is a few words a pair, and no row of it.

Nothing is capped: lists of any length are treated alike, and links within a component need no
others. Full sets are made again from the text for the nodes of candidates only.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, map_batches, repeated_ids, rows_of, text_tag
from paperloom.llm.components import components
from paperloom.llm.exact_dedup import keep_ids, keep_texts

SHINGLE, PERCENT = 5, 80
K, WIDE = 64, 512
#: Chances that a link of sets larger than K (WIDE) is missed by its keys, and by one estimate.
MISS, DOUBT = 2e-8, 1e-6
BLOCK = 400
#: Sets meet within bands of their size's logarithm.
BAND = 0.05
#: Bits of the map of a set's values. Entries of a value that are compared with SMALL others at most, and pairs at a time.
BITS, LARGE, SMALL, PAIRS = 1024, 2048, 16384, 1 << 15
#: So many ids at most (some 40 bytes each) are sent to the texts; beyond, texts and ids are joined by a shuffle.
FEW_IDS = 100_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C2
    return h ^ (h >> np.uint64(29))


#: Words of up to LETTERS bytes are hashed by random values of each place and byte, some PIECE bytes of text at a time.
LETTERS, PIECE = 32, 1 << 17
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) > 64) & (np.arange(256) < 91), 32, 0).astype(np.uint8)
_VALUES = _mix(_mix(np.arange(1, 256 * LETTERS + 1, dtype=np.uint64) * _C1) * _C1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts, and its hash: the sum of its values, so that words of a whole batch cost a few array operations."""
    solid = ~_GAP[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, n = edges[::2], edges[1::2] - edges[::2]
    if not len(n):
        return starts, np.zeros(0, np.uint64)
    low, first = _LOWER[data[solid]], np.cumsum(n) - n
    place = np.arange(len(low), dtype=np.int64) - np.repeat(first, n)
    h = np.add.reduceat(_VALUES[np.minimum(place, LETTERS - 1) * 256 + low], first)
    for i in np.flatnonzero(n > LETTERS):
        h[i] = xxhash.xxh3_64_intdigest(low[first[i] : first[i] + n[i]].tobytes())
    return starts, h


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The bytes in pieces that cut no word, and where they start."""
    at = 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data):
            gaps = _GAP[data[stop : stop + PIECE]]
            if gaps.any():
                stop += int(gaps.argmax())
                break
            stop += PIECE
        yield at, data[at:stop]
        at = stop


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than the width: the whole sequence as one."""
    parts = [(t or "").encode() for t in texts]  # bytes: A-Z and the six gaps are one byte each
    found = [(at + starts, h) for at, piece in _pieces(np.frombuffer(b"\n".join(parts), np.uint8)) for starts, h in [_words(piece)]]
    starts = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
    flat = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)])
    counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))).tolist()
    h = _mix(flat * _C1)
    for k in range(1, width):  # position i takes in word i + k
        h[: len(flat) - k] = _mix((h[: len(flat) - k] + flat[k:]) * _C1) if len(flat) > k else h[: len(flat) - k]
    out, at = [], 0
    for n in counts:
        if n >= width:
            s = h[at : at + n - width + 1]
            s.sort()  # np.unique() takes four times as long
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], dtype=np.uint64)
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s.view(np.int64))
        at += n
    return out


def _lists(arrays: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, kind)])))


@functools.cache
def run_length(percent: int) -> int:
    """The longest run of common values that the K least of a union of this similarity lack with a chance of at most MISS."""
    p, best = percent / 100, 0
    for run in range(1, 9):
        ends = np.eye(1, run)[0]  # chances of the numbers of common values at the end, none of them a run yet
        for _ in range(K):
            ends = np.concatenate([[ends.sum() * (1 - p)], ends[:-1] * p])
        best = run if ends.sum() <= MISS else best
    if not best:
        raise ValueError(f"sketches of {K} values can't find sets of a similarity of {percent}%")
    return best


@functools.cache
def least_common(percent: int, k: int) -> int:
    """Of the k least values of a union of this similarity, fewer are common with a chance of at most DOUBT."""
    p, fewer = percent / 100, 0.0
    for n in range(k):
        fewer += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if fewer > DOUBT:
            return n
    return k


@functools.cache
def key_runs(percent: int) -> tuple[tuple[int, ...], ...]:
    """For each size up to K, the lengths of the runs that are a set's keys; none for sizes that link to equal sets only.

    The values that only one of two sets has cut the common ones into runs; the longest has at least their mean length.
    """
    longest = run_length(percent)
    out: list[set[int]] = [set() for _ in range(K + 1)]
    for union in range(2, 100 * K // percent + 1):
        for common in range(-(-percent * union // 100), union):
            sure = min(longest, -(-common // (union - common + 1)))
            for n in range(common, min(union, K) + 1):
                out[n].add(sure)
    for n in range(percent * K // 100, K + 1):
        out[n].add(longest)  # for partners larger than K
    return tuple(tuple(sorted(x)) for x in out)


def run_keys(sketch: Column, n: Column, percent: int) -> Column:
    """array<long>: the hash of each run that is a key of a node with n values."""
    run = lambda k: F.transform(F.sequence(F.lit(1), F.size(sketch) - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[F.element_at(sketch, i + j) for j in range(k)]))
    sizes: dict[tuple[int, ...], list[int]] = {}
    for size, lengths in enumerate(key_runs(percent)):
        sizes.setdefault(lengths, []).append(size)
    out = F.when(n > K, run(run_length(percent)))
    for lengths, of in sizes.items():
        out = out.when(n.isin(of), F.concat(*map(run, lengths)) if lengths else F.array().cast("array<long>"))
    return out


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), print (128-bit digest of the set), sketch (its K least values, in unsigned order); tag if docs has it."""
    tagged = ["tag"] if "tag" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                sets = shingle_sets(b.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists([s[:K] for s in sets]), *b.columns[2:]], names=["doc_id", "n", "print", "sketch", *tagged])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows_of(docs, "doc_id", "text", *tagged), run, f"doc_id {kind}, n long, print binary, sketch array<long>" + ", tag string" * len(tagged))


def full_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """node, print, items: the whole sets of the texts of (node, print, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(shingle_sets(b.column(2).to_pylist(), width))], names=["node", "print", "items"])

    return map_batches(docs.select("node", "print", "text"), run, "node long, print binary, items array<long>")


def _linked(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def verified(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The (a, b) of pairs that are links: size filter, union-sketch estimate, then the full sets."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    p = pairs.join(of("a"), "a").join(of("b"), "b")
    p = p.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # sketches are sorted as unsigned values; flipping the sign bit makes sort_array agree
    flip = lambda s: F.transform(s, lambda v: v.bitwiseXOR(F.lit(-(2**63))))
    p = p.withColumn("f_a", flip(F.col("s_a"))).withColumn("f_b", flip(F.col("s_b")))
    p = p.withColumn("union", F.slice(F.sort_array(F.array_union("f_a", "f_b")), 1, K))
    p = p.withColumn("common", F.size(F.array_intersect(F.array_intersect("union", "f_a"), "f_b")).cast("long"))
    p = p.withColumn("whole", (F.col("n_a") <= K) & (F.col("n_b") <= K)).withColumn("all_common", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
    p = p.filter(F.when(F.col("whole"), _linked(F.col("all_common"), F.col("n_a"), F.col("n_b"), percent)).otherwise(F.col("common") >= least_common(percent, K)))
    p = scratch.save(p.select("a", "b", "n_a", "n_b", "whole"))
    large = p.filter(~F.col("whole"))
    needed = large.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.save(_of_nodes(scratch, full_sets, needed, nodes, docs, width))
    items = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"i_{x}"))
    exact = large.join(items("b"), "b").join(items("a"), "a")
    exact = exact.filter(_linked(F.size(F.array_intersect("i_a", "i_b")).cast("long"), F.col("n_a"), F.col("n_b"), percent))
    return scratch.save(p.filter("whole").select("a", "b").union(exact.select("a", "b")))


def _of_nodes(scratch: Scratch, make, needed: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """make(texts, width) for the texts of the needed nodes."""
    # a doc_id may be repeated with other texts: then only the text with the node's tag is the node's
    tagged = ["tag"] if "tag" in docs.columns else []
    first = [F.col(c).alias(f"first_{c}") for c in ["doc_id", *tagged]]
    chosen = scratch.save(nodes.join(needed, "node").select("node", "print", *first))
    ids = F.broadcast(chosen) if chosen.count() <= FEW_IDS else chosen
    same = docs["doc_id"].eqNullSafe(F.col("first_doc_id"))
    for c in tagged:
        same &= docs[c] == F.col(f"first_{c}")
    made = make(docs.join(ids, same), width)
    return made.dropDuplicates(["node"]) if tagged else made


def wide_sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """node, print, items: as full_sets, but the WIDE least values only."""
    return full_sets(docs, width).withColumn("items", F.slice("items", 1, WIDE))


def _medoid(nodes: np.ndarray, values: list[np.ndarray]) -> int:
    """The member whose values are the most common in the group; ties: the least node."""
    sizes = np.array([len(v) for v in values])
    _, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    mean = np.add.reduceat(counts[inverse], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes
    return int(min(np.flatnonzero(mean >= mean.max() - 1e-9), key=lambda i: nodes[i]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups (key, block) of sorted rows, over the ends of batches."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        key, block = t.column(0).to_numpy(), t.column(1).to_numpy()
        start = 0
        for end in np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1:
            yield t.slice(start, end - start)
            start = end
        rest = t.slice(start)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def medoids(dealt: DataFrame) -> DataFrame:
    """key, node, sketch: the medoid of each group (key, block) of rows (key, block, node, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            key, nodes, lists = (g.column(i).chunk(0) for i in (0, 2, 3))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            of = [values[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            i = _medoid(nodes.to_numpy(), of)
            yield pa.RecordBatch.from_arrays([key.slice(i, 1), nodes.slice(i, 1), _lists([of[i]])], names=["key", "node", "sketch"])

    grouped = dealt.select("key", "block", "node", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return map_batches(grouped, run, "key long, node long, sketch array<long>")


def _entries(wide: DataFrame, percent: int) -> DataFrame:
    """v, node, label, n, size, place, small: rows (node, label, n, items) under their first values, from rare to frequent; with bits if wide has them, and the values before.

    Values that nodes of one label alone have come before all others and need no entry. `small`: the
    place is early enough for the smaller set of a pair.
    """
    bits = ["bits"] if "bits" in wide.columns else []
    values = wide.select("node", "label", F.explode("items").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("v", "f")
    met = values.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("met"))  # at most WIDE values
    n, size = F.col("n"), F.col("size")
    # a set of n values that has to share a * n / b of them shares one of the first ones
    first = lambda a, b: F.when(n <= WIDE, n - F.floor((a * n + (b - 1)) / b) + 1).otherwise(0)
    sampled = F.when(100 * n > percent * WIDE, size - (least_common(percent, WIDE) - 1)).otherwise(0)  # for pairs with a set larger than WIDE
    e = wide.select("node", "label", "n", F.size("items").alias("size"), *bits).join(met, "node").withColumn("free", size - F.size("met"))
    e = e.withColumn("as_small", F.greatest(first(2 * percent, 100 + percent), sampled)).withColumn("as_large", F.greatest(first(percent, 100), sampled))
    part = F.slice("met", F.lit(1), F.greatest(F.lit(0), F.col("as_large") - F.col("free")).cast("int"))
    e = e.select("node", "label", "n", "size", "free", "as_small", *bits, part["v"].alias("part")).select("*", F.posexplode("part").alias("at", "v"))
    place = F.col("free") + F.col("at")
    before = [F.slice("part", F.lit(1), F.col("at")).alias("before")] if bits else []
    return e.select("v", "node", "label", "n", "size", place.alias("place"), (place < F.col("as_small")).alias("small"), *bits, *before)


def _bitmaps(wide: DataFrame) -> DataFrame:
    """wide with bits: a map of BITS bits in which each value flips the one that its hash names. Bits that differ are values that only one of two sets has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                items = b.column(3)
                row = np.repeat(np.arange(b.num_rows), items.value_lengths().to_numpy())
                bit = (_mix(items.flatten().to_numpy().view(np.uint64) * _C1) & np.uint64(BITS - 1)).astype(np.int64)
                odd = np.bincount(row * BITS + bit, minlength=b.num_rows * BITS) & 1
                words = np.packbits(odd.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(list(words.reshape(b.num_rows, -1)))], names=["node", "label", "n", "items", "bits"])

    return map_batches(wide.select("node", "label", "n", "items"), run, "node long, label long, n long, items array<long>, bits array<long>")


def _met(e: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries as the smaller (.._a) and the larger (.._b) of pairs: those that may be links share v, band, side, above and cell.

    The label with the most entries under a value is its main one: its entries meet only those of other labels. So
    a large component costs rows in proportion, not with the square of its size. Entries of at least the main label's
    mean size (`above`) meet only those whose place leaves room for a smaller partner of that size. Cells hold some
    SMALL of the smaller and LARGE of the larger ones.
    """
    n, place = F.col("n"), F.col("place")
    band = lambda x: F.floor(F.log(x) / BAND).cast("int")
    room = F.when(n <= WIDE, F.floor((n - place) * (100 + percent) / percent) - n).otherwise(0)  # what is left must do for the largest partner
    room = F.greatest(room, F.when(100 * n > percent * WIDE, F.lit(2**62)).otherwise(0))
    main = e.groupBy("v", "label").agg(F.count("*").alias("f"), F.ceil(F.avg("n")).alias("mean"))
    main = main.groupBy("v").agg(F.max_by(F.struct("label", "mean", "f"), F.struct("f", "label")).alias("main"), F.sum("f").alias("total"))
    main = main.select("v", F.col("main.label").alias("main"), "main.mean", F.col("main.f").alias("own"), (F.col("total") - F.col("main.f")).alias("others"))
    e = e.withColumn("room", room).join(main, "v").withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    large = F.greatest(F.lit(1), F.ceil(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("others")) / LARGE)).cast("int")
    small = F.greatest(F.lit(1), F.ceil((F.when(F.col("side") == 0, 0).otherwise(F.col("own")) + F.col("others")) / SMALL)).cast("int")
    drawn = lambda cells: F.pmod(F.xxhash64("node"), cells).cast("int")
    cols = [c for c in ("node", "label", "n", "size", "place", "bits", "before") if c in e.columns]
    x = e.filter("small").withColumn("most", F.least("room", F.floor(100 * n / percent))).filter("most >= n").withColumn("above", (n >= F.col("mean")).cast("int"))
    x = x.withColumn("side", F.explode(F.when(F.col("side") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    x = x.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), large - 1), lambda i: drawn(small) * large + i)))
    x = x.select("v", "side", "above", "cell", F.explode(F.sequence(band(n), band(F.col("most")))).alias("band"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = e.withColumn("above", F.explode(F.when(F.least("room", "n") >= F.col("mean"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    y = y.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), small - 1), lambda i: i * large + drawn(large))))
    return x, y.select("v", "side", "above", "cell", band(n).alias("band"), *[F.col(c).alias(f"{c}_b") for c in cols])


def crosswise(wide: DataFrame, percent: int, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """a, b: pairs of nodes of different labels that may be links, of rows (node, label, n, items); none that is one is left out (larger than WIDE: but for DOUBT)."""
    x, y = _met(save(_entries(save(_bitmaps(wide)), percent)), percent)
    group = F.xxhash64("v", "side", "above", "cell", "band").alias("group")
    cols = ["node", "label", "n", "size", "place", "bits", "before"]
    rows = y.select(group, F.lit(0).alias("role"), *[F.col(f"{c}_b").alias(c) for c in cols]).union(x.select(group, F.lit(1), *[f"{c}_a" for c in cols]))
    return _ordered(_candidates(rows.repartition("group").sortWithinPartitions("group", "role"), percent))


def _candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: which of a group's smaller sets, role 1, may be linked with which of its larger ones, role 0; a pair under the first of its common values only."""
    overlap = least_common(percent, WIDE)

    def chosen(t: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, label, n, size, place = (t.column(k).to_numpy() for k in range(2, 7))
        words = t.column(7).flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)  # of signed ones, the bits of absolute values are counted

        def enough(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
            return np.where((n[a] <= WIDE) & (n[b] <= WIDE), (100 + percent) * common >= percent * (n[a] + n[b]), common >= overlap)

        fit = (label[a] != label[b]) & ((n[a] < n[b]) | ((n[a] == n[b]) & (node[a] < node[b]))) & (100 * n[a] >= percent * n[b])
        fit &= enough(a, b, np.minimum(size[a] - place[a], size[b] - place[b]))
        a, b = a[fit], b[fit]
        apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        fit = enough(a, b, (size[a] + size[b] - apart) // 2)
        a, b = a[fit], b[fit]
        before = {i: frozenset(t.column(8)[i].as_py()) for i in np.unique(np.concatenate([a, b])).tolist()}
        first = np.array([before[i].isdisjoint(before[k]) for i, k in zip(a.tolist(), b.tolist())], bool)
        return node[a[first]], node[b[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the larger sets of the last group
        for t in batches:
            t = t if rest is None else pa.concat_batches([rest, t])
            if not t.num_rows:
                continue
            group, role = t.column(0).to_numpy(), t.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            larger = np.add.reduceat((role == 0).astype(np.int64), starts)
            of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(group)]))
            small = np.flatnonzero((role == 1) & (larger[of] > 0))
            meets = larger[of[small]]
            ends = np.cumsum(meets)
            cuts = np.searchsorted(ends, np.arange(PAIRS, (ends[-1] if len(ends) else 0) + PAIRS, PAIRS), "left") + 1
            at = 0
            for stop in np.unique(np.minimum(cuts, len(small))).tolist():
                part, many = small[at:stop], meets[at:stop]
                a = np.repeat(part, many)
                b = np.repeat(starts[of[part]] - (np.cumsum(many) - many), many) + np.arange(len(a))
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in chosen(t, a, b)], names=["a", "b"])
            rest = t.slice(starts[-1], larger[-1])

    return map_batches(dealt, run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(scratch: Scratch, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists with several components, with label."""
    tagged = scratch.save(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    split = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    return scratch.save(tagged.join(split, "key"))


def _joined(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links."""
    if links.isEmpty():
        return labels
    return components(scratch, labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs, by sets of `width` words and links of at least `percent`.

    component_id is the smallest doc_id reachable over links (100 * intersection >= percent * union);
    texts without words are linked with nothing. Null texts have no words. Null ids are reachable but
    never the smallest unless alone. Repeated rows are equal sets; a pair of exactly `percent` is
    linked. Whole texts of any length count. An empty table gives an empty result. Other columns of
    docs are never looked at. A percentage too low for sketches of K values is refused.
    """
    docs = rows_of(docs, id_col, text_col).toDF("doc_id", "text")
    if repeated_ids(docs):
        docs = docs.withColumn("tag", text_tag(F.col("text")))
    out = _verdicts(docs, percent, width)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _verdicts(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n, component_id, label (of the component; null without words) of rows (doc_id, text); with tag, which they must have if ids are repeated."""
    scratch = Scratch(docs.sparkSession, "neardup")
    tagged = ["tag"] if "tag" in docs.columns else []
    rows = scratch.save(sketches(docs, width))
    some = rows.filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")) if tagged else F.struct(F.min("doc_id").alias("doc_id"))
    groups = some.groupBy("print", "n").agg(least.alias("least"), F.first("sketch").alias("sketch"))
    groups = groups.select("print", "n", *[F.col(f"least.{c}").alias(c) for c in ["doc_id", *tagged]], "sketch")
    nodes = scratch.save(groups.withColumn("node", F.monotonically_increasing_id()))
    postings = nodes.select("node", F.explode(run_keys(F.col("sketch"), F.col("n"), percent)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("length"), F.min("node").alias("low"), F.max("node").alias("high")).filter("length > 1")
    members = scratch.save(postings.join(lists, "key"))  # only of lists with several members
    stars = members.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    labels = components(scratch, verified(scratch, _ordered(stars), nodes, docs, percent, width))
    # a list of two has met; of longer ones, those that aren't one component yet take their medoid
    longer = members.filter("length > 2").select("key", "node", "length")
    apart = _apart(scratch, longer, labels)
    if not apart.isEmpty():
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col("length") / BLOCK)).cast("int")
        some_of = scratch.save(medoids(apart.withColumn("block", block).join(nodes.select("node", "sketch"), "node")))
        center = scratch.save(medoids(some_of.withColumn("block", F.lit(0))).select("key", F.col("node").alias("b")))
        stars = apart.join(center, "key").select(F.col("node").alias("a"), "b")
        labels = _joined(scratch, labels, verified(scratch, _ordered(stars), nodes, docs, percent, width))
        scratch.drop(apart)
        apart = _apart(scratch, longer, labels)
    if not apart.isEmpty():
        left = scratch.save(apart.select("node", "label").distinct())
        items = _of_nodes(scratch, wide_sketches, left.select("node"), nodes, docs, width).select("node", "items")
        wide = scratch.save(items.join(left, "node").join(nodes.select("node", "n"), "node"))
        labels = _joined(scratch, labels, verified(scratch, crosswise(wide, percent, scratch.save), nodes, docs, percent, width))
    found = nodes.select("print", "n", "node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = found.join(least, "label").select("print", "n", "component_id", "label")
    out = some.select("doc_id", "n", "print", *tagged).join(known, ["print", "n"]).select("doc_id", "n", "component_id", "label", *tagged)
    return out.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"), *tagged))


def kept_documents(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each component; of those without words, one for each id and text."""
    if not repeated_ids(docs):
        return keep_ids(docs, near_duplicates(docs, percent, width).filter("kept"))
    tag = text_tag(F.col("text"))
    found = _verdicts(rows_of(docs, "doc_id", "text").withColumn("tag", tag), percent, width)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows of one component that share its id, or have none, are near copies too
    once = stay.filter("label IS NOT NULL").groupBy("label").agg(F.first("doc_id").alias("doc_id"), F.min("tag").alias("tag"))
    return keep_texts(docs, once.select("doc_id", "tag").union(stay.filter("label IS NULL").select("doc_id", "tag")), tag)
