"""Offsets between normalised and raw text: interval joins with clipping, coverage, validity, exact quotes.

Interval joins go by an equal key (chunk or document) first; overlap is a filter within it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from paperloom.functions.text import LIGATURES, SPACE_CLASS, collapse
from paperloom.io import saved
from paperloom.operators.documents import _CLASS, KINDS, spread

#: Characters of quotes that are looked for in one reading of the texts (some 100 bytes each while they are); more quotes take more readings.
QUOTE_CHARS = 1_000_000
_SPACES = re.compile(r"\s+")


def clip(intervals: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Each interval (key, span, start, stop, source_start) that overlaps a request (key, lo, hi), cut to it and shifted in the source."""
    j = intervals.join(requests, key).filter(F.greatest("start", "lo") < F.least("stop", "hi"))
    left, right = F.greatest("start", "lo"), F.least("stop", "hi")
    return j.select(key, "span", left.alias("start"), right.alias("stop"), (F.col("source_start") + left - F.col("start")).alias("source_start"), (F.col("source_start") + right - F.col("start")).alias("source_stop"))


#: Characters of a bin of the finest level; each level's bins are four times as wide.
BIN, LEVELS = 64, 15


def _dealt(rows: DataFrame, start: str, stop: str, levels: list[int] | None, coarser: int = 0) -> DataFrame:
    """Rows with level__ and bin__: at the level whose bins hold them in two at most, or at all of levels from `coarser` above it."""
    at = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")) if levels is not None else F.col("own__")
    r = rows.withColumn("level__", at).filter(F.col("level__") >= F.col("own__") + (coarser if levels is not None else 0))
    wide = F.expr(f"shiftleft({BIN}L, 2 * level__)")
    return r.withColumn("bin__", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor((F.col(stop) - 1) / wide))))


def overlaps(intervals: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """All columns of intervals (key, start, stop, ...) and requests (key, lo, hi, ...) for each pair of a key that overlaps, once.

    Both are dealt to bins of a key's offsets, so a key with a million intervals is many small joins, not one. A long interval lies
    in few wide bins of a coarser level; a pair meets at the level of its longer one, in the bin of its later
    start. Short ones go up to the levels that the other side really has (16 at most), and never meet each other there. Empty intervals and rows
    with a null key or bound overlap nothing. Other columns may not have the same name on both sides.
    """

    def ready(rows: DataFrame, start: str, stop: str) -> DataFrame:
        length = F.col(stop) - F.col(start)
        own = sum((F.when(length > BIN * 4**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
        return rows.filter(F.col(key).isNotNull() & (length > 0)).withColumn("own__", own)

    a, b = ready(intervals, "start", "stop"), ready(requests, "lo", "hi")
    of_a, of_b = (sorted(t.agg(F.collect_set("own__")).first()[0]) for t in (a, b))  # 16 numbers at most
    later = F.floor(F.greatest("start", "lo") / F.expr(f"shiftleft({BIN}L, 2 * level__)"))
    meet = (F.greatest("start", "lo") < F.least("stop", "hi")) & (F.col("bin__") == later)
    on = [key, "level__", "bin__"]
    longer = _dealt(a, "start", "stop", None).drop("own__").join(_dealt(b, "lo", "hi", of_a).drop("own__"), on).filter(meet)
    shorter = _dealt(a, "start", "stop", of_b, 1).drop("own__").join(_dealt(b, "lo", "hi", None).drop("own__"), on).filter(meet)
    return longer.unionByName(shorter).drop("level__", "bin__")


def clip_binned(intervals: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """`clip` for keys with very many intervals and requests."""
    left, right = F.greatest("start", "lo"), F.least("stop", "hi")
    source = F.col("source_start") - F.col("start")
    return overlaps(intervals, requests, key).select(key, "span", left.alias("start"), right.alias("stop"), (source + left).alias("source_start"), (source + right).alias("source_stop"))


def mapping_defects(mappings: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, mapping, defect of mappings (key, mapping, kind, start, stop, source_start, source_stop) that break: `outside` without a span (key, lo, hi) of the source that holds all of it, `length` for an identity of two lengths.

    A mapping of an empty source lies in a span that it touches. Null bounds are outside. (key, mapping) tells mappings apart.
    """
    a, b = F.col("source_start"), F.col("source_stop")
    touched = mappings.select(key, "mapping", a.alias("a__"), b.alias("b__"), F.when(a == b, a - 1).otherwise(a).alias("start"), F.when(a == b, b + 1).otherwise(b).alias("stop"))
    held = overlaps(touched, spans.select(key, "lo", "hi"), key).filter((F.col("lo") <= F.col("a__")) & (F.col("b__") <= F.col("hi"))).select(key, "mapping")
    out = mappings.join(held, [key, "mapping"], "left_anti").select(key, "mapping", F.lit("outside").alias("defect"))
    uneven = mappings.filter((F.col("kind") == "identity") & (F.col("stop") - F.col("start") != b - a)).select(key, "mapping", F.lit("length").alias("defect"))
    return out.union(uneven)


def merge_adjacent(fragments: DataFrame, key: str) -> DataFrame:
    """Fragments (key, span, start, stop, source_start, source_stop): neighbours of one span that touch in the source become one."""
    order = Window.partitionBy(key).orderBy("start")
    touches = (F.lag("span").over(order) == F.col("span")) & (F.lag("source_stop").over(order) == F.col("source_start"))
    f = fragments.withColumn("new", F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1))
    f = f.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy(key, "island", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("source_start").alias("source_start"), F.max("source_stop").alias("source_stop")).drop("island")


def covers(mappings: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """key, ok: mappings (key, ordinal, start, stop) tile [0, length) of lengths (key, length) without gap or overlap."""
    order = Window.partitionBy(key).orderBy("ordinal")
    m = mappings.withColumn("fits", F.col("start") == F.coalesce(F.lag("stop").over(order), F.lit(0)))
    g = m.groupBy(key).agg(F.every("fits").alias("fits"), F.max("stop").alias("stop"))
    j = lengths.join(g, key, "left")
    return j.select(key, F.when(F.col("length") == 0, F.col("stop").isNull() | (F.col("stop") == 0)).otherwise(F.coalesce(F.col("fits") & (F.col("stop") == F.col("length")), F.lit(False))).alias("ok"))


def mapping_valid(kind: Column, start: Column, stop: Column, source_start: Column, source_stop: Column, text: Column, raw: Column) -> Column:
    """Does one mapping hold? Each kind has its own law; separators have no source."""
    part, origin = F.substr(text, start + 1, stop - start), F.substr(raw, source_start + 1, source_stop - source_start)
    blank = lambda c: c.rlike(f"^{SPACE_CLASS}+$")
    ligature = F.lit(False)
    for one, many in LIGATURES.items():
        ligature = ligature | ((origin == one) & (part == many))
    sourced = (source_start >= 0) & (source_start < source_stop) & (source_stop <= F.char_length(raw))
    law = (
        F.when(kind == "separator", source_start.isNull() & source_stop.isNull() & (start < stop) & blank(part))
        .when(kind == "identity", sourced & (part == origin))
        .when(kind == "whitespace", sourced & blank(origin) & (part == " "))
        .when(kind == "ligature", sourced & ligature)
        .when(kind == "dehyphenation", sourced & (origin == "-") & (start == stop))
    )
    return F.coalesce((start >= 0) & (start <= stop) & (stop <= F.char_length(text)) & law, F.lit(False))


#: Pieces of a span in a chunk: their text, and for each mapping how far it begins behind the one before and how long it is, there and in the source.
PIECES = "piece string, gap array<int>, size array<int>, source_gap array<int>, source_size array<int>, kind array<tinyint>"


def span_pieces(chunks: DataFrame) -> DataFrame:
    """doc, span and PIECES, of chunks (doc, text, mappings): one row for each stretch of a chunk's mappings that lead to one span, in numbers that are small or alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                m = b.column(2).flatten()
                span = m.field("span")
                sourced = span.is_valid()
                chunk = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().fill_null(0).to_numpy())[sourced.to_numpy(zero_copy_only=False)]
                m, span = m.filter(sourced), span.filter(sourced).to_numpy()
                start, stop, source_start, source_stop = (m.field(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("start", "stop", "source_start", "source_stop"))
                kind = pc.index_in(m.field("kind"), pa.array(KINDS)).fill_null(-1).to_numpy().astype(np.int8)
                fresh = np.ones(len(span), bool)
                fresh[1:] = (chunk[1:] != chunk[:-1]) | (span[1:] != span[:-1])
                first = np.flatnonzero(fresh)
                if not len(first):
                    continue
                low, high = np.minimum.reduceat(start, first), np.maximum.reduceat(stop, first)
                texts, chunk_of = b.column(1).to_pylist(), chunk[first].tolist()
                piece = [texts[c][max(x, 0) : y] for c, x, y in zip(chunk_of, low.tolist(), high.tolist(), strict=True)]
                gap, source_gap = start.copy(), source_start.copy()
                gap[1:] -= stop[:-1]
                gap[first] = start[first] - np.maximum(low, 0)
                source_gap[1:] -= source_stop[:-1]
                source_gap[first] = source_start[first]
                offsets = pa.array(np.append(first, len(span)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((gap, pa.int32()), (stop - start, pa.int32()), (source_gap, pa.int32()), (source_stop - source_start, pa.int32()), (kind, pa.int8()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(chunk_of)), pa.array(span[first]), pa.array(piece, pa.string()), *lists], names=["doc", "span", "piece", "gap", "size", "source_gap", "source_size", "kind"])

    kind = chunks.schema["doc"].dataType.simpleString()
    return chunks.select("doc", "text", "mappings").mapInArrow(run, f"doc {kind}, span long, {PIECES}")


def _along(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each of so many lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _behind(steps: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running sums of the steps, from 0 in each group; groups are numbered and stand together."""
    total = np.cumsum(steps)
    first = np.searchsorted(of, of)
    return total - (total - steps)[first]


def judged(spans: DataFrame) -> DataFrame:
    """doc, span, raw, wrong of spans (doc, span, raw_text, pieces: array of PIECES): what the mappings lead to, read from the raw text in its order, each place once, and how many of them break the law of their kind (as `mapping_valid` has it)."""

    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                raws, parts = b.column(2).to_pylist(), b.column(3).flatten()
                pieces = parts.field("piece").to_pylist()
                (raw, raw_at), (text, text_at) = codes(raws), codes(pieces)
                row_of_part = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
                part = np.repeat(np.arange(len(pieces)), parts.field("gap").value_lengths().to_numpy())
                gap, size, source_gap, source_size, kind = (parts.field(c).flatten().to_numpy().astype(np.int64) for c in ("gap", "size", "source_gap", "source_size", "kind"))
                row = row_of_part[part]
                stop, source_stop = _behind(gap + size, part), _behind(source_gap + source_size, part)
                start, source_start = stop - size, source_stop - source_size
                n_raw, n_text = np.diff(raw_at)[row], np.diff(text_at)[part]
                sound = (source_start >= 0) & (source_size > 0) & (source_stop <= n_raw) & (start >= 0) & (size >= 0) & (stop <= n_text)
                at, source_at = text_at[part] + start, raw_at[row] + source_start
                good = np.zeros(len(part), bool)
                # identity: every character is the source's
                i = np.flatnonzero(sound & (kind == KINDS.index("identity")) & (size == source_size))
                other = np.concatenate([[0], np.cumsum(text[_along(size[i], at[i])] != raw[_along(size[i], source_at[i])])])
                ends = np.cumsum(size[i])
                good[i] = other[ends] == other[ends - size[i]]
                # white space: one space of nothing but white space
                i = np.flatnonzero(sound & (kind == KINDS.index("whitespace")) & (size == 1))
                blank = np.concatenate([[0], np.cumsum(_CLASS[np.minimum(raw, 0xFFFF)] == 1)])
                good[i] = (text[at[i]] == 32) & (blank[source_at[i] + source_size[i]] - blank[source_at[i]] == source_size[i])
                for k in np.flatnonzero(sound & (kind == KINDS.index("ligature")) & (source_size == 1)):
                    good[k] = pieces[part[k]][start[k] : stop[k]] == LIGATURES.get(chr(raw[source_at[k]]))
                i = np.flatnonzero(sound & (kind == KINDS.index("dehyphenation")) & (source_size == 1) & (size == 0))
                good[i] = raw[source_at[i]] == ord("-")
                # what is read of each text
                low, high = np.clip(source_start, 0, n_raw), np.clip(source_stop, 0, n_raw)
                read = np.flatnonzero(low < high)
                depth = np.bincount(raw_at[row[read]] + low[read], minlength=len(raw) + 1) - np.bincount(raw_at[row[read]] + high[read], minlength=len(raw) + 1)
                held = np.cumsum(depth[:-1]) > 0
                count = np.concatenate([[0], np.cumsum(held)])[raw_at]
                if held.all():
                    out = raws
                else:
                    kept = raw[held].tobytes()
                    out = [kept[4 * x : 4 * y].decode("utf-32-le") for x, y in zip(count[:-1].tolist(), count[1:].tolist(), strict=True)]
                wrong = np.bincount(row[~good], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(wrong, pa.int32())], names=["doc", "span", "raw", "wrong"])

    kind = spans.schema["doc"].dataType.simpleString()
    return spans.select("doc", "span", "raw_text", "pieces").mapInArrow(run, f"doc {kind}, span long, raw string, wrong int")


def _fragments(asked: DataFrame, mappings: DataFrame) -> DataFrame:
    """chunk, lo, hi, at, span, a, b, bad of what requests (chunk, lo, hi) take of the mappings: touching pieces of a span are one, `at` is their order; bad if it cuts what isn't the identity."""
    key = ["chunk", "lo", "hi"]
    hit = ((F.col("start") == F.col("stop")) & (F.col("lo") < F.col("start")) & (F.col("start") < F.col("hi"))) | (F.greatest("start", "lo") < F.least("stop", "hi"))
    j = asked.join(mappings.filter("kind != 'separator'"), "chunk").filter(hit)
    same, empty = F.col("kind") == "identity", F.col("start") == F.col("stop")
    cut = ~empty & ((F.col("lo") > F.col("start")) | (F.col("hi") < F.col("stop")))
    a = F.when(same, F.col("source_start") + F.greatest("start", "lo") - F.col("start")).otherwise(F.col("source_start")).cast("int")
    b = F.when(same, F.col("source_start") + F.least("stop", "hi") - F.col("start")).otherwise(F.col("source_stop")).cast("int")
    j = j.select(*key, "ordinal", "span", a.alias("a"), b.alias("b"), (cut & ~same).alias("bad"))
    order = Window.partitionBy(*key).orderBy("ordinal")
    touches = (F.lag("span").over(order) == F.col("span")) & (F.lag("b").over(order) == F.col("a"))
    j = j.withColumn("new", F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1)).withColumn("at", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return j.groupBy(*key, "at", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("bad").alias("bad"))


def resolve_ranges(mappings: DataFrame, requests: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """chunk, lo, hi, status, fragments for requests (chunk, lo, hi) over mappings (chunk, ordinal, start, stop, span, source_start, source_stop, kind).

    Identity may be cut; any other kind only whole, else the request is unresolved. A deletion counts
    only strictly inside. Touching fragments of a span are one, in order. A fragment is (span, a, b), and with
    spans (span, page_index, raw_text, boxes) also its page_index, quote and boxes, one for each character (none if spans have none); a
    span that isn't there leaves the request unresolved. Requests are a set: repeated ones are answered once.
    """
    key = ["chunk", "lo", "hi"]
    asked = requests.select(*key).distinct()
    f = _fragments(asked, mappings)
    part = ["span", "a", "b"]
    if spans is not None:
        boxed = ["boxes"] * ("boxes" in spans.columns)
        f = f.join(spans.select("span", "page_index", "raw_text", *boxed), "span", "left")
        n = F.col("b") - F.col("a")
        f = f.withColumn("quote", F.substr("raw_text", F.col("a") + 1, n)).withColumn("bad", F.col("bad") | F.col("raw_text").isNull())
        f = f.withColumn("boxes", F.slice("boxes", F.col("a") + 1, n)) if boxed else f
        part += ["page_index", "quote", *boxed]
    parts = F.sort_array(F.collect_list(F.struct("at", F.struct(*part).alias("f"))))
    g = f.groupBy(*key).agg(F.max("bad").alias("bad"), F.transform(parts, lambda x: x["f"]).alias("fragments"))
    out = asked.join(g, key, "left")
    ok = F.coalesce(~F.col("bad") & (F.col("lo") >= 0) & (F.col("lo") < F.col("hi")), F.lit(False))
    none = F.array().cast(g.schema["fragments"].dataType)
    return out.select(*key, F.when(ok, "resolved").otherwise("unresolved").alias("status"), F.when(ok, F.col("fragments")).otherwise(none).alias("fragments"))


def collapsed(raw: str) -> tuple[str, list[int], list[int]]:
    """The text with each run of white space as one space, where the runs of several characters are in it, and what they and those before are longer than that."""
    at, more, extra = [], [], 0
    for m in _SPACES.finditer(raw):
        if (n := m.end() - m.start()) > 1:
            at.append(m.start() - extra)
            extra += n - 1
            more.append(extra)
    return _SPACES.sub(" ", raw), at, more


def raw_place(place: int, at: list[int], more: list[int]) -> int:
    """The place in the raw text of a place in its collapsed text."""
    i = bisect_left(at, place)
    return place + (more[i - 1] if i else 0)


def quote_matches(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id, start, status, raw_start, raw_stop of every text that holds a quote: `unique`, or `ambiguous` if it occurs again.

    White space runs are equal, case is not; start is in the trimmed text with runs as one space, raw_start
    and raw_stop are in the text itself. A second occurrence may overlap the first. Quotes are a stated set:
    an automaton of up to QUOTE_CHARS characters of them reads each text once, whatever their number. Without quotes there are no matches.
    """
    q = quotes.select("item_id", collapse(F.col("text")).alias("quote")).filter("quote != ''")
    sums = Window.orderBy("item_id", "quote").rowsBetween(Window.unboundedPreceding, 0)  # the stated set only
    stated = q.withColumn("block", F.floor((F.sum(F.char_length("quote")).over(sums) - 1) / QUOTE_CHARS)).collect()
    blocks: dict[int, dict[str, list]] = {}
    for row in stated:
        blocks.setdefault(row["block"], {}).setdefault(row["quote"], []).append(row["item_id"])
    rows = spread(texts.select("doc_id", "text").filter("text IS NOT NULL"))
    item, doc = quotes.schema["item_id"].dataType.simpleString(), texts.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {item}, doc_id {doc}, start int, status string, raw_start int, raw_stop int"
    if not blocks:
        return rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.union, [_found(rows, block, schema) for block in blocks.values()])


def _found(rows: DataFrame, quotes: dict[str, list], schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(quotes)
    target = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = ahocorasick.Automaton()
        for quote, items in shared.value.items():
            finder.add_word(quote, (len(quote), items))
        finder.make_automaton()
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                plain, at, more = collapsed(raw)
                lead = len(plain) - len(plain.lstrip())
                found: dict[int, tuple[int, int, list, bool]] = {}
                for end, (n, items) in finder.iter(plain):
                    start = end - n + 1
                    found[id(items)] = (start, n, items, False) if id(items) not in found else (*found[id(items)][:3], True)
                for start, n, items, again in found.values():
                    raw_at = raw_place(start, at, more), raw_place(start + n, at, more)
                    out += [(item, doc, start - lead, "ambiguous" if again else "unique", *raw_at) for item in items]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(target)], names=["item_id", "doc_id", "start", "status", "raw_start", "raw_stop"])

    return rows.mapInArrow(run, schema)


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))
def unique_place(raw: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """Where a quote stands in a raw text if it does exactly once, white space runs being equal; else nulls. For single excerpts, not for scans."""

    last: tuple[str | None, tuple[str, list[int], list[int]]] = None, ("", [], [])

    def place(r: str | None, q: str | None) -> tuple[int | None, int | None]:
        nonlocal last
        if not r or not q:
            return None, None
        if last[0] != r:  # quotes of one text stand next to each other
            last = r, collapsed(r)
        (plain, at, more), wanted = last[1], _SPACES.sub(" ", q)
        first = plain.find(wanted)
        if first < 0 or plain.find(wanted, first + 1) >= 0:
            return None, None
        return raw_place(first, at, more), raw_place(first + len(wanted), at, more)

    return pd.DataFrame([place(r, q) for r, q in zip(raw, quote, strict=True)], columns=["start", "stop"], dtype="Int32")


def evidence_labels(hits: DataFrame, key: str, at_most: int = 5, budget: int = 12_000) -> DataFrame:
    """key, ref (S1, S2, ... in order of rank), chunk, ok: whether the key's hits (rank, chunk, n_text, n_raw) are a catalog: few enough, none without source, within both budgets."""
    w = Window.partitionBy(key)
    ok = (F.count("*").over(w) <= at_most) & (F.sum("n_text").over(w) <= budget) & (F.sum("n_raw").over(w) <= budget) & (F.min("n_raw").over(w) > 0)
    return hits.select(key, F.concat(F.lit("S"), F.row_number().over(w.orderBy("rank")).cast("string")).alias("ref"), "chunk", ok.alias("ok"))


def resolve_citations(proposals: DataFrame, chunks: DataFrame, mappings: DataFrame, spans: DataFrame, limit: int = 2000, boxes: Column | None = None) -> DataFrame:
    """citation, status, part, page, quote, boxes, fragments: proposals (citation, chunk, quote) traced to their pages.

    The chunk (chunk, length) is resolved as a whole to its sources' raw text; the quote must stand in that
    exactly once. Its characters lead back to fragments of spans, which must not cut through a ligature or a
    white space run of the mappings. There is one part for each run of fragments on a page, with page
    number, quote and a box for each character; a part above the limit leaves the citation unresolved.
    Unresolved ones have one row without a part, unknown chunks too. `boxes` makes a span's boxes of its other columns (but page_index
    and raw_text); they are then made where the citation is, not shuffled. Without it, spans have a column of that name.
    """
    boxes = F.col("boxes") if boxes is None else boxes
    whole = chunks.join(proposals.select("chunk"), "chunk", "left_semi").groupBy("chunk").agg(F.max("length").cast("int").alias("hi")).filter("hi > 0")
    f = _fragments(whole.select("chunk", F.lit(0).alias("lo"), "hi"), mappings).join(spans.select("span", "page_index", "raw_text"), "span", "left")
    f = f.select("chunk", "at", "span", "page_index", "a", F.substr("raw_text", F.col("a") + 1, F.col("b") - F.col("a")).alias("quote"), (F.col("bad") | F.col("raw_text").isNull()).alias("bad")).withColumn("n", F.char_length("quote"))
    # texts come to their chunk once: what follows, up to the place of each quote, goes by chunk alone
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("at", "span", "page_index", "a", "n", "ahead", "quote")))
    source = f.withColumn("ahead", ahead).groupBy("chunk").agg(F.max("bad").alias("bad"), rows.alias("rows")).filter("NOT bad")
    source = source.select("chunk", F.transform("rows", lambda r: r.dropFields("quote")).alias("fragments"), F.array_join(F.transform("rows", lambda r: r["quote"]), "").alias("raw"))
    placed = proposals.join(source, "chunk", "left").withColumn("p", unique_place("raw", "quote"))
    # of the chunk's text only what is cited goes on
    lo, hi = F.col("p.start"), F.col("p.stop")
    x, y = (lambda r: F.greatest(F.lit(0), lo - r["ahead"])), (lambda r: F.least(r["n"], hi - r["ahead"]))
    within = F.filter("fragments", lambda r: x(r) < y(r))
    cited = F.transform(within, lambda r: F.struct(r["at"].alias("at"), r["span"].alias("span"), r["page_index"].alias("page_index"), (r["a"] + x(r)).alias("a"), (r["a"] + y(r)).alias("b"), F.substr("raw", r["ahead"] + x(r) + 1, y(r) - x(r)).alias("quote")))
    f = saved(placed.select("citation", "chunk", F.explode_outer(F.when(lo.isNotNull(), cited)).alias("f")).select("citation", "chunk", "f.*"), "citations")
    # every character comes from a mapping, and a mapping that isn't the identity is taken whole; texts and boxes stay behind until that is known
    light = f.drop("quote").filter("at IS NOT NULL")
    m = mappings.filter("span IS NOT NULL").select("chunk", "span", "source_start", "source_stop", "kind")
    met = light.join(m, ["chunk", "span"]).filter(F.greatest("a", "source_start") < F.least("b", "source_stop"))
    cut = (F.col("kind") != "identity") & ((F.col("source_start") < F.col("a")) | (F.col("source_stop") > F.col("b")))
    held = met.groupBy("citation", "at").agg(F.sum(F.least("b", "source_stop") - F.greatest("a", "source_start")).alias("held"), F.max(cut).alias("cut"))
    light = light.join(spans.select("span", F.size(boxes).alias("n_boxes")), "span").join(held, ["citation", "at"], "left")
    good = F.coalesce((F.col("held") == F.col("b") - F.col("a")) & ~F.col("cut") & (F.col("n_boxes") >= F.col("b")), F.lit(False))
    order, part = Window.partitionBy("citation").orderBy("at"), Window.partitionBy("citation", "part")
    light = light.withColumn("new", F.when(F.lag("page_index").over(order).eqNullSafe(F.col("page_index")), 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    light = light.withColumn("fits", good & (F.sum(F.col("b") - F.col("a")).over(part) <= limit)).withColumn("alone", F.count("*").over(part) == 1)
    light = light.withColumn("fits", F.every("fits").over(Window.partitionBy("citation"))).filter("fits")
    light = saved(light.select("citation", "at", "span", "part", (F.col("page_index") + 1).alias("page"), "alone"), "parts")

    def boxed(of: Column) -> DataFrame:
        """The cited fragments of such parts with their boxes. Boxes are many times their text: only cited spans bring theirs."""
        r = f.filter("at IS NOT NULL").drop("chunk", "page_index").join(light.filter(of).drop("span"), ["citation", "at"])
        held = spans.drop("page_index", "raw_text").join(light.filter(of).select("span").distinct(), "span", "left_semi")
        return r.join(held, "span").withColumn("boxes", F.slice(boxes, F.col("a") + 1, F.col("b") - F.col("a")))

    # a part of one fragment has its boxes where they join it; only the others' are brought together
    resolved, piece = F.lit("resolved").alias("status"), ["span", "a", "b"]
    one = boxed(F.col("alone")).select("citation", resolved, "part", "page", "quote", "boxes", F.array(F.struct(*piece)).alias("fragments"))
    many = boxed(~F.col("alone")).groupBy("citation", "part", "page").agg(F.sort_array(F.collect_list(F.struct("at", *piece, "quote", "boxes"))).alias("rows"))
    many = many.select("citation", resolved, "part", "page", F.array_join(F.transform("rows", lambda r: r["quote"]), "").alias("quote"), F.flatten(F.transform("rows", lambda r: r["boxes"])).alias("boxes"), F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in piece])).alias("fragments"))
    not_placed = f.filter("at IS NULL").select("citation")
    left = not_placed.union(f.filter("at IS NOT NULL").select("citation").distinct().join(light.select("citation"), "citation", "left_anti"))
    none = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in ("part", "page", "quote", "boxes", "fragments")]
    return one.unionByName(many).unionByName(left.select("citation", F.lit("unresolved").alias("status"), *none))


def spans_on_pages(spans: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """span, raw_text, boxes, page_index, block_box, page_box of the spans (doc, span, block, raw_text, boxes) whose block (doc, block, page, box, excluded) is not excluded and whose page (doc, page, page_index, page_box) is known."""
    b = blocks.filter(~F.coalesce("excluded", F.lit(False))).select("doc", "block", "page", F.col("box").alias("block_box"))
    return spans.join(b, ["doc", "block"]).join(pages.select("doc", "page", "page_index", "page_box"), ["doc", "page"]).select("doc", "span", "raw_text", "boxes", "page_index", "block_box", "page_box")


#: So many rows at most, on average, are sorted or grouped by one task.
TASK_ROWS = 500_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for a shuffle of rows: one for each core, more if they would get more than TASK_ROWS. Counts the rows, which files know."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def stored_citations(citations: DataFrame, runs: DataFrame, ideas: DataFrame, sources: DataFrame, pages: DataFrame, publications: DataFrame) -> DataFrame:
    """The citations whose whole origin holds: a completed run, an idea and a source of that run, the very page, and a publication under the source's profile.

    citations (owner, citation, run, idea, doc, page_id, page), runs (owner, run, state), ideas (owner, run, idea), sources (owner, run, doc,
    profile), pages (owner, doc, page_id, page_index), publications (owner, doc, profile). Each join is dealt to as many tasks as the
    citations need (`tasks_for`), the other side follows; so what a task holds doesn't grow with the tables.
    """
    tasks = tasks_for(citations)
    held = lambda j, other, *keys: j.repartition(tasks, *keys).join(other, [*keys])
    done = runs.filter("state = 'completed'").select("owner", "run")
    at = pages.select("owner", "doc", "page_id", (F.col("page_index") + 1).alias("page"))
    j = held(citations, done, "owner", "run")
    j = held(j, ideas.select("owner", "run", "idea"), "owner", "run", "idea")
    j = held(j, sources.select("owner", "run", "doc", "profile"), "owner", "run", "doc")
    j = held(j, at, "owner", "doc", "page_id", "page")
    return held(j, publications.select("owner", "doc", "profile"), "owner", "doc", "profile").select(*citations.columns, "profile")


def citations_by_page(fragments: DataFrame, limit: int = 2000) -> DataFrame:
    """Fragments (citation, ordinal, page_index, quote) grouped by runs of one page: citation, part, page, quote, ok (length within limit)."""
    order = Window.partitionBy("citation").orderBy("ordinal")
    new = F.when(F.lag("page_index").over(order).eqNullSafe(F.col("page_index")), 0).otherwise(1)
    f = fragments.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = f.groupBy("citation", "part").agg((F.first("page_index") + 1).alias("page"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "quote"))), lambda x: x["quote"]), "").alias("quote"))
    return g.withColumn("ok", F.char_length("quote").between(1, limit))


def revalidate_citations(stored: DataFrame, spans: DataFrame) -> DataFrame:
    """citation, ok: quote (and boxes, if both tables have them) of (citation, span, source_start, source_stop, quote, boxes) are still what the span holds."""
    boxed = "boxes" in stored.columns and "boxes" in spans.columns
    j = stored.join(spans.select("span", "raw_text", *([F.col("boxes").alias("now_boxes")] if boxed else [])), "span", "left")
    a, n = F.col("source_start"), F.col("source_stop") - F.col("source_start")
    ok = (F.substr("raw_text", a + 1, n) == F.col("quote")) & (a >= 0) & (n > 0) & (F.col("source_stop") <= F.char_length("raw_text"))
    if boxed:
        ok &= F.slice("now_boxes", F.greatest(a, F.lit(0)) + 1, F.greatest(n, F.lit(0))).eqNullSafe(F.col("boxes"))
    return j.groupBy("citation").agg(F.every(F.coalesce(ok, F.lit(False))).alias("ok"))
