"""Periodic runs of words by block matching.

A run of period q in [s, 2s), s a power of two, that lasts four periods holds a block of s words that
starts at a multiple of s and stands again q words later. So for each s the aligned blocks of a text
become the keys of an automaton over integer sequences, which is searched through the words; an
occurrence s to 2s - 1 words after an aligned block of the same words seeds an exact extension to both
sides. A stretch that is found with a multiple of its period is the same stretch, so the least period stays.

Where no run can be, nothing is searched: in a run of period q each word after the first q occurred at
most q words before, so at a scale only stretches of at least 3s words of which each occurred less
than 2s before, and the 2s - 1 words ahead of them, can hold runs. That leaves out no run.

Texts are independent of each other: nothing is shuffled, and a task holds one Arrow batch of texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_crc, map_batches, rows_of

LEAST_LENGTH, LEAST_PERIODS = 6, 4
WORD = r"([^\x20\x09-\x0D]+)"


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal stretches [i, j) of true entries with at least so many."""
    gaps = np.concatenate([[-1], np.flatnonzero(~mask), [len(mask)]])
    long = np.flatnonzero(np.diff(gaps) > least)
    return [(int(gaps[k]) + 1, int(gaps[k + 1])) for k in long]


def _seeds(codes: list[int], lo: int, hi: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """p, q: aligned blocks at p in [lo, hi) that stand again at p + q, q in [s, 2s)."""
    none = np.zeros(0, np.int64)
    first = -(-lo // s) * s
    starts = range(first, hi - s + 1, s)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    name = []  # of each aligned block: the number of the first equal one
    for p in starts:
        key = tuple(codes[p : p + s])
        found = automaton.get(key, -1)
        if found < 0:
            found = len(name)
            automaton.add_word(key, found)
        name.append(found)
    if not name:
        return none, none
    automaton.make_automaton()
    hits = np.fromiter(itertools.chain.from_iterable(automaton.iter(tuple(codes[lo:hi]))), np.int64).reshape(-1, 2)
    at = hits[:, 0] + lo - s + 1  # blocks have one length, so at most one ends at a word
    k = (at - s) // s - first // s  # the one aligned block that starts s to 2s - 1 words before
    inside = k >= 0
    at, k, block = at[inside], k[inside], hits[inside, 1]
    same = np.array(name)[k] == block
    p = first + k[same] * s
    return p, at[same] - p


def _reach(words: np.ndarray, i: int, q: int, step: int) -> int:
    """How far from i (i itself included) words equal the ones q words on, going by step, in pieces of growing size."""
    n, size, done = len(words) - q, 64, 0
    while True:
        a, z = (i + done, min(n, i + done + size)) if step > 0 else (max(0, i - done - size + 1), i - done + 1)
        if a >= z:
            return done
        equal = words[a:z] == words[a + q : z + q]
        if not equal.all():
            return done + int(np.argmin(equal if step > 0 else equal[::-1]))
        done, size = done + z - a, size * 4


def periodic_stretches(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of whole numbers, by start, then period."""
    n = len(codes)
    if n < LEAST_LENGTH:
        return []
    words = np.array(codes)
    order = np.argsort(words, kind="stable")
    before = np.full(n, n)
    again = words[order[1:]] == words[order[:-1]]
    before[order[1:][again]] = (order[1:] - order[:-1])[again]  # words since the same word, n for the first
    found: dict[tuple[int, int], int] = {}
    s = 1
    while LEAST_PERIODS * s <= n:
        parts = _stretches(before < 2 * s, max(3 * s, LEAST_LENGTH - 1))
        if parts:
            inside = np.full(n, -1)  # the longest run known so far at a word
            known = sorted(found, key=lambda r: r[1] - r[0])
            for k, (a, z) in enumerate(known):
                inside[a:z] = k
            ends, periods = np.array([z for _, z in known] or [0]), np.array([found[r] for r in known] or [1])
        for i, j in parts:
            p, q = _seeds(codes, max(0, i - 2 * s + 1), j, s)
            run = inside[p]
            p, q = (x[~((run >= 0) & (p + q + s <= ends[run]) & (q % periods[run] == 0))] for x in (p, q))  # a multiple of a known period
            order = np.lexsort((p, q))
            last, upto = 0, 0
            for at, period in zip(p[order].tolist(), q[order].tolist()):
                if period == last and at + period < upto:
                    continue
                start = at - _reach(words, at - 1, period, -1)
                end = at + period + _reach(words, at, period, 1)
                last, upto = period, end
                if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * period):
                    found[start, end] = min(period, found.get((start, end), period))
        s *= 2
    return sorted(((a, z - a, q) for (a, z), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if not runs else itertools.compress(words, keep))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs array<struct<start,length,period>>, collapsed: one row per row of docs.

    A run is a stretch of words of smallest period q and a length of at least max(6, 4 * q) that can't be
    extended; runs come by start, then period. `collapsed` has the words by single spaces without those
    that lie in a run after its first q words. Words are as written, case included. Null and blank texts have no words, no
    runs and an empty `collapsed`. Whole texts of any length are searched. Null ids and repeated rows are
    rows like others. An empty table gives an empty result. Other columns are never looked at.
    """
    docs = rows_of(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                counts, offsets, runs, left = [], [0], [], []
                for text in b.column(1).cast(pa.binary()):
                    words = (text.as_py() or b"").split()  # bytes: the six gaps
                    code: dict[bytes, int] = {}
                    own = periodic_stretches(list(map(code.setdefault, words, range(len(words)))))  # a word's first place is its number
                    counts.append(len(words))
                    runs += own
                    offsets.append(len(runs))
                    left.append(collapsed_words(words, own))
                spans = pa.StructArray.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as fractions; of equal ones the first. Null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (four nulls without runs) and digests of all runs and of the collapsed text, of periodic_runs()."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of rows whose crc32 of the id in decimal ends in 0, the words from place a on repeat with period p, as the other digits say; a row without an id stays as it is."""
    words, h = F.regexp_extract_all(F.col("text"), F.lit(WORD), 1), id_crc(F.col("doc_id"))
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    d = rows_of(docs, "doc_id", "text").withColumn("words", F.when(chosen, words)).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("words"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))
