"""Periodic runs against every period at every word, the planted queries, and odd texts."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import periodic
from paperloom.llm.queries import op13_periodic_runs


def brute_runs(words):
    """Every maximal stretch for every period, the least period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, z - a, q) for (a, z), q in found.items()), key=lambda r: (r[0], r[2]))


def test_sequences():
    rnd = random.Random(7)
    for trial in range(1500):
        kinds = rnd.choice([1, 2, 2, 3, 5, 50])
        seq = []
        while len(seq) < rnd.choice([5, 8, 30, 90, 250]):
            if rnd.random() < 0.5:
                seq += [rnd.randrange(kinds) for _ in range(rnd.randrange(1, 12))]
            else:
                piece = [rnd.randrange(kinds) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 8, 15, 16, 17]))]
                seq += (piece * 12)[: rnd.randrange(len(piece), 9 * len(piece) + 2)]
        codes = [seq.index(x) for x in seq]
        assert periodic.periodic_stretches(codes) == brute_runs(seq), seq


@pytest.mark.parametrize("seq,runs", [([], []), ([1] * 5, []), ([1] * 6, [(0, 6, 1)]), ([1, 2] * 3 + [1], []), ([1, 2] * 4, [(0, 8, 2)]), ([1, 2, 3] * 4, [(0, 12, 3)]), ([9, 1, 2] + [1, 2] * 3 + [1, 8], [(1, 9, 2)]), ([5] * 6 + [6] * 6, [(0, 6, 1), (6, 6, 1)])])
def test_bounds(seq, runs):
    assert periodic.periodic_stretches([seq.index(x) for x in seq]) == runs


def test_long():
    """One word, a long period, and runs within runs, over many thousand words."""
    assert periodic.periodic_stretches([0] * 60_000) == [(0, 60_000, 1)]
    piece = list(range(7000))
    assert periodic.periodic_stretches((piece * 5)[:29_000]) == [(0, 29_000, 7000)]
    inner = [0] * 7 + list(range(1, 90))
    got = periodic.periodic_stretches(inner * 40)
    assert (0, len(inner) * 40, len(inner)) in got and len(got) == 41 and all(r[1:] == (7, 1) for r in got if r[2] == 1)


def want(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = op13_periodic_runs(spark, data).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_odd(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "a", "to be " * 5, "a\tb\na b\x0ba b a\x0cb", "é " * 9, "a\x85a " * 7, "A a " * 3 + "x", "no no no no no no"])] + [(None, "x " * 8), (None, None), (4, "to be " * 5)]
    rows += [(i, " ".join(f"w{k % 83}" for k in range(200))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("runs", "words", "n", "a", "p", "g", "start", "collapsed")])
    got = periodic.run_digests(periodic.periodic_runs(d)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want(i, t, plant=False) for i, t in rows)
    got = periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(d))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want(i, t) for i, t in rows)
    assert periodic.run_digests(periodic.periodic_runs(d.limit(0))).count() == 0
