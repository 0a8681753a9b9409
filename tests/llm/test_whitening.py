"""Whitening against plain sums and a full singular value decomposition, and on odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import whitening


def brute(rows, components=4):
    """{(position, component): (id, deviation, whitened, explained)} by whole numbers and numpy."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = []
    for i, x in good:
        d = [n * c - s for c, s in zip(x, sums)]
        for k in range(min(components, len(sums))):
            out.append((i, k + 1, n, sum(q * q for q in d), float(np.array([q / n for q in d]) @ vectors[:, k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def check(got, want):
    got = sorted(got, key=lambda r: (r.component, -1 if r.vec_id is None else r.vec_id, r.deviation))
    want = sorted(want, key=lambda r: (r[1], -1 if r[0] is None else r[0], r[3]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    for k in {w[1] for w in want}:
        a, b = np.array([r.whitened for r in got if r.component == k]), np.array([w[4] for w in want if w[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(abs(r.explained - w[5]) <= 1e-6 * w[5] for r, w in zip(got, want) if r.component == k)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_table(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet")
    check(whitening.whiten(t).collect(), brute([(r.vec_id, r.embedding) for r in t.collect()]))


def test_many_tasks_and_odd_rows(spark):
    """One factor for each of 40 tasks, merged in two rounds; nulls, entries that aren't finite, repeated rows, no id, negative entries."""
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(6, 6)) * [9, 5, 3, 2, 1, 0.5]
    rows = [(i, (rnd.normal(size=6) @ mix + 3).tolist()) for i in range(700)]
    rows += [(1, rows[0][1])] * 300 + [(None, rows[5][1]), (None, [1.0] * 6)]
    bad = [(2000, None), (2001, [None, *[1.0] * 5]), (2002, [math.nan, *[1.0] * 5]), (2003, [math.inf, *[0.0] * 5]), (2004, [-math.inf, *[0.0] * 5])]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").select("*", F.lit("clash").alias("x"), F.lit("clash").alias("whitened"))
    check(whitening.whiten(t.repartition(40)).collect(), brute(rows))
    # an empty vector, one of another length and one beyond a long are left out
    more = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1e300, *[0.0] * 5])], "vec_id long, embedding array<double>")
    check(whitening.whiten(t.select("vec_id", "embedding").union(more)).collect(), brute(rows))


def test_merge_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=5).tolist()) for i in range(90)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(13)).collect(), brute(rows))


def test_without_spread(spark):
    one = spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one).collect()} == {(i, k, 1, 0, None, None, 0.0) for i in (1, 2) for k in (1, 2)}
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.explained == pytest.approx(float(r.component == 1)) for r in got) and got[0].identity_error < 1e-9
    assert whitening.whiten(flat.limit(0)).count() == 0
    assert whitening.whiten(flat.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_large_numbers(spark):
    """Deviations are exact beyond 2^53 and null beyond a long."""
    rows = [(0, [1e6, 0.0]), (1, [-1e6 + 1 / 256, 3.0]), (2, [5.0, 1e6])]
    got = {(r.vec_id, r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(i, d) for i, _, _, d, _, _ in brute(rows)}
    rows[0] = (0, [1e12, 0.0])
    assert {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}[0] is None
