"""Digest trees, the canonical store, exact quantiles and interval joins against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluate, provenance, reconcile
from paperloom.sources import canonical

ROW = "k long, a string, b double, at timestamp"


def test_tree_opens_only_what_differs(spark):
    e = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).alias("v"))
    o = e.filter("k != 11").withColumn("v", F.when(F.col("k") == 500, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(-5, 1)], "k long, v long"))
    assert {tuple(r) for r in reconcile.reconcile(e, o, "k").collect()} == {(11, "missing"), (500, "changed"), (-5, "unexpected")}
    r = reconcile.receipt(e, o, "k").first()
    assert (r.expected, r.observed, r.missing, r.unexpected, r.changed, r.publishable) == (20_000, 20_000, 1, 1, 1, False)
    assert 3 <= r.opened < 20
    same = reconcile.receipt(e, e.orderBy(F.rand(3)), "k").first()
    assert (same.opened, same.publishable) == (0, True)


def test_tree_rows_are_a_multiset(spark):
    row = lambda *x: (*x, None)
    e = spark.createDataFrame([row(1, "x", 1.0), row(1, "x", 1.0), row(2, None, 2.0), row(3, "y", None), row(None, "n", 0.0), row(None, "n", 0.0)], ROW)
    o = spark.createDataFrame([row(1, "x", 1.0), row(2, "", 2.0), row(3, None, None), row(None, "n", 0.0), row(None, "n", 0.0)], ROW)
    assert {tuple(r) for r in reconcile.reconcile(e, o, "k", 4, 2).collect()} == {(1, "changed"), (2, "changed"), (3, "changed")}
    assert reconcile.reconcile(e, e, "k", 4, 2).count() == 0
    none = e.limit(0)
    assert {tuple(r) for r in reconcile.reconcile(none, o, "k").collect()} == {(k, "unexpected") for k in (1, 2, 3, None)}
    r = reconcile.receipt(none, none, "k").first()
    assert (r.expected, r.observed, r.opened, r.publishable) == (0, 0, 0, False)


def test_tree_sees_microseconds_and_refuses_maps(spark):
    e = spark.sql("SELECT 1L AS k, TIMESTAMP '2026-01-01 00:00:00.000001' AS t")
    assert reconcile.reconcile(e, spark.sql("SELECT 1L AS k, TIMESTAMP '2026-01-01 00:00:00.000002' AS t"), "k").count() == 1
    with pytest.raises(ValueError):
        reconcile.digest_tree(spark.sql("SELECT 1 AS k, map('a', 1) AS m"), "k")


def test_tree_levels_add_up_and_stored_trees_serve(spark, tmp_path):
    e = spark.range(300).select(F.col("id").alias("k"))
    reconcile.digest_tree(e, "k", 4, 3).write.parquet(f"{tmp_path}/tree")
    t = spark.read.parquet(f"{tmp_path}/tree")
    rows = t.collect()
    assert {level: sum(r.n for r in rows if r.level == level) for level in range(4)} == dict.fromkeys(range(4), 300)
    up = Counter()
    for r in rows:
        if r.level == 3:
            up[r.node // 4] += r.d2
    assert up == {r.node: r.d2 for r in rows if r.level == 2}
    assert [tuple(r) for r in reconcile.reconcile(e, e.filter("k != 7"), "k", 4, 3, trees=(t, None)).collect()] == [(7, "missing")]


# canonical store


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, body string, seen long")


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    schema = "id string, body string, seen long"
    first = batch(spark, ("a", "1", 1), ("b", None, 2), ("b", None, 2))
    assert tuple(canonical.write_batch(first, path, "b1", "id").first()) == ("b1", 0, 3, 2)
    assert tuple(canonical.write_batch(first, path, "b1", "id").first()) == ("b1", 0, 3, 2)  # by name
    assert tuple(canonical.write_batch(first, path, "b2", "id").first()) == ("b2", 1, 3, 0)  # by content
    for wrong in (("a", "2", 1), ("b", "", 2), ("a", None, 1)):
        with pytest.raises(canonical.DivergentReplay):
            canonical.write_batch(batch(spark, wrong, ("c", "new", 1)), path, "b3", "id")
    with pytest.raises(canonical.DivergentReplay):  # within a batch
        canonical.write_batch(batch(spark, ("d", "1", 1), ("d", "2", 1)), path, "b3", "id")
    with pytest.raises(canonical.DivergentReplay):  # a known name with a row that was never stored
        canonical.write_batch(batch(spark, ("z", "1", 1)), path, "b1", "id")
    assert sorted(map(tuple, canonical.stored(spark, path, schema).drop("batch").collect())) == [("a", "1", 1), ("b", None, 2)]
    assert tuple(canonical.write_batch(first.limit(0), path, "b4", "id").first()) == ("b4", 2, 0, 0)
    for bad, name in ((batch(spark, (None, "1", 1)), "b5"), (first, "../b")):
        with pytest.raises(ValueError):
            canonical.write_batch(bad, path, name, "id")


def test_store_first_arrival_wins_and_unfinished_batches_are_unseen(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    schema = "id string, body string, seen long"
    canonical.write_batch(batch(spark, ("a", "late", 9), ("a", "early", 3)), path, "b1", "id", first_wins="seen")
    r = canonical.write_batch(batch(spark, ("a", "first of all", 1), ("b", "x", 1)), path, "b2", "id", first_wins="seen").first()
    assert (r.offered, r.written) == (2, 1)
    batch(spark, ("z", "died before its receipt", 1)).write.parquet(f"{path}/records/batch=b3")
    read = lambda: sorted((r.id, r.body) for r in canonical.stored(spark, path, schema).collect())
    assert read() == [("a", "early"), ("b", "x")]
    canonical.write_batch(batch(spark, ("z", "again", 1)), path, "b3", "id")
    assert read() == [("a", "early"), ("b", "x"), ("z", "again")]


# exact quantiles


@pytest.mark.parametrize("kind", ["spread", "ties", "tails", "few", "nan"])
def test_exact_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(evaluate, "FEW_VALUES", 8)
    v = {
        "spread": F.xxhash64("id") / 1e12,
        "ties": F.when(F.col("id") % 3 == 0, F.col("id") / 7).otherwise(5.0),
        "tails": F.exp((F.col("id") % 700).cast("double")),
        "few": F.when(F.col("id") < 3, F.col("id").cast("double")),
        "nan": F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") / 3),
    }[kind]
    t = spark.range(6_000).select(v.alias("v"))
    ps = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    want = t.agg(F.percentile("v", ps)).first()[0]
    got = evaluate.exact_quantiles(t, "v", ps)
    assert [x if x != x else pytest.approx(x, rel=1e-12) for x in got] == want or all(a == pytest.approx(b, rel=1e-12, nan_ok=True) for a, b in zip(got, want))
    assert evaluate.exact_quantiles(t.limit(0), "v", [0.5]) == [None]


# interval joins


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    made = lambda n: [(rng.choice("ab"), i, s, s + rng.choice([0, 1, 3, 64, 65, 300, 5_000, 40_000])) for i in range(n) for s in [rng.randrange(20_000)]]
    a, b = made(250), made(120)
    left = spark.createDataFrame(a + [(None, 900, 0, 50), ("a", 901, None, 5)], "k string, i long, start long, stop long")
    right = spark.createDataFrame(b + [(None, 900, 0, 50)], "k string, j long, lo long, hi long")
    want = Counter((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    got = provenance.overlaps(left, right, "k")
    assert Counter((r.i, r.j) for r in got.collect()) == want and len(want) > 1000
    assert provenance.overlaps(left.limit(0), right, "k").count() == 0


def test_overlaps_splits_a_long_key(spark):
    lines = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 40).alias("start"), (F.col("id") * 40 + 40).alias("stop"))
    asked = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 160 + 20).alias("lo"), (F.col("id") * 160 + 60).alias("hi")).union(spark.sql("SELECT 1, 0L, 8000000L"))
    assert provenance.overlaps(lines, asked, "k").count() == 2 * 50_000 + 200_000


def test_mapping_defects(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 11, 20)], "doc long, lo long, hi long")
    rows = [(1, 1, "identity", 0, 10, 0, 10), (1, 2, "identity", 0, 4, 8, 12), (1, 3, "identity", 0, 3, 12, 14), (1, 4, "deletion", 3, 3, 10, 10), (1, 5, "deletion", 3, 3, 25, 25), (2, 6, "identity", 0, 1, 0, 1), (1, 7, "ligature", 0, 2, 5, 6), (1, 8, "identity", 0, 1, None, None)]
    m = spark.createDataFrame(rows, "doc long, mapping long, kind string, start long, stop long, source_start long, source_stop long")
    assert {(r.mapping, r.defect) for r in provenance.mapping_defects(m, spans, "doc").collect()} == {(2, "outside"), (3, "length"), (5, "outside"), (6, "outside"), (8, "outside")}


def test_replay_outcomes_of_rows_of_equal_arrival(spark):
    stored = spark.createDataFrame([(9, "x")], "k long, a string")
    rows = [(1, 5, 1, "b"), (1, 5, 1, "a"), (1, 5, 1, "a"), (2, 6, 1, "b"), (1, 6, 9, "x"), (1, 6, 9, "x")]
    b = spark.createDataFrame(rows, "batch int, at int, k long, a string")
    out = canonical.replay_outcomes(stored, b, "k", "batch", "at")
    assert sorted(map(tuple, out.collect())) == [(1, 5, 1, 3, 1), (2, 1, 0, 0, 1)]
