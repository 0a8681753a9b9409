"""Leases as a stateful stream: expiry by timer, stale generations, late heartbeats."""

import pytest
from pyspark.sql import functions as F

from paperloom.streaming.leases import leases

START = 1_700_000_000


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old, parts = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set(name, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def run(spark, tmp_path, *batches, late="0 seconds"):
    """Each batch is a file of (job, kind, second, generation), read in order; the rows of each."""
    folder, out = tmp_path / "in", {}
    folder.mkdir(exist_ok=True)
    schema = "job string, kind string, ts timestamp, generation int"

    def keep(df, number):
        out[number] = [(r.job, r.status, r.generation, r.expires and int(r.expires.timestamp()) - START, r.accepted) for r in df.collect()]

    for i, rows in enumerate(batches):
        d = spark.createDataFrame(rows, "job string, kind string, s long, generation int").select("job", "kind", F.timestamp_seconds(F.col("s") + START).alias("ts"), "generation")
        d.coalesce(1).write.mode("append").parquet(str(folder))
        q = leases(spark.readStream.schema(schema).parquet(str(folder)), late=late).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None, i
    return [r for k in sorted(out) for r in sorted(out[k], key=lambda r: str(r[0]))]  # a job's rows of a batch are in order


def test_expiry_by_timer(rocks, tmp_path):
    got = run(rocks, tmp_path, [("a", "claim", 0, None), ("b", "claim", 0, None), ("b", "heartbeat", 60, 1)], [("c", "claim", 100, None)], [("c", "succeed", 101, 1)])
    a = [r for r in got if r[0] == "a"]
    assert a == [("a", "running", 1, 90, True), ("a", "expired", 1, 90, True)]  # no event of a's own came
    assert [r for r in got if r[0] == "b"] == [("b", "running", 1, 90, True), ("b", "running", 1, 150, True)]  # extended
    assert [r[1] for r in got if r[0] == "c"] == ["running", "succeeded"]


def test_stale_generation_and_late_heartbeat(rocks, tmp_path):
    first = [("a", "claim", 0, None), ("a", "claim", 10, None), ("a", "heartbeat", 90, 1), ("a", "claim", 91, None)]
    second = [("a", "succeed", 95, 1), ("a", "heartbeat", 96, 2), ("a", "fail", 97, None), ("a", "succeed", 98, 2), ("a", "other", 99, None)]
    got = run(rocks, tmp_path, first, second, late="1 hour")
    assert [r[1:] for r in got[:5]] == [("running", 1, 90, True), ("refused", 1, 90, False), ("expired", 1, 90, True), ("refused", 1, 90, False), ("running", 2, 181, True)]
    assert [r[1:] for r in got[5:]] == [("refused", 2, 181, False), ("running", 2, 186, True), ("failed", 2, 97, True), ("refused", 2, 97, False), ("refused", 2, 97, False)]


def test_ties_nulls_and_nothing(rocks, tmp_path):
    got = run(rocks, tmp_path, [(None, "claim", 0, None), (None, "succeed", 5, None), (None, "claim", 5, None), ("x", None, 5, None)], late="1 hour")
    assert [r for r in got if r[0] is None] == [(None, "running", 1, 90, True), (None, "succeeded", 1, 5, True), (None, "running", 2, 95, True)]
    assert [r[1:] for r in got if r[0] == "x"] == [("refused", 0, None, False)]
