"""State queries: events play transitions, quotas and ledgers. "Now" is a fixed instant, or taken from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.io import table
from paperloom.operators import checks, evaluate, state
from paperloom.plans.registry import query

NOW = "2024-01-08 00:00:00"
_NOW_SQL = f"TIMESTAMP '{NOW}'"
_K = "CAST(json_extract(props, '$.k') AS INTEGER)"
_CODES = ("DEPENDENCY_UNAVAILABLE", "PDF_TOO_LARGE", "PDF_INVALID", "PARSER_OUTPUT_INVALID")


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent, recent > 3 AS over FROM events""")
def rolling_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the user in the last hour, exactly one hour ago not included."""
    return state.rolling_count(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id", "recent", (F.col("recent") > 3).alias("over"))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY user_id, date_trunc('hour', ts)")
def hourly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return e.agg(F.count("*").alias("n"), (F.count("*") > 2).alias("over"))


@query(f"""WITH e AS (SELECT user_id, event_id, ts, event_type, {_K} AS k FROM events),
l AS (SELECT user_id AS job, event_id, ts, event_type, k FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
a AS (SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS attempts FROM e GROUP BY user_id),
c AS (SELECT job, event_id, ({list(_CODES)})[k % 4 + 1] AS code, least(attempts, 6) AS attempts, k % 400 AS retry_after FROM l JOIN a USING (job)),
d AS (SELECT *, CASE code WHEN 'DEPENDENCY_UNAVAILABLE' THEN 'temporary' WHEN 'PDF_TOO_LARGE' THEN 'resource_limit' WHEN 'PDF_INVALID' THEN 'unsupported' ELSE 'integrity' END AS kind FROM c)
SELECT job, event_id, kind, CASE WHEN kind = 'temporary' AND attempts < 5 AND retry_after <= 300 THEN 'pending' ELSE 'failed' END AS status,
CASE WHEN kind = 'temporary' THEN greatest(([5, 15, 45, 120])[greatest(1, least(attempts, 4))], retry_after) ELSE 0 END AS delay FROM d""")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, their events as transitions: the last one decides the failure, errors so far are attempts."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "job")
    last = state.latest(e.select("job", "event_id", "ts", "event_type", "k"), "job", "ts", "event_id")
    attempts = e.groupBy("job").agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    codes = F.element_at(F.array(*map(F.lit, _CODES)), F.col("k") % 4 + 1)
    j = last.join(attempts, "job").select("job", "event_id", codes.alias("code"), F.least("attempts", F.lit(6)).alias("attempts"), (F.col("k") % 400).alias("retry_after"))
    return state.after_failure(j).select("job", "event_id", "kind", "status", "delay")


_JOBS_SQL = f"""j AS (SELECT event_id AS job, CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'signup' THEN 'succeeded' ELSE 'running' END AS status, ts AS created,
ts + to_seconds({_K} * 10000) AS due, {_K} % 7 AS attempts FROM events)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "signup", "succeeded").otherwise("running")
    due = (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("k") * 10000)).alias("due")
    return _events(spark, sf_dir).select(F.col("event_id").alias("job"), status.alias("status"), F.col("ts").alias("created"), due, (F.col("k") % 7).alias("attempts"))


@query(f"""WITH {_JOBS_SQL} SELECT job, status, due AS due_at, CASE WHEN attempts >= 5 THEN 'exhausted' ELSE 'claim' END AS outcome FROM j WHERE status IN ('pending', 'running') AND due <= {_NOW_SQL}""")
def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs with a due time or lease end k * 10000 s after they began: what can be claimed now."""
    jobs = _jobs(spark, sf_dir).select("*", F.col("due").alias("run_after"), F.col("due").alias("lease_until"))
    return state.claimable(jobs, _now()).select("job", "status", "due_at", "outcome")


@query(f"""WITH {_JOBS_SQL} SELECT job, status, due AS due_at FROM j WHERE status IN ('pending', 'running') AND due <= {_NOW_SQL} ORDER BY due, created, job LIMIT 1""")
def next_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).select("*", F.col("due").alias("run_after"), F.col("due").alias("lease_until"))
    return state.claimable(jobs, _now()).orderBy("due_at", "created", "job").limit(1).select("job", "status", "due_at")


_STAGE_SQL = "([" + ", ".join(f"'{s}'" for s in state.STAGES) + "])"


@query(f"""WITH m AS (SELECT DISTINCT user_id, {_STAGE_SQL}[CAST(least({_K} % 6, user_id % 7) AS INTEGER) + 1] AS stage FROM events),
s AS (SELECT unnest({_STAGE_SQL}) AS stage, unnest(range(6)) AS n), u AS (SELECT DISTINCT user_id FROM events),
f AS (SELECT user_id, min(n) AS n FROM u, s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = u.user_id AND m.stage = s.stage) GROUP BY user_id)
SELECT u.user_id, coalesce({_STAGE_SQL}[f.n + 1], 'indexing') AS stage FROM u LEFT JOIN f USING (user_id)""")
def resume_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a manifest of a stage; users differ in how far they can get."""
    e = _events(spark, sf_dir)
    at = F.least(F.col("k") % 6, F.col("user_id") % 7).cast("int")
    m = e.select("user_id", F.element_at(F.array(*map(F.lit, state.STAGES)), at + 1).alias("stage"))
    return state.resume_stage(m, e.select("user_id").distinct(), "user_id")


@query(f"""SELECT event_id, CASE WHEN event_id = first_value(event_id) OVER w THEN 'new' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome
FROM events WINDOW w AS (PARTITION BY user_id, {_K} ORDER BY ts, event_id)""")
def idempotent_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and k as idempotency key, the event's type as digest."""
    e = _events(spark, sf_dir).withColumn("key", F.struct("user_id", "k"))
    return state.intake(e, "key", "event_type", "ts", "event_id").select("event_id", "outcome")


@query(f"""WITH {_JOBS_SQL}, r AS (SELECT user_id, count(*) AS n FROM events JOIN j ON job = event_id WHERE status = 'running' AND due > {_NOW_SQL} GROUP BY user_id) SELECT user_id, n FROM r WHERE n > 1""")
def single_active_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than one running job whose lease is good."""
    running = _jobs(spark, sf_dir).filter((F.col("status") == "running") & (F.col("due") > _now()))
    owners = table(spark, sf_dir, "events").select(F.col("event_id").alias("job"), "user_id")
    return running.join(owners, "job").groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""WITH e AS (SELECT user_id, {_K} AS attempt, CASE event_type WHEN 'click' THEN 'reserve' WHEN 'view' THEN 'reserve' WHEN 'error' THEN 'uncertain' ELSE 'settle' END AS kind, CASE WHEN value > 1 THEN round(value, 2) END AS cost FROM events),
a AS (SELECT user_id, attempt, max(CASE WHEN kind = 'reserve' THEN 1 ELSE 0 END) AS r, max(CASE WHEN kind = 'settle' THEN 1 ELSE 0 END) AS s, max(CASE WHEN kind = 'uncertain' THEN 1 ELSE 0 END) AS u, sum(cost) FILTER (kind = 'settle') AS cost FROM e GROUP BY user_id, attempt)
SELECT user_id, CAST(sum(r) AS BIGINT) AS reserved, CAST(sum(s) AS BIGINT) AS settled, count(*) FILTER (r = 1 AND s = 0 AND u = 0) AS open, CAST(sum(u) AS BIGINT) AS uncertain, CASE WHEN count(*) FILTER (s = 1 AND cost IS NULL) = 0 THEN round(sum(cost), 6) END AS total FROM a GROUP BY user_id""")
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "reserve").when(F.col("event_type") == "error", "uncertain").otherwise("settle")
    e = _events(spark, sf_dir).select("user_id", F.col("k").alias("attempt"), kind.alias("kind"), F.when(F.col("value") > 1, F.round("value", 2)).alias("cost"))
    return state.ledger(e, "user_id")


@query("""WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS tokens FROM events GROUP BY user_id, event_type), t AS (SELECT 'click' AS event_type, 1.5 AS price UNION ALL SELECT 'view', 0.5 UNION ALL SELECT 'purchase', 4 UNION ALL SELECT 'error', 2)
SELECT user_id AS run, CASE WHEN count(tokens * price) = count(*) THEN round(sum(tokens * price / 1000000), 9) END AS cost FROM c LEFT JOIN t USING (event_type) GROUP BY user_id""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as token classes; one of them has no price, so runs that use it have no cost."""
    usage = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("class")).agg(F.count("*").cast("double").alias("tokens"))
    prices = {"click": 1.5, "view": 0.5, "purchase": 4.0, "error": 2.0}
    tariff = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])).alias("class", "price"))
    return evaluate.cost(usage, tariff)


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE value < before""")
def monotone_usage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return state.monotone_violations(e, "user_id", "at", "value").select("user_id", "event_id")


@query("""WITH h AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id FROM h WHERE before IS NOT NULL AND before IS DISTINCT FROM event_type""")
def immutable_fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the user's event before it."""
    return checks.changed_facts(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("value").alias("seconds"))
    s = evaluate.latency_summary(e)
    return s.select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")
