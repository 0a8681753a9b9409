"""State as folds over logs: jobs, leases, retries, quotas, ledgers, conversations. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Delays after failures in seconds, attempts in a cycle, stages in order, failure kinds.
BACKOFF = (5, 15, 45, 120)
MAX_ATTEMPTS = 5
STAGES = ("validating", "parsing", "normalizing", "chunking", "embedding", "indexing")
TEMPORARY = ("DEPENDENCY_UNAVAILABLE", "DEPENDENCY_RATE_LIMITED", "PDF_SANDBOX_UNAVAILABLE")
RESOURCE = ("PDF_TOO_LARGE", "PDF_TOO_MANY_PAGES", "PDF_PARSE_RESOURCE_LIMIT", "PROCESSING_RESOURCE_LIMIT", "EMBEDDING_CONTEXT_LIMIT", "PDF_PARSE_TIMEOUT")
UNSUPPORTED = ("PDF_ENCRYPTED", "PDF_INVALID", "PDF_NO_TEXT", "PDF_PARSE_GEOMETRY_INVALID")


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by one aggregate (combined before the shuffle), without ranking all rows."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def failure_kind(code: Column) -> Column:
    return F.when(code.isin(*TEMPORARY), "temporary").when(code.isin(*RESOURCE), "resource_limit").when(code.isin(*UNSUPPORTED), "unsupported").otherwise("integrity")


def backoff(attempts: Column, asked: Column | None = None) -> Column:
    """Seconds to wait after so many attempts, or longer if asked for."""
    wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.lit(1), F.least(attempts, F.lit(len(BACKOFF)))).cast("int"))
    return F.greatest(wait, F.coalesce(asked, F.lit(0))) if asked is not None else wait


def after_failure(jobs: DataFrame) -> DataFrame:
    """Adds kind, status, delay to rows (code, attempts, retry_after): temporary failures wait for another try until five attempts or 300 s. Without a retry_after, the table of delays decides."""
    kind = failure_kind(F.col("code"))
    temporary = kind == "temporary"
    again = temporary & (F.col("attempts") < MAX_ATTEMPTS) & (F.coalesce("retry_after", F.lit(0)) <= 300)
    return jobs.withColumn("kind", kind).withColumn("status", F.when(again, "pending").otherwise("failed")).withColumn("delay", F.when(temporary, backoff(F.col("attempts"), F.col("retry_after"))).otherwise(0))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job, status, run_after, lease_until, attempts, created) that are due or whose lease ran out, in the order they are taken.

    outcome: `claim`, or `exhausted` after five attempts.
    """
    due = ((F.col("status") == "pending") & (F.col("run_after") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") <= now))
    at = F.when(F.col("status") == "running", F.col("lease_until")).otherwise(F.col("run_after"))
    return jobs.filter(due).select("job", "status", at.alias("due_at"), "created", F.when(F.col("attempts") >= MAX_ATTEMPTS, "exhausted").otherwise("claim").alias("outcome"))


def presentation(status: Column, stage: Column, attempts: Column, revision: Column, published: Column) -> Column:
    """waiting, preparing, delayed, failed or complete; what can't be is `invalid`."""
    return (
        F.when((status == "succeeded") & (stage == "ready") & published, "complete")
        .when((status == "failed") & (stage == "failed"), "failed")
        .when((status == "running") & ~stage.isin("queued", "ready", "failed"), "preparing")
        .when((status == "pending") & ~stage.isin("ready", "failed"), F.when((attempts == 0) & (revision == 0), "waiting").otherwise("delayed"))
        .otherwise("invalid")
    )


def resume_stage(manifests: DataFrame, jobs: DataFrame, key: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """key, stage: the first stage without a manifest; the last one if all are there."""
    done = manifests.groupBy(key).agg(F.collect_set("stage").alias("done"))
    missing = F.array_except(F.array(*map(F.lit, stages)), F.coalesce("done", F.array().cast("array<string>")))
    return jobs.join(done, key, "left").select(key, F.coalesce(F.get(missing, F.lit(0)), F.lit(stages[-1])).alias("stage"))


def retry_decision(asked: Column, revision: Column, status: Column, retryable: Column, wait: Column, recent: Column, limit: int = 5) -> Column:
    """Optimistic revision: an older one replays, a newer one conflicts; else state, waiting time and quota decide."""
    return F.when(asked > revision, "conflict").when(asked < revision, "replay").when((status != "failed") | ~retryable, "not_retryable").when((wait > 0) | (recent >= limit), "wait").otherwise("accept")


def intake(requests: DataFrame, key: str, digest: str, *order: str) -> DataFrame:
    """Adds outcome: the first request of a key is `new`, later ones `replay` it or, with another digest, `conflict`."""
    first = F.min(F.struct(*order, digest)).over(Window.partitionBy(key))
    me = F.struct(*order, digest)
    return requests.withColumn("first__", first).withColumn("outcome", F.when(me == F.col("first__"), "new").when(F.col(digest).eqNullSafe(F.col(f"first__.{digest}")), "replay").otherwise("conflict")).drop("first__")


def rolling_count(log: DataFrame, key: str, ts: str, seconds: int = 3600) -> DataFrame:
    """Adds recent: rows of the key in the time before, from strictly after ts - seconds up to and with ts (microseconds)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return log.withColumn("recent", F.count("*").over(w))


def running_within(rows: DataFrame, key: str, order: Column, size: Column, budget: int, at_most: int) -> DataFrame:
    """The first rows of each key while their number and total size stay within limits: it stops at the first that doesn't fit."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(order))).withColumn("sum__", F.sum(size).over(w)).filter((F.col("n__") <= at_most) & (F.col("sum__") <= budget)).drop("n__", "sum__")


def page_after(rows: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(page, more): n rows in order, and one row more (boolean), found by looking at n + 1."""
    looked = rows.orderBy(*order).limit(n + 1)
    return looked.orderBy(*order).limit(n), looked.agg((F.count("*") > n).alias("more"))


def ledger(events: DataFrame, key: str) -> DataFrame:
    """Attempts folded from (key, attempt, kind: reserve | settle | uncertain, cost): reserved, settled, open, uncertain, total (null if any settled cost is unknown)."""
    a = events.groupBy(key, "attempt").agg(F.max((F.col("kind") == "reserve").cast("int")).alias("reserved"), F.max((F.col("kind") == "settle").cast("int")).alias("settled"), F.max((F.col("kind") == "uncertain").cast("int")).alias("uncertain"), F.sum(F.when(F.col("kind") == "settle", F.col("cost"))).alias("cost"))
    n = lambda c: F.sum(c).cast("long")
    open_ = ((F.col("reserved") == 1) & (F.col("settled") == 0) & (F.col("uncertain") == 0)).cast("int")
    total = F.when(F.count_if((F.col("settled") == 1) & F.col("cost").isNull()) == 0, F.sum("cost"))
    return a.groupBy(key).agg(n("reserved").alias("reserved"), n("settled").alias("settled"), n(open_).alias("open"), n("uncertain").alias("uncertain"), F.round(total, 6).alias("total"))


def monotone_violations(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose cumulative value is below the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return log.withColumn("before__", F.lag(value).over(w)).filter(F.col(value) < F.col("before__")).drop("before__")


def sequence_violations(log: DataFrame, key: str, sequence: str, first: int = 1) -> DataFrame:
    """key, n of keys whose sequence numbers aren't first, first + 1, ... without gap or repeat."""
    g = log.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(sequence).alias("d"), F.min(sequence).alias("a"), F.max(sequence).alias("b"))
    return g.filter((F.col("d") != F.col("n")) | (F.col("a") != first) | (F.col("b") != first + F.col("n") - 1)).select(key, "n")


def quota_use(windows: DataFrame, key: str, now: Column, seconds: int = 3600) -> DataFrame:
    """key, used, resets: requests of all windows kept (key, window_start, n), and the seconds from now until the oldest one ends."""
    start = F.unix_micros(F.min("window_start").cast("timestamp")) + seconds * 1_000_000 - F.unix_micros(now.cast("timestamp"))
    return windows.groupBy(key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"), F.ceil(start / 1_000_000).alias("resets"))
