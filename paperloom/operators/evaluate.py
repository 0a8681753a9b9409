"""Scoring of evaluation campaigns: frozen denominators, and totals that are unknown if any part is."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_total(value: Column) -> Column:
    """Aggregate: the sum, or null if any value is unknown."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def ratio(num: Column, den: Column) -> Column:
    return F.round(F.try_divide(num, den), 9)


def confusion(cases: DataFrame, results: DataFrame) -> DataFrame:
    """expected, got, n over all frozen cases (case_id, expected); a case without result (case_id, got) is `missing`."""
    j = cases.join(results, "case_id", "left").withColumn("got", F.coalesce("got", F.lit("missing")))
    return j.groupBy("expected", "got").agg(F.count("*").alias("n"))


def group_recall(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: groups, recalled. Expected (case_id, group, ids) counts as recalled if every id of a group is among the case's hits (case_id, hits)."""
    j = expected.join(hits, "case_id", "left")
    found = F.size(F.array_except("ids", F.coalesce("hits", F.array().cast("array<bigint>")))) == 0
    g = j.groupBy("case_id").agg(F.max(found).alias("found"))
    return g.agg(F.count("*").alias("groups"), F.count_if("found").alias("recalled"))


def coverage(regions: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: regions, exact, characters, covered. Regions (id, quote) against observed (id, text): missing ones count with nothing covered."""
    j = regions.join(observed, "id", "left")
    return j.agg(F.count("*").alias("regions"), F.count_if(F.coalesce(F.col("text") == F.col("quote"), F.lit(False))).alias("exact"), F.sum(F.char_length("quote")).cast("long").alias("characters"), F.sum(F.when(F.contains("text", "quote"), F.char_length("quote")).otherwise(0)).cast("long").alias("covered"))


def decorative(citations: DataFrame, claims: DataFrame) -> DataFrame:
    """citation ids that no claim (claim, refs array) refers to."""
    used = claims.select(F.explode("refs").alias("citation")).distinct()
    return citations.select("citation").join(used, "citation", "left_anti")


def cost(usage: DataFrame, tariff: DataFrame) -> DataFrame:
    """run, cost from usage (run, class, tokens) by tariff (class, price per million); null unless every class is priced and counted."""
    j = usage.join(tariff, "class", "left")
    part = F.col("tokens") * F.col("price") / 1_000_000
    return j.groupBy("run").agg(F.round(known_total(part), 9).alias("cost"))


def allocation_use(spent: DataFrame, limits: DataFrame) -> DataFrame:
    """allocation, spent, status of every limit: within, over, or unknown if any amount is missing."""
    s = spent.groupBy("allocation").agg(known_total(F.col("amount")).alias("spent"), F.count("*").alias("n"))
    j = limits.join(s, "allocation", "left")
    used = F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("spent"))
    return j.select("allocation", used.alias("spent"), F.when(used.isNull(), "unknown").when(used <= F.col("limit"), "within").otherwise("over").alias("status"))


def token_lcs_recall(reference: DataFrame) -> DataFrame:
    """id, recall from (id, expected array, got array): longest common subsequence over the number of expected tokens; null for none."""

    @F.pandas_udf("int")
    def lcs(expected: pd.Series, got: pd.Series) -> pd.Series:
        return pd.Series([_lcs(list(e), list(g)) for e, g in zip(expected, got, strict=True)], dtype="int32")

    n = F.size("expected")
    return reference.select("id", F.when(n > 0, F.round(lcs("expected", F.coalesce("got", F.array().cast(reference.schema["got"].dataType))) / n, 9)).alias("recall"))


def _lcs(expected: list, got: list) -> int:
    """Length of the longest common subsequence: one row of the table as bits of a number, a step for each token got."""
    places: dict = {}
    for i, token in enumerate(expected):
        places[token] = places.get(token, 0) | 1 << i
    every = (1 << len(expected)) - 1
    row = every
    for token in got:
        met = row & places.get(token, 0)
        row = (row + met | row - met) & every
    return len(expected) - row.bit_count()


#: A window of so many values is sorted by the driver; wider ones are narrowed by a sketch of so many parts.
FEW_VALUES, SKETCH = 4096, 1000


def _at_ranks(rows: DataFrame, ranks: list[int], n: int, low: float, high: float) -> dict[int, float]:
    """The values at ranks (from 0) of rows (v).

    Each rank has a window of values that surely holds it: the least and largest one, the number of values before and within. A
    round asks a sketch for a narrower window and counts what it holds, so the sketch's error costs a round at most, never a
    result. Tasks hold sketches and counters only; some two scans cut a window to a few of SKETCH parts.
    """
    v, found = F.col("v"), {}
    windows = {r: (low, high, 0, n) for r in ranks}
    while windows:
        small = {r: w for r, w in windows.items() if w[0] == w[1] or w[3] <= FEW_VALUES}
        for r, (lo, hi, before, _) in small.items():
            if lo == hi:
                found[r] = lo
                continue
            for x, c in rows.filter(v.between(lo, hi)).groupBy("v").count().orderBy("v").collect():
                before += c
                if before > r:
                    found[r] = x
                    break
        windows = {r: w for r, w in windows.items() if r not in small}
        if not windows:
            break
        asked = []
        for r, (lo, hi, before, within) in windows.items():
            f = (r - before + 0.5) / within
            asked.append(F.percentile_approx(F.when(v.between(lo, hi), v), [max(0.0, f - 2 / SKETCH), min(1.0, f + 2 / SKETCH)], SKETCH).alias(f"w{r}"))
        guess = rows.agg(*asked).first()
        counts = rows.agg(*[c for r in windows for c in (F.count_if(v < guess[f"w{r}"][0]).alias(f"b{r}"), F.count_if(v.between(*guess[f"w{r}"])).alias(f"c{r}"))]).first()
        for r, (lo, hi, before, within) in list(windows.items()):
            b, c = counts[f"b{r}"], counts[f"c{r}"]
            if b <= r < b + c and c < within or guess[f"w{r}"][0] == guess[f"w{r}"][1] and b <= r < b + c:
                windows[r] = (*guess[f"w{r}"], b, c)
            else:  # the sketch was of no use: Spark's exact aggregate over the window
                found[r] = rows.filter(v.between(lo, hi)).agg(F.percentile("v", (r - before) / max(1, within - 1))).first()[0]
                del windows[r]
    return found


def exact_quantiles(samples: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours, as `percentile` gives them, without one task that holds all distinct values.

    Nulls don't count; NaN is the largest value. Without values all are None. samples is read several times: give it a table, not a long plan.
    """
    rows = samples.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    at = _at_ranks(rows, sorted({r for x in places for r in (math.floor(x), math.ceil(x))}), n, low, high)
    ends = [(x, math.floor(x), math.ceil(x)) for x in places]
    return [at[i] if i == k or at[i] == at[k] else (k - x) * at[i] + (x - i) * at[k] for x, i, k in ends]


def latency_summary(samples: DataFrame) -> DataFrame:
    """One row: n, p50, p95 (exact) of seconds."""
    p50, p95 = (F.lit(q).cast("double") for q in exact_quantiles(samples, "seconds", [0.5, 0.95]))
    return samples.agg(F.count("*").alias("n"), F.round(F.first(p50), 9).alias("p50"), F.round(F.first(p95), 9).alias("p95"))


def citations_exact(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """citation, exact: every fragment (citation, source, page, quote) equals a region's quote (source, page, quote) or stands in exactly one of its page's regions."""
    j = fragments.join(regions.select("source", "page", F.col("quote").alias("region")), ["source", "page"], "left")
    g = j.groupBy("citation", "source", "page", "quote").agg(F.count_if(F.col("region") == F.col("quote")).alias("equal"), F.count_if(F.contains("region", "quote")).alias("within"))
    return g.groupBy("citation").agg(F.every((F.col("equal") > 0) | (F.col("within") == 1)).alias("exact"))


STATES = ("completed", "refused", "failed", "interrupted", "running")


def campaign_defects(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """case_id, defect of observations (case_id, state) that can't be scored: unknown_case, invalid_state (null too), or repeated; a campaign with any must be refused."""
    seen = observations.groupBy("case_id").agg(F.count("*").alias("n"), F.every(F.coalesce(F.col("state").isin(*STATES), F.lit(False))).alias("ok"))
    j = seen.join(cases.select("case_id", F.lit(True).alias("known")), "case_id", "left")
    found = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown_case"), F.when(~F.col("ok"), "invalid_state"), F.when(F.col("n") > 1, "repeated")))
    return j.select("case_id", F.explode(found).alias("defect"))


def score_campaign(cases: DataFrame, observations: DataFrame, expected: DataFrame, measures: DataFrame, required: list[str] | None = None) -> DataFrame:
    """layer, metric, num, den, unknown, value, accepted: every metric of a campaign, every layer, and the campaign, over frozen denominators.

    cases (case_id, allocation) and expected (case_id, layer, metric, den, gate) are frozen; measures (case_id, layer,
    metric, num) and observations (case_id, state) are what a run made. A case without a measure, or with one that is null, negative or above its
    denominator, adds its denominator, nothing to num and 1 to unknown. `value` is num / den, null where there is
    nothing to count. A metric is accepted if it has cases and all of them are full, or if it is no gate; a layer (metric
    null) if all its metrics are and it has a gate; the campaign (layer and metric null; num and den count
    observed cases, unknown the missing ones) if no case is missing and all required layers, without a list all that are expected, are accepted.
    Diagnostic cases count in no denominator. Measures of cases or metrics that nobody expects are ignored.
    """
    frozen = cases.filter(~F.col("allocation").eqNullSafe("diagnostic")).select("case_id")
    m = measures.groupBy("case_id", "layer", "metric").agg(F.min("num").alias("num"))
    j = expected.join(frozen, "case_id", "left_semi").join(m, ["case_id", "layer", "metric"], "left")
    good = F.coalesce(F.col("num").between(0, F.col("den")), F.lit(False))
    metrics = j.groupBy("layer", "metric").agg(F.sum(F.when(good, F.col("num")).otherwise(0)).cast("long").alias("num"), F.sum("den").cast("long").alias("den"), F.count_if(~good).alias("unknown"), F.max("gate").alias("gate"))
    metrics = metrics.withColumn("accepted", ~F.col("gate") | ((F.col("den") > 0) & (F.col("num") == F.col("den")) & (F.col("unknown") == 0)))
    layers = metrics.groupBy("layer").agg(F.sum("unknown").alias("unknown"), (F.every("accepted") & F.max("gate")).alias("accepted"))
    wanted = cases.sparkSession.createDataFrame([(x,) for x in required], "layer string") if required is not None else layers.select("layer")
    gates = wanted.join(layers, "layer", "left").agg(F.count("*").alias("n"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("passed"))
    seen = frozen.join(observations.select("case_id").distinct().withColumn("seen", F.lit(True)), "case_id", "left").agg(F.count("seen").alias("num"), F.count("*").alias("den"))
    none = F.lit(None)
    whole = seen.join(F.broadcast(gates)).select(none.cast("string").alias("layer"), none.cast("string").alias("metric"), "num", "den", (F.col("den") - F.col("num")).alias("unknown"), ((F.col("num") == F.col("den")) & (F.col("n") > 0) & (F.col("passed") == F.col("n"))).alias("accepted"))  # one row each
    parts = metrics.select("layer", "metric", "num", "den", "unknown", "accepted")
    out = parts.unionByName(layers.select("layer", none.cast("string").alias("metric"), none.cast("long").alias("num"), none.cast("long").alias("den"), "unknown", "accepted")).unionByName(whole)
    return out.select("layer", "metric", "num", "den", "unknown", ratio(F.col("num"), F.col("den")).alias("value"), "accepted")
