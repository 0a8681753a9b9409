"""Data quality rules as queries: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.geometry import inside, valid_box


def numeric_array(c: Column, n: int) -> Column:
    """n finite numbers?"""
    return F.coalesce((F.size(c) == n) & F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < 1e300)), F.lit(False))


def boxes_match_text(boxes: Column, text: Column) -> Column:
    """One valid box for each code point?"""
    return F.coalesce((F.size(boxes) == F.char_length(text)) & F.forall(boxes, valid_box), F.lit(False))


def outside_page(blocks: DataFrame, pages: DataFrame, slack: float = 0.01) -> DataFrame:
    """Blocks (doc, page_index, box) that reach beyond their page (doc, page_index, page_box), or have none."""
    j = blocks.join(pages, ["doc", "page_index"], "left")
    return j.filter(~F.coalesce(inside(F.col("box"), F.col("page_box"), slack), F.lit(False))).select(*blocks.columns)


def divergent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Keys present in both with any other column different: a replay that isn't one."""
    cols = [c for c in existing.columns if c != key]
    e, i = existing.select(key, F.struct(*cols).alias("e")), incoming.select(key, F.struct(*cols).alias("i"))
    return e.join(i, key).filter(~F.col("e").eqNullSafe(F.col("i"))).select(key)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The rows of incoming whose key isn't there yet, one for each key (the least by all columns)."""
    cols = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, "r.*")
    return once.join(existing.select(key).distinct(), key, "left_anti")


def set_difference(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, side: missing from observed, or unexpected in it. One grouping over both tables, with two flags for each key."""
    both = expected.select(key, F.lit(True).alias("e__")).union(observed.select(key, F.lit(False)))
    g = both.groupBy(key).agg(F.max("e__").alias("in_e"), F.min("e__").alias("not_o"))
    # a null key equals none, so it lacks on both sides
    alone = F.col(key).isNull()
    sides = F.array(F.when(F.col("in_e") & (F.col("not_o") | alone), F.lit("missing")), F.when(~F.col("not_o") & (~F.col("in_e") | alone), F.lit("unexpected")))
    return g.select(key, F.explode(F.array_compact(sides)).alias("side"))


def shared_elements(table: DataFrame, scope: str, array: str) -> DataFrame:
    """scope, element, n of elements that several rows' arrays hold within a scope."""
    return table.select(scope, F.explode(F.array_distinct(array)).alias("element")).groupBy(scope, "element").agg(F.count("*").alias("n")).filter("n > 1")


def without_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children, parents[parent_key] == children[child_key], "left_anti")


def one_owner(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, n of ids that don't belong to exactly one row of the two tables."""
    return a.select(key).union(b.select(key)).groupBy(key).agg(F.count("*").alias("n")).filter("n != 1")


def publication_mismatch(jobs: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """Ready without a publication, or published without being ready."""
    j = jobs.join(publications.select(key, F.lit(True).alias("p")), key, "full_outer")
    return j.filter(F.coalesce(F.col("ready"), F.lit(False)) != F.coalesce("p", F.lit(False))).select(key)


def changed_facts(history: DataFrame, key: str, order: str, *facts: str) -> DataFrame:
    """key, order of versions that change a column which must never change."""
    w = Window.partitionBy(key).orderBy(order)
    now = F.struct(*facts)
    return history.withColumn("b__", F.lag(now).over(w)).filter(F.col("b__").isNotNull() & ~now.eqNullSafe(F.col("b__"))).select(key, order)


def incomplete_runs(runs: DataFrame, sources: DataFrame, ideas: DataFrame, citations: DataFrame) -> DataFrame:
    """run of research runs that break: sources 0..n-1, 1 to 3 ideas 0..k-1, 1 to 24 citations, every idea cited."""
    s = sources.groupBy("run").agg(F.count("*").alias("s"), F.max("ordinal").alias("s_max"), F.countDistinct("ordinal").alias("s_d"))
    i = ideas.groupBy("run").agg(F.count("*").alias("i"), F.max("ordinal").alias("i_max"), F.countDistinct("ordinal").alias("i_d"))
    c = citations.groupBy("run").agg(F.count("*").alias("c"), F.countDistinct("idea").alias("c_d"))
    j = runs.join(s, "run", "left").join(i, "run", "left").join(c, "run", "left").na.fill(0, ["s", "i", "c", "c_d"])
    good = (F.col("s") > 0) & (F.col("s_max") == F.col("s") - 1) & (F.col("s_d") == F.col("s")) & F.col("i").between(1, 3) & (F.col("i_max") == F.col("i") - 1) & (F.col("i_d") == F.col("i")) & F.col("c").between(1, 24) & (F.col("c_d") == F.col("i"))
    return j.filter(~F.coalesce(good, F.lit(False))).select("run")


def citation_rules(citations: DataFrame, messages: DataFrame) -> DataFrame:
    """citation, rule of citations (citation, message, page, page_index) that break: the page is the index plus 1; the message (message, state) is completed."""
    j = citations.join(messages, "message", "left")
    rule = F.when(~F.coalesce(F.col("page") == F.col("page_index") + 1, F.lit(False)), "page").when(~F.coalesce(F.col("state") == "completed", F.lit(False)), "message")
    return j.select("citation", rule.alias("rule")).filter("rule IS NOT NULL")


def publication_receipt(expected: DataFrame, observed: DataFrame, key: str, payload: str) -> DataFrame:
    """One row: expected, observed, missing, unexpected, changed, publishable. Points may be published only if all three differences are 0."""
    e, o = expected.select(key, F.col(payload).alias("e__")), observed.select(key, F.col(payload).alias("o__"))
    j = e.withColumn("in_e", F.lit(1)).join(o.withColumn("in_o", F.lit(1)), key, "full_outer")
    both = F.col("in_e").isNotNull() & F.col("in_o").isNotNull()
    r = j.agg(F.count("in_e").alias("expected"), F.count("in_o").alias("observed"), F.count_if(F.col("in_o").isNull()).alias("missing"), F.count_if(F.col("in_e").isNull()).alias("unexpected"), F.count_if(both & ~F.col("e__").eqNullSafe(F.col("o__"))).alias("changed"))
    return r.withColumn("publishable", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("changed") == 0) & (F.col("expected") > 0))
