"""Relational queries: the TPC-H-like tables play papers, versions, jobs and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.io import table
from paperloom.operators import checks, relational, state
from paperloom.plans.registry import query


@query("""SELECT o_orderkey, c_name, o_orderpriority, o_totalprice, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS published,
CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'waiting' ELSE 'delayed' END AS state
FROM orders JOIN customer ON o_custkey = c_custkey""")
def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as papers, the newest first."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "waiting").otherwise("delayed")
    flagged = relational.flag_existing(o, returned, "o_orderkey", "published")
    return flagged.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "c_name", "o_orderpriority", "o_totalprice", "published", status.alias("state"))


@query("""SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE instr(lower(c_name), 'r#00000012') > 0 OR instr(lower(n_name), 'nation_1') > 0""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as papers, their nation and region as authors; `r#00000012` and `nation_1` in any case."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("authors", F.array("n_name", "r_name"))
    return c.filter(relational.literal_search(F.col("c_name"), F.array(), "R#00000012") | relational.literal_search(F.lit(None).cast("string"), F.col("authors"), " Nation_1 ")).select("c_custkey", "c_name")


@query("""SELECT conv_id, turn, role, left(text, 240) AS preview FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def last_message_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = relational.last_of(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return last.select("conv_id", "turn", "role", relational.preview(F.col("text")).alias("preview"))


@query("""SELECT conv_id, turn, role, (SELECT count(*) FROM conversations WHERE (conv_id, turn) > (20, 1)) > 50 AS more FROM conversations WHERE (conv_id, turn) > (20, 1) ORDER BY conv_id, turn LIMIT 50""")
def message_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty messages after the cursor (20, 1), rising."""
    after = table(spark, sf_dir, "conversations").filter(F.struct("conv_id", "turn") > F.struct(F.lit(20).cast("long"), F.lit(1).cast("long")))
    page, more = state.page_after(after.select("conv_id", "turn", "role"), [F.asc("conv_id"), F.asc("turn")], 50)
    return page.join(F.broadcast(more))  # one row


@query("""WITH c AS (SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, turns, (SELECT count(*) FROM c WHERE (turns, conv_id) < (6, 60)) > 20 AS more FROM c WHERE (turns, conv_id) < (6, 60) ORDER BY turns DESC, conv_id DESC LIMIT 20""")
def conversation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of twenty conversations before the cursor, falling."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    before = c.filter(F.struct("turns", "conv_id") < F.struct(F.lit(6).cast("long"), F.lit(60).cast("long")))
    page, more = state.page_after(before, [F.desc("turns"), F.desc("conv_id")], 20)
    return page.join(F.broadcast(more))  # one row


@query("""WITH p AS (SELECT u.conv_id, u.turn, length(u.text) + length(a.text) AS size FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS total FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, size FROM r WHERE n <= 6 AND total <= 8000""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's and the next assistant's message, newest first, at most six and 8000 characters: the first that doesn't fit ends it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.char_length("text").alias("nu"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.char_length("text").alias("na"))
    pairs = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("nu") + F.col("na")).cast("long").alias("size"))
    return state.running_within(pairs, "conv_id", F.desc("turn"), F.col("size"), 8000, 6)


@query("SELECT conv_id, coalesce(max(turn), 0) + 1 AS next FROM conversations GROUP BY conv_id")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next"))


@query("""SELECT r_regionkey AS section, r_name AS title, r_regionkey AS ordinal, min(s_suppkey) AS first_page FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey, r_name""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sections, nations as blocks, suppliers as pages."""
    s = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("section"), F.col("r_name").alias("title"), F.col("r_regionkey").alias("ordinal"))
    b = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("page"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("page_index"))
    return relational.outline(s, b, p)


@query("""SELECT key, side FROM (
SELECT DISTINCT o_orderkey AS key, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)
UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_quantity > 20 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0)
) WHERE side = 'missing' AND key % 11 <> 0 OR side = 'unexpected'""")
def set_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (all but every eleventh) against the orders of items above 20 pieces."""
    expected = table(spark, sf_dir, "orders").filter("o_orderkey % 11 != 0").select(F.col("o_orderkey").alias("key"))
    observed = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("key"))
    return checks.set_difference(expected, observed, "key")


@query("""WITH b AS (SELECT l_suppkey AS scope, l_orderkey, unnest(list_distinct(list(l_partkey))) AS element FROM lineitem GROUP BY l_suppkey, l_orderkey)
SELECT scope, element, count(*) AS n FROM b GROUP BY scope, element HAVING count(*) > 1""")
def array_overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches (a supplier's parts in one order): parts that two batches of a supplier hold."""
    batches = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scope"), "l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return checks.shared_elements(batches, "scope", "parts")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_missing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return checks.without_children(table(spark, sf_dir, "customer"), big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_shipdate) AS first_ship, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def scoped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes in one aggregate under a pushed filter."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_shipdate").alias("first_ship"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT o.o_custkey, o.o_orderkey, lag(o.o_orderkey) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS before, o.o_orderdate IS DISTINCT FROM lag(o.o_orderdate) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS moved FROM orders o""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within a key with a null-safe comparison."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), (~F.col("o_orderdate").eqNullSafe(F.lag("o_orderdate").over(w))).alias("moved"))


@query("""WITH r AS (SELECT c_custkey AS doc, c_nationkey % 5 AS owner FROM customer),
d AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 4 = 0 THEN 9 ELSE c_nationkey % 5 END AS owner, c_acctbal > 0 AS ready, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS expected, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 2000) AS found FROM customer WHERE c_custkey % 5 <> 0)
SELECT r.owner, r.doc, CASE WHEN d.doc IS NULL THEN 'not_found' WHEN NOT ready THEN 'not_ready' WHEN expected <> found THEN 'inconsistent' ELSE 'ready' END AS status FROM r LEFT JOIN d ON r.doc = d.doc AND r.owner = d.owner""")
def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents of their nation's owner, orders as parts; all are asked for, a fifth don't exist, a quarter are another owner's."""
    from paperloom.operators.retrieval import readiness

    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("expected"), F.count_if(F.col("o_totalprice") > 2000).alias("found"))
    requests = c.select("doc", (F.col("c_nationkey") % 5).alias("owner"))
    docs = c.filter("doc % 5 != 0").join(o, "doc", "left").select("doc", F.when(F.col("doc") % 4 == 0, 9).otherwise(F.col("c_nationkey") % 5).alias("owner"), (F.col("c_acctbal") > 0).alias("ready"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return readiness(requests, docs, "owner", "doc")


@query("""WITH e AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 3 THEN 'x' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 40 <> 1)
SELECT count(e.k) AS expected, count(o.k) AS observed, count(*) FILTER (o.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS unexpected, count(*) FILTER (e.k IS NOT NULL AND o.k IS NOT NULL AND e.p IS DISTINCT FROM o.p) AS changed,
count(*) FILTER (o.k IS NULL OR e.k IS NULL OR e.p IS DISTINCT FROM o.p) = 0 AS publishable FROM e FULL OUTER JOIN o ON e.k = o.k""")
def publication_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    o = e.filter("k % 40 != 1").select("k", F.when(F.col("k") % 50 == 3, "x").otherwise(F.col("p")).alias("p"))
    return checks.publication_receipt(e, o, "k", "p")
