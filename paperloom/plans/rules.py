"""Queries of rules and small operators: parsing, data quality, campaign scoring, job decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.functions.identity import ordered_digest, sha256, uuid5
from paperloom.io import table
from paperloom.operators import checks, evaluate, provenance, relational, state
from paperloom.operators import retrieval as R
from paperloom.plans.registry import query
from paperloom.sources import record_rules, records

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_SPACE = T.SPACE_CLASS
_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _plain_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _choice(n: Column, *values: str | None) -> Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


# Parsing


@query("""WITH h AS (SELECT o_orderkey, o_custkey AS total, o_orderkey % 7 AS c, o_orderkey % 1000 AS a, o_orderkey % 1700 AS b FROM orders),
r AS (SELECT *, CASE c WHEN 0 THEN NULL WHEN 1 THEN concat('bytes=', a, '-', b) WHEN 2 THEN concat('bytes=', a, '-') WHEN 3 THEN concat('bytes=-', a) WHEN 4 THEN 'bytes=-' WHEN 5 THEN concat('bytes=', a, '-', b, ',0-1') ELSE concat('items=', a, '-', b) END AS header FROM h)
SELECT o_orderkey, CASE WHEN c = 0 THEN 200 WHEN c = 1 AND a < total AND b >= a OR c = 2 AND a < total OR c = 3 AND a > 0 AND total > 0 THEN 206 ELSE 416 END AS status,
CAST(CASE WHEN c = 0 THEN 0 WHEN c = 1 AND a < total AND b >= a OR c = 2 AND a < total THEN a WHEN c = 3 AND a > 0 AND total > 0 THEN greatest(0, total - a) END AS BIGINT) AS start,
CAST(CASE WHEN c = 0 THEN total WHEN c = 1 AND a < total AND b >= a THEN least(b, total - 1) - a + 1 WHEN c = 2 AND a < total THEN total - a WHEN c = 3 AND a > 0 AND total > 0 THEN least(total, a) END AS BIGINT) AS length FROM r""")
def byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests with Range headers of seven forms."""
    k, t = F.col("o_orderkey"), lambda s: F.lit(s)
    a, b = (k % 1000).cast("string"), (k % 1700).cast("string")
    forms = [F.lit(None), F.concat(t("bytes="), a, t("-"), b), F.concat(t("bytes="), a, t("-")), F.concat(t("bytes=-"), a), t("bytes=-"), F.concat(t("bytes="), a, t("-"), b, t(",0-1")), F.concat(t("items="), a, t("-"), b)]
    header = F.get(F.array(*forms), (k % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.byte_range(header, F.col("o_custkey")).alias("r")).select("o_orderkey", "r.*")


@query(r"""WITH r AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 15 AS VARCHAR), 2, '0') AS ym, o_orderkey % 6 AS c, o_orderkey % 4 AS v FROM orders),
p AS (SELECT *, CASE c WHEN 0 THEN '' WHEN 1 THEN 'arXiv:' WHEN 2 THEN 'https://arxiv.org/abs/' WHEN 3 THEN 'https://export.arxiv.org/abs/' WHEN 4 THEN 'https://www.arxiv.org/pdf/' ELSE 'http://arxiv.org/abs/' END AS head,
CASE WHEN o_orderkey % 3 = 0 THEN 'cond-mat.mes-hall/' || ym || '001' ELSE ym || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END AS id FROM r)
SELECT o_orderkey, CASE WHEN ok THEN id END AS id, CASE WHEN ok AND v > 0 THEN CAST(v AS INTEGER) END AS version FROM (SELECT *, c IN (0, 1, 2, 4) AND CAST(right(ym, 2) AS INTEGER) BETWEEN 1 AND 12 AS ok FROM p)""")
def paper_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and URLs made of order numbers: months 0 to 14, hosts and schemes that hold and that don't."""
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    month = F.concat(pad(k % 100, 2), pad(F.col("o_custkey") % 15, 2))
    id_ = F.when(k % 3 == 0, F.concat(F.lit("cond-mat.mes-hall/"), month, F.lit("001"))).otherwise(F.concat(month, F.lit("."), pad(k % 100000, 5)))
    head = _choice(k % 6, "", "arXiv:", "https://arxiv.org/abs/", "https://export.arxiv.org/abs/", "https://www.arxiv.org/pdf/", "http://arxiv.org/abs/")
    version = F.when(k % 4 > 0, F.concat(F.lit("v"), (k % 4).cast("string"))).otherwise("")
    tail = F.when(k % 6 == 4, ".pdf").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.paper_reference(F.concat(head, id_, version, tail)).alias("r")).select("o_orderkey", "r.id", "r.version")


@query(f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(0, {_K} % 500 - 5) WHEN 1 THEN greatest(0, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-08')) AS BIGINT)) END AS wait FROM events""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as seconds, as HTTP dates, and as neither; now is a fixed instant."""
    e = _events(spark, sf_dir)
    at = F.concat(F.date_format(F.col("ts"), "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(F.col("event_id") % 3 == 0, (F.col("k") % 500 - 5).cast("string")).when(F.col("event_id") % 3 == 1, at).otherwise("soon")
    return e.select("event_id", records.retry_after(value, F.lit("2024-01-08").cast("timestamp")).cast("long").alias("wait"))


@query(rf"""SELECT page_id, nullif(left({_plain_sql(r"regexp_replace(html, '\p{C}', ' ', 'g')")}, 500), '') AS title FROM pages""")
def safe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_title(F.col("html")).alias("title"))


@query(r"""SELECT doc_id, sha256(CASE WHEN length(text) <= 6000 THEN text ELSE regexp_extract(left(text, 6000), '(?s)^(.*) [^ ]*$', 1) END) AS cut FROM documents""")
def text_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sha256(T.cut_at_space(F.col("text"), 6000)).alias("cut"))


@query(f"""WITH h AS (SELECT page_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(url)) AS h FROM pages)
SELECT page_id, concat_ws('-', left(h, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM h""")
def named_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uuid5(NAMESPACE, F.col("url")).alias("id"))


@query(r"""SELECT doc_id, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]|[\x{202a}-\x{202e}\x{2066}-\x{2069}]') AS unsafe FROM (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN concat(text, chr(8238)) WHEN 2 THEN concat(text, chr(7)) ELSE text END AS text FROM documents WHERE text IS NOT NULL)""")
def unsafe_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth text ends with an override, every fifth with a control character."""
    end = F.when(F.col("doc_id") % 5 == 1, F.lit("\u202e")).when(F.col("doc_id") % 5 == 2, F.lit("\x07")).otherwise("")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", T.has_unsafe_unicode(F.concat("text", end)).alias("unsafe"))


@query("""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '\\r\\n|\\r', chr(10), 'g') AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
w AS (SELECT conv_id, turn, text, concat('event: ', role, chr(10), 'data: ', replace(text, chr(10), concat(chr(10), 'data: ')), chr(10), chr(10)) AS wire FROM c)
SELECT conv_id, turn, sha256(wire) AS wire, len(string_split(text, chr(10))) AS lines FROM w WHERE octet_length(encode(wire)) <= 262144""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in wire form; read back, each gives one event with the lines it had, whatever ended them. A message above the limit has no wire form."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role IS NOT NULL")
    c = c.withColumn("wire", records.event_text(F.col("role"), F.col("text"))).withColumn("back", records.parse_events(F.col("wire")))
    return c.filter((F.size("back") >= 1)).select("conv_id", "turn", sha256(F.col("wire")).alias("wire"), F.size(F.split(F.col("back")[0]["data"], "\n")).cast("long").alias("lines"))


# Geometry and arrays


def _box(spark: SparkSession, sf_dir: str, turn: bool = False) -> DataFrame:
    """Items as boxes: x from quantity, y from the line number; with turn, those of every ninth order are turned around."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").cast("double").alias("n"))
    turned = F.when((F.col("l_orderkey") % 9 == 0) & F.lit(turn), -1.0).otherwise(1.0)
    return li.select("l_orderkey", "l_linenumber", G.box(F.col("q"), F.col("n"), F.col("q") + turned * 10, F.col("n") + 1).alias("box"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 9 = 0 OR l_quantity + 10 > 55.01 OR l_linenumber + 1 > 7.01 OR l_orderkey % 50 = 7""")
def outside_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that are turned around, reach beyond their page, or have none (every fiftieth order)."""
    b = _box(spark, sf_dir, turn=True).withColumn("doc", F.col("l_orderkey")).withColumn("page_index", F.lit(0))
    pages = b.filter("l_orderkey % 50 != 7").select("doc", "page_index").distinct().withColumn("page_box", G.box(*[F.lit(x) for x in (0.0, 0.0, 55.0, 7.0)]))
    out = checks.outside_page(b.filter(G.valid_box(F.col("box"))), pages)
    return out.unionByName(b.filter(~G.valid_box(F.col("box")))).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(min(l_linenumber) AS DOUBLE) AS y0, CAST(max(l_quantity + 10) AS DOUBLE) AS x1, CAST(max(l_linenumber) + 1 AS DOUBLE) AS y1 FROM lineitem GROUP BY l_orderkey""")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _box(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("box").alias("boxes"))
    return b.select("l_orderkey", G.union_boxes(F.col("boxes")).alias("u")).select("l_orderkey", "u.*")


@query("""SELECT l_orderkey, l_linenumber, CAST(100 - 2 * (l_linenumber + 1) AS DOUBLE) AS x0, CAST(3 * l_quantity AS DOUBLE) AS y0, CAST(100 - 2 * l_linenumber AS DOUBLE) AS x1, CAST(3 * (l_quantity + 10) AS DOUBLE) AS y1 FROM lineitem""")
def mapped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter turn, stretched and moved."""
    m = F.array(*[F.lit(float(x)) for x in (0, 3, -2, 0, 100, 0)])
    b = _box(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", G.mapped_box(F.col("box"), m).alias("u")).select("l_orderkey", "l_linenumber", "u.*")


@query("SELECT vec_id, vec_id % 4 NOT IN (1, 2) AS numeric, vec_id % 4 = 0 AS regular FROM embeddings")
def array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as they are, one short, and with a value that is no number; six numbers as a matrix: good, two that are singular or short."""
    v, k = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 4
    x = F.when(k == 1, F.slice("embedding", 1, 63)).when(k == 2, F.transform("embedding", lambda e, i: F.when(i == 5, F.lit(float("nan"))).otherwise(e))).otherwise(F.col("embedding"))
    m = F.when(k == 0, F.array(*[F.lit(float(i)) for i in (1, 0, 0, 1, 5, 5)])).when(k == 3, F.array(*[F.lit(float(i)) for i in (1, 2, 2, 4, 0, 0)])).otherwise(F.array(F.lit(1.0)))
    return v.select("vec_id", checks.numeric_array(x, 64).alias("numeric"), G.regular_matrix(m).alias("regular"))


@query("SELECT conv_id, turn, turn % 3 <> 1 OR length(text) = 0 AS ok FROM conversations WHERE text IS NOT NULL")
def boxes_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each character; every third message lacks the last one."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    n = F.greatest(F.lit(0), F.char_length("text") - F.when(F.col("turn") % 3 == 1, 1).otherwise(0))
    one = lambda i: G.box(i.cast("double"), F.lit(0.0), i.cast("double") + 1, F.lit(1.0))
    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    return c.select("conv_id", "turn", checks.boxes_match_text(boxes, F.col("text")).alias("ok"))


# Data quality


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 17 = 3 AND o_orderkey % 5 <> 0""")
def divergent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written again; every seventeenth with another price. Every fifth wasn't there before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    again = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 17 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return checks.divergent(o.filter("o_orderkey % 5 != 0"), again, "o_orderkey")


@query("""WITH j AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS ready FROM orders), p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT coalesce(j.k, p.k) AS k FROM j FULL OUTER JOIN p ON j.k = p.k WHERE coalesce(ready, false) <> (p.k IS NOT NULL)""")
def publication_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("ready"))
    return checks.publication_mismatch(jobs, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct(), "k")


@query("""WITH s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS ordinal FROM orders),
g AS (SELECT run, count(*) AS s, max(ordinal) AS m FROM s GROUP BY run)
SELECT c_custkey AS run FROM customer LEFT JOIN g ON run = c_custkey WHERE s IS NULL OR m <> s - 1 OR s % 5 = 0 OR s > 24 OR s % 5 > 3 OR (s % 5 > 1 AND c_custkey % 2 = 0)""")
def incomplete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as sources (of every seventh one starting at 1) and citations; orders modulo 5 as ideas, of even ones only the first is cited."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.row_number().over(w) - 1).alias("n"))
    sources = o.select("run", (F.col("n") + F.when(F.col("run") % 7 == 0, 1).otherwise(0)).alias("ordinal"))
    count = o.groupBy("run").agg((F.count("*") % 5).cast("int").alias("ideas"))
    ideas = count.filter("ideas > 0").select("run", F.explode(F.sequence(F.lit(0), F.col("ideas") - 1)).alias("ordinal"))
    cites = o.join(count, "run").filter("ideas > 0").select("run", F.when(F.col("run") % 2 == 0, 0).otherwise(F.col("n") % F.col("ideas")).alias("idea"))
    return checks.incomplete_runs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")), sources, ideas, cites)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 'page' ELSE 'message' END AS rule FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 4 = 0 OR o_orderstatus IS DISTINCT FROM 'F'""")
def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as citations of their order's message; every fourth line has a wrong page, finished orders are completed."""
    c = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("citation"), F.col("l_orderkey").alias("message"), (F.col("l_linenumber") + F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(1)).alias("page"), F.col("l_linenumber").alias("page_index"))
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"))
    return checks.citation_rules(c, m).select("citation.*", "rule")


@query("""SELECT conv_id, count(*) AS n FROM (SELECT conv_id, turn + CASE WHEN conv_id % 6 = 1 AND turn > 1 THEN 1 ELSE 0 END AS s FROM conversations) GROUP BY conv_id HAVING count(DISTINCT s) <> count(*) OR min(s) <> 0 OR max(s) <> count(*) - 1""")
def sequence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sequence numbers; of every sixth conversation the third is missing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + F.when((F.col("conv_id") % 6 == 1) & (F.col("turn") > 1), 1).otherwise(0)).alias("s"))
    return state.sequence_violations(c, "conv_id", "s", first=0)


@query(f"""WITH m AS (SELECT doc_id, text AS raw, length(text) AS n, k FROM documents, (SELECT unnest(range(4)) AS k) WHERE text IS NOT NULL)
SELECT doc_id, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN n > 0 WHEN 1 THEN false WHEN 2 THEN regexp_full_match(substr(raw, n // 2 + 1, 1), '{_SPACE}+') AND substr(raw, n // 2 + 1, 1) = ' ' ELSE n > 1 AND left(raw, n - 1) = substr(raw, 2) END AS ok FROM m""")
def mapping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four mappings of each whole text onto itself: the same place, a separator that has a source, the middle character as white space, a place that is off by one."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").alias("raw"), F.char_length("text").alias("n"))
    m = d.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    kind = _choice(F.col("k"), "identity", "separator", "whitespace", "identity")
    middle = F.floor(F.col("n") / 2).cast("int")
    start = F.when(F.col("k") == 2, middle).otherwise(0)
    stop = F.when(F.col("k") == 2, middle + 1).when(F.col("k") == 3, F.col("n") - 1).otherwise(F.col("n"))
    shift = F.when(F.col("k") == 3, 1).otherwise(0)
    return m.select("doc_id", "k", provenance.mapping_valid(kind, start, stop, start + shift, stop + shift, F.col("raw"), F.col("raw")).alias("ok"))


@query("""WITH c AS (SELECT DISTINCT doc_id, sha256(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 1 THEN 'corrupt' ELSE 'ok' END AS status FROM c""")
def verified_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that lacks every eleventh object and holds one byte more in every thirteenth."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content")).distinct()
    refs = d.select(F.col("doc_id").alias("address"), F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    held = d.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("address"), F.when(F.col("doc_id") % 13 == 1, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")).alias("content"))
    return records.verified(held, refs).withColumnRenamed("address", "doc_id")


@query("""WITH c AS (SELECT concat_ws('/', coalesce(source, ''), 'text', sha256(coalesce(text, ''))) AS address, doc_id FROM documents), e AS (SELECT DISTINCT address FROM c WHERE doc_id % 10 = 0)
SELECT DISTINCT address FROM c WHERE doc_id % 10 <> 0 AND address NOT IN (SELECT address FROM e)""")
def stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put into a store by scope, stage and content that holds every tenth document."""
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    c = d.select("doc_id", records.address(F.coalesce("source", F.lit("")), F.lit("text"), content).alias("address"), content.alias("content"))
    return records.put_once(c.filter("doc_id % 10 = 0").select("address", "content"), c.filter("doc_id % 10 != 0").select("address", "content")).select("address")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, list_sort(json_keys(props)) = ['k'] AS closed FROM events""")
def closed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects with exactly the keys they may have."""
    e = _events(spark, sf_dir)
    return e.select("event_id", "k", (F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))).alias("closed"))


@query("""WITH i AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
f AS (SELECT l_orderkey, 'keys' AS rule, 2 * k - 1 AS number FROM i WHERE q = 17 UNION ALL SELECT l_orderkey, 'version', 2 * k FROM i WHERE q = 23 UNION ALL SELECT l_orderkey, 'geometry', 2 * k - 1 FROM i WHERE 10 + q > 55 AND q <> 17
UNION ALL SELECT l_orderkey, 'order', 2 * k FROM i WHERE (CASE WHEN q = 31 THEN k ELSE k - 1 END) <> k - 1 UNION ALL SELECT l_orderkey, 'summary', 2 * count(*) + 1 FROM i GROUP BY l_orderkey HAVING least(count(*), 5) <> count(*))
SELECT l_orderkey, rule, count(*) AS n, CAST(min(number) AS BIGINT) AS first FROM f GROUP BY l_orderkey, rule""")
def record_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as record streams of one page, a block and a span for each item, as wide as its quantity: some are wider than the page, some have a key too many, another version or a number that is off; a summary counts to five at most."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    i = record_rules.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    i = i.select("l_orderkey", F.col("l_quantity").cast("double").alias("q"), F.row_number().over(w).alias("k"))
    q, k = F.col("q"), F.col("k")

    def line(kind: str, **fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("kind"), *[c.alias(name) for name, c in fields.items()]))

    def box(*edges: float | Column) -> Column:
        return F.array(*[(e if isinstance(e, Column) else F.lit(e)).cast("double") for e in edges])

    one, zero = F.lit(1), F.lit(0)
    block = line("block", schema_version=one, page_index=zero, ordinal=k - 1, box=box(10, 10, q + 10, 20), block_type=F.lit("text"), font_size=F.lit(9.5), bold=F.lit(False), source_group=k - 1, more=F.when(q == 17, 1))
    span = line("span", schema_version=F.when(q == 23, 2).otherwise(1), page_index=zero, ordinal=k - F.when(q == 31, 0).otherwise(1), block_ordinal=k - 1, raw_text=F.lit("ab"), character_boxes=F.array(box(10, 10, q / 2 + 10, 20), box(q / 2 + 10, 10, q + 10, 20)))
    items = i.select("l_orderkey", F.inline(F.array(F.struct((2 * k - 1).cast("long").alias("number"), block.alias("line")), F.struct((2 * k).cast("long").alias("number"), span.alias("line")))))
    g = i.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    page = line("page", schema_version=one, page_index=zero, media_box=box(0, 0, 55, 100), crop_box=box(0, 0, 55, 100), rotation=zero, width=F.lit(55), height=F.lit(100), transform=box(1, 0, 0, -1, 0, 100))
    summary = line("summary", schema_version=one, page_count=one, block_count=F.least("n", F.lit(5)), span_count=F.col("n"), character_count=2 * F.col("n"))
    ends = g.select("l_orderkey", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("number"), page.alias("line")), F.struct((2 * F.col("n") + 1).alias("number"), summary.alias("line")))))
    return record_rules.record_defects(items.unionByName(ends), "l_orderkey")


# Campaign scoring


@query("""WITH t AS (SELECT l_orderkey AS c, l_suppkey % 2 AS g, list_sort(list(DISTINCT l_partkey % 40)) AS ids FROM lineitem GROUP BY l_orderkey, l_suppkey % 2), h AS (SELECT o_orderkey AS c, [o_custkey % 40, (o_custkey + 1) % 40, (o_custkey + 2) % 40] AS hits FROM orders WHERE o_orderkey % 6 <> 1),
f AS (SELECT t.c, max(hits IS NOT NULL AND len(list_filter(ids, lambda x: NOT list_contains(hits, x))) = 0) AS found FROM t LEFT JOIN h ON t.c = h.c GROUP BY t.c)
SELECT count(*) AS groups, count(*) FILTER (found) AS recalled FROM f""")
def packed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases with two groups of parts, of which all must be among the hits; every sixth case has none."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 2).alias("group")).agg(F.collect_set((F.col("l_partkey") % 40).cast("long")).alias("ids"))
    k = F.col("o_custkey").cast("long")
    h = table(spark, sf_dir, "orders").filter("o_orderkey % 6 != 1").select(F.col("o_orderkey").alias("case_id"), F.array(k % 40, (k + 1) % 40, (k + 2) % 40).alias("hits"))
    return evaluate.group_recall(g, h)


@query(f"""WITH r AS (SELECT doc_id AS id, {_plain_sql('text')} AS quote, CASE doc_id % 4 WHEN 0 THEN {_plain_sql('text')} WHEN 1 THEN concat('[', {_plain_sql('text')}, ']') WHEN 2 THEN 'other' END AS observed FROM documents WHERE text IS NOT NULL)
SELECT count(*) AS regions, count(*) FILTER (observed = quote) AS exact, CAST(sum(length(quote)) AS BIGINT) AS characters, CAST(sum(CASE WHEN contains(observed, quote) THEN length(quote) ELSE 0 END) AS BIGINT) AS covered FROM r""")
def parser_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as regions; a quarter observed exactly, a quarter within a longer text, a quarter otherwise, a quarter not at all."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), T.collapse(F.col("text")).alias("quote"))
    k = F.col("id") % 4
    seen = d.filter(k != 3).select("id", F.when(k == 0, F.col("quote")).when(k == 1, F.concat(F.lit("["), "quote", F.lit("]"))).otherwise("other").alias("text"))
    return evaluate.coverage(d, seen)


@query("""SELECT o_orderkey AS citation FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def decorative_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citations that no claim (the large items of one part) refers to."""
    claims = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("claim")).agg(F.collect_set("l_orderkey").alias("refs"))
    return evaluate.decorative(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("citation")), claims)


@query("""WITH s AS (SELECT event_type AS allocation, count(CASE WHEN event_type <> 'error' OR event_id % 100 > 0 THEN value END) AS known, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type),
l AS (SELECT DISTINCT event_type AS allocation, CASE event_type WHEN 'click' THEN 1 ELSE 1000000000 END AS lim FROM events UNION ALL SELECT 'unused', 5)
SELECT l.allocation, CASE WHEN s.n IS NULL OR known = n THEN CASE WHEN coalesce(n, 0) <= lim THEN 'within' ELSE 'over' END ELSE 'unknown' END AS status FROM l LEFT JOIN s USING (allocation)""")
def allocation_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit for each event against its type's limit; some amounts of `error` are missing, one allocation isn't used."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    missing = (F.col("event_type") == "error") & (F.col("event_id") % 100 == 0)
    spent = e.select(F.col("event_type").alias("allocation"), F.when(~missing, 1.0).alias("amount"))
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("allocation")).distinct()
    limits = kinds.select("allocation", F.when(F.col("allocation") == "click", 1.0).otherwise(1e9).alias("limit")).union(spark.range(1).select(F.lit("unused"), F.lit(5.0)))
    return evaluate.allocation_use(spent, limits).select("allocation", "status")


@query("""WITH r AS (SELECT l_orderkey AS source, concat('line ', l_partkey, ' of ', l_suppkey) AS region FROM lineitem),
f AS (SELECT l_orderkey AS citation, l_orderkey AS source, CASE l_linenumber % 3 WHEN 0 THEN concat('line ', l_partkey, ' of ', l_suppkey) WHEN 1 THEN concat(l_partkey, ' of ') ELSE 'line ' END AS quote FROM lineitem),
g AS (SELECT DISTINCT citation, source, quote FROM f),
k AS (SELECT citation, quote, count(*) FILTER (region = quote) AS equal, count(*) FILTER (contains(region, quote)) AS within FROM g JOIN r USING (source) GROUP BY citation, quote)
SELECT citation, bool_and(equal > 0 OR within = 1) AS exact FROM k GROUP BY citation""")
def citations_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as regions of their order; fragments that are one, stand in one, or may stand in several."""
    li = table(spark, sf_dir, "lineitem")
    whole = F.concat(F.lit("line "), F.col("l_partkey").cast("string"), F.lit(" of "), F.col("l_suppkey").cast("string"))
    regions = li.select(F.col("l_orderkey").alias("source"), F.lit(0).alias("page"), whole.alias("quote"))
    quote = F.when(F.col("l_linenumber") % 3 == 0, whole).when(F.col("l_linenumber") % 3 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(" of "))).otherwise("line ")
    fragments = li.select(F.col("l_orderkey").alias("citation"), F.col("l_orderkey").alias("source"), F.lit(0).alias("page"), quote.alias("quote")).distinct()
    return evaluate.citations_exact(fragments, regions)


# Retrieval


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey % 900 AS id, CASE WHEN o_orderkey % 31 = 0 THEN 1.5 ELSE 0.5 END AS score, o_custkey % 3 AS scope FROM orders),
c AS (SELECT vec_id AS id, label % 3 AS scope FROM embeddings WHERE vec_id % 7 <> 3), n AS (SELECT *, count(*) OVER (PARTITION BY q, id) AS times FROM h)
SELECT DISTINCT q, id, CASE WHEN score > 1.00001 THEN 'bad_score' WHEN times > 1 THEN 'repeated' WHEN c.scope IS NULL THEN 'unknown' ELSE 'foreign' END AS defect FROM n LEFT JOIN c USING (id) WHERE score > 1.00001 OR times > 1 OR c.scope IS NULL OR n.scope <> c.scope""")
def hit_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of their customer's query: out of bounds, repeated, of no vector, of another scope."""
    k = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), (k % 900).cast("long").alias("id"), F.when(k % 31 == 0, 1.5).otherwise(0.5).alias("score"), (F.col("o_custkey") % 3).cast("int").alias("scope"))
    chunks = table(spark, sf_dir, "embeddings").filter("vec_id % 7 != 3").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("int").alias("scope"))
    return R.hit_defects(hits, chunks).withColumnRenamed("query", "q")


@query("""WITH r AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey % 1000 AS id FROM orders)
SELECT q, rank, id, bool_and(id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 9)) OVER (PARTITION BY q) AS complete FROM r""")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked orders with the texts of documents; every tenth document isn't there."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ranked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.row_number().over(w).alias("rank"), (F.col("o_orderkey") % 1000).cast("long").alias("id"))
    chunks = table(spark, sf_dir, "documents").filter("doc_id % 10 != 9").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return R.hydrate(ranked, chunks).select(F.col("query").alias("q"), "rank", "id", "complete")


@query("""WITH e AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey AS id, concat(' Title  ', o_orderkey % 5) AS title FROM orders),
a AS (SELECT o_custkey AS source, min(o_orderkey) AS id FROM orders GROUP BY o_custkey),
k AS (SELECT e.source, position, e.id FROM e JOIN a USING (source) WHERE NOT CASE WHEN source % 2 = 0 THEN e.id = a.id ELSE e.id % 5 = 2 END)
SELECT source, position, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS n FROM k) WHERE n <= 3""")
def related_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three orders of a customer that aren't the active one: known by id for even customers, by title for others."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("source"), F.row_number().over(w).alias("position"), F.col("o_orderkey").alias("id"), F.concat(F.lit(" Title  "), (F.col("o_orderkey") % 5).cast("string")).alias("title"))
    a = o.groupBy(F.col("o_custkey").alias("source")).agg(F.min("o_orderkey").alias("first")).select("source", F.when(F.col("source") % 2 == 0, F.col("first")).alias("id"), F.lit("TITLE 2").alias("title"))
    return R.select_candidates(e, a).select("source", "position", "id")


@query(f"""SELECT doc_id, CASE WHEN t <> '' THEN t || ' methods and results' ELSE 'methods and results' END AS query FROM (SELECT doc_id, left(coalesce(nullif({_plain_sql("CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END")}, ''), {_plain_sql("coalesce(source, '') || ' ' || coalesce(lang, '')")}), 1000) AS t FROM documents)""")
def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles where there are any, else source and language as headings."""
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", R.source_query(title, F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), "methods and results").alias("query"))


# Jobs


_PRESENT = ("succeeded", "failed", "running", "pending")


@query(f"""WITH j AS (SELECT event_id, (['succeeded', 'failed', 'running', 'pending'])[{_K} % 4 + 1] AS status, (['ready', 'failed', 'parsing', 'queued'])[event_id % 4 + 1] AS stage, {_K} % 3 AS attempts, user_id % 2 AS revision, user_id % 3 > 0 AS published FROM events)
SELECT event_id, CASE WHEN status = 'succeeded' AND stage = 'ready' AND published THEN 'complete' WHEN status = 'failed' AND stage = 'failed' THEN 'failed' WHEN status = 'running' AND stage = 'parsing' THEN 'preparing'
WHEN status = 'pending' AND stage IN ('parsing', 'queued') THEN CASE WHEN attempts = 0 AND revision = 0 THEN 'waiting' ELSE 'delayed' END ELSE 'invalid' END AS shown FROM j""")
def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _events(spark, sf_dir), F.col("k")
    shown = state.presentation(_choice(k % 4, *_PRESENT), _choice(F.col("event_id") % 4, "ready", "failed", "parsing", "queued"), k % 3, F.col("user_id") % 2, F.col("user_id") % 3 > 0)
    return e.select("event_id", shown.alias("shown"))


@query(f"""WITH j AS (SELECT event_id, {_K} % 4 AS asked, user_id % 4 AS revision, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'failed ' END AS s, {_K} % 5 > 0 AS retryable, {_K} % 2 * 3 AS wait, {_K} % 8 AS recent FROM events)
SELECT event_id, CASE WHEN asked > revision THEN 'conflict' WHEN asked < revision THEN 'replay' WHEN s <> 'failed' OR NOT retryable THEN 'not_retryable' WHEN wait > 0 OR recent >= 5 THEN 'wait' ELSE 'accept' END AS decision FROM j""")
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _events(spark, sf_dir), F.col("k")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select("event_id", state.retry_decision(k % 4, F.col("user_id") % 4, status, k % 5 > 0, k % 2 * 3, k % 8).alias("decision"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS used, CAST(ceil(epoch(min(hour) + INTERVAL 1 HOUR) - epoch(TIMESTAMP '2024-01-08')) AS BIGINT) AS resets FROM h GROUP BY user_id""")
def quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user over all windows that are kept, and the seconds until the oldest one ends."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))
    return state.quota_use(e, "user_id", F.lit("2024-01-08").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT user_id, event_id // 4 AS batch, count(*) AS n, sha256(string_agg(concat('{"event_id":', event_id, ',"event_type":', CASE WHEN event_type IS NULL THEN 'null' ELSE concat('"', event_type, '"') END, '}'), '' ORDER BY event_id)) AS digest FROM events GROUP BY user_id, event_id // 4)
SELECT user_id, batch, n, digest FROM c""")
def batch_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four ids and the digest of their rows as JSON with a fixed order of keys."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 4).alias("batch"), "event_id", F.to_json(F.struct("event_id", "event_type"), {"ignoreNullFields": "false"}).alias("json"))
    return e.groupBy("user_id", "batch").agg(F.count("*").alias("n"), ordered_digest(F.col("event_id"), F.col("json")).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN l.n IS NULL THEN o_orderstatus ELSE 'S' END AS o_orderstatus, coalesce(l.n, 0) AS parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def updated_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rewritten from their returned items: a matched row takes the new state, others stay."""
    n = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("parts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return relational.updated_from(o, n.withColumn("o_orderstatus", F.lit("S")), "o_orderkey").select("o_orderkey", "o_orderstatus", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_type) - 1 AS ordinal FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events in the order of stages."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    order = relational.stated_order(F.col("event_type"), ("signup", "view", "click", "purchase"))
    return e.select("user_id", "event_type", (F.row_number().over(Window.partitionBy("user_id").orderBy(order, "event_type")) - 1).alias("ordinal"))


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 10 = 3 DESC, c_custkey) - 1 AS ordinal FROM customer""")
def active_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a set: the active ones first, the others by id."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc(F.col("c_custkey") % 10 == 3), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(w) - 1).alias("ordinal"))


@query("""SELECT event_id, event_type FROM events WHERE event_id BETWEEN 40 AND 79""")
def ordinal_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch of forty by ordinal: a range that reaches the scan, in place of an offset."""
    return relational.ordinal_batch(table(spark, sf_dir, "events"), "event_id", 1, 40).select("event_id", "event_type")


# Provenance


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_partkey, c_custkey, n_name, r_name, p_name FROM l JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def citation_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of seven tables from an item to all it stems from; only finished orders count."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    o = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    j = c.join(o, "l_orderkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(t("nation"), "n_nationkey")
    j = j.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    return j.select("l_orderkey", "l_partkey", "c_custkey", "n_name", "r_name", "p_name")
