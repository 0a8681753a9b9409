"""Queries that trace quotes back to pages: lines, chunks, ranges, citations and where they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.identity import sha256
from paperloom.io import saved, table
from paperloom.operators import documents as D
from paperloom.operators import provenance
from paperloom.plans.documents import LINES_SQL, _lines
from paperloom.plans.registry import query

PER_CHUNK, PER_PAGE = 10, 5  # lines of a chunk and of a page of the queries below


#: Finds what `collapse` changes; looking for it costs a part of replacing every single space.
_UNEVEN = " {2}|^ | $|" + T.SPACE_CLASS.replace(r"\x1c-\x20", r"\x1c-\x1f")


def _plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, m (number among lines with text), line: each line with white space collapsed.

    Lines are numbered within their text, without a shuffle; only if an id is repeated, by a window over all lines of the id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(_UNEVEN), T.collapse(x)).otherwise(x))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select("doc_id", F.posexplode(F.filter(plain, lambda x: x != "")).alias("m", "line"))
    rows = docs.select("doc_id", F.posexplode(plain).alias("n", "line")).filter("line != ''")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).alias("m"), "line")


PLAIN_LINES_SQL = rf"""raw_lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc_id, n, regexp_replace(regexp_replace(line, '{T.SPACE_CLASS}+', ' ', 'g'), '^ | $', '', 'g') AS line FROM raw_lines),
plain_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS m, line FROM flat WHERE line <> '')"""


def _number(doc, m):
    """One id for a document's line or chunk."""
    return doc.cast("long") * 1_000_000 + m


@query(f"""WITH {LINES_SQL}, kept AS (SELECT doc_id, n, line FROM lines WHERE line <> '')
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(0 AS BIGINT) AS n_wrong, CAST(sum(length(line)) AS BIGINT) AS n_chars, sha256(string_agg(line, '' ORDER BY n)) AS raw_sha256 FROM kept GROUP BY doc_id""")
def chunk_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines to sections to chunks: what the chunks' mappings lead to, read from the raw lines, is every character of each line once, and every mapping's law holds.

    All lines stand in the middle of their page, where none is a running line.
    """
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ordinal", "raw_text")).filter("raw_text != ''")
    y = 500.0 - 5.0 * (F.col("ordinal") % 40)
    box = F.struct(F.lit(50.0).alias("x0"), (y - 4).alias("y0"), F.lit(550.0).alias("x1"), y.alias("y1"))
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    kind = F.when((F.char_length("raw_text") < 60) & ~F.col("raw_text").rlike(r"[.!?,]"), "heading").otherwise("text")
    lines = rows.select("doc", F.floor(F.col("ordinal") / 40).cast("int").alias("page_index"), "ordinal", kind.alias("block_type"), F.floor(F.col("ordinal") / 5).cast("int").alias("source_group"), box.alias("box"), page.alias("page_box"), "raw_text")
    # a chunk's mappings meet their lines as one row for each line, with the text they are judged by
    pieces = provenance.span_pieces(D.chunk_lines(lines))
    m = pieces.groupBy("doc", "span").agg(F.collect_list(F.struct(*pieces.columns[2:])).alias("pieces"))
    g = provenance.judged(m.join(rows.select("doc", F.col("ordinal").cast("long").alias("span"), "raw_text"), ["doc", "span"]))
    d = g.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum("wrong").alias("n_wrong"), F.sum(F.char_length("raw")).cast("long").alias("n_chars"), F.array_sort(F.collect_list(F.struct("span", "raw"))).alias("s"))
    return d.select(F.col("doc").alias("doc_id"), "n_lines", "n_wrong", "n_chars", sha256(F.array_join(F.transform("s", lambda x: x["raw"]), "")).alias("raw_sha256"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, CAST(n // 4 AS INTEGER) AS lo, CAST(3 * n // 4 AS INTEGER) AS hi FROM t UNION SELECT doc_id, CAST(stop AS INTEGER), CAST(stop + 1 AS INTEGER) FROM lines),
f AS (SELECT doc_id, lo, hi, n, greatest(start, lo) - start AS a, least(stop, hi) - start AS b FROM r JOIN lines USING (doc_id) WHERE greatest(start, lo) < least(stop, hi)),
g AS (SELECT doc_id, lo, hi, count(*) AS k, sha256(string_agg(concat(n, ':', CAST(a AS BIGINT), '-', CAST(b AS BIGINT)), ' ' ORDER BY n)) AS places FROM f GROUP BY doc_id, lo, hi)
SELECT r.doc_id, r.lo, r.hi, CASE WHEN k > 0 THEN 'resolved' ELSE 'unresolved' END AS status, CAST(coalesce(k, 0) AS BIGINT) AS n_fragments, coalesce(places, sha256('')) AS places_sha256 FROM r LEFT JOIN g ON g.doc_id = r.doc_id AND g.lo = r.lo AND g.hi = r.hi""")
def resolved_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as chunks of lines and separators: the middle half of each, and every line end, which leads nowhere."""
    lines = _lines(table(spark, sf_dir, "documents"))
    null = F.lit(None).cast("int")
    line = F.struct((2 * F.col("n")).alias("ordinal"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("n").alias("span"), F.lit(0).alias("source_start"), F.char_length("line").alias("source_stop"), F.lit("identity").alias("kind"))
    end = F.struct((2 * F.col("n") + 1).alias("ordinal"), F.col("stop").cast("int").alias("start"), (F.col("stop") + 1).cast("int").alias("stop"), null.alias("span"), null.alias("source_start"), null.alias("source_stop"), F.lit("separator").alias("kind"))
    mappings = lines.select(F.col("doc_id").alias("chunk"), F.inline(F.array(line, end))).filter("start < stop")
    n = F.char_length("text")
    asked = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("chunk"), F.floor(n / 4).cast("int").alias("lo"), F.floor(3 * n / 4).cast("int").alias("hi"))
    asked = asked.union(lines.select("doc_id", F.col("stop").cast("int"), (F.col("stop") + 1).cast("int")))
    out = provenance.resolve_ranges(mappings, asked)
    places = F.array_join(F.transform("fragments", lambda f: F.concat_ws("-", F.concat_ws(":", f["span"].cast("string"), f["a"].cast("string")), f["b"].cast("string"))), " ")
    return out.select(F.col("chunk").alias("doc_id"), "lo", "hi", "status", F.size("fragments").cast("long").alias("n_fragments"), sha256(places).alias("places_sha256"))


@query(f"""WITH {PLAIN_LINES_SQL}, l AS (SELECT doc_id * 1000000 + m // {PER_CHUNK} AS chunk, m % {PER_CHUNK} AS k, doc_id, m, line FROM plain_lines),
c AS (SELECT chunk, string_agg(line, '' ORDER BY k) AS raw FROM l GROUP BY chunk),
p AS (SELECT chunk, 0 AS kind, line AS quote, m // {PER_PAGE} + 1 AS page, NULL AS next_page, length(line) AS cut FROM l WHERE k = 0
UNION ALL SELECT a.chunk, 1, a.line || b.line, a.m // {PER_PAGE} + 1, b.m // {PER_PAGE} + 1, length(a.line) FROM l a JOIN l b ON a.chunk = b.chunk WHERE a.k = {PER_PAGE - 1} AND b.k = {PER_PAGE}
UNION ALL SELECT chunk, 2, concat('<', reverse(line), '>'), NULL, NULL, 0 FROM l WHERE k = 0),
q AS (SELECT p.*, strpos(raw, quote) AS place, raw FROM p JOIN c USING (chunk)),
r AS (SELECT *, place > 0 AND strpos(substr(raw, place + 1), quote) = 0 AND greatest(cut, length(quote) - cut) <= 2000 AS good FROM q)
SELECT chunk, kind, 'resolved' AS status, CAST(1 AS INTEGER) AS part, CAST(page AS INTEGER) AS page, sha256(left(quote, cut)) AS quote_sha256, CAST(cut AS INTEGER) AS n_boxes FROM r WHERE good
UNION ALL SELECT chunk, kind, 'resolved', 2, CAST(next_page AS INTEGER), sha256(substr(quote, cut + 1)), CAST(length(quote) - cut AS INTEGER) FROM r WHERE good AND next_page IS NOT NULL
UNION ALL SELECT chunk, kind, 'unresolved', NULL, NULL, NULL, NULL FROM r WHERE NOT good""")
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines to a chunk, five to a page. Each chunk's quotes: its first line, the two lines at the page's end, which are two parts, and one that isn't there."""
    l = _plain_lines(spark, sf_dir).withColumn("chunk", _number(F.col("doc_id"), F.floor(F.col("m") / PER_CHUNK))).withColumn("k", (F.col("m") % PER_CHUNK).cast("int")).withColumn("n", F.char_length("line"))  # noqa: E741
    n = F.col("n")
    stop = F.sum(n).over(Window.partitionBy("chunk").orderBy("k")).cast("int")
    m = l.select("chunk", F.col("k").alias("ordinal"), (stop - n).alias("start"), stop.alias("stop"), _number(F.col("doc_id"), F.col("m")).alias("span"), F.lit(0).alias("source_start"), n.alias("source_stop"), F.lit("identity").alias("kind"))
    x = lambda i: i.cast("double")
    boxes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(x(i).alias("x0"), F.lit(0.0).alias("y0"), x(i + 1).alias("x1"), F.lit(1.0).alias("y1")))
    spans = l.select(_number(F.col("doc_id"), F.col("m")).alias("span"), F.floor(F.col("m") / PER_PAGE).cast("int").alias("page_index"), F.col("line").alias("raw_text"), "n")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    g = l.groupBy("chunk").agg(at(0).alias("first"), F.concat(at(PER_PAGE - 1), at(PER_PAGE)).alias("across"), F.sum(n).alias("length"))
    quotes = F.array(F.col("first"), F.col("across"), F.concat(F.lit("<"), F.reverse("first"), F.lit(">")))
    proposals = g.select("chunk", F.posexplode(quotes).alias("kind", "quote")).filter("quote IS NOT NULL").select((F.col("chunk") * 3 + F.col("kind")).alias("citation"), "chunk", "quote")
    out = provenance.resolve_citations(proposals, g.select("chunk", "length"), m, spans, boxes=boxes)
    return out.select(F.floor(F.col("citation") / 3).alias("chunk"), (F.col("citation") % 3).cast("int").alias("kind"), "status", F.col("part").cast("int").alias("part"), "page", sha256(F.col("quote")).alias("quote_sha256"), F.when(F.col("part").isNotNull(), F.size("boxes")).alias("n_boxes"))


@query(f"""WITH {PLAIN_LINES_SQL} SELECT doc_id, bool_and(CASE WHEN doc_id % 5 = 0 THEN upper(line) ELSE line END = line) AS ok FROM plain_lines GROUP BY doc_id""")
def revalidated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is quoted in whole by its document's citation; since then, the lines of every fifth document are in upper case."""
    l = _plain_lines(spark, sf_dir).withColumn("span", _number(F.col("doc_id"), F.col("m")))  # noqa: E741
    stored = l.select(F.col("doc_id").alias("citation"), "span", F.lit(0).alias("source_start"), F.char_length("line").alias("source_stop"), F.col("line").alias("quote"))
    now = l.select("span", F.when(F.col("doc_id") % 5 == 0, F.upper("line")).otherwise(F.col("line")).alias("raw_text"))
    return provenance.revalidate_citations(stored, now).withColumnRenamed("citation", "doc_id")


@query(f"""WITH {LINES_SQL}, b AS (SELECT DISTINCT doc_id, n // 5 AS block, n // 40 AS page, coalesce(n // 5 % 7 = 3, false) AS excluded FROM lines),
p AS (SELECT DISTINCT doc_id, n // 40 AS page FROM lines WHERE n // 40 % 4 <> 2)
SELECT l.doc_id, l.n AS span, CAST(b.page AS INTEGER) AS page_index, sha256(l.line) AS raw_sha256, CAST(n // 5 * 10 AS DOUBLE) AS block_y, CAST(b.page * 800 AS DOUBLE) AS page_y
FROM lines l JOIN b ON b.doc_id = l.doc_id AND b.block = l.n // 5 JOIN p ON p.doc_id = b.doc_id AND p.page = b.page WHERE NOT excluded""")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans, five to a block, forty to a page: those of excluded blocks (every seventh, from the fourth) and of pages that aren't known (every fourth, from the third) have no place."""
    l = _lines(table(spark, sf_dir, "documents")).withColumn("block", F.floor(F.col("n") / 5))  # noqa: E741
    page = F.floor(F.col("block") / 8)
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), y.cast("double").alias("y0"), F.lit(600.0).alias("x1"), (y + 10).cast("double").alias("y1"))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    spans = l.select(F.col("doc_id").alias("doc"), F.col("n").alias("span"), "block", F.col("line").alias("raw_text"), none.alias("boxes"))
    blocks = l.select(F.col("doc_id").alias("doc"), "block").distinct().select("doc", "block", page.alias("page"), box(F.col("block") * 10).alias("box"), F.when(F.col("block") % 7 == 3, True).alias("excluded"))
    pages = blocks.select("doc", "page").distinct().filter("page % 4 != 2").select("doc", "page", F.col("page").cast("int").alias("page_index"), box(F.col("page") * 800).alias("page_box"))
    out = provenance.spans_on_pages(spans, blocks, pages)
    return out.select(F.col("doc").alias("doc_id"), "span", "page_index", sha256(F.col("raw_text")).alias("raw_sha256"), F.col("block_box.y0").alias("block_y"), F.col("page_box.y0").alias("page_y"))


@query("""WITH i AS (SELECT o_custkey AS owner, o_orderkey AS run, o_orderstatus, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ideas AS (SELECT DISTINCT owner, run, l_partkey FROM i WHERE l_partkey % 7 <> 0), sources AS (SELECT DISTINCT owner, run, l_suppkey, l_suppkey % 3 AS profile FROM i WHERE l_suppkey % 11 <> 0),
pages AS (SELECT DISTINCT owner, l_suppkey, l_linenumber, l_linenumber - CASE WHEN l_linenumber = 5 THEN 0 ELSE 1 END AS page_index FROM i), publications AS (SELECT DISTINCT owner, l_suppkey, CASE WHEN l_suppkey % 13 = 0 THEN 9 ELSE l_suppkey % 3 END AS profile FROM i)
SELECT i.owner, i.run AS run, i.l_linenumber AS citation, CAST(s.profile AS BIGINT) AS profile FROM i JOIN ideas d ON d.owner = i.owner AND d.run = i.run AND d.l_partkey = i.l_partkey
JOIN sources s ON s.owner = i.owner AND s.run = i.run AND s.l_suppkey = i.l_suppkey JOIN pages g ON g.owner = i.owner AND g.l_suppkey = i.l_suppkey AND g.l_linenumber = i.l_linenumber AND page_index + 1 = i.l_linenumber
JOIN publications p ON p.owner = i.owner AND p.l_suppkey = i.l_suppkey AND p.profile = s.profile WHERE o_orderstatus = 'F'""")
def stored_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as citations of suppliers' pages in an order's run: some ideas, sources and publications are missing, the fifth page is another than the one cited."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("idea"), F.col("l_suppkey").cast("long").alias("doc"))
    i = saved(items.repartition(tasks := provenance.tasks_for(items), "run").join(o.select("owner", "run"), "run"), "items")
    page_id = F.concat_ws("/", F.col("doc").cast("string"), F.col("page").cast("string"))
    citations = i.select("owner", F.col("page").alias("citation"), "run", "idea", "doc", page_id.alias("page_id"), "page")
    distinct = lambda rows, *keys: rows.repartition(tasks, *keys).distinct()
    ideas = distinct(i.filter("idea % 7 != 0").select("owner", "run", "idea"), "owner", "run", "idea")
    sources = distinct(i.filter("doc % 11 != 0").select("owner", "run", "doc", (F.col("doc") % 3).alias("profile")), "owner", "run", "doc")
    pages = distinct(i.select("owner", "doc", page_id.alias("page_id"), (F.col("page") - F.when(F.col("page") == 5, 0).otherwise(1)).alias("page_index")), "owner", "doc", "page_id")
    publications = distinct(i.select("owner", "doc", F.when(F.col("doc") % 13 == 0, 9).otherwise(F.col("doc") % 3).alias("profile")), "owner", "doc", "profile")
    out = provenance.stored_citations(citations, o.select("owner", "run", "state"), ideas, sources, pages, publications)
    return out.select("owner", "run", "citation", "profile")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 80 AS BIGINT) AS n_text, CASE WHEN l_quantity = 17 THEN 0 ELSE CAST(l_quantity * 90 AS BIGINT) END AS n_raw FROM lineitem),
g AS (SELECT l_orderkey, count(*) <= 5 AND sum(n_text) <= 12000 AND sum(n_raw) <= 12000 AND min(n_raw) > 0 AS ok FROM h GROUP BY l_orderkey)
SELECT l_orderkey, concat('S', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) AS ref, l_linenumber AS chunk, ok FROM h JOIN g USING (l_orderkey)""")
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as an order's hits, sizes by quantity; one of a quantity of 17 has no source text."""
    q = F.col("l_quantity")
    h = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("chunk"), (q * 80).cast("long").alias("n_text"), F.when(q == 17, 0).otherwise((q * 90).cast("long")).alias("n_raw"))
    return provenance.evidence_labels(h, "l_orderkey")


@query(f"""WITH {PLAIN_LINES_SQL}, f AS (SELECT doc_id, m, m // 3 % 2 + 1 AS page, line, CASE WHEN lag(m // 3 % 2) OVER w = m // 3 % 2 THEN 0 ELSE 1 END AS fresh FROM plain_lines WINDOW w AS (PARTITION BY doc_id ORDER BY m)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY m) AS part FROM f)
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(page AS INTEGER) AS page, sha256(string_agg(line, '' ORDER BY m)) AS quote_sha256, sum(length(line)) BETWEEN 1 AND 2000 AS ok FROM g GROUP BY doc_id, part, page""")
def citation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as fragments of one citation, three on a page, then three on the other, and so on: a part for each stay."""
    l = _plain_lines(spark, sf_dir)  # noqa: E741
    fragments = l.select(F.col("doc_id").alias("citation"), F.col("m").alias("ordinal"), (F.floor(F.col("m") / 3) % 2).cast("int").alias("page_index"), F.col("line").alias("quote"))
    out = provenance.citations_by_page(fragments)
    return out.select(F.col("citation").alias("doc_id"), "part", "page", sha256(F.col("quote")).alias("quote_sha256"), "ok")


@query(f"""WITH {PLAIN_LINES_SQL} SELECT doc_id, CAST(m // 41 AS INTEGER) AS page_index, CAST(m % 41 AS INTEGER) AS source_order, CAST(row_number() OVER (PARTITION BY doc_id, m // 41 ORDER BY m % 41 > 0, m % 41 % 2 = 0, m) - 1 AS INTEGER) AS position FROM plain_lines""")
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on pages of a title across and two columns that are filled in turn: the title is read first, then the left column, then the right one."""
    l, k = _plain_lines(spark, sf_dir), (F.col("m") % 41).cast("int")  # noqa: E741
    x, y = F.when(k % 2 == 1, 50.0).otherwise(350.0), 20.0 * F.ceil(k / 2) + 20
    box = F.struct(F.when(k == 0, 40.0).otherwise(x).alias("x0"), y.alias("y0"), F.when(k == 0, 560.0).otherwise(x + 200).alias("x1"), (y + 12).alias("y1"))
    items = l.select(F.col("doc_id").alias("doc"), F.floor(F.col("m") / 41).cast("int").alias("page_index"), F.lit(600.0).alias("page_width"), k.alias("source_order"), box.alias("box"))
    return D.reading_order(items).withColumnRenamed("doc", "doc_id")
