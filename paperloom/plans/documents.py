"""Queries over document texts: screening, normalisation, chunks, digests, intervals, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.identity import ordered_digest, sha256
from paperloom.io import table
from paperloom.operators import checks, provenance
from paperloom.operators import documents as D
from paperloom.plans.registry import query
from paperloom.plans.retrieval import PLAIN_SQL
from paperloom.sources import records

SPACE = T.SPACE_CLASS


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (line number from 0), line, start, stop (offsets; the line end belongs to no line)."""
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0))
    return rows.withColumn("start", start).withColumn("stop", F.col("start") + F.char_length("line"))


LINES_SQL = """l AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
lines AS (SELECT *, start + length(line) AS stop FROM o)"""


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, 0 AS lo, length(text) // 2 AS hi FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, length(text) // 2, length(text) FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, n // 3 AS span, greatest(start, lo) AS start, least(stop, hi) AS stop, 1000 + start + (n // 2) AS src, start AS s FROM lines JOIN r USING (doc_id) WHERE greatest(start, lo) < least(stop, hi)),
f AS (SELECT doc_id, span, start, stop, src + start - s AS source_start, src + stop - s AS source_stop FROM c),
i AS (SELECT *, CASE WHEN lag(span) OVER w = span AND lag(source_stop) OVER w = source_start THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM i)
SELECT doc_id, span, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, CAST(min(source_start) AS BIGINT) AS source_start, CAST(max(source_stop) AS BIGINT) AS source_stop FROM g GROUP BY doc_id, span, island""")
def fragment_overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fragments (three to a span; sources of two successive lines leave a gap), requested in two halves of each text: the line that is cut is one again."""
    lines = _lines(table(spark, sf_dir, "documents"))
    src = 1000 + F.col("start") + F.floor(F.col("n") / 2)
    intervals = lines.select("doc_id", F.floor(F.col("n") / 3).alias("span"), "start", "stop", src.alias("source_start"))
    length, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), length.alias("hi")))
    requests = table(spark, sf_dir, "documents").select("doc_id", F.inline(halves)).distinct()
    return provenance.merge_adjacent(provenance.clip(intervals, requests, "doc_id"), "doc_id")


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, n, start, stop + 1 AS stop FROM lines WHERE NOT (doc_id % 7 = 0 AND n = 1)),
k AS (SELECT doc_id, stop, start = coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY n), 0) AS fits FROM m),
g AS (SELECT doc_id, bool_and(fits) AS fits, max(stop) AS stop FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(fits AND stop = length(text) + 1, false) AS ok FROM documents d LEFT JOIN g USING (doc_id) WHERE text IS NOT NULL""")
def mapping_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their ends tile each text; in every seventh document the second line is left out."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    m = _lines(docs).filter("NOT (doc_id % 7 = 0 AND n = 1)").select("doc_id", F.col("n").alias("ordinal"), "start", (F.col("stop") + 1).alias("stop"))
    return provenance.covers(m, docs.select("doc_id", (F.char_length("text") + 1).alias("length")), "doc_id")


@query(f"""WITH {LINES_SQL}, k AS (SELECT source, doc_id, CASE WHEN regexp_full_match(trim(line), '[0-9]+') THEN '#' ELSE trim(line) END AS line FROM lines WHERE trim(line) <> ''),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM k GROUP BY source)
SELECT k.source, sha256(line) AS line_sha256, count(DISTINCT doc_id) AS n_pages FROM k JOIN p USING (source) GROUP BY k.source, line, pages HAVING count(DISTINCT doc_id) >= greatest(3, ceil(pages * 0.001))""")
def repeated_line_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents, documents as pages: lines on a thousandth of pages, and on three at least; digits alone count as one line."""
    line = F.trim("line")
    keyed = _lines(table(spark, sf_dir, "documents")).filter(line != "").select("source", "doc_id", F.when(line.rlike(r"^[0-9]+$"), "#").otherwise(line).alias("line"))
    return D.running_lines(keyed, "source", "doc_id", "line", share=0.001).select("source", sha256(F.col("line")).alias("line_sha256"), "n_pages")


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, length(regexp_replace(line, '{SPACE}', '', 'g')) AS solid FROM lines),
g AS (SELECT doc_id, count(*) AS pages, CAST(sum(solid) AS BIGINT) AS chars, count(*) FILTER (solid >= 40) AS substantial FROM s GROUP BY doc_id)
SELECT doc_id, pages, chars, CASE WHEN chars = 0 THEN 'no_text' WHEN chars < 200 OR substantial * 2 < pages THEN 'low_text' ELSE 'ok' END AS status FROM g""")
def document_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    return D.screen(rows.select("doc_id", "page", T.solid_chars(F.col("line")).alias("solid")))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def _terms_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) <= 80 AND x NOT IN {_STOP})"


@query(f"""WITH d AS (SELECT doc_id, left({PLAIN_SQL}, 90) AS title, substr(text, 91) AS abstract FROM documents),
u AS (SELECT doc_id, title, {_terms_sql('title')} AS a, {_terms_sql('abstract')} AS b FROM d WHERE length(title) BETWEEN 1 AND 1000 AND lower(title) NOT IN ('untitled', 'untitled document', 'unknown', 'unknown title', 'error') AND regexp_matches(title, '[\\p{{L}}\\p{{N}}]')),
v AS (SELECT doc_id, list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 12) AS a, b FROM u),
w AS (SELECT doc_id, a, list_slice(list_filter(b, lambda x, i: list_position(b, x) = i AND NOT list_contains(a, x)), 1, 8) AS b FROM v)
SELECT doc_id, '(' || array_to_string(list_transform(a, lambda x: 'all:"' || x || '"'), ' OR ') || ')' || CASE WHEN len(b) = 0 THEN '' ELSE ' AND (' || array_to_string(list_transform(b, lambda x: 'abs:"' || x || '"'), ' OR ') || ')' END AS query FROM w WHERE len(a) > 0""")
def related_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 90 characters as title, all the others as abstract."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.left(T.collapse(F.col("text")), F.lit(90)).alias("title"), F.substring(F.col("text"), F.lit(91), F.char_length("text")).alias("abstract"))
    a = d.filter(T.usable_title(F.col("title"))).withColumn("a", T.distinct_terms(F.col("title"), 12)).filter(F.size("a") > 0)
    b = a.withColumn("b", T.distinct_terms(F.col("abstract"), 8, F.col("a")))
    ored = lambda c, field: F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: F.concat(F.lit(f'{field}:"'), x, F.lit('"'))), " OR "), F.lit(")"))
    return b.select("doc_id", F.concat(ored("a", "all"), F.when(F.size("b") > 0, F.concat(F.lit(" AND "), ored("b", "abs"))).otherwise("")).alias("query"))


HAND_MADE = [(-1, "ﬁnd  the\tﬂow"), (-2, " a  b\r\n\r\nc "), (-3, "eﬃcient oﬄine ﬅ ﬆ"), (-4, ""), (-5, "a😀b")]
_HAND_SQL = " UNION ALL ".join(f"SELECT {i} AS doc_id, " + "concat(" + ", ".join(f"chr({ord(c)})" for c in t) + ")" + " AS text" if t else f"SELECT {i} AS doc_id, '' AS text" for i, t in HAND_MADE)


def _ligatures_sql(text: str) -> str:
    for one, many in T.LIGATURES.items():
        text = f"replace({text}, chr({ord(one)}), '{many}')"
    return text


@query(f"""WITH d AS ({_HAND_SQL} UNION ALL SELECT doc_id, text FROM documents)
SELECT doc_id, length(plain) AS n, sha256(plain) AS plain_sha256 FROM (SELECT doc_id, {PLAIN_SQL.replace('(text,', '(' + _ligatures_sql('text') + ',')} AS plain FROM d)""")
def ligature_whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in HAND_MADE])))
    d = made.unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = T.collapse(T.expand_ligatures(F.col("text")))
    return d.select("doc_id", F.char_length(plain).alias("n"), sha256(plain).alias("plain_sha256"))


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one section; no SQL twin, the tests rebuild the texts from the chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("section"), "text", F.array().cast("array<struct<a:int,b:int>>").alias("atoms"))
    return D.chunk_sections(D.spread(docs)).withColumnRenamed("doc", "doc_id")


_LIGATURES = "".join(T.LIGATURES)


@query(rf"""WITH {LINES_SQL}, a AS (SELECT doc_id, CAST(n AS INTEGER) AS n, n // 40 AS page, n // 5 AS grp, line, 800 - 20 * (n % 40) AS y, length(line) < 60 AND NOT regexp_matches(line, '[.!?,]') AS heading FROM lines WHERE line <> ''),
k AS (SELECT *, CASE WHEN y - 10 >= {800 * (1 - D.MARGIN)} THEN 'top' WHEN y <= {800 * D.MARGIN} THEN 'bottom' END AS band, regexp_replace(regexp_replace({_ligatures_sql('line')}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS plain FROM a),
m AS (SELECT *, CASE WHEN band IS NOT NULL THEN concat(band, ':', CASE WHEN regexp_full_match(plain, '[0-9]+') THEN '#' ELSE plain END) END AS mark FROM k),
p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM a GROUP BY doc_id),
r AS (SELECT doc_id, mark FROM m JOIN p USING (doc_id) WHERE mark IS NOT NULL GROUP BY doc_id, mark, pages HAVING count(DISTINCT page) >= greatest(3, ceil(pages * {D.RUNNING}))),
e AS (SELECT m.*, r.mark IS NOT NULL AS excluded FROM m LEFT JOIN r ON r.doc_id = m.doc_id AND r.mark = m.mark),
h AS (SELECT *, sum(CASE WHEN heading AND NOT excluded THEN 1 ELSE 0 END) OVER w AS section,
coalesce(NOT excluded AND page = lead(page) OVER w AND grp = lead(grp) OVER w AND NOT lead(heading) OVER w AND NOT lead(excluded) OVER w AND regexp_matches(line, '\p{{L}}-$') AND regexp_matches(lead(line) OVER w, '^\p{{Ll}}'), false) AS dropped_hyphen
FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, last_value(CASE WHEN NOT excluded THEN {{'page': page, 'grp': grp, 'dropped': dropped_hyphen}} END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
CASE WHEN dropped_hyphen THEN left(line, length(line) - 1) ELSE line END AS body FROM h)
SELECT doc_id, n AS ordinal, CAST(section AS BIGINT) AS section, excluded, dropped_hyphen, CASE WHEN before IS NULL THEN '' WHEN before.page = page AND before.grp = grp THEN CASE WHEN before.dropped THEN '' ELSE ' ' END ELSE concat(chr(10), chr(10)) END AS separator,
CAST(len(regexp_extract_all(body, '{SPACE}+|[{_LIGATURES}]|[^{SPACE[1:-1]}{_LIGATURES}]+')) + CASE WHEN dropped_hyphen THEN 1 ELSE 0 END AS INTEGER) AS n_mappings, sha256({_ligatures_sql(f"regexp_replace(body, '{SPACE}+', ' ', 'g')")}) AS text_sha256 FROM b""")
def normalised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents laid out on pages of 40 lines, normalised with mappings; the tests check the mappings."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ordinal", "raw_text")).filter("raw_text != ''")
    y = 800.0 - 20.0 * (F.col("ordinal") % 40)
    box = F.struct(F.lit(50.0).alias("x0"), (y - 10).alias("y0"), F.lit(550.0).alias("x1"), y.alias("y1"))
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    kind = F.when((F.char_length("raw_text") < 60) & ~F.col("raw_text").rlike(r"[.!?,]"), "heading").otherwise("text")
    spans = D.normalize_lines(rows.select("doc", F.floor(F.col("ordinal") / 40).cast("int").alias("page_index"), "ordinal", kind.alias("block_type"), F.floor(F.col("ordinal") / 5).cast("int").alias("source_group"), box.alias("box"), page.alias("page_box"), "raw_text"))
    return spans.select(F.col("doc").alias("doc_id"), "ordinal", "section", "excluded", "dropped_hyphen", "separator", F.size("mappings").alias("n_mappings"), sha256(F.col("text")).alias("text_sha256"))


@query("""WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY source, doc_id // 1000)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY block)) AS digest FROM b GROUP BY source""")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest tree: of the texts in each block of a thousand ids, then of the blocks, so that no task orders a whole source."""
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("block"), "doc_id", sha256(F.coalesce("text", F.lit(""))).alias("h"))
    blocks = d.groupBy("source", "block").agg(ordered_digest(F.col("doc_id"), F.col("h")).alias("digest"), F.count("*").alias("n"))
    return blocks.groupBy("source").agg(F.sum("n").alias("n"), ordered_digest(F.col("block"), F.col("digest")).alias("digest"))


@query("""WITH c AS (SELECT doc_id, sha256(coalesce(text, '')) AS address FROM documents), e AS (SELECT DISTINCT address FROM c WHERE doc_id % 10 = 0)
SELECT min(doc_id) AS doc_id, address FROM c WHERE doc_id % 10 <> 0 AND address NOT IN (SELECT address FROM e) GROUP BY address""")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content-addressed store that holds every tenth document already: what the others add, each content once."""
    c = table(spark, sf_dir, "documents").select("doc_id", sha256(F.coalesce("text", F.lit(""))).alias("address"))
    return checks.append_new(c.filter("doc_id % 10 = 0"), c.filter("doc_id % 10 != 0"), "address").select("doc_id", "address")


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
nullif(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '') AS query, try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1), '') AS INTEGER) AS number FROM pages WHERE regexp_matches(url, '^https?://[^/\\s]+')""".replace("\\\\", "\\"))
def url_reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("u", records.url_parts(F.col("url"))).filter("u IS NOT NULL")
    number = F.regexp_extract("u.path", r"/([0-9]+)(?:\.html)?/?$", 1).try_cast("int")
    return p.select("page_id", "u.scheme", "u.host", "u.path", "u.query", number.alias("number"))


@query(r"""WITH e AS (SELECT page_id, regexp_extract(url, '/([0-9]+)(?:\.html)?/?(?:[?#].*)?$', 1) AS id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)
SELECT id, min(page_id) AS position, count(*) AS n, count(DISTINCT host) > 1 AS conflict FROM e WHERE id <> '' GROUP BY id""")
def feed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries whose id is the number in the URL and whose metadata is the host."""
    e = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1).alias("id"), F.regexp_extract("url", r"^https?://([^/?#:]+)", 1).alias("host"))
    return records.dedupe_feed(e.filter("id != ''"), "id", "page_id", "host")


@query("""SELECT id, n FROM (SELECT id, count(*) AS n FROM (SELECT page_id AS id FROM pages UNION ALL SELECT doc_id FROM documents) GROUP BY id) WHERE n <> 1""")
def union_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all pages and documents."""
    return checks.one_owner(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")
