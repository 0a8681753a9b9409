"""Quotes traced through chunks to pages, on small cases."""

import pytest
from pyspark.sql import functions as F

from paperloom.io import table
from paperloom.operators import documents, provenance
from paperloom.plans import citations, registry

registry.load()

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(n):
    return [(float(i), 0.0, float(i + 1), 1.0) for i in range(n)]


@pytest.fixture(scope="module")
def traced(spark):
    """Two pages: a hyphen, a ligature, a white space run, a sentence that occurs twice."""
    raw = [(0, 0, "We find ex-"), (0, 0, "plicit  eﬃcient ways."), (0, 1, "Then the end."), (1, 2, "Then the end."), (1, 2, "Last words")]
    rows = [("d", page, i, "text", group, (50.0, 500.0 - 20 * i, 550.0, 510.0 - 20 * i), (0.0, 0.0, 600.0, 800.0), text) for i, (page, group, text) in enumerate(raw)]
    lines = spark.createDataFrame(rows, f"doc string, page_index int, ordinal int, block_type string, source_group int, box {BOX}, page_box {BOX}, raw_text string")
    chunks = documents.chunk_sections(documents.sections(documents.normalize_lines(lines))).withColumn("chunk", F.col("ordinal").cast("int"))
    assert chunks.count() == 1
    m = chunks.select("chunk", F.posexplode("mappings").alias("ordinal", "m")).select("chunk", "ordinal", "m.*")
    spans = spark.createDataFrame([(i, page, text, boxes(len(text))) for i, (page, _, text) in enumerate(raw)], f"span long, page_index int, raw_text string, boxes array<{BOX}>")
    return chunks.select("chunk", F.char_length("text").alias("length")).cache(), m.cache(), spans, chunks.first().text


def test_chunk_text(traced):
    assert traced[3] == "We find explicit efficient ways.\n\nThen the end.\n\nThen the end. Last words"


def test_resolve_citations(spark, traced):
    chunks, m, spans, _ = traced
    quotes = [(1, 0, "find ex-plicit"), (2, 0, "plicit eﬃcient"), (3, 0, "plicit  eﬃcient"), (4, 0, "Then the end."), (5, 0, "the end.Last"), (6, 0, "efficient"), (7, 9, "find"), (8, 0, ""), (9, 0, None), (10, 0, "end.Then")]
    got = {}
    for r in provenance.resolve_citations(spark.createDataFrame(quotes, "citation int, chunk int, quote string"), chunks, m, spans).orderBy("citation", "part").collect():
        got.setdefault(r.citation, []).append(r)
    at = lambda c: [(r.page, r.quote, [tuple(f) for f in r.fragments]) for r in got[c]]
    assert at(1) == [(1, "find ex-plicit", [(0, 3, 11), (1, 0, 6)])]
    assert at(2) == at(3) == [(1, "plicit  eﬃcient", [(1, 0, 15)])]
    assert at(5) == [(2, "the end.Last", [(3, 5, 13), (4, 0, 4)])]
    assert at(10) == [(1, "end.", [(2, 9, 13)]), (2, "Then", [(3, 0, 4)])]
    assert [len(r.boxes) for r in got[10]] == [4, 4] and [tuple(b)[0] for b in got[10][0].boxes] == [9.0, 10.0, 11.0, 12.0]
    for c in (4, 6, 7, 8, 9):  # twice, not in the raw text, unknown chunk, nothing
        assert [(r.status, r.part) for r in got[c]] == [("unresolved", None)], c
    assert all(r.status == "resolved" for c in (1, 2, 3, 5, 10) for r in got[c])


def test_citation_limit_and_missing_span(spark, traced):
    chunks, m, spans, _ = traced
    asked = spark.createDataFrame([(1, 0, "find ex-plicit")], "citation int, chunk int, quote string")
    assert provenance.resolve_citations(asked, chunks, m, spans, limit=13).first().status == "unresolved"
    assert provenance.resolve_citations(asked, chunks, m, spans.filter("span != 4")).first().status == "unresolved"


def test_ranges_with_quotes_and_boxes(spark, traced):
    _, m, spans, text = traced
    a = text.index("efficient")
    asks = spark.createDataFrame([(0, a, a + 9), (0, a + 2, a + 9), (0, 0, len(text))], "chunk int, lo int, hi int")
    got = {(r.lo, r.hi): r for r in provenance.resolve_ranges(m, asks, spans).collect()}
    one = got[a, a + 9].fragments
    assert [(f.span, f.a, f.b, f.quote, f.page_index, len(f.boxes)) for f in one] == [(1, 8, 15, "eﬃcient", 0, 7)]
    assert got[a + 2, a + 9].status == "unresolved"  # cuts the ligature
    assert [f.quote for f in got[0, len(text)].fragments] == ["We find ex-", "plicit  eﬃcient ways.", "Then the end.", "Then the end.", "Last words"]


def test_revalidate_boxes(spark, traced):
    spans = traced[2]
    rows = [(1, 0, 3, 7, "find", boxes(11)[3:7]), (2, 0, 3, 7, "find", boxes(4)), (3, 0, 3, 7, "fine", boxes(11)[3:7]), (4, 0, 8, 12, "ex-", boxes(11)[8:])]
    stored = spark.createDataFrame(rows, f"citation int, span long, source_start int, source_stop int, quote string, boxes array<{BOX}>")
    assert {r.citation: r.ok for r in provenance.revalidate_citations(stored, spans).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_spans_on_pages(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    spans = spark.createDataFrame([("d", 1, 1, "a", [box]), ("d", 2, 2, "b", [box]), ("d", 3, 3, "c", [box]), ("d", 4, 9, "d", [box])], f"doc string, span int, block int, raw_text string, boxes array<{BOX}>")
    blocks = spark.createDataFrame([("d", 1, 7, box, None), ("d", 2, 7, box, True), ("d", 3, 8, box, False)], f"doc string, block int, page int, box {BOX}, excluded boolean")
    pages = spark.createDataFrame([("d", 7, 0, box)], f"doc string, page int, page_index int, page_box {BOX}")
    assert [(r.span, r.page_index) for r in provenance.spans_on_pages(spans, blocks, pages).collect()] == [(1, 0)]


def test_stored_citations(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    citations = f([("o", i, 1, 5, "d", "p1", 1) for i in range(2)] + [("o", 2, 2, 5, "d", "p1", 1), ("o", 3, 1, 6, "d", "p1", 1), ("o", 4, 1, 5, "e", "p1", 1), ("o", 5, 1, 5, "d", "p1", 2), ("q", 6, 1, 5, "d", "p1", 1)], "owner string, citation int, run int, idea int, doc string, page_id string, page int")
    runs = f([("o", 1, "completed"), ("o", 2, "running"), ("q", 1, "completed")], "owner string, run int, state string")
    ideas, sources = f([("o", 1, 5), ("o", 2, 5)], "owner string, run int, idea int"), f([("o", 1, "d", "x"), ("o", 1, "e", "y"), ("o", 2, "d", "x")], "owner string, run int, doc string, profile string")
    pages, published = f([("o", "d", "p1", 0), ("o", "e", "p1", 0)], "owner string, doc string, page_id string, page_index int"), f([("o", "d", "x"), ("o", "e", "x")], "owner string, doc string, profile string")
    assert sorted(r.citation for r in provenance.stored_citations(citations, runs, ideas, sources, pages, published).collect()) == [0, 1]


def test_evidence_labels(spark):
    rows = [("a", 3, 30, 10, 10), ("a", 7, 70, 10, 10), *(("b", i, i, 1, 1) for i in range(6)), ("c", 1, 1, 10, 0), ("d", 1, 1, 12_000, 12_000), ("e", 1, 1, 1, 12_001)]
    got = {}
    for r in provenance.evidence_labels(spark.createDataFrame(rows, "k string, rank int, chunk int, n_text int, n_raw int"), "k").collect():
        got.setdefault(r.k, []).append((r.ref, r.chunk, r.ok))
    assert sorted(got["a"]) == [("S1", 30, True), ("S2", 70, True)] and got["d"] == [("S1", 1, True)]
    assert not any(ok for k in "bce" for _, _, ok in got[k])


def test_normalised_lines_keep_their_document(spark):
    """Running lines of one document leave the others' ids and sections alone."""
    page = (0.0, 0.0, 600.0, 800.0)
    rows = [(d, p, 2 * p + i, "text", p, (50.0, 790.0 - 400 * i, 550.0, 799.0 - 400 * i), page, "Head" if i == 0 and d == "x" else f"{d}{p}{i}") for d in "xy" for p in range(3) for i in range(2)]
    got = documents.normalize_lines(spark.createDataFrame(rows, f"doc string, page_index int, ordinal int, block_type string, source_group int, box {BOX}, page_box {BOX}, raw_text string")).collect()
    assert sorted((r.doc, r.raw_text, r.excluded) for r in got) == sorted((r[0], r[7], r[7] == "Head") for r in rows)


def test_citations_bring_the_boxes_of_cited_spans_only(spark, data, shuffled):
    chars = table(spark, data, "documents").agg(F.sum(F.char_length("text")).alias("n")).first().n
    registry.QUERIES["resolved_citations"](spark, data).collect()
    assert shuffled() < 15 * chars


def test_chunking_does_not_execute_its_input_beforehand(spark, data, shuffled):
    registry.QUERIES["chunk_mappings"](spark, data)
    assert shuffled() == 0


def test_stored_citations_by_rows(spark, monkeypatch):
    """More citations take more tasks, so that none sorts a share that grows with the table."""
    monkeypatch.setattr(provenance, "TASK_ROWS", 100)
    n = spark.range(3000)
    citations = n.selectExpr("id % 7 owner", "id citation", "id % 500 run", "id % 11 idea", "id % 13 doc", "concat('p', id % 13) page_id", "1L page")
    runs = citations.selectExpr("owner", "run", "'completed' state").distinct()
    pages = citations.selectExpr("owner", "doc", "page_id", "0L page_index").distinct()
    published = citations.selectExpr("owner", "doc", "doc % 2 profile").distinct()
    out = provenance.stored_citations(citations, runs, citations.select("owner", "run", "idea").distinct(), citations.selectExpr("owner", "run", "doc", "doc % 2 profile").distinct(), pages, published)
    assert out.rdd.getNumPartitions() >= 30 and out.count() == out.distinct().count() == 3000


def test_citations_bring_texts_to_their_chunk_once(spark, data, shuffled):
    """Boxes that are made of other columns are not shuffled at all, nor do lines go by document first."""
    chars = table(spark, data, "documents").agg(F.sum(F.char_length("text")).alias("n")).first().n
    registry.QUERIES["resolved_citations"](spark, data).collect()
    assert shuffled() < 4 * chars


def test_citation_over_several_spans_of_a_page_keeps_its_boxes(spark, traced):
    chunks, m, spans, _ = traced
    asked = spark.createDataFrame([(1, 0, "find ex-plicit"), (2, 0, "nowhere"), (3, 0, "end.Then")], "citation int, chunk int, quote string")
    got = provenance.resolve_citations(asked, chunks, m, spans).orderBy("citation", "part").collect()
    assert [(r.citation, r.status, r.part, r.page, r.quote, r.boxes and [b.x0 for b in r.boxes], r.fragments and [tuple(x) for x in r.fragments]) for r in got] == [
        (1, "resolved", 1, 1, "find ex-plicit", [*map(float, range(3, 11)), *map(float, range(6))], [(0, 3, 11), (1, 0, 6)]),
        (2, "unresolved", None, None, None, None, None),
        (3, "resolved", 1, 1, "end.", [9.0, 10.0, 11.0, 12.0], [(2, 9, 13)]),
        (3, "resolved", 2, 2, "Then", [0.0, 1.0, 2.0, 3.0], [(3, 0, 4)]),
    ]
    short = spans.withColumn("boxes", F.when(F.col("span") == 3, F.slice("boxes", 1, 3)).otherwise(F.col("boxes")))  # a box is missing: no part of it holds
    assert [r.status for r in provenance.resolve_citations(asked.filter("citation = 3"), chunks, m, short).collect()] == ["unresolved"]


def test_plain_lines_of_repeated_ids(spark, tmp_path):
    """Lines of one id are numbered through, as in SQL; those of others within their text."""
    rows = [(1, "a  b\n\n c\t"), (1, "a  b\n\n c\t"), (2, " \nd"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, citations._plain_lines(spark, str(tmp_path)).collect())) == [(1, 0, "a b"), (1, 1, "a b"), (1, 2, "c"), (1, 3, "c"), (2, 0, "d")]
    spark.createDataFrame(rows[1:], "doc_id long, text string").write.parquet(f"{tmp_path}/one/documents.parquet")
    assert sorted(map(tuple, citations._plain_lines(spark, f"{tmp_path}/one").collect())) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "d")]


def test_chunks_of_lines_are_those_of_their_sections(spark):
    """Hyphens, ligatures, white space, running and missing lines, several sections: the same chunks whether mappings are made before or behind the shuffle."""
    page = (0.0, 0.0, 600.0, 800.0)
    texts = ["Head", "1.", "Title", "We find ex-", "plicit  eﬃcient ways. Then\tthe end.", None, "More words stand here. And some more of them.", " ", "ﬁ", "Foot 3"]
    at = [790, 700, 700, 600, 580, 560, 540, 520, 500, 20]
    rows = [(d, p, 10 * p + i, "heading" if t in ("Title", "ﬁ") else "text", i // 3, (50.0 + 20 * (i == 2), y - 9.0, 60.0 + 20 * (i == 2), float(y)), page, t and t * (1 + 3 * (p == 1 and i == 6))) for d in "xy" for p in range(4) for i, (t, y) in enumerate(zip(texts, at, strict=True))]
    lines = spark.createDataFrame(rows, f"doc string, page_index int, ordinal int, block_type string, source_group int, box {BOX}, page_box {BOX}, raw_text string")
    one = documents.chunk_sections(documents.sections(documents.normalize_lines(lines)), 60, 90, 30)
    two = documents.chunk_lines(lines, 60, 90, 30)
    assert one.schema.simpleString() == two.schema.simpleString()
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect())) and two.filter("ordinal > 5").count()


def test_mappings_are_judged_by_the_law_of_their_kind(spark):
    """Each broken in its own way: the same verdict as that of `mapping_valid`; what is read is every place that a mapping leads to, once."""
    raw = "ab  ﬁ\tc-"
    text = "ab fi c x"
    cases = [(0, 2, 0, 2, "identity"), (0, 2, 1, 3, "identity"), (0, 1, 0, 2, "identity"), (2, 3, 2, 4, "whitespace"), (2, 3, 1, 3, "whitespace"), (0, 1, 2, 4, "whitespace"), (3, 5, 4, 5, "ligature"), (3, 4, 4, 5, "ligature"), (3, 5, 3, 4, "ligature"),
             (5, 6, 5, 6, "whitespace"), (7, 7, 7, 8, "dehyphenation"), (7, 8, 7, 8, "dehyphenation"), (7, 7, 6, 7, "dehyphenation"), (6, 7, 6, 7, "identity"), (6, 7, 6, 9, "identity"), (0, 1, 0, 0, "identity"), (0, 2, 0, 2, "other"), (0, 2, 0, 2, None), (8, 9, 20, 21, "identity"), (4, 2, 0, 2, "identity")]
    kind = "struct<start:int,stop:int,span:long,source_start:int,source_stop:int,kind:string>"
    chunks = spark.createDataFrame([(i, text, [(*c[:2], 5, *c[2:])]) for i, c in enumerate(cases)], f"doc int, text string, mappings array<{kind}>")
    pieces = provenance.span_pieces(chunks)
    joined = pieces.groupBy("doc", "span").agg(F.collect_list(F.struct(*pieces.columns[2:])).alias("pieces")).withColumn("raw_text", F.lit(raw))
    got = {r.doc: r for r in provenance.judged(joined).collect()}
    m = chunks.select("doc", F.inline("mappings"))
    law = m.select("doc", provenance.mapping_valid(F.col("kind"), F.lit(0), F.col("stop") - F.col("start"), F.col("source_start"), F.col("source_stop"), F.substr(F.lit(text), F.col("start") + 1, F.col("stop") - F.col("start")), F.lit(raw)).alias("ok"))
    want = {r.doc: r.ok for r in law.collect()}
    assert {i: got[i].wrong == 0 for i in got} == want and sum(want.values()) == 6
    assert [got[i].raw for i in range(len(cases))] == [raw[max(c[2], 0) : c[3]] for c in cases]
    # two stretches that share characters, one place left out, a separator
    both = spark.createDataFrame([(0, "ab fi", [(0, 2, 5, 0, 2, "identity"), (2, 3, 5, 2, 4, "whitespace"), (3, 5, 5, 4, 5, "ligature"), (5, 5, None, None, None, "separator")]), (0, "b c", [(0, 1, 5, 1, 2, "identity"), (1, 2, None, None, None, "separator"), (2, 3, 5, 6, 7, "identity")])], f"doc int, text string, mappings array<{kind}>")
    pieces = provenance.span_pieces(both)
    assert pieces.count() == 2
    joined = pieces.groupBy("doc", "span").agg(F.collect_list(F.struct(*pieces.columns[2:])).alias("pieces")).withColumn("raw_text", F.lit(raw))
    assert list(map(tuple, provenance.judged(joined).collect())) == [(0, 5, "ab  ﬁc", 0)]


def test_mappings_are_made_behind_the_shuffle(spark, data, shuffled):
    chars = table(spark, data, "documents").agg(F.sum(F.char_length("text")).alias("n")).first().n
    rows = registry.QUERIES["chunk_mappings"](spark, data).collect()
    assert shuffled() < 6 * chars and sum(r.n_wrong for r in rows) == 0
