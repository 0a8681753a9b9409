"""Operators of the library on small cases, and every registered query against its SQL."""

import glob
import random
import re
import time
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry, text
from paperloom.functions.identity import uuid5
from paperloom.operators import checks, documents, evaluate, indexing, provenance, retrieval, state, vector_index
from paperloom.plans import registry
from paperloom.sources import records
from paperloom.streaming import jobs

registry.load()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return None if v != v else round(float(v), 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    r = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=repr)
    assert sorted((tuple(norm(x[c]) for c in sorted(cols)) for x in rows), key=repr) == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# text


def test_text(spark):
    assert one(spark, text.collapse(F.lit(" a  b\t\nc "))) == "a b c"
    assert one(spark, text.expand_ligatures(F.lit("eﬃcient ﬂow"))) == "efficient flow"
    assert one(spark, text.cut_at_space(F.lit("aaa bbb ccc"), 9)) == "aaa bbb" and one(spark, text.cut_at_space(F.lit("aaaaaa"), 3)) == ""
    assert one(spark, text.distinct_terms(F.lit("The Deep deep net-work of X1"), 3)) == ["deep", "net", "work"]
    assert one(spark, text.casefold(F.lit("Straße"))) == "strasse"
    assert one(spark, text.filename_title(F.lit("dir/My_paper--v2.PDF"))) == "My paper v2"
    assert one(spark, text.has_unsafe_unicode(F.lit("a‮b"))) and not one(spark, text.has_unsafe_unicode(F.lit("a\n‍b")))
    assert not one(spark, text.usable_title(F.lit("Unknown"))) and not one(spark, text.usable_title(F.lit("--")))
    assert one(spark, text.safe_title(F.lit("a\x00 b\x07"))) == "a b"


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    for name in ("a", "paper/1", "ü"):
        assert one(spark, uuid5(ns, F.lit(name))) == str(uuid.uuid5(uuid.UUID(ns), name))


def test_geometry(spark):
    b = geometry.box(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    m = F.array(*[F.lit(float(x)) for x in (0, 1, -1, 0, 10, 0)])
    assert tuple(one(spark, geometry.mapped_box(b, m))) == (6.0, 1.0, 8.0, 3.0)
    assert one(spark, geometry.regular_matrix(m)) and not one(spark, geometry.regular_matrix(F.array(*[F.lit(0.0)] * 6)))
    assert not one(spark, geometry.valid_box(geometry.box(*[F.lit(float(x)) for x in (3, 2, 1, 4)])))
    assert tuple(one(spark, geometry.union_boxes(F.array(b, geometry.box(*[F.lit(float(x)) for x in (0, 3, 2, 9)]))))) == (0.0, 2.0, 3.0, 9.0)


# retrieval


def ranks(spark, dense, lexical):
    rows = [("dense", i, r) for r, i in enumerate(dense, 1)] + [("lexical", i, r) for r, i in enumerate(lexical, 1)]
    return retrieval.fuse(spark.createDataFrame(rows, "channel string, id long, rank int"))


def test_fusion(spark):
    order = lambda f, **k: [r.id for r in retrieval.fused_top(f, 5, **k).orderBy("rank").collect()]
    assert order(ranks(spark, [1, 2], [3, 2])) == [2, 1, 3]
    assert order(ranks(spark, [3], [1])) == [1, 3] and order(ranks(spark, [3], [1]), by_channel=True) == [3, 1]
    assert {r.id: r.score for r in ranks(spark, [1, 1, 2], []).collect()}[2] == round(1 / 63, 12)
    assert ranks(spark, [7], [7]).first().score == round(2 / 61, 12)


@pytest.mark.parametrize("sizes,kept", [([7000, 6000, 3000], [1, 3]), ([7000, 6000, 6000, 6000, 6000, 3000], [1]), ([100], [1])])
def test_packing(spark, sizes, kept):
    rows = [(i, i, n, n) for i, n in enumerate(sizes, 1)]
    assert [r.id for r in retrieval.pack(spark.createDataFrame(rows, "rank int, id long, n_text int, n_raw int")).orderBy("position").collect()] == kept


def test_round_robin(spark):
    schema = "set_id int, source int, rank int, id long, n_text int, n_raw int"
    good = [(1, 0, 1, 10, 9000, 9000), (1, 0, 2, 11, 9000, 9000), (1, 1, 1, 20, 9000, 9000), (1, 1, 2, 21, 2000, 2000)]
    bad = [(2, 0, 1, 10, 20000, 20000), (2, 1, 1, 20, 9000, 9000)]
    gap = [(3, 0, 1, 1, 5, 5), (3, 2, 1, 2, 5, 5)]
    got = {r.set_id: (r.status, [(k.ref, k.id) for k in r.kept]) for r in retrieval.pack_round_robin(spark.createDataFrame(good + bad + gap, schema)).collect()}
    assert got == {1: ("ok", [("P0:S1", 10), ("P1:S1", 20), ("P1:S2", 21)]), 2: ("insufficient", []), 3: ("insufficient", [])}


def test_round_robin_wanted(spark):
    """A last source without hits, a set without hits, and a hit of a source that nobody asked for."""
    hits = [(1, 0, 1, 10, 5, 5), (2, 0, 1, 10, 5, 5), (2, 1, 1, 11, 5, 5), (2, 9, 1, 12, 30_000, 5)]
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)], "set_id int, source int")
    got = {r.set_id: (r.status, [k.id for k in r.kept]) for r in retrieval.pack_round_robin(spark.createDataFrame(hits, "set_id int, source int, rank int, id long, n_text int, n_raw int"), wanted=wanted).collect()}
    assert got == {1: ("insufficient", []), 2: ("ok", [10, 11]), 3: ("insufficient", [])}


def test_bad_vectors_are_not_ranked(spark):
    nan = float("nan")
    v = spark.createDataFrame([(1, 0, [nan, 1.0]), (2, 0, None), (3, 0, [1.0, 0.0]), (4, 0, [0.0, 1.0]), (5, 0, [1.0, None]), (6, 0, [float("inf"), 0.0])], "vec_id long, scope int, embedding array<float>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.5])], "query_id int, scope int, q array<float>")
    assert [(r.rank, r.vec_id) for r in retrieval.dense_topk(v, q, 9).orderBy("rank").collect()] == [(1, 3), (2, 4)]
    assert sorted((r.rank, r.vec_id) for r in retrieval.dense_topk_in_scope(v, q, 9).collect()) == [(1, 3), (2, 4)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """400 documents of three scopes over few words, with their index; small blocks."""
    import random

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (1 + j) for j in range(30)], k=rnd.randrange(1, 60))), f"s{i % 3}") for i in range(400)] + [(900, None, "s0"), (901, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, indexing.build_index(docs, f"file://{tmp_path_factory.mktemp('index')}", scope="source")


def test_index_equals_scan(spark, indexed):
    docs, index = indexed
    asked = ["w0 w9 w25", "w3", "w28 W28 w28", "w0 w1 w2 w3", "nowhere", "", "w29 nowhere", None]
    questions = spark.createDataFrame(list(enumerate(asked)), "question int, text string")
    got = {(r.question, r.rank, r.doc_id, round(r.score, 5)) for r in indexing.search(index, questions, 6).collect()}
    want = set()
    for i, t in enumerate(asked):
        words = sorted(set((t or "").lower().split()))
        if words:
            want |= {(i, r["rank"], r.doc_id, round(r.score, 5)) for r in retrieval.topk(retrieval.bm25(docs.filter("text IS NOT NULL"), words), 6).collect()}
    assert got == want and len(got) > 20


def test_index_prunes_blocks(spark, indexed, monkeypatch):
    docs, index = indexed
    monkeypatch.setattr(indexing, "BLOCK", 8)
    small = indexing.build_index(docs, "file:///tmp/" + uuid.uuid4().hex)
    questions = spark.createDataFrame([(0, "w0 w1")], "question int, text string")
    asked = indexing.question_terms(small, questions)
    kept = indexing.blocks_to_read(small, asked, 3).count()
    assert 0 < kept < small.postings.filter("term IN ('w0', 'w1')").count()
    assert [(r["rank"], r.doc_id) for r in indexing.search(small, questions, 3).orderBy("rank").collect()] == [(r["rank"], r.doc_id) for r in indexing.search(index, questions, 3).orderBy("rank").collect()]
    # a stated question opens the folders of its own terms only
    plan = small.postings.filter("bucket = 5 AND term = 'w1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w1)]" in plan


def test_index_covers(spark, indexed):
    docs, index = indexed
    questions = spark.createDataFrame([(0, "w0 w4 w7", None), (1, "w0 w1", "s1"), (2, "w5", "s2"), (3, "w0 nowhere", None)], "question int, text string, scope string")
    got = sorted((r.question, r["rank"], r.doc_id) for r in indexing.covered(index, questions, 5).collect())
    want = []
    for q, words, scope in ((0, ["w0", "w4", "w7"], None), (1, ["w0", "w1"], "s1"), (2, ["w5"], "s2")):
        part = docs.filter(F.col("source") == scope) if scope else docs
        want += [(q, r["rank"], r.doc_id) for r in retrieval.topk(retrieval.cover_density(part, words), 5).collect()]
    assert got == sorted(want)
    none = indexing.build_index(docs.limit(0), "file:///tmp/" + uuid.uuid4().hex, scope="source")
    assert indexing.search(none, questions, 5).count() == 0 and indexing.covered(none, questions, 5).count() == 0


def test_hybrid_rounds(spark):
    asked = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")], "set_id int, source int, question string")
    hits = [("a", 1, 1, 9000, 9000), ("a", 2, 2, 9000, 9000), ("a", 3, 3, 100, 100), ("b", 1, 4, 500, 500), ("c", 1, 5, 10, 10)]
    got = {r.set_id: (r.status, [(k.ref, k.id) for k in r.kept]) for r in retrieval.hybrid_rounds(spark.createDataFrame(hits, "question string, rank int, id long, n_text int, n_raw int"), asked).collect()}
    # the second of a passes its own budget and is skipped; d has no hit
    assert got == {0: ("ok", [("P0:S1", 1), ("P1:S1", 4), ("P0:S2", 3)]), 1: ("insufficient", [])}


def unit(rnd, center, spread):
    import math

    v = [c + rnd.gauss(0, spread) for c in center]
    return [x / math.sqrt(sum(y * y for y in v)) for x in v]


def test_vector_index(spark):
    """Clustered vectors: the result of a scan, most cells unread, upserts that replace, replay and remove."""
    import random

    rnd = random.Random(6)
    middles = [unit(rnd, [0] * 8, 1) for _ in range(12)]
    rows = [(i, f"s{i % 2}", unit(rnd, middles[i % 12], 0.03)) for i in range(300)] + [(1000, "s0", [2.0] * 8), (1001, "s0", None), (1002, "s0", [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, scope string, embedding array<float>")
    index = vector_index.create(v, f"file:///tmp/{uuid.uuid4().hex}", 8)
    queries = v.filter("vec_id % 25 = 0 AND vec_id < 300").select(F.col("vec_id").alias("query_id"), F.lit("x").alias("scope"), F.col("embedding").alias("q"))

    def check(table):
        got = vector_index.search(spark, index, queries.select("query_id", "q"), 4).collect()
        valid = retrieval.valid_vectors(table, 8).filter("ok").withColumn("scope", F.lit("x"))
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.dense_topk_in_scope(valid, queries, 4).collect())
        return got

    assert all(2 * r.cells_read < r.cells for r in check(v))
    reopened = vector_index.open_index(spark, index.path, 8)
    assert (reopened.centers == index.centers).all() and len(index.centers) == 18
    assert {(r.scope, r.n) for r in vector_index.exact_count(spark, index).collect()} == {("s0", 150), ("s1", 150)}
    moved = spark.createDataFrame([(i, "s1", unit(rnd, middles[0], 0.5)) for i in range(0, 40)] + [(500, "s1", unit(rnd, middles[3], 0.01))], "vec_id long, scope string, embedding array<float>")
    for _ in range(2):
        vector_index.upsert(index, moved, 1)
    assert {(r.scope, r.n) for r in vector_index.exact_count(spark, index).collect()} == {("s0", 130), ("s1", 171)}
    now = v.filter("vec_id >= 40").unionByName(moved)
    check(now)
    vector_index.upsert(index, spark.createDataFrame([(2,), (77,), (9999,)], "vec_id long"), 2, removed=True)
    check(now.filter("vec_id NOT IN (2, 77)"))
    pages, after = [], None
    while page := [r.vec_id for r in vector_index.scroll(spark, index, after, 90).collect()]:
        pages, after = [*pages, *page], page[-1]
    assert pages == sorted(r.vec_id for r in retrieval.valid_vectors(now, 8).filter("ok AND vec_id NOT IN (2, 77)").collect())
    none = vector_index.create(v.limit(0), f"file:///tmp/{uuid.uuid4().hex}", 8)
    assert vector_index.search(spark, none, queries, 4).count() == 0 and vector_index.exact_count(spark, none).count() == 0


def test_score_campaign(spark):
    """A missing case, an unmeasured one and one above its denominator stay in the denominators; diagnostic cases never make up for them."""
    cases = spark.createDataFrame([(1, "primary"), (2, "primary"), (3, "diagnostic"), (4, None)], "case_id int, allocation string")
    expected = spark.createDataFrame([(i, "parser", "coverage", 10, True) for i in (1, 2, 3, 4)] + [(1, "cost", "known", 1, True), (2, "cost", "known", 1, True), (1, "cost", "note", 1, False)], "case_id int, layer string, metric string, den long, gate boolean")
    measured = lambda rows: spark.createDataFrame(rows, "case_id int, layer string, metric string, num long")
    seen = lambda *ids: spark.createDataFrame([(i, "completed") for i in ids], "case_id int, state string")
    score = lambda *a, **b: {(r.layer, r.metric): (r.num, r.den, r.unknown, r.value, r.accepted) for r in evaluate.score_campaign(cases, *a, **b).collect()}
    full = [(i, "parser", "coverage", 10) for i in (1, 2, 4)] + [(1, "cost", "known", 1), (2, "cost", "known", 1)]
    got = score(seen(1, 2, 4), expected, measured(full))
    assert got == {("parser", "coverage"): (30, 30, 0, 1.0, True), ("cost", "known"): (2, 2, 0, 1.0, True), ("cost", "note"): (0, 1, 1, 0.0, True), ("parser", None): (None, None, 0, None, True), ("cost", None): (None, None, 1, None, True), (None, None): (3, 3, 0, 1.0, True)}
    got = score(seen(1, 2, 3), expected, measured([(1, "parser", "coverage", 11), (2, "parser", "coverage", 10), (3, "parser", "coverage", 10), (9, "parser", "coverage", 10), (1, "cost", "known", None), (2, "cost", "known", 1)]))
    assert got["parser", "coverage"] == (10, 30, 2, 0.333333333, False) and got["cost", "known"] == (1, 2, 1, 0.5, False) and got[None, None] == (2, 3, 1, 0.666666667, False)
    assert score(seen(1, 2, 4), expected, measured(full[:3]), required=["parser"])[None, None][4] and not score(seen(1, 2, 4), expected, measured(full), required=["parser", "reader"])[None, None][4]
    bad = evaluate.campaign_defects(cases, spark.createDataFrame([(1, "completed"), (1, "failed"), (2, "odd"), (4, None), (8, "running")], "case_id int, state string"))
    assert sorted(map(tuple, bad.collect())) == [(1, "repeated"), (2, "invalid_state"), (4, "invalid_state"), (8, "unknown_case")]


def test_no_quotes(spark):
    texts = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = provenance.quote_matches(texts, spark.createDataFrame([(1, " "), (2, None)], "item_id long, text string"))
    assert none.count() == 0 and none.columns == ["item_id", "doc_id", "start", "status", "raw_start", "raw_stop"]


def test_web_query(spark):
    d = spark.createDataFrame([(1, "deep learning for graphs"), (2, "learning deep"), (3, "shallow trees"), (4, None)], "doc_id int, text string")
    match = lambda q: sorted(r.doc_id for r in retrieval.lexical_match(d, q).collect())
    assert match("deep learning") == [1, 2] and match('"deep learning"') == [1] and match("deep -graphs or trees") == [2, 3]
    assert match("") == [] and match("-deep") == [] and match("Deep GRAPHS") == [1]


def test_source_query(spark):
    assert one(spark, retrieval.source_query(F.lit(" A  title "), F.array(F.lit("x")), "methods")) == "A title methods"
    assert one(spark, retrieval.source_query(F.lit(None).cast("string"), F.array(F.lit("One"), F.lit("Two")), "m")) == "One Two m"


# documents

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINES = f"doc int, page_index int, ordinal int, block_type string, source_group int, box {BOX}, page_box {BOX}, raw_text string"


def lines(spark, pages):
    """pages: lists of (text, y, group, type)."""
    rows, n = [], 0
    for p, page in enumerate(pages):
        for t, y, g, kind in page:
            rows.append((1, p, n, kind, g, (50.0, y, 50.0 + 5 * len(t), y + 10.0), (0.0, 0.0, 600.0, 800.0), t))
            n += 1
    return spark.createDataFrame(rows, LINES)


def test_normalise_hyphen_and_ligature(spark):
    got = documents.normalize_lines(lines(spark, [[("eﬃ-", 400.0, 1, "text"), ("cient 😀  line", 380.0, 1, "text"), ("Other", 300.0, 2, "text")]])).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["effi", "cient 😀 line", "Other"] and [r.separator for r in got] == ["", "", "\n\n"]
    m = [tuple(x) for x in got[0].mappings]
    assert m == [(0, 1, 0, 1, "identity"), (1, 4, 1, 2, "ligature"), (4, 4, 2, 3, "dehyphenation")]
    assert [tuple(x) for x in got[1].mappings] == [(0, 5, 0, 5, "identity"), (5, 6, 5, 6, "whitespace"), (6, 7, 6, 7, "identity"), (7, 8, 7, 9, "whitespace"), (8, 12, 9, 13, "identity")]


@pytest.mark.parametrize("n,total,out", [(3, 5, True), (3, 6, False), (2, 2, False)])
def test_running_lines(spark, n, total, out):
    pages = [[("Running head", 790.0, 0, "text"), ("same body", 400.0, 1, "text")] if p < n else [("same body", 400.0, 1, "text")] for p in range(total)]
    got = documents.normalize_lines(lines(spark, pages)).collect()
    assert {r.excluded for r in got if r.raw_text == "Running head"} == {out}
    assert not any(r.excluded for r in got if r.raw_text == "same body")


def test_numbered_headings(spark):
    head = [("2.1", 500.0, 3, "text"), ("Methods", 500.0, 4, "heading"), ("Text one.", 400.0, 5, "text")]
    d = lines(spark, [head])
    d = d.withColumn("box", F.when(F.col("raw_text") == "Methods", F.struct(F.lit(90.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(140.0).alias("x1"), F.lit(510.0).alias("y1"))).otherwise(F.col("box")))
    got = documents.normalize_lines(d).orderBy("ordinal").collect()
    assert [(r.section, r.section_title) for r in got] == [(1, "2.1 Methods")] * 3
    joined = documents.sections(documents.normalize_lines(d)).collect()
    assert [r.text for r in joined] == ["2.1\n\nMethods\n\nText one."]


@pytest.mark.parametrize("target,maximum,overlap", [(100, 160, 25), (80, 120, 20), (1600, 2400, 200)])
def test_chunks_rebuild(spark, data, target, maximum, overlap):
    made = ["A sentence with 😀 in it. " * 30 + "\n\n" + "Another one! " * 40, "x" * 1000, "", "word " * 300]
    made += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(20).collect()]
    rows = [(i, 0, t, [(5, 8)]) for i, t in enumerate(made)]
    d = spark.createDataFrame(rows, "doc int, section int, text string, atoms array<struct<a:int,b:int>>")
    by = {}
    for r in documents.chunk_sections(d, target, maximum, overlap).orderBy("doc", "ordinal").collect():
        assert 0 < len(r.text) <= maximum and r.shared <= overlap
        by.setdefault(r.doc, []).append(r)
    for i, t in enumerate(made):
        assert "".join(r.text[r.shared :] for r in by.get(i, [])) == t


def test_chunk_rules():
    first = "One two three. " * 4
    assert documents.chunk_spans(first + "\n\n" + "Four five six. " * 6, [], 70, 100, 0)[0][:2] == (0, len(first) + 2)
    assert documents.chunk_spans("a" * 50, [(18, 23)], 20, 30, 0)[0] == (0, 18, 0)
    spans = documents.chunk_spans("Aaaa bbb. Cccc ddd. Eeee fff. Gggg hhh. ", [], 20, 30, 12)
    assert spans[1][2] == 10 and spans[0][:2] == (0, 20)


def test_reading_order(spark):
    column = [(i, (50.0 + 300 * (i % 2), 100.0 + 20 * (i // 2), 250.0 + 300 * (i % 2), 112.0 + 20 * (i // 2))) for i in range(8)]
    rows = [(1, 0, 600.0, o, b) for o, b in column] + [(1, 0, 600.0, 8, (40.0, 50.0, 560.0, 70.0))]
    got = documents.reading_order(spark.createDataFrame(rows, f"doc int, page_index int, page_width double, source_order int, box {BOX}")).orderBy("position").collect()
    assert [r.source_order for r in got] == [8, 0, 2, 4, 6, 1, 3, 5, 7]


def test_screen(spark):
    rows = [(1, 0, 500), (1, 1, 0), (2, 0, 10), (3, 0, 0), (4, 0, 300), (4, 1, 1), (4, 2, 1)]
    got = {r.doc_id: r.status for r in documents.screen(spark.createDataFrame(rows, "doc_id int, page int, solid int")).collect()}
    assert got == {1: "ok", 2: "low_text", 3: "no_text", 4: "low_text"}


# provenance

MAPPINGS = "chunk int, ordinal int, start int, stop int, span int, source_start int, source_stop int, kind string"


def test_resolve_ranges(spark):
    m = [(1, 0, 0, 4, 7, 0, 4, "identity"), (1, 1, 4, 4, 7, 4, 5, "dehyphenation"), (1, 2, 4, 8, 8, 0, 4, "identity"), (1, 3, 8, 9, 8, 4, 7, "whitespace"), (1, 4, 9, 11, 8, 7, 8, "ligature"), (1, 5, 11, 13, None, None, None, "separator")]
    asks = [(1, 2, 6), (1, 0, 4), (1, 9, 10), (1, 8, 11), (1, 11, 13), (1, 5, 5)]
    got = provenance.resolve_ranges(spark.createDataFrame(m, MAPPINGS), spark.createDataFrame(asks, "chunk int, lo int, hi int"))
    by = {(r.lo, r.hi): (r.status, [tuple(f) for f in r.fragments]) for r in got.collect()}
    assert by[2, 6] == ("resolved", [(7, 2, 5), (8, 0, 2)])
    assert by[0, 4] == ("resolved", [(7, 0, 4)]) and by[8, 11] == ("resolved", [(8, 4, 8)])
    assert all(by[k][0] == "unresolved" for k in ((9, 10), (11, 13), (5, 5)))


def test_mapping_valid(spark):
    rows = [("identity", 0, 2, 0, 2, True), ("identity", 0, 2, 1, 3, False), ("whitespace", 2, 3, 2, 4, True), ("ligature", 3, 5, 4, 5, True), ("dehyphenation", 5, 5, 5, 6, True), ("separator", 2, 3, None, None, True), ("separator", 0, 1, None, None, False), ("other", 0, 1, 0, 1, False)]
    d = spark.createDataFrame(rows, "k string, a int, b int, c int, d int, want boolean")
    ok = provenance.mapping_valid(F.col("k"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit("ab fi"), F.lit("ab \tﬁ-"))
    assert all(r.ok == r.want for r in d.withColumn("ok", ok).collect())


def test_quotes(spark):
    t = spark.createDataFrame([(1, "x aaa  y"), (2, "aa"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "aa"), (2, "a y"), (3, " ")], "item_id int, text string")
    got = {(r.item_id, r.doc_id): (r.start, r.status) for r in provenance.quote_matches(t, q).collect()}
    assert got == {(1, 1): (2, "ambiguous"), (1, 2): (0, "unique"), (2, 1): (4, "unique")}


def test_citation_pages(spark):
    rows = [(1, 0, 3, "a"), (1, 1, 3, "b"), (1, 2, 4, "c"), (1, 3, 3, "d")]
    got = provenance.citations_by_page(spark.createDataFrame(rows, "citation int, ordinal int, page_index int, quote string")).orderBy("part").collect()
    assert [(r.page, r.quote) for r in got] == [(4, "ab"), (5, "c"), (4, "d")]
    stored = spark.createDataFrame([(1, 5, 0, 2, "ab"), (2, 5, 1, 3, "xx"), (3, 9, 0, 1, "a")], "citation int, span int, source_start int, source_stop int, quote string")
    assert {r.citation: r.ok for r in provenance.revalidate_citations(stored, spark.createDataFrame([(5, "abc")], "span int, raw_text string")).collect()} == {1: True, 2: False, 3: False}


# state and checks


def test_failures(spark):
    rows = [("DEPENDENCY_UNAVAILABLE", 1, 0), ("DEPENDENCY_UNAVAILABLE", 4, 200), ("DEPENDENCY_UNAVAILABLE", 5, 0), ("DEPENDENCY_RATE_LIMITED", 2, 301), ("PDF_INVALID", 1, 0), ("?", 1, 0)]
    got = [(r.kind, r.status, r.delay) for r in state.after_failure(spark.createDataFrame(rows, "code string, attempts int, retry_after int")).collect()]
    assert got == [("temporary", "pending", 5), ("temporary", "pending", 200), ("temporary", "failed", 120), ("temporary", "failed", 301), ("unsupported", "failed", 0), ("integrity", "failed", 0)]


def test_presentation_and_retry(spark):
    p = lambda *a: one(spark, state.presentation(*map(F.lit, a)))
    assert [p("succeeded", "ready", 1, 0, True), p("succeeded", "ready", 1, 0, False), p("pending", "queued", 0, 0, False), p("pending", "parsing", 1, 0, False), p("running", "parsing", 1, 0, False), p("failed", "failed", 1, 0, False)] == ["complete", "invalid", "waiting", "delayed", "preparing", "failed"]
    d = lambda *a: one(spark, state.retry_decision(*map(F.lit, a)))
    assert [d(2, 1, "failed", True, 0, 0), d(0, 1, "failed", True, 0, 0), d(1, 1, "running", True, 0, 0), d(1, 1, "failed", True, 3, 0), d(1, 1, "failed", True, 0, 5), d(1, 1, "failed", True, 0, 4)] == ["conflict", "replay", "not_retryable", "wait", "wait", "accept"]


def test_checks(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "b")], "k int, v string")
    assert [r.k for r in checks.divergent(old, new, "k").collect()] == [2]
    assert [tuple(r) for r in checks.append_new(old, new, "k").collect()] == [(3, "b")]
    runs = spark.createDataFrame([(i,) for i in range(4)], "run int")
    sources = spark.createDataFrame([(r, o) for r in range(4) for o in (0, 1)], "run int, ordinal int")
    ideas = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1)], "run int, ordinal int")
    cites = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "run int, idea int")
    assert sorted(r.run for r in checks.incomplete_runs(runs, sources, ideas, cites).collect()) == [1, 2, 3]
    assert sorted(r.k for r in state.sequence_violations(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 1)], "k string, s int"), "k", "s").collect()) == ["b", "c"]
    jobs_ = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "k string, ready boolean")
    assert sorted(r.k for r in checks.publication_mismatch(jobs_, spark.createDataFrame([("a",), ("c",), ("d",)], "k string"), "k").collect()) == ["b", "c", "d"]


def test_evaluation(spark):
    lcs = spark.createDataFrame([(1, list("abcde"), list("xaebd")), (2, [], ["a"])], "id int, expected array<string>, got array<string>")
    assert {r.id: r.recall for r in evaluate.token_lcs_recall(lcs).collect()} == {1: 0.6, 2: None}
    exp = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [9]), (2, 0, [5])], "case_id int, `group` int, ids array<long>")
    assert tuple(evaluate.group_recall(exp, spark.createDataFrame([(1, [2, 1, 7])], "case_id int, hits array<long>")).first()) == (2, 1)
    spent = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("c", 9.0)], "allocation string, amount double")
    limits = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 8.0), ("d", 1.0)], "allocation string, `limit` double")
    assert {r.allocation: r.status for r in evaluate.allocation_use(spent, limits).collect()} == {"a": "within", "b": "unknown", "c": "over", "d": "within"}
    assert [r.citation for r in evaluate.decorative(spark.createDataFrame([("S1",), ("S2",)], "citation string"), spark.createDataFrame([(1, ["S1"])], "claim int, refs array<string>")).collect()] == ["S2"]


# sources and streams


def test_byte_ranges(spark):
    rows = [(None, (200, 0, 100)), ("bytes=0-9", (206, 0, 10)), ("bytes=90-", (206, 90, 10)), ("bytes=-5", (206, 95, 5)), ("bytes=-500", (206, 0, 100)), ("bytes=50-900", (206, 50, 50)), ("bytes=100-", (416, None, None)), ("bytes=-0", (416, None, None)), ("bytes=9-3", (416, None, None)), ("bytes=-", (416, None, None)), ("items=0-1", (416, None, None)), ("bytes=99999999999999999999-", (416, None, None))]
    d = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string")
    got = {r.i: tuple(r.x) for r in d.select("i", records.byte_range(F.col("h"), F.lit(100)).alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_references(spark):
    rows = {"arXiv:1706.03762v5": ("1706.03762", 5), "https://arxiv.org/abs/cs.CL/0102003": None, "hep-th/9901001": ("hep-th/9901001", None), "https://arxiv.org/pdf/1706.03762v2.pdf": ("1706.03762", 2), "http://arxiv.org/abs/1706.03762": None, "https://evil.org/abs/1706.03762": None, "1706.03762?x": None, "": None}
    d = spark.createDataFrame([(k,) for k in rows], "v string")
    for r in d.select("v", records.paper_reference(F.col("v")).alias("x")).collect():
        want = ("cs.CL/0102003", None) if r.v.endswith("0102003") else rows[r.v]
        assert (tuple(r.x) if r.x else None) == want, r.v


def test_records_and_feed(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.jsonl").write_text('{"kind":"page","page_index":0}\n{"kind":"block","ordinal":0}\n{"kind":"span","ordinal":1}\n{"kind":"summary","pages":1,"blocks":1,"spans":1}\nnope\n{"kind":"page","kind":"page"}\n')
    read = records.read_records(spark, str(tmp_path / "r"))
    assert sorted(r.defect or "" for r in read.collect()) == ["", "", "", "", "duplicate_key", "malformed"]
    bad = records.record_violations(read.filter("defect IS NULL").withColumn("doc", F.lit(1)), "doc").collect()
    assert [r.rule for r in bad] == ["ordinals_span"]
    entry = lambda i, t: f"<entry><id>http://arxiv.org/abs/{i}</id><title>{t}</title><summary> s  t </summary><published>2017-06-12T00:00:00Z</published><author><name>A  B</name></author><author><name>C</name></author></entry>"
    (tmp_path / "f.xml").write_text("<feed>" + entry("1706.03762v5", "One") + entry("1706.03762v4", "One") + entry("1706.00001v1", "Two") + entry("1706.00001v2", "Other") + "</feed>")
    feed = records.read_feed(spark, str(tmp_path / "f.xml"))
    first = feed.filter("position = 0").first()
    assert (first.id, first.title, first.authors, first.abstract, first.year) == ("1706.03762", "One", ["A B", "C"], "s t", 2017)
    got = {r.id: (r.position, r.n, r.conflict) for r in records.dedupe_feed(feed, "id", "position", "title", "abstract").collect()}
    assert got == {"1706.03762": (0, 2, False), "1706.00001": (2, 2, True)}


def test_store(spark):
    content = lambda t: bytearray(t.encode())
    a = spark.createDataFrame([("x", content("1")), ("y", content("2"))], "address string, content binary")
    b = spark.createDataFrame([("y", content("2")), ("z", content("3")), ("z", content("3"))], "address string, content binary")
    assert [r.address for r in records.put_once(a, b).collect()] == ["z"]
    import hashlib

    refs = spark.createDataFrame([("x", 1, hashlib.sha256(b"1").hexdigest()), ("y", 1, "0"), ("q", 1, "0")], "address string, size int, sha256 string")
    assert {r.address: r.status for r in records.verified(a, refs).collect()} == {"x": "ok", "y": "corrupt", "q": "missing"}


def test_event_text(spark):
    t = one(spark, records.event_text(F.lit("claim"), F.lit("a\r\nb")))
    assert t == "event: claim\ndata: a\ndata: b\n\n"
    got = one(spark, records.parse_events(F.lit(t + ": note\r\ndata: x\r\n\r\n")))
    assert [tuple(e) for e in got] == [("claim", "a\nb"), ("message", "x")]
    assert one(spark, records.retry_after(F.lit("7"), F.lit("2026-01-01").cast("timestamp"))) == 7
    assert one(spark, records.retry_after(F.lit("Thu, 01 Jan 2026 00:01:00 GMT"), F.lit("2026-01-01").cast("timestamp"))) == 60
    assert one(spark, records.retry_after(F.lit("soon"), F.lit("2026-01-01").cast("timestamp"))) is None


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.hourly_counts(stream, "user_id", "ts", late="1000 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.user_id, r.h, r.n) for r in events.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert {(r.user_id, r.hour, r.n) for r in spark.table("hours").collect()} == want


def test_lease_stream(spark, tmp_path):
    rows = [("a", "claim", 0), ("a", "heartbeat", 60), ("a", "succeed", 100), ("b", "claim", 0), ("b", "succeed", 95), ("c", "claim", 10), ("d", "claim", 90_000)]
    d = spark.createDataFrame(rows, "job string, kind string, s long").select("job", "kind", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = jobs.leases(stream).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("leases").collect():
        got.setdefault(r.job, []).append((r.status, r.generation))
    assert got["a"] == [("succeeded", 1)] and got["b"][0][0] == "running" and got["d"][0] == ("running", 1)


def test_hits(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, "a"), (1, 11, 1.5, "a"), (1, 12, 0.2, "a"), (1, 12, 0.2, "a"), (1, 13, 0.1, "a"), (1, 14, 0.1, "a")], "query int, id int, score double, scope string")
    chunks = spark.createDataFrame([(10, "a", "t"), (11, "a", "t"), (12, "a", "t"), (14, "b", "t")], "id int, scope string, text string")
    assert {r.id: r.defect for r in retrieval.hit_defects(hits, chunks).collect()} == {11: "bad_score", 12: "repeated", 13: "unknown", 14: "foreign"}
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (2, 1, 12)], "query int, rank int, id int")
    assert {(r.query, r.id, r.complete) for r in retrieval.hydrate(ranked, chunks).collect()} == {(1, 10, False), (1, 99, False), (2, 12, True)}


def test_candidates(spark):
    entries = spark.createDataFrame([(s, i, f"id{i}", t) for s in (1, 2) for i, t in enumerate(["A  title", "Two", "Three", "Four", "Five"])], "source int, position int, id string, title string")
    active = spark.createDataFrame([(1, "id1", "x"), (2, None, "a TITLE")], "source int, id string, title string")
    got = {(r.source, r.id) for r in retrieval.select_candidates(entries, active).collect()}
    assert got == {(1, "id0"), (1, "id2"), (1, "id3"), (2, "id1"), (2, "id2"), (2, "id3")}


def test_citation_scores(spark):
    regions = spark.createDataFrame([("s", 1, "one line"), ("s", 1, "two lines"), ("s", 1, "one line more")], "source string, page int, quote string")
    f = spark.createDataFrame([(1, "s", 1, "two lines"), (2, "s", 1, "line m"), (3, "s", 1, "one"), (4, "s", 2, "two lines")], "citation int, source string, page int, quote string")
    assert {r.citation: r.exact for r in evaluate.citations_exact(f, regions).collect()} == {1: True, 2: True, 3: False, 4: False}
    cites = spark.createDataFrame([(1, 1, 4, 3), (2, 1, 3, 3), (3, 2, 4, 3), (4, 9, 4, 3)], "citation int, message int, page int, page_index int")
    rules = {r.citation: r.rule for r in checks.citation_rules(cites, spark.createDataFrame([(1, "completed"), (2, "running")], "message int, state string")).collect()}
    assert rules == {2: "page", 3: "message", 4: "message"}


# whole jobs of queries whose SQL twin still does a part, against plain Python


def rows_of(data, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return con.execute(sql).fetchall()


def test_library_listing_whole(spark, data):
    returned = {k for (k,) in rows_of(data, "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")}
    orders = rows_of(data, "SELECT o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")
    want = [(k, k in returned) for _, k in sorted(orders, key=lambda r: (-r[0].toordinal(), r[1]))]
    assert len(want) > 50
    assert [(r.o_orderkey, r.published) for r in registry.QUERIES["library_listing"](spark, data).collect()] == want


def test_history_window_whole(spark, tmp_path):
    """Pairs of 3000 characters: two fit into 8000, none into 1200; one of 8001 ends the window; six pairs at most."""
    sizes = {1: [3000, 3000, 3000], 2: [10, 8001, 10], 3: [10] * 8, 4: [8000]}
    turns = [(c, 2 * i + j, ("user", "assistant")[j], "x" * (n - 1 if j else 1)) for c, s in sizes.items() for i, n in enumerate(s) for j in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r["size"]) for r in registry.QUERIES["history_window"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, 3000), (1, 4, 3000), (2, 4, 10), *[(3, 2 * i, 10) for i in range(2, 8)], (4, 0, 8000)]


def test_unknown_aware_totals_whole(spark, data):
    seen = {}
    for source, quality in rows_of(data, "SELECT d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"):
        seen.setdefault(source, []).append(quality)
    want = {s: (len(q), len([x for x in q if x is not None]), None if None in q else sum(q)) for s, q in seen.items()}
    assert {r.source: (r.n, r.known, r.total) for r in registry.QUERIES["unknown_aware_totals"](spark, data).collect()} == want


def test_immutable_fact_changes_whole(spark, data):
    last, want = {}, []
    for user, event, kind in sorted(rows_of(data, "SELECT user_id, event_id, event_type FROM events"), key=lambda r: r[:2]):
        if user in last and last[user] != kind:
            want.append((user, event))
        last[user] = kind
    assert sorted(map(tuple, registry.QUERIES["immutable_fact_changes"](spark, data).collect())) == sorted(want)


def test_array_overlap_violations_whole(spark, data):
    n = {}
    for supplier, part, _ in set(rows_of(data, "SELECT l_suppkey, l_partkey, l_orderkey FROM lineitem")):
        n[supplier, part] = n.get((supplier, part), 0) + 1
    want = {(*k, v) for k, v in n.items() if v > 1}
    assert {(r.scope, r.element, r.n) for r in registry.QUERIES["array_overlap_violations"](spark, data).collect()} == want


def test_fragment_overlap_clip_whole(spark, data):
    want = []
    for doc, text in rows_of(data, "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"):
        start = 0
        for n, line in enumerate(text.split("\n")):
            stop, src = start + len(line), 1000 + start + n // 2
            if line:
                want.append((doc, n // 3, start, stop, src, src + len(line)))
            start = stop + 1
    got = registry.QUERIES["fragment_overlap_clip"](spark, data).select("doc_id", "span", "start", "stop", "source_start", "source_stop").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_related_terms_query_whole(spark, tmp_path):
    spark.createDataFrame([(1, "alpha " * 100 + "zebra")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["related_terms_query"](spark, str(tmp_path)).first().query == '(all:"alpha") AND (abs:"zebra")'


def test_union_identity_check_whole(spark, data):
    n = {}
    for (i,) in rows_of(data, "SELECT page_id FROM pages") + rows_of(data, "SELECT doc_id FROM documents"):
        n[i] = n.get(i, 0) + 1
    got = registry.QUERIES["union_identity_check"](spark, data).collect()
    assert {tuple(r) for r in got} == {(i, k) for i, k in n.items() if k != 1}


def test_resume_stage_whole(spark, data):
    done = {}
    for user, k in rows_of(data, "SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) FROM events"):
        done.setdefault(user, set()).add(min(k % 6, user % 7))
    want = {u: state.STAGES[min((i for i in range(6) if i not in d), default=5)] for u, d in done.items()}
    assert {r.user_id: r.stage for r in registry.QUERIES["resume_stage"](spark, data).collect()} == want
    assert len(set(want.values())) > 2


def test_readiness_gate_whole(spark, data):
    got = registry.QUERIES["readiness_gate"](spark, data).collect()
    assert sorted(r.doc for r in got) == sorted(i for (i,) in rows_of(data, "SELECT c_custkey FROM customer"))
    assert len({r.status for r in got}) > 2


def test_set_difference_in_one_grouping(spark):
    e, o = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([1, 1, 2, None], [2, 3, 3, None]))
    d = checks.set_difference(e, o, "k")
    assert sorted(map(tuple, d.collect()), key=repr) == [(1, "missing"), (3, "unexpected"), (None, "missing"), (None, "unexpected")]
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_pages_over_the_ends_of_batches_are_ordered_by_several_tasks(spark):
    box = F.struct(F.lit(0.0).alias("x0"), (-10.0 * F.col("k")).alias("y0"), F.lit(9.0).alias("x1"), (5 - 10.0 * F.col("k")).alias("y1"))
    items = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("doc"), (F.col("id") % 7).cast("int").alias("page_index"), F.lit(100.0).alias("page_width"), F.col("id").alias("k"), F.col("id").cast("int").alias("source_order"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = documents.reading_order(items.withColumn("box", box).drop("k"))
        rows, tasks = out.collect(), out.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pages = {}
    for r in rows:
        pages.setdefault((r.doc, r.page_index), []).append((r.position, r.source_order))
    assert len(pages) == 21 and sum(map(len, pages.values())) == 500 and tasks > 1
    for (doc, page), p in pages.items():
        assert [s for _, s in sorted(p)] == sorted((s for s in range(500) if (s % 3 or None, s % 7) == (doc, page)), reverse=True)


def test_index_is_built_with_one_shuffle_of_its_postings(spark, data, shuffled, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chars = docs.agg(F.sum(F.char_length("text")).alias("n")).first().n
    indexing.build_index(docs, f"file://{tmp_path}/index", scope="source")
    assert shuffled() < 9 * chars


def test_the_bound_of_a_search_is_a_full_score(spark, indexed):
    _, index = indexed
    questions = spark.createDataFrame([(0, "w0 w1 w2 w3 w25"), (1, "w0 w29")], "question int, text string")
    bounds = {r.question: r.bound for r in indexing._bounds(index, indexing.question_terms(index, questions), 3).collect()}
    third = {r.question: r.score for r in indexing.search(index, questions, 3).collect() if r["rank"] == 3}
    assert bounds.keys() == third.keys() == {0, 1}
    assert all(0.7 * third[q] <= bounds[q] <= third[q] + 1e-5 for q in third)


def test_cells_are_scored_at_once(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 3, [0.6, 0.8])], "cell int, vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0], 0, None), (7, [1.0, 0.0], 1, 0.9), (8, [0.0, 1.0], 1, 0.5)], "query_id int, q array<float>, cell int, kth double")
    got = sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in vector_index._best_of_cells(rows, asked, 1, 2).collect())
    assert got == [(7, 1, 1.0), (8, 3, 0.8)]


def test_mapped_text_by_pieces():
    """The same mappings as from the pieces of a regular expression, in less CPU time than finding these takes."""
    rng = random.Random(3)
    signs = ["a", "b", "é", " ", " ", "  ", "\t", "\x1c", "\x85", "ﬁ", "ﬃ", "ﬆ", "😀", "￿", "-"]
    raw = [None if rng.random() < 0.05 else "".join(rng.choice(signs) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    drop = [bool(t) and rng.random() < 0.3 for t in raw]
    texts, mappings = documents.mapped_text(raw, drop)
    piece = re.compile(r"\s+|[ﬀﬁﬂﬃﬄﬅﬆ]|[^\sﬀﬁﬂﬃﬄﬅﬆ]+")
    for t, d, got, ms in zip(raw, drop, texts, mappings.to_pylist(), strict=True):
        at = source = 0
        plain, expected = "", []
        for p in piece.findall((t or "")[: -1 if d else None]):
            new, kind = (" ", "whitespace") if p.isspace() else (text.LIGATURES[p], "ligature") if p in text.LIGATURES else (p, "identity")
            expected.append({"start": at, "stop": at + len(new), "source_start": source, "source_stop": source + len(p), "kind": kind})
            plain, at, source = plain + new, at + len(new), source + len(p)
        expected += [{"start": at, "stop": at, "source_start": source, "source_stop": source + 1, "kind": "dehyphenation"}] * d
        assert ms == expected and got == (None if t is None else plain)
    words = ["some words of a line " * 10] * 2000

    def least(f) -> float:
        taken = []
        for _ in range(4):
            began = time.process_time()
            f()
            taken.append(time.process_time() - began)
        return min(taken)

    assert least(lambda: documents.mapped_text(words, [False] * len(words))) < least(lambda: [[p.isspace() for p in piece.findall(t)] for t in words])
