"""Retrieval: exact dense top-k, lexical match with cover density, BM25, rank fusion, packing under budgets.

Queries are small stated sets, the rest are tables. A top-k with one query is TakeOrderedAndProject;
with many queries it is a rank by query after the scope has been joined by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import terms

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def valid_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Adds norm2 and ok: of the right length, finite, of unit norm within 1e-5."""
    norm2 = dot(F.col("embedding"), F.col("embedding"))
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < 1e30))
    return vectors.withColumn("norm2", norm2).withColumn("ok", F.coalesce((F.size("embedding") == dim) & finite & (F.abs(norm2 - 1) <= 1e-5), F.lit(False)))


def scored_vectors(joined: DataFrame, *keep: str) -> DataFrame:
    """keep..., vec_id, score of rows (embedding, q); vectors without a finite score, such as null ones or those with NaN, aren't ranked."""
    score = F.round(dot(F.col("embedding"), F.col("q")), 9)
    return joined.select(*keep, "vec_id", score.alias("score")).filter(F.abs("score") < float("inf"))  # null and NaN fail


def dense_topk(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """rank, vec_id, score of the k nearest to the single vector of `query` (column q); ties by id. Nothing if there is none, which a caller that needs evidence must refuse."""
    one = F.broadcast(query.select("q").limit(1))
    top = scored_vectors(vectors.join(one)).orderBy(F.desc("score"), "vec_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


def dense_topk_in_scope(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id: for each row of queries (query_id, scope, q) the k nearest among vectors of its scope."""
    scored = scored_vectors(vectors.join(queries, "scope"), "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id")


def compare_vectors(expected: DataFrame, observed: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """vec_id, status of the full outer comparison: missing, extra, changed or same."""
    a, b = expected.select("vec_id", F.col("embedding").alias("e")), observed.select("vec_id", F.col("embedding").alias("o"))
    near = F.forall(F.zip_with("e", "o", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
    status = F.when(F.col("o").isNull(), "missing").when(F.col("e").isNull(), "extra").when(near, "same").otherwise("changed")
    return a.join(b, "vec_id", "full_outer").select("vec_id", status.alias("status"))


def parse_web_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, words): bare words are all needed, "..." is a phrase, - excludes, `or` separates."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        words = re.findall(r"[^\W_]+", (phrase or word).lower())
        if words:
            groups[-1].append((not minus, words))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def lexical_match(docs: DataFrame, query: str) -> DataFrame:
    """The rows of docs that match; a query without terms matches nothing.

    Words and phrases are looked up in the text's terms joined by single spaces.
    """
    joined = F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" "))
    found = F.lit(False)
    for group in parse_web_query(query):
        every = F.lit(True)
        for wanted, words in group:
            holds = F.contains(joined, F.lit(f" {' '.join(words)} "))
            every = every & (holds if wanted else ~holds)
        found = found | every
    return docs.filter(F.coalesce(found, F.lit(False)))


def cover_density(docs: DataFrame, words: list[str], reach: int = 16) -> DataFrame:
    """doc_id, score: sum over the minimal intervals holding all words of 1, or reach / length beyond the reach.

    Cover density ranking as published (Clarke, Cormack, Tudhope). Only occurrences of query words
    are exploded and the windows run within a document.
    """
    wanted = F.array(*map(F.lit, words))
    hits = docs.select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term")).filter(F.array_contains(wanted, F.col("term")))
    upto = Window.partitionBy("doc_id").orderBy("pos")
    last = [F.max(F.when(F.col("term") == w, F.col("pos"))).over(upto) for w in words]
    complete = F.lit(True)
    for c in last:
        complete = complete & c.isNotNull()
    starts = hits.select("doc_id", "pos", F.when(complete, F.least(*last) if len(last) > 1 else last[0]).alias("start"))
    before = F.max("start").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    covers = starts.withColumn("before", before).filter(F.col("start").isNotNull() & (F.col("before").isNull() | (F.col("start") > F.col("before"))))
    length = F.col("pos") - F.col("start") + 1
    return covers.groupBy("doc_id").agg(F.round(F.sum(F.least(F.lit(1.0), F.lit(float(reach)) / length)), 6).alias("score"))


def bm25(docs: DataFrame, words: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id, score of documents with a query word; words count once. Statistics are over all of docs."""
    words = sorted(set(words))
    t = docs.select("doc_id", terms(F.col("text")).alias("t"))
    times = lambda word: F.size(F.filter("t", lambda x: x == word))
    tf = [times(w).alias(f"tf{i}") for i, w in enumerate(words)]
    counted = t.select("doc_id", F.size("t").alias("len"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    scored = counted.filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(words))], F.lit(0)) > 0).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)
    return scored.select("doc_id", F.round(score, 6).alias("score"))


def topk(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """rank, id, score: score falling, id rising."""
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"), id_col, "score")


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score, dense_rank, lexical_rank from rows (channel, id, rank): the sum of 1 / (k + rank).

    Of an id that a channel repeats only the first rank counts; the others keep their places.
    """
    first = ranked.groupBy("channel", "id").agg(F.min("rank").alias("rank"))
    by = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank")))
    return first.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), by("dense").alias("dense_rank"), by("lexical").alias("lexical_rank"))


def fused_top(fused: DataFrame, n: int, by_channel: bool = False) -> DataFrame:
    """rank, id: ties by id, or first by dense and then lexical rank."""
    ties = [F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")] if by_channel else []
    order = [F.desc("score"), *ties, F.asc("id")]
    top = fused.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id")


def fused_top_of_each(ranked: DataFrame, key: str, n: int, k: int = RRF_K) -> DataFrame:
    """key, rank, id: fuse() and the n best of rows (key, channel, id, rank) for each key by itself; ties by id."""
    first = ranked.groupBy(key, "channel", "id").agg(F.min("rank").alias("rank"))
    fused = first.groupBy(key, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return fused.withColumn("rank", place).filter(F.col("rank") <= n).select(key, "rank", "id")


def hybrid_rounds(hits: DataFrame, asked: DataFrame, per_source: int = 2) -> DataFrame:
    """set_id, status, kept of pack_round_robin() for sets of sources (set_id, source, question) and hits (question, rank, id, n_text, n_raw) of each question.

    What a question may use is packed under its own budget first; of that the per_source first go into the rounds.
    """
    kept = pack(hits, "question").join(hits.select("question", "id", "n_text", "n_raw"), ["question", "id"])
    rows = kept.filter(F.col("position") <= per_source).join(asked, "question")
    return pack_round_robin(rows.select("set_id", "source", F.col("position").alias("rank"), "id", "n_text", "n_raw"), per_source, wanted=asked)


def pack(hits: DataFrame, group: str | None = None, considered: int = 5, budget: int = 12_000) -> DataFrame:
    """Rows (group..., rank, id, n_text, n_raw) that are kept: in order of rank, one that would pass either budget is skipped, later ones may fit.

    A fold over the at most `considered` first rows of each group, which are ranked before they are gathered.
    """
    keys, order = [group] if group else [], ["rank", "id", "n_text", "n_raw"]
    if group:
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        hits = hits.select(group, *order, place.alias("place__")).filter(F.col("place__") <= considered)
    else:
        hits = hits.orderBy(*order).limit(considered)
    rows = F.sort_array(F.collect_list(F.struct(*order)))
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("r"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["t"] + x["n_text"] <= budget) & (acc["r"] + x["n_raw"] <= budget)
        grown = F.struct((acc["t"] + x["n_text"]).alias("t"), (acc["r"] + x["n_raw"]).alias("r"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))
        return F.when(fits, grown).otherwise(acc)

    packed = hits.groupBy(*keys).agg(F.aggregate(rows, start, step)["kept"].alias("kept"))
    return packed.select(*keys, F.posexplode("kept").alias("at", "id")).select(*keys, (F.col("at") + 1).alias("position"), "id")


def pack_round_robin(hits: DataFrame, per_source: int = 2, budget: int = 24_000, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (set_id, source, rank, id, n_text, n_raw) of several sources: first every source's best, then every second.

    One row per set: set_id, status, kept (array of refs P<source>:S<n> with ids). A missing or
    overflowing best hit fails the whole set ('insufficient'); a later one is only left out. The sources
    that a set needs are the rows of `wanted` (set_id, source), so that one without any hit is missed
    wherever it stands; without `wanted` they are all numbers up to the largest that has a hit.
    """
    order = F.sort_array(F.collect_list(F.struct("rank", "source", "id", "n_text", "n_raw")))
    kept_type = "array<struct<source:int,n:int,id:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("r"), F.lit(False).alias("failed"), F.array().cast(kept_type).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["n_raw"] > 0) & (acc["t"] + x["n_text"] <= budget) & (acc["r"] + x["n_raw"] <= budget)
        n = F.size(F.filter(acc["kept"], lambda k: k["source"] == x["source"])) + 1
        item = F.struct(x["source"].alias("source"), n.alias("n"), x["id"].alias("id"))
        grown = F.struct((acc["t"] + x["n_text"]).alias("t"), (acc["r"] + x["n_raw"]).alias("r"), acc["failed"].alias("failed"), F.concat(acc["kept"], F.array(item)).alias("kept"))
        failed = F.struct(acc["t"].alias("t"), acc["r"].alias("r"), (acc["failed"] | (x["rank"] == 1)).alias("failed"), acc["kept"].alias("kept"))
        return F.when(fits, grown).otherwise(failed)

    if wanted is not None:
        hits = hits.join(wanted.select("set_id", "source").distinct(), ["set_id", "source"], "left_semi")
    rows = hits.filter(F.col("rank") <= per_source).select("set_id", F.col("source").cast("int").alias("source"), F.col("rank").cast("int").alias("rank"), "id", F.col("n_text").cast("long").alias("n_text"), F.col("n_raw").cast("long").alias("n_raw"))
    folded = rows.groupBy("set_id").agg(F.aggregate(order, start, step).alias("f"), F.count_if(F.col("rank") == 1).alias("first"), F.max("source").alias("last"))
    if wanted is None:
        folded = folded.withColumn("needed", F.col("last") + 1)
    else:
        folded = wanted.groupBy("set_id").agg(F.countDistinct("source").alias("needed")).join(folded, "set_id", "left")
    ok = F.coalesce(~F.col("f.failed") & (F.col("first") == F.col("needed")), F.lit(False))
    refs = F.transform("f.kept", lambda k: F.struct(F.concat(F.lit("P"), k["source"].cast("string"), F.lit(":S"), k["n"].cast("string")).alias("ref"), k["id"].alias("id")))
    return folded.select("set_id", F.when(ok, "ok").otherwise("insufficient").alias("status"), F.when(ok, refs).otherwise(F.array().cast("array<struct<ref:string,id:bigint>>")).alias("kept"))


def source_query(title: Column, headings: Column, suffix: str) -> Column:
    """The title, or else the headings, collapsed and cut at 1000 characters, then the fixed suffix."""
    from paperloom.functions.text import collapse

    text = F.left(F.coalesce(F.nullif(collapse(title), F.lit("")), collapse(F.array_join(headings, " "))), F.lit(1000))
    return F.concat(F.when(text != "", F.concat(text, F.lit(" "))).otherwise(""), F.lit(suffix))


def ranking_metrics(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: n, hits_at_2, hits_at_5, mrr over expected (case_id, id); a case that is never found counts as a miss."""
    first = expected.join(ranked, ["case_id", "id"], "left").groupBy("case_id").agg(F.min("rank").alias("rank"))
    within = lambda k: F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False)))
    return first.agg(F.count("*").alias("n"), within(2).alias("hits_at_2"), within(5).alias("hits_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"))


def readiness(requests: DataFrame, documents: DataFrame, owner: str, doc: str) -> DataFrame:
    """doc, status of requests (owner, doc) for documents (doc, owner, ready, expected, found): the first rule that applies.

    not_found for what the owner doesn't own, whether it exists or not; then not_ready; then
    inconsistent if the counts of expected and found parts differ; else ready.
    """
    d = documents.select(F.col(doc).alias("d__"), F.col(owner).alias("o__"), "ready", "expected", "found")
    j = requests.join(d, (F.col(doc) == F.col("d__")) & F.col(owner).eqNullSafe(F.col("o__")), "left")
    status = F.when(F.col("d__").isNull(), "not_found").when(~F.coalesce("ready", F.lit(False)), "not_ready").when(~F.col("expected").eqNullSafe(F.col("found")), "inconsistent").otherwise("ready")
    return j.select(owner, doc, status.alias("status"))


def hit_defects(hits: DataFrame, chunks: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """query, id, defect of index hits (query, id, score, scope) that can't be trusted: bad_score, repeated, unknown (no such chunk) or foreign (of another scope)."""
    from pyspark.sql import Window

    times = F.count("*").over(Window.partitionBy("query", "id"))
    c = chunks.select(F.col("id").alias("c__"), F.col("scope").alias("s__"))
    j = hits.withColumn("times__", times).join(c, F.col("id") == F.col("c__"), "left")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") > 1 + tolerance)
    defect = F.when(bad, "bad_score").when(F.col("times__") > 1, "repeated").when(F.col("c__").isNull(), "unknown").when(~F.col("scope").eqNullSafe(F.col("s__")), "foreign")
    return j.select("query", "id", defect.alias("defect")).filter("defect IS NOT NULL").distinct()


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits (query, rank, id) with their texts, from the table and not from the index; complete is false for queries that miss one."""
    from pyspark.sql import Window

    j = ranked.join(chunks.select("id", "text"), "id", "left")
    return j.withColumn("complete", F.every(F.col("text").isNotNull()).over(Window.partitionBy("query"))).select("query", "rank", "id", "text", "complete")


def select_candidates(entries: DataFrame, active: DataFrame, n: int = 3) -> DataFrame:
    """source, position, id, title: of each source's feed entries (source, position, id, title) the first n that aren't the source itself.

    It is recognised by its id, or, if active (source, id, title) has none, by its title without regard to case and spacing.
    """
    from pyspark.sql import Window

    from paperloom.functions.text import collapse

    fold = lambda c: F.lower(collapse(c))
    a = active.select("source", F.col("id").alias("a_id"), F.col("title").alias("a_title"))
    j = entries.join(a, "source")
    same = F.when(F.col("a_id").isNotNull(), F.col("id") == F.col("a_id")).otherwise(fold(F.col("title")) == fold(F.col("a_title")))
    rest = j.filter(~F.coalesce(same, F.lit(False)))
    return rest.withColumn("n__", F.row_number().over(Window.partitionBy("source").orderBy("position"))).filter(F.col("n__") <= n).select("source", "position", "id", "title")
