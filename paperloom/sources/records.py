"""Readers and writers: typed record lines, content-addressed stores, byte ranges, feeds, event text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
RECORD = f"kind string, page_index int, ordinal int, block_ordinal int, block_type string, source_group int, box {BOX}, media_box {BOX}, crop_box {BOX}, rotation int, width double, height double, transform array<double>, raw_text string, character_boxes array<{BOX}>, pages int, blocks int, spans int"


@F.pandas_udf(BooleanType())
def has_duplicate_keys(text: pd.Series) -> pd.Series:
    """Does a JSON text name a key twice in one object? False for texts that aren't JSON."""

    def look(t: str) -> bool:
        twice = False

        def pairs(items):
            nonlocal twice
            twice |= len({k for k, _ in items}) < len(items)
            return dict(items)

        try:
            json.loads(t, object_pairs_hook=pairs)
        except (ValueError, RecursionError):
            return False
        return twice

    return text.map(look, na_action="ignore")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Typed lines: file, line text, record (null if it isn't one), defect (null, `malformed` or `duplicate_key`)."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    rec = raw.withColumn("record", F.from_json("line", RECORD, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("line").isNotNull())
    return rec.withColumn("defect", F.when(has_duplicate_keys(F.col("line")), "duplicate_key").when(~F.col("ok") | F.col("record.kind").isNull(), "malformed")).drop("ok")


def record_violations(records: DataFrame, doc: str) -> DataFrame:
    """doc, rule for record streams (doc, record) that break: ordinals 0..n-1 of each kind, exactly one summary, its counts."""
    r = records.select(doc, "record.*")
    ordinal = F.when(F.col("kind") == "page", F.col("page_index")).otherwise(F.col("ordinal"))
    by_kind = r.filter(F.col("kind").isin("page", "block", "span")).groupBy(doc, "kind").agg(F.count("*").alias("n"), F.countDistinct(ordinal).alias("d"), F.min(ordinal).alias("a"), F.max(ordinal).alias("b"))
    gaps = by_kind.filter((F.col("d") != F.col("n")) | (F.col("a") != 0) | (F.col("b") != F.col("n") - 1)).select(doc, F.concat(F.lit("ordinals_"), F.col("kind")).alias("rule"))
    n = lambda k: F.count_if(F.col("kind") == k)
    last = lambda c: F.max(F.when(F.col("kind") == "summary", F.col(c)))
    t = r.groupBy(doc).agg(n("summary").alias("s"), n("page").alias("p"), n("block").alias("b"), n("span").alias("x"), last("pages").alias("sp"), last("blocks").alias("sb"), last("spans").alias("sx"))
    counts = t.filter((F.col("s") != 1) | (F.col("p") != F.col("sp")) | (F.col("b") != F.col("sb")) | (F.col("x") != F.col("sx"))).select(doc, F.lit("summary").alias("rule"))
    return gaps.union(counts)


def address(scope: Column, stage: Column, content: Column) -> Column:
    """The path of a content: scope, stage and SHA-256."""
    return F.concat_ws("/", scope, stage, F.sha2(content, 256))


def put_once(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Of (address, content) the ones not stored yet, each once."""
    return incoming.dropDuplicates(["address"]).join(existing.select("address"), "address", "left_anti")


def verified(stored: DataFrame, references: DataFrame) -> DataFrame:
    """address, status of references (address, size, sha256): ok, missing or corrupt."""
    j = references.join(stored, "address", "left")
    return j.select("address", F.when(F.col("content").isNull(), "missing").when((F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256")), "ok").otherwise("corrupt").alias("status"))


def byte_range(header: Column, total: Column) -> Column:
    """struct<status,start,length> of a Range header: 200 without one, 206 for one that can be met, else 416 with nulls."""
    a, b = F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 1), F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 2)
    valid = header.rlike(r"^bytes=([0-9]{1,20}-[0-9]{0,20}|-[0-9]{1,20})$") & (F.octet_length(header) <= 256)
    x, y = a.try_cast("decimal(38,0)"), b.try_cast("decimal(38,0)")
    top = F.lit(str(2**64 - 1)).cast("decimal(38,0)")
    small = (F.coalesce(x, F.lit(0)) <= top) & (F.coalesce(y, F.lit(0)) <= top)
    last = total - 1
    suffix = F.struct(F.lit(206).alias("status"), F.greatest(F.lit(0), total - y).cast("long").alias("start"), F.least(total, y).cast("long").alias("length"))
    stop = F.least(F.coalesce(y, last), last)
    plain = F.struct(F.lit(206).alias("status"), x.cast("long").alias("start"), (stop - x + 1).cast("long").alias("length"))
    none = F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length"))
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("start"), total.cast("long").alias("length"))
    return F.when(header.isNull(), whole).when(valid & small & (a == "") & (y > 0) & (total > 0), suffix).when(valid & small & (a != "") & (x < total) & (F.coalesce(y, last) >= x), plain).otherwise(none)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value: an integer, or an HTTP date from now; null if neither. Never negative."""
    until = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.greatest(F.lit(0), F.coalesce(value.try_cast("int"), (F.unix_timestamp(until) - F.unix_timestamp(now)).cast("int"))) + F.when(value.try_cast("int").isNull() & until.isNull(), F.lit(None).cast("int")).otherwise(0)


# A fixed format: YYMM.NNNN(N), or archive/YYMMNNN where the archive may have a subject class; months 01 to 12; with or without a version.
_MONTH = r"\d{2}(?:0[1-9]|1[0-2])"
CURRENT_ID, LEGACY_ID = _MONTH + r"\.\d{4,5}", r"[a-zA-Z-]+(?:\.[a-zA-Z-]+)?/" + _MONTH + r"\d{3}"


def paper_reference(value: Column, hosts: tuple[str, ...] = ("arxiv.org", "www.arxiv.org")) -> Column:
    """struct<id,version> of an identifier, bare, with an `arxiv:` prefix, or in an https abs or pdf URL of the hosts; null if it is none."""
    v = F.btrim(value)
    url = rf"^https://(?:{'|'.join(h.replace('.', '[.]') for h in hosts)})/(?:abs/(.+)|pdf/(.+?)(?:\.pdf)?)$"
    from_url = F.coalesce(F.nullif(F.regexp_extract(v, url, 1), F.lit("")), F.regexp_extract(v, url, 2))
    raw = F.when(v.contains("://"), from_url).otherwise(F.btrim(F.regexp_replace(v, r"^(?i:arxiv:)", "")))
    form = rf"^({CURRENT_ID}|{LEGACY_ID})(?:v([1-9]\d*))?$"
    good = raw.rlike(form) & ~v.rlike(r"[?#@\\]")
    return F.when(good, F.struct(F.regexp_extract(raw, form, 1).alias("id"), F.regexp_extract(raw, form, 2).try_cast("int").alias("version")))


def url_parts(url: Column) -> Column:
    """struct<scheme,host,path,query>; null for what isn't an http(s) URL."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.when(url.rlike(r"^https?://[^/\s]+"), F.struct(part("PROTOCOL").alias("scheme"), F.lower(part("HOST")).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query")))


ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>"


def read_feed(spark: SparkSession, path: str, at_most: int = 10) -> DataFrame:
    """Entries of Atom feeds: file, position, id, title, authors, abstract, year; the first `at_most` of each file.

    Files are read whole: a feed is a page of results, its size is bounded by its source.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    entry = F.from_xml(F.col("value"), f"entry array<struct<{ENTRY.replace(' string', ':string').replace(' array', ':array')}>>")
    e = whole.select("file", F.posexplode(F.slice(entry["entry"], 1, at_most)).alias("position", "e"))
    from paperloom.functions.text import collapse

    year = F.coalesce(F.left("e.published", F.lit(4)).try_cast("int"), F.left("e.updated", F.lit(4)).try_cast("int"))
    return e.select("file", "position", F.regexp_extract("e.id", r"/abs/(.+?)(?:v\d+)?$", 1).alias("id"), F.nullif(collapse(F.col("e.title")), F.lit("")).alias("title"), F.transform("e.author", lambda a: collapse(a["name"])).alias("authors"), F.nullif(collapse(F.col("e.summary")), F.lit("")).alias("abstract"), year.alias("year"))


def dedupe_feed(entries: DataFrame, key: str, position: str, *facts: str) -> DataFrame:
    """key, position, n, conflict: the first entry of each id; conflict if a repeat says otherwise."""
    f = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in facts])
    return entries.groupBy(key).agg(F.min(position).alias("position"), F.count("*").alias("n"), (F.countDistinct(f) > 1).alias("conflict"))


def event_text(event: Column, data: Column, limit: int = 256 * 1024) -> Column:
    """The wire form of a server-sent event; null if it is longer than the limit."""
    text = F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\r\n|\r|\n"), lambda d: F.concat(F.lit("data: "), d)), "\n"), F.lit("\n\n"))
    return F.when(F.octet_length(text) <= limit, text)


def parse_events(text: Column) -> Column:
    """array<struct<event,data>> of a stream's text: CR, LF or both end lines, data lines are joined, comments ignored."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n\n+"), lambda b: b != "")
    field = lambda lines, name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))

    def event(b: Column) -> Column:
        lines = F.split(b, "\n")
        return F.struct(F.coalesce(F.try_element_at(field(lines, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field(lines, "data"), "\n").alias("data"))

    return F.transform(blocks, event)


def write_json_once(df: DataFrame, path: str) -> None:
    """A small report as one file; the committer makes it appear whole or not at all."""
    df.coalesce(1).write.mode("overwrite").json(path)
