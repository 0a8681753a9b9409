r"""Chat formatting by event-sourced reconstruction (native).

A conversation is a log of events (conv_id, seq, turn, kind, role, text). In order of seq:

- `message` starts a turn with a text, `delta` appends to it, `edit` replaces it,
- `regenerate` empties a turn and discards what later turns had received before it.

Template: `<turn ROLE>\nTEXT</turn>\n` for each turn. In roles and texts `\` is written `\e`, `<` is
`\l`, and in roles `>` is `\g`; so no `<` inside is a control string and reading back is exact.
The loss mask is a list of [start, stop) code point spans: the assistant's texts.

One shuffle, by conversation. A conversation is rendered to one string, so one task must hold the
longest conversation; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import rows_of

RESETS = ["message", "edit", "regenerate"]


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g")) if role else c


def unescaped(c: Column) -> Column:
    for short, char in (("\\g", ">"), ("\\l", "<"), ("\\e", "\\")):
        c = F.replace(c, F.lit(short), F.lit(char))
    return c


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of each conversation.

    Ties in seq go by kind, then text. Null texts are empty; the last role given to a turn holds,
    null or none reads as empty. Null kinds count as `message`, null ids and turns are values like others.
    An event sent twice (all columns equal) applies once.
    """
    e = rows_of(events, "conv_id", "seq", "turn", "kind", "role", "text").select("conv_id", "seq", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    earlier_turns = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier_turns))
    e = e.filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    log = F.array_distinct(F.sort_array(F.collect_list(F.struct("seq", rank.alias("rank"), "text", "role"))))
    g = e.groupBy("conv_id", "turn").agg(log.alias("log"))
    last = F.array_max(F.transform(F.filter("log", lambda x: x["rank"] < 3), lambda x: F.struct(x["seq"], x["rank"], x["text"])))
    g = g.select("conv_id", "turn", "log", last.alias("last"))
    live = F.filter("log", lambda x: F.col("last").isNull() | (F.struct(x["seq"], x["rank"], x["text"]) >= F.col("last")))
    texts = F.transform(live, lambda x: F.when(x["rank"] == 1, F.lit("")).otherwise(x["text"]))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return g.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,stop>>: one row per conversation, turns in order."""
    head = F.concat(F.lit("<turn "), escaped(F.col("role"), role=True), F.lit(">\n"))
    m = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    m = m.select("conv_id", F.struct("turn", "piece", "learned", start.alias("start"), (start + F.char_length("body")).alias("stop")).alias("m"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return g.select("conv_id", F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_events(events: DataFrame) -> DataFrame:
    """render(reconstruct(events)); an empty log gives an empty table."""
    return render(reconstruct(events))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a rendered conversation."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda s: s != "")
    return F.transform(pieces, lambda s: F.struct(unescaped(F.substring(s, F.lit(7), F.locate(">", s) - 7)).alias("role"), unescaped(F.substr(s, F.locate(">", s) + 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log: each row is one message, in order of turn (ties: role, text)."""
    c = rows_of(conversations, "conv_id", "turn", "role", "text")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return c.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all taken from the rendered string."""
    r = rendered.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
