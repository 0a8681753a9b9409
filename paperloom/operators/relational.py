"""Listing, search, paging and last-of-group queries over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_existing(rows: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a boolean column: is there any row in others with this key? Null keys: no."""
    seen = others.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return rows.join(seen, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def literal_search(title: Column, authors: Column, text: str) -> Column:
    """Does the title or any author hold the text, whatever its case? The text is literal; trimmed, at most 200 characters."""
    q = text.strip().lower()
    if len(q) > 200:
        raise ValueError("a search text has at most 200 characters")
    return (F.instr(F.lower(F.coalesce(title, F.lit(""))), F.lit(q)) > 0) | F.coalesce(F.exists(authors, lambda a: F.instr(F.lower(a), F.lit(q)) > 0), F.lit(False))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row with the greatest order: one aggregate instead of a correlated lookup."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def preview(text: Column, limit: int = 240) -> Column:
    return F.left(text, F.lit(limit))


def outline(sections: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """section, title, ordinal, first_page of sections (section, title, ordinal) with blocks (section, page) on pages (page, page_index)."""
    j = sections.join(blocks, "section").join(pages, "page")
    return j.groupBy("section", "title", "ordinal").agg(F.min("page_index").alias("first_page"))


def updated_from(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of changes (one row for each key) where there is one: columns of both take the change, others of changes are added, null without one."""
    shared = [c for c in changes.columns if c != key and c in rows.columns]
    c = changes.select(F.col(key), F.lit(True).alias("changed__"), *[F.col(x).alias(f"{x}__") for x in shared], *[x for x in changes.columns if x != key and x not in shared])
    j = rows.join(c, key, "left")
    return j.withColumns({x: F.when(F.col("changed__"), F.col(f"{x}__")).otherwise(F.col(x)) for x in shared}).drop("changed__", *[f"{x}__" for x in shared])


def stated_order(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a stated order; all others come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def ordinal_batch(rows: DataFrame, ordinal: str, batch: int, size: int) -> DataFrame:
    """The rows of one batch by their ordinal."""
    return rows.filter(F.col(ordinal).between(batch * size, (batch + 1) * size - 1))
