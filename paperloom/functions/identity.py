"""Digests and name-based identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_digest(order: Column, value: Column) -> Column:
    """Aggregate: the digest of all values joined in order. The list is sorted inside, as collecting has no order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda e: e["v"]), ""), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name: SHA-1 over namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab89ab89ab89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
