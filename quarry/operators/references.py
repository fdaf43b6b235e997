"""Texts that name parts of their own message, and cells that hold several values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reference to a part by its content id, in an attribute or a style.
LINK = r"[cC][iI][dD]:([^\"'\s)>]+)"


def data_uri(kind: Column, content: Column) -> Column:
    """A part as a link that holds it."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def inlined(messages: DataFrame, parts: DataFrame, message: str, html: str, cid: str, uri: str) -> DataFrame:
    """``messages`` with the links of ``html`` to parts of the same message replaced by their ``uri``; others stay as they are.

    Content ids are compared without angle brackets and case, links after percent signs are decoded; of parts with one id the first in the
    order of their links counts. A text is put together in one pass, so what was put in is not looked at again. Texts without links, and
    messages without parts, are not touched; a null text stays null.
    """
    name = lambda c: F.lower(F.regexp_replace(c, r"^<+|>+$", ""))
    own = parts.where(F.col(cid).isNotNull() & F.col(uri).isNotNull()).groupBy(F.col(message).alias("_m"), name(F.col(cid)).alias("_cid")).agg(F.min(uri).alias("_uri"))
    found = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))
    asked = messages.where(F.col(html).rlike(LINK)).select(F.col(message).alias("_m"), F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))))).alias("_cid")).distinct()
    known = asked.join(own, ["_m", "_cid"]).groupBy("_m").agg(F.map_from_entries(F.collect_list(F.struct("_cid", "_uri"))).alias("_known"))
    texts, links = F.split(F.col(html), LINK, -1), F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(0))
    target = lambda link: F.lower(F.coalesce(F.try_url_decode(F.replace(F.substring(link, 5, 1 << 30), F.lit("+"), F.lit("%2B"))), F.substring(link, 5, 1 << 30)))
    put = F.transform(links, lambda link: F.coalesce(F.try_element_at("_known", target(link)), link))
    whole = F.array_join(F.flatten(F.transform(texts, lambda x, i: F.array(x, F.coalesce(F.get(put, i), F.lit(""))))), "")
    out = messages.join(known, F.col(message).eqNullSafe(F.col("_m")), "left")
    replaced = F.when(F.col("_known").isNull(), F.col(html)).otherwise(whole)
    return out.select(*[replaced.alias(html) if c == html else F.col(f"`{c}`") for c in messages.columns])


def distinct_in_order(rows: DataFrame, key: str, value: str, order: str, limit: int | None = None) -> DataFrame:
    """key, values: the distinct values of each key as they were first seen, the first ``limit`` of them where that is given.

    Repeats are gone before values meet, so a list holds each value once. Nulls are no values.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("_l"))
    values = F.transform("_l", lambda x: x["v"])
    return listed.select(key, (F.slice(values, 1, limit) if limit else values).alias("values"))


def in_one_cell(rows: DataFrame, key: str, value: str, kind: str, order: str, between: str = "; ") -> DataFrame:
    """key, cell: all values of a key in their order, each with its kind in brackets if it has one; blank values are left out."""
    kept = rows.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")
    one = F.concat(F.col(value).cast("string"), F.when(F.coalesce(F.col(kind).cast("string"), F.lit("")) != "", F.concat(F.lit(" ("), F.col(kind).cast("string"), F.lit(")"))).otherwise(""))
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), one.alias("v")))).alias("_l"))
    return listed.select(key, F.array_join(F.transform("_l", lambda x: x["v"]), between).alias("cell"))
