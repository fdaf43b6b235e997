"""HTTP archives (HAR): one row a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "log struct<entries:array<struct<startedDateTime:string,time:double,request:struct<method:string,url:string>,response:struct<status:bigint,bodySize:bigint,content:struct<size:bigint,mimeType:string>>>>>"


def requests(df: DataFrame, json: str) -> DataFrame:
    """Started, Method, URL, Status, Time (ms), Size (bytes), Type of every entry; unknown (negative) sizes are null."""
    e = df.select(F.explode(F.from_json(json, SCHEMA)["log"]["entries"]).alias("e"))
    known = lambda c: F.when(c >= 0, c)
    content, body = F.col("e.response.content.size"), F.col("e.response.bodySize")
    size = F.when(content.isNotNull(), known(content)).otherwise(known(body))
    return e.select(F.col("e.startedDateTime").alias("Started"), F.col("e.request.method").alias("Method"), F.col("e.request.url").alias("URL"), F.col("e.response.status").alias("Status"), F.col("e.time").alias("Time (ms)"), size.alias("Size (bytes)"), F.col("e.response.content.mimeType").alias("Type"))
