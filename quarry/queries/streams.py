"""Ingestion rules and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.kept import shared_folder
from ..streaming import ledger, timers, watch
from .registry import QUERIES, SQL, query


@query("""WITH s AS (SELECT user_id AS path, ts, floor(value)::BIGINT AS length, event_type AS mtime FROM events), c AS (SELECT *, lag(length) OVER w IS DISTINCT FROM length OR lag(mtime) OVER w IS DISTINCT FROM mtime AS changed FROM (SELECT path, ts, max(length) AS length, max(mtime) AS mtime FROM s GROUP BY path, ts) WINDOW w AS (PARTITION BY path ORDER BY ts)),
r AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS until FROM c WHERE changed) SELECT path, length, mtime, min(ts + INTERVAL 6 HOURS) AS ready_at FROM r WHERE until IS NULL OR until >= ts + INTERVAL 6 HOURS GROUP BY path, length, mtime""")
def settle_time(spark, table):
    """Versions that stayed unchanged for six hours, each once."""
    seen = table("events").groupBy(F.col("user_id").alias("path"), F.col("ts").alias("seen_at")).agg(F.max(F.floor("value").cast("bigint")).alias("length"), F.max("event_type").alias("mtime"))
    return watch.settled(seen, "'6' hour")


@query("""SELECT user_id || '/' || ts::DATE AS path, max(ts) + INTERVAL 10 SECONDS AS next_at FROM events GROUP BY 1 HAVING count(*) = 1 AND NOT bool_or(event_type = 'view')""")
def retry_once(spark, table):
    """A user's day is a file, and each of its events an attempt."""
    path = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return watch.attempts(table("events").select(path.alias("path"), F.col("ts").alias("at"), (F.col("event_type") == "view").alias("ok")))


def stream_windows(spark, sf_dir):
    """The events table read as a stream, in tumbling windows with a watermark, every row processed once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    s = s.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    counts = s.groupBy(F.window("at", "1 day")["start"].cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
    name = f"stream_{uuid.uuid4().hex}"
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


QUERIES["stream_windows"] = stream_windows
SQL["stream_windows"] = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def watch_ready(spark, sf_dir):
    """The events of a user as observations of a file, in an engine without hurry: hours stand for seconds. SQL would need the rules' state."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = e.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).alias("length"), (F.col("event_id") % 2).alias("mtime"), (F.col("event_type") == "signup").alias("zeros"), (F.col("event_type") == "error").alias("failed"))
    hour = 3_600_000
    return timers.ready(seen, timers.Waits(settle=2 * hour, zero_wait=30 * hour, retry=10 * hour))


QUERIES["watch_ready"] = watch_ready


def watch_exactly_once(spark, sf_dir):
    """The events as files of a watch, worked on in batches under a ledger; a second run of the whole stream, from its start, adds nothing."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    base = f"{shared_folder(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
    own = ledger.Ledger(spark, f"{base}/ledger")
    each = ledger.exactly_once(own, lambda rows, folder: rows.write.mode("overwrite").parquet(folder), f"{base}/out")
    for run in ("first", "again"):
        s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        s = s.select(F.col("event_id").cast("string").alias("path"), F.lit(1).cast("long").alias("length"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), "event_type")
        s.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/{run}").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


QUERIES["watch_exactly_once"] = watch_exactly_once
SQL["watch_exactly_once"] = "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS paths FROM events GROUP BY event_type"
