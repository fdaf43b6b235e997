"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (space, TAB, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the master is local (tests, a laptop) a temporary folder
    of this machine takes its place; on a cluster it would be lost with an executor, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/quarry-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut; it outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of steps whose results were settled and that nothing refers to any more.

    Spark removes them when the driver's JVM finds their objects unreachable; between its own collections, which a driver with much
    free memory seldom makes, the files of all rounds would pile up on the executors' disks. What ran last is still referred to for a
    moment, so there is a second collection.
    """
    for pause in (0.5, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def text_tasks(docs: DataFrame, file_bytes: int) -> int:
    """Number of tasks for what is derived from the texts: one for so many bytes of the files below, or the session's number if that is more.

    The files' sizes come from the optimiser's statistics; only texts that do not come straight from files are measured.
    """
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    if leaves.size() == 1 and leaves.apply(0).nodeName().startswith("LogicalRelation"):
        size = int(str(leaves.apply(0).stats().sizeInBytes()))
    else:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or what it takes behind it to be no column of ``df``."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column of that name, or nulls where ``df`` has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: Rows of a few numbers that may be broadcast: some tens of MB in memory at most.
BROADCAST_ROWS = 400_000


def small(settled: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Asks for a broadcast of a settled table if it is counted to have at most ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(settled) if settled.limit(rows + 1).count() <= rows else settled


#: Links that one task may hold to find their components; 16 MB.
SOLO_LINKS = 1_000_000


def _solo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in (a, b):
                up.setdefault(x, x)
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
    for x in sorted(up):  # what x points to is smaller and done
        up[x] = up[up[x]]
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], ["node", "root"])


def components(links: DataFrame, solo: int = SOLO_LINKS) -> DataFrame:
    """node, root (the smallest node that links reach) of every node of ``links`` (a, b).

    Each round points every node at its smallest neighbour, follows the pointers to their ends, and contracts the links; the nodes
    that have links at least halve. All tables stay distributed; once at most ``solo`` links are left, one task joins them.
    """
    left = settle(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    roots = None

    def moved(m: DataFrame) -> DataFrame:
        """``roots`` carried on by a table of nodes and their roots."""
        m = m.select(F.col("node").alias("m_node"), F.col("root").alias("m_root"))
        return roots.join(m, roots["root"] == m["m_node"], "left").select("node", F.coalesce("m_root", "root").alias("root"))

    while n := left.count():
        if n <= solo:
            last = settle(left.repartition(1).mapInArrow(_solo, "node long, root long"))
            return last if roots is None else settle(moved(last))
        both = left.unionAll(left.select("b", "a"))
        to = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
        while True:
            up = to.select(F.col("node").alias("up"), F.col("root").alias("top"))
            nxt = settle(to.join(up, to["root"] == up["up"]).select("node", "top", (F.col("top") != F.col("root")).alias("moved")))
            to = nxt.select("node", F.col("top").alias("root"))
            if nxt.where("moved").isEmpty():
                break
        roots = to if roots is None else settle(moved(to))
        m = to.select(F.col("node").alias("m_node"), F.col("root").alias("m_root"))
        a = left.join(m, left["a"] == m["m_node"]).select(F.col("m_root").alias("a"), "b")
        left = settle(a.join(m, a["b"] == m["m_node"]).select("a", F.col("m_root").alias("b")).where("a <> b").distinct())
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


#: Rows in an Arrow batch of texts; Spark's default of 10,000 holds too much where texts are long.
TEXT_ROWS = 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Python smaller batches from now on, unless it was told how many rows to send."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_ROWS))
    return df


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``; its worker, which is used again, gives free memory back to the system when a task ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
