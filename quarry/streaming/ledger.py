"""A watch folder that survives restarts: own outputs are known again, and a batch that is repeated changes nothing.

A stream hands a batch on at least once: after a stop between the work and the stream's own commit, the same rows come again under the
same number. The ledger makes that once. It is a folder of tables, one a batch, with the versions of the files that the batch wrote:

1. a batch whose table is complete is skipped;
2. rows that are own outputs, in the version that the ledger has, are left out; a file that someone replaced is not left out;
3. the rest is worked on, below a folder that has the batch's number, so that a repeated batch writes over its own half-done files;
4. the table of what was written is committed. Spark's marker of a complete table is the last thing to appear, and all there is to it.

Every so many batches the tables are put together into one, the newest version of each path, so the join does not slow down with time.
All of it goes through Spark's file systems, so folders may be in any store, and only numbers of batches reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "path string, length bigint, mtime bigint"


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, mtime (microseconds) of all files below ``folder`` that are no markers; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = F.element_at(F.split("path", "/"), -1)
    return files.where(~named.startswith("_") & ~named.startswith(".")).select("path", "length", F.unix_micros("modificationTime").alias("mtime"))


class Ledger:
    """The own outputs of a watch, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = 50) -> None:
        self.spark, self.folder, self.merge_every = spark, folder.rstrip("/"), merge_every

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        at = self._path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _complete(self, kind: str) -> list[int]:
        """The numbers of the complete tables of one kind."""
        at = self._path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        found = sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))
        return [i for i in found if self._exists(f"{self.folder}/{kind}-{i}/_SUCCESS")]

    def has(self, batch: int) -> bool:
        return self._exists(f"{self.folder}/batch-{batch}/_SUCCESS") or any(batch <= i for i in self._complete("upto"))

    def outputs(self) -> DataFrame:
        """path, length, mtime of the newest version of each own output."""
        whole = self._complete("upto")[-1:]
        later = [f"{self.folder}/batch-{i}" for i in self._complete("batch") if not whole or i > whole[0]]
        tables = [f"{self.folder}/upto-{i}" for i in whole] + later
        if not tables:
            return self.spark.createDataFrame([], VERSION)
        newest = F.max_by(F.struct("length", "mtime"), "mtime").alias("v")
        return self.spark.read.schema(VERSION).parquet(*tables).groupBy("path").agg(newest).select("path", "v.length", "v.mtime")

    def commit(self, batch: int, written: DataFrame) -> None:
        """Puts down what a batch wrote; complete or not there at all."""
        written.select("path", "length", "mtime").write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        if batch and batch % self.merge_every == 0:
            self.outputs().write.mode("overwrite").parquet(f"{self.folder}/upto-{batch}")

    def fresh(self, seen: DataFrame) -> DataFrame:
        """The rows of ``seen`` (path, length, mtime, ...) that are no own output in the version it had when it was written."""
        own = self.outputs().select(F.col("path").alias("o_path"), F.col("length").alias("o_length"), F.col("mtime").alias("o_mtime"))
        return seen.join(own, (F.col("path") == F.col("o_path")) & (F.col("length") == F.col("o_length")) & (F.col("mtime") == F.col("o_mtime")), "left_anti")


def exactly_once(ledger: Ledger, work: Callable[[DataFrame, str], None], target: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. ``work(rows, folder)`` writes the results of the rows below the folder, which is the batch's own.

    The rows come sorted by path. A batch without new rows writes nothing and is put down all the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        if ledger.has(number):
            return
        spark, folder = ledger.spark, f"{target.rstrip('/')}/batch-{number}"
        rows = ledger.fresh(batch)
        if rows.isEmpty():
            ledger.commit(number, spark.createDataFrame([], VERSION))
            return
        work(rows.orderBy("path"), folder)
        ledger.commit(number, file_versions(spark, folder))

    return run
