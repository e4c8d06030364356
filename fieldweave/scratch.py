"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: Bytes on disk up to which a table is broadcast. Names and nulls pack so well that a file says little of the rows in it.
SMALL = 1 << 16


class Scratch:
    """Intermediate tables as parquet in the shared folder: they survive lost executors and cut the lineage.

    Spark takes a file's size for that of its rows, so it would collect tables of millions of rows on the driver to
    broadcast them. Tables beyond `SMALL` are joined by shuffles instead, so what the driver holds doesn't grow with them;
    those within are broadcast, so the large ones are not shuffled for them.
    """

    #: Whether joins follow `SMALL`; if not, Spark chooses.
    by_size = True

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        if not self.by_size:
            return held
        return held.hint("broadcast" if self._size(path) <= SMALL else "merge")

    def held(self, names: list[str], like: DataFrame) -> DataFrame:
        """Tables that were written with the columns of `like`, as one: a single scan, however many they are."""
        paths = [f"{self.folder}/{name}" for name in names]
        rows = self.spark.read.schema(like.schema).parquet(*paths)
        return rows.hint("broadcast" if sum(map(self._size, paths)) <= SMALL else "merge") if self.by_size else rows

    def write_small(self, df: DataFrame, name: str) -> DataFrame | None:
        """The table if it is within `SMALL`, to be broadcast, else None."""
        held = self.write(df, name)
        return F.broadcast(held) if self._size(f"{self.folder}/{name}") <= SMALL else None

    def _size(self, path: str) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def sub(self, name: str) -> Scratch:
        """A scratch within this one, for steps that write tables of names used before."""
        inner = type(self).__new__(type(self))
        inner.spark, inner.folder = self.spark, f"{self.folder}/{name}"
        return inner

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; without names, all."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[Column], column: str, scratch: Scratch, name: str) -> DataFrame:
    """Adds the place of each row, from 1, in one total order: sorted in range partitions, which start where the last ended.

    Only one count a partition comes to the driver.
    """
    dealt = scratch.write(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")), name)
    starts, total = [], 0
    for part, n in sorted(dealt.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + place).alias(column))
