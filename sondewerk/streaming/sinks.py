"""Sinks for batches of results; each is called as sink(batch, epoch) and may be run again for an epoch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.operators.vectors import ilp_line, point_id, upsert


def parquet(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per epoch, overwritten when the epoch is repeated; nothing is written for an empty batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def stdout(every: int = 1, tie: str = "seq") -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.filter(F.col(tie) % every == 0).show(20, truncate=False)

    return write


def lines(path: str, measurement: str = "signal") -> Callable[[DataFrame, int], None]:
    """Line protocol as text, ready for a time-series database."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.select(ilp_line(measurement, F.col("node_id"), {"energy": F.col("energy"), "energy_z": F.col("energy_z")}, F.col("ts_us")).alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch}")

    return write


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a keyed table that are written whole, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))


def points(path: str) -> Callable[[DataFrame, int], None]:
    """Keyed table of the newest row per point id: each epoch writes a new version beside the old one."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.withColumn("point_id", point_id(F.col("node_id"), F.col("seq")))
        old = [v for v in _versions(batch.sparkSession, path) if v < epoch]
        table = batch.sparkSession.read.parquet(f"{path}/v={old[-1]}") if old else new.limit(0)
        upsert(table, new, ["point_id"], "ts_us").write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a keyed table."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")
