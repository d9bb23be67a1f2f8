"""Cutting lineage for iterative operators."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or, in local mode, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not where:
            where = tempfile.mkdtemp(prefix="driftlens-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, compressed, and read back; the shuffle files behind it are deleted at once.

    A checkpoint would keep its rows as they lie in memory, and shuffle files until the driver's garbage is collected.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{folder(spark)}/cut-{uuid.uuid4().hex[:12]}", spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftlens_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; later reads of them fail."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(df._driftlens_path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def few(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether ``df`` was counted to have at most ``rows``."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a few short columns if they were counted to be few rows."""
    return F.broadcast(df) if few(df) else df


def steps(most: int | None) -> Iterator[int]:
    """1, 2, ... without end; an error where a loop would go on past ``most``, so that it never returns a part as the whole."""
    for k in itertools.count(1):
        if most is not None and k > most:
            raise RuntimeError(f"not finished after {most} rounds")
        yield k


#: Bytes of files behind a partition that ``parted`` aims at: some 900,000 rows of lineitem.
PART_BYTES = 16 << 20


def parted(df: DataFrame, *on: str, ranges: bool = False) -> DataFrame:
    """``df`` by hash or range of ``on`` in as many partitions as its files' size asks for, at least those set: tasks grow in number, not in memory."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # What is not read from files has no known size.
    set_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(set_, -(-size // PART_BYTES)), 5_000)
    return df.repartitionByRange(parts, *on) if ranges else df.repartition(parts, *on)
