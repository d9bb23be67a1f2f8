"""Workspace, size-checked broadcasts and salted joins used by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows times their width stay under this.
BROADCAST_BYTES = 16 << 20
#: How many ways the rows of one join key are spread.
SALTS = 8


def workspace(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/driftlens-{spark.sparkContext.applicationId}"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_driftlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="driftlens-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/driftlens.zip", "w") as z:
        for f in (root / "driftlens").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(f"{folder}/driftlens.zip")
    sc._driftlens_shipped = True


def new_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The copy outlives any executor. ``release`` deletes it once nothing reads it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftlens_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables made by ``written``; later reads of them fail."""
    for df in frames:
        delete(df.sparkSession, df._driftlens_path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``written``, then the shuffle files behind it deleted at once: else they stay until the driver's garbage is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(df, label)
    finally:
        conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trim() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function for ``mapInArrow``, that in the end gives freed memory back: workers are used again, and an executor's tasks share its limit."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if counted rows prove that ``df`` stays under ``limit`` bytes; else leave the join to Spark."""
    rows = df.limit(limit // row_bytes + 1).count()
    return F.broadcast(df) if rows * row_bytes <= limit else df


def salted(big: DataFrame, side: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a row-heavy frame to one row per key, each key's rows spread over ``salts`` tasks."""
    left = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


#: Rows of one join key that a task takes; ``spread`` splits keys with more.
KEY_ROWS = 50_000


def spread(big: DataFrame, side: DataFrame, on: list[str], how: str = "left", per: int = 0) -> DataFrame:
    """Join ``big``, a written table, to at most one row per key; keys of over ``per`` rows go to as many tasks as they need.

    Only such keys are copied on the side, at most one more copy per ``per``
    rows of ``big``. Rows without a key don't move.
    """
    per = per or KEY_ROWS
    none = " or ".join(f"`{c}` is null" for c in on)
    hot = big.where(f"not ({none})").groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > per)
    hot = small(written(hot.select(*on, F.ceil(F.col("__n") / per).cast("int").alias("__ways")), "hot"), 64)
    ways = F.coalesce("__ways", F.lit(1))
    left = big.where(f"not ({none})").join(hot, on, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), ways).cast("int")).drop("__ways")
    right = side.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("__ways")
    out = left.join(right, [*on, "__salt"], how).drop("__salt")
    if how != "left":
        return out
    more = [F.lit(None).cast(side.schema[c].dataType).alias(c) for c in side.columns if c not in on]
    return out.unionByName(big.where(none).select(*big.columns, *more))


def joined(big: DataFrame, side: DataFrame, on: list[str], row_bytes: int, how: str = "left") -> DataFrame:
    """Join one row per key: broadcast if its counted size allows it, else salted; for a written ``big`` see ``spread``."""
    hinted = small(side, row_bytes)
    return salted(big, side, on, how) if hinted is side else big.join(hinted, on, how)


def bytes_of(text) -> "F.Column":
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def bitmap_filter(df: DataFrame, h: str, members: DataFrame, kept: str) -> DataFrame:
    """Add boolean ``kept``: surely true where long column ``h`` is among ``members`` (one long column of that name).

    The filter is a bitmap of at most 16 MB whatever the data: it is broadcast
    whole, and as it fills up it only passes more rows, never fewer.
    """
    buckets = 16
    while buckets < 4096 and buckets * 32768 < 16 * members.count():
        buckets *= 4
    spot = lambda c: F.pmod(F.shiftrightunsigned(F.col(c), 15), F.lit(buckets))
    bits = members.groupBy(spot(h).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col(h).bitwiseAND(F.lit(32767))).alias("__bits")
    )
    byte = F.conv(F.hex(F.expr(f"substring(__bits, cast(({h} & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr(f"cast({h} & 7 as int)")
    joined = df.withColumn("__bucket", spot(h)).join(F.broadcast(bits), "__bucket", "left")
    test = F.col("__bits").isNotNull() & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0)
    return joined.withColumn(kept, F.coalesce(test, F.lit(False))).drop("__bucket", "__bits")
