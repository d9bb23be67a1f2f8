"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_filter, bytes_of, spread, written

#: Leading characters that the second step hashes.
HEAD = 256


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None) -> DataFrame:
    """Group rows of identical text; the largest id of each group stays.

    Three scans refine the candidates: equal byte length, then equal hash of
    the first ``HEAD`` characters, then SHA-256 of the whole text, which is
    taken only of rows that survived both. No text is shuffled: between the
    scans goes a bitmap of surviving groups, whose size is bounded.

    ``carry`` names further output columns as expressions over ``df``; other
    columns, whatever their names, are left out. Returns one row per input row:
    ``id_col``, the carried columns, ``keep_id``, ``group_size`` and ``kept``.
    A null text counts as empty. Ids may be null (smallest) or repeat: of equal
    rows exactly one is kept. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text).cast("long")
    rows = df.select(
        F.col(id_col).alias("__id"),
        *[c.alias(f"__carry_{n}") for n, c in (carry or {}).items()],
        text.alias("__text"),
        F.xxhash64(length).alias("__h1"),
        length.alias("__length"),
    )
    many = lambda d, key: d.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    lengths = written(many(rows.select("__h1"), "__h1"), "lengths")
    alike = bitmap_filter(rows, "__h1", lengths, "__alike").withColumn(
        "__h2", F.when(F.col("__alike"), F.xxhash64("__length", F.substring("__text", 1, HEAD)))
    )
    heads = written(many(alike.where("__alike").select("__h2"), "__h2"), "heads")
    full = bitmap_filter(alike, "__h2", heads, "__same_head").select(
        "__id",
        *[f"__carry_{n}" for n in carry or {}],
        F.monotonically_increasing_id().alias("__row"),
        F.when(F.col("__same_head"), F.unhex(F.sha2(F.encode("__text", "UTF-8"), 256))).alias("__full"),
    )
    hashed = written(full, "hashed")
    groups = (
        hashed.where("__full is not null")
        .groupBy("__full")
        .agg(F.max(F.struct("__id", "__row")).alias("__keep"), F.count("*").alias("__n"))
        .where("__n > 1")
    )
    out = spread(hashed, groups, ["__full"])
    alone = F.col("__n").isNull()
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__carry_{n}").alias(n) for n in carry or {}],
        F.when(alone, F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__keep.__row") == F.col("__row"))).alias("kept"),
    )


def text_sha256(text_col: str = "text"):
    return F.sha2(bytes_of(F.col(text_col)), 256)
