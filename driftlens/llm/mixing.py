"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import release, small, spread, written

#: Items that one fold of the reduction tree takes, on average.
FAN_IN = 64
#: Times that a source's miss is lessened by turning over one document.
CORRECTIONS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``__rank`` from 0 by code point, null last, without a sort in one task."""
    parts = written(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("__part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sources' table.
    starts = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(starts, "__part").withColumn("__rank", F.row_number().over(within) - 1 + F.col("__start")).drop("__part", "__start")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: ``source``, ``source_size``, ``n``, ``target``.

    ``sizes`` has ``source``, ``source_size`` and ``n`` per source. Weights
    repeat over the sources by code point, null last. The targets share
    ``share`` times all sizes by weight; one stops at ``most`` times its
    source's size and its excess is shared again, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = written(_ranked(sizes).withColumn("__w", weight).drop("__rank"), "weights")
    cap = F.col("source_size") * most
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate = -1.0
    while True:  # the rate only rises, so sources only join the capped ones
        above = (F.col("__w") * rate) > cap
        capped, free = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("__w"))), F.lit(0.0))
        ).first()
        if not free or rate == (new := (total - capped) / free):
            break
        rate = new
    return ranked.select("source", "source_size", "n", F.least(F.col("__w") * max(rate, 0.0), cap).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _fold(items: Column, seed: int, level: int) -> Column:
    """Fold an array of (s, o, key, row, p), largest first: the pending item is paired with the next until one is integral.

    A pair moves ``a`` up and ``b`` down or the other way, keeping s.p summed
    and each p in expectation. The one that became integral goes to ``done``.
    """
    item = "struct<row:bigint,key:bigint,s:double,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("now"), F.array().cast("array<struct<row:bigint,one:boolean>>").alias("done"))

    def step(acc, x):
        a = acc["now"]
        here = F.struct(x["row"].alias("row"), x["key"].alias("key"), x["s"].alias("s"), x["p"].alias("p"))
        ratio = a["s"] / x["s"]
        up = F.least(1 - a["p"], x["p"] / ratio)
        down = F.least(a["p"], (1 - x["p"]) / ratio)
        rises = _uniform(F.lit(seed), F.lit(level), a["key"], x["key"]) * (up + down) < down
        move = F.when(rises, up).otherwise(-down)
        # Which of the two became integral follows from which bound was the lesser, not from rounding.
        a_done = F.when(rises, (1 - a["p"]) <= x["p"] / ratio).otherwise(a["p"] <= (1 - x["p"]) / ratio)
        left = F.when(
            a_done, F.struct(x["row"].alias("row"), x["key"].alias("key"), x["s"].alias("s"), (x["p"] - move * ratio).alias("p"))
        ).otherwise(F.struct(a["row"].alias("row"), a["key"].alias("key"), a["s"].alias("s"), (a["p"] + move).alias("p")))
        out = F.struct(
            F.when(a_done, a["row"]).otherwise(x["row"]).alias("row"), F.when(a_done, rises).otherwise(~rises).alias("one")
        )
        first = a.isNull()
        return F.struct(
            F.when(first, here).otherwise(left).cast(item).alias("now"),
            F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(out))).alias("done"),
        )

    return F.aggregate(items, start, step)


def pivotal_rounding(items: DataFrame, seed: int) -> DataFrame:
    """Round fractional items of each group to whole ones: returns ``row`` and ``one``.

    ``items``: ``row`` (unique long), ``key`` (long, orders and seeds), ``g``
    (group), ``n`` (the group's items), ``s`` (size > 0), ``p`` in (0, 1). Each
    level hashes a group's items to chunks of about ``FAN_IN``, folds every
    chunk, and passes one pending item per chunk on; about log_64(n) levels.
    What is left of a group is one item, rounded to the nearer side, so a
    group's words miss their sum by at most half of that item.
    """
    spark = items.sparkSession
    decided, now, level = [], written(items, "pivotal"), 0
    while True:
        chunks = F.ceil(F.col("n") / FAN_IN).cast("long")
        order = F.xxhash64("key", F.lit(seed), F.lit(level))
        placed = now.withColumn("c", F.pmod(order, F.greatest(chunks, F.lit(1)))).withColumn("o", order)
        folded = placed.groupBy("g", "c").agg(F.sort_array(F.collect_list(F.struct("s", "o", "key", "row", "p")), False).alias("x"))
        done = written(folded.select("g", _fold(F.col("x"), seed, level).alias("f")), "folded")
        decided.append(done.select(F.explode("f.done").alias("d")).select("d.row", "d.one"))
        rest = done.select("g", "f.now.*")
        more = rest.groupBy("g").agg(F.count("*").alias("n"))
        last = more.where("n > 1").limit(1).count() == 0
        if last:
            decided.append(rest.select("row", (F.col("p") >= 0.5).alias("one")))
            break
        after = written(rest.join(more, rest["g"].eqNullSafe(more["g"])).drop(more["g"]), "pivotal")
        release(now)
        now, level = after, level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out if decided else spark.createDataFrame([], "row bigint, one boolean")


def _corrected(out: DataFrame, seed: int) -> DataFrame:
    """Turn over the rounding of one document per source, the one whose size is nearest to what its source misses."""
    n = F.col("whole") + F.coalesce(F.col("one").cast("long"), F.lit(0))
    miss = written(out.groupBy("g").agg((F.first("target") - F.sum(n * F.col("size"))).alias("miss")).where("abs(miss) >= 1"), "miss")
    open_ = spread(out.where("one is not null").select("row", "id", "g", "size", "one"), miss, ["g"], "inner")
    fits = open_.where((F.col("one") == (F.col("miss") < 0)) & (F.col("size") < 2 * F.abs("miss")))
    nearest = F.min(F.struct(F.abs(F.col("size") - F.abs("miss")).alias("off"), F.xxhash64("id", F.lit(seed)).alias("key"), "row"))
    turned = fits.groupBy("g").agg(nearest.alias("t")).select(F.col("t.row").alias("row"), F.lit(True).alias("turned"))
    after = written(out.join(small(turned, 16), "row", "left").withColumn("one", F.when(F.col("turned"), ~F.col("one")).otherwise(F.col("one"))).drop("turned"), "rounded")
    release(out, miss)
    return after


def mix_sources(
    df: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20240607,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: dict | None = None,
) -> DataFrame:
    """How many words a mix takes of each document, so that each source meets its target.

    A document's copies are its source's target over its size, between 0 and
    ``most``: the whole part is taken outright, the fraction by dependent
    rounding over the source's documents with sizes as weights, so that a
    source's words miss its target by at most half a document; then, ``CORRECTIONS``
    times, the document whose size is nearest to what is still amiss is turned over.

    Returns one row per row of ``df``: ``id_col``, ``size`` (words of the text,
    0 for null), ``source_size``, ``target``, ``copies``, ``taken``, and what ``carry``
    names as expressions over ``df``. Equal
    inputs give equal mixes. Null sources form one source, the last; texts
    without words take none; repeated rows are separate documents; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = written(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.monotonically_increasing_id().alias("row"),
            *[c.alias(f"__carry_{n}") for n, c in (carry or {}).items()],
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"))
    targets = written(source_targets(sizes, weights, share, most), "targets")
    keyed = targets.select(F.struct("source").alias("g"), "source_size", "n", "target")
    full = spread(rows.withColumn("g", F.struct("source")), keyed, ["g"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = full.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    items = full.where("size > 0 and p > 0").select(
        "row", F.xxhash64("id", F.lit(seed)).alias("key"), "g", "n", F.col("size").cast("double").alias("s"), "p"
    )
    rounded = pivotal_rounding(items, seed)
    out = written(full.join(rounded, "row", "left"), "rounded")
    for _ in range(CORRECTIONS):
        out = _corrected(out, seed)
    n = F.col("whole") + F.coalesce(F.col("one").cast("long"), F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", n.cast("long").alias("copies"), (n * F.col("size")).cast("long").alias("taken"),
        *[F.col(f"__carry_{c}").alias(c) for c in carry or {}],
    )
