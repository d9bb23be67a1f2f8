"""Report aggregates and migration rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import cut, parted


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.count_if("is_breaking").alias("breaking"))


def by_file(changes: DataFrame) -> DataFrame:
    """Per file its changes sorted by symbol, totals and breaking ones."""
    return changes.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("symbol", "change"))).alias("changes"), F.count("*").alias("n"), F.count_if("is_breaking").alias("breaking")
    )


def removal_rollup(members: DataFrame) -> DataFrame:
    """Per type its members, those removed, the share, and status: removed when over half and at least three are gone."""
    out = members.groupBy("package", "type").agg(F.count("*").alias("members"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change").isNotNull()).alias("touched"))
    ratio = F.round(F.col("removed") / F.col("members"), 6)
    status = F.when((F.col("removed") / F.col("members") > 0.5) & (F.col("removed") >= 3), "removed").when(F.col("touched") > 0, "modified").otherwise("same")
    return out.select("package", "type", "members", "removed", ratio.alias("removal_ratio"), status.alias("status"))


def constant_groups(changes: DataFrame, least: int = 10) -> DataFrame:
    """Groups of (package, change, strategy) of at least ``least`` constants, import path changes apart."""
    kept = changes.where("strategy <> 'ImportPathChange'")
    return kept.groupBy("package", "change", "strategy").agg(F.count("*").alias("n"), F.min("symbol").alias("first_symbol")).where(F.col("n") >= least)


def majority(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return counts.withColumn("r", best).where("r = 1").drop("r")


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row written last of each key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("s")).select(key, "s.*")


def consolidate(rules: DataFrame) -> DataFrame:
    """Rules of one ``key`` as one: first id, all ids, labels united, most effort."""
    return rules.groupBy("key").agg(
        F.min("rule_id").alias("rule_id"),
        F.count("*").alias("merged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.max("effort").alias("effort"),
    )


def id_mapping(rules: DataFrame) -> DataFrame:
    """What each rule's id became."""
    first = F.min("rule_id").over(Window.partitionBy("key"))
    return rules.select("rule_id", first.alias("merged_id"))


def merge_conditions(rules: DataFrame) -> DataFrame:
    """Rules with one condition become one; those with a codemod stay apart."""
    plain = rules.where("not has_codemod").groupBy("condition").agg(
        F.min("rule_id").alias("rule_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels")
    )
    return plain.select("rule_id", "condition", "labels").unionByName(rules.where("has_codemod").select("rule_id", "condition", "labels"))


def suppress(rules: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    """Rules that a broader one already covers are dropped."""
    return rules.join(by.select(*on).distinct(), on, "left_anti")


def unique_ids(df: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Ids from a base: the first keeps it, later ones get ``-2``, ``-3``, ...

    Rows are parted by ranges of base and order; a base of many rows is numbered
    part by part, each from the rows of the parts before it.
    """
    rows = cut(parted(df, base, *order, ranges=True).withColumn("__part", F.spark_partition_id()))
    long = rows.groupBy(F.col(base).alias("__base")).agg(F.min("__part").alias("a"), F.max("__part").alias("b")).where("a < b").select("__base")
    same = F.col(base).eqNullSafe(F.col("__base"))
    counts = rows.select(base, "__part").join(F.broadcast(long), same).groupBy("__base", F.col("__part").alias("__p")).agg(F.count("*").alias("n"))
    sofar = F.sum("n").over(Window.partitionBy("__base").orderBy("__p")) - F.col("n")
    # At most two rows per part: a base that goes on into the next and one that came from the last.
    sofar = F.broadcast(cut(counts.select("__base", "__p", sofar.alias("__before"))))
    n = F.row_number().over(Window.partitionBy(base, "__part").orderBy(*order)) + F.coalesce("__before", F.lit(0))
    out = rows.join(sofar, same & (F.col("__part") == F.col("__p")), "left").withColumn("__n", n)
    unique = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("__n").cast("string")))
    return out.select(*df.columns, unique.alias("unique_id"))


def dead_classes(old: DataFrame, new: DataFrame, prefix: str, to: str) -> DataFrame:
    """Classes that are gone even after their version prefix is swapped."""
    swapped = old.select("class", F.regexp_replace("class", f"^{prefix}", to).alias("swapped"))
    return swapped.join(new.select(F.col("class").alias("swapped")), "swapped", "left_anti").select("class", "swapped")


def class_rules(old: DataFrame, new: DataFrame, prefix: str, to: str) -> DataFrame:
    """Per old class: Rename where the swapped one exists, else Manual."""
    swapped = old.select("class", F.regexp_replace("class", f"^{prefix}", to).alias("target"))
    there = new.select(F.col("class").alias("target"), F.lit(True).alias("there"))
    strategy = F.when(F.col("there"), "Rename").otherwise("Manual")
    return swapped.join(there, "target", "left").select("class", F.when(F.col("there"), F.col("target")).alias("target"), strategy.alias("strategy"))


def top_constants(df: DataFrame, suffixes: list[str], preferred: int = 20, most: int = 30) -> DataFrame:
    """A report's sample of constants per package: up to ``preferred`` with a telling suffix, filled in order to ``most``."""
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.col("name").endswith(s)
    w = Window.partitionBy("package", "hit").orderBy("ordinal")
    marked = df.withColumn("hit", hit).withColumn("k", F.row_number().over(w))
    rank = F.row_number().over(Window.partitionBy("package").orderBy(F.when(F.col("hit") & (F.col("k") <= preferred), 0).otherwise(1), "ordinal"))
    return marked.withColumn("r", rank).where(F.col("r") <= most).drop("hit", "k", "r")


def rename_symbols(df: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("replacement", T.first_rename("name", patterns))
