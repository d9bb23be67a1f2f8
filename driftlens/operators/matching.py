"""Matching two surfaces: exact, relocated, renamed, migrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import cut, parted, steps

SAME_FAMILY, CROSS_FAMILY, AMBIGUOUS, NAME_ONLY, GROUP_CAP = 0.15, 0.50, 0.45, 0.6, 50


def exact_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Added, removed and changed keys with their values; removals and changes are breaking."""
    a = old.select(F.col(key).alias("k"), F.col(value).alias("before"), F.lit(True).alias("o"))
    b = new.select(F.col(key).alias("k"), F.col(value).alias("after"), F.lit(True).alias("n"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = both.withColumn("change", change).where("change is not null")
    return out.select(F.col("k").alias(key), "change", "before", "after", (F.col("change") != "added").alias("is_breaking"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def relocate(removed: DataFrame, added: DataFrame, key: str = "qualified_name", kind: str = "kind", name: str = "name") -> DataFrame:
    """Pair removed and added symbols of one canonical path and kind, same names first, each used once.

    Pairs within a group are ranked on both sides, so a group needs no loop:
    same names pair by order, then what is left pairs by order.
    """
    a = removed.select(F.col(key).alias("old"), T.canonical_path(key).alias("c"), F.col(kind).alias("kind"), F.col(name).alias("name"))
    b = added.select(F.col(key).alias("new"), T.canonical_path(key).alias("c"), F.col(kind).alias("kind"), F.col(name).alias("name"))
    same = ["c", "kind", "name"]
    ranked = lambda d, cols, by: d.withColumn("r", F.row_number().over(Window.partitionBy(*cols).orderBy(by)))
    first = ranked(a, same, "old").join(ranked(b, same, "new"), [*same, "r"]).select("old", "new")
    rest_a, rest_b = a.join(first, "old", "left_anti"), b.join(first, "new", "left_anti")
    some = ["c", "kind"]
    second = ranked(rest_a, some, "old").join(ranked(rest_b, some, "new"), [*some, "r"]).select("old", "new")
    return first.unionByName(second)


def fingerprint_pairs(removed: DataFrame, added: DataFrame, block: list[str], cap: int = GROUP_CAP, old_cap: int | None = GROUP_CAP, carry: tuple = ()) -> DataFrame:
    """Candidate renames: equal block columns (null-safe), blocks of at most ``cap`` added and ``old_cap`` removed.

    The cap is the operator's definition, not a limit on work: larger blocks
    tell nothing about a rename.
    """
    sized = lambda d, n: d.withColumn(n, F.count("*").over(Window.partitionBy(*block)))
    more = lambda side: [F.col(c).alias(f"{side}_{c}") for c in carry]
    few = F.lit(True) if old_cap is None else F.col("n_old") <= old_cap
    a = sized(removed, "n_old").where(few).select(F.col("qualified_name").alias("old"), F.col("name").alias("old_name"), F.struct(*block).alias("b"), "n_old", *more("old"))
    b = sized(added, "n_new").where(F.col("n_new") <= cap).select(F.col("qualified_name").alias("new"), F.col("name").alias("new_name"), F.struct(*block).alias("b"), "n_new", *more("new"))
    return a.join(b, a["b"].eqNullSafe(b["b"])).select("old", "new", "old_name", "new_name", "n_old", "n_new", *[f"{side}_{c}" for side in ("old", "new") for c in carry])


def rename_threshold(same_family: Column, ambiguous: Column) -> Column:
    return F.when(~same_family, CROSS_FAMILY).when(ambiguous, AMBIGUOUS).otherwise(SAME_FAMILY)


def rename_candidates(removed: DataFrame, added: DataFrame, part: str = "package") -> DataFrame:
    """Scored candidate renames (``old``, ``new``, ``score``) of four passes within ``part``.

    By kind and exact type, type with masked names, type with masked literals
    too, and for properties of one parent by name alone. The masked passes cap
    the added side only; other directories and groups of over two of one
    primitive type need more similar names. A pair needs the least of its passes.
    """
    type_of, parent = F.col("return_type"), F.regexp_extract("qualified_name", r"(?s)^(.*)\.[^.]*$", 1)
    with_dir = lambda d: d.withColumn("d", F.coalesce(T.directory(T.canonical_path("file")), F.lit("")))
    removed, added = with_dir(removed), with_dir(added)
    found = []
    for fp, old_cap in ((type_of, GROUP_CAP), (T.mask_types(type_of), None), (T.mask_literals(type_of), None)):
        pairs = fingerprint_pairs(removed.withColumn("fp", fp), added.withColumn("fp", fp), ["kind", part, "fp"], old_cap=old_cap, carry=("d", "fp"))
        ambiguous = T.is_primitive_or_absent("old_fp") & ((F.col("n_old") > 2) | (F.col("n_new") > 2))
        found.append(pairs.withColumn("least", rename_threshold(F.col("old_d") == F.col("new_d"), ambiguous)))
    props = lambda d: d.where((F.lower("kind") == "property") & F.contains("qualified_name", F.lit("."))).withColumn("fp", parent)
    found.append(fingerprint_pairs(props(removed), props(added), [part, "fp"]).withColumn("least", F.lit(NAME_ONLY)))
    cols = ["old", "new", "old_name", "new_name"]
    every = found[0].select(*cols, "least")
    for f in found[1:]:
        every = every.unionByName(f.select(*cols, "least"))
    # Cut: else the similarity would be pushed down and folded once a pass.
    once = cut(every.groupBy(*cols).agg(F.min("least").alias("least"))).withColumn("score", T.name_similarity("old_name", "new_name"))
    return once.where("score >= least").select("old", "new", F.round("score", 6).alias("score"))


def greedy_assignment(pairs: DataFrame, score: str = "score", old: str = "old", new: str = "new", rounds: int | None = None) -> DataFrame:
    """One-to-one pairs as by walking candidates from the best: score down, then old, then new.

    Every round takes all pairs that are best on both sides and drops their
    rivals; with a total order that is what the walk takes, in far fewer steps.
    """
    left, taken = cut(pairs.select(old, new, score)), None
    order = [F.desc(score), F.col(old), F.col(new)]
    for step in steps(rounds):
        if not left.limit(1).count():
            break
        ranked = left.withColumn("i", F.row_number().over(Window.partitionBy(old).orderBy(*order))).withColumn(
            "j", F.row_number().over(Window.partitionBy(new).orderBy(*order))
        )
        best = cut(ranked.where("i = 1 and j = 1").select(old, new, score))
        taken = best if taken is None else taken.unionByName(best)
        if step % 50 == 0:
            taken = cut(taken)
        left = cut(left.join(best.select(old), old, "left_anti").join(best.select(new), new, "left_anti"))
    return taken if taken is not None else pairs.select(old, new, score).limit(0)


def sibling_guard(renames: DataFrame) -> DataFrame:
    """Renames across directories stay only if another one moves between the same two; same-name ones always stay."""
    paths = renames.withColumn("d0", T.directory("old")).withColumn("d1", T.directory("new"))
    n = F.count("*").over(Window.partitionBy("d0", "d1"))
    return paths.withColumn("n", n).where("d0 = d1 or n > 1 or old_name = new_name").drop("n", "d0", "d1")


def token_pairs(removed: DataFrame, added: DataFrame, least: float = 0.6) -> DataFrame:
    """Names whose segments overlap: Jaccard of ``least``, and max(2, 60 % of the removed name's) shared.

    Candidates come from an inverted index on segments by prefix filter: a pair
    at this Jaccard shares one of each name's first, rarest segments.
    """
    a = removed.select(F.col("name").alias("old")).distinct().withColumn("s", T.segments("old"))
    b = added.select(F.col("name").alias("new")).distinct().withColumn("s", T.segments("new"))
    freq = a.select(F.explode("s").alias("t")).unionByName(b.select(F.explode("s").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefixes(d: DataFrame, key: str) -> DataFrame:
        n = F.size("s")
        width = (n - F.ceil(n * least - 1e-9) + 1).cast("int")
        tokens = d.select(key, "s", F.explode("s").alias("t")).join(freq, "t")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("f", "t"))
        return tokens.withColumn("r", rank).where(F.col("r") <= width).select(key, F.col("s").alias(f"s_{key}"), "t")

    pairs = prefixes(a, "old").join(prefixes(b, "new"), "t").drop("t").distinct()
    shared = F.size(F.array_intersect("s_old", "s_new"))
    scored = pairs.withColumn("shared", shared).withColumn("score", F.col("shared") / (F.size("s_old") + F.size("s_new") - F.col("shared")))
    enough = F.col("shared") >= F.greatest(F.lit(2), F.ceil(F.size("s_old") * least - 1e-9))
    return scored.where(enough & (F.col("score") >= least)).select("old", "new", F.col("shared").cast("long").alias("shared"), "score")


def migration_targets(removed_members: DataFrame, new_members: DataFrame, least: float = 0.25) -> DataFrame:
    """For each removed container the best new one of its family by shared members.

    Both tables: ``family``, ``container``, ``member``. The ratio is the larger
    of the two directions' shares; ties go to the first container by name.
    """
    a = removed_members.distinct().withColumn("n_old", F.count("*").over(Window.partitionBy("family", "container")))
    b = new_members.distinct().withColumn("n_new", F.count("*").over(Window.partitionBy("family", "container")))
    pairs = (
        a.withColumnRenamed("container", "old")
        .join(b.withColumnRenamed("container", "new"), ["family", "member"])
        .where("old <> new")
        .groupBy("family", "old", "new", "n_old", "n_new")
        .agg(F.count("*").alias("shared"))
    )
    ratio = F.greatest(F.col("shared") / F.col("n_old"), F.col("shared") / F.col("n_new"))
    good = pairs.withColumn("ratio", ratio).where((F.col("shared") >= T.min_overlap("n_old")) & (F.col("ratio") >= least))
    best = F.row_number().over(Window.partitionBy("family", "old").orderBy(F.desc("ratio"), "new"))
    return good.withColumn("r", best).where("r = 1").select("family", "old", "new", "shared", "ratio")


def default_export_dedupe(changes: DataFrame) -> DataFrame:
    """Drop a change of ``default`` where the same file has a named symbol with the same change."""
    named = changes.where("name <> 'default'").select("file", "change").distinct()
    default = changes.where("name = 'default'").join(named, ["file", "change"], "left_anti")
    return changes.where("name <> 'default'").unionByName(default)


def swap_replacements(stopped: DataFrame, started: DataFrame) -> DataFrame:
    """What hosts render instead: for each component that hosts stopped rendering, the one most of them started.

    Of several, one that is a group like it, or like it isn't, then the first by name.
    """
    side = lambda d, n: parted(d.select("host", F.col("component").alias(n)), "host").distinct()
    # Each pair of distinct rows is a host of its own, so that counts fold before they are shuffled.
    pairs = side(stopped, "old").join(side(started, "new"), "host")
    counted = pairs.where("old <> new").groupBy("old", "new").agg(F.count("*").alias("hosts"))
    best = F.row_number().over(Window.partitionBy("old").orderBy(F.desc("hosts"), F.desc(F.col("old").endswith("Group") == F.col("new").endswith("Group")), "new"))
    return counted.withColumn("r", best).where("r = 1").drop("r")
