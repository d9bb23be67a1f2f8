"""Lookups across files, tests, commits and packages, as joins on derived keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import cut, few, release, steps


def importers(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that import a symbol: ``imports`` (file, symbol, module) on ``targets`` (symbol, module)."""
    return imports.join(targets.distinct(), ["symbol", "module"]).select("file", "symbol", "module").distinct()


def callers(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """Callers of functions within their files: ``calls`` (file, caller, callee), ``wanted`` (file, callee)."""
    return calls.join(wanted.distinct(), ["file", "callee"], "left_semi").where("caller <> callee").distinct()


def test_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Tests of each source: ``source``, ``test``, ``priority``; the nearest strategy of each pair.

    Both tables have ``file``. A test is named like its source with ``.test``
    or ``.spec``, beside it (1), in a ``__tests__`` folder there (2), or in any
    folder of that name below the same parent (3).
    """
    named = files.where(F.col("file").rlike(r"\.(test|spec)\.[A-Za-z]+$"))
    tests = named.select(
        F.col("file").alias("test"),
        T.directory("file").alias("dir"),
        F.regexp_replace(T.stem("file"), r"\.(test|spec)$", "").alias("stem"),
    )
    own = sources.select(F.col("file").alias("source"), T.directory("file").alias("dir"), T.stem("file").alias("stem"))
    beside = own.join(tests, ["dir", "stem"]).select("source", "test", F.lit(1).alias("priority"))
    inner = tests.where("dir like '%__tests__'").withColumn("dir", F.regexp_replace("dir", "/?__tests__$", ""))
    below = own.join(inner, ["dir", "stem"]).select("source", "test", F.lit(2).alias("priority"))
    parent = lambda d: d.withColumn("dir", T.directory("dir"))
    far = parent(own).join(parent(tests), ["dir", "stem"]).select("source", "test", F.lit(3).alias("priority"))
    return beside.unionByName(below).unionByName(far).groupBy("source", "test").agg(F.min("priority").alias("priority"))


def cochange_replacements(removed: DataFrame, added: DataFrame) -> DataFrame:
    """What replaced a removed component: the only one added by the commits that removed it. Both: ``commit``, ``component``."""
    pairs = removed.withColumnRenamed("component", "old").join(added.withColumnRenamed("component", "new"), "commit").where("old <> new")
    return pairs.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new")).where("n = 1").select("old", "new")


def prop_moves(removed_props: DataFrame, child_props: DataFrame) -> DataFrame:
    """Props that a parent lost and a child of its family has: ``family``, ``parent``, ``child``, ``prop``.

    ``removed_props``: family, component, prop; ``child_props``: the same of the
    new version. The child must own the prop itself.
    """
    a = removed_props.withColumnRenamed("component", "parent").distinct()
    b = child_props.withColumnRenamed("component", "child").distinct()
    return a.join(b, ["family", "prop"]).where("parent <> child").select("family", "parent", "child", "prop")


def packages_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """The package of each file (``file``): the longest of ``packages`` (``dir``, ``package``) that holds it; null without one.

    A file's directories are its keys, so the prefix join is an equi-join.
    """
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = files.select("file", F.explode(dirs).alias("dir")).join(packages, "dir")
    best = hits.groupBy("file").agg(F.max_by("package", F.length("dir")).alias("package"))
    return files.join(best, "file", "left")


def barrel_dedupe(changes: DataFrame) -> DataFrame:
    """Drop a barrel file's change where another file has the same (symbol, change)."""
    barrel = F.col("file").rlike(r"(^|/)index(\.d)?\.[a-z]+$")
    real = changes.where(~barrel).select("symbol", "change").distinct()
    return changes.where(~barrel).unionByName(changes.where(barrel).join(real, ["symbol", "change"], "left_anti"))


def redirect(changes: DataFrame, replacements: DataFrame) -> DataFrame:
    """Rewrite changes of replaced components (``old`` to ``new``): relocated ones become changed, their props' are dropped."""
    known = replacements.select(F.col("old").alias("component"), "new")
    out = changes.join(known, "component", "left")
    kept = out.where(F.col("new").isNull() | F.col("prop").isNull())
    moved = F.col("new").isNotNull() & (F.col("change") == "relocated")
    return kept.withColumn("change", F.when(moved, "changed").otherwise(F.col("change"))).withColumnRenamed("new", "replacement")


def managed_attributes(changed: DataFrame, bindings: DataFrame) -> DataFrame:
    """Components whose attributes a changed helper generates. ``changed``: function; ``bindings``: component, attribute, generator."""
    return bindings.join(changed.select(F.col("function").alias("generator")).distinct(), "generator", "left_semi").distinct()


def inherited_props(props: DataFrame, extends: DataFrame) -> DataFrame:
    """Own and inherited props: ``interface``, ``prop``, through all levels of ``extends`` (child, parent).

    Each round a node takes what the nodes at the end of its links know, then
    links to where theirs end: after k rounds it knows all within 2^k levels,
    and links only to what is just that far. Links end at the top or, on
    cycles, once no path without repeats is longer.
    """
    gather = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    own = props.groupBy(F.col("interface").alias("node")).agg(gather(F.array("prop")).alias("props"))
    up = extends.where("child <> parent").groupBy(F.col("child").alias("node")).agg(F.collect_set("parent").alias("up"))
    none = F.array().cast(own.schema["props"].dataType)
    state = cut(own.join(up, "node", "full_outer").withColumn("props", F.coalesce("props", none)))
    longest = state.where("up is not null").count()
    for step in steps(None):
        links = state.select("node", F.explode("up").alias("at"))
        theirs = state.withColumnsRenamed({"node": "at", "props": "more", "up": "further"})
        # The farther links reach, the fewer nodes they end at: those go to every task.
        ends = links.select("at").distinct()
        if few(ends, 50_000):
            theirs = F.broadcast(theirs.join(F.broadcast(ends), "at", "left_semi"))
        got = links.join(theirs, "at").groupBy("node").agg(gather("more").alias("more"), gather("further").alias("further"))
        after = state.drop("up").join(got, "node", "left")
        further = F.array_except("further", F.array("node"))
        after = after.select("node", F.when(F.col("more").isNull(), F.col("props")).otherwise(F.array_union("props", "more")).alias("props"), F.when(F.size(further) > 0, further).alias("up"))
        last, state = state, cut(after)
        release(last)
        if 2**step > longest or not state.where("up is not null").limit(1).count():
            break
    return state.select(F.col("node").alias("interface"), F.explode("props").alias("prop"))
