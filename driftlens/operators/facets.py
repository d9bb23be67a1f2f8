"""Diffs of manifests, profiles and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _object(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_map(content: str | Column, field: str) -> Column:
    """A string map of a JSON manifest; empty where the field is missing or no object."""
    text = F.col(content) if isinstance(content, str) else content
    return _object(F.get_json_object(text, f"$.{field}"))


def json_bins(content: str) -> Column:
    """Commands of a manifest; a plain string is one command of the package's name."""
    return _bins(F.get_json_object(F.col(content), "$.bin"), F.get_json_object(F.col(content), "$.name"))


def _bins(raw: Column, name: Column) -> Column:
    return F.when(raw.isNotNull() & ~raw.startswith("{"), F.create_map(F.coalesce(name, F.lit("<unknown>")), raw)).otherwise(_object(raw))


def map_changes(a: Column, b: Column) -> Column:
    """``map_diff`` of two maps of one row, as an array of structs."""

    def entry(k: Column) -> Column:
        before, after = F.try_element_at(a, k), F.try_element_at(b, k)
        change = F.when(before.isNull() & after.isNull(), None).when(before.isNull(), "added").when(after.isNull(), "removed").when(before != after, "changed")
        return F.struct(k.alias("field"), change.alias("change"), before.alias("before"), after.alias("after"))

    return F.filter(F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), entry), lambda r: r["change"].isNotNull())


def map_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Entries of two map columns that were added, removed or changed."""
    a = pairs.select(key, F.explode(old).alias("field", "before"))
    b = pairs.select(key, F.explode(new).alias("field", "after"))
    both = a.join(b, [key, "field"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "field", "change", "before", "after")


#: Per map of a manifest, which changes count and whether they break.
_BREAKS = {"peerDependencies": {"added": True, "removed": False, "changed": True}, "engines": {"added": True, "changed": True}, "bin": {"removed": True}}


#: Top-level fields of a manifest that are read, all in one pass over its text.
_FIELDS = ("main", "module", "types", "typings", "type", "name", "peerDependencies", "engines", "bin", "exports")


def manifest_diff(pairs: DataFrame, key: str = "case") -> DataFrame:
    """``old`` and ``new`` package manifests (JSON text): entry points, module system, exports, dependency maps.

    Each row holds both manifests, so its maps are compared where they are.
    """
    both = pairs.select(key, "old", "new")
    for side in ("old", "new"):
        both = both.select("*", F.json_tuple(side, *_FIELDS).alias(*[f"{side}_{f}" for f in _FIELDS]))
    at = lambda side, f: F.col(f"{side}_{f}")
    of = {f: (lambda side, f=f: _object(at(side, f))) for f in _BREAKS} | {"bin": lambda side: _bins(at(side, "bin"), at(side, "name")), "exports": lambda side: _exports(at(side, "exports"))}
    maps = both.select("*", *[m(side).alias(f"{side}_map_{f}") for f, m in of.items() for side in ("old", "new")])
    rows = []
    for f in ("main", "module", "types", "typings"):
        a, b = at("old", f), at("new", f)
        row = F.struct(F.lit(f).alias("field"), F.lit("entry_point").alias("change"), F.lit(True).alias("is_breaking"), a.alias("before"), b.alias("after"))
        rows.append(F.when(a.isNotNull() & ~a.eqNullSafe(b), row))
    a, b = (F.coalesce(at(s, "type"), F.lit("commonjs")) for s in ("old", "new"))
    row = F.struct(F.lit("type").alias("field"), F.lit("module_system").alias("change"), F.lit(True).alias("is_breaking"), a.alias("before"), b.alias("after"))
    rows.append(F.when(a != b, row))
    parts = [F.filter(F.array(*rows), lambda r: r.isNotNull())]
    for f, breaks in (_BREAKS | {"exports": {"added": False, "removed": True, "changed": True}}).items():
        parts.append(_counted(f, breaks, at("old", f"map_{f}"), at("new", f"map_{f}")))
    return maps.select(key, F.inline(F.concat(*parts)))


def _counted(f: str, breaks: dict, a: Column, b: Column) -> Column:
    """The changes of map ``f`` that count, as rows of ``manifest_diff``."""
    matter, verb = [c for c, b in breaks.items() if b], "export_" if f == "exports" else "dependency_"

    def row(r: Column) -> Column:
        named = F.concat(F.lit(f"{f}."), r["field"]).alias("field"), F.concat(F.lit(verb), r["change"]).alias("change")
        return F.struct(*named, r["change"].isin(*matter).alias("is_breaking"), r["before"].alias("before"), r["after"].alias("after"))

    return F.transform(F.filter(map_changes(a, b), lambda r: r["change"].isin(*breaks)), row)


def flat_exports(content: str) -> Column:
    """``exports`` as subpath and condition to target; a plain string is ``.`` and one condition level is flattened."""
    return _exports(F.get_json_object(F.col(content), "$.exports"))


def _exports(raw: Column) -> Column:
    plain = F.when(raw.isNotNull() & ~raw.startswith("{"), F.create_map(F.lit("."), raw))
    top = F.map_entries(F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>"))
    nested = F.flatten(
        F.transform(
            top,
            lambda e: F.when(
                e["value"].startswith("{"),
                F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("#"), x["key"]).alias("key"), x["value"].alias("value"))),
            ).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))),
        )
    )
    return F.coalesce(plain, F.map_from_entries(nested), F.create_map().cast("map<string,string>"))


def gradle_dependencies(content: Column) -> Column:
    """``group:name`` to version of a Gradle build file."""
    pattern = F.lit("(?:implementation|api|compileOnly|runtimeOnly)[ (]+['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]")
    return F.map_from_arrays(F.regexp_extract_all(content, pattern, F.lit(1)), F.regexp_extract_all(content, pattern, F.lit(2)))


def pom_dependencies(content: Column) -> Column:
    """``groupId:artifactId`` to version of a Maven POM."""
    part = lambda t: F.xpath(content, F.lit(f"/project/dependencies/dependency/{t}/text()"))
    names = F.zip_with(part("groupId"), part("artifactId"), lambda g, a: F.concat(g, F.lit(":"), a))
    return F.map_from_arrays(names, part("version"))


def counts_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences per key on either side, where they differ."""
    a = old.groupBy(*keys).agg(F.count("*").alias("n_old"))
    b = new.groupBy(*keys).agg(F.count("*").alias("n_new"))
    both = a.join(b, keys, "full_outer").na.fill(0, ["n_old", "n_new"])
    return both.where("n_old <> n_new").withColumn("delta", F.col("n_new") - F.col("n_old"))


def set_diff(pairs: DataFrame, key: str, old: Column, new: Column) -> DataFrame:
    """Elements of two arrays on one side only."""
    lost = pairs.select(key, F.explode(F.array_except(old, new)).alias("element"), F.lit("removed").alias("change"))
    got = pairs.select(key, F.explode(F.array_except(new, old)).alias("element"), F.lit("added").alias("change"))
    return lost.unionByName(got)


def assertion_lines(diffs: DataFrame, pattern: str) -> DataFrame:
    """Added and removed lines of unified diffs (``file``, ``diff``) that assert something."""
    lines = diffs.select("file", F.posexplode(F.split("diff", "\n")).alias("n", "line"))
    sign = F.substring("line", 1, 1)
    kept = lines.where(sign.isin("+", "-") & ~F.col("line").rlike(r"^(\+\+\+|---)") & F.col("line").rlike(pattern))
    return kept.select("file", "n", F.when(sign == "+", "added").otherwise("removed").alias("change"), F.trim(F.expr("substring(line, 2)")).alias("line"))
