"""Migration rules from changes: each a projection to one row per rule, ids made unique at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as T
from . import report

COLUMNS = ["rule_id", "change_type", "package", "effort", "category", "pattern", "location", "strategy"]
#: Rule of a Java source change: label, where it shows, effort. Other categories make no rule.
JAVA = {
    "annotation_removed": ("annotation-removed", "ANNOTATION", 3),
    "annotation_changed": ("annotation-changed", "ANNOTATION", 2),
    "synchronization_removed": ("synchronization-removed", "METHOD_CALL", 3),
    "exception_added": ("exception-added", "METHOD_CALL", 3),
    "serialization_field_removed": ("serialization-break", "TYPE", 5),
    "serialization_field_type_changed": ("serialization-break", "TYPE", 5),
    "transient_changed": ("serialization-break", "TYPE", 3),
    "override_removed": ("override-removed", "TYPE", 3),
    "constructor_changed": ("constructor-changed", "CONSTRUCTOR_CALL", 3),
    "final_added": ("final-added", "TYPE", 3),
    "sealed_changed": ("sealed-changed", "TYPE", 3),
    "inheritance_changed": ("inheritance-changed", "TYPE", 5),
    "native_removed": ("native-removed", "METHOD_CALL", 5),
    "delegation_changed": ("delegation-changed", "METHOD_CALL", 3),
    "module_export_removed": ("module-export-removed", "IMPORT", 5),
}
MANIFEST_EFFORT = {"module_system": 7, "entry_point": 5, "export_removed": 5}


def _rule(rule_id: Column, change_type, package, effort, category, pattern: Column, location, strategy) -> list[Column]:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    cells = (rule_id, lit(change_type), lit(package).cast("string"), lit(effort).cast("int"), lit(category), pattern, lit(location), lit(strategy).cast("string"))
    return [c.alias(n) for c, n in zip(cells, COLUMNS)]


def _id(*parts) -> Column:
    return F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else T.sanitize_id(p) for p in parts])


def _exact(name) -> Column:
    return F.concat(F.lit("^"), F.col(name) if isinstance(name, str) else name, F.lit("$"))


def _packaged(changes: DataFrame, packages: DataFrame) -> DataFrame:
    """Add the ``package`` of each ``component``; one that none is known for is ``unknown``."""
    return changes.join(packages, "component", "left").withColumn("package", F.coalesce("package", F.lit("unknown")))


def deprecated_prop_rules(changes: DataFrame, packages: DataFrame) -> DataFrame:
    """Per newly deprecated prop, an optional rule on its use."""
    c = _packaged(changes.where("category = 'prop_deprecated'"), packages)
    return c.select(*_rule(_id("source-deprecated-prop", F.col("component"), F.col("before")), "prop-deprecated", F.col("package"), 1, "optional", _exact("before"), "JSX_PROP", None))


def context_rules(changes: DataFrame, packages: DataFrame) -> DataFrame:
    """Per context that a component came to use or provide, or ceased to, a rule on its import; ``key`` names it."""
    c = _packaged(changes.where("category = 'context_dependency'"), packages)
    return c.select(*_rule(_id("source-context", F.col("component"), F.col("key")), "context-dependency", F.col("package"), 3, "mandatory", _exact("key"), "IMPORT", "Manual"))


def removed_member_rules(old: DataFrame, new: DataFrame, packages: DataFrame) -> DataFrame:
    """Per member that left its family (``family``, ``component``), a rule on its use."""
    on = ["family", "component"]
    gone = _packaged(old.select(*on).distinct().join(new.select(*on), on, "left_anti"), packages)
    return gone.select(*_rule(_id("composition", F.col("family"), "removed-member", F.col("component")), "composition", F.col("package"), 3, "mandatory", _exact("component"), "JSX_COMPONENT", "Manual"))


def css_block_rules(blocks: DataFrame, prefixes: tuple[str, str]) -> DataFrame:
    """Per removed ``block`` a rule on its class under either version's prefix."""
    pattern = F.concat(F.lit(f"({'|'.join(prefixes)})-c-"), F.col("block"))
    return blocks.select(*_rule(_id("css-removed", F.col("block")), "css-removal", None, 3, "mandatory", pattern, "CSS_CLASS", None))


def css_file_rules(files: DataFrame, package: str) -> DataFrame:
    """Per removed style entry ``file`` a rule on its import."""
    name = F.regexp_replace("file", r"\.scss$", "")
    named = files.withColumn("file", name).where("file <> ''")
    return named.select(*_rule(_id("css-file-removed", F.col("file")), "css-file-removed", package, 1, "mandatory", F.concat(F.lit(f"{package}/"), F.col("file")), "IMPORT", None))


def dead_class_rules(dead: DataFrame) -> DataFrame:
    """Per class whose swapped name doesn't exist either (``class``, ``swapped``), a rule on both."""
    quoted = lambda c: F.regexp_replace(c, r"([.+*?()|\[\]{}^$\\-])", r"\\$1")
    pattern = F.concat(F.lit("("), quoted("class"), F.lit("|"), quoted("swapped"), F.lit(")"))
    return dead.select(*_rule(_id("css-dead-class", F.col("class")), "css-dead-class", None, 3, "mandatory", pattern, "CSS_CLASS", None))


def java_rules(changes: DataFrame, prefix: str = "java") -> DataFrame:
    """Per breaking source change of a class (``class_name``, ``category``, ``before``, ``after``) that a rule can find."""
    part = lambda i: S.lookup({k: v[i] for k, v in JAVA.items()}, "category")
    c = changes.where("is_breaking").where(F.col("category").isin(*JAVA))
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    strategy = F.when(F.col("category").isin("annotation_removed", "annotation_changed", "final_added", "sealed_changed"), "ManualReview").when(
        F.col("category") == "inheritance_changed", F.when(known, "UpdateSignature").otherwise("ManualReview")
    )
    pattern = F.regexp_replace("class_name", r"([.$])", r"\\$1")
    base = c.select(*_rule(F.concat_ws("-", F.lit(f"{prefix}-sd"), part(0), T.sanitize_id("class_name")), part(0), None, part(2), "mandatory", pattern, part(1), strategy))
    return report.unique_ids(base, "rule_id", ["location", "effort", "strategy"]).drop("rule_id").withColumnRenamed("unique_id", "rule_id").select(*COLUMNS)


def manifest_rules(changes: DataFrame) -> DataFrame:
    """Per manifest change (``field``, ``change``, ``is_breaking``) a rule; ids of one field and change are numbered by ``case_id``."""
    label = F.replace("change", F.lit("_"), F.lit("-"))
    effort = F.coalesce(S.lookup(MANIFEST_EFFORT, "change"), F.lit(3))
    strategy = F.when(F.col("field").startswith("peerDependencies.") & F.col("change").isin("dependency_added", "dependency_changed"), F.when(F.col("after").isNotNull(), "EnsureDependency").otherwise("Manual")).otherwise("Manual")
    base = changes.select("case_id", *_rule(F.concat_ws("-", F.lit("manifest"), T.sanitize_id("field"), label), label, None, effort, F.when(F.col("is_breaking"), "mandatory").otherwise("optional"), F.col("field"), "MANIFEST", strategy))
    return report.unique_ids(base, "rule_id", ["case_id"]).drop("rule_id").withColumnRenamed("unique_id", "rule_id").select("case_id", *COLUMNS)


def change_rules(changes: DataFrame) -> DataFrame:
    """Per API change that takes something away, a rule with its effort and repair."""
    c = changes.where(~S.is_additive("verb", "before", "after", "description"))
    fix = S.fix_strategy("verb", "kind", "symbol", "before", "after", "description", "file", "target", "disposition")
    leaf = F.substring_index("symbol", ".", -1)
    where = F.when(F.col("kind") == "property", "JSX_PROP").otherwise("IMPORT")
    label = F.replace("verb", F.lit("_"), F.lit("-"))
    base = c.withColumn("fix", fix).select("id", *_rule(F.concat_ws("-", F.lit("api"), T.sanitize_id("symbol"), label), label, None, S.effort("verb"), "mandatory", _exact(leaf), where, F.col("fix.strategy")))
    return report.unique_ids(base, "rule_id", ["id"]).drop("rule_id").withColumnRenamed("unique_id", "rule_id").select("id", *COLUMNS)
