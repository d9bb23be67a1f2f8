"""String functions on names, types and paths, all as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMITIVES = ("string", "number", "boolean", "any", "void", "undefined", "null", "never", "unknown")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence: one row of the table folded over the characters of ``a``."""
    chars = lambda c: F.filter(F.split(_col(c), ""), lambda x: x != "")
    right = chars(b)
    zero = F.transform(F.concat(F.array(F.lit("")), right), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        # Cell j is the best of its left, upper and, on a match, diagonal neighbour.
        cells = F.transform(right, lambda y, j: F.struct(y.alias("y"), F.element_at(above, (j + 1).cast("int")).alias("d"), F.element_at(above, (j + 2).cast("int")).alias("u")))
        return F.aggregate(
            cells,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(
                acc, F.array(F.when(c["y"] == x, c["d"] + 1).otherwise(F.greatest(c["u"], F.element_at(acc, -1))))
            ),
        )

    return F.element_at(F.aggregate(chars(a), zero, row), -1)


def name_similarity(a, b) -> Column:
    """LCS length over the longer length; equal names are 1, an empty one is 0."""
    a, b = _col(a), _col(b)
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(lcs_length(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def segments(name) -> Column:
    """Distinct lower-cased parts of a name between underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(name)), "_"), lambda x: x != ""))


def jaccard(a, b) -> Column:
    """Shared over all elements of two arrays; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(_col(a), _col(b))), F.size(F.array_union(_col(a), _col(b))))


def mask_types(t) -> Column:
    """Capitalised identifiers as ``_T_`` without their type arguments, parameter names as ``_p_``."""
    out = F.regexp_replace(_col(t), "[A-Z](?=[A-Za-z0-9_]*[a-z])[A-Za-z0-9_]*", "_T_")
    for _ in range(4):  # innermost first; deeper nesting than this keeps its outer part
        out = F.regexp_replace(out, "_T_<[^<>]*>", "_T_")
    return F.regexp_replace(out, "[a-z][A-Za-z0-9_]*(\\s*:)", "_p_$1")


def mask_literals(t) -> Column:
    """``mask_types`` with string literals as ``_V_`` and runs of one placeholder folded."""
    out = F.regexp_replace(mask_types(t), "'[^']*'", "'_V_'")
    return F.regexp_replace(F.regexp_replace(out, "('_V_'\\s*\\|\\s*)+'_V_'", "'_V_'"), "(_T_\\s*\\|\\s*)+_T_", "_T_")


def is_primitive_or_absent(t) -> Column:
    return _col(t).isNull() | F.lower(F.trim(_col(t))).isin(*PRIMITIVES)


def pascal_to_kebab(s) -> Column:
    return F.lower(F.regexp_replace(_col(s), "(?<!^)([A-Z])", "-$1"))


def camel_to_kebab(s) -> Column:
    return F.lower(F.regexp_replace(_col(s), "([A-Z])", "-$1"))


def kebab_to_camel(s) -> Column:
    parts = F.split(_col(s), "-")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def block_to_component(block) -> Column:
    """``menu-toggle`` to ``MenuToggle``."""
    return F.array_join(F.transform(F.split(_col(block), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def trailing_suffix(name) -> Column:
    """A capitalised part after the last underscore that isn't all capitals; null without one."""
    return F.nullif(F.regexp_extract(_col(name), "_([A-Z][^_]*[a-z][^_]*)$", 1), F.lit(""))


def version_prefix(name) -> Column:
    """``pf-v5`` of ``pf-v5-c-menu``; null without a version."""
    return F.nullif(F.regexp_extract(_col(name), "^([a-z]+-v[0-9]+)-", 1), F.lit(""))


def canonical_path(path) -> Column:
    """A path without its ``deprecated`` and ``next`` directories."""
    return F.regexp_replace(_col(path), "(^|/)(deprecated|next)(?=/)", "")


def directory(path) -> Column:
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def stem(path) -> Column:
    return F.regexp_replace(F.regexp_extract(_col(path), "([^/]+)$", 1), "(\\.d)?\\.[A-Za-z]+$", "")


def sanitize_id(s) -> Column:
    """Lower case, other than letters and digits as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeeze(s) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.lower(F.regexp_replace(F.trim(_col(s)), "\\s+", " "))


def normal_body(body) -> Column:
    """A function body without comments and blank lines, each line trimmed."""
    bare = F.regexp_replace(F.regexp_replace(_col(body), "(?s)/\\*.*?\\*/", ""), "(?m)//.*$", "")
    return F.array_join(F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def string_literals(body) -> Column:
    return F.regexp_extract_all(_col(body), F.lit("['\"]([^'\"]*)['\"]"), F.lit(1))


def union_values(t) -> Column:
    """The string literals of a union type, in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(t), F.lit("")), F.lit("'([^']*)'"), F.lit(1)))


def css_references(body) -> Column:
    """Custom properties and classes that a body names."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit("(--[a-zA-Z0-9_-]+|class=\"[^\"]*\")"), F.lit(1)))


def min_overlap(members) -> Column:
    """Members that a migration must share: 1 of up to three, 2 of up to six, else 3."""
    return F.when(_col(members) <= 3, 1).when(_col(members) <= 6, 2).otherwise(3)


def alternation(names) -> Column:
    """An anchored pattern that matches any of an array of names."""
    quoted = F.transform(F.array_sort(F.array_distinct(_col(names))), lambda n: F.regexp_replace(n, "([.\\\\+*?\\[\\]^$(){}=!<>|:#-])", "\\\\$1"))
    return F.concat(F.lit("^("), F.array_join(quoted, "|"), F.lit(")$"))


def first_rename(name, patterns: list[tuple[str, str]]) -> Column:
    """The result of the first pattern that changes the name; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_replace(_col(name), p, r), _col(name)) for p, r in patterns], F.lit(None).cast("string"))
