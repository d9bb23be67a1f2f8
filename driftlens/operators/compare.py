"""Comparing matched symbols: one change row per difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RANK = {"private": 0, "internal": 1, "protected": 2, "public": 3, "exported": 4}


def _change(kind: str, breaking, before: Column, after: Column, when: Column) -> Column:
    breaking = breaking if isinstance(breaking, Column) else F.lit(breaking)
    row = F.struct(F.lit(kind).alias("change"), breaking.alias("is_breaking"), before.cast("string").alias("before"), after.cast("string").alias("after"))
    return F.when(when, row)


def _emit(pairs: DataFrame, key: str, changes: list[Column]) -> DataFrame:
    rows = F.filter(F.array(*changes), lambda c: c.isNotNull())
    return pairs.select(key, F.inline(rows))


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def visibility_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """``old_visibility`` against ``new_visibility``: less visible is breaking."""
    a, b = F.col("old_visibility"), F.col("new_visibility")
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), c), F.lit(-1))
    return _emit(pairs, key, [_change("visibility", rank(b) < rank(a), a, b, _differ(a, b))])


def modifier_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Changes of readonly, abstract, static and accessor kind.

    Becoming readonly or abstract breaks, ceasing to be doesn't; static and
    accessor changes always do.
    """
    out = []
    for m, breaks in (("readonly", None), ("abstract", None), ("static", True)):
        a, b = F.coalesce(F.col(f"old_{m}"), F.lit(False)), F.coalesce(F.col(f"new_{m}"), F.lit(False))
        out.append(_change(m, b if breaks is None else True, a, b, a != b))
    a, b = F.col("old_accessor"), F.col("new_accessor")
    return _emit(pairs, key, [*out, _change("accessor", True, a, b, _differ(a, b))])


def hierarchy_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Base class changes (breaking) and implemented interfaces lost (breaking) or gained."""
    a, b = F.col("old_extends"), F.col("new_extends")
    base = _emit(pairs, key, [_change("extends", True, a, b, _differ(a, b))])
    empty = F.array().cast("array<string>")
    old, new = F.coalesce("old_implements", empty), F.coalesce("new_implements", empty)
    lost = pairs.select(key, F.explode(F.array_except(old, new)).alias("before")).select(key, F.lit("implements_removed").alias("change"), F.lit(True).alias("is_breaking"), "before", F.lit(None).cast("string").alias("after"))
    got = pairs.select(key, F.explode(F.array_except(new, old)).alias("after")).select(key, F.lit("implements_added").alias("change"), F.lit(False).alias("is_breaking"), F.lit(None).cast("string").alias("before"), "after")
    return base.unionByName(lost).unionByName(got)


def signature_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Signatures gained or lost, async wrapping of the return type, and other return type changes."""
    had, has = F.col("old_has_signature"), F.col("new_has_signature")
    a, b = F.col("old_return"), F.col("new_return")
    wrapped = b == F.concat(F.lit("Promise<"), a, F.lit(">"))
    bare = a == F.concat(F.lit("Promise<"), b, F.lit(">"))
    both = had & has & _differ(a, b)
    return _emit(
        pairs,
        key,
        [
            _change("signature_removed", True, a, b, had & ~has),
            _change("signature_added", False, a, b, ~had & has),
            _change("made_async", True, a, b, both & F.coalesce(wrapped, F.lit(False))),
            _change("made_sync", True, a, b, both & F.coalesce(bare, F.lit(False))),
            _change("return_type", True, a, b, both & ~F.coalesce(wrapped | bare, F.lit(False))),
        ],
    )


def parameter_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Positional diff of ``old_params``/``new_params``: arrays of struct(name, type, optional, variadic).

    A parameter added breaks unless it is optional; one removed, retyped or made
    required breaks; a new name or becoming optional doesn't. Variadic ones are
    compared apart.
    """
    fixed = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)), lambda p: ~p["variadic"])
    rest = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast(pairs.schema[c].dataType)), lambda p: p["variadic"])
    split = pairs.select(key, fixed("old_params").alias("a"), fixed("new_params").alias("b"))
    rows = split.select(key, F.inline(F.arrays_zip("a", "b")))
    a, b = F.col("a"), F.col("b")
    out = _emit(
        rows,
        key,
        [
            _change("parameter_added", ~b["optional"], a["name"], b["name"], a.isNull()),
            _change("parameter_removed", True, a["name"], b["name"], b.isNull()),
            _change("parameter_renamed", False, a["name"], b["name"], a["name"] != b["name"]),
            _change("parameter_type", True, a["type"], b["type"], a.isNotNull() & b.isNotNull() & _differ(a["type"], b["type"])),
            _change("parameter_required", True, a["name"], b["name"], a["optional"] & ~b["optional"]),
            _change("parameter_optional", False, a["name"], b["name"], ~a["optional"] & b["optional"]),
        ],
    )
    was, now = rest("old_params"), rest("new_params")
    return out.unionByName(_emit(pairs, key, [_change("variadic_removed", True, was, now, was & ~now), _change("variadic_added", False, was, now, ~was & now)]))


def type_parameter_diff(pairs: DataFrame, key: str = "qualified_name") -> DataFrame:
    """``old_types``/``new_types``, arrays of struct(name, constraint, default): reordered, added, removed, reconstrained."""
    names = lambda c: F.transform(F.col(c), lambda t: t["name"])
    reordered = (F.array_sort(names("old_types")) == F.array_sort(names("new_types"))) & (names("old_types") != names("new_types"))
    moved = _emit(pairs, key, [_change("type_parameters_reordered", True, F.array_join(names("old_types"), ","), F.array_join(names("new_types"), ","), reordered)])
    kept = pairs.where(~reordered).select(key, F.col("old_types").alias("a"), F.col("new_types").alias("b"))
    rows = kept.select(key, F.inline(F.arrays_zip("a", "b")))
    a, b = F.col("a"), F.col("b")
    return moved.unionByName(
        _emit(
            rows,
            key,
            [
                _change("type_parameter_added", b["default"].isNull(), a["name"], b["name"], a.isNull()),
                _change("type_parameter_removed", True, a["name"], b["name"], b.isNull()),
                _change("type_parameter_constraint", True, a["constraint"], b["constraint"], a.isNotNull() & b.isNotNull() & _differ(a["constraint"], b["constraint"])),
                _change("type_parameter_default", a["default"].isNotNull() & b["default"].isNull(), a["default"], b["default"], a.isNotNull() & b.isNotNull() & _differ(a["default"], b["default"])),
            ],
        )
    )


def union_value_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """String literals that a union type lost (breaking) or gained."""
    a, b = T.union_values(old), T.union_values(new)
    lost = pairs.select(key, F.explode(F.array_except(a, b)).alias("value"), F.lit("removed").alias("change"), F.lit(True).alias("is_breaking"))
    got = pairs.select(key, F.explode(F.array_except(b, a)).alias("value"), F.lit("added").alias("change"), F.lit(False).alias("is_breaking"))
    return lost.unionByName(got)


def member_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members (``parent``, ``member``, ``type``) of parents that both sides have: added, removed, changed."""
    shared = old.select("parent").intersect(new.select("parent"))
    a = old.join(shared, "parent", "left_semi").select("parent", "member", F.col("type").alias("before"), F.lit(True).alias("o"))
    b = new.join(shared, "parent", "left_semi").select("parent", "member", F.col("type").alias("after"), F.lit(True).alias("n"))
    both = a.join(b, ["parent", "member"], "full_outer")
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(_differ(F.col("before"), F.col("after")), "changed")
    return both.withColumn("change", change).where("change is not null").select("parent", "member", "change", "before", "after")


def body_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Functions (``file``, ``name``, ``body``) whose bodies differ beyond comments and white space."""
    side = lambda d, n: d.select("file", "name", T.normal_body("body").alias(n))
    both = side(old, "before").join(side(new, "after"), ["file", "name"], "full_outer")
    return both.where(_differ(F.col("before"), F.col("after")))
