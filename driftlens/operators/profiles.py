"""Diffs of component, class and function profiles in long form: one outer join, one case per facet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import cut

#: Facets of ``profile_diff``: category, whether a removal and an addition touch tests, and whether values are compared.
_FACETS = {
    "consumed_context": ("context_dependency", False, False, False),
    "provided_context": ("context_dependency", True, True, False),
    "rendered_component": ("rendered_component", False, False, False),
    "element": ("dom_structure", True, True, False),
    "aria": ("aria_change", True, True, True),
    "role": ("role_change", True, True, True),
    "data": ("data_attribute", True, True, False),
    "css_token": ("css_token", True, True, False),
    "prop_default": ("prop_default", None, False, True),
}
_ON = ["component", "facet", "element", "key"]
_OUT = ["component", "category", "change", "element", "key", "before", "after", "affects_tests"]


def _long(change: Column, category, before, after, tests, element=None, key=None) -> list[Column]:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    cells = (lit(category), change, text(element), text(key), text(before), text(after), lit(tests))
    return ["component", *[c.alias(n) for c, n in zip(cells, _OUT[1:])]]


def facet_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Contexts, rendered components, elements, attributes, tokens and defaults that came, went or changed.

    ``old`` and ``new``: ``component``, ``facet``, ``element``, ``key``,
    ``value``, ``conditional``. Of elements, data attributes and tokens only
    presence counts. An attribute that was always there and now depends on a
    condition is a change of its own. A removed or changed default touches
    tests if it was a string.
    """
    side = lambda d, n: d.where(F.col("facet").isin(*_FACETS)).select(*[F.coalesce(c, F.lit("")).alias(c) for c in _ON], F.struct("value", F.coalesce("conditional", F.lit(False)).alias("maybe")).alias(n))
    both = side(old, "a").join(side(new, "b"), _ON, "full_outer")
    pick = lambda i: F.element_at(F.create_map(*[x for f, row in _FACETS.items() for x in (F.lit(f), F.lit(row[i]))]), F.col("facet"))
    gone, came = F.col("b").isNull(), F.col("a").isNull()
    change = F.when(came, "added").when(gone, "removed").when(pick(3) & ~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    # A default's entry is null in the table: whether it touches tests hangs on its value.
    quoted = F.coalesce(F.col("a.value").rlike("""^['"]"""), F.lit(False))
    tests = F.when(F.col("facet") == "prop_default", ~came & quoted).when(came, pick(2)).otherwise(pick(1))
    named = F.nullif("element", F.lit("")), F.nullif("key", F.lit(""))
    out = both.withColumn("change", change).where("change is not null").select(*_long(F.col("change"), pick(0), F.col("a.value"), F.col("b.value"), tests, *named))
    maybe = both.where(F.col("facet").isin("aria", "role", "data") & ~came & ~gone & ~F.col("a.maybe") & F.col("b.maybe"))
    return out.unionByName(maybe.select(*_long(F.lit("conditional"), "attribute_conditionality", F.col("a.value"), None, True, *named)))


def flag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Portal, refs, memo, children and the path to them, of components on both sides (one row each).

    A change of the path counts where both sides have one; it touches tests
    where an HTML element comes to wrap the children.
    """
    pairs = old.alias("a").join(new.alias("b"), "component")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    rows = []
    for flag, category, tests in (("uses_portal", "portal_usage", True), ("is_forward_ref", "forward_ref", False), ("is_memo", "memo", False), ("has_children", "composition", False)):
        rows.append((a(flag) != b(flag), F.when(b(flag), "added").otherwise("removed"), category, a(flag), b(flag), tests, flag))
    rows.append((a("uses_portal") & b("uses_portal") & ~a("portal_target").eqNullSafe(b("portal_target")), F.lit("changed"), "portal_usage", F.coalesce(a("portal_target"), F.lit("unknown")), F.coalesce(b("portal_target"), F.lit("unknown")), True, "portal_target"))
    html = lambda c: F.exists(c, lambda t: t.rlike("^[a-z]"))
    wraps = html(b("children_path")) & ~html(a("children_path"))
    path = (a("children_path") != b("children_path")) & (F.size(a("children_path")) > 0) & (F.size(b("children_path")) > 0)
    join = lambda c: F.array_join(c, " > ")
    rows.append((path, F.lit("changed"), F.when(wraps, "dom_structure").otherwise("composition"), join(a("children_path")), join(b("children_path")), wraps, "children_path"))
    outs = [pairs.where(when).select(*_long(change, category, x, y, tests, None, F.lit(key))) for when, change, category, x, y, tests, key in rows]
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def binding_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """CSS tokens that a prop gained or lost control of: rows of facet ``prop_style`` (key prop, value token).

    A lost one counts while the prop lives on (facet ``prop``) and the token
    is gone or bound to it no more; a gained one where the prop isn't new.
    """
    of = lambda d, f, *more: d.where(F.col("facet") == f).select("component", "key", *more).distinct()
    a, b = of(old, "prop_style", "value"), of(new, "prop_style", "value")
    used = new.where("facet = 'css_token'").select("component", F.col("key").alias("value"), F.lit(True).alias("used")).distinct()
    bound = b.withColumn("bound", F.lit(True))
    lost = a.join(of(new, "prop"), ["component", "key"], "left_semi").join(used, ["component", "value"], "left").join(bound, ["component", "key", "value"], "left")
    lost = lost.where("used is null or bound is null").select(*_long(F.lit("removed"), "css_token", F.concat("key", F.lit(" > "), "value"), None, True, None, F.col("key")))
    got = b.join(of(old, "prop"), ["component", "key"], "left_semi").join(a, ["component", "key", "value"], "left_anti")
    return lost.unionByName(got.select(*_long(F.lit("added"), "css_token", None, F.concat("key", F.lit(" > "), "value"), True, None, F.col("key"))))


def managed_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes that a prop overrides through a helper: ``component``, ``prop``, ``helper``, ``overrides``, ``attributes``.

    A binding that overrides counts if it is new or used to yield to the
    consumer; one that overrode and is gone counts too.
    """
    on = ["component", "prop", "helper"]
    yields = old.where("not overrides").select(*on, F.lit(True).alias("yielded")).distinct()
    known = old.select(*on, F.lit(True).alias("known")).distinct()
    now = new.where("overrides").join(known, on, "left").join(yields, on, "left").where("known is null or yielded")
    text = F.array_join("attributes", ", ")
    change = F.when(F.col("yielded"), "changed").otherwise("added")
    came = now.select(*_long(change, "prop_attribute_override", F.when(F.col("yielded"), text), text, True, F.col("helper"), F.col("prop")))
    gone = old.where("overrides").join(new.select(*on).distinct(), on, "left_anti")
    return came.unionByName(gone.select(*_long(F.lit("removed"), "prop_attribute_override", text, None, False, F.col("helper"), F.col("prop"))))


def deprecation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Props (facet ``deprecated``, value the advice) that existed before and are deprecated only now."""
    on = ["component", "key"]
    of = lambda d, f: d.where(F.col("facet") == f).select(*on).distinct()
    now = new.where("facet = 'deprecated'").select(*on, "value").join(of(old, "prop"), on, "left_semi").join(of(old, "deprecated"), on, "left_anti")
    return now.select(*_long(F.lit("deprecated"), "prop_deprecated", F.col("key"), F.col("value"), False, None, F.col("key")))


def component_changes(old: DataFrame, new: DataFrame, old_flags: DataFrame, new_flags: DataFrame) -> DataFrame:
    """All facets of components that have a profile (a row of flags) on both sides."""
    both = old_flags.select("component").join(new_flags.select("component"), "component", "left_semi").distinct()
    # Each side is used by all parts and made once.
    a, b = (cut(d.join(both, "component", "left_semi")) for d in (old, new))
    out = flag_changes(old_flags, new_flags)
    for part in (facet_changes(a, b), binding_changes(a, b), deprecation_changes(a, b)):
        out = out.unionByName(part)
    return out


def jsx_facets(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """What a body renders: rows ``facet`` (tag, aria, role, data, class), ``element``, ``key``, ``value``.

    Tags and attributes are found by pattern; of an attribute's values on one
    element name the last counts, one in braces is empty.
    """
    tags = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"<([A-Za-z][A-Za-z0-9.]*(?:\s[^<>]*)?)"), F.lit(1)),
        lambda t: F.struct(F.regexp_extract(t, "^[A-Za-z0-9.]+", 0).alias("element"), t.alias("rest")),
    )
    each = bodies.select(key, F.posexplode(tags).alias("n", "t")).select(key, "n", "t.element", "t.rest")
    none = F.lit(None).cast("string")
    tag = each.groupBy(key, "element").agg(F.count("*").cast("string").alias("value")).select(key, F.lit("tag").alias("facet"), "element", F.lit("").alias("key"), "value")
    pairs = F.arrays_zip(
        F.regexp_extract_all("rest", F.lit(r'\s(aria-[a-z]+|role|data-[a-z-]+)=(?:"[^"]*"|\{)'), F.lit(1)).alias("k"),
        F.regexp_extract_all("rest", F.lit(r'\s(?:aria-[a-z]+|role|data-[a-z-]+)=(?:"([^"]*)"|\{)'), F.lit(1)).alias("v"),
    )
    attr = each.select(key, "n", "element", F.explode(pairs).alias("p")).groupBy(key, "element", F.col("p.k").alias("key")).agg(F.max_by("p.v", "n").alias("value"))
    facet = F.when(F.col("key") == "role", "role").when(F.col("key").startswith("aria-"), "aria").otherwise("data")
    attr = attr.select(key, facet.alias("facet"), "element", F.when(F.col("key") == "role", "").otherwise(F.col("key")).alias("key"), "value")
    classes = F.explode(F.split(F.regexp_extract("rest", r'\sclass(?:Name)?="([^"]*)"', 1), r"\s+"))
    css = each.select(key, classes.alias("key")).where("key <> ''").distinct().select(key, F.lit("class").alias("facet"), F.lit("").alias("element"), "key", none.alias("value"))
    return tag.unionByName(attr).unionByName(css)


def jsx_changes(bodies: DataFrame, key: str = "symbol") -> DataFrame:
    """Changes between what ``old_body`` and ``new_body`` render, for bodies that both render something.

    Tags come, go or, for HTML elements, change in number. ARIA attributes
    come, go and change; of roles and data attributes new ones don't count;
    empty values tell no change. Classes come and go.
    """
    both = bodies.where(F.col("old_body").rlike("<[A-Za-z]") & F.col("new_body").rlike("<[A-Za-z]"))
    on = [key, "facet", "element", "key"]
    side = lambda c, n: jsx_facets(both, key, c).select(*on, F.struct("value").alias(n))
    d = side("old_body", "a").join(side("new_body", "b"), on, "full_outer").withColumns({"before": F.col("a.value"), "after": F.col("b.value")})
    came, gone = F.col("a").isNull(), F.col("b").isNull()
    moved = F.col("before") != F.col("after")
    full = (F.col("before") != "") & (F.col("after") != "")
    change = (
        F.when(came, F.when(~F.col("facet").isin("role", "data"), "added"))
        .when(gone, "removed")
        .when((F.col("facet") == "tag") & moved & F.col("element").rlike("^[a-z]"), "count")
        .when(F.col("facet").isin("aria", "data") & moved & full, "changed")
        .when((F.col("facet") == "role") & moved, "changed")
    )
    category = F.when(F.col("facet") == "tag", "dom_structure").when(F.col("facet").isin("aria", "role"), "accessibility").when(F.col("facet") == "class", "css_class").otherwise("data_attribute")
    return d.withColumn("change", change).where("change is not null").select(key, category.alias("category"), "change", "element", "key", "before", "after")


def react_api(sources: DataFrame, key: str, source: str) -> DataFrame:
    """Text scan of a component's source: portals, refs, memo, consumed and provided contexts."""
    s = F.coalesce(F.col(source), F.lit(""))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(p), F.lit(1))))
    return sources.select(
        key,
        s.rlike(r"createPortal ?\(").alias("uses_portal"),
        s.rlike(r"forwardRef[(<]").alias("is_forward_ref"),
        s.rlike(r"(?<![A-Za-z0-9_])memo\(").alias("is_memo"),
        found(r"useContext\(\s*([A-Za-z0-9_.]+)").alias("consumed"),
        found(r"<([A-Za-z0-9_]+)\.Provider").alias("provided"),
    )


def _row(category, breaks, before=None, after=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c if isinstance(c, Column) else F.lit(c)).cast("string")
    breaks = breaks if isinstance(breaks, Column) else F.lit(breaks)
    return F.struct((category if isinstance(category, Column) else F.lit(category)).alias("category"), text(before).alias("before"), text(after).alias("after"), breaks.alias("is_breaking"))


def _rows(pairs: DataFrame, keys: list, cases: list[tuple[Column, Column]]) -> DataFrame:
    return pairs.select(*keys, F.inline(F.filter(F.array(*[F.when(w, r) for w, r in cases]), lambda r: r.isNotNull())))


def java_class_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Classes on both sides by ``qualified_name``: final, sealed, permits, superclass, interfaces, constructor."""
    pairs = old.alias("a").join(new.alias("b"), "qualified_name")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    text = lambda c: F.array_join(c, ", ")
    less = F.size(F.array_except(a("permits"), b("permits"))) > 0
    return _rows(pairs, ["qualified_name"], [
        (~a("is_final") & b("is_final"), _row("final_added", True, None, "final")),
        (a("is_final") & ~b("is_final"), _row("final_removed", False, "final", None)),
        ((a("is_sealed") != b("is_sealed")) | (a("permits") != b("permits")), _row("sealed_changed", b("is_sealed") & (~a("is_sealed") | less), F.when(a("is_sealed"), text(a("permits"))), F.when(b("is_sealed"), text(b("permits"))))),
        (~a("extends").eqNullSafe(b("extends")), _row("inheritance_changed", True, a("extends"), b("extends"))),
        (F.size(F.array_except(a("implements"), b("implements"))) > 0, _row("inheritance_changed", True, text(a("implements")), text(b("implements")))),
        ((a("constructor_params") != b("constructor_params")) & (F.size(a("constructor_params")) > 0), _row("constructor_changed", True, text(a("constructor_params")), text(b("constructor_params")))),
    ])


def java_method_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Methods on both sides by ``class_name`` and ``method``: synchronized, native, override, exceptions, delegations."""
    keys = ["class_name", "method"]
    pairs = old.alias("a").join(new.alias("b"), keys)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    text = lambda c: F.array_join(c, ", ")
    lost, got = (lambda f: a(f) & ~b(f)), (lambda f: ~a(f) & b(f))
    moved = F.size(F.array_except(a("delegations"), b("delegations"))) + F.size(F.array_except(b("delegations"), a("delegations")))
    out = _rows(pairs, keys, [
        (lost("is_synchronized"), _row("synchronization_removed", True, "synchronized")),
        (got("is_synchronized"), _row("synchronization_added", False, None, "synchronized")),
        (lost("is_native"), _row("native_removed", True, "native")),
        (lost("is_override"), _row("override_removed", True, "@Override")),
        (got("is_override"), _row("override_added", False, None, "@Override")),
        ((F.size(a("delegations")) > 0) & (moved > 0), _row("delegation_changed", True, text(a("delegations")), text(b("delegations")))),
    ])
    none = F.lit(None).cast("string")
    more = pairs.select(*keys, F.explode(F.array_except(b("exceptions"), a("exceptions"))).alias("x"))
    less = pairs.select(*keys, F.explode(F.array_except(a("exceptions"), b("exceptions"))).alias("x"))
    out = out.unionByName(more.select(*keys, F.lit("exception_added").alias("category"), none.alias("before"), F.col("x").alias("after"), F.lit(True).alias("is_breaking")))
    return out.unionByName(less.select(*keys, F.lit("exception_removed").alias("category"), F.col("x").alias("before"), none.alias("after"), F.lit(False).alias("is_breaking")))


def annotation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations of a ``target`` by ``name``, with ``attributes`` as text: removed and changed ones break."""
    on = ["target", "name"]
    both = old.select(*on, F.struct("attributes").alias("a")).join(new.select(*on, F.struct("attributes").alias("b")), on, "full_outer")
    came, gone = F.col("a").isNull(), F.col("b").isNull()
    change = F.when(came, "annotation_added").when(gone, "annotation_removed").when(~F.col("a.attributes").eqNullSafe(F.col("b.attributes")), "annotation_changed")
    out = both.withColumn("category", change).where("category is not null")
    return out.select(*on, "category", F.col("a.attributes").alias("before"), F.col("b.attributes").alias("after"), (F.col("category") != "annotation_added").alias("is_breaking"))


def serialization_changes(old: DataFrame, new: DataFrame, serializable: DataFrame) -> DataFrame:
    """Fields of ``serializable`` classes (``class_name``): every change of what is stored breaks.

    Fields have ``field``, ``type``, ``is_static`` and ``is_transient``; static
    ones aren't stored, transient ones only tell that they came to be so.
    """
    on = ["class_name", "field"]
    side = lambda d, n: d.where("not is_static").join(serializable, "class_name", "left_semi").select(*on, F.struct("type", "is_transient").alias(n))
    both = side(old, "a").join(side(new, "b"), on, "full_outer")
    kept = lambda n: F.col(n).isNotNull() & ~F.coalesce(F.col(f"{n}.is_transient"), F.lit(True))
    word = lambda n: F.when(F.col(f"{n}.is_transient"), "transient").otherwise("non-transient")
    return _rows(both, on, [
        (kept("a") & ~kept("b"), _row("serialization_field_removed", True, F.col("field"))),
        (kept("b") & ~kept("a"), _row("serialization_field_added", True, None, F.col("field"))),
        (kept("a") & kept("b") & (F.col("a.type") != F.col("b.type")), _row("serialization_field_type_changed", True, F.col("a.type"), F.col("b.type"))),
        (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.is_transient") != F.col("b.is_transient")), _row("transient_changed", True, word("a"), word("b"))),
    ])


def module_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directives of module descriptors (``module``, ``directive``): a lost export breaks."""
    on = ["module", "directive"]
    lost = old.select(*on).distinct().join(new.select(*on), on, "left_anti").withColumn("gone", F.lit(True))
    got = new.select(*on).distinct().join(old.select(*on), on, "left_anti").withColumn("gone", F.lit(False))
    exports = F.col("directive").startswith("exports ")
    category = F.when(~exports, "module_requires_changed").when(F.col("gone"), "module_export_removed").otherwise("module_export_added")
    return lost.unionByName(got).select(*on, category.alias("category"), (exports & F.col("gone")).alias("is_breaking"))


def inheritance(classes: DataFrame) -> DataFrame:
    """Per class its superclass and its direct subclasses in order."""
    below = classes.where("extends is not null").groupBy(F.col("extends").alias("qualified_name")).agg(F.array_sort(F.collect_set("qualified_name")).alias("subclasses"))
    return classes.select("qualified_name", "extends").join(below, "qualified_name", "left").withColumn("subclasses", F.coalesce("subclasses", F.array().cast("array<string>")))


def spec_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaks between specifications of functions: rows ``name``, ``part``, ``subject``, ``term``, ``extra``.

    Parts: ``pre`` (parameter, condition, what a violation does), ``post``
    (condition, what it returns), ``error`` (trigger, error), ``effect``
    (target, action). Text is compared in lower case with single blanks; of
    several rows with one subject the first by term counts, but for effects.
    A precondition that is new or changed breaks, as do a lost or changed
    guarantee, a new or other error, and a lost or other effect.
    """
    norm = lambda d, n: d.select("name", "part", T.squeeze("subject").alias("s"), F.struct("subject", "term", "extra", T.squeeze("term").alias("t"), T.squeeze(F.coalesce("extra", F.lit(""))).alias("e")).alias(n))
    a, b = norm(old, "a"), norm(new, "b")
    one = lambda d, n: d.where("part <> 'effect'").groupBy("name", "part", "s").agg(F.min_by(n, f"{n}.term").alias(n))
    both = one(a, "a").join(one(b, "b"), ["name", "part", "s"], "full_outer")
    came, gone = F.col("a").isNull(), F.col("b").isNull()
    part = lambda p: F.col("part") == p
    case = lambda why, x=None, y=None: F.struct(F.lit(why).alias("reason"), (F.lit(None).cast("string") if x is None else F.col(x)).alias("before"), (F.lit(None).cast("string") if y is None else F.col(y)).alias("after"))
    differ = lambda f: ~came & ~gone & (F.col(f"a.{f}") != F.col(f"b.{f}"))
    cases = [
        (part("pre") & came, case("precondition_added", None, "b.term")),
        (part("pre") & differ("t"), case("precondition_changed", "a.term", "b.term")),
        (part("pre") & differ("e"), case("violation_changed", "a.extra", "b.extra")),
        (part("post") & gone, case("postcondition_removed", "a.term", None)),
        (part("post") & differ("t"), case("return_changed", "a.term", "b.term")),
        (part("error") & differ("t"), case("error_changed", "a.term", "b.term")),
        (part("error") & came, case("error_added", None, "b.term")),
    ]
    subject = F.coalesce("b.subject", "a.subject").alias("subject")
    out = both.select("name", subject, F.inline(F.filter(F.array(*[F.when(w, c) for w, c in cases]), lambda r: r.isNotNull())))
    x, y = a.where("part = 'effect'").select("name", "s", "a").distinct(), b.where("part = 'effect'").select("name", "s", "b").distinct()
    same = x.join(y.select("name", "s", F.col("b.t").alias("t2")), (x["name"] == y["name"]) & (x["s"] == y["s"]) & (F.col("a.t") == F.col("t2")), "left_anti")
    lost = same.select("name", F.col("a.subject").alias("subject"), F.lit("effect_removed").alias("reason"), F.col("a.term").alias("before"), F.lit(None).cast("string").alias("after"))
    other = x.join(y, ["name", "s"]).where("a.t <> b.t").select("name", F.col("a.subject").alias("subject"), F.lit("effect_changed").alias("reason"), F.col("a.term").alias("before"), F.col("b.term").alias("after"))
    return out.unionByName(lost).unionByName(other)


def pom_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Project descriptors by ``project``: rows ``project``, ``section``, ``key``, ``value``, ``scope``.

    Sections: ``identity`` (groupId, artifactId, version), ``parent``
    (artifact, version), ``dependency``, ``property``. Another group or
    artifact breaks, so do a lost dependency, one that leaves the compile
    scope, and another parent; versions and properties don't.
    """
    on = ["project", "section", "key"]
    side = lambda d, n: d.select(*on, F.struct("value", "scope").alias(n))
    both = side(old, "a").join(side(new, "b"), on, "full_outer")
    came, gone = F.col("a").isNull(), F.col("b").isNull()
    x, y = F.col("a.value"), F.col("b.value")
    section = lambda s: F.col("section") == s
    scope = lambda n: F.coalesce(F.col(f"{n}.scope"), F.lit("compile"))
    dep, differ = section("dependency"), ~x.eqNullSafe(y)
    return _rows(both, on, [
        (section("identity") & differ, _row("project_identity_changed", F.col("key") != "version", x, y)),
        (section("parent") & (F.col("key") == "version") & differ, _row("parent_version_changed", False, x, y)),
        (section("parent") & (F.col("key") == "artifact") & (x != y), _row("parent_changed", True, x, y)),
        (dep & gone, _row("dependency_removed", True, x, None)),
        (dep & came, _row("dependency_added", False, None, y)),
        (dep & ~came & ~gone & differ, _row("dependency_version_changed", False, x, y)),
        (dep & ~came & ~gone & ~F.col("a.scope").eqNullSafe(F.col("b.scope")), _row("dependency_scope_changed", (scope("a") == "compile") & (scope("b") != "compile"), F.col("a.scope"), F.col("b.scope"))),
        (section("property") & differ, _row("property_changed", False, x, y)),
    ])
