"""What names, types, paths and changes mean, per language: Column expressions that the operators take as hooks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PRIMITIVES, _col, union_values

#: Ranks by which a visibility is narrower than another.
TS_RANK = {"private": 0, "internal": 1, "protected": 1, "public": 2, "exported": 3}
KINDS = {
    "function": "function", "method": "method", "class": "class", "interface": "interface", "type_alias": "type_alias", "constant": "constant",
    "variable": "constant", "enum": "type_alias", "property": "property", "namespace": "module_export", "struct": "class",
    "enum_member": "property", "constructor": "method", "get_accessor": "property", "set_accessor": "property",
}
LABELS = {k: k.replace("_", " ") for k in KINDS} | {"get_accessor": "getter", "set_accessor": "setter"}
EFFORT = {"removed": 5, "signature_changed": 3, "type_changed": 3, "visibility_changed": 3, "renamed": 1}
REMOVAL_BREAKS = (
    "Bean", "Component", "Service", "Repository", "Controller", "RestController", "Configuration", "ConfigurationProperties", "Autowired",
    "ConditionalOnClass", "ConditionalOnMissingBean", "ConditionalOnProperty",
)
CHANGE_BREAKS = (
    "ConfigurationProperties", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping",
    "ConditionalOnProperty", "ConditionalOnClass",
)


def lookup(table: dict, key) -> Column:
    """The value of ``key`` in a literal table; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _col(key))


def is_skipped(name) -> Column:
    """Star exports carry no symbol of their own."""
    return _col(name) == "*"


def is_container(kind) -> Column:
    return _col(kind).isin("interface", "class", "enum")


def java_canonical(name) -> Column:
    return F.substring_index(_col(name), ".", -1)


def relocation_class(old, new) -> Column:
    """How a symbol moved between the plain, the deprecated and the next tree; null for other moves."""
    has = lambda c, d: F.contains(_col(c), F.lit(f"/{d}/"))
    return (
        F.when(~has(old, "deprecated") & has(new, "deprecated"), "moved to deprecated")
        .when(has(old, "deprecated") & ~has(new, "deprecated"), "promoted from deprecated")
        .when(has(old, "next") & ~has(new, "next"), "promoted from next")
        .when(~has(old, "next") & has(new, "next"), "moved to next")
    )


def component_dir(path) -> Column:
    """Directory of a file outside the deprecated and next trees; a bare file name stands for itself."""
    out = F.replace(F.replace(_col(path), F.lit("/deprecated/"), F.lit("/")), F.lit("/next/"), F.lit("/"))
    out = F.regexp_replace(F.regexp_replace(out, "^deprecated/", ""), "^next/", "")
    return F.regexp_replace(out, "(?s)/[^/]*$", "")


def identity_name(name) -> Column:
    return F.regexp_replace(_col(name), "Props$", "")


def import_subpath(package, name) -> Column:
    base, n = F.coalesce(_col(package), F.lit("unknown")), _col(name)
    tree = F.when(F.contains(n, F.lit("/deprecated/")), "/deprecated").when(F.contains(n, F.lit("/next/")), "/next").otherwise("")
    return F.concat(base, tree)


def ts_rank(visibility) -> Column:
    return lookup(TS_RANK, visibility)


def ts_addition_breaks(container_kind, optional) -> Column:
    """A new member breaks those who implement its container, unless it is optional."""
    return _col(container_kind).isin("interface", "type_alias") & ~F.coalesce(_col(optional), F.lit(False))


def java_addition_breaks(container_kind, container_abstract, member_kind, member_abstract, member_default) -> Column:
    method = _col(member_kind) == "method"
    return ((_col(container_kind) == "interface") & ~_col(member_default) & method) | (
        (_col(container_kind) == "class") & _col(container_abstract) & _col(member_abstract) & method
    )


def type_category(t) -> Column:
    t = F.trim(_col(t))
    return (
        F.when(t.endswith("[]") | t.startswith("Array<"), "array")
        .when(t.startswith("{"), "object")
        .when(F.contains(t, F.lit("=>")), "function")
        .when(t.startswith("["), "tuple")
        .when(F.lower(t).isin(*PRIMITIVES), "primitive")
        .otherwise("reference")
    )


def types_similar(old, new) -> Column:
    """Of one category; an absent type goes with any."""
    return F.when(_col(old).isNull() | _col(new).isNull(), True).otherwise(type_category(old) == type_category(new))


def types_compatible(old, new) -> Column:
    """For a report's wording: two objects, two literal unions or the same text."""
    old, new = _col(old), _col(new)
    union = lambda t: F.contains(t, F.lit("|")) & F.contains(t, F.lit("'"))
    return (old.startswith("{") & new.startswith("{")) | (union(old) & union(new)) | (old == new)


def union_literals(t) -> Column:
    """Sorted quoted members of a union type; null unless there are two."""
    parts = F.transform(F.split(_col(t), r"\|"), lambda p: F.trim(p))
    quoted = lambda p: (p.startswith("'") & p.endswith("'") | p.startswith('"') & p.endswith('"')) & (F.length(p) > 2)
    found = F.array_sort(F.array_distinct(F.transform(F.filter(parts, quoted), lambda p: F.substring(p, F.lit(2), F.length(p) - 2))))
    return F.when(F.size(found) >= 2, found)


def annotation_removal_breaks(name) -> Column:
    return _col(name).isin(*REMOVAL_BREAKS)


def annotation_change_breaks(name) -> Column:
    return _col(name).isin(*CHANGE_BREAKS)


def is_test_file(path) -> Column:
    return _col(path).rlike(r"\.(test|spec)\.|__tests?__/")


def is_source_file(path) -> Column:
    """A script or module that consumers run: no declaration, build output, test, story, mock or tool configuration."""
    p = _col(path)
    skip = r"\.(stories|story|config|conf)\.|__(mocks|fixtures)__/|\.eslintrc|(jest|vitest|webpack|rollup|vite)\.config|tsconfig|package\.json"
    return p.rlike(r"\.(tsx?|jsx?|mts|mjs)$") & ~p.rlike(r"\.d\.m?ts$|/dist/|^dist/") & ~is_test_file(p) & ~p.rlike(skip)


def is_excluded(path) -> Column:
    """Left out of behavioural analysis: barrels, declarations, tests, build output."""
    return _col(path).rlike(r"(^|/)index\.(tsx?|js)$|\.d\.ts$|\.(test|spec)\.[^/]*$|__tests__|/dist/|^dist/")


def is_child_candidate(name, parent) -> Column:
    """A capitalised name, not the parent's own and no property bag."""
    n = _col(name)
    return n.rlike("^[A-Z].*[a-z]") & (n != _col(parent)) & ~n.endswith("Props")


def is_slot_type(t) -> Column:
    return _col(t).rlike("ReactNode|Element")


def is_render_prop(t) -> Column:
    return F.contains(_col(t), F.lit("=>")) & F.lower(_col(t)).rlike(r"reactnode|reactelement|jsx\.element")


def is_concrete(value) -> Column:
    return ~_col(value).startswith("{") & ~_col(value).isin("true", "false")


def is_hierarchy_candidate(kind, name) -> Column:
    return _col(kind).isin("variable", "class", "function", "constant") & _col(name).rlike(r"^\p{Lu}")


def symbol_summary(kind, name, return_type) -> Column:
    of = F.when(_col(return_type).isNotNull(), F.concat(F.lit(": "), _col(return_type))).otherwise("")
    return F.concat(lookup(LABELS, kind), F.lit(": "), _col(name), of)


def param_summary(p) -> Column:
    """``...name?: type = default`` of a struct with name, type_annotation, optional, default_value, is_variadic."""
    p = _col(p)
    text = lambda before, f: F.when(p[f].isNotNull(), F.concat(F.lit(before), p[f])).otherwise("")
    return F.concat(
        F.when(p["is_variadic"], "...").otherwise(""), p["name"], F.when(p["optional"], "?").otherwise(""), text(": ", "type_annotation"), text(" = ", "default_value")
    )


def display_symbol(qualified_name, name) -> Column:
    """What a report calls a symbol: the part after the file, a property bag under its component's name."""
    parts = F.split(F.substring_index(_col(qualified_name), "/", -1), r"\.")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    head = F.regexp_replace(rest[0], "(?s)^(.+)Props$", "$1")
    joined = F.array_join(F.concat(F.array(head), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))), ".")
    return F.when(F.size(rest) == 0, _col(name)).when(F.size(rest) == 1, rest[0]).otherwise(joined)


def api_kind(kind) -> Column:
    return lookup(KINDS, kind)


def api_verb(change, subject) -> Column:
    """One of five verbs for a structural change (added, removed, renamed, relocated, changed) and what it changed."""
    change, subject = _col(change), _col(subject)
    return (
        F.when(change == "removed", "removed")
        .when(change.isin("renamed", "relocated"), "renamed")
        .when((change == "changed") & (subject == "visibility"), "visibility_changed")
        .when((change == "changed") & subject.isin("return_type", "parameter", "union_value"), "type_changed")
        .otherwise("signature_changed")
    )


def effort(verb) -> Column:
    return lookup(EFFORT, verb)


def value_key(return_type) -> Column:
    """The quoted value in an object type's ``"value"`` entry, by which tokens can be matched; null without one."""
    return F.nullif(F.regexp_extract(_col(return_type), r'(?s)"value"\]?[^:]*:[^"]*"([^"]*)"', 1), F.lit(""))


def is_additive(verb, before, after, description) -> Column:
    """A change that takes nothing away: union values only added, a part added, readonly, a first base class."""
    old, new = union_values(before), union_values(after)
    grown = (F.size(old) >= 2) & (F.size(F.array_except(old, new)) == 0) & (F.size(F.array_except(new, old)) > 0)
    told = F.lower(_col(description)).rlike("was added|was made readonly|base class changed from none to")
    return F.when(_col(verb) == "type_changed", F.coalesce(grown, F.lit(False))).when(_col(verb) == "signature_changed", told).otherwise(False)


def incompatible_base(old, new) -> Column:
    """Both extend something, and not the same: another base or other type arguments."""
    return F.coalesce(_col(old) != _col(new), F.lit(False))


def packages_related(old, new) -> Column:
    """Whether a class of one package may have moved to another: three leading parts, or two and the next part somewhere."""
    parts = lambda c: F.split(F.regexp_replace(_col(c), r"(?s)\.[^.]*$", ""), r"\.")
    a, b = parts(old), parts(new)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    lead = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, F.size(same).cast("long")).cast("int")
    later = F.array_contains(F.slice(b, lead + 1, F.greatest(F.size(b), F.lit(1))), F.get(a, lead))
    return (lead >= 3) | ((lead >= 2) & F.coalesce(later, F.lit(False)))


def is_import_path(s) -> Column:
    s = _col(s)
    return ~F.contains(s, F.lit(": ")) & (s != "") & (s.startswith("@") | F.contains(s, F.lit("/")) | s.rlike(r"^[a-z0-9._-]+$"))


def is_quoted_value(s) -> Column:
    """A single quoted literal, no union."""
    return F.trim(_col(s)).rlike(r"""(?s)^('[^|]*'|"[^|]*")$""")


def fix_strategy(verb, kind, symbol, before, after, description, file, target, disposition) -> Column:
    """The repair of a change as a struct (strategy, from, to); the first case that fits decides.

    ``target``: the symbol that a removed container's members went to;
    ``disposition``: the member that replaces a removed one. Both may be null.
    """
    verb, kind, symbol, before, after = map(_col, (verb, kind, symbol, before, after))
    target, disposition = _col(target), _col(disposition)
    none = F.lit(None).cast("string")
    made = lambda name, a=none, b=none: F.struct(F.lit(name).alias("strategy"), a.alias("from"), b.alias("to"))
    leaf, prop = (lambda c: F.substring_index(c, ".", -1)), F.substring_index(symbol, ".", -1)
    inner = F.regexp_replace(F.trim(before), "(?s)^.|.$", "")
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    value = lambda c: F.nullif(F.regexp_extract(c, r"(?s)^[^=]+\.[^.= ]+ = (.+)$", 1), F.lit(""))
    local = lambda c: F.contains(c, F.lit("packages/"))
    renamed = (
        F.when(value(b).isNotNull() & value(a).isNotNull(), made("Rename", value(b), value(a)))
        .when((a != b) & ~local(a) & ~local(b) & is_import_path(b) & is_import_path(a), made("ImportPathChange", before, after))
        .when(kind == "constant", made("Rename", symbol, F.regexp_replace(F.regexp_replace(a, "(?s)^.*?: ", ""), "(?s): .*$", "")))
        .when(F.contains(a, F.lit("/deprecated/")) & ~F.contains(b, F.lit("/deprecated/")), made("ImportPathChange", before, after))
        .otherwise(made("Rename", leaf(b), leaf(a)))
    )
    prefixes = F.array_distinct(F.regexp_extract_all(_col(description), F.lit("(--[a-zA-Z]+-v[0-9]+-)"), F.lit(1)))
    swapped = (F.size(prefixes) >= 2) & (F.regexp_replace(F.get(prefixes, 0), "[0-9].*$", "") == F.regexp_replace(F.get(prefixes, 1), "[0-9].*$", ""))
    changed = (
        F.when(disposition.isNotNull(), made("LlmAssisted", none, disposition))
        .when(is_quoted_value(before), made("PropValueChange", inner))
        .when(swapped, made("CssVariablePrefix", F.get(prefixes, 0), F.get(prefixes, 1)))
        .when(F.contains(_col(description), F.lit("was deprecated and replaced by")), made("LlmAssisted", before, after))
        .otherwise(made("PropTypeChange", before, after))
    )
    removed = (
        F.when(target.isNotNull(), made("StructuralMigration", symbol, target))
        .when(kind.isin("property", "field") & disposition.isNotNull(), made("Rename", F.when(is_quoted_value(before), inner).otherwise(prop), disposition))
        .when(kind.isin("property", "field") & is_quoted_value(before), made("PropValueChange", inner))
        .when(kind.isin("property", "field"), made("RemoveProp", prop))
        .when(F.contains(_col(file), F.lit("/deprecated/")), made("LlmAssisted", symbol))
        .otherwise(made("Manual"))
    )
    return F.when(verb == "renamed", renamed).when(verb.isin("type_changed", "signature_changed"), changed).when(verb == "removed", removed).otherwise(made("Manual"))
