"""Queries of lookups, signatures, names and report parts, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, lookup, report
from .queries import query


@query("imports", "import_targets", oracle=" SELECT DISTINCT i.file, i.symbol, i.module FROM imports i JOIN import_targets t ON t.symbol = i.symbol AND t.module = i.module")
def importer_lookup(imports, targets):
    return lookup.importers(imports, targets).select("file", "symbol", "module")


@query("file_calls", "wanted_calls", oracle=" SELECT DISTINCT file, caller, callee FROM file_calls c WHERE caller <> callee AND EXISTS (FROM wanted_calls w WHERE w.file = c.file AND w.callee = c.callee)")
def caller_lookup(calls, wanted):
    return lookup.callers(calls, wanted).select("file", "caller", "callee")


@query("source_files", "all_files", oracle=r""", s AS (SELECT file AS source, regexp_replace(file, '/[^/]*$', '') AS dir, regexp_extract(file, '/([^/.]+)[.]tsx$', 1) AS stem FROM source_files),
    t AS (SELECT file AS test, regexp_replace(file, '/[^/]*$', '') AS dir, regexp_extract(file, '/([^/.]+)[.](test|spec)[.]', 1) AS stem FROM all_files),
    p AS (SELECT source, test, CASE WHEN t.dir = s.dir THEN 1 WHEN t.dir = s.dir || '/__tests__' THEN 2 WHEN regexp_replace(t.dir, '/[^/]*$', '') = regexp_replace(s.dir, '/[^/]*$', '') THEN 3 END AS priority FROM s JOIN t USING (stem)) SELECT * FROM p WHERE priority IS NOT NULL""")
def test_discovery(sources, files):
    return lookup.test_files(sources, files)


@query("commit_removed", "commit_added", oracle=" SELECT r.component AS old, min(a.component) AS new FROM commit_removed r JOIN commit_added a ON a.commit = r.commit GROUP BY r.component HAVING count(DISTINCT a.component) = 1")
def cochange_replacement(removed, added):
    return lookup.cochange_replacements(removed, added)


@query("lost_props", "child_props", oracle=" SELECT DISTINCT a.family, a.component AS parent, b.component AS child, a.prop FROM lost_props a JOIN child_props b ON a.family = b.family AND a.prop = b.prop WHERE a.component <> b.component")
def prop_to_child(lost, children):
    return lookup.prop_moves(lost, children)


@query("pack_files", "pack_dirs", oracle=" SELECT f.file, arg_max(d.package, len(d.dir)) AS package FROM pack_files f LEFT JOIN pack_dirs d ON starts_with(f.file, d.dir || '/') GROUP BY f.file")
def package_of_file(files, dirs):
    return lookup.packages_of(files, dirs)


@query("barrel_changes", oracle=" SELECT file, symbol, change FROM barrel_changes c WHERE file <> 'p/index.ts' OR NOT EXISTS (FROM barrel_changes r WHERE r.file <> 'p/index.ts' AND r.symbol = c.symbol AND r.change = c.change)")
def barrel_dedupe(changes):
    return lookup.barrel_dedupe(changes).select("file", "symbol", "change")


@query("moved_changes", "replacements", oracle=" SELECT id, component, prop, CASE WHEN r.new IS NOT NULL AND change = 'relocated' THEN 'changed' ELSE change END AS change, r.new AS replacement FROM moved_changes m LEFT JOIN replacements r ON r.old = m.component WHERE r.new IS NULL OR prop IS NULL")
def replacement_application(changes, replacements):
    return lookup.redirect(changes, replacements).select("id", "component", "prop", "change", "replacement")


@query("helpers", "bindings", oracle=" SELECT component, attribute, generator FROM bindings WHERE generator IN (FROM helpers)")
def helper_propagation(helpers, bindings):
    return lookup.managed_attributes(helpers, bindings).select("component", "attribute", "generator")


@query("own_props", "needs", oracle=", up(child, parent) AS (SELECT node, dep FROM needs UNION SELECT up.child, n.dep FROM up JOIN needs n ON n.node = up.parent) SELECT interface, prop FROM own_props UNION SELECT up.child, p.prop FROM up JOIN own_props p ON p.interface = up.parent")
def extends_resolution(props, needs):
    return lookup.inherited_props(props, needs.select(F.col("node").alias("child"), F.col("dep").alias("parent")))


_AT = """, p AS (SELECT id, i, nullif(string_split(o, ',')[i], '') AS a, nullif(string_split(n, ',')[i], '') AS b FROM (SELECT id, regexp_replace(old_sig, ',?rest:any:v', '') AS o, regexp_replace(new_sig, ',?rest:any:v', '') AS n, unnest([1, 2, 3, 4]) AS i FROM sigs)),
    q AS (SELECT id, string_split(a, ':')[1] AS an, string_split(a, ':')[2] AS at_, a LIKE '%:o' AS ao, string_split(b, ':')[1] AS bn, string_split(b, ':')[2] AS bt, b LIKE '%:o' AS bo, a IS NULL AS came, b IS NULL AS gone FROM p WHERE a IS NOT NULL OR b IS NOT NULL)"""


@query("sigs", oracle=_AT + """ SELECT id, 'parameter_added' AS change, NOT bo AS is_breaking, an AS before, bn AS after FROM q WHERE came UNION ALL SELECT id, 'parameter_removed', true, an, bn FROM q WHERE gone UNION ALL SELECT id, 'parameter_renamed', false, an, bn FROM q WHERE an <> bn
    UNION ALL SELECT id, 'parameter_type', true, at_, bt FROM q WHERE at_ <> bt UNION ALL SELECT id, 'parameter_required', true, an, bn FROM q WHERE ao AND NOT bo UNION ALL SELECT id, 'parameter_optional', false, an, bn FROM q WHERE NOT ao AND bo
    UNION ALL SELECT id, CASE WHEN contains(old_sig, 'rest:') THEN 'variadic_removed' ELSE 'variadic_added' END, contains(old_sig, 'rest:'), CAST(contains(old_sig, 'rest:') AS VARCHAR), CAST(contains(new_sig, 'rest:') AS VARCHAR) FROM sigs WHERE contains(old_sig, 'rest:') <> contains(new_sig, 'rest:')""")
def parameter_diff(sigs):
    part = lambda p, i: F.split_part(p, F.lit(":"), F.lit(i))
    of = lambda c: F.transform(F.filter(F.split(c, ","), lambda p: p != ""), lambda p: F.struct(part(p, 1).alias("name"), part(p, 2).alias("type"), (part(p, 3) == "o").alias("optional"), (part(p, 3) == "v").alias("variadic")))
    return compare.parameter_diff(sigs.select("id", of("old_sig").alias("old_params"), of("new_sig").alias("new_params")), "id")


@query("sigs", oracle=""", t AS (SELECT id, list_filter(string_split(old_sig, ','), lambda x: x <> '') AS o, list_filter(string_split(new_sig, ','), lambda x: x <> '') AS n FROM sigs),
    u AS (SELECT id, list_transform(o, lambda x: string_split(x, ':')[1]) AS onames, list_transform(n, lambda x: string_split(x, ':')[1]) AS nnames, o, n FROM t),
    m AS (SELECT *, list_sort(onames) = list_sort(nnames) AND onames <> nnames AS reordered FROM u), p AS (SELECT id, unnest([1, 2, 3, 4]) AS i, o, n FROM m WHERE NOT reordered),
    q AS (SELECT id, string_split(o[i], ':')[1] AS an, string_split(n[i], ':')[1] AS bn, string_split(o[i], ':')[2] AS ac, string_split(n[i], ':')[2] AS bc, nullif(string_split(o[i], ':')[3], 'r') AS ad, nullif(string_split(n[i], ':')[3], 'r') AS bd, o[i] IS NULL AS came, n[i] IS NULL AS gone FROM p WHERE o[i] IS NOT NULL OR n[i] IS NOT NULL)
    SELECT id, 'type_parameters_reordered' AS change, true AS is_breaking, array_to_string(onames, ',') AS before, array_to_string(nnames, ',') AS after FROM m WHERE reordered
    UNION ALL SELECT id, 'type_parameter_added', bd IS NULL, an, bn FROM q WHERE came UNION ALL SELECT id, 'type_parameter_removed', true, an, bn FROM q WHERE gone
    UNION ALL SELECT id, 'type_parameter_constraint', true, ac, bc FROM q WHERE ac <> bc UNION ALL SELECT id, 'type_parameter_default', ad IS NOT NULL AND bd IS NULL, ad, bd FROM q WHERE NOT came AND NOT gone AND ad IS DISTINCT FROM bd""")
def type_parameter_diff(sigs):
    part = lambda p, i: F.split_part(p, F.lit(":"), F.lit(i))
    of = lambda c: F.transform(F.filter(F.split(c, ","), lambda p: p != ""), lambda p: F.struct(part(p, 1).alias("name"), part(p, 2).alias("constraint"), F.nullif(part(p, 3), F.lit("r")).alias("default")))
    return compare.type_parameter_diff(sigs.select("id", of("old_sig").alias("old_types"), of("new_sig").alias("new_types")), "id")


@query("functions_old", "functions_new", oracle=""", o AS (SELECT file, name, trim(regexp_replace(body, '//.*$', '')) AS before FROM functions_old), n AS (SELECT file, name, trim(body) AS after FROM functions_new)
    SELECT file, name, before, after FROM o FULL JOIN n USING (file, name) WHERE before IS DISTINCT FROM after""")
def function_body_diff(old, new):
    return compare.body_diff(old, new)


@query("symbol_changes", oracle=" SELECT file, string_agg(symbol || ':' || change, ',' ORDER BY symbol, change) AS changes, count(*) AS n, count(*) FILTER (WHERE is_breaking) AS breaking FROM symbol_changes GROUP BY file")
def report_by_file(changes):
    return report.by_file(changes).withColumn("changes", F.array_join(F.transform("changes", lambda c: F.concat(c["symbol"], F.lit(":"), c["change"])), ","))


@query("behaviours", oracle=" SELECT symbol, max(seq) AS seq, arg_max(description, seq) AS description FROM behaviours GROUP BY symbol")
def behavioral_merge(behaviours):
    """A later finding on a symbol replaces an earlier one."""
    return report.latest(behaviours, "symbol", "seq")


@query("conditions", oracle=" SELECT min(rule_id) AS rule_id, condition, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM conditions WHERE NOT has_codemod GROUP BY condition UNION ALL SELECT rule_id, condition, label FROM conditions WHERE has_codemod")
def duplicate_condition_merge(conditions):
    return report.merge_conditions(conditions.withColumn("labels", F.array("label"))).withColumn("labels", F.array_join("labels", ","))


@query("texts", oracle=r""" SELECT id, lower(regexp_replace(regexp_replace(s, '([A-Z])', '-\1', 'g'), CASE WHEN regexp_matches(s, '^[A-Z]') THEN '^-' ELSE '^$' END, '')) AS kebab, lower(regexp_replace(s, '([A-Z])', '-\1', 'g')) AS camel_kebab,
    array_to_string(list_transform(string_split(s, '-'), lambda p: upper(left(p, 1)) || substring(p, 2)), '') AS component, string_split(s, '-')[1] || array_to_string(list_transform(string_split(s, '-')[2:], lambda p: upper(left(p, 1)) || substring(p, 2)), '') AS camel,
    nullif(regexp_extract(s, '_([A-Z][^_]*[a-z][^_]*)$', 1), '') AS suffix, nullif(regexp_extract(s, '^([a-z]+-v[0-9]+)-', 1), '') AS prefix, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS clean_id, lower(regexp_replace(trim(s), '\s+', ' ', 'g')) AS squeezed,
    CASE id % 4 WHEN 0 THEN '_T_ | null' WHEN 1 THEN '''a'' | ''b'' | _T_' WHEN 2 THEN '(_p_: string, _p_: number) => _T_' ELSE 'string' END AS masked, CASE id % 4 WHEN 0 THEN '_T_ | null' WHEN 1 THEN '''_V_'' | _T_' WHEN 2 THEN '(_p_: string, _p_: number) => _T_' ELSE 'string' END AS blanked,
    t = 'string' AS primitive, CASE WHEN id % 4 = 1 THEN 'a,b' ELSE '' END AS literals, CASE WHEN regexp_matches(s, 'Toggle') THEN replace(s, 'Toggle', 'Switch') WHEN s LIKE 'pf-v5-%' THEN replace(s, 'pf-v5-', 'pf-v6-') END AS renamed FROM texts""")
def name_functions(texts):
    """Conversions of names, masks of types and rename patterns."""
    return texts.select(
        "id", T.pascal_to_kebab("s").alias("kebab"), T.camel_to_kebab("s").alias("camel_kebab"), T.block_to_component("s").alias("component"), T.kebab_to_camel("s").alias("camel"), T.trailing_suffix("s").alias("suffix"),
        T.version_prefix("s").alias("prefix"), T.sanitize_id("s").alias("clean_id"), T.squeeze("s").alias("squeezed"), T.mask_types("t").alias("masked"), T.mask_literals("t").alias("blanked"), T.is_primitive_or_absent("t").alias("primitive"),
        F.array_join(T.string_literals("t"), ",").alias("literals"), T.first_rename("s", [("Toggle", "Switch"), ("^pf-v5-", "pf-v6-")]).alias("renamed"),
    )
