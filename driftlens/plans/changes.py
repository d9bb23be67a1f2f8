"""Queries of predicates, profile diffs and rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import facets, graph, profiles, report, rules
from ..operators.tables import cut
from .queries import query

_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_MAP = lambda t, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in t.items()) + " END"
_FULL = lambda old, new, on: f"(SELECT {', '.join(f'coalesce(a.{c}, b.{c}) AS {c}' for c in on)}, CASE WHEN a.{on[0]} IS NOT NULL THEN a END AS a, CASE WHEN b.{on[0]} IS NOT NULL THEN b END AS b FROM {old} a FULL JOIN {new} b ON " + " AND ".join(f"a.{c} = b.{c}" for c in on) + ")"
_SAN = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("named", oracle=f""" SELECT id, name = '*' AS skipped, kind IN ('interface', 'class', 'enum') AS container, {_MAP(S.KINDS, 'kind')} AS api_kind,
    {_MAP(S.TS_RANK, 'visibility')} AS rank, CASE WHEN name LIKE '%Props' THEN left(name, len(name) - 5) ELSE name END AS identity,
    coalesce(package, 'unknown') || CASE WHEN contains(qualified_name, '/deprecated/') THEN '/deprecated' WHEN contains(qualified_name, '/next/') THEN '/next' ELSE '' END AS subpath,
    CASE WHEN NOT contains(qualified_name, '/deprecated/') AND contains(new_name, '/deprecated/') THEN 'moved to deprecated' WHEN contains(qualified_name, '/deprecated/') AND NOT contains(new_name, '/deprecated/') THEN 'promoted from deprecated'
      WHEN contains(qualified_name, '/next/') AND NOT contains(new_name, '/next/') THEN 'promoted from next' WHEN NOT contains(qualified_name, '/next/') AND contains(new_name, '/next/') THEN 'moved to next' END AS moved,
    kind IN ('interface', 'type_alias') AND NOT optional AS ts_breaks,
    kind = 'interface' AND NOT is_default AND visibility = 'public' OR kind = 'class' AND is_abstract AND optional AND visibility = 'public' AS java_breaks,
    kind IN ('variable', 'class', 'function', 'constant') AND regexp_matches(name, '^[A-Z]') AS candidate,
    regexp_matches(name, '^[A-Z].*[a-z]') AND name <> 'Button' AND name NOT LIKE '%Props' AS child,
    {_MAP(S.LABELS, 'kind')} || ': ' || name || coalesce(': ' || return_type, '') AS summary,
    CASE WHEN len(string_split(string_split(qualified_name, '/')[-1], '.')) = 1 THEN name ELSE replace(regexp_replace(string_split(qualified_name, '/')[-1], '^[^.]*[.]', ''), 'ButtonProps.', 'Button.') END AS display
    FROM named""")
def symbol_predicates(named):
    """Which symbols are looked at, how they rank and what a report calls them."""
    method = F.when(F.col("visibility") == "public", "method").otherwise("other")
    return named.select(
        "id", S.is_skipped("name").alias("skipped"), S.is_container("kind").alias("container"), S.api_kind("kind").alias("api_kind"), S.ts_rank("visibility").alias("rank"),
        S.identity_name("name").alias("identity"), S.import_subpath("package", "qualified_name").alias("subpath"), S.relocation_class("qualified_name", "new_name").alias("moved"),
        S.ts_addition_breaks("kind", "optional").alias("ts_breaks"), S.java_addition_breaks("kind", "is_abstract", method, "optional", "is_default").alias("java_breaks"),
        S.is_hierarchy_candidate("kind", "name").alias("candidate"), S.is_child_candidate("name", F.lit("Button")).alias("child"),
        S.symbol_summary("kind", "name", "return_type").alias("summary"), S.display_symbol("qualified_name", "name").alias("display"),
    )


_CAT = "CASE WHEN {0} LIKE '%[]' OR {0} LIKE 'Array<%' THEN 'array' WHEN {0} LIKE '{{%' THEN 'object' WHEN contains({0}, '=>') THEN 'function' WHEN {0} LIKE '[%' THEN 'tuple' WHEN lower({0}) IN ('string', 'number', 'boolean', 'void', 'null', 'undefined', 'never', 'any', 'unknown') THEN 'primitive' ELSE 'reference' END"
_UNI = "contains({0}, '|') AND contains({0}, '''')"


@query("typed", oracle=f""", t AS (SELECT *, trim(old_type) AS o, trim(new_type) AS n,
      list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(new_type, '|'), lambda x: trim(x)), lambda x: regexp_matches(x, '^(''.+''|".+")$')), lambda x: substring(x, 2, len(x) - 2)))) AS lits FROM typed)
    SELECT id, CASE WHEN o IS NOT NULL THEN {_CAT.format('o')} ELSE 'reference' END AS category, CASE WHEN o IS NULL THEN true ELSE {_CAT.format('o')} = {_CAT.format('n')} END AS similar,
      (old_type LIKE '{{%' AND new_type LIKE '{{%') OR ({_UNI.format('old_type')} AND {_UNI.format('new_type')}) OR old_type = new_type AS compatible,
      CASE WHEN len(lits) >= 2 THEN array_to_string(lits, ',') END AS literals, contains(old_type, 'ReactNode') OR contains(old_type, 'Element') AS slot,
      contains(old_type, '=>') AND contains(lower(old_type), 'reactnode') AS render_prop, nullif(regexp_extract(old_type, '"value": "([^"]*)"', 1), '') AS value_key, NOT starts_with(new_type, '{{') AND new_type NOT IN ('true', 'false') AS concrete FROM t""")
def type_predicates(typed):
    """Category, likeness, literals and roles of types as written."""
    return typed.select(
        "id", S.type_category("old_type").alias("category"), S.types_similar("old_type", "new_type").alias("similar"), S.types_compatible("old_type", "new_type").alias("compatible"),
        F.array_join(S.union_literals("new_type"), ",").alias("literals"), S.is_slot_type("old_type").alias("slot"), S.is_render_prop("old_type").alias("render_prop"),
        S.value_key("old_type").alias("value_key"), S.is_concrete("new_type").alias("concrete"),
    )


@query("paths", oracle=r""", p AS (SELECT *, replace(replace(path, '/deprecated/', '/'), '/next/', '/') AS c, string_split(path, '/')[-1] AS base, contains(path, '.test.') OR contains(path, '.spec.') OR contains(path, '__tests__/') AS test FROM paths),
    q AS (SELECT *, CASE WHEN starts_with(c, 'next/') THEN substring(c, 6) ELSE c END AS d FROM p)
    SELECT id, CASE WHEN contains(d, '/') THEN regexp_replace(d, '/[^/]*$', '') ELSE d END AS dir, test AS is_test,
      regexp_matches(path, '[.](ts|tsx|js|jsx|mts|mjs)$') AND NOT path LIKE '%.d.ts' AND NOT contains(path, '/dist/') AND NOT starts_with(path, 'dist/') AND NOT test AND NOT contains(path, '.stories.') AND NOT contains(path, '.config.') AS is_source,
      base IN ('index.ts', 'index.tsx', 'index.js') OR base LIKE '%.d.ts' OR contains(base, '.test.') OR contains(base, '.spec.') OR contains(path, '__tests__') OR contains(path, '/dist/') OR starts_with(path, 'dist/') AS excluded FROM q""")
def path_predicates(paths):
    return paths.select("id", S.component_dir("path").alias("dir"), S.is_test_file("path").alias("is_test"), S.is_source_file("path").alias("is_source"), S.is_excluded("path").alias("excluded"))


@query("java_names", oracle=f""", x AS (SELECT *, string_split(old_name, '.')[:-2] AS a, string_split(new_name, '.')[:-2] AS b FROM java_names),
    y AS (SELECT *, CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] IS DISTINCT FROM b[2] THEN 1 WHEN a[3] IS NULL OR b[3] IS NULL OR a[3] <> b[3] THEN least(2, len(a), len(b)) WHEN a[4] IS NULL OR b[4] IS NULL OR a[4] <> b[4] THEN 3 ELSE 4 END AS k FROM x)
    SELECT id, string_split(old_name, '.')[-1] AS simple, k >= 3 OR (k >= 2 AND coalesce(list_contains(b[k + 1:], a[k + 1]), false)) AS related,
      coalesce(old_extends <> new_extends, false) AS other_base, annotation IN ({_IN(S.REMOVAL_BREAKS)}) AS removal_breaks, annotation IN ({_IN(S.CHANGE_BREAKS)}) AS change_breaks FROM y""")
def java_predicates(names):
    return names.select(
        "id", S.java_canonical("old_name").alias("simple"), S.packages_related("old_name", "new_name").alias("related"), S.incompatible_base("old_extends", "new_extends").alias("other_base"),
        S.annotation_removal_breaks("annotation").alias("removal_breaks"), S.annotation_change_breaks("annotation").alias("change_breaks"),
    )


_QUOTED = """regexp_matches(trim({0}), '^(''[^|]*''|"[^|]*")$')"""
_PATHY = "(NOT contains({0}, ': ') AND {0} <> '' AND (starts_with({0}, '@') OR contains({0}, '/') OR regexp_matches({0}, '^[a-z0-9._-]+$')))"
_INNER = "substring(trim(before), 2, len(trim(before)) - 2)"
_LITS = "list_distinct(regexp_extract_all(coalesce({0}, ''), '''([^'']*)''', 1))"
_ADDITIVE = f"""CASE verb WHEN 'type_changed' THEN len({_LITS.format('before')}) >= 2 AND len(list_filter({_LITS.format('before')}, lambda x: NOT list_contains({_LITS.format('after')}, x))) = 0
      AND len(list_filter({_LITS.format('after')}, lambda x: NOT list_contains({_LITS.format('before')}, x))) > 0
    WHEN 'signature_changed' THEN regexp_matches(lower(description), 'was added|was made readonly|base class changed from none to') ELSE false END"""
_FIX = f""", c AS (SELECT *, coalesce(before, '') AS b, coalesce(after, '') AS a, nullif(regexp_extract(coalesce(before, ''), '^[^=]+[.][^.= ]+ = (.+)$', 1), '') AS vb, nullif(regexp_extract(coalesce(after, ''), '^[^=]+[.][^.= ]+ = (.+)$', 1), '') AS va,
      {_ADDITIVE} AS additive FROM api_changes),
    f AS (SELECT *, CASE verb
      WHEN 'renamed' THEN CASE WHEN vb IS NOT NULL AND va IS NOT NULL THEN ['Rename', vb, va] WHEN a <> b AND NOT contains(a, 'packages/') AND NOT contains(b, 'packages/') AND {_PATHY.format('b')} AND {_PATHY.format('a')} THEN ['ImportPathChange', before, after]
        WHEN kind = 'constant' THEN ['Rename', symbol, regexp_replace(regexp_replace(a, '^.*?: ', ''), ': .*$', '')] WHEN contains(a, '/deprecated/') AND NOT contains(b, '/deprecated/') THEN ['ImportPathChange', before, after]
        ELSE ['Rename', string_split(b, '.')[-1], string_split(a, '.')[-1]] END
      WHEN 'removed' THEN CASE WHEN target IS NOT NULL THEN ['StructuralMigration', symbol, target] WHEN kind = 'property' AND disposition IS NOT NULL THEN ['Rename', CASE WHEN {_QUOTED.format('before')} THEN {_INNER} ELSE string_split(symbol, '.')[-1] END, disposition]
        WHEN kind = 'property' AND {_QUOTED.format('before')} THEN ['PropValueChange', {_INNER}, NULL] WHEN kind = 'property' THEN ['RemoveProp', string_split(symbol, '.')[-1], NULL] WHEN contains(file, '/deprecated/') THEN ['LlmAssisted', symbol, NULL] ELSE ['Manual', NULL, NULL] END
      WHEN 'visibility_changed' THEN ['Manual', NULL, NULL]
      ELSE CASE WHEN disposition IS NOT NULL THEN ['LlmAssisted', NULL, disposition] WHEN {_QUOTED.format('before')} THEN ['PropValueChange', {_INNER}, NULL] WHEN contains(description, '--pf-v5-') THEN ['CssVariablePrefix', '--pf-v5-', '--pf-v6-']
        WHEN contains(description, 'was deprecated and replaced by') THEN ['LlmAssisted', before, after] ELSE ['PropTypeChange', before, after] END END AS fix FROM c)"""


@query("api_changes", oracle=f"{_FIX} SELECT id, additive, {_MAP(S.EFFORT, 'verb')} AS effort, fix[1] AS strategy, fix[2] AS source, fix[3] AS goal FROM f")
def change_strategies(changes):
    """Effort and repair of each API change."""
    fix = S.fix_strategy("verb", "kind", "symbol", "before", "after", "description", "file", "target", "disposition")
    out = changes.select("id", S.is_additive("verb", "before", "after", "description").alias("additive"), S.effort("verb").alias("effort"), fix.alias("f"))
    return out.select("id", "additive", "effort", F.col("f.strategy").alias("strategy"), F.col("f.from").alias("source"), F.col("f.to").alias("goal"))


@query("api_changes", oracle=f"""{_FIX}, r AS (SELECT id, 'api-' || {_SAN('symbol')} || '-' || replace(verb, '_', '-') AS base, replace(verb, '_', '-') AS change_type, CAST(NULL AS VARCHAR) AS package, {_MAP(S.EFFORT, 'verb')} AS effort, 'mandatory' AS category,
      '^' || string_split(symbol, '.')[-1] || '$' AS pattern, CASE WHEN kind = 'property' THEN 'JSX_PROP' ELSE 'IMPORT' END AS location, fix[1] AS strategy FROM f WHERE NOT additive),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM r)
    SELECT id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS rule_id, change_type, package, effort, category, pattern, location, strategy FROM n""")
def change_rules(changes):
    return rules.change_rules(changes)


_VALUE = "('aria', 'role', 'prop_default')"
_CATS = {k: v[0] for k, v in profiles._FACETS.items()}
_FACET = f"""fc AS (SELECT component, {_MAP(_CATS, 'facet')} AS category, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN facet IN {_VALUE} AND a.value <> b.value THEN 'changed' END AS change, nullif(element, '') AS element, nullif(key, '') AS key, a.value AS before, b.value AS after,
      CASE WHEN facet IN ('consumed_context', 'rendered_component') THEN false WHEN facet = 'prop_default' THEN a IS NOT NULL AND starts_with(a.value, '''') ELSE true END AS affects_tests, a IS NOT NULL AND b IS NOT NULL AND facet IN ('aria', 'role', 'data') AND NOT a.conditional AND b.conditional AS maybe
      FROM {_FULL('old_facets', 'new_facets', ['component', 'facet', 'element', 'key'])} WHERE facet NOT IN ('prop', 'deprecated', 'prop_style')),
    facet_part AS (SELECT component, category, change, element, key, before, after, affects_tests FROM fc WHERE change IS NOT NULL UNION ALL SELECT component, 'attribute_conditionality', 'conditional', element, key, before, NULL, true FROM fc WHERE maybe)"""
_COLS = "component, category, change, element, key, before, after, affects_tests"


@query("old_facets", "new_facets", oracle=f", {_FACET} SELECT {_COLS} FROM facet_part")
def facet_changes(old, new):
    return profiles.facet_changes(old, new)


_BOOL = "SELECT component, '{c}' AS category, CASE WHEN y.{f} THEN 'added' ELSE 'removed' END AS change, CAST(NULL AS VARCHAR) AS element, '{f}' AS key, CAST(x.{f} AS VARCHAR) AS before, CAST(y.{f} AS VARCHAR) AS after, {t} AS affects_tests FROM old_flags x JOIN new_flags y USING (component) WHERE x.{f} <> y.{f}"
_FLAG = "flag_part AS (" + " UNION ALL ".join(_BOOL.format(f=f, c=c, t=t) for f, c, t in (("uses_portal", "portal_usage", "true"), ("is_forward_ref", "forward_ref", "false"), ("is_memo", "memo", "false"), ("has_children", "composition", "false"))) + """
    UNION ALL SELECT component, 'portal_usage', 'changed', NULL, 'portal_target', coalesce(x.portal_target, 'unknown'), coalesce(y.portal_target, 'unknown'), true FROM old_flags x JOIN new_flags y USING (component) WHERE x.uses_portal AND y.uses_portal AND x.portal_target IS DISTINCT FROM y.portal_target
    UNION ALL SELECT component, CASE WHEN list_contains(y.children_path, 'div') AND NOT list_contains(x.children_path, 'div') THEN 'dom_structure' ELSE 'composition' END, 'changed', NULL, 'children_path', array_to_string(x.children_path, ' > '), array_to_string(y.children_path, ' > '),
      list_contains(y.children_path, 'div') AND NOT list_contains(x.children_path, 'div') FROM old_flags x JOIN new_flags y USING (component) WHERE x.children_path <> y.children_path)"""


@query("old_flags", "new_flags", oracle=f", {_FLAG} SELECT {_COLS} FROM flag_part")
def flag_changes(old, new):
    return profiles.flag_changes(old, new)


_BIND = """os AS (SELECT component, key, value FROM old_facets WHERE facet = 'prop_style'), ns AS (SELECT component, key, value FROM new_facets WHERE facet = 'prop_style'),
    bind_part AS (SELECT component, 'css_token' AS category, 'removed' AS change, CAST(NULL AS VARCHAR) AS element, key, key || ' > ' || value AS before, CAST(NULL AS VARCHAR) AS after, true AS affects_tests FROM os WHERE EXISTS (FROM new_facets p WHERE p.facet = 'prop' AND p.component = os.component AND p.key = os.key)
        AND (NOT EXISTS (FROM new_facets t WHERE t.facet = 'css_token' AND t.component = os.component AND t.key = os.value) OR NOT EXISTS (FROM ns WHERE ns.component = os.component AND ns.key = os.key AND ns.value = os.value))
      UNION ALL SELECT component, 'css_token', 'added', NULL, key, NULL, key || ' > ' || value, true FROM ns WHERE EXISTS (FROM old_facets p WHERE p.facet = 'prop' AND p.component = ns.component AND p.key = ns.key)
        AND NOT EXISTS (FROM os WHERE ns.component = os.component AND ns.key = os.key AND ns.value = os.value))"""
_DEPR = """depr_part AS (SELECT component, 'prop_deprecated' AS category, 'deprecated' AS change, CAST(NULL AS VARCHAR) AS element, key, key AS before, value AS after, false AS affects_tests FROM new_facets n WHERE facet = 'deprecated'
      AND EXISTS (FROM old_facets o WHERE o.facet = 'prop' AND o.component = n.component AND o.key = n.key) AND NOT EXISTS (FROM old_facets o WHERE o.facet = 'deprecated' AND o.component = n.component AND o.key = n.key))"""


@query("old_facets", "new_facets", oracle=f", {_BIND} SELECT {_COLS} FROM bind_part")
def binding_changes(old, new):
    return profiles.binding_changes(old, new)


@query("old_facets", "new_facets", oracle=f", {_DEPR} SELECT {_COLS} FROM depr_part")
def deprecation_changes(old, new):
    return profiles.deprecation_changes(old, new)


@query("old_managed", "new_managed", oracle=""" SELECT component, 'prop_attribute_override' AS category, CASE WHEN NOT o.overrides THEN 'changed' ELSE 'added' END AS change, helper AS element, prop AS key, CASE WHEN NOT o.overrides THEN array_to_string(n.attributes, ', ') END AS before, array_to_string(n.attributes, ', ') AS after, true AS affects_tests
      FROM new_managed n LEFT JOIN old_managed o USING (component, prop, helper) WHERE n.overrides AND (o.overrides IS NULL OR NOT o.overrides)
    UNION ALL SELECT component, 'prop_attribute_override', 'removed', helper, prop, array_to_string(o.attributes, ', '), NULL, false FROM old_managed o ANTI JOIN new_managed n USING (component, prop, helper) WHERE o.overrides""")
def managed_attribute_changes(old, new):
    return profiles.managed_changes(old, new)


@query("old_facets", "new_facets", "old_flags", "new_flags", oracle=f", {_FACET}, {_FLAG}, {_BIND}, {_DEPR} SELECT {_COLS} FROM facet_part UNION ALL SELECT {_COLS} FROM flag_part UNION ALL SELECT {_COLS} FROM bind_part UNION ALL SELECT {_COLS} FROM depr_part")
def component_profile_diff(old, new, old_flags, new_flags):
    return profiles.component_changes(old, new, old_flags, new_flags)


_TAG = """{n}t AS (SELECT symbol, t, i, regexp_extract(t, '^[A-Za-z0-9.]+', 0) AS element FROM (SELECT symbol, unnest(regexp_extract_all({b}, '<([A-Za-z][A-Za-z0-9.]*(?:\\s[^<>]*)?)', 1)) AS t, generate_subscripts(regexp_extract_all({b}, '<([A-Za-z][A-Za-z0-9.]*(?:\\s[^<>]*)?)', 1), 1) AS i FROM mb)),
    {n}a AS (SELECT symbol, element, i, unnest(regexp_extract_all(t, '\\s(aria-[a-z]+|role|data-[a-z-]+)=(?:"([^"]*)"|\\{{)', 1)) AS k, unnest(regexp_extract_all(t, '\\s(aria-[a-z]+|role|data-[a-z-]+)=(?:"([^"]*)"|\\{{)', 2)) AS v FROM {n}t),
    {n}f AS (SELECT symbol, 'tag' AS facet, element, '' AS key, CAST(count(*) AS VARCHAR) AS value FROM {n}t GROUP BY symbol, element UNION ALL SELECT symbol, CASE WHEN k = 'role' THEN 'role' WHEN k LIKE 'aria-%' THEN 'aria' ELSE 'data' END, element, CASE WHEN k = 'role' THEN '' ELSE k END, arg_max(coalesce(v, ''), i) FROM {n}a GROUP BY symbol, element, k
      UNION ALL SELECT DISTINCT symbol, 'class', '', c, NULL FROM (SELECT symbol, unnest(string_split(regexp_extract(t, '\\sclass(?:Name)?="([^"]*)"', 1), ' ')) AS c FROM {n}t) WHERE c <> '')"""


@query("bodies", oracle=f""", mb AS (SELECT * FROM bodies WHERE contains(old_body, '<') AND contains(new_body, '<')), {_TAG.format(n='o', b='old_body')}, {_TAG.format(n='n', b='new_body')},
    d AS (SELECT symbol, facet, element, key, a.value AS before, b.value AS after, a IS NULL AS came, b IS NULL AS gone FROM {_FULL('of', 'nf', ['symbol', 'facet', 'element', 'key'])}),
    e AS (SELECT *, CASE WHEN came THEN CASE WHEN facet NOT IN ('role', 'data') THEN 'added' END WHEN gone THEN 'removed' WHEN before = after THEN NULL WHEN facet = 'tag' THEN CASE WHEN regexp_matches(element, '^[a-z]') THEN 'count' END WHEN facet = 'role' OR (before <> '' AND after <> '') THEN 'changed' END AS change FROM d)
    SELECT symbol, CASE WHEN facet = 'tag' THEN 'dom_structure' WHEN facet IN ('aria', 'role') THEN 'accessibility' WHEN facet = 'class' THEN 'css_class' ELSE 'data_attribute' END AS category, change, element, key, before, after FROM e WHERE change IS NOT NULL""")
def jsx_body_diff(bodies):
    return profiles.jsx_changes(bodies)


@query("component_sources", oracle=r""" SELECT name, regexp_matches(source, 'createPortal ?\(') AS uses_portal, regexp_matches(source, 'forwardRef[(<]') AS is_forward_ref, regexp_matches(source, '(^|[^A-Za-z0-9_])memo\(') AS is_memo,
    array_to_string(list_sort(list_distinct(regexp_extract_all(source, 'useContext\(\s*([A-Za-z0-9_.]+)', 1))), ',') AS consumed, array_to_string(list_sort(list_distinct(regexp_extract_all(source, '<([A-Za-z0-9_]+)\.Provider', 1))), ',') AS provided FROM component_sources""")
def react_api_usage(sources):
    return profiles.react_api(sources, "name", "source").withColumns({c: F.array_join(c, ",") for c in ("consumed", "provided")})


_J = "FROM old_java x JOIN new_java y USING (qualified_name)"
_ARR = "array_to_string({}, ', ')"


@query("old_java", "new_java", oracle=f""" SELECT qualified_name, 'final_added' AS category, CAST(NULL AS VARCHAR) AS before, 'final' AS after, true AS is_breaking {_J} WHERE NOT x.is_final AND y.is_final
    UNION ALL SELECT qualified_name, 'final_removed', 'final', NULL, false {_J} WHERE x.is_final AND NOT y.is_final
    UNION ALL SELECT qualified_name, 'sealed_changed', CASE WHEN x.is_sealed THEN {_ARR.format('x.permits')} END, CASE WHEN y.is_sealed THEN {_ARR.format('y.permits')} END, y.is_sealed AND (NOT x.is_sealed OR len(list_filter(x.permits, lambda p: NOT list_contains(y.permits, p))) > 0) {_J} WHERE x.is_sealed <> y.is_sealed OR x.permits <> y.permits
    UNION ALL SELECT qualified_name, 'inheritance_changed', x.extends, y.extends, true {_J} WHERE x.extends IS DISTINCT FROM y.extends
    UNION ALL SELECT qualified_name, 'inheritance_changed', {_ARR.format('x.implements')}, {_ARR.format('y.implements')}, true {_J} WHERE len(list_filter(x.implements, lambda p: NOT list_contains(y.implements, p))) > 0
    UNION ALL SELECT qualified_name, 'constructor_changed', {_ARR.format('x.constructor_params')}, {_ARR.format('y.constructor_params')}, true {_J} WHERE x.constructor_params <> y.constructor_params""")
def java_class_diff(old, new):
    return profiles.java_class_changes(old, new)


_M = "FROM old_methods x JOIN new_methods y USING (class_name, method)"
_ONE = lambda f, c, gone, b: f"SELECT class_name, method, '{c}' AS category, {repr(f[1]) if gone else 'CAST(NULL AS VARCHAR)'} AS before, {'CAST(NULL AS VARCHAR)' if gone else repr(f[1])} AS after, {b} AS is_breaking {_M} WHERE {'x' if gone else 'y'}.{f[0]} AND NOT {'y' if gone else 'x'}.{f[0]}"
_METHODS = " UNION ALL ".join([
    _ONE(("is_synchronized", "synchronized"), "synchronization_removed", True, "true"), _ONE(("is_synchronized", "synchronized"), "synchronization_added", False, "false"),
    _ONE(("is_native", "native"), "native_removed", True, "true"), _ONE(("is_override", "@Override"), "override_removed", True, "true"), _ONE(("is_override", "@Override"), "override_added", False, "false"),
    f"SELECT class_name, method, 'delegation_changed', {_ARR.format('x.delegations')}, {_ARR.format('y.delegations')}, true {_M} WHERE list_sort(list_distinct(x.delegations)) <> list_sort(list_distinct(y.delegations))",
    f"SELECT class_name, method, 'exception_added', NULL, unnest(list_filter(y.exceptions, lambda e: NOT list_contains(x.exceptions, e))), true {_M}",
    f"SELECT class_name, method, 'exception_removed', unnest(list_filter(x.exceptions, lambda e: NOT list_contains(y.exceptions, e))), NULL, false {_M}",
])


@query("old_methods", "new_methods", oracle=" " + _METHODS)
def java_method_diff(old, new):
    return profiles.java_method_changes(old, new)


@query("old_notes", "new_notes", oracle=f""", d AS (SELECT target, name, CASE WHEN a IS NULL THEN 'annotation_added' WHEN b IS NULL THEN 'annotation_removed' WHEN a.attributes <> b.attributes THEN 'annotation_changed' END AS category, a.attributes AS before, b.attributes AS after FROM {_FULL('old_notes', 'new_notes', ['target', 'name'])})
    SELECT *, category <> 'annotation_added' AS is_breaking FROM d WHERE category IS NOT NULL""")
def java_annotation_diff(old, new):
    return profiles.annotation_changes(old, new)


@query("old_fields", "new_fields", "stored", oracle=f""", o AS (SELECT * FROM old_fields WHERE NOT is_static AND class_name IN (FROM stored)), n AS (SELECT * FROM new_fields WHERE NOT is_static AND class_name IN (FROM stored)),
    d AS (SELECT class_name, field, a.type AS t, b.type AS u, a.is_transient AS p, b.is_transient AS q, coalesce(NOT a.is_transient, false) AS x, coalesce(NOT b.is_transient, false) AS y FROM {_FULL('o', 'n', ['class_name', 'field'])})
    SELECT class_name, field, 'serialization_field_removed' AS category, field AS before, CAST(NULL AS VARCHAR) AS after, true AS is_breaking FROM d WHERE x AND NOT y
    UNION ALL SELECT class_name, field, 'serialization_field_added', NULL, field, true FROM d WHERE y AND NOT x
    UNION ALL SELECT class_name, field, 'serialization_field_type_changed', t, u, true FROM d WHERE x AND y AND t <> u
    UNION ALL SELECT class_name, field, 'transient_changed', CASE WHEN p THEN 'transient' ELSE 'non-transient' END, CASE WHEN q THEN 'transient' ELSE 'non-transient' END, true FROM d WHERE p <> q""")
def java_serialization_diff(old, new, stored):
    return profiles.serialization_changes(old, new, stored)


@query("old_directives", "new_directives", oracle=""" SELECT module, directive, CASE WHEN starts_with(directive, 'exports ') THEN 'module_export_removed' ELSE 'module_requires_changed' END AS category, starts_with(directive, 'exports ') AS is_breaking FROM (FROM old_directives EXCEPT FROM new_directives)
    UNION ALL SELECT module, directive, CASE WHEN starts_with(directive, 'exports ') THEN 'module_export_added' ELSE 'module_requires_changed' END, false FROM (FROM new_directives EXCEPT FROM old_directives)""")
def java_module_diff(old, new):
    return profiles.module_changes(old, new)


@query("extends", oracle=""" SELECT c.child, c.parent, coalesce((SELECT string_agg(CAST(d.child AS VARCHAR), ',' ORDER BY d.child) FROM extends d WHERE d.parent = c.child), '') AS subclasses FROM extends c""")
def inheritance_summary(extends):
    out = profiles.inheritance(extends.select(F.col("child").alias("qualified_name"), F.col("parent").alias("extends")).withColumn("extends", F.col("extends").cast("string")).withColumn("qualified_name", F.format_string("%012d", "qualified_name")).withColumn("extends", F.format_string("%012d", F.col("extends").cast("long"))))
    plain = F.array_join(F.transform("subclasses", lambda x: x.cast("long").cast("string")), ",")
    return out.select(F.col("qualified_name").cast("long").alias("child"), F.col("extends").cast("long").alias("parent"), plain.alias("subclasses"))


_SPEC = lambda t: f"(SELECT *, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(extra, '\\s+', ' ', 'g'))) AS e FROM {t})"


@query("old_specs", "new_specs", oracle=f""", o AS {_SPEC('old_specs')}, n AS {_SPEC('new_specs')}, d AS (SELECT name, part, coalesce(b.subject, a.subject) AS subject, a, b FROM {_FULL('o', 'n', ['name', 'part', 's'])})
    SELECT name, subject, 'precondition_added' AS reason, CAST(NULL AS VARCHAR) AS before, b.term AS after FROM d WHERE part = 'pre' AND a IS NULL
    UNION ALL SELECT name, subject, 'precondition_changed', a.term, b.term FROM d WHERE part = 'pre' AND a.t <> b.t UNION ALL SELECT name, subject, 'violation_changed', a.extra, b.extra FROM d WHERE part = 'pre' AND a.e <> b.e
    UNION ALL SELECT name, subject, 'postcondition_removed', a.term, NULL FROM d WHERE part = 'post' AND b IS NULL UNION ALL SELECT name, subject, 'return_changed', a.term, b.term FROM d WHERE part = 'post' AND a.t <> b.t
    UNION ALL SELECT name, subject, 'error_changed', a.term, b.term FROM d WHERE part = 'error' AND a.t <> b.t UNION ALL SELECT name, subject, 'error_added', NULL, b.term FROM d WHERE part = 'error' AND a IS NULL
    UNION ALL SELECT name, subject, 'effect_removed', a.term, NULL FROM d WHERE part = 'effect' AND (b IS NULL OR a.t <> b.t) AND a IS NOT NULL UNION ALL SELECT name, subject, 'effect_changed', a.term, b.term FROM d WHERE part = 'effect' AND a.t <> b.t""")
def function_spec_diff(old, new):
    return profiles.spec_changes(old, new)


@query("old_poms", "new_poms", oracle=f""", d AS (SELECT project, section, key, a.value AS x, b.value AS y, a.scope AS s, b.scope AS t, a IS NULL AS came, b IS NULL AS gone FROM {_FULL('old_poms', 'new_poms', ['project', 'section', 'key'])})
    SELECT project, section, key, 'project_identity_changed' AS category, x AS before, y AS after, key <> 'version' AS is_breaking FROM d WHERE section = 'identity' AND x IS DISTINCT FROM y
    UNION ALL SELECT project, section, key, 'parent_version_changed', x, y, false FROM d WHERE section = 'parent' AND key = 'version' AND x IS DISTINCT FROM y UNION ALL SELECT project, section, key, 'parent_changed', x, y, true FROM d WHERE section = 'parent' AND key = 'artifact' AND x <> y
    UNION ALL SELECT project, section, key, 'dependency_removed', x, NULL, true FROM d WHERE section = 'dependency' AND gone UNION ALL SELECT project, section, key, 'dependency_added', NULL, y, false FROM d WHERE section = 'dependency' AND came
    UNION ALL SELECT project, section, key, 'dependency_version_changed', x, y, false FROM d WHERE section = 'dependency' AND x <> y
    UNION ALL SELECT project, section, key, 'dependency_scope_changed', s, t, coalesce(s, 'compile') = 'compile' AND coalesce(t, 'compile') <> 'compile' FROM d WHERE section = 'dependency' AND NOT came AND NOT gone AND s IS DISTINCT FROM t
    UNION ALL SELECT project, section, key, 'property_changed', x, y, false FROM d WHERE section = 'property' AND x IS DISTINCT FROM y""")
def pom_diff(old, new):
    return profiles.pom_changes(old, new)


_JS = lambda side, f: f"json_extract_string({side}, '$.{f}')"
_KEYS = lambda f: f"""SELECT case_id, '{f}.' || k AS field, CASE WHEN x IS NULL THEN 'dependency_added' WHEN y IS NULL THEN 'dependency_removed' ELSE 'dependency_changed' END AS change, x AS before, y AS after, '{f}' AS f
      FROM (SELECT case_id, k, json_extract_string(old, '$.{f}."' || k || '"') AS x, json_extract_string(new, '$.{f}."' || k || '"') AS y FROM (SELECT *, unnest(list_distinct(list_concat(json_keys(old, '$.{f}'), json_keys(new, '$.{f}')))) AS k FROM manifests)) WHERE x IS DISTINCT FROM y"""  # noqa: E731
_MANIFEST = f""", e AS (SELECT case_id, f AS field, json_extract_string(old, '$.' || f) AS before, json_extract_string(new, '$.' || f) AS after FROM (SELECT *, unnest(['main', 'module', 'types', 'typings']) AS f FROM manifests)),
    k AS ({_KEYS('peerDependencies')} UNION ALL {_KEYS('engines')}),
    mf AS (SELECT case_id, field, 'entry_point' AS change, true AS is_breaking, before, after FROM e WHERE before IS NOT NULL AND before IS DISTINCT FROM after
      UNION ALL SELECT case_id, 'type', 'module_system', true, coalesce({_JS('old', 'type')}, 'commonjs'), coalesce({_JS('new', 'type')}, 'commonjs') FROM manifests WHERE coalesce({_JS('old', 'type')}, 'commonjs') <> coalesce({_JS('new', 'type')}, 'commonjs')
      UNION ALL SELECT case_id, field, change, change <> 'dependency_removed', before, after FROM k WHERE f = 'peerDependencies' OR change <> 'dependency_removed'
      UNION ALL SELECT case_id, 'bin.n', 'dependency_removed', true, {_JS('old', 'bin')}, NULL FROM manifests WHERE json_type(old, '$.bin') = 'VARCHAR')"""


@query("manifests", oracle=_MANIFEST + " SELECT * FROM mf")
def package_manifest_diff(manifests):
    return facets.manifest_diff(manifests, "case_id")


@query("manifests", oracle=_MANIFEST + f""", r AS (SELECT case_id, 'manifest-' || {_SAN('field')} || '-' || replace(change, '_', '-') AS base, replace(change, '_', '-') AS change_type, CAST(NULL AS VARCHAR) AS package, CASE change WHEN 'module_system' THEN 7 WHEN 'entry_point' THEN 5 ELSE 3 END AS effort,
      CASE WHEN is_breaking THEN 'mandatory' ELSE 'optional' END AS category, field AS pattern, 'MANIFEST' AS location, CASE WHEN starts_with(field, 'peer') AND change <> 'dependency_removed' THEN 'EnsureDependency' ELSE 'Manual' END AS strategy FROM mf),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY case_id) AS i FROM r) SELECT case_id, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS rule_id, change_type, package, effort, category, pattern, location, strategy FROM n""")
def manifest_rules(manifests):
    return rules.manifest_rules(facets.manifest_diff(manifests, "case_id"))


_EDGES = "SELECT family, parent, child, bool_or(chp) AS chp, bool_or(pmc) AS pmc FROM signals GROUP BY ALL"


@query("signals", oracle=f""", e AS ({_EDGES}), walk(family, parent, node, chp, pmc, hops) AS (SELECT family, parent, child, chp, pmc, 0 FROM e WHERE parent < 'n4'
      UNION SELECT w.family, w.parent, e.child, w.pmc AND e.chp, w.pmc AND e.pmc, hops + 1 FROM walk w JOIN e ON e.family = w.family AND e.parent = w.node WHERE w.node >= 'n4' AND hops < 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY family, parent, node ORDER BY hops, pmc DESC, chp DESC) AS k FROM walk WHERE node < 'n4' AND (hops = 0 OR node <> parent))
    SELECT family, parent, node AS child, chp, pmc FROM r WHERE k = 1""")
def internal_node_collapse(signals):
    """Nodes n4 and n5 are internal."""
    edges = cut(graph.combine_edges(signals).select("family", "parent", "child", "chp", "pmc"))
    names = edges.select("family", F.col("parent").alias("node")).unionByName(edges.select("family", F.col("child").alias("node"))).where("node < 'n4'")
    return graph.collapse_internal(edges, names)


@query("signals", oracle=""", o AS (SELECT family, parent, child, bool_or(chp) AS chp, bool_or(pmc) AS pmc FROM signals WHERE relationship <> 'internal' GROUP BY ALL), n AS (SELECT family, parent, child, bool_or(chp) AS chp, bool_or(pmc) AS pmc FROM signals WHERE relationship <> 'prop_passed' GROUP BY ALL),
    d AS (SELECT family, parent, child, CASE WHEN o.chp IS NULL THEN 'added' WHEN n.chp IS NULL THEN 'removed' WHEN o.chp <> n.chp OR o.pmc <> n.pmc THEN 'strength' END AS change FROM o FULL JOIN n USING (family, parent, child)) SELECT * FROM d WHERE change IS NOT NULL""")
def composition_tree_diff(signals):
    return graph.tree_diff(graph.combine_edges(signals.where("relationship <> 'internal'")), graph.combine_edges(signals.where("relationship <> 'prop_passed'")))


@query("needs", oracle=""", walk(node, level) AS (SELECT dep, 0 FROM needs WHERE dep NOT IN (SELECT node FROM needs) UNION SELECT needs.node, level + 1 FROM walk JOIN needs ON dep = walk.node) SELECT DISTINCT node, level FROM walk""")
def build_order(needs):
    """A family is built after the one that it delegates to."""
    return graph.levels(needs, needs.select("node").unionByName(needs.select(F.col("dep").alias("node"))))


_PKG = "coalesce((SELECT package FROM pk WHERE pk.component = c.component), 'unknown')"
_PACKAGES = ", pk AS (SELECT 'C' || CAST(ordinal AS VARCHAR) AS component, package FROM old_symbols)"


def _packages(symbols):
    return symbols.select(F.concat(F.lit("C"), F.col("ordinal").cast("string")).alias("component"), "package")


@query("old_facets", "new_facets", "old_symbols", oracle=f", {_DEPR}{_PACKAGES} SELECT 'source-deprecated-prop-' || {_SAN('component')} || '-' || {_SAN('before')} AS rule_id, 'prop-deprecated' AS change_type, {_PKG} AS package, 1 AS effort, 'optional' AS category, '^' || before || '$' AS pattern, 'JSX_PROP' AS location, CAST(NULL AS VARCHAR) AS strategy FROM depr_part c")
def deprecated_prop_rules(old, new, symbols):
    return rules.deprecated_prop_rules(profiles.deprecation_changes(old, new), _packages(symbols))


@query("old_facets", "new_facets", "old_symbols", oracle=f", {_FACET}{_PACKAGES} SELECT 'source-context-' || {_SAN('component')} || '-' || {_SAN('key')} AS rule_id, 'context-dependency' AS change_type, {_PKG} AS package, 3 AS effort, 'mandatory' AS category, '^' || key || '$' AS pattern, 'IMPORT' AS location, 'Manual' AS strategy FROM facet_part c WHERE category = 'context_dependency'")
def context_rules(old, new, symbols):
    return rules.context_rules(profiles.facet_changes(old, new), _packages(symbols))


@query("old_symbols", "new_symbols", oracle=f""", g AS (SELECT DISTINCT file, name, package FROM old_symbols o WHERE NOT EXISTS (FROM new_symbols n WHERE n.file = o.file AND n.name = o.name))
    SELECT 'composition-' || {_SAN('file')} || '-removed-member-' || {_SAN('name')} AS rule_id, 'composition' AS change_type, package, 3 AS effort, 'mandatory' AS category, '^' || name || '$' AS pattern, 'JSX_COMPONENT' AS location, 'Manual' AS strategy FROM g""")
def removed_member_rules(old, new):
    of = lambda d: d.select(F.col("file").alias("family"), F.col("name").alias("component"))
    return rules.removed_member_rules(of(old), of(new), old.select(F.col("name").alias("component"), "package"))


@query("old_classes", "new_classes", oracle=f""", d AS (SELECT class, replace(class, 'pf-v5-', 'pf-v6-') AS swapped FROM old_classes WHERE replace(class, 'pf-v5-', 'pf-v6-') NOT IN (SELECT class FROM new_classes))
    SELECT 'css-dead-class-' || {_SAN('class')} AS rule_id, 'css-dead-class' AS change_type, CAST(NULL AS VARCHAR) AS package, 3 AS effort, 'mandatory' AS category, '(' || replace(class, '-', '\\-') || '|' || replace(swapped, '-', '\\-') || ')' AS pattern, 'CSS_CLASS' AS location, CAST(NULL AS VARCHAR) AS strategy FROM d""")
def dead_class_rules(old, new):
    return rules.dead_class_rules(report.dead_classes(old, new, "pf-v5-", "pf-v6-"))


@query("old_classes", "new_classes", oracle=f""", b AS (SELECT DISTINCT regexp_replace(class, '^pf-v5-', '') AS block FROM old_classes EXCEPT SELECT regexp_replace(class, '^pf-v6-', '') FROM new_classes)
    SELECT 'css-removed-' || {_SAN('block')} AS rule_id, 'css-removal' AS change_type, CAST(NULL AS VARCHAR) AS package, 3 AS effort, 'mandatory' AS category, '(pf-v5|pf-v6)-c-' || block AS pattern, 'CSS_CLASS' AS location, CAST(NULL AS VARCHAR) AS strategy FROM b
    UNION ALL SELECT 'css-file-removed-' || {_SAN('block')}, 'css-file-removed', 'styles', 1, 'mandatory', 'styles/' || block, 'IMPORT', NULL FROM b""")
def removed_css_rules(old, new):
    """Removed blocks and the entry files named after them."""
    of = lambda d, p: d.select(F.regexp_replace("class", p, "").alias("block")).distinct()
    gone = of(old, "^pf-v5-").join(of(new, "^pf-v6-"), "block", "left_anti")
    files = gone.select(F.concat("block", F.lit(".scss")).alias("file"))
    return rules.css_block_rules(gone, ("pf-v5", "pf-v6")).unionByName(rules.css_file_rules(files, "styles"))


_LABEL = {k: v[0] for k, v in rules.JAVA.items()}


@query("old_methods", "new_methods", oracle=f""", c AS (SELECT class_name, category, before, after FROM ({_METHODS}) WHERE is_breaking AND category IN ({_IN(rules.JAVA)})),
    r AS (SELECT 'java-sd-' || {_MAP(_LABEL, 'category')} || '-' || {_SAN('class_name')} AS base, {_MAP(_LABEL, 'category')} AS change_type, CAST(NULL AS VARCHAR) AS package, {_MAP({k: v[2] for k, v in rules.JAVA.items()}, 'category')} AS effort, 'mandatory' AS category, class_name AS pattern,
      {_MAP({k: v[1] for k, v in rules.JAVA.items()}, 'category')} AS location, CAST(NULL AS VARCHAR) AS strategy FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY base) AS k FROM r)
    SELECT CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS rule_id, change_type, package, effort, category, pattern, location, strategy FROM n""")
def java_source_rules(old, new):
    return rules.java_rules(profiles.java_method_changes(old, new).drop("method"))
