"""Version pairs derived from the driver's tables by arithmetic on keys.

Conditions on keys tell which of the two versions has a thing; all rows of
the tables take part.
Each text is SQL that both Spark and the oracle's engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import parted

_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'interface' WHEN 2 THEN 'class' WHEN 3 THEN 'constant' ELSE 'enum' END"
_VIS = "CASE {x} % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'public' ELSE 'exported' END"
_PAIR = "'pkg/' || p_brand || '/' || replace(p_name, ' ', '_') || '.S' || CAST(p_partkey AS STRING)"

SQL = {
    "old_symbols": f"""SELECT {_PAIR} AS qualified_name, 'S' || CAST(p_partkey AS STRING) AS name, {_KIND} AS kind,
        p_brand AS package, p_type AS return_type, 'pkg/' || p_brand || '/' || replace(p_name, ' ', '_') AS file, p_partkey AS ordinal
        FROM part WHERE p_partkey % 10 <> 1""",
    "new_symbols": f"""SELECT CASE p_partkey % 10 WHEN 3 THEN replace({_PAIR}, 'pkg/', 'pkg/deprecated/') WHEN 5 THEN {_PAIR} || 'x' ELSE {_PAIR} END AS qualified_name,
        'S' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 10 = 5 THEN 'x' ELSE '' END AS name, {_KIND} AS kind,
        p_brand AS package, CASE WHEN p_partkey % 10 = 4 THEN p_type || ' V2' ELSE p_type END AS return_type,
        'pkg/' || p_brand || '/' || replace(p_name, ' ', '_') AS file, p_partkey AS ordinal
        FROM part WHERE p_partkey % 10 <> 2""",
    "matched": f"""SELECT p_partkey AS id, {_VIS.format(x='p_partkey')} AS old_visibility, {_VIS.format(x='(p_partkey + p_size)')} AS new_visibility,
        p_size % 2 = 0 AS old_readonly, p_size % 3 = 0 AS new_readonly, p_size % 5 = 0 AS old_abstract, p_size % 4 = 0 AS new_abstract,
        p_size % 7 = 0 AS old_static, p_size % 11 = 0 AS new_static, CASE WHEN p_size % 3 = 0 THEN 'get' END AS old_accessor, CASE WHEN p_size % 6 = 0 THEN 'get' END AS new_accessor,
        p_size % 6 <> 0 AS old_has_signature, p_size % 8 <> 0 AS new_has_signature, p_type AS old_return,
        CASE p_partkey % 4 WHEN 0 THEN 'Promise<' || p_type || '>' WHEN 1 THEN p_brand ELSE p_type END AS new_return,
        CASE WHEN p_size % 2 = 0 THEN p_brand END AS old_extends, CASE WHEN p_size % 3 = 0 THEN p_brand END AS new_extends FROM part""",
    "old_members": "SELECT CAST(l_partkey AS STRING) AS parent, 'm' || CAST(l_linenumber AS STRING) AS member, min(l_returnflag) AS type FROM lineitem WHERE (l_partkey + l_linenumber) % 7 <> 0 GROUP BY ALL",
    "new_members": "SELECT CAST(l_partkey AS STRING) AS parent, 'm' || CAST(l_linenumber AS STRING) AS member, max(l_linestatus) AS type FROM lineitem WHERE (l_partkey + l_linenumber) % 5 <> 0 GROUP BY ALL",
    "old_tokens": "SELECT DISTINCT 'global_' || replace(p_name, ' ', '_') || '_' || CAST(p_size AS STRING) AS name FROM part WHERE p_partkey % 3 = 0",
    "new_tokens": "SELECT DISTINCT 'global_' || replace(p_name, ' ', '_') || '_t' || CAST(p_size % 10 AS STRING) AS name FROM part WHERE p_partkey % 3 <> 0",
    "removed_containers": "SELECT CAST(l_suppkey % 20 AS STRING) AS family, 'old' || CAST(l_partkey % 50 AS STRING) AS container, 'm' || CAST(l_orderkey % 40 AS STRING) AS member FROM lineitem WHERE l_linenumber = 1",
    "new_containers": "SELECT CAST(l_suppkey % 20 AS STRING) AS family, 'new' || CAST(l_partkey % 60 AS STRING) AS container, 'm' || CAST(l_orderkey % 40 AS STRING) AS member FROM lineitem WHERE l_linenumber = 2",
    "type_members": "SELECT p_brand AS package, p_type AS type, CASE WHEN p_partkey % 5 < 2 + (p_size % 3) THEN 'removed' WHEN p_partkey % 7 = 0 THEN 'changed' END AS change FROM part",
    "constant_changes": "SELECT p_brand AS package, CASE p_partkey % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' ELSE 'type' END AS change, CASE p_size % 4 WHEN 0 THEN 'ImportPathChange' WHEN 1 THEN 'Rename' ELSE 'Manual' END AS strategy, 'c' || CAST(p_partkey AS STRING) AS symbol FROM part",
    "calls": "SELECT DISTINCT 'f' || CAST(l_orderkey AS STRING) AS caller, 'f' || CAST(CAST(floor(l_orderkey / 2.0E0) AS BIGINT) + l_linenumber AS STRING) AS callee FROM lineitem",
    "functions": "SELECT 'f' || CAST(o_orderkey AS STRING) AS name, o_custkey % 2 = 0 AS is_public FROM orders",
    "changed": "SELECT 'f' || CAST(o_orderkey AS STRING) AS root, 0.5 + (o_orderkey % 5) / 10.0E0 AS confidence FROM orders WHERE NOT (o_custkey % 2 = 0)",
    "extends": "SELECT p_partkey AS child, p_partkey - 1 - p_size % 40 AS parent FROM part WHERE p_partkey - 1 - p_size % 40 > 0",
    "needs": "SELECT CAST(o_orderkey AS STRING) AS node, CAST(CAST(floor(o_orderkey / 3.0E0) AS BIGINT) AS STRING) AS dep FROM orders WHERE o_orderkey >= 3",
    "flagged": "SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0",
    "signals": "SELECT 'f' || CAST(l_partkey AS STRING) AS family, 'n' || CAST(l_suppkey % 6 AS STRING) AS parent, 'n' || CAST(l_orderkey % 6 AS STRING) AS child, l_linenumber > 4 AS chp, l_quantity > 40 AS pmc, CASE l_returnflag WHEN 'A' THEN 'internal' WHEN 'N' THEN 'direct_child' ELSE 'prop_passed' END AS relationship, CASE WHEN l_tax > 0.02E0 THEN l_linestatus || CAST(l_linenumber AS STRING) END AS evidence, l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_returnflag = 'R' THEN 'p' || CAST(l_linenumber AS STRING) END AS prop_name FROM lineitem",
    "renders": "SELECT DISTINCT CAST(l_suppkey AS STRING) AS host, CAST(l_partkey AS STRING) AS component FROM lineitem",
    "behaviour": "SELECT CAST(p_partkey AS STRING) AS component, p_type AS category FROM part",
    "stopped": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS host, 'c' || CAST(l_suppkey % 25 AS STRING) || CASE WHEN l_suppkey % 3 = 0 THEN 'Group' ELSE '' END AS component FROM lineitem WHERE l_returnflag = 'R'",
    "started": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS host, 'c' || CAST(l_suppkey % 30 AS STRING) || CASE WHEN l_suppkey % 2 = 0 THEN 'Group' ELSE '' END AS component FROM lineitem WHERE l_returnflag <> 'R'",
    "old_classes": "SELECT DISTINCT 'pf-v5-' || lower(replace(p_name, ' ', '-')) || '-' || CAST(p_size % 15 AS STRING) AS class FROM part WHERE p_partkey % 4 <> 0",
    "new_classes": "SELECT DISTINCT 'pf-v6-' || lower(replace(p_name, ' ', '-')) || '-' || CAST(p_size % 15 AS STRING) AS class FROM part WHERE p_partkey % 6 = 0",
    "rules": "SELECT 'r' || CAST(o_orderkey AS STRING) AS rule_id, o_orderpriority || '/' || CAST(o_custkey % 50 AS STRING) AS key, o_orderstatus AS label, CAST(o_orderkey % 7 AS BIGINT) AS effort FROM orders",
    "file_changes": "SELECT 'f' || CAST(o_custkey AS STRING) AS file, CASE WHEN o_orderkey % 4 = 0 THEN 'default' ELSE 'S' || CAST(o_orderkey AS STRING) END AS name, o_orderstatus AS change FROM orders",
    "old_facets": """SELECT 'C' || CAST(l_partkey AS STRING) AS component,
        CASE (l_linenumber + l_suppkey) % 12 WHEN 0 THEN 'aria' WHEN 1 THEN 'role' WHEN 2 THEN 'data' WHEN 3 THEN 'css_token' WHEN 4 THEN 'prop_default' WHEN 5 THEN 'element' WHEN 6 THEN 'prop_style'
          WHEN 7 THEN 'prop' WHEN 8 THEN 'deprecated' WHEN 9 THEN 'consumed_context' WHEN 10 THEN 'provided_context' ELSE 'rendered_component' END AS facet,
        CASE WHEN (l_linenumber + l_suppkey) % 12 < 3 THEN 'e' || CAST(l_suppkey % 2 AS STRING) ELSE '' END AS element,
        CASE WHEN (l_linenumber + l_suppkey) % 12 = 1 THEN '' ELSE 'k' || CAST(l_orderkey % 3 AS STRING) END AS key,
        min(CASE WHEN (l_linenumber + l_suppkey) % 12 = 6 THEN 'k' || CAST(l_suppkey % 3 AS STRING) WHEN l_linestatus = 'O' THEN '''open''' ELSE 'done' END) AS value, min(l_quantity) > 20 AS conditional
        FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3, 4 """,
    "new_facets": """SELECT 'C' || CAST(l_partkey AS STRING) AS component,
        CASE (l_linenumber + l_suppkey) % 12 WHEN 0 THEN 'aria' WHEN 1 THEN 'role' WHEN 2 THEN 'data' WHEN 3 THEN 'css_token' WHEN 4 THEN 'prop_default' WHEN 5 THEN 'element' WHEN 6 THEN 'prop_style'
          WHEN 7 THEN 'prop' WHEN 8 THEN 'deprecated' WHEN 9 THEN 'consumed_context' WHEN 10 THEN 'provided_context' ELSE 'rendered_component' END AS facet,
        CASE WHEN (l_linenumber + l_suppkey) % 12 < 3 THEN 'e' || CAST(l_suppkey % 2 AS STRING) ELSE '' END AS element,
        CASE WHEN (l_linenumber + l_suppkey) % 12 = 1 THEN '' ELSE 'k' || CAST(l_orderkey % 3 AS STRING) END AS key,
        max(CASE WHEN (l_linenumber + l_suppkey) % 12 = 6 THEN 'k' || CAST(l_suppkey % 3 AS STRING) WHEN l_linestatus = 'O' THEN '''open''' ELSE 'done' END) AS value, min(l_quantity) > 20 AS conditional
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3, 4 """,
    "old_flags": """SELECT 'C' || CAST(p_partkey AS STRING) AS component, p_size % 2 = 0 AS uses_portal, CASE WHEN p_size % 3 = 0 THEN 'body' WHEN p_size % 3 = 1 THEN p_brand END AS portal_target,
        p_size % 3 = 0 AS is_forward_ref, p_size % 4 = 0 AS is_memo, p_size % 5 < 2 AS has_children,
        CASE p_size % 3 WHEN 0 THEN split('Wrap,div', ',') WHEN 1 THEN split('Wrap,Inner', ',') ELSE split('Wrap', ',') END AS children_path FROM part """,
    "new_flags": """SELECT 'C' || CAST(p_partkey AS STRING) AS component, p_size % 3 = 0 AS uses_portal, CASE WHEN p_size % 4 = 0 THEN 'body' WHEN p_size % 3 = 1 THEN p_brand END AS portal_target,
        p_size % 4 = 0 AS is_forward_ref, p_size % 5 = 0 AS is_memo, p_size % 6 < 2 AS has_children,
        CASE p_size % 4 WHEN 0 THEN split('Wrap,div', ',') WHEN 1 THEN split('Wrap,Inner', ',') ELSE split('Wrap', ',') END AS children_path FROM part """,
    "old_java": """SELECT 'org.k' || CAST(p_size % 7 AS STRING) || '.K' || CAST(p_partkey AS STRING) AS qualified_name, p_size % 2 = 0 AS is_final, p_size % 3 = 0 AS is_sealed,
        split('A,B,' || CAST(p_size % 3 AS STRING), ',') AS permits, CASE WHEN p_size % 4 <> 0 THEN 'org.Base' || CAST(p_size % 4 AS STRING) END AS extends,
        split('I' || CAST(p_size % 2 AS STRING) || ',J', ',') AS implements, split('T' || CAST(p_size % 4 AS STRING), ',') AS constructor_params FROM part """,
    "new_java": """SELECT 'org.k' || CAST(p_size % 7 AS STRING) || '.K' || CAST(p_partkey AS STRING) AS qualified_name, p_size % 3 = 0 AS is_final, p_size % 4 = 0 AS is_sealed,
        split('A,B,' || CAST(p_size % 4 AS STRING), ',') AS permits, CASE WHEN p_size % 5 <> 0 THEN 'org.Base' || CAST(p_size % 5 AS STRING) END AS extends,
        split('I' || CAST(p_size % 3 AS STRING) || ',J', ',') AS implements, split('T' || CAST(p_size % 5 AS STRING), ',') AS constructor_params FROM part """,
    "old_methods": """SELECT 'K' || CAST(l_partkey AS STRING) AS class_name, 'm' || CAST(l_suppkey % 9 AS STRING) AS method, min(l_linenumber) % 3 = 0 AS is_synchronized, min(l_linenumber) % 4 = 0 AS is_native,
        min(l_linenumber) % 2 = 0 AS is_override, split('d' || CAST(min(l_linenumber) AS STRING) || ',d0', ',') AS delegations, split('E' || CAST(min(l_orderkey) % 3 AS STRING) || ',Io', ',') AS exceptions
        FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2 """,
    "new_methods": """SELECT 'K' || CAST(l_partkey AS STRING) AS class_name, 'm' || CAST(l_suppkey % 9 AS STRING) AS method, max(l_linenumber) % 4 = 0 AS is_synchronized, max(l_linenumber) % 5 = 0 AS is_native,
        max(l_linenumber) % 2 = 0 AS is_override, split('d' || CAST(max(l_linenumber) AS STRING) || ',d0', ',') AS delegations, split('E' || CAST(max(l_orderkey) % 3 AS STRING) || ',Io', ',') AS exceptions
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 """,
    "old_fields": """SELECT 'K' || CAST(l_partkey AS STRING) AS class_name, 'f' || CAST(l_suppkey % 9 AS STRING) AS field, min(l_linestatus) AS type, min(l_linenumber) = 7 AS is_static, min(l_linenumber) % 3 = 0 AS is_transient
        FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2 """,
    "new_fields": """SELECT 'K' || CAST(l_partkey AS STRING) AS class_name, 'f' || CAST(l_suppkey % 9 AS STRING) AS field, max(l_linestatus) AS type, max(l_linenumber) = 7 AS is_static, max(l_linenumber) % 3 = 0 AS is_transient
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 """,
    "stored": "SELECT 'K' || CAST(p_partkey AS STRING) AS class_name FROM part WHERE p_size > 10",
    "old_notes": "SELECT 'K' || CAST(l_partkey AS STRING) AS target, 'N' || CAST(l_suppkey % 9 AS STRING) AS name, min(l_linestatus) AS attributes FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2",
    "new_notes": "SELECT 'K' || CAST(l_partkey AS STRING) AS target, 'N' || CAST(l_suppkey % 9 AS STRING) AS name, max(l_linestatus) AS attributes FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2",
    "old_directives": "SELECT DISTINCT 'M' || CAST(l_suppkey AS STRING) AS module, CASE WHEN l_linenumber % 2 = 0 THEN 'exports p' ELSE 'requires p' END || CAST(l_partkey % 40 AS STRING) AS directive FROM lineitem WHERE l_returnflag = 'A' ",
    "new_directives": "SELECT DISTINCT 'M' || CAST(l_suppkey AS STRING) AS module, CASE WHEN l_linenumber % 2 = 0 THEN 'exports p' ELSE 'requires p' END || CAST(l_partkey % 40 AS STRING) AS directive FROM lineitem WHERE l_returnflag = 'N' ",
    "old_specs": """SELECT 'fn' || CAST(l_partkey AS STRING) AS name, CASE l_linenumber % 4 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' WHEN 2 THEN 'error' ELSE 'effect' END AS part, 'S  ' || CAST(l_suppkey % 4 AS STRING) AS subject,
        min(CASE WHEN l_linestatus = 'O' THEN ' Gives  ' ELSE 'gives ' END || CAST(l_quantity > 25 AS STRING)) AS term, min(l_linestatus) AS extra FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3 """,
    "new_specs": """SELECT 'fn' || CAST(l_partkey AS STRING) AS name, CASE l_linenumber % 4 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' WHEN 2 THEN 'error' ELSE 'effect' END AS part, 'S  ' || CAST(l_suppkey % 4 AS STRING) AS subject,
        max(CASE WHEN l_linestatus = 'O' THEN ' Gives  ' ELSE 'gives ' END || CAST(l_quantity > 25 AS STRING)) AS term, max(l_linestatus) AS extra FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3 """,
    "old_poms": """SELECT 'P' || CAST(l_suppkey AS STRING) AS project, CASE l_linenumber WHEN 1 THEN 'identity' WHEN 2 THEN 'parent' WHEN 3 THEN 'property' ELSE 'dependency' END AS section,
        CASE l_linenumber WHEN 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'groupId' WHEN 1 THEN 'artifactId' ELSE 'version' END WHEN 2 THEN CASE l_partkey % 2 WHEN 0 THEN 'artifact' ELSE 'version' END ELSE 'g:a' || CAST(l_partkey % 50 AS STRING) END AS key,
        CAST(min(l_orderkey) % 4 AS STRING) AS value, CASE min(l_linenumber + l_orderkey) % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'compile' END AS scope FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3 """,
    "new_poms": """SELECT 'P' || CAST(l_suppkey AS STRING) AS project, CASE l_linenumber WHEN 1 THEN 'identity' WHEN 2 THEN 'parent' WHEN 3 THEN 'property' ELSE 'dependency' END AS section,
        CASE l_linenumber WHEN 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'groupId' WHEN 1 THEN 'artifactId' ELSE 'version' END WHEN 2 THEN CASE l_partkey % 2 WHEN 0 THEN 'artifact' ELSE 'version' END ELSE 'g:a' || CAST(l_partkey % 50 AS STRING) END AS key,
        CAST(max(l_orderkey) % 4 AS STRING) AS value, CASE max(l_linenumber + l_orderkey) % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'compile' END AS scope FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3 """,
    "old_managed": "SELECT 'C' || CAST(l_partkey AS STRING) AS component, 'p' || CAST(l_suppkey % 4 AS STRING) AS prop, 'h' || CAST(l_orderkey % 2 AS STRING) AS helper, min(l_linenumber) > 2 AS overrides, split('data-a,data-' || CAST(min(l_linenumber) AS STRING), ',') AS attributes FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3",
    "new_managed": "SELECT 'C' || CAST(l_partkey AS STRING) AS component, 'p' || CAST(l_suppkey % 4 AS STRING) AS prop, 'h' || CAST(l_orderkey % 2 AS STRING) AS helper, max(l_linenumber) > 4 AS overrides, split('data-a,data-' || CAST(max(l_linenumber) AS STRING), ',') AS attributes FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3",
    "bodies": """SELECT CAST(p_partkey AS STRING) AS symbol, '<div role="r' || CAST(p_size % 3 AS STRING) || '" aria-label="' || p_brand || '" className="a b' || CAST(p_size % 4 AS STRING) || '"><span data-id="' || CAST(p_size AS STRING) || '"/><Icon/></div>' AS old_body,
        CASE p_size % 5 WHEN 0 THEN 'no markup' WHEN 1 THEN '<section aria-label={x} aria-live="polite"><span/><span/></section>' ELSE '<div role="r' || CAST(p_size % 4 AS STRING) || '" aria-label="' || p_brand || '" class="a c"><span data-id="7"/><span/></div>' END AS new_body FROM part """,
    "component_sources": """SELECT CAST(p_partkey AS STRING) AS name, CASE p_size % 4 WHEN 0 THEN 'export const A = React.memo(forwardRef((p, ref) => createPortal(p.children, el)))' WHEN 1 THEN 'const c = useContext(' || 'Ctx' || CAST(p_size % 7 AS STRING) || '); const d = useContext( Theme ); return <Menu.Provider value={c}/>'
        WHEN 2 THEN 'useMemo(() => x); deepmemo(y)' ELSE 'memo(forwardRef<T>(f)); createPortal (a, b); <Ctx1.Provider/> <Ctx0.Provider/>' END AS source FROM part """,
    "typed": """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'string' WHEN 1 THEN ' Number ' WHEN 2 THEN 'Array<' || p_brand || '>' WHEN 3 THEN '{ a: string }' WHEN 4 THEN '(x) => React.ReactNode' WHEN 5 THEN '[a, b]' WHEN 6 THEN p_type || '[]'
        WHEN 7 THEN 'ReactElement' WHEN 8 THEN '''a'' | ''' || p_brand || '''' WHEN 9 THEN '{ "value": "' || p_brand || '" }' END AS old_type,
        CASE p_size % 10 WHEN 0 THEN 'string' WHEN 1 THEN 'void' WHEN 2 THEN 'Foo[]' WHEN 3 THEN '{ b: number }' WHEN 4 THEN '() => void' WHEN 5 THEN '[c]' WHEN 6 THEN 'ReactNode' WHEN 7 THEN '"x" | "y" | ''x''' WHEN 8 THEN '''a'' | string' ELSE '''a'' | ''b''' END AS new_type FROM part """,
    "paths": """SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'packages/core/deprecated/' WHEN 2 THEN 'next/' WHEN 3 THEN 'dist/' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN '__tests__/' WHEN 1 THEN 'next/Menu/' WHEN 2 THEN 'Menu/' ELSE '' END ||
        CASE p_partkey % 9 WHEN 0 THEN 'index.ts' WHEN 1 THEN 'Menu.tsx' WHEN 2 THEN 'Menu.test.tsx' WHEN 3 THEN 'Menu.d.ts' WHEN 4 THEN 'jest.config.js' WHEN 5 THEN 'Menu.stories.jsx' WHEN 6 THEN 'a.css' WHEN 7 THEN 'x.mts' ELSE 'README' END AS path FROM part """,
    "named": """SELECT p_partkey AS id, CASE p_partkey % 15 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'interface' WHEN 4 THEN 'type_alias' WHEN 5 THEN 'constant' WHEN 6 THEN 'variable' WHEN 7 THEN 'enum' WHEN 8 THEN 'property'
        WHEN 9 THEN 'namespace' WHEN 10 THEN 'struct' WHEN 11 THEN 'enum_member' WHEN 12 THEN 'constructor' WHEN 13 THEN 'get_accessor' ELSE 'set_accessor' END AS kind,
        CASE p_size % 6 WHEN 0 THEN '*' WHEN 1 THEN 'ButtonProps' WHEN 2 THEN 'button' WHEN 3 THEN 'Button' WHEN 4 THEN 'ABC' ELSE 'MenuItem' END AS name,
        CASE p_size % 4 WHEN 0 THEN p_brand END AS package, CASE WHEN p_size % 3 = 0 THEN p_type END AS return_type,
        CASE p_size % 5 WHEN 0 THEN 'pkg/deprecated/' WHEN 1 THEN 'pkg/next/' ELSE 'pkg/' END || CASE p_partkey % 4 WHEN 0 THEN 'file.ButtonProps.isOpen' WHEN 1 THEN 'file.Menu' WHEN 2 THEN 'file' ELSE 'file.Menu.Item.x' END AS qualified_name,
        CASE p_size % 7 WHEN 0 THEN 'pkg/deprecated/' WHEN 1 THEN 'pkg/next/' ELSE 'pkg/' END || 'file.Menu' AS new_name,
        CASE p_size % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'internal' WHEN 2 THEN 'protected' WHEN 3 THEN 'public' ELSE 'exported' END AS visibility, p_size % 2 = 0 AS optional, p_size % 3 = 0 AS is_abstract, p_size % 4 = 0 AS is_default FROM part """,
    "java_names": """SELECT o_orderkey AS id, 'org.' || CASE o_custkey % 3 WHEN 0 THEN 'spring.' WHEN 1 THEN 'boot.' ELSE '' END || 'web.' || CASE o_orderkey % 3 WHEN 0 THEN 'client.' ELSE '' END || 'K' AS old_name,
        'org.' || CASE o_orderkey % 4 WHEN 0 THEN 'spring.' WHEN 1 THEN 'boot.' WHEN 2 THEN 'boot.auto.' ELSE '' END || 'web.' || CASE o_custkey % 4 WHEN 0 THEN 'client.' WHEN 1 THEN 'x.client.' ELSE '' END || 'K' AS new_name,
        CASE o_orderkey % 4 WHEN 0 THEN 'Base<A>' WHEN 1 THEN 'Base' WHEN 2 THEN 'Other' END AS old_extends, CASE o_custkey % 3 WHEN 0 THEN 'Base<A>' WHEN 1 THEN 'Base<B>' END AS new_extends,
        CASE o_custkey % 5 WHEN 0 THEN 'Bean' WHEN 1 THEN 'GetMapping' WHEN 2 THEN 'Autowired' WHEN 3 THEN 'ConditionalOnClass' ELSE 'Deprecated' END AS annotation FROM orders """,
    "api_changes": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'type_changed' WHEN 3 THEN 'signature_changed' ELSE 'visibility_changed' END AS verb,
        CASE o_custkey % 3 WHEN 0 THEN 'property' WHEN 1 THEN 'constant' ELSE 'interface' END AS kind, 'Menu.p' || CAST(o_custkey % 100 AS STRING) AS symbol,
        CASE o_custkey % 7 WHEN 0 THEN '''on''' WHEN 1 THEN '''a'' | ''b''' WHEN 2 THEN '@x/core' WHEN 3 THEN 'property: isOpen: boolean' WHEN 4 THEN 'packages/a/src/Menu.isOpen' WHEN 5 THEN 'Menu.size = sm' END AS before,
        CASE o_orderkey % 7 WHEN 0 THEN '''a'' | ''b'' | ''c''' WHEN 1 THEN '@x/core/next' WHEN 2 THEN 'constant: NEW_NAME: string' WHEN 3 THEN 'packages/a/src/deprecated/Menu.isOpen' WHEN 4 THEN 'Menu.size = small' WHEN 5 THEN 'Menu.open' END AS after,
        CASE o_custkey % 5 WHEN 0 THEN 'Prop was added to Menu' WHEN 1 THEN '--pf-v5-x became --pf-v6-x' WHEN 2 THEN 'x was deprecated and replaced by y' WHEN 3 THEN 'Base class changed from none to B' ELSE '' END AS description,
        CASE o_custkey % 4 WHEN 0 THEN 'src/deprecated/a.ts' ELSE 'src/a.ts' END AS file, CASE WHEN o_custkey % 11 = 0 THEN 'Toolbar' END AS target, CASE WHEN o_custkey % 9 = 0 THEN 'newProp' END AS disposition FROM orders """,
    "manifests": """SELECT CAST(o_orderkey AS STRING) AS case_id, '{"name": "n", "main": "a' || CAST(o_custkey % 3 AS STRING) || '.js", ' || CASE WHEN o_custkey % 2 = 0 THEN '"type": "module", ' ELSE '' END || '"peerDependencies": {"react": "' || CAST(o_custkey % 4 AS STRING) || '", "x' || CAST(o_custkey % 3 AS STRING) || '": "1"}, "engines": {"node": "' || CAST(o_custkey % 3 AS STRING) || '"}, "bin": ' || CASE WHEN o_custkey % 3 = 0 THEN '"cli.js"' ELSE '{"run": "r.js"}' END || ', "dependencies": {"d": "1"}}' AS old,
        '{"name": "n", ' || CASE WHEN o_orderkey % 5 > 0 THEN '"main": "a' || CAST(o_orderkey % 3 AS STRING) || '.js", ' ELSE '' END || '"module": "m.js", ' || CASE WHEN o_orderkey % 3 = 0 THEN '"type": "module", ' ELSE '' END || '"peerDependencies": {"react": "' || CAST(o_orderkey % 4 AS STRING) || '", "x' || CAST(o_orderkey % 3 AS STRING) || '": "1"}, "engines": {"node": "' || CAST(o_orderkey % 3 AS STRING) || '"}, "bin": {"run": "s.js"}, "dependencies": {"d": "2"}}' AS new FROM orders """,
    "imports": "SELECT 'f' || CAST(l_orderkey AS STRING) AS file, 's' || CAST(l_partkey AS STRING) AS symbol, 'm' || CAST(l_suppkey % 5 AS STRING) AS module FROM lineitem",
    "import_targets": "SELECT 's' || CAST(p_partkey AS STRING) AS symbol, 'm' || CAST(p_size % 5 AS STRING) AS module FROM part",
    "file_calls": "SELECT 'f' || CAST(l_partkey AS STRING) AS file, 'c' || CAST(l_suppkey % 9 AS STRING) AS caller, 'c' || CAST(l_orderkey % 9 AS STRING) AS callee FROM lineitem",
    "wanted_calls": "SELECT 'f' || CAST(p_partkey AS STRING) AS file, 'c' || CAST(p_size % 9 AS STRING) AS callee FROM part",
    "source_files": "SELECT 'r/p' || CAST(p_size % 9 AS STRING) || '/M' || CAST(p_partkey AS STRING) || '.tsx' AS file FROM part",
    "all_files": "SELECT 'r/p' || CAST((p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 9 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '/__tests__' ELSE '' END || '/M' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.test.tsx' ELSE '.spec.ts' END AS file FROM part",
    "commit_removed": "SELECT 'k' || CAST(l_orderkey AS STRING) AS commit, 'c' || CAST(l_partkey AS STRING) AS component FROM lineitem WHERE l_returnflag = 'R'",
    "commit_added": "SELECT 'k' || CAST(l_orderkey AS STRING) AS commit, 'd' || CAST(l_suppkey % 4 AS STRING) AS component FROM lineitem WHERE l_returnflag <> 'R'",
    "lost_props": "SELECT 'f' || CAST(l_suppkey AS STRING) AS family, 'C' || CAST(l_partkey % 20 AS STRING) AS component, 'p' || CAST(l_orderkey % 15 AS STRING) AS prop FROM lineitem WHERE l_returnflag = 'A'",
    "child_props": "SELECT 'f' || CAST(l_suppkey AS STRING) AS family, 'C' || CAST(l_orderkey % 20 AS STRING) AS component, 'p' || CAST(l_partkey % 15 AS STRING) AS prop FROM lineitem WHERE l_returnflag = 'N'",
    "pack_files": "SELECT 'r/p' || CAST(p_size AS STRING) || '/q' || CAST(p_partkey % 4 AS STRING) || '/f' || CAST(p_partkey AS STRING) || '.ts' AS file FROM part",
    "pack_dirs": "SELECT DISTINCT 'r/p' || CAST(p_size AS STRING) AS dir, 'one' || CAST(p_size AS STRING) AS package FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT 'r/p' || CAST(p_size AS STRING) || '/q1' AS dir, 'two' || CAST(p_size AS STRING) AS package FROM part WHERE p_size % 3 = 0",
    "barrel_changes": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'p/index.ts' ELSE 'p/f' || CAST(o_custkey AS STRING) || '.ts' END AS file, 's' || CAST(o_custkey % 900 AS STRING) AS symbol, o_orderstatus || CAST(o_orderkey % 4 AS STRING) AS change FROM orders",
    "moved_changes": "SELECT o_orderkey AS id, 'c' || CAST(o_custkey % 50 AS STRING) AS component, CASE WHEN o_custkey % 3 = 0 THEN 'p' || CAST(o_custkey % 7 AS STRING) END AS prop, CASE o_orderkey % 3 WHEN 0 THEN 'relocated' WHEN 1 THEN 'removed' ELSE 'changed' END AS change FROM orders",
    "replacements": "SELECT DISTINCT 'c' || CAST(s_suppkey % 30 AS STRING) AS old, 'n' || CAST(s_suppkey % 30 AS STRING) AS new FROM supplier",
    "helpers": "SELECT 'h' || CAST(s_suppkey AS STRING) AS function FROM supplier WHERE s_acctbal > 0",
    "bindings": "SELECT DISTINCT 'C' || CAST(l_partkey AS STRING) AS component, 'a' || CAST(l_linenumber AS STRING) AS attribute, 'h' || CAST(l_suppkey AS STRING) AS generator FROM lineitem",
    "own_props": "SELECT CAST(o_orderkey AS STRING) AS interface, 'p' || CAST(o_custkey % 9 AS STRING) AS prop FROM orders",
    "sigs": "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'a:string:r' WHEN 1 THEN 'a:string:r,b:number:o' WHEN 2 THEN '' WHEN 3 THEN 'a:string:r,b:number:r,c:Foo:o' ELSE 'x:Foo:o,rest:any:v' END AS old_sig, CASE p_partkey % 5 WHEN 0 THEN 'a:string:o' WHEN 1 THEN 'a:Bar:r,b:number:r' WHEN 2 THEN 'a:string:r,q:number:o,c:Foo:o,d:Foo:o' WHEN 3 THEN 'z:string:r,rest:any:v' ELSE '' END AS new_sig FROM part",
    "texts": "SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'menuToggleItem' WHEN 1 THEN 'MenuToggle' WHEN 2 THEN 'menu-toggle-item' WHEN 3 THEN 'pf-v5-c-menu' WHEN 4 THEN 'c_button_Color' WHEN 5 THEN 'Some  Text, here!' ELSE 'global_SIZE_SM' END AS s, CASE p_partkey % 4 WHEN 0 THEN 'Map<string, Foo<Bar>> | null' WHEN 1 THEN '''a'' | ''b'' | Foo' WHEN 2 THEN '(name: string, age: number) => FooBar' ELSE 'string' END AS t FROM part",
    "functions_old": "SELECT 'f' || CAST(p_size AS STRING) AS file, 'n' || CAST(p_partkey AS STRING) AS name, 'a ' || CAST(p_size % 3 AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ' // note' ELSE '' END AS body FROM part WHERE p_partkey % 11 <> 0",
    "functions_new": "SELECT 'f' || CAST(p_size AS STRING) AS file, 'n' || CAST(p_partkey AS STRING) AS name, '  a ' || CAST(p_partkey % 3 AS STRING) || ' ' AS body FROM part WHERE p_partkey % 13 <> 0",
    "behaviours": "SELECT 's' || CAST(o_custkey AS STRING) AS symbol, o_orderkey AS seq, o_orderpriority AS description FROM orders",
    "conditions": "SELECT 'r' || CAST(o_orderkey AS STRING) AS rule_id, 'c' || CAST(o_custkey AS STRING) AS condition, o_orderstatus AS label, o_orderkey % 9 = 0 AS has_codemod FROM orders",
    "symbol_changes": "SELECT 'f' || CAST(o_custkey AS STRING) AS file, 's' || CAST(o_orderkey AS STRING) AS symbol, o_orderstatus AS change, o_orderkey % 2 = 0 AS is_breaking FROM orders",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its base tables are read from ``sf_dir``."""
    tables = [t for t in ("part", "lineitem", "orders", "supplier") if f"FROM {t}" in SQL[name]]
    sql = SQL[name].replace("GROUP BY ALL", "GROUP BY 1, 2").replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if sql.startswith("SELECT DISTINCT ") and " UNION " not in sql:
        # Made distinct here, in partitions by size.
        every = spark.sql(sql.replace("SELECT DISTINCT ", "SELECT ", 1), **read)
        return parted(every, *every.columns).distinct()
    return spark.sql(sql, **read)


def with_(*names: str) -> str:
    """The derived tables as common table expressions of an oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
