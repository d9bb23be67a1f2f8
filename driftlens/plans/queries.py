"""One query per operator family, and its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, facets, graph, matching, report
from .derived import derived, with_

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(*tables: str, oracle: str | None = None):
    """Register a function of derived tables (or, by ``@``, of base tables) under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda t: spark.read.parquet(f"{sf_dir}/{t[1:]}.parquet") if t[0] == "@" else derived(spark, sf_dir, t)
            return f(*map(read, tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            names = [t for t in tables if t[0] != "@"]
            ORACLE_SQL[f.__name__] = f"{with_(*names)}{oracle}" if names else oracle.lstrip(", ")
        return f

    return register


_MATCH = """, pairs AS (SELECT coalesce(o.qualified_name, n.qualified_name) AS qualified_name,
    CASE WHEN n.qualified_name IS NULL THEN 'removed' WHEN o.qualified_name IS NULL THEN 'added' WHEN o.return_type IS DISTINCT FROM n.return_type THEN 'changed' END AS change,
    o.return_type AS before, n.return_type AS after
    FROM old_symbols o FULL JOIN new_symbols n ON o.qualified_name = n.qualified_name)"""


@query("old_symbols", "new_symbols", oracle=_MATCH + " SELECT qualified_name, change, before, after, change <> 'added' AS is_breaking FROM pairs WHERE change IS NOT NULL")
def surface_diff_exact(old, new):
    return matching.exact_diff(old, new, "qualified_name", "return_type")


@query("old_symbols", "new_symbols", oracle=_MATCH + " SELECT change, count(*) AS n, count(*) FILTER (WHERE change <> 'added') AS breaking FROM pairs WHERE change IS NOT NULL GROUP BY change")
def surface_summary_by_verb(old, new):
    return report.summary(matching.exact_diff(old, new, "qualified_name", "return_type"))


_SIDES = """, removed AS (SELECT * FROM old_symbols o WHERE NOT EXISTS (FROM new_symbols n WHERE n.qualified_name = o.qualified_name)),
    added AS (SELECT * FROM new_symbols n WHERE NOT EXISTS (FROM old_symbols o WHERE o.qualified_name = n.qualified_name))"""


def _sides(old, new):
    return matching.unmatched(old, new, "qualified_name"), matching.unmatched(new, old, "qualified_name")


@query("old_symbols", "new_symbols", oracle=_SIDES + """ SELECT r.qualified_name AS old, a.qualified_name AS new FROM removed r JOIN added a
    ON r.qualified_name = replace(a.qualified_name, '/deprecated/', '/') AND r.kind = a.kind""")
def relocation_match(old, new):
    return matching.relocate(*_sides(old, new))


_BLOCK = ["kind", "package", "return_type"]


@query("old_symbols", "new_symbols", oracle=_SIDES + """, a AS (SELECT *, count(*) OVER (PARTITION BY kind, package, return_type) AS n_old FROM removed),
    b AS (SELECT *, count(*) OVER (PARTITION BY kind, package, return_type) AS n_new FROM added)
    SELECT a.qualified_name AS old, b.qualified_name AS new, a.name AS old_name, b.name AS new_name, n_old, n_new FROM a JOIN b
    ON a.kind = b.kind AND a.package = b.package AND a.return_type IS NOT DISTINCT FROM b.return_type WHERE n_old <= 50 AND n_new <= 50""")
def rename_fingerprint_candidates(old, new):
    return matching.fingerprint_pairs(*_sides(old, new), _BLOCK)


def _scored(old, new):
    pairs = matching.fingerprint_pairs(*_sides(old, new), _BLOCK)
    return pairs.withColumn("score", F.round(T.name_similarity("old_name", "new_name"), 6))


@query("old_symbols", "new_symbols")
def rename_lcs_score(old, new):
    return _scored(old, new).select("old", "new", "score")


@query("old_symbols", "new_symbols")
def rename_greedy_match(old, new):
    return matching.greedy_assignment(matching.rename_candidates(*_sides(old, new)))


@query("old_symbols", "new_symbols", oracle=_SIDES + """, a AS (SELECT *, count(*) OVER (PARTITION BY kind, package, return_type) AS n_old FROM removed),
    b AS (SELECT *, count(*) OVER (PARTITION BY kind, package, return_type) AS n_new FROM added),
    pairs AS (SELECT a.qualified_name AS old, b.qualified_name AS new, a.name AS old_name, b.name AS new_name, regexp_extract(a.qualified_name, '^(.*)/[^/]*$', 1) AS d0, regexp_extract(b.qualified_name, '^(.*)/[^/]*$', 1) AS d1
      FROM a JOIN b ON a.kind = b.kind AND a.package = b.package AND a.return_type IS NOT DISTINCT FROM b.return_type WHERE n_old <= 50 AND n_new <= 50),
    counted AS (SELECT *, count(*) OVER (PARTITION BY d0, d1) AS n FROM pairs)
    SELECT old, new, old_name, new_name FROM counted WHERE d0 = d1 OR n > 1 OR old_name = new_name""")
def rename_sibling_guard(old, new):
    return matching.sibling_guard(matching.fingerprint_pairs(*_sides(old, new), _BLOCK).select("old", "new", "old_name", "new_name"))


@query("old_tokens", "new_tokens", oracle=""", a AS (SELECT name AS old, list_distinct(string_split(lower(name), '_')) AS s FROM old_tokens),
    b AS (SELECT name AS new, list_distinct(string_split(lower(name), '_')) AS t FROM new_tokens),
    p AS (SELECT old, new, len(list_intersect(s, t)) AS shared, len(s) AS n, len(s) + len(t) - len(list_intersect(s, t)) AS u FROM a, b)
    SELECT old, new, CAST(shared AS BIGINT) AS shared, round(shared / u, 6) AS score FROM p WHERE shared / u >= 0.6 AND shared >= greatest(2, ceil(n * 0.6 - 1e-9))""")
def token_jaccard_pairs(old, new):
    return matching.token_pairs(old, new).withColumn("score", F.round("score", 6))


@query("old_members", "new_members", oracle=""", o AS (SELECT * FROM old_members WHERE parent IN (SELECT parent FROM new_members)),
    n AS (SELECT * FROM new_members WHERE parent IN (SELECT parent FROM old_members)),
    d AS (SELECT coalesce(o.parent, n.parent) AS parent, coalesce(o.member, n.member) AS member,
      CASE WHEN n.parent IS NULL THEN 'removed' WHEN o.parent IS NULL THEN 'added' WHEN o.type IS DISTINCT FROM n.type THEN 'changed' END AS change, o.type AS before, n.type AS after
      FROM o FULL JOIN n ON o.parent = n.parent AND o.member = n.member)
    SELECT * FROM d WHERE change IS NOT NULL""")
def member_diff(old, new):
    return compare.member_diff(old, new)


@query("removed_containers", "new_containers", oracle=""", a AS (SELECT *, count(*) OVER (PARTITION BY family, container) AS n_old FROM (SELECT DISTINCT * FROM removed_containers)),
    b AS (SELECT *, count(*) OVER (PARTITION BY family, container) AS n_new FROM (SELECT DISTINCT * FROM new_containers)),
    p AS (SELECT a.family, a.container AS old, b.container AS new, n_old, n_new, count(*) AS shared FROM a JOIN b ON a.family = b.family AND a.member = b.member GROUP BY ALL),
    q AS (SELECT *, greatest(shared / n_old, shared / n_new) AS ratio FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY family, old ORDER BY ratio DESC, new) AS k FROM q
      WHERE ratio >= 0.25 AND shared >= CASE WHEN n_old <= 3 THEN 1 WHEN n_old <= 6 THEN 2 ELSE 3 END)
    SELECT family, old, new, shared, round(ratio, 6) AS ratio FROM r WHERE k = 1""")
def migration_best_target(old, new):
    return matching.migration_targets(old, new).withColumn("ratio", F.round("ratio", 6))


@query("@part", oracle="""WITH t AS (SELECT p_partkey, [p_brand, p_type, p_name] AS o, [p_brand, p_name, 'v' || p_size] AS n FROM part)
    SELECT p_partkey, unnest(list_filter(list_distinct(o), lambda x: NOT list_contains(n, x))) AS value, 'removed' AS change, true AS is_breaking FROM t
    UNION ALL SELECT p_partkey, unnest(list_filter(list_distinct(n), lambda x: NOT list_contains(o, x))), 'added', false FROM t""")
def union_value_diff(part):
    quoted = lambda *cs: F.concat_ws(" | ", *[F.concat(F.lit("'"), c, F.lit("'")) for c in cs])
    size = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    pairs = part.select("p_partkey", quoted(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("o"), quoted(F.col("p_brand"), F.col("p_name"), size).alias("n"))
    return compare.union_value_diff(pairs, "p_partkey", "o", "n")


@query("type_members", oracle=""", g AS (SELECT package, type, count(*) AS members, count(*) FILTER (WHERE change = 'removed') AS removed, count(change) AS touched FROM type_members GROUP BY ALL)
    SELECT package, type, members, removed, round(removed / members, 6) AS removal_ratio,
      CASE WHEN removed / members > 0.5 AND removed >= 3 THEN 'removed' WHEN touched > 0 THEN 'modified' ELSE 'same' END AS status FROM g""")
def type_removal_rollup(members):
    return report.removal_rollup(members)


@query("constant_changes", oracle=" SELECT package, change, strategy, count(*) AS n, min(symbol) AS first_symbol FROM constant_changes WHERE strategy <> 'ImportPathChange' GROUP BY ALL HAVING count(*) >= 10")
def constant_group_collapse(changes):
    return report.constant_groups(changes)


@query("old_classes", "new_classes", oracle=""", c AS (SELECT regexp_extract(class, '^([a-z]+-v[0-9]+)-', 1) AS prefix, count(*) AS n FROM (FROM old_classes UNION ALL FROM new_classes) GROUP BY ALL)
    SELECT 'all' AS scope, prefix, n FROM c ORDER BY n DESC, prefix LIMIT 1""")
def majority_prefix(old, new):
    classes = old.unionByName(new).select(F.lit("all").alias("scope"), T.version_prefix("class").alias("prefix"))
    return report.majority(classes, ["scope"], "prefix")


@query("old_classes", "new_classes", oracle=" SELECT class, replace(class, 'pf-v5-', 'pf-v6-') AS swapped FROM old_classes WHERE replace(class, 'pf-v5-', 'pf-v6-') NOT IN (SELECT class FROM new_classes)")
def dead_class_after_swap(old, new):
    return report.dead_classes(old, new, "pf-v5-", "pf-v6-")


@query("old_classes", "new_classes", oracle=""" SELECT o.class, n.class AS target, CASE WHEN n.class IS NULL THEN 'Manual' ELSE 'Rename' END AS strategy
    FROM old_classes o LEFT JOIN new_classes n ON n.class = replace(o.class, 'pf-v5-', 'pf-v6-')""")
def class_rename_rules(old, new):
    return report.class_rules(old, new, "pf-v5-", "pf-v6-")


def _tags(pages, shift: int):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return pages.select((F.col("page_id") - shift).alias("page"), tags.alias("tag"))


@query("@pages", oracle="""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages),
    c AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL),
    d AS (SELECT coalesce(a.page_id, b.page_id - 1) AS page, coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new FROM c a FULL JOIN c b ON b.page_id = a.page_id + 1 AND a.tag = b.tag)
    SELECT *, n_new - n_old AS delta FROM d WHERE n_old <> n_new""")
def element_count_delta(pages):
    return facets.counts_delta(_tags(pages, 0), _tags(pages, 1), ["page", "tag"])


@query("@pages", oracle="""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '((?:href|class)="[^"]*")', 1)) AS element FROM pages),
    both_ AS (SELECT a.page_id FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)
    SELECT page_id, element, 'removed' AS change FROM r WHERE page_id IN (FROM both_) AND NOT EXISTS (FROM r x WHERE x.page_id = r.page_id + 1 AND x.element = r.element)
    UNION ALL SELECT page_id - 1, element, 'added' FROM r WHERE page_id - 1 IN (FROM both_) AND NOT EXISTS (FROM r x WHERE x.page_id = r.page_id - 1 AND x.element = r.element)""")
def attribute_reference_diff(pages):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('((?:href|class)="[^"]*")'), F.lit(1)))
    old = pages.select("page_id", found.alias("a"))
    new = pages.select((F.col("page_id") - 1).alias("page_id"), found.alias("b"))
    return facets.set_diff(old.join(new, "page_id"), "page_id", F.col("a"), F.col("b"))


@query("@events", oracle="""WITH f AS (SELECT user_id, arg_min(props, event_id) AS o, arg_max(props, event_id) AS n FROM events GROUP BY user_id),
    k AS (SELECT user_id, unnest(json_keys(o)) AS field, o FROM f), m AS (SELECT user_id, unnest(json_keys(n)) AS field, n FROM f),
    d AS (SELECT coalesce(k.user_id, m.user_id) AS user_id, coalesce(k.field, m.field) AS field, json_extract_string(k.o, k.field) AS before, json_extract_string(m.n, m.field) AS after
      FROM k FULL JOIN m ON k.user_id = m.user_id AND k.field = m.field)
    SELECT user_id, field, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change, before, after FROM d WHERE before IS DISTINCT FROM after""")
def manifest_map_diff(events):
    pairs = events.groupBy("user_id").agg(F.min_by("props", "event_id").alias("o"), F.max_by("props", "event_id").alias("n"))
    as_map = lambda c: F.from_json(c, "map<string,string>")
    return facets.map_diff(pairs.select("user_id", as_map("o").alias("a"), as_map("n").alias("b")), "user_id", "a", "b")


@query("@documents", oracle=r"""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
    SELECT file, CAST(n AS INTEGER) AS n, 'added' AS change, trim(line) AS line FROM l WHERE regexp_matches(line, '(that|than) ')""")
def line_assertion_delta(documents):
    """Every line counts as added, since the texts are no diffs."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x))
    diffs = documents.select(F.col("doc_id").alias("file"), F.array_join(lines, "\n").alias("diff"))
    return facets.assertion_lines(diffs, "(that|than) ")


@query("calls", "changed", "functions", oracle=""", up AS (SELECT DISTINCT caller, callee, is_public FROM calls JOIN functions ON name = caller WHERE caller <> callee),
    walk(root, at_, is_public) AS (SELECT root, root, false FROM changed UNION SELECT w.root, u.caller, u.is_public FROM walk w JOIN up u ON u.callee = w.at_ WHERE NOT w.is_public)
    SELECT root, at_ AS broken, round(confidence * 0.9, 6) AS confidence FROM walk JOIN changed USING (root) WHERE is_public""")
def call_graph_walkup(calls, changed, functions):
    return graph.walk_up(calls, changed, functions).select("root", "broken", F.round("confidence", 6).alias("confidence"))


@query("calls", "functions", oracle=""", walk(node) AS (SELECT name FROM functions WHERE is_public UNION SELECT callee FROM walk JOIN calls ON caller = node) SELECT node FROM walk""")
def reachability(calls, functions):
    """What public functions call, at any depth."""
    roots = functions.where("is_public").select(F.col("name").alias("node"))
    return graph.reachable(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), roots).select("node")


@query("extends", "flagged", oracle=", walk(node) AS (SELECT node FROM flagged UNION SELECT child FROM walk JOIN extends ON parent = node) SELECT node FROM walk")
def transitive_closure(extends, flagged):
    return graph.closure_of_flag(extends, flagged)


@query("signals", oracle=""" SELECT family, parent, child, bool_or(chp) AS chp, bool_or(pmc) AS pmc, CASE WHEN bool_or(relationship = 'internal') THEN 'internal' WHEN bool_or(relationship = 'prop_passed') THEN 'prop_passed' ELSE 'direct_child' END AS relationship,
    coalesce(string_agg(evidence, ' + ' ORDER BY ordinal), '') AS evidence, arg_max(prop_name, ordinal) FILTER (WHERE prop_name IS NOT NULL) AS prop_name FROM signals GROUP BY family, parent, child""")
def edge_strength_combine(signals):
    return graph.combine_edges(signals)


@query("signals", oracle=""", e AS (SELECT DISTINCT family, parent, child FROM signals WHERE chp)
    SELECT DISTINCT a.family, a.parent, a.child AS middle, b.child FROM e a JOIN e b ON a.family = b.family AND a.child = b.parent
    WHERE a.parent <> b.child AND NOT EXISTS (FROM e x WHERE x.family = a.family AND x.parent = a.parent AND x.child = b.child)""")
def conformance_two_hop(signals):
    return graph.two_hop_violations(signals.where("chp").select("family", "parent", "child").distinct())


@query("signals", oracle=""", e AS (SELECT family, parent, child, bool_or(chp) AS chp, bool_or(pmc) AS pmc FROM signals GROUP BY ALL), r AS (SELECT *, CASE WHEN chp AND pmc THEN 3 WHEN pmc THEN 2 WHEN chp THEN 1 ELSE 0 END AS strength FROM e),
    i AS (SELECT family, child AS node, count(*) AS n FROM e WHERE chp GROUP BY ALL), two AS (SELECT f.family, f.parent, f.child, f.strength AS fs, b.strength AS bs, x.n AS fin, y.n AS bin FROM r f JOIN r b ON f.chp AND b.chp AND b.family = f.family AND b.parent = f.child AND b.child = f.parent AND f.parent <= f.child
      JOIN i x ON x.family = f.family AND x.node = f.child JOIN i y ON y.family = f.family AND y.node = f.parent),
    lost AS (SELECT family, CASE WHEN fs < bs OR (fs = bs AND fin < bin) THEN parent ELSE child END AS parent, CASE WHEN fs < bs OR (fs = bs AND fin < bin) THEN child ELSE parent END AS child FROM two)
    SELECT family, parent, child, chp AND l.family IS NULL AS chp, pmc AND l.family IS NULL AS pmc FROM e LEFT JOIN (SELECT *, family AS f2 FROM lost) l USING (family, parent, child)""".replace("l.family IS NULL", "l.f2 IS NULL"))
def two_way_downgrade(signals):
    return graph.drop_two_way(graph.combine_edges(signals).select("family", "parent", "child", "chp", "pmc"))


@query("behaviour", "renders", oracle=" SELECT DISTINCT host, component AS via, category FROM behaviour JOIN renders USING (component) WHERE host <> component")
def propagate_one_level(behaviour, renders):
    return graph.propagate_one_level(behaviour, renders)


@query("stopped", "started", oracle=""", p AS (SELECT s.component AS old, t.component AS new, count(DISTINCT host) AS hosts FROM stopped s JOIN started t USING (host) WHERE s.component <> t.component GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY hosts DESC, (old LIKE '%Group') = (new LIKE '%Group') DESC, new) AS k FROM p) SELECT old, new, hosts FROM r WHERE k = 1""")
def swap_replacement(stopped, started):
    return matching.swap_replacements(stopped, started)


@query("rules", oracle=" SELECT key, min(rule_id) AS rule_id, count(*) AS merged, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(effort) AS effort FROM rules GROUP BY key")
def rule_consolidation(rules):
    out = report.consolidate(rules.withColumn("labels", F.array("label")))
    return out.withColumn("labels", F.array_join("labels", ","))


@query("rules", oracle=" SELECT rule_id, min(rule_id) OVER (PARTITION BY key) AS merged_id FROM rules")
def rule_id_mapping(rules):
    return report.id_mapping(rules)


@query("rules", oracle=" SELECT rule_id, key, label FROM rules r WHERE NOT EXISTS (FROM rules b WHERE b.effort = 6 AND b.key = r.key AND b.label = r.label)")
def rule_suppression(rules):
    return report.suppress(rules, rules.where("effort = 6"), ["key", "label"]).select("rule_id", "key", "label")


@query("rules", oracle=""" SELECT rule_id, key, CASE WHEN k = 1 THEN key ELSE key || '-' || k END AS unique_id
    FROM (SELECT rule_id, key, row_number() OVER (PARTITION BY key ORDER BY rule_id) AS k FROM rules)""")
def id_suffixing(rules):
    return report.unique_ids(rules, "key", ["rule_id"]).select("rule_id", "key", "unique_id")


@query("file_changes", oracle=""" SELECT file, name, change FROM file_changes c WHERE name <> 'default'
    OR NOT EXISTS (FROM file_changes n WHERE n.name <> 'default' AND n.file = c.file AND n.change = c.change)""")
def default_export_dedupe(changes):
    return matching.default_export_dedupe(changes)


_RANK = "CASE {} WHEN 'private' THEN 0 WHEN 'protected' THEN 2 WHEN 'public' THEN 3 ELSE 4 END"


@query("matched", oracle=f""" SELECT id, 'visibility' AS change, {_RANK.format('new_visibility')} < {_RANK.format('old_visibility')} AS is_breaking,
    old_visibility AS before, new_visibility AS after FROM matched WHERE old_visibility <> new_visibility""")
def visibility_diff(matched):
    return compare.visibility_diff(matched, "id")


_MOD = "SELECT id, '{m}' AS change, {b} AS is_breaking, CAST(old_{m} AS STRING) AS before, CAST(new_{m} AS STRING) AS after FROM matched WHERE old_{m} IS DISTINCT FROM new_{m}"


@query("matched", oracle=" " + " UNION ALL ".join(_MOD.format(m=m, b=b) for m, b in (("readonly", "new_readonly"), ("abstract", "new_abstract"), ("static", "true"), ("accessor", "true"))))
def modifier_diff(matched):
    return compare.modifier_diff(matched, "id")


@query("matched", oracle=""" SELECT id, c AS change, c <> 'signature_added' AS is_breaking, old_return AS before, new_return AS after FROM (SELECT *, CASE
    WHEN old_has_signature AND NOT new_has_signature THEN 'signature_removed' WHEN NOT old_has_signature AND new_has_signature THEN 'signature_added'
    WHEN NOT old_has_signature OR old_return = new_return THEN NULL WHEN new_return = 'Promise<' || old_return || '>' THEN 'made_async' ELSE 'return_type' END AS c FROM matched) WHERE c IS NOT NULL""")
def signature_diff(matched):
    return compare.signature_diff(matched, "id")


@query("matched", oracle=" SELECT id, 'extends' AS change, true AS is_breaking, old_extends AS before, new_extends AS after FROM matched WHERE old_extends IS DISTINCT FROM new_extends")
def hierarchy_diff(matched):
    none = F.lit(None).cast("array<string>")
    return compare.hierarchy_diff(matched.withColumns({"old_implements": none, "new_implements": none}), "id")
