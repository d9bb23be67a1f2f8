import pytest
from pyspark.sql import functions as F

from driftlens.operators import compare, facets, graph, matching, profiles, report


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact_diff(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "k string, v string")
    new = spark.createDataFrame([("a", "y"), ("c", None), ("d", "z")], "k string, v string")
    got = {(r.k, r.change, r.is_breaking) for r in matching.exact_diff(old, new, "k", "v").collect()}
    assert got == {("a", "changed", True), ("b", "removed", True), ("d", "added", False)}


def test_relocation_prefers_names_and_uses_each_once(spark):
    schema = "qualified_name string, kind string, name string"
    old = spark.createDataFrame([("p/a.X", "class", "X"), ("p/b.Y", "class", "Y")], schema)
    new = spark.createDataFrame([("p/deprecated/a.X", "class", "X"), ("p/next/b.Y", "type", "Y")], schema)
    assert rows(matching.relocate(old, new)) == [("p/a.X", "p/deprecated/a.X")]


def test_greedy_assignment_equals_the_walk(spark):
    import random

    r = random.Random(3)
    pairs = [(f"o{i}", f"n{j}", round(r.random(), 1)) for i in range(12) for j in range(12) if r.random() < 0.4]
    want, used_a, used_b = [], set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            want.append((a, b, s))
            used_a.add(a)
            used_b.add(b)
    assert rows(matching.greedy_assignment(spark.createDataFrame(pairs, "old string, new string, score double"))) == sorted(want)


def test_rename_passes(spark):
    schema = "qualified_name string, name string, kind string, package string, return_type string, file string"
    sym = lambda parent, name, kind, t, file="d/f": (f"{file}.{parent}.{name}", name, kind, "p", t, file)
    old = [
        sym("A", "chips", "property", "ToolbarChip[]"),
        sym("A", "spacer", "method", "{ a: 'spacerNone' | 'spacerSm' }"),
        sym("A", "splitButtonOptions", "property", "SplitOptions"),
        *[sym("B", f"isOld{k}", "method", "Foo<string>") for k in "XYZ"],
        sym("C", "header", "class", "number[]", "d/f"),
        *[sym("D", n, "field", "boolean") for n in ("isDisabled", "qqqq", "wwww")],
    ]
    new = [
        sym("A", "chipLabels", "property", "ToolbarLabel[]"),
        sym("A", "spaces", "method", "{ b: 'gapNone' | 'gapSm' | 'gapXl' }"),
        sym("A", "splitButtonItems", "property", "ReactNode[] | string"),
        *[sym("B", f"hasNew{k}", "method", "Foo<string>") for k in "XYZ"],
        sym("C", "reader", "class", "number[]", "e/f"),
        sym("C", "hex", "class", "string[]", "e/f"),
        sym("D", "hasAnimations", "field", "boolean"),
    ]
    got = matching.greedy_assignment(matching.rename_candidates(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)))
    short = lambda q: q.rsplit(".", 1)[1]
    assert sorted((short(r.old), short(r.new)) for r in got.collect()) == sorted(
        [("chips", "chipLabels"), ("spacer", "spaces"), ("splitButtonOptions", "splitButtonItems"), ("header", "reader")] + [(f"isOld{k}", f"hasNew{k}") for k in "XYZ"]
    )


def test_token_pairs_equal_all_pairs(spark):
    old = spark.createDataFrame([("a_b_c",), ("a_b_d_e",), ("z",)], "name string")
    new = spark.createDataFrame([("a_b_x",), ("a_b_c_y",), ("z",)], "name string")
    assert [r[:2] for r in rows(matching.token_pairs(old, new))] == [("a_b_c", "a_b_c_y")]


def test_migration_target(spark):
    old = spark.createDataFrame([("f", "Header", m) for m in ("children", "className", "headingLevel", "icon", "titleClassName", "titleText")], "family string, container string, member string")
    new = spark.createDataFrame([("f", "State", m) for m in ("titleText", "headingLevel", "icon", "status", "titleClassName", "headerClassName")], old.schema)
    got = matching.migration_targets(old, new).first()
    assert (got.old, got.new, got.shared) == ("Header", "State", 4)


def test_parameters(spark):
    p = "array<struct<name:string,type:string,optional:boolean,variadic:boolean>>"
    df = spark.createDataFrame([("f", [("a", "string", True, False)], [("a", "number", False, False), ("b", "string", True, False), ("r", "any", False, True)])], f"q string, old_params {p}, new_params {p}")
    got = {(r.change, r.is_breaking) for r in compare.parameter_diff(df, "q").collect()}
    assert got == {("parameter_type", True), ("parameter_required", True), ("parameter_added", False), ("variadic_added", False)}


def test_type_parameters_reordered(spark):
    p = "array<struct<name:string,constraint:string,default:string>>"
    df = spark.createDataFrame([("f", [("A", None, None), ("B", None, None)], [("B", None, None), ("A", None, None)])], f"q string, old_types {p}, new_types {p}")
    assert [r.change for r in compare.type_parameter_diff(df, "q").collect()] == ["type_parameters_reordered"]


def test_walk_up_stops_at_public_and_survives_cycles(spark):
    calls = spark.createDataFrame([("b", "a"), ("a", "b"), ("P", "b"), ("Q", "P")], "caller string, callee string")
    functions = spark.createDataFrame([("a", False), ("b", False), ("P", True), ("Q", True)], "name string, is_public boolean")
    changed = spark.createDataFrame([("a", 1.0)], "root string, confidence double")
    assert rows(graph.walk_up(calls, changed, functions)) == [("a", "P", pytest.approx(0.9), 2)]


def test_reachable_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert rows(graph.reachable(edges, spark.createDataFrame([(1,)], "node long"))) == [(1, 0), (2, 1), (3, 2)]


def test_loops_never_return_a_part(spark):
    chain = [(i, i + 1) for i in range(6)]
    edges, one = spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    calls = spark.createDataFrame([(str(b), str(a)) for a, b in chain], "caller string, callee string")
    functions = spark.createDataFrame([(str(i), i == 6) for i in range(7)], "name string, is_public boolean")
    changed = spark.createDataFrame([("0", 1.0)], "root string, confidence double")
    ties = spark.createDataFrame([(f"o{i}", f"n{j}", 1.0) for i in range(5) for j in (i - 1, i) if j >= 0], "old string, new string, score double")
    inner = spark.createDataFrame([("f", str(a), str(b), True, True) for a, b in chain], "family string, parent string, child string, chp boolean, pmc boolean")
    ends = spark.createDataFrame([("f", "0"), ("f", "6")], "family string, node string")
    for part in (
        lambda: graph.reachable(edges, one, max_depth=3),
        lambda: graph.walk_up(calls, changed, functions, max_depth=3),
        lambda: graph.collapse_internal(inner, ends, max_depth=3),
        lambda: matching.greedy_assignment(ties, rounds=2),
    ):
        with pytest.raises(RuntimeError, match="not finished"):
            part()
    assert len(rows(graph.reachable(edges, one))) == 7
    assert len(rows(matching.greedy_assignment(ties))) == 5


def test_assertion_lines_are_whole(spark):
    long = "expect(" + "x" * (1 << 20) + ")"
    diffs = spark.createDataFrame([("f", f"+{long}\n-{long}")], "file string, diff string")
    assert [r.line == long for r in facets.assertion_lines(diffs, "expect").collect()] == [True, True]


def test_closure(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(2, 12)] + [(21, 20), (20, 21)], "child long, parent long")
    assert rows(graph.closure_of_flag(parents, spark.createDataFrame([(5,)], "node long"))) == [(i,) for i in range(5, 12)]


def test_collapse_internal(spark):
    edges = spark.createDataFrame([("f", "A", "i", False, True), ("f", "i", "B", True, False), ("f", "A", "C", True, True)], "family string, parent string, child string, chp boolean, pmc boolean")
    exported = spark.createDataFrame([("f", n) for n in "ABC"], "family string, node string")
    assert rows(graph.collapse_internal(edges, exported)) == [("f", "A", "B", True, False), ("f", "A", "C", True, True)]
    # A hop whose parent doesn't need its child makes the path allowed; one that does hands on what follows.
    hop = lambda a, b: spark.createDataFrame([("f", "A", "i", *a), ("f", "i", "B", *b)], edges.schema)
    required, structural, wrapper = (True, True), (True, False), (False, True)
    assert rows(graph.collapse_internal(hop(structural, required), exported)) == [("f", "A", "B", False, False)]
    assert rows(graph.collapse_internal(hop(required, wrapper), exported)) == [("f", "A", "B", False, True)]


def test_two_way_edges_keep_the_stronger(spark):
    schema = "family string, parent string, child string, chp boolean, pmc boolean"
    edges = spark.createDataFrame([("f", "A", "B", True, True), ("f", "B", "A", True, False), ("g", "A", "B", True, False), ("g", "B", "A", True, False), ("g", "C", "B", True, False)], schema)
    got = {(r.family, r.parent, r.child): (r.chp, r.pmc) for r in graph.drop_two_way(edges).collect()}
    assert got[("f", "A", "B")] == (True, True) and got[("f", "B", "A")] == (False, False)
    # Of equals the edge into the child that more edges bind stays.
    assert got[("g", "A", "B")] == (True, False) and got[("g", "B", "A")] == (False, False)


def test_combined_edge_takes_the_most_telling_relationship(spark):
    rows_ = [("f", "A", "B", True, False, "direct_child", "x", 2, None), ("f", "A", "B", False, True, "prop_passed", "y", 1, "p"), ("f", "A", "C", False, False, "prop_passed", None, 1, None), ("f", "A", "C", False, False, "internal", "z", 2, None)]
    signals = spark.createDataFrame(rows_, "family string, parent string, child string, chp boolean, pmc boolean, relationship string, evidence string, ordinal long, prop_name string")
    assert rows(graph.combine_edges(signals)) == [("f", "A", "B", True, True, "prop_passed", "y + x", "p"), ("f", "A", "C", False, False, "internal", "z", None)]


def test_levels(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, dep string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert rows(graph.levels(deps, nodes)) == [("a", 0), ("b", 1), ("c", 2)]


def test_manifest(spark):
    old = '{"main": "a.js", "peerDependencies": {"react": "17"}, "exports": {".": {"import": "./a.mjs"}}}'
    new = '{"main": "b.js", "type": "module", "peerDependencies": {"react": "18"}, "exports": {".": {"import": "./b.mjs"}}}'
    df = spark.createDataFrame([(1, old, new)], "case int, old string, new string")
    got = {(r.field, r.is_breaking, r.before, r.after) for r in facets.manifest_diff(df, "case").collect()}
    assert got == {("main", True, "a.js", "b.js"), ("type", True, "commonjs", "module"), ("peerDependencies.react", True, "17", "18"), ("exports..#import", True, "./a.mjs", "./b.mjs")}


def test_build_files(spark):
    pom = "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>"
    gradle = "implementation 'g:a:1'\napi(\"h:b:2\")"
    df = spark.createDataFrame([(pom, gradle)], "pom string, gradle string")
    got = df.select(facets.pom_dependencies(F.col("pom")).alias("p"), facets.gradle_dependencies(F.col("gradle")).alias("g")).first()
    assert (got.p, got.g) == ({"g:a": "1"}, {"g:a": "1", "h:b": "2"})


def test_rules(spark):
    rules = spark.createDataFrame([("r1", "k", ["a"], 1, "c", False), ("r2", "k", ["b", "a"], 3, "c", False), ("r3", "k", ["z"], 1, "c", True)], "rule_id string, key string, labels array<string>, effort int, condition string, has_codemod boolean")
    one = report.consolidate(rules).first()
    assert (one.rule_id, one.merged, one.labels, one.effort) == ("r1", 3, ["a", "b", "z"], 3)
    assert sorted(r.rule_id for r in report.merge_conditions(rules).collect()) == ["r1", "r3"]
    ids = [r.unique_id for r in report.unique_ids(rules, "key", ["rule_id"]).orderBy("rule_id").collect()]
    assert ids == ["k", "k-2", "k-3"]


def test_java_classes(spark):
    schema = "qualified_name string, is_final boolean, is_sealed boolean, permits array<string>, extends string, implements array<string>, constructor_params array<string>"
    old = spark.createDataFrame([("C", False, True, ["P", "Q"], "A", ["I", "J"], [])], schema)
    new = spark.createDataFrame([("C", True, True, ["P"], "B", ["I"], ["X"])], schema)
    got = sorted((r.category, r.is_breaking) for r in profiles.java_class_changes(old, new).collect())
    assert got == [("final_added", True), ("inheritance_changed", True), ("inheritance_changed", True), ("sealed_changed", True)]


def test_empty_tables(spark):
    schema = "qualified_name string, kind string, name string"
    none = spark.createDataFrame([], schema)
    assert rows(matching.relocate(none, none)) == []
    pairs = spark.createDataFrame([], "old string, new string, score double")
    assert rows(matching.greedy_assignment(pairs)) == []
    edges = spark.createDataFrame([], "src long, dst long")
    assert rows(graph.reachable(edges, spark.createDataFrame([], "node long"))) == []


def test_walks_over_files_equal_walks_by_levels(spark, monkeypatch):
    import random

    from driftlens.operators import walk

    r, n = random.Random(7), 120
    calls = spark.createDataFrame([(f"f{r.randrange(n)}", f"f{r.randrange(n)}é") if i % 9 == 0 else (f"f{r.randrange(n)}", f"f{r.randrange(n)}") for i in range(400)] * 2, "caller string, callee string")
    functions = spark.createDataFrame([(f"f{i}", i % 3 == 0) for i in range(n - 10)] + [("f1", True), ("f2", None)], "name string, is_public boolean")
    changed = spark.createDataFrame([(f"f{i}", i / 100) for i in range(0, n, 2)] + [("f2", 0.5), ("f3é", 0.5), ("nowhere", 1.0)], "root string, confidence double")
    by_levels = rows(graph.walk_up(calls, changed, functions, max_depth=1000))
    assert len(by_levels) > 500
    for pairs, chunk, batch in ((1 << 22, 1 << 18, 1 << 17), (50, 16, 7)):
        monkeypatch.setattr(walk, "PAIRS", pairs)
        monkeypatch.setattr(walk, "CHUNK", chunk)
        monkeypatch.setattr(walk, "BATCH", batch)
        assert rows(graph.walk_up(calls, changed, functions)) == by_levels
    none = changed.limit(0)
    assert rows(graph.walk_up(calls, none, functions)) == [] == rows(graph.walk_up(calls.limit(0), changed, functions))


def test_levels_wait_for_all_needs(spark, monkeypatch):
    import random

    r, n, tables = random.Random(9), 90, []
    deps = [(i, r.randrange(i)) for i in range(1, n) for _ in range(r.choice([0, 1, 1, 3]))] + [(200, 201), (201, 200), (202, 200), (5, 5), (7, 999)]
    names = [(i,) for i in range(n)] + [(200,), (201,), (202,)]
    level, node = {}, {i for i, in names}
    for i in range(n):
        level[i] = max((level[d] + 1 for a, d in deps if a == i and d in node and d != i), default=0)
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    got = graph.levels(spark.createDataFrame(deps, "node long, dep long"), spark.createDataFrame(names, "node long"))
    assert rows(got) == sorted(level.items())
    # What is left is not written again each round.
    tables.clear()
    chain = [(i, i // 3) for i in range(1, 400)]
    assert got.count() == n and len(rows(graph.levels(spark.createDataFrame(chain, "node long, dep long"), spark.createDataFrame([(i,) for i in range(400)], "node long")))) == 400
    assert sum(t.count() for t in tables) < 3 * 400


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_propagated_rows_need_no_last_distinct(spark, monkeypatch):
    from driftlens.operators import tables

    changes = spark.createDataFrame([("A", "x"), ("A", "x"), ("A", "y"), ("B", "x"), (None, "x")], "component string, category string")
    renders = spark.createDataFrame([("h", "A"), ("h", "A"), ("A", "A"), ("k", "B"), ("k", None)], "host string, component string")
    monkeypatch.setattr(tables, "PART_BYTES", 1)
    got = graph.propagate_one_level(changes, renders)
    assert rows(got) == [("h", "A", "x"), ("h", "A", "y"), ("k", "B", "x")]
    assert not _plan(got).startswith("Aggregate")


def test_manifests_are_compared_in_their_rows(spark):
    old = '{"name": "n", "bin": "a.js", "engines": {"node": "1", "gone": "1", "void": null}, "exports": {".": "./a", "./b": {"import": "./b"}}, "main": null}'
    new = '{"bin": {"m": "b.js"}, "engines": {"node": "2", "new": "1", "void": null}, "exports": "./a", "module": "m"}'
    df = spark.createDataFrame([(None, old, new), (1, "{}", None), (2, "no json", new)], "case int, old string, new string")
    got = facets.manifest_diff(df, "case")
    assert [tuple(r)[1:] for r in sorted(got.where("case is null").collect(), key=lambda r: r.field)] == [
        ("bin.n", "dependency_removed", True, "a.js", None),
        ("engines.new", "dependency_added", True, None, "1"),
        ("engines.node", "dependency_changed", True, "1", "2"),
        ("exports../b#import", "export_removed", True, "./b", None),
    ]
    assert {r.field for r in got.where("case = 2").collect()} == {"engines.new", "engines.node", "exports.."}
    assert "Join" not in _plan(got) and "Union" not in _plan(got)


def test_numbers_of_one_base_are_parted(spark, monkeypatch):
    from driftlens.operators import tables

    data = [(b, i) for i in range(300) for b in (["hot", "x", None] if i % 50 == 0 else ["hot"])]
    monkeypatch.setattr(tables, "PART_BYTES", 1)
    got = report.unique_ids(spark.createDataFrame(data[::-1], "b string, i long"), "b", ["i"])
    count, want = {}, []
    for b, i in data:
        count[b] = count.get(b, 0) + 1
        want.append((b, i, None if b is None else b if count[b] == 1 else f"{b}-{count[b]}"))
    key = lambda r: (r[0] or "", r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert "__part" in next(line for line in _plan(got).splitlines() if "Window" in line)


def test_collapse_makes_edges_once(spark, monkeypatch):
    from driftlens.plans import QUERIES, changes

    made = []
    cut = changes.cut
    monkeypatch.setattr(changes, "cut", lambda df: made.append(df.columns) or cut(df))
    QUERIES["internal_node_collapse"](spark, "/root/testdata/sf0.001")
    assert made == [["family", "parent", "child", "chp", "pmc"]]


def test_profiles_are_made_once(spark, monkeypatch):
    made = []
    cut = profiles.cut
    monkeypatch.setattr(profiles, "cut", lambda df: made.append(df) or cut(df))
    facet = "component string, facet string, element string, key string, value string, conditional boolean"
    old = spark.createDataFrame([("C", "prop", "", "p", None, False), ("D", "role", "e", "", "x", False)], facet)
    new = spark.createDataFrame([("C", "prop", "", "p", None, False), ("C", "deprecated", "", "p", "use q", False), ("D", "role", "e", "", "y", False)], facet)
    flags = spark.createDataFrame([("C", True, "body", False, False, False, ["Wrap"])], "component string, uses_portal boolean, portal_target string, is_forward_ref boolean, is_memo boolean, has_children boolean, children_path array<string>")
    got = profiles.component_changes(old, new, flags, flags)
    assert [(r.component, r.change, r.key) for r in got.collect() if r.category == "prop_deprecated"] == [("C", "deprecated", "p")]
    assert len(made) == 2


def test_swaps_fold_before_they_are_shuffled(spark):
    pairs = lambda *r: spark.createDataFrame([tuple(x) for x in r], "host string, component string")
    got = matching.swap_replacements(pairs("1A", "1A", "2A", "3B"), pairs("1X", "1X", "2X", "2Y", "2Y", "3B"))
    assert rows(got) == [("A", "X", 2)]
    assert "distinct" not in _plan(got).replace("Distinct", "")
