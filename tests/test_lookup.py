from driftlens.operators import lookup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_test_files(spark):
    sources = spark.createDataFrame([("a/b/Menu.tsx",)], "file string")
    files = spark.createDataFrame([("a/b/Menu.test.tsx",), ("a/b/__tests__/Menu.spec.tsx",), ("a/c/Menu.test.tsx",), ("a/b/Other.test.tsx",)], "file string")
    assert rows(lookup.test_files(sources, files)) == [
        ("a/b/Menu.tsx", "a/b/Menu.test.tsx", 1), ("a/b/Menu.tsx", "a/b/__tests__/Menu.spec.tsx", 2), ("a/b/Menu.tsx", "a/c/Menu.test.tsx", 3)
    ]


def test_replacements_and_moves(spark):
    pairs = "commit string, component string"
    removed = spark.createDataFrame([("1", "A"), ("2", "B")], pairs)
    added = spark.createDataFrame([("1", "X"), ("2", "Y"), ("2", "Z")], pairs)
    assert rows(lookup.cochange_replacements(removed, added)) == [("A", "X")]
    props = "family string, component string, prop string"
    assert rows(lookup.prop_moves(spark.createDataFrame([("f", "P", "icon"), ("f", "P", "x")], props), spark.createDataFrame([("f", "C", "icon"), ("g", "D", "x")], props))) == [("f", "P", "C", "icon")]


def test_packages_and_barrels(spark):
    files = spark.createDataFrame([("p/a/x.ts",), ("q/y.ts",)], "file string")
    packages = spark.createDataFrame([("p", "one"), ("p/a", "two")], "dir string, package string")
    assert rows(lookup.packages_of(files, packages).select("file", "package")) == [("p/a/x.ts", "two"), ("q/y.ts", None)]
    changes = spark.createDataFrame([("p/index.d.ts", "S", "removed"), ("p/s.d.ts", "S", "removed"), ("p/index.d.ts", "T", "removed")], "file string, symbol string, change string")
    assert rows(lookup.barrel_dedupe(changes).select("file", "symbol")) == [("p/index.d.ts", "T"), ("p/s.d.ts", "S")]


def test_inherited_props(spark):
    props = spark.createDataFrame([("C", "c"), ("B", "b"), ("A", "a")], "interface string, prop string")
    extends = spark.createDataFrame([("C", "B"), ("B", "A"), ("A", "C")], "child string, parent string")
    assert len(rows(lookup.inherited_props(props, extends))) == 9


def test_inherited_props_hold_no_links_of_all_levels(spark, monkeypatch):
    import random

    r, tables = random.Random(5), []
    pairs = [(str(i), str(r.randrange(max(i, 2) if r.random() < 0.95 else 60))) for i in range(60) for _ in range(r.choice([0, 1, 1, 2]))]
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 70)]
    own = [(str(i), f"p{i % 7}") for i in range(0, 60, 3)] + [("c0", "top"), ("c0", None), ("x", "alone")]
    want = set(own)
    while more := {(c, p) for c, up in pairs + chain for i, p in want if i == up} - want:
        want |= more
    cut = lookup.cut
    monkeypatch.setattr(lookup, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    monkeypatch.setattr(lookup, "release", lambda *_: None)
    got = lookup.inherited_props(spark.createDataFrame(own, "interface string, prop string"), spark.createDataFrame(pairs + chain, "child string, parent string"))
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert max(t.count() for t in tables) <= 131
