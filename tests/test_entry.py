import importlib
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_contract_lists_queries_and_oracles():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(__import__("driftlens.plans", fromlist=["x"]).ORACLE_SQL))
def test_queries_match_their_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = __spark_entry__.queries()[name](spark, SF)
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    norm = lambda rows, names: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[names.index(c)] for c in cols))) for r in rows)
    assert norm([tuple(r) for r in got.collect()], got.columns) == norm(rel.fetchall(), rel.columns)


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(importlib.import_module("driftlens").__file__)
    for folder, _, files in os.walk(root):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "driftlens.llm" not in open(os.path.join(folder, f)).read()
