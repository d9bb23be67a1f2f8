"""Each stage on its own input, over nulls, empty texts, repeated rows and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlens.llm import mixing, simhash, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    words = [f"word{i % 37} plain{i % 11} talk{i}" for i in range(120)]
    rows = [(i, w + (" vile" if i % 6 == 0 else ""), "en", f"s{i % 3}", 1) for i, w in enumerate(words)]
    body = " ".join(f"token{i}" for i in range(200))
    rows += [(200, body, "en", None, 1), (201, body, "en", "s1", 1), (202, body + " more", "en", "s1", 1), (203, None, "en", "s1", 0), (204, "", None, "s2", 0)]
    rows += [rows[1], rows[1], (None, "a text without an id", "en", "s0", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = counted(docs)
    clean = stages.reread(stages.toxicity(spark, docs, sf_dir))
    assert clean.columns == docs.columns
    assert counted(clean) == Counter({k: n for k, n in before.items() if not (k[1] or "").endswith("vile")})

    single = stages.reread(stages.exact(spark, clean, sf_dir))
    largest = {}
    for i, t in counted(clean):
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    got = counted(single)
    assert {(t or "", -1 if i is None else i) for i, t in got} == set(largest.items())
    assert set(got.values()) == {1} and single.columns == docs.columns

    apart = stages.reread(stages.near(spark, single, sf_dir))
    judged = simhash.near_duplicates(single)
    assert apart.count() == judged.where("kept").count() == single.count() - 1
    assert {201, 202} & {r.doc_id for r in apart.collect()} == {201}

    mixed = stages.reread(stages.mix(spark, apart, sf_dir))
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix_sources(apart).collect() if r.copies}
    assert sum(copies.values()) == mixed.count() and max(counted(mixed).values()) <= 2
    assert set(counted(mixed)) <= set(counted(apart))

    packed = stages.pack(spark, mixed, sf_dir)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_are_the_pipeline():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
