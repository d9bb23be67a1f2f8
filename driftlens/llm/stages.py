"""Stages of the corpus pipeline: each applies one operator and returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, packing, simhash, toxicity as chain
from .queries import table
from .shared import joined, ship, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reread(docs: DataFrame) -> DataFrame:
    """A stage's result as the next one's documents: written and read again."""
    return written(docs, "stage")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("__digest"))


def _with(docs: DataFrame, decisions: DataFrame, how: str = "left") -> DataFrame:
    """Join decisions by id and digest of the text; null ids meet null ids."""
    id_of = F.struct("doc_id").alias("__key")
    right = decisions.select(id_of, *[c for c in decisions.columns if c != "doc_id"])
    return joined(_keyed(docs).withColumn("__key", F.struct("doc_id")), right, ["__key", "__digest"], 64, how)


def _first_rows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One of each repeated row; ``repeated`` names them, and where it is empty nothing moves."""
    if not repeated.limit(1).count():
        return docs
    marked = _with(docs, repeated.withColumn("__again", F.lit(True)))
    again = marked.where("__again").dropDuplicates(["__key", "__digest"])
    return marked.where("__again is null").unionByName(again).drop("__again", "__key", "__digest")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain finds toxic; all others stay, null and empty texts included."""
    ship(spark)
    fitted = chain.fit_chain(docs, table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return chain.keep(docs, fitted, "toxic").select(*COLUMNS)


def _one_of_each(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``judged`` has doc_id, __digest and kept for every row of ``docs``: drop what isn't kept."""
    out = written(judged.groupBy("doc_id", "__digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "judged")
    gone = out.where("not kept").select("doc_id", "__digest", F.lit(True).alias("__gone"))
    left = _with(docs, gone).where("__gone is null").drop("__gone", "__key", "__digest")
    return _first_rows(left, out.where("kept and n > 1").select("doc_id", "__digest")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays; of equal rows one."""
    digest = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return _one_of_each(docs, exact_dedup.exact_dedup(docs, carry={"__digest": digest}))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays; of equal rows one."""
    ship(spark)
    return _one_of_each(docs, simhash.near_duplicates(docs, digests=True).withColumnRenamed("digest", "__digest"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Equal rows take their copies together."""
    digest = F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    judged = mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2.0, carry={"__digest": digest})
    out = written(judged.groupBy("doc_id", "__digest").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")), "copies")
    single = _first_rows(docs, out.where("n > 1").select("doc_id", "__digest"))
    taken = _with(single, out.where("copies > 0").select("doc_id", "__digest", "copies"), "inner")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the mix took into sequences of 2048 tokens; a row per piece."""
    ship(spark)
    return packing.pack_documents(docs, size=2048)
