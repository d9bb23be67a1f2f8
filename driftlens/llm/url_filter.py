"""URL filtering: blocked Bloom filter in front of an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import salted, small

#: Words of 64 bits to a block; a key sets one bit in each, all within one block.
WORDS = 8
BITS_PER_KEY = 16


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path of a url as they are listed: no scheme, query or fragment; what has no ``://`` is taken as it stands."""
    return F.when(F.contains(url, F.lit("://")), F.concat(url_host(url), url_path(url))).otherwise(url)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int"))


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter's filled blocks, one row of ``WORDS`` longs each, and the number of blocks."""
    blocks = max(1, keys.count() * BITS_PER_KEY // (64 * WORDS))
    out = keys.groupBy(_block(F.col(key), blocks).alias("__block")).agg(
        *[F.bit_or(_mask(F.col(key), i)).alias(f"__w{i}") for i in range(WORDS)]
    )
    return out, blocks


def may_contain(df: DataFrame, key: str, bloom: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose key may be in the filter: all true ones and a few others."""
    table, blocks = bloom
    hit = None
    for i in range(WORDS):
        m = _mask(F.col(key), i)
        test = F.col(f"__w{i}").bitwiseAND(m) == m
        hit = test if hit is None else hit & test
    probed = df.withColumn("__block", _block(F.col(key), blocks)).join(small(table, 8 * WORDS + 24), "__block")
    return probed.where(hit).drop("__block", *[f"__w{i}" for i in range(WORDS)])


def url_filter(
    pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every url by host and path rules, else by a list of blocked canonical urls.

    ``rules``: ``host``, ``path``, ``verdict`` (allow or block). A rule fits its
    host and all subdomains where the url's path starts with the rule's; the
    longest host and path wins (equal length: longer host, then block).
    ``listed``: ``url``, urls that are blocked, in their canonical form, where
    no rule fits; every other url is allowed.

    Rules and list form one table of canonical keys. Each url yields its host's
    suffixes joined to its path's prefixes of listed lengths; the Bloom filter
    passes the few that may be listed, and an exact join on the key removes the
    false positives. Distinct hosts and paths are judged once, so a hot url
    costs one probe.

    Returns one row per page: ``id_col``, ``host``, ``path``, ``rule`` (null
    where none fits) and ``verdict``. A null url, or one without ``://``, has
    empty host and path, fits no rule and is allowed. Extra columns of any name
    are ignored; repeated rows each get their verdict; empty tables give none.
    """
    urls = pages.select(
        F.col(id_col).alias("__id"), url_host(F.col(url_col)).alias("__host"), url_path(F.col(url_col)).alias("__path")
    )
    keys = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("__key"),
        F.length("host").alias("__hosts"),
        F.lit(True).alias("__prefix"),
        F.lower("verdict").alias("__verdict"),
        F.length("path").alias("__length"),
    )
    if listed is not None:
        keys = keys.unionByName(
            listed.where("url is not null").select(
                canonical_url(F.col("url")).alias("__key"),
                F.length(F.regexp_extract(canonical_url(F.col("url")), "^[^/]*", 0)).alias("__hosts"),
                F.lit(False).alias("__prefix"),
                F.lit("block").alias("__verdict"),
                F.lit(-1).alias("__length"),
            )
        )
    # At most as many lengths as a path has characters: a bounded list.
    lengths = sorted(r[0] for r in keys.where("__length >= 0").select("__length").distinct().collect())
    exact = keys.groupBy("__key", "__hosts", "__prefix").agg(F.max("__verdict").alias("__verdict"))
    labels = F.split("__host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    depths = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.length("__path")))
    distinct = urls.where("__host <> '' or __path <> ''").select("__host", "__path").distinct()
    tries = (
        distinct.withColumn("__suffix", F.explode(hosts))
        .withColumn("__depth", F.explode(F.concat(depths, F.array(F.lit(-1)))))
        .where("__depth >= 0 or __suffix = __host")
        .select(
            "__host",
            "__path",
            F.concat("__suffix", F.when(F.col("__depth") < 0, F.col("__path")).otherwise(F.expr("left(__path, __depth)"))).alias("__key"),
            F.length("__suffix").alias("__hosts"),
            (F.col("__depth") >= 0).alias("__prefix"),
        )
    )
    possible = may_contain(tries, "__key", bloom_filter(exact.select("__key").distinct(), "__key"))
    hits = possible.join(small(exact, 2048), ["__key", "__hosts", "__prefix"])
    best = hits.groupBy("__host", "__path").agg(
        F.max(
            F.struct(
                F.col("__prefix").alias("p"), F.length("__key").alias("n"), F.col("__hosts").alias("h"), F.col("__verdict").alias("v"), F.col("__key").alias("k")
            )
        ).alias("__best")
    )
    return salted(urls, best, ["__host", "__path"]).select(
        F.col("__id").alias(id_col),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(F.col("__best.p"), F.col("__best.k")).alias("rule"),
        F.coalesce("__best.v", F.lit("allow")).alias("verdict"),
    )
