"""Near-duplicate documents by SimHash: sampled bits group candidates, distances and exact Jaccard verify them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bitmap_filter, release, salted, small, spread, trimmed, written

BITS = 256
#: Words to a shingle, and the least Jaccard similarity of shingle sets.
SHINGLE, SIMILARITY = 5, 0.8
#: Chance that a pair right at the threshold shares no table's bucket.
MISS = 0.01
#: Members of a bucket beyond which further bits are sampled for it.
BUCKET = 16384
#: Signatures of which one tells the sizes of buckets.
SHARE = 16
#: Members of a bucket up to which its pairs are listed; of a larger one a forest.
FEW = 16
#: Bytes of text that one verifying task takes of a component.
BLOCK_BYTES = 24 << 20
#: Words whose hashes a worker remembers.
WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five lower-cased words; of all words where there are fewer."""
    found = _WORD.findall((text or "").lower())
    w = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(SHINGLE, len(w))
    if not k:
        return w
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h + np.uint64(k)))


def simhash(hashes: np.ndarray) -> bytes:
    """Bit i is set where most hashes have derived bit i set; 256 bits."""
    if not len(hashes):
        return bytes(BITS // 8)
    derived = mix(hashes[:, None] * _MIX[None, :] + _MIX[::-1][None, :])
    lanes = np.unpackbits(derived.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1).view(np.uint64)
    total = np.zeros(BITS, np.uint32)
    for i in range(0, len(lanes), 255):  # eight counters of a byte in each lane
        total += lanes[i : i + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * total > len(hashes)).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signed = [(simhash(s), len(s)) for s in (shingle_hashes(t.as_py()) for t in b.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("digest"), pa.array([s for s, _ in signed], pa.binary()), pa.array([n for _, n in signed], pa.int64())],
            ["id", "digest", "sig", "n"],
        )


def bit_agreement(similarity: float) -> float:
    """How often a bit agrees for two sets of equal size and this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_tables(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits per table and tables: buckets stay small as n grows, and a threshold pair is missed with chance MISS."""
    bits = max(8, min(40, math.ceil(math.log2(max(n, 2))) - 2))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(bit_agreement(similarity) ** bits)))


def _positions(table: int, bits: int, level: int) -> np.ndarray:
    return np.random.default_rng([level, table]).choice(BITS, bits, replace=False)


def _explode(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = [_positions(t, bits, 0) for t in range(tables)]
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = batch.slice(at, 8192)
                sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, BITS // 8)
                on, near = np.unpackbits(sigs, axis=1), sigs[:, :8].copy().view(np.int64)[:, 0]
                for t, spot in enumerate(spots):
                    key = on[:, spot].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) + (t << 44)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column("cid"), pa.array(near)], ["key", "cid", "near"])

    return run


def forest(n: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of 0..n-1, where ``linked(i, others)`` tells which of ``others`` i links to."""
    left, out = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = linked(i, left)
            new = left[hit]
            out += [(i, int(j)) for j in new]
            front += new.tolist()
            left = left[~hit]
    return out


def _words(sigs: pa.Array) -> np.ndarray:
    """Signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _buckets(limit: int):
    """Of each bucket of at most ``FEW`` rows the pairs whose first 64 bits differ in at most ``limit``; of others the rows, ``b`` null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, cid, near = (t.column(c).to_numpy() for c in ("key", "cid", "near"))
        order = np.argsort(key, kind="stable")
        key, cid, near = key[order], cid[order], near[order].view(np.uint64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        size_of = np.repeat(sizes, sizes)
        a, b = [], []
        few = np.flatnonzero(size_of <= FEW)
        for o in range(1, FEW):
            i = few[few + o < len(key)]
            i = i[key[i] == key[i + o]]
            i = i[np.bitwise_count(near[i] ^ near[i + o]) <= limit]
            a.append(cid[i])
            b.append(cid[i + o])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "a", "b"])
        many = size_of > FEW
        yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(cid[many]), pa.nulls(int(many.sum()), pa.int64())], ["key", "a", "b"])

    return run


def _whole(most: int):
    """Pairs whose whole signatures differ in at most ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = np.bitwise_count(_words(b.column("sig_a")) ^ _words(b.column("sig_b"))).sum(axis=1, dtype=np.int64)
                yield b.select(["a", "b"]).filter(pa.array(far <= most))

    return run


def _forests(most: int):
    """Forests of each bucket's graph of pairs whose whole signatures differ in at most ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, cid, sigs = t.column("key").to_numpy(), t.column("a").to_numpy(), _words(t.column("sig"))
        order = np.argsort(key, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            x, c = sigs[at], cid[at]
            pairs = forest(len(at), lambda i, o: np.bitwise_count(x[i] ^ x[o]).sum(axis=1, dtype=np.int64) <= most)
            a, b = c[[p for p, _ in pairs]] if pairs else c[:0], c[[p for _, p in pairs]] if pairs else c[:0]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _candidates(rows: DataFrame, sigs: DataFrame, near: int, most: int, parts: int) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of the pairs that share a bucket of ``rows`` and are near in all bits.

    The tables carry 64 bits of a signature. By these alone chance pairs grow
    with the corpus until they tie it into one component, so each pair is held
    against the whole signatures (``sigs``: ``cid``, ``sig``) before it counts.
    """
    found = written(rows.repartition(parts, "key").mapInArrow(trimmed(_buckets(near)), "key long, a long, b long"), "found")
    of = lambda at: sigs.select(F.col("cid").alias(at), F.col("sig").alias(f"sig_{at}"))
    pairs = found.where("b is not null").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    many = found.where("b is null").select("key", "a").join(sigs.select(F.col("cid").alias("a"), "sig"), "a")
    return pairs.mapInArrow(_whole(most), "a long, b long").unionByName(many.repartition(parts, "key").mapInArrow(_forests(most), "a long, b long"))


def _some(rows: DataFrame) -> DataFrame:
    """One in ``SHARE`` of the signatures."""
    return rows.where(F.pmod(F.xxhash64("cid"), F.lit(SHARE)) == 0)


def _refined(rows: DataFrame, some: DataFrame, sigs: DataFrame, level: int = 1) -> DataFrame:
    """Split buckets over BUCKET by further sampled bits, in as many tables as keep a threshold pair's chance.

    Their sizes are told from ``some``, the rows of one in ``SHARE`` signatures:
    any split keeps that chance, so the limit needn't be met exactly.
    """
    hot = some.groupBy("key").count().where(F.col("count") * SHARE > BUCKET).select("key")
    hot = written(hot, "hot")
    if level > 4 or not hot.limit(1).count():
        return rows
    bits = 8
    tables = math.ceil(math.log(MISS) / math.log1p(-(bit_agreement(SIMILARITY) ** bits)))
    spots = [_positions(t, bits, level).tolist() for t in range(tables)]

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = np.unpackbits(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            for t, spot in enumerate(spots):
                extra = on[:, spot].astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                key = mix(b.column("key").to_numpy().view(np.uint64) * _MIX[0] + (extra << np.uint64(8)) + np.uint64(t)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("cid"), b.column("near")], ["key", "cid", "near"])

    side = small(hot, 24)
    split = rows.join(side, "key", "left_semi").join(sigs, "cid").select("key", "cid", "near", "sig")
    split = written(split.mapInArrow(more, "key long, cid long, near long"), "split")
    return rows.join(side, "key", "left_anti").unionByName(_refined(split, _some(split), sigs, level + 1))


def _verify(most: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Forest of a component's (or two of its blocks') documents by exact Jaccard of whole shingle sets."""
        sets = [shingle_hashes(t) for t in f.pop("text")]
        sizes = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        ids = [flat[e - n : e] for e, n in zip(ends, sizes)]
        sig = np.frombuffer(b"".join(f["sig"]), np.uint64).reshape(len(f), -1)
        mark = np.zeros(len(names), bool)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            hit = np.bitwise_count(sig[others] ^ sig[i]).sum(axis=1, dtype=np.int64) <= most
            lo, hi = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            hit &= (lo >= SIMILARITY * hi) & (lo > 0)
            mark[ids[i]] = True
            for k in np.flatnonzero(hit):
                both = int(mark[ids[others[k]]].sum())
                hit[k] = both >= SIMILARITY * (sizes[i] + sizes[others[k]] - both) - 1e-9
            mark[ids[i]] = False
            return hit

        cid = f["cid"].to_numpy()
        pairs = forest(len(f), linked)
        return pd.DataFrame({"a": [cid[i] for i, _ in pairs], "b": [cid[j] for _, j in pairs]}, dtype="int64")

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Classes of documents linked by shingle sets of Jaccard similarity 0.8 or more.

    Words are lower-cased runs of letters and digits; five in a row are a
    shingle, and a shorter text is one shingle of all its words. Texts are
    first folded by digest. Their 256-bit SimHashes go to tables that group on
    sampled bits, so many that a pair right at 0.8 meets with a chance of 0.99;
    a bucket over ``BUCKET`` is split by further bits, again in several tables.
    Pairs of a bucket are candidates if they are near in all 256 bits (in small
    buckets also in the first 64); a large bucket gives a spanning forest of
    them, never all pairs. Each component of the candidates is then verified: by
    distance and by exact Jaccard of the whole texts, in blocks of
    ``BLOCK_BYTES`` if it is large. Verified links form the classes.

    Returns one row per input row: ``id_col``, ``class_id`` (smallest id of the
    class), ``class_size``, ``kept`` (one row of each class) and with ``digests``
    the text's MD5. Null counts as
    empty; texts without words are alike only if identical. Ids may be null
    (counted last) or repeat; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), text.alias("text"))
    id_type = dict(df.dtypes)[id_col]
    base = written(
        source.mapInArrow(trimmed(_sign), f"id {id_type}, digest binary, sig binary, n long").withColumn("row", F.monotonically_increasing_id()), "signed"
    )
    classes = written(base.groupBy("digest").agg(F.min("row").alias("cid"), F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    # Texts of one signature are one candidate: a forest of stars, whatever their number.
    worded = classes.where("n > 0")
    heads = worded.groupBy("sig").agg(F.min("cid").alias("head"), F.count("*").alias("m"))
    stars = salted(worded, heads.where("m > 1").select("sig", "head"), ["sig"], "inner").where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    sigs = written(heads.select(F.col("head").alias("cid"), "sig"), "sigs")
    n = sigs.count()
    bits, tables = plan_tables(n)
    p = 1 - bit_agreement(SIMILARITY)
    near = round(64 * p + 3 * math.sqrt(64 * p * (1 - p)))
    most = round(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables // 1_000_000)
    rows, some = (d.mapInArrow(_explode(bits, tables), "key long, cid long, near long") for d in (sigs, _some(sigs)))
    found = _candidates(_refined(rows, some, sigs), sigs, near, most, parts)
    candidates = connected_components(found.unionByName(stars))
    members = written(candidates.join(classes.select(F.col("cid").alias("id"), "digest", "sig"), "id").withColumnRenamed("id", "cid"), "members")
    texts = (
        bitmap_filter(source.select("digest", F.xxhash64("digest").alias("h"), "text"), "h", members.select(F.xxhash64("digest").alias("h")), "may")
        .where("may")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
    )
    whole = written(texts.join(members, "digest").withColumn("bytes", F.octet_length("text")), "texts")
    blocks = whole.groupBy("component").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # One block alone, or with every other: each pair of members meets.
    other = F.when(F.col("blocks") <= 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda j: j != block)
    )
    tasks = (
        salted(whole, blocks, ["component"])
        .withColumn("other", F.explode(other))
        .select("component", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "cid", "sig", "text")
    )
    links = tasks.groupBy("component", "i", "j").applyInPandas(_verify(most), "a long, b long")
    linked = written(connected_components(links), "linked")
    of = spread(base.select("row", "id", "digest"), classes.select("digest", "cid"), ["digest"])
    grouped = written(
        salted(of, linked.select(F.col("id").alias("cid"), "component"), ["cid"]).select("row", "id", *["digest"] * digests, F.coalesce("component", "cid").alias("component")), "grouped"
    )
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f"), F.count("*").alias("n"))
    release(whole)
    return spread(grouped, first, ["component"]).select(
        F.col("id").alias(id_col), F.col("f.id").alias("class_id"), F.col("n").alias("class_size"), (F.col("f.row") == F.col("row")).alias("kept"), *["digest"] * digests
    )
