"""Near-duplicate embeddings by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import release, small, spread, written

#: Chance that a pair right at the threshold shares no filter.
MISS = 0.0001
#: Vectors of a group of filters that one task compares with as many others, and bytes that a task or batch takes.
BLOCK, TASK_BYTES, BATCH_BYTES = 4096, 32 << 20, 4 << 20


class ProductCode:
    """Filter directions: sums of one random codeword from each of several blocks of a rotated space.

    With m blocks of c codewords there are c**m directions, yet a vector's
    scores need only m*c products; those over the cap's height are decoded as a
    list. The height follows from ``similarity``, so that a pair at the
    threshold is expected to share enough filters to miss with chance ``miss``.
    """

    def __init__(self, dim: int, n: int, similarity: float, miss: float = MISS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.blocks = 2
        # About as many directions as vectors: filters stay small as the data grow.
        self.words = int(min(4096, max(8, math.ceil(math.sqrt(n)))))
        width = -(-dim // self.blocks)
        self.rotation = np.linalg.qr(rng.normal(size=(width * self.blocks, width * self.blocks)))[0][:, :dim]
        codes = rng.normal(size=(self.blocks, self.words, width))
        self.codes = codes / np.linalg.norm(codes, axis=2, keepdims=True) / math.sqrt(self.blocks)
        total, sd = self.words**self.blocks, 1 / math.sqrt(width * self.blocks)
        # Both scores exceed the height for a share of directions; their mean is a Poisson's.
        probe = rng.normal(size=(200_000, 2))
        pair = np.minimum(probe[:, 0], similarity * probe[:, 0] + math.sqrt(1 - similarity**2) * probe[:, 1])
        want = self.least = 2 * math.log(1 / miss)
        share = min(0.5, want / total)
        if share * len(pair) >= 20:
            z = float(np.quantile(pair, 1 - share))
        else:
            # Beyond the sample, the pair's tail is that of its mean: a normal of variance (1 + s) / 2.
            z = NormalDist().inv_cdf(1 - share) * math.sqrt((1 + similarity) / 2)
        self.height = z * sd

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Per row of unit vectors, the ids of all filters whose direction scores at least the height."""
        y = x @ self.rotation.T
        w = y.shape[1] // self.blocks
        first, second = (y[:, b * w : (b + 1) * w] @ self.codes[b].T for b in range(self.blocks))
        order = np.argsort(-second, axis=1)
        ranked = np.take_along_axis(second, order, axis=1)
        out = []
        for i in range(len(x)):
            # Second codewords that go with each first one form a prefix of the ranking.
            n = np.searchsorted(-ranked[i], first[i] - self.height, side="right")
            if n.sum() < self.least:  # lies badly to the codes, and so do its neighbours: they share its best directions
                k = min(total := first.shape[1] * second.shape[1], 2 * math.ceil(self.least))
                scores = (first[i][:, None] + second[i][None, :]).ravel()
                out.append(np.argpartition(-scores, k - 1)[:k] if k < total else np.arange(total))
                continue
            a = np.repeat(np.arange(self.words), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(a * self.words + order[i][within])
        return out


def unit(values) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it is null, empty, zero or not finite."""
    if values is None:
        return None
    try:
        x = np.asarray(values, dtype=np.float64)
    except (TypeError, ValueError):
        return None
    if not x.size or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def group_width(words: int, n: int, per_vector: float = 40.0) -> int:
    """Second codewords to a group of filters of one first codeword, so that a group has about ``BLOCK`` vectors or all of them."""
    return max(1, min(words, int(BLOCK * words * words / max(1.0, n * per_vector))))


def _decode(dim: int, n: int, similarity: float):
    """Rows of a vector for each group of filters that it has a filter in: the vector travels once a group, not once a filter."""
    code = ProductCode(dim, n, similarity)
    width = group_width(code.words, n)
    step = max(1, BATCH_BYTES // (40 * (8 * dim + 200)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                raw = b.column("unit").to_pylist()
                filters = [np.sort(f).astype(np.int32) for f in code.decode(np.frombuffer(b"".join(raw)).reshape(len(raw), dim))]
                groups = [np.unique(f // code.words * code.words + f % code.words // width) for f in filters]
                rows = pa.array(np.repeat(np.arange(len(raw)), [len(g) for g in groups]))
                lists = pa.array([f.tobytes() for f in filters], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(groups).astype(np.int64)), *[b.column(c).take(rows) for c in ("cid", "weight", "unit")], lists.take(rows)],
                    ["filters_of", "cid", "weight", "unit", "filters"],
                )

    return run, code.words, width


def _compare(similarity: float, plans: dict[int, tuple[int, int]]):
    def group(name: int, two: bool, x, cid, weight, block, lists):
        """Verified pairs of a filter (or of two of its blocks) that share no smaller filter: counts, spanning forest."""
        count, tree, parent = np.zeros(len(x), np.int64), [], list(range(len(x)))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        # Filters before this one, padded so that no pad equals another.
        before = [v[v < name] for v in lists]
        width = max(1, max(map(len, before)))
        grid = -1 - np.arange(len(x))[:, None] * np.ones((1, width), np.int64)
        for k, v in enumerate(before):
            grid[k, : len(v)] = v

        def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            step, out = max(1, 4_000_000 // width**2), [np.zeros(0, bool)]
            for s in range(0, len(i), step):
                out.append((grid[i[s : s + step], :, None] == grid[j[s : s + step], None, :]).any(axis=(1, 2)))
            return np.concatenate(out)

        for s in range(0, len(x), 1024):
            i, j = np.nonzero(x[s : s + 1024] @ x.T >= similarity - 1e-9)
            i += s
            keep = i < j
            if two:  # pairs within a block are another task's
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            # The decision takes one order of summation, whatever block the pair came from.
            ok = np.einsum("nd,nd->n", x[i], x[j]) >= similarity
            i, j = i[ok], j[ok]
            mine = ~shared(i, j)
            i, j = i[mine], j[mine]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            for p, q in zip(i.tolist(), j.tolist()):
                r, t = root(p), root(q)
                if r != t:
                    parent[max(r, t)] = min(r, t)
                    tree.append((cid[p], cid[q]))
        some = np.flatnonzero(count)
        return cid[some], count[some], tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (cid, null, k) add k to a vector's links; rows (a, b, null) link two vectors of a component."""
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        dim, name, i, j, cid, weight, block = (t.column(c).to_numpy() for c in ("dim", "filters_of", "i", "j", "cid", "weight", "block"))
        order = np.lexsort((cid, j, i, name, dim))
        new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (dim, name, i, j)], axis=0), True]
        units, lists = t.column("unit"), t.column("filters")
        ends, a, b, links = np.flatnonzero(new), [], [], []
        for lo, hi in zip(ends[:-1], ends[1:]):
            o = order[lo:hi]
            x = np.frombuffer(b"".join(units[int(k)].as_py() for k in o)).reshape(len(o), -1)
            own = [np.frombuffer(lists[int(k)].as_py(), np.int32) for k in o]
            words, width = plans[int(dim[o[0]])]
            # The filters of this group, and the vectors in each.
            flat, of = np.concatenate(own), np.repeat(np.arange(len(o)), [len(v) for v in own])
            here = flat // words * words + flat % words // width == name[o[0]]
            flat, of = flat[here], of[here]
            by = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.r_[True, flat[by][1:] != flat[by][:-1], True])
            for u, v in zip(starts[:-1], starts[1:]):
                if v - u > 1:
                    m = of[by[u:v]]
                    k = o[m]
                    some, counts, tree = group(int(flat[by[u]]), i[o[0]] != j[o[0]], x[m], cid[k], weight[k], block[k], [own[q] for q in m])
                    a += [*some.tolist(), *(p for p, _ in tree)]
                    b += [*[None] * len(some), *(q for _, q in tree)]
                    links += [*counts.tolist(), *[None] * len(tree)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, links)], ["a", "b", "links"])

    return run


def near_embeddings(df: DataFrame, similarity: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors of cosine ``similarity`` or more, in double precision, whatever their labels.

    Equal directions are folded into weighted classes first. Each class is
    decoded to every filter whose cap it lies in, and joined on filters; pairs
    are compared exactly, and counted in the smallest filter they share. A
    vector travels once for all its filters of a group; a group over ``BLOCK``
    vectors is spread over pairs of blocks.

    Returns one row per vector: ``id_col``, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable) and ``kept`` (whether
    that is its own id; so are all rows of a repeated id). Null, empty, zero or
    non-finite vectors, and those of another dimension than a pair's other one,
    link with nothing. Null ids count last. Extra columns are ignored.
    """

    def normal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            units = [unit(v) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([None if u is None else u.tobytes() for u in units], pa.binary()), pa.array([0 if u is None else len(u) for u in units], pa.int32())],
                ["id", "unit", "dim"],
            )

    id_type = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(slim.mapInArrow(normal, f"id {id_type}, unit binary, dim int").withColumn("row", F.monotonically_increasing_id()), "units")
    classes = written(
        rows.where("unit is not null").groupBy("unit", "dim").agg(F.min("row").alias("cid"), F.count("*").alias("weight")), "directions"
    )
    hits, plans, nbytes = None, {}, 64
    for dim, n in sorted(tuple(r) for r in classes.groupBy("dim").count().collect()):  # one pass per dimension that occurs
        decode, words, width = _decode(dim, n, similarity)
        plans[dim], nbytes = (words, width), max(nbytes, 8 * dim + 200)
        one = classes.where(F.col("dim") == dim).select("cid", "weight", "unit")
        one = one.mapInArrow(decode, "filters_of long, cid long, weight long, unit binary, filters binary").withColumn("dim", F.lit(dim))
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    hits = written(hits, "hits")
    sizes = hits.groupBy("dim", "filters_of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m"))
    sizes = written(sizes.where("m > 1"), "sizes")
    # One row in BLOCK / 2 at most is of a split group: what is left out of these is the bulk.
    split = small(sizes.where("blocks > 1").select("dim", "filters_of", "blocks"), 32)
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = (
        hits.join(split, ["dim", "filters_of"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    copies = sizes.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    # A task takes many small groups, and at most one part of a large one beside them.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), copies * nbytes // TASK_BYTES)
    spread_hits = placed.repartition(parts, "dim", "filters_of", "i", "j")
    found = written(spread_hits.mapInArrow(_compare(similarity, plans), "a long, b long, links long"), "links")
    release(hits, sizes)
    counts = found.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("k"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.select("unit", "dim", "cid", "weight").join(counts, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
    side = known.select("unit", "dim", "weight", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("component", "cid").alias("c"))
    grouped = written(
        spread(rows, side, ["unit", "dim"]).select("id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("c", "row").alias("c")), "grouped"
    )
    first = grouped.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f")).select("c", F.col("f.id").alias("component_id"))
    return spread(grouped, first, ["c"]).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
