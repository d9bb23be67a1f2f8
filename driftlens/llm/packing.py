"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, trimmed, written
from .tokenize import Encoder, default_path

#: Pieces that one problem, and so one task, holds on average.
BLOCK = 12_000
#: Texts whose ids a worker holds at once.
ROWS = 1000
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 4, 12, 2
#: Bins filled less than this are packed again across blocks.
LOOSE = 0.995
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, size: int, end_id: int) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, to pieces of at most ``size``; only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            which, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(enc.encode([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    which.append(k)
                    piece.append(p)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(trimmed(run), f"id {dict(df.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins ordered by room, for best fit."""

    def __init__(self, rooms: list[tuple[int, int]]):
        self.rooms = sorted(rooms)

    def place(self, length: int) -> int | None:
        """Put ``length`` into the fullest bin that has room for it."""
        i = bisect_left(self.rooms, (length, -1))
        if i == len(self.rooms):
            return None
        room, b = self.rooms.pop(i)
        if room > length:
            insort(self.rooms, (room - length, b))
        return b


def best_fit(lengths: np.ndarray, bins: np.ndarray, todo: np.ndarray, size: int) -> np.ndarray:
    """Fill ``bins`` for the items in ``todo``, longest first; the others keep theirs."""
    out = bins.copy()
    out[todo] = -1
    fixed = np.flatnonzero(out >= 0)
    used = np.zeros(0, np.int64)
    if len(fixed):
        used, out[fixed] = np.unique(out[fixed], return_inverse=True)
    fill = np.bincount(out[fixed], weights=lengths[fixed], minlength=len(used)).astype(np.int64)
    rooms = Bins([(size - int(f), b) for b, f in enumerate(fill) if f < size])
    n = len(used)
    for i, length in zip(todo.tolist(), lengths[todo].tolist()):
        b = rooms.place(length)
        if b is None:
            b, n = n, n + 1
            if length < size:
                insort(rooms.rooms, (size - length, b))
        out[i] = b
    return out


def fitness(lengths: np.ndarray, bins: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is the most uneven."""
    fill = np.bincount(bins, weights=lengths) / size
    return -len(fill), float((fill**2).sum())


def cross(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Inject whole well-filled bins of ``b`` into ``a``.

    Bins of ``a`` that hold any injected item are broken up, so that no item is
    there twice; what else was in them goes back in by best fit, longest first.
    """
    fill = np.bincount(b, weights=lengths) / size
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = np.zeros(len(fill), bool)
    taken[rng.choice(good, max(1, len(good) // int(rng.integers(2, 6))), replace=False)] = True
    inside = taken[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[inside]] = True
    child = a.copy()
    child[inside] = b[inside] + int(a.max()) + 1
    return best_fit(lengths, child, np.flatnonzero(broken[a] & ~inside), size)


def mutate(lengths: np.ndarray, a: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Break up the emptiest bins and a few others."""
    fill = np.bincount(a, weights=lengths) / size
    gone = rng.random(len(fill)) < 0.02
    gone[np.argsort(fill)[: max(2, len(fill) // 50)]] = True
    return best_fit(lengths, a, np.flatnonzero(gone[a]), size)


def evolve(lengths: np.ndarray, population: list[np.ndarray], size: int, generations: int, seed: list[int]) -> list[np.ndarray]:
    """Steady-state evolution; stops where the least possible number of bins is reached. Best first.

    A new population is of items put to their best bins in random orders, so
    that what is good about a grouping comes of crossing, not of its start.
    """
    rng, score = np.random.default_rng(seed), lambda p: fitness(lengths, p, size)
    bound = -(-int(lengths.sum()) // size)
    while len(population) < POPULATION:
        population = [*population, best_fit(lengths, np.full(len(lengths), -1), rng.permutation(len(lengths)), size)]
    population = sorted(population, key=score, reverse=True)[: POPULATION + 2]
    for _ in range(generations):
        if -score(population[0])[0] == bound:
            break
        i, j = rng.choice(len(population), 2, replace=False).tolist()
        child = cross(lengths, population[i], population[j], size, rng)
        if rng.random() < 0.5:
            child = mutate(lengths, child, size, rng)
        population = sorted([*population, child], key=score, reverse=True)[:POPULATION]
    return population


def _island(size: int, epoch: int, seed: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """One epoch of an island: its own and the migrated elites go in, its best groupings come out."""
        block, island = int(f["block"].iloc[0]), int(f["island"].iloc[0])
        items = f[f["item"].notna()].sort_values(["length", "item"], ascending=[False, True])
        guests = [np.frombuffer(g, np.int32).astype(np.int64) for g in f["grouping"].dropna()]
        lengths = items["length"].to_numpy(np.int64)
        if epoch == EPOCHS - 1:  # a last immigrant where crossing hasn't solved it: no block ends worse than longest-first
            guests.append(best_fit(lengths, np.full(len(lengths), -1), np.arange(len(lengths)), size))
            guests.sort(key=lambda g: fitness(lengths, g, size), reverse=True)
        got = evolve(lengths, guests, size, GENERATIONS, [seed, epoch, block, island])
        bins, unevenness = fitness(lengths, got[0], size)
        return pd.DataFrame(
            {"block": block, "island": island, "rank": range(len(got)), "bins": -bins, "score": unevenness, "grouping": [g.astype(np.int32).tobytes() for g in got]}
        )

    return run


def _assign(f: pd.DataFrame) -> pd.DataFrame:
    items = f[f["item"].notna()].sort_values(["length", "item"], ascending=[False, True])
    items = items.assign(bin=np.frombuffer(f["grouping"].dropna().iloc[0], np.int32))
    items = items.sort_values(["bin", "item"])
    items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
    items["fill"] = items.groupby("bin")["length"].transform("sum")
    return items[["block", "item", "length", "bin", "offset", "fill"]].astype("int64")


def pack_items(items: DataFrame, size: int, seed: int = 5) -> DataFrame:
    """Pack ``item`` (unique long) of ``length`` up to ``size``: ``block``, ``item``, ``length``, ``bin``, ``offset``, ``fill``.

    Items are hashed to blocks of about ``BLOCK``. ``ISLANDS`` populations of
    groupings per block evolve apart for an epoch; then each takes in the best
    grouping of its neighbour, by way of a written table, and goes on. In the
    last epoch best fit from the longest on joins as one more parent.
    """
    blocks = max(1, round(items.count() / BLOCK))
    placed = written(items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)).alias("block")), "items")
    elites = None
    everywhere = placed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("grouping", F.lit(None).cast("binary"))
    for epoch in range(EPOCHS):
        state = everywhere
        if elites is not None:
            # An island keeps its population; its best also moves to the next island.
            moved = elites.where("rank = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
            guests = elites.unionByName(moved).select("block", "island", "grouping")
            state = state.unionByName(guests, allowMissingColumns=True)
        after = written(
            state.groupBy("block", "island").applyInPandas(
                _island(size, epoch, seed), "block long, island int, rank int, bins long, score double, grouping binary"
            ),
            "elites",
        )
        if elites is not None:
            release(elites)
        elites = after
    best = elites.where("rank = 0").groupBy("block").agg(F.min_by("grouping", F.struct("bins", -F.col("score"), "island")).alias("grouping"))
    both = placed.withColumn("grouping", F.lit(None).cast("binary")).unionByName(best, allowMissingColumns=True)
    return both.groupBy("block").applyInPandas(_assign, "block long, item long, length long, bin long, offset long, fill long")


def pack_documents(
    df: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0
) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` tokens.

    A document is the ids of its text and ``end_id``. Only a longer one is cut,
    to pieces of ``size`` after a first one of the rest. Full pieces are
    sequences of their own; all others are packed in blocks (``pack_items``),
    then what loose bins hold is packed once more across blocks.

    Returns a row per piece: ``id_col``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``. A null or empty text is
    ``end_id`` alone; repeated rows are packed as documents of their own; extra
    columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_path()
    pieces = written(token_pieces(df, id_col, text_col, path, size, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size).select("item", "length")
    packed = written(pack_items(short, size), "packed")
    loose = packed.where(F.col("fill") < LOOSE * size).select("item", "length")
    tight = packed.where(F.col("fill") >= LOOSE * size)
    again = written(pack_items(loose, size, seed=6), "packed")
    # Blocks number bins below 2**31: ids of the three kinds of sequence can't meet.
    name = lambda kind: (F.col("block") * F.lit(1 << 32) + F.col("bin")) * 3 + kind
    spots = tight.select("item", name(0).alias("sequence_id"), "offset").unionByName(again.select("item", name(1).alias("sequence_id"), "offset"))
    out = pieces.join(spots, "item", "left")
    return out.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence_id", F.col("item") * 3 + 2).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )
