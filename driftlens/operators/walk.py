"""Walks from many roots over a graph in files that the workers map."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, folder

#: Nodes whose part of the files one task writes; pairs of root and node that a walk of several roots may hold; rows of a batch given back.
CHUNK, PAIRS, BATCH = 1 << 18, 1 << 22, 1 << 17


def local_folder(df: DataFrame) -> str | None:
    """The shared folder as a path, or None where it is not on a mounted file system."""
    where = folder(df.sparkSession)
    if where.startswith("file:"):
        return "/" + where[5:].lstrip("/")
    return where if where.startswith("/") else None


def _numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """``names`` with a gapless long ``id``, and how many there are."""
    kept = cut(names.withColumn("m", F.monotonically_increasing_id()))
    part, base, total = F.shiftright("m", 33), [], 0
    for p, n in sorted(kept.groupBy(part.alias("p")).count().collect()):
        base.append((p, total))
        total += n
    bases = kept.sparkSession.createDataFrame(base, "p long, base long")
    low = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("p", part).join(F.broadcast(bases), "p").select("name", "pub", "priv", (F.col("base") + low).alias("id")), total


def walk_files(calls: DataFrame, changed: DataFrame, functions: DataFrame) -> DataFrame:
    """``root``, ``broken``, ``confidence``, ``depth`` as ``graph.walk_up`` finds them, without shuffling a pair.

    The graph is shuffled once into files: of each node the numbers of its
    callers, one after another. Workers map them, take changed rows by the
    batch and walk all of a batch at a time; where that comes to over ``PAIRS``
    pairs, it is halved, so a task holds that many or one root's nodes. Pairs
    that were met are known to the task alone and never written.
    """
    texts = functions.select(F.col("name").cast("string").alias("name"), "is_public").unionByName(changed.select(F.col("root").cast("string").alias("name"), F.lit(None).cast("boolean").alias("is_public")))
    ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    ids, total = _numbered(texts.where("name is not null").groupBy("name").agg(ever(F.col("is_public")).alias("pub"), ever(~F.col("is_public")).alias("priv")))
    chunk = F.floor(F.col("id") / CHUNK).cast("long").alias("chunk")
    side = lambda c, n, keep: ids.where(keep).select(F.col("name").alias(c), F.col("id").alias(n))
    edges = calls.where("caller <> callee").select(F.col("caller").cast("string").alias("caller"), F.col("callee").cast("string").alias("callee"))
    edges = edges.join(side("caller", "c", "pub or priv"), "caller").join(side("callee", "id", "true"), "callee").select("c", "id")
    edges = cut(edges.withColumn("chunk", chunk))

    base = f"{local_folder(calls)}/walk-{uuid.uuid4().hex[:12]}"
    os.makedirs(base)

    def room(name: str, sizes: list) -> dict:
        """Where each chunk's part of a file begins; the file is made as long as all of them."""
        begin, at = {}, 0
        for k, n in sorted(sizes):
            begin[k], at = at, at + n
        with open(f"{base}/{name}", "wb") as f:
            f.truncate(max(at, 1) * (4 if name == "caller" else 1))
        return begin

    for name, width in (("start", 8), ("stop", 8), ("flag", 1), ("name_at", 8)):
        with open(f"{base}/{name}", "wb") as f:
            f.truncate((total + 1) * width)
    edge_at = room("caller", [tuple(r) for r in edges.groupBy("chunk").count().collect()])
    sizes = ids.groupBy(chunk).agg(F.sum(F.octet_length("name")).alias("n")).collect()
    name_at = room("name", [tuple(r) for r in sizes])
    name_end, size = sum(r.n for r in sizes), CHUNK

    def put(name: str, kind, at: int, values) -> None:
        if len(values):
            room = np.memmap(f"{base}/{name}", kind, "r+", at * np.dtype(kind).itemsize, (len(values),))
            room[:] = values
            room.flush()

    # A task that runs twice writes the same bytes: what a chunk holds is sorted first.
    def put_edges(t: pa.Table) -> pa.Table:
        k = t["chunk"][0].as_py()
        first, n = k * size, min(size, total - k * size)
        key = np.unique((t["id"].to_numpy() - first) * total + t["c"].to_numpy())
        put("caller", np.int32 if total < 1 << 31 else np.int64, edge_at[k], key % total)
        ends = edge_at[k] + np.searchsorted(key // total, np.arange(n + 1))
        put("start", np.int64, first, ends[:-1])
        put("stop", np.int64, first, ends[1:])
        return pa.table({"chunk": pa.array([k], pa.int64())})

    def put_nodes(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        k = t["chunk"][0].as_py()
        raw = [x.encode() for x in t["name"].to_pylist()]
        put("flag", np.uint8, k * size, t["pub"].to_numpy().astype(np.uint8) + 2 * t["priv"].to_numpy().astype(np.uint8))
        put("name_at", np.int64, k * size, name_at[k] + np.cumsum([0, *map(len, raw[:-1])]))
        put("name", np.uint8, name_at[k], np.frombuffer(b"".join(raw), np.uint8))
        return pa.table({"chunk": pa.array([k], pa.int64())})

    if total >= 1 << 31:
        raise RuntimeError("over 2^31 functions")
    for table, by in ((edges, put_edges), (ids.select("id", "name", "pub", "priv", chunk), put_nodes)):
        table.groupBy("chunk").applyInArrow(by, "chunk long").count()
    with open(f"{base}/name_at", "r+b") as f:
        f.seek(8 * total)
        f.write(np.int64(name_end).tobytes())
    most, out_rows = PAIRS, BATCH

    def run(batches):
        start, stop, caller, flag = (np.memmap(f"{base}/{n}", k, "r") for n, k in (("start", np.int64), ("stop", np.int64), ("caller", np.int32), ("flag", np.uint8)))
        names = pa.LargeStringArray.from_buffers(total, pa.py_buffer(np.memmap(f"{base}/name_at", np.int64, "r")), pa.py_buffer(np.memmap(f"{base}/name", np.uint8, "r")))

        def walk(ids):
            """Public ends of the walks: indexes of ``ids``, nodes, depths; None where they are too many at once."""
            seen, found, depth = np.arange(len(ids)) * total + ids, [], 0
            seen.sort()
            front = seen
            while len(front):
                depth += 1
                who, at = np.divmod(front, total)
                n = stop[at] - start[at]
                if len(ids) > 1 and len(seen) + n.sum() > most:
                    return None
                place = np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)
                new = np.unique(np.repeat(who * total, n) + caller[place])
                spot = np.minimum(np.searchsorted(seen, new), len(seen) - 1)
                new = new[seen[spot] != new]
                seen = np.sort(np.concatenate([seen, new]), kind="stable")
                kind = flag[new % total]
                found.append((new[kind & 1 > 0], depth))
                front = new[kind & 2 > 0]
            ends = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.int64)
            depths = np.concatenate([np.full(len(f), d, np.int32) for f, d in found]) if found else np.zeros(0, np.int32)
            return *np.divmod(ends, total), depths

        for b in batches:
            todo = [(0, len(b))]
            while todo:
                low, high = todo.pop()
                ends = walk(b.column(0).to_numpy()[low:high]) if high > low else None
                if ends is None:
                    if high > low:
                        mid = (low + high) // 2
                        todo += [(mid, high), (low, mid)]
                    continue
                for i in range(0, len(ends[0]), out_rows):
                    who, at, depths = (pa.array(x[i : i + out_rows]) for x in ends)
                    who = pa.compute.add(who, low)
                    yield pa.RecordBatch.from_arrays([b.column(1).take(who), names.take(at).cast(pa.string()), b.column(2).take(who), depths], ["root", "broken", "confidence", "depth"])

    rows = changed.select(F.col("root").cast("string").alias("name"), F.col("confidence").cast("double").alias("confidence")).join(ids.select("name", "id"), "name").select("id", "name", "confidence")
    rows = cut(rows)
    parts = max(rows.count() // 40_000, rows.sparkSession.sparkContext.defaultParallelism)
    hits = rows.repartition(parts).mapInArrow(run, "root string, broken string, confidence double, depth int")
    return hits.select(F.col("root").cast(changed.schema["root"].dataType).alias("root"), F.col("broken").cast(calls.schema["caller"].dataType).alias("broken"), "confidence", "depth")
