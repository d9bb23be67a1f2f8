"""Exact removal of long repeated substrings by a distributed merge sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_filter, release, written

#: Bytes of a string that must repeat, and of the part of it that an anchor is chosen by.
LENGTH, CORE = 200, 72
#: Anchors that one partition of the first exchange holds on average.
ANCHORS = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
_ANCHOR = np.dtype([("core", "<u8"), ("context", "<u8"), ("tid", "<i8"), ("pos", "<i4"), ("lo", "<u2"), ("hi", "<u2")])


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        step = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        step[0] = 1
        got = _POWERS[base, inverse] = np.cumprod(step)
    return got[:n]


class Prefixes:
    """Polynomial hashes of any substring of ``data`` from running sums."""

    def __init__(self, data: np.ndarray, base: int):
        self.base, n = base, len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(base, False, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _powers(self.base, True, len(self.sums))[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray) -> np.ndarray:
    """For every string of LENGTH bytes, the leftmost least-hashed CORE bytes in it: equal strings, equal place.

    A row per anchor: its position, and how far before it the first and the
    last string start that it was chosen for.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, _ANCHOR)
    sums = Prefixes(data, _BASES[0])
    at = np.arange(n - CORE + 1)
    h = sums.of(at, at + CORE)
    window, least, span = LENGTH - CORE + 1, at, 1
    while span * 2 <= window:
        left, right = least[:-span], least[span:]
        least = np.where(h[right] < h[left], right, left)
        span *= 2
    if rest := window - span:
        left, right = least[:-rest], least[rest:]
        least = np.where(h[right] < h[left], right, left)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    out = np.zeros(len(first), _ANCHOR)
    pos = least[first]
    out["core"], out["pos"], out["lo"], out["hi"] = h[pos], pos, pos - first, pos - last
    shape = (out["lo"].astype(np.uint64) << np.uint64(16)) + out["hi"]
    out["context"] = (sums.of(first, last + LENGTH) + shape) * np.uint64(0xFF51AFD7ED558CCD)
    return out


def _find(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("data")):
                a = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                a["tid"] = tid
                found.append(a)
            a = np.concatenate(found) if found else np.zeros(0, _ANCHOR)
            part = (a["core"] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            a, part = a[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(a) else []
            ends = [*cuts[1:], len(a)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[c]) for c in cuts], pa.int32()), pa.array([a[c:e].tobytes() for c, e in zip(cuts, ends)], pa.binary())], ["part", "blob"]
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose core occurs twice: ``whole`` if the context does too; else, or as a context's one witness, ``open``."""
    blobs = [x.as_py() for b in batches for x in b.column("blob")]
    a = np.frombuffer(b"".join(blobs), _ANCHOR)
    del blobs
    a = a[np.lexsort((a["pos"], a["tid"], a["context"], a["core"]))]
    core_new = np.r_[True, a["core"][1:] != a["core"][:-1]] if len(a) else np.zeros(0, bool)
    new = core_new | np.r_[True, a["context"][1:] != a["context"][:-1]] if len(a) else core_new
    cores = np.cumsum(core_new) - 1
    contexts = np.cumsum(new) - 1
    copies = np.bincount(contexts) if len(a) else np.zeros(0, int)
    kinds = np.bincount(cores, weights=new).astype(int) if len(a) else np.zeros(0, int)
    whole = copies[contexts] > 1 if len(a) else new
    opened = new & (kinds[cores] > 1) if len(a) else new
    keep = whole | opened
    a, whole, opened = a[keep], whole[keep], opened[keep]
    for i in range(0, len(a), 200_000):
        s = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a["tid"][s]), pa.array(a["core"][s].view(np.int64)), pa.array(a["pos"][s]), pa.array(a["lo"][s].astype(np.int32)), pa.array(a["hi"][s].astype(np.int32)), pa.array(whole[s]), pa.array(opened[s])],
            ["tid", "core", "pos", "lo", "hi", "whole", "opened"],
        )


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = np.frombuffer(a, np.uint8, n - start, start) != np.frombuffer(b, np.uint8, n - start, start)
    return start + int(x.argmax())


def front_coded(records: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, rest): each suffix as the bytes shared with the one before and those that follow."""
    out, before = [], b""
    for suffix, rest in sorted(records):
        k = common_prefix(before, suffix)
        out.append(k.to_bytes(2, "little") + (len(suffix) - k).to_bytes(2, "little") + len(rest).to_bytes(2, "little") + suffix[k:] + rest)
        before = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(bytes shared with the one before, suffix, rest) of a front-coded run."""
    at, before = 0, b""
    while at < len(run):
        k, n, m = (int.from_bytes(run[at + i : at + i + 2], "little") for i in (0, 2, 4))
        before = before[:k] + run[at + 6 : at + 6 + n]
        yield k, before, run[at + 6 + n : at + 6 + n + m]
        at += 6 + n + m


def merged(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge front-coded runs by a loser tree that never compares a known common prefix again.

    Every waiting suffix carries its common prefix with the last winner. Of two
    with unequal ones the longer comes first, unread; only ties are compared,
    from there on. Yields (common prefix with the one before, suffix, rest).
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    sources = [decoded(r) for r in runs] + [iter(())] * (size - len(runs))
    heads: list = [next(s, None) for s in sources]
    shared = [0] * size

    def first(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it shares with the winner."""
        if heads[i] is None or heads[j] is None:
            return (j, i) if heads[i] is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        a, b = heads[i][1], heads[j][1]
        k = common_prefix(a, b, shared[i])
        i, j = (j, i) if b[k:] < a[k:] else (i, j)
        shared[j] = k
        return i, j

    losers = [0] * size
    winners = [*[0] * size, *range(size)]
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = first(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        yield shared[top], heads[top][1], heads[top][2]
        heads[top] = next(sources[top], None)
        shared[top] = heads[top][0] if heads[top] is not None else 0
        node = (top + size) // 2
        while node:
            top, losers[node] = first(top, losers[node])
            node //= 2


#: Classes of suffixes that are worked out at a time.
CLASSES = 1 << 20
_REST = np.dtype([("tid", "<i8"), ("pos", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("many", "u1")])


def _cut(parts: int):
    """Sorted, front-coded runs of the open anchors' suffixes, with the bytes before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list] = {}
            for tid, text, found in zip(batch.column("tid").to_pylist(), batch.column("data"), batch.column("found").to_pylist()):
                data = memoryview(text.as_buffer())
                for x in found:
                    pos, lo, hi = x["pos"], x["lo"], x["hi"]
                    rest = np.array([(tid, pos, lo, hi, x["whole"])], _REST).tobytes() + bytes(data[pos - lo : pos])
                    part = int(np.int64(x["core"]).view(np.uint64) % np.uint64(parts))
                    by.setdefault(part, []).append((bytes(data[pos : pos - hi + LENGTH]), rest))
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([front_coded(v) for v in by.values()], pa.binary())], ["part", "run"])

    return run


def _group_spans(group: list[tuple[bytes, bytes]], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Of sorted suffixes with one core, the strings that another of them (or a copy of its context) holds too.

    ``shared`` are the merge's common prefixes of each suffix with the one
    before: two strings agree from the core on where none between them is
    shorter than what the string has there.
    """
    rests = np.frombuffer(b"".join(r[: _REST.itemsize] for _, r in group), _REST)
    data = np.frombuffer(b"".join(r[_REST.itemsize :] + s for s, r in group), np.uint8)
    sizes = np.array([len(r) - _REST.itemsize + len(s) for s, r in group])
    ends = np.cumsum(sizes)
    counts = sizes - LENGTH + 1
    who = np.repeat(np.arange(len(group)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (ends - sizes)[who] + nth
    # A string is told by where in it the core lies, by its class from there on, and by two hashes of what stands before.
    place = rests["lo"][who].astype(np.int64) - nth
    after, prefixes = np.zeros(len(start), np.int64), np.array(shared)
    most = int(place.max()) + 1
    for low in range(0, most, step := min(most, max(1, CLASSES // len(group)))):
        places = np.arange(low, low + step)
        classes = np.cumsum(prefixes[None, :] < (LENGTH - places)[:, None], axis=1)
        mine = (place >= low) & (place < low + step)
        after[mine] = classes[place[mine] - low, who[mine]]
    a, b = (Prefixes(data, base).of(start, start + place) for base in _BASES)
    order = np.lexsort((b, a, after, place))
    new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (a, b, after, place)], axis=0)]
    group_of = np.cumsum(new) - 1
    weight = 1 + rests["many"][who[order]].astype(np.int64)
    hit = np.zeros(len(start), bool)
    hit[order] = np.bincount(group_of, weights=weight)[group_of] > 1
    for i in np.flatnonzero(np.bincount(who, weights=hit)):
        if rests["many"][i]:
            continue
        mine = nth[(who == i) & hit] if len(group) < 50 else nth[np.searchsorted(who, i) : np.searchsorted(who, i, "right")][hit[np.searchsorted(who, i) : np.searchsorted(who, i, "right")]]
        base = int(rests["pos"][i]) - int(rests["lo"][i])
        cut = np.flatnonzero(np.r_[True, np.diff(mine) > 1])
        for lo, hi in zip(mine[cut], mine[np.r_[cut[1:], len(mine)] - 1]):
            yield int(rests["tid"][i]), base + int(lo), base + int(hi) + LENGTH


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = [x.as_py() for b in batches for x in b.column("run")]
    out: list[tuple[int, int, int]] = []
    group, prefixes = [], []
    for shared, suffix, rest in merged(runs):
        if shared < CORE and group:
            if len(group) > 1:
                out += _group_spans(group, prefixes)
            group, prefixes = [], []
        group.append((suffix, rest))
        prefixes.append(shared)
    if len(group) > 1:
        out += _group_spans(group, prefixes)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["tid", "lo", "hi"])


_OUT = "data binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for x, spans in zip(batch.column("data"), batch.column("spans").to_pylist()):
                data, at, parts, removed, n = x.as_py(), 0, [], 0, 0
                end = -1
                for s in sorted(spans or [], key=lambda s: s["lo"]):
                    lo, hi = s["lo"], s["hi"]
                    if lo > end:  # a span that touches the one before goes on with it
                        parts.append(data[at:lo])
                        n += 1
                        removed += hi - lo
                    else:
                        removed += max(0, hi - end)
                    end = at = max(end, hi)
                rest = b"".join([*parts, data[at:]])
                kept.append(rest if text else None)
                rows.append((len(data), removed, n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(kept, pa.binary()), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "data", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Byte spans of ``data`` (by ``tid``) that are covered by strings of LENGTH bytes which occur twice anywhere.

    Anchors pick few suffixes, the same in equal strings. The first exchange
    drops those whose core is unique and settles contexts that recur as a
    whole. The suffixes of the others are sorted in runs, exchanged front-coded
    and merged by loser trees; within a core, strings are matched one by one.
    """
    total = texts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 2 * total // (LENGTH - CORE + 2) // ANCHORS)
    found = texts.where(F.octet_length("data") >= LENGTH).mapInArrow(_find(parts), "part int, blob binary")
    kept = found.repartition(parts, "part").mapInArrow(_repeated, "tid long, core long, pos int, lo int, hi int, whole boolean, opened boolean")
    kept = written(kept, "anchors")
    whole = kept.where("whole").select("tid", (F.col("pos") - F.col("lo")).cast("long").alias("lo"), (F.col("pos") - F.col("hi") + LENGTH).cast("long").alias("hi"))
    opened = kept.where("opened").groupBy("tid").agg(F.collect_list(F.struct("core", "pos", "lo", "hi", "whole")).alias("found"))
    opened = written(opened, "open")
    some = bitmap_filter(texts.withColumn("h", F.xxhash64("tid")), "h", opened.select(F.xxhash64("tid").alias("h")), "may").where("may")
    # One copy of a text is enough: all have its spans.
    runs = some.select("tid", "data").dropDuplicates(["tid"]).join(opened, "tid").mapInArrow(_cut(parts), "part int, run binary")
    matched = runs.repartition(parts, "part").mapInArrow(_match, "tid long, lo long, hi long")
    return written(whole.unionByName(matched), "spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every byte covered by a string of 200 bytes that also starts anywhere else, the same text included.

    Texts are UTF-8 bytes; strings never cross texts; overlapping ones count,
    and all are judged on the input. Returns a row per row: ``id_col``,
    ``data`` (the remaining bytes; null with ``texts=False``), ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``.
    Null counts as empty; texts under 200 bytes lose nothing; repeated rows are
    copies of each other and lose all of 200 bytes or more; extra columns are
    ignored; an empty table gives no rows.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    docs = df.select(F.col(id_col).alias("id"), data.alias("data")).withColumn("tid", F.xxhash64("id", F.md5("data")))
    spans = repeated_spans(docs.select("tid", "data"))
    by = written(spans.groupBy("tid").agg(F.array_distinct(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "by")
    marked = bitmap_filter(docs.withColumn("h", F.xxhash64("tid")), "h", by.select(F.xxhash64("tid").alias("h")), "may").drop("h")
    id_type = dict(df.dtypes)[id_col]
    cut = marked.where("may").select("id", "tid", "data").join(by, "tid", "left").select("id", "data", "spans")
    cut = cut.mapInArrow(_apply(texts), f"id {id_type}, {_OUT}")
    free = marked.where("not may").select(
        "id", (F.col("data") if texts else F.lit(None).cast("binary")).alias("data"), F.octet_length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256")
    )
    release(spans)
    return cut.unionByName(free).withColumnRenamed("id", id_col)
