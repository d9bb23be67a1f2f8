"""Toxicity by a classifier chain of linear models trained with out-of-fold predictions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, trim, trimmed, written

#: At most so many labelled documents, those of lowest hashed id, train the chain.
SAMPLE = 12_000
#: Features that each category's model looks at: those of highest chi-squared, of so many candidates.
VOCABULARY, CANDIDATES = 256, 6000
FOLDS = 5
#: Rows whose features are listed at once: a text shows up to a hundred thousand.
ROWS = 16
#: Words whose roots a worker remembers.
WORDS = 300_000
#: A feature is a word or a word's beginning (``^`` and its letters), at least so often in a text.
PREFIXES, LEVELS = range(3, 9), (1, 2, 4)
_WORD = re.compile(r"[^\W_]+")


def roots(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if n <= len(word))]


def features(text: str | None, of=roots) -> set[str]:
    """What a text shows: roots of its words, with ``#n`` for those found n times or more."""
    found: dict[str, int] = {}
    for w in _WORD.findall((text or "").lower()):
        for r in of(w):
            found[r] = found.get(r, 0) + 1
    return {r if k == 1 else f"{r}#{k}" for r, n in found.items() for k in LEVELS if n >= k}


class Known(dict):
    """The roots of a word that a model knows, remembered for up to ``WORDS`` words."""

    def __init__(self, names):
        super().__init__()
        self.names = {n.partition("#")[0] for n in names}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= WORDS:
            self.clear()
        out = self[word] = tuple(r for r in roots(word) if r in self.names)
        return out


@dataclass
class Link:
    """One category's linear model: weights of features, of earlier categories' probabilities, and a bias."""

    category: str
    weights: dict[str, float]
    earlier: list[float]
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def predict(self, found: set[str]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            z = link.bias + sum(w * p for w, p in zip(link.earlier, out))
            z += sum(link.weights[w] for w in found & link.weights.keys())
            out.append(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))
        return out


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 0.3) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias, which isn't shrunk."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = np.diag(ridge)
        for at in range(0, len(x), 1024):  # copies of few rows at a time
            part, q = x[at : at + 1024], p[at : at + 1024]
            h += (part * (q * (1 - q) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_bias(*parts: np.ndarray) -> np.ndarray:
    return np.column_stack([*parts, np.ones(len(parts[0]))])


def _apart(best: list[tuple[str, float, int, int]]) -> list[str]:
    """The best features, of those that mark the same texts (one begins the other, equal counts) only the shortest."""
    out, seen = [], {}
    for w, _, n, p in sorted(best, key=lambda r: (-r[1], len(r[0]), r[0])):
        stem = w.partition("#")[0].lstrip("^")
        if any(stem.startswith(k) or k.startswith(stem) for k in seen.setdefault((n, p), [])):
            continue
        seen[n, p].append(stem)
        out.append(w)
    return out[:VOCABULARY]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, ``text``, as its features ``w``; few rows at a time, whatever comes in."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            c = b.slice(at, ROWS)
            w = pa.array([sorted(features(t)) for t in c.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*c.columns[:-1], w], [*c.schema.names[:-1], "w"])


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Chain:
    """Train a model per category, in order, each also fed the probabilities of those before it.

    Training uses at most ``sample`` labelled documents. What a later model
    sees of earlier ones in training comes from models that didn't see that
    document (``FOLDS`` folds by hashed id); in use it comes from the models of
    all folds together. Null labels leave a row out of that category only; a
    category with a single class, or none, predicts its rate. Ids that repeat
    in ``labels`` take the larger label; documents of one id are each a row.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(*[F.max(F.col(c)).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    ys = [f"y{i}" for i in range(len(categories))]

    # One text per id, however often the id repeats: what is collected below is at most ``sample`` rows.
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    picked = picked.groupBy("__id", *ys).agg(F.min("text").alias("text")).select("__id", *ys, "text")
    rows = picked.mapInArrow(trimmed(_tokens), f"__id {dict(docs.dtypes)[id_col]}, {', '.join(f'{y} int' for y in ys)}, w array<string>")
    rows = written(rows, "labelled")
    totals = rows.agg(*[f for y in ys for f in (F.count(y), F.coalesce(F.sum(y), F.lit(0)))]).first()
    counts = rows.select(F.explode("w").alias("w"), *ys).groupBy("w").agg(
        *[f for y in ys for f in (F.count(y).alias(f"n{y}"), F.coalesce(F.sum(y), F.lit(0)).alias(f"p{y}"))]
    )
    vocabularies = []
    for i, y in enumerate(ys):
        n, pos = float(totals[2 * i]), float(totals[2 * i + 1])
        a, b = F.col(f"p{y}"), F.col(f"n{y}") - F.col(f"p{y}")
        c, d = pos - a, (n - pos) - b
        # Null for what every text shows, which tells nothing.
        chi = F.try_divide(n * (a * d - b * c) ** 2, (a + b) * (c + d) * pos * (n - pos)) if 0 < pos < n else F.lit(0.0)
        best = counts.where(F.col(f"n{y}") >= 3).select("w", chi.alias("chi"), f"n{y}", f"p{y}").where("chi > 15").orderBy(F.desc("chi"), "w").limit(CANDIDATES)
        vocabularies.append(_apart([tuple(r) for r in best.collect()]))
    known = sorted({w for v in vocabularies for w in v})
    at = {w: i for i, w in enumerate(known)}
    # At most ``sample`` rows, each with the numbers of the few chosen features it has.
    names = F.array(*[F.lit(w) for w in known]).cast("array<string>")
    numbers = F.transform(F.array_intersect("w", names), lambda w: F.array_position(names, w).cast("int"))
    got = rows.select(*ys, numbers.alias("w"), F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS)).alias("fold")).toArrow()
    release(rows)
    x = np.zeros((len(got), len(known)), bool)
    has = got.column("w").combine_chunks()
    x[np.repeat(np.arange(len(got)), has.value_lengths().to_numpy()), has.flatten().to_numpy() - 1] = True
    fold = got.column("fold").to_numpy().astype(int)
    chain, before = Chain(), np.zeros((len(got), 0))
    for i, category in enumerate(categories):
        y = np.array([np.nan if v is None else float(v > 0) for v in got.column(ys[i]).to_pylist()])
        own = x[:, [at[w] for w in vocabularies[i]]].astype(float)
        z, has = _with_bias(own, before) if len(got) else np.zeros((0, 1)), ~np.isnan(y)
        rate = float(y[has].mean()) if has.any() else 0.0

        def model(rows: np.ndarray) -> np.ndarray:
            if len(set(y[rows])) == 2:
                return _fit(z[rows], y[rows])
            r = min(max(float(y[rows].mean()) if rows.any() else rate, 1e-6), 1 - 1e-6)
            return np.append(np.zeros(z.shape[1] - 1), np.log(r / (1 - r)))

        oof = np.zeros(len(got))
        for k in range(FOLDS):
            mine = fold == k
            oof[mine] = 1 / (1 + np.exp(-np.clip(z[mine] @ model(has & ~mine), -40, 40)))
        w = model(has)
        v = len(vocabularies[i])
        chain.links.append(Link(category, dict(zip(vocabularies[i], w[:v].tolist())), w[v:-1].tolist(), float(w[-1])))
        before = np.column_stack([before, oof])
        del own, z
        trim()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the chain's probability of each category, over whole texts; a null or empty text has no features."""
    names = [f"p_{link.category}" for link in chain.links]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known([w for link in chain.links for w in link.weights])
        for f in frames:
            p = np.array([chain.predict(features(t, known.__getitem__)) for t in f["text"]]).reshape(len(f), len(names))
            yield pd.DataFrame({"id": f["id"]} | {n: p[:, i] for i, n in enumerate(names)})

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = slim.mapInPandas(apply, f"id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"`{n}` double" for n in names))
    return out.withColumnRenamed("id", id_col)


def keep(docs: DataFrame, chain: Chain, target: str, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, as they are, that the chain does not find ``target``."""
    at = [link.category for link in chain.links].index(target)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known([w for link in chain.links for w in link.weights])
        for b in batches:
            ok = [chain.predict(features(t, known.__getitem__))[at] < threshold for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(trimmed(apply), docs.schema)


def flag_toxic(
    docs: DataFrame, labels: DataFrame, categories=("quality", "toxic"), target: str = "toxic", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fit the chain on ``labels`` and judge every document: id, ``p_<category>`` of each, and ``toxic``.

    The chain runs over all categories that are labelled, ``target`` last.
    One row per document, repeated rows included; an empty table gives none.
    """
    chain = fit_chain(docs, labels, list(categories), id_col, text_col)
    return score(docs, chain, id_col, text_col).withColumn("toxic", F.col(f"p_{target}") >= threshold)
