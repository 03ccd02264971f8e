"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of hashed character n-grams of its words. The ratio of a bucket is the
logarithm of its smoothed share among toxic over that among clean texts; a logistic model is
fitted on presence times ratio, so that buckets that both kinds share hardly count. Texts are
turned into buckets and scored in the tasks; the driver holds one bounded sample and two
vectors of ``BUCKETS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import mix, text_or_empty, texts_of

SAMPLE = 4_000  # labelled rows of each label that a model is fitted on, at most
SIZES = (3, 4, 5, 6)  # characters of an n-gram, a space at either end of a word counted
BUCKETS = 1 << 18


def buckets(text: str, sizes: tuple[int, ...] = SIZES, most: int = BUCKETS) -> np.ndarray:
    """Sorted distinct buckets of the character n-grams of the whole text's lower-case words.

    An n-gram lies in one word with a space before and after it; an empty text has none.
    """
    words = set(text.lower().split())
    if not words:
        return np.zeros(0, np.int32)
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    spaces = np.concatenate([[0], np.cumsum(chars == 32)])
    found = np.zeros(most, bool)
    run = chars
    for n in range(2, max(sizes) + 1):
        run = run[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        if n in sizes and len(run):
            inside = spaces[n - 1 : len(chars)] == spaces[1 : len(chars) - n + 2]
            found[mix(run[inside] + np.uint64(n)) % np.uint64(most)] = True
    return np.flatnonzero(found).astype(np.int32)


@dataclass
class Linear:
    """Intercept and one weight for each bucket, the ratio multiplied in."""

    base: float
    weight: np.ndarray

    def score(self, found: np.ndarray) -> float:
        margin = self.base + float(self.weight[found].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def ratios(rows: list[np.ndarray], y: np.ndarray, most: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """Logarithm of each bucket's smoothed share of the toxic over that of the clean rows' buckets."""
    count = np.full((2, most), smooth)
    for found, label in zip(rows, y):
        count[int(label), found] += 1
    share = np.log(count / count.sum(axis=1, keepdims=True))
    return share[1] - share[0]


def fit(rows: list[np.ndarray], y: np.ndarray, odds: float, most: int = BUCKETS, ridge: float = 1e-4, rounds: int = 60, block: int = 512) -> Linear:
    """A logistic model on the rows' buckets; ``odds`` are those of label 1 among all labelled rows.

    The sample holds the labels in other shares than the corpus; the intercept is moved by the
    difference of the log odds. With one label only, or none, the score is constant.
    """
    toxic = float(y.sum())
    if not 0 < toxic < len(y):
        return Linear(float(np.log(odds)), np.zeros(most))
    ratio = ratios(rows, y, most)
    parts = [slice(a, a + block) for a in range(0, len(rows), block)]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        weight, value, gradient = v[:-1] * ratio, 0.0, np.zeros(most + 1)
        for part in parts:
            flat, sizes, truth = np.concatenate(rows[part]), [len(r) for r in rows[part]], y[part]
            ends = np.concatenate([[0], np.cumsum(weight[flat])])[np.cumsum([0, *sizes])]
            margin = v[-1] + np.diff(ends)
            slope = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - truth
            value += float(np.logaddexp(0, np.where(truth > 0, -margin, margin)).sum())
            gradient[:-1] += np.bincount(flat, np.repeat(slope, sizes), most)
            gradient[-1] += slope.sum()
        gradient /= len(y)
        gradient[:-1] = gradient[:-1] * ratio + ridge * v[:-1]
        return value / len(y) + ridge / 2 * float(v[:-1] @ v[:-1]), gradient

    prior = float(np.log(toxic / (len(y) - toxic)))
    v = minimise(loss, np.append(np.zeros(most), prior), rounds)
    return Linear(float(v[-1] + np.log(odds) - prior), v[:-1] * ratio)


def minimise(loss, v: np.ndarray, rounds: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with halved steps, until the gradient or the rounds end."""
    value, slope = loss(v)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < tolerance:
            break
        way, factors = slope.copy(), []
        for s, g in reversed(steps):
            factors.append((s @ way) / (s @ g))
            way -= factors[-1] * g
        if steps:
            way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, g), a in zip(steps, reversed(factors)):
            way += (a - (g @ way) / (s @ g)) * s
        size, fall = 1.0, float(slope @ way)
        for _ in range(30):
            new = v - size * way
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        if (new - v) @ (new_slope - slope) > 1e-12:
            steps = [*steps[1 - memory :], (new - v, new_slope - slope)]
        v, value, slope = new, new_value, new_slope
    return v


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id as text leaves 1 modulo 3; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **options) -> Linear:
    """A model fitted on at most ``sample`` rows of each label, those with the smallest hash of their id.

    Held-out ids, NULL ids and NULL labels are left out. Several labels of an id count as their
    majority (toxic in a tie); of several documents with an id, the one whose buckets sort
    first is used. The odds of the labels are counted over all of them.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    ).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    counted = dict(known.groupBy("y").count().collect())
    first = [known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = first[0].unionByName(first[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(t).tobytes() for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "found"])

    # At most ``sample`` ids of each label, so the broadcast and the collected rows are bounded.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    vectors = rows.mapInArrow(run, "doc_id long, found binary").groupBy("doc_id").agg(F.min("found").alias("found"))
    got = vectors.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").select("found", "y").toArrow()
    sets = [np.frombuffer(b, np.int32) for b in got["found"].to_pylist()]
    odds = (counted.get(1, 0) + 0.5) / (counted.get(0, 0) + 0.5)
    return fit(sets, got["y"].to_numpy().astype(np.float64), odds, **options)


def score_toxicity(docs: DataFrame, model: Linear, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    NULL text is empty and gets the score of a text without n-grams. Columns of these names are
    replaced; every row gives one row.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(buckets(t)) for t in texts_of(batch.column(len(kept)))], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=[*kept, "score", "predicted"])

    return docs.select(*kept, text_or_empty(text)).mapInArrow(run, schema)
