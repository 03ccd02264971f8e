"""Quality scores by histogram gradient-boosted trees over statistics of the text.

The statistics of a document are one row of numbers; trees are fitted on a bounded sample
of labelled rows, kept as flat arrays (complete binary trees), and a batch of rows walks all
trees at once in numpy.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_or_empty, texts_of

SAMPLE = 20_000  # labelled rows that a model is fitted on, at most

FEATURES = [
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digit", "space", "newline", "comma_period", "other_mark",
    "non_ascii", "top_mark", "mark_kinds", "words_no_letter", "words_upper", "words_marked", "distinct_words", "top_word",
    "distinct_lines", "line_length", "words_per_period", "double_mark", "longest_word", "entropy",
]
_UPPER, _DIGIT = np.frombuffer(string.ascii_uppercase.encode(), np.uint8), np.frombuffer(string.digits.encode(), np.uint8)
_MARKS = np.frombuffer("".join(c for c in string.punctuation if c not in ".,").encode(), np.uint8)
_IS_MARK = np.zeros(256, bool)
_IS_MARK[_MARKS] = True


def features(text: str) -> list[float]:
    """The statistics of one whole text, all finite; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    marks = count[_MARKS]
    share = count[count > 0] / n
    is_mark = _IS_MARK[raw]
    marked = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,")
    no_letter = sum(c for w, c in seen.items() if not any(map(str.isalpha, w)))
    shouted = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), count[_UPPER].sum() / n, count[_DIGIT].sum() / n,
        count[32] / n, count[10] / n, (count[44] + count[46]) / n, marks.sum() / n, (raw > 127).mean(), marks.max() / n,
        float((marks > 0).sum()), no_letter / k, shouted / k, marked / k, len(seen) / k, max(seen.values(), default=0) / k,
        len(set(lines)) / len(lines), n / len(lines), k / (1 + count[46]), (is_mark[1:] & is_mark[:-1]).mean() if n > 1 else 0.0,
        sizes.max(), float(-(share * np.log(share)).sum()),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth: split features and cuts by node, values by leaf."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        margin = self.base + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, splits sought in histograms of binned features.

    Without rows the score is 0.5 everywhere, with one label a constant near it.
    """
    inner, k = (1 << depth) - 1, x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if len(np.unique(y)) < 2:
        return Trees(model.base, model.feature[:0], model.cut[:0], model.value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, columns = np.full(len(y), model.base), np.arange(k)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            flat = (((node - first)[:, None] * k + columns) * bins + binned).ravel()
            g, h = (np.bincount(flat, np.repeat(v, k), width * k * bins).reshape(width, k, bins) for v in (grad, hess))
            gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + i], model.cut[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        model.value[t] = rate * g / (h + ridge)
        margin += model.value[t, leaf]
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id as text leaves 2 modulo 4; false for a NULL id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_VECTORS = "doc_id long, x array<double>"


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **options) -> Trees:
    """Trees fitted on at most ``sample`` labelled rows, those with the smallest hash of their id.

    Held-out ids are left out. Several labels of an id count as their majority (1 in a
    tie); of several documents with an id one is used.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    # At most ``sample`` ids, so the broadcast and the collected rows are bounded.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id")
    vectors = rows.mapInArrow(run, _VECTORS).groupBy("doc_id").agg(F.min("x").alias("x"))
    got = vectors.join(F.broadcast(known), "doc_id").orderBy("doc_id").select("x", "y").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(got.num_rows, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(np.float64), **options)


def score_quality(docs: DataFrame, model: Trees, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if ``score >= threshold``).

    NULL text is empty and gets a score too. Columns of these names are replaced; every row
    gives one row.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in texts_of(batch.column(len(kept)))], np.float64).reshape(batch.num_rows, len(FEATURES))
            score = np.concatenate([model.scores(x[a : a + 2048]) for a in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*kept, "score", "predicted"])

    return docs.select(*kept, text_or_empty(text)).mapInArrow(run, schema)
