"""Vector best-fit packing of token sequences.

A bin has three residual capacities: tokens, documents and attention cost (the sum of
squared lengths). Pieces are placed from the longest to the shortest into the bin that
takes them under every constraint and whose residual, weighted and as a share of the
capacities, is the smallest afterwards (``rule="norm"``), or whose residual before has the
largest weighted dot product with the piece (``rule="dot"``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import materialise, pieces, text_or_empty, texts_of
from faultline.llm.encoding import encoder

GROUP = 1 << 13  # pieces packed together; each group leaves about one bin part filled

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def vector_best_fit(
    lengths: np.ndarray, tokens: int, documents: int, attention: int,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` are at most ``tokens`` and fit an empty bin."""
    capacity = np.array([tokens, documents, attention], np.float64)
    w = np.array(weights)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins, residual = np.empty(n, np.int64), np.empty((3, n), np.float64)
    m = n_bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        item = np.array([size, 1, size * size], np.float64)
        fits = np.flatnonzero((residual[0, :m] >= item[0]) & (residual[1, :m] >= 1) & (residual[2, :m] >= item[2]))
        if len(fits):
            share = residual[:, fits] / capacity[:, None]
            own = item / capacity
            if rule == "norm":
                k = fits[np.argmin(w @ np.square(share - own[:, None]))]
            else:
                k = fits[np.argmax((w * own) @ share)]
        else:
            k, m = m, m + 1
            open_bins[k], residual[:, k] = n_bins, capacity
            n_bins += 1
        bins[i], offsets[i] = open_bins[k], tokens - int(residual[0, k])
        residual[:, k] -= item
        if residual[0, k] < 1 or residual[1, k] < 1 or residual[2, k] < 1:  # full: the last open bin takes its place
            m -= 1
            open_bins[k], residual[:, k] = open_bins[m], residual[:, m]
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids with the end id, and the checksums of its pieces.

    A document longer than ``capacity`` is cut into pieces of that length; its first piece
    takes what is left over and may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts, sizes, sums = texts_of(batch.column(1)), [], []
            for a, b in pieces(texts, enc.BLOCK_CHARS):
                ids, lengths = enc.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
                raw, at = memoryview(ids).cast("B"), 0
                for n in (lengths + 1).tolist():
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    sums.append(np.array([zlib.crc32(raw[4 * (at + s) : 4 * (at + e)]) for s, e in zip(cuts, cuts[1:])], "<u4").tobytes())
                    sizes.append(n)
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary())], names=["doc_id", "n_tokens", "sums"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, sums binary")


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = 1024, max_documents: int | None = None,
         max_attention: int | None = None, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """One row per piece (``PIECES``): its bin is ``sequence_id``, its place there ``offset``.

    By default the other two capacities are those that ``capacity`` tokens imply, so that
    they never cost a bin; smaller ones bind. A piece that no empty bin takes raises an error. Whole pieces of a
    long document are bins of their own; the rest goes to random groups of about ``group``
    documents, packed each in one task, whose size doesn't follow the input. NULL text is
    empty (the end id alone); repeated rows are all packed; an empty table gives no rows.
    """
    documents = capacity if max_documents is None else max_documents
    attention = capacity * capacity if max_attention is None else max_attention
    if documents < 1 or attention < 1:
        raise ValueError("an empty bin has to take a piece")
    items = materialise(token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity)
                        .withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-items.count() // group))
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py() << 40
        table = table.sort_by([("n_tokens", "descending"), ("row", "ascending")])
        doc_ids, sums = table["doc_id"], [np.frombuffer(s, "<u4") for s in table["sums"].to_pylist()]
        n_tokens = table["n_tokens"].to_numpy()
        rest = (n_tokens - 1) % capacity + 1
        longest = int(np.where(n_tokens > capacity, capacity, rest).max())
        if longest * longest > attention:
            raise ValueError(f"no empty bin takes a piece of {longest} tokens")
        packed = rest < capacity
        bins, offsets = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        bins[packed], offsets[packed] = vector_best_fit(rest[packed], capacity, documents, attention, rule=rule)
        counts = np.array([len(s) for s in sums], np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = piece == 0
        start = np.where(first, 0, rest[doc] + (piece - 1) * capacity)
        alone = ~first | ~packed[doc]
        sequence = bins[doc]
        sequence[alone] = (int(bins[packed].max()) + 1 if packed.any() else 0) + np.arange(int(alone.sum()))
        values = [doc_ids.take(pa.array(doc)), piece, start, np.where(first, rest[doc], capacity),
                  np.concatenate(sums).astype(np.int64), sequence + number, np.where(first, offsets[doc], 0)]
        fields = [f.split() for f in PIECES.split(", ")]
        return pa.table({n: v if isinstance(v, pa.ChunkedArray) else pa.array(v.astype("int64")).cast(kinds[t])
                         for v, (n, t) in zip(values, fields)}).select(names)

    # A group is little data and much work: deal groups out by number, which small sizes don't undo.
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups))).repartition(tasks, "bucket")
    return dealt.groupBy("bucket").applyInArrow(run, PIECES)
