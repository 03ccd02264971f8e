"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; it hashes the tokens at its ones and ignores
the others, so that a changed token on an ignored place leaves the hash alone. The hashes of
all windows of the benchmark are joined with those of the documents; around each hit the
benchmark item is laid over the document, and an overlap counts if enough of its tokens are
equal, wherever the substitutions stand.

Documents drop hashes that no benchmark window has by a bitmap of bounded size before
anything is shuffled; the join decides, so a full bitmap costs rows and never results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import WordHashes, hash_bitmap, materialise, mix, pieces, ragged, text_or_empty, texts_of

# Five ones each, spans of 6 to 9. Every run with at least 12 equal tokens and a share of at
# least 0.7 contains one of them, however its substitutions lie (shown in tests/llm/test_edges.py).
MASKS = ("111011", "110100011", "1001111", "101100101", "101010011", "1111001")
LEAST_MATCHES, LEAST_SHARE = 12, 0.7  # of the tokens that lie over each other
BITMAP_BITS = 1 << 24
BROADCAST_ROWS = 1_000_000  # windows of the benchmark that are broadcast, at most
SALTS = 16

_WORDS = WordHashes()
_TOKEN = re.compile(r"\w+")
_FACTORS = (mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)).tolist()  # one for each place of a mask


def tokens_of(text: str) -> np.ndarray:
    """Hashes of the words of a text: lower case, without punctuation."""
    return _WORDS.of(_TOKEN.findall(text.lower()))


def _tokens_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of many texts, one after another, and where each text's end."""
    words = [_TOKEN.findall(t.lower()) for t in texts]
    return _WORDS.of(list(chain.from_iterable(words))), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def seed_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of each window of the mask; none if there are fewer tokens than the mask is long."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Tokens are hashes already: a sum with odd factors tells their places apart.
    out = np.full(n, number + 1, np.uint64)
    for i, one in enumerate(mask):
        if one == "1":
            out += tokens[i : i + n] * np.uint64(_FACTORS[i])
    return mix(out)


def _runs(hashes: np.ndarray, at: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of consecutive places with one hash in a group: the group, the hash, first and last place of each."""
    group = np.zeros(len(at), np.int64) if group is None else group
    order = np.lexsort((at, hashes, group))
    g, h, p = group[order], hashes[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1] + 1)
    last = np.append(first[1:], np.ones(min(len(h), 1), bool))
    return g[first], h[first], p[first], p[last]


def _stretch_starts(where: np.ndarray, of: np.ndarray, flank: int) -> np.ndarray:
    """First hit of each stretch: hits of one document, none further than ``flank`` from the one before, 8 times that in all."""
    apart = np.ones(len(where), bool)
    apart[1:] = (of[1:] != of[:-1]) | (where[1:] - where[:-1] > flank)
    starts = []
    for a, b in zip(np.flatnonzero(apart).tolist(), np.append(np.flatnonzero(apart)[1:], len(where)).tolist()):
        while a < b:
            starts.append(a)
            a += int(np.searchsorted(where[a:b], where[a] + 8 * flank, side="right"))
    return np.array(starts, np.int64)


def benchmark_windows(benchmark: DataFrame, masks: tuple[str, ...] = MASKS, text: str = "text") -> DataFrame:
    """``hash, item_id, low, high``: every window of every item under every mask; an item shorter than a mask has none.

    Windows with one hash at consecutive places, as repeated tokens make them, are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                tokens = tokens_of(t)
                found = [seed_hashes(tokens, m, k) for k, m in enumerate(masks)]
                _, h, low, high = _runs(np.concatenate(found).view(np.int64), np.concatenate([np.arange(len(h)) for h in found]))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([item] * len(h), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                                 names=["hash", "item_id", "low", "high"])

    return benchmark.select("item_id", text_or_empty(text)).mapInArrow(run, "hash long, item_id long, low long, high long")


def item_tokens(benchmark: DataFrame, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tokens_of(t).view(np.int64) for t in texts_of(batch.column(1))], pa.list_(pa.int64()))],
                names=["item_id", "item"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty(text)).mapInArrow(run, "item_id long, item array<long>")


def document_hits(docs: DataFrame, seen: np.ndarray, flank: int, masks: tuple[str, ...] = MASKS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stretches of documents around hashes that the bitmap knows, with ``flank`` tokens either side.

    Hits whose surroundings overlap share a stretch of at most ``8 * flank`` tokens between
    its first and last hit; those with one hash at consecutive places are one.
    """
    packed, places = np.packbits(seen), np.uint64(len(seen) - 1)
    schema = f"doc_id {_kind(docs, doc_id)}, stretch long, start long, tokens array<long>, hits array<struct<hash:long,low:long,high:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed).astype(bool)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in pieces(texts):
                ids = batch.column(0).slice(a, b - a)
                tokens, ends = _tokens_of_all(texts[a:b])
                left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(tokens))  # tokens up to the document's end
                found = [seed_hashes(tokens, m, k) for k, m in enumerate(masks)]
                at = [np.flatnonzero(known[h & places] & (left[: len(h)] >= len(m))) for h, m in zip(found, masks)]
                where = np.concatenate(at)
                hashes = np.concatenate([h[i] for h, i in zip(found, at)]).view(np.int64)
                order = np.argsort(where, kind="stable")
                where, hashes = where[order], hashes[order]
                of = np.searchsorted(ends, where, side="right")
                starts = _stretch_starts(where, of, flank)
                stops = np.append(starts[1:], len(where)).astype(np.int64)
                doc = of[starts]
                begin = np.concatenate([[0], ends])[doc]  # where the document begins
                first = np.maximum(begin, where[starts] - flank)
                last = np.minimum(ends[doc], where[stops - 1] + flank) if len(starts) else first
                stretch = np.repeat(np.arange(len(starts)), stops - starts)
                of_run, h, low, high = _runs(hashes, where - begin[stretch], stretch)
                hits = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (h, low, high)], names=["hash", "low", "high"])
                cut = np.searchsorted(of_run, np.arange(len(starts) + 1)).astype(np.int32)
                sizes = last - first
                flat = tokens[ragged(first, sizes)].view(np.int64)
                ends_ = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), pa.array(np.arange(len(starts)), pa.int64()), pa.array(first - begin, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.array(flat, pa.int64())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), hits)],
                    names=["doc_id", "stretch", "start", "tokens", "hits"])

    found = docs.select(F.col(doc_id).cast(_kind(docs, doc_id)).alias("doc_id"), text_or_empty(text)).mapInArrow(run, schema)
    return found.withColumn("stretch", F.monotonically_increasing_id())


def _kind(docs: DataFrame, doc_id: str) -> str:
    """Type of the column that names a document: whole numbers are long, others stay."""
    kind = dict(docs.dtypes)[doc_id]
    return "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, least_matches: int = LEAST_MATCHES,
    least_share: float = LEAST_SHARE, bits: int = BITMAP_BITS, doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, item_id, doc_token, item_token, length, matches``: the best overlap of each pair.

    The item is laid over the document at each hit; an overlap is the run of ``length`` tokens
    there of which at least ``least_share`` and at least ``least_matches`` are equal. Shorter
    overlaps can't be told from chance. With the default masks, every such overlap has a hit
    if the two limits are no lower than theirs. ``doc_id`` names the documents, by numbers, strings or bytes. NULL text is
    empty, items with a NULL id are left out, documents with one are kept; repeated rows of a document or an item give their pair
    once, empty tables give no rows.

    Equal tokens in a row hit on many neighbouring diagonals: a run of hits on a run of windows is one row
    with a range of diagonals, and the ranges of a stretch and an item are searched together.
    """
    items = materialise(item_tokens(benchmark), "items")
    windows = materialise(benchmark_windows(benchmark, masks).distinct(), "windows")
    flank = max(items.agg(F.max(F.size("item"))).first()[0] or 0, 1)
    stretches = materialise(document_hits(docs, hash_bitmap(windows, bits), flank, masks, doc_id=doc_id), "stretches")
    hits = stretches.select("stretch", F.explode("hits").alias("h")).select("stretch", "h.hash", F.col("h.low").alias("doc_low"), F.col("h.high").alias("doc_high"))
    if windows.count() <= broadcast_rows:
        met = hits.join(F.broadcast(windows), "hash")
    else:  # a hash that many documents have is dealt over the salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = hits.withColumn("salt", F.pmod(F.xxhash64("stretch"), F.lit(SALTS)).cast("int")).join(windows.select("*", salts), ["hash", "salt"])
    # Where the item's first token lies in the document, as ranges.
    range_ = F.struct((F.col("doc_low") - F.col("high")).alias("low"), (F.col("doc_high") - F.col("low")).alias("high"))
    laid = materialise(met.filter("item_id is not null").groupBy("stretch", "item_id").agg(F.collect_set(range_).alias("ranges")), "laid")
    over = laid.join(stretches.select("stretch", "doc_id", "start", "tokens"), "stretch").join(items, "item_id")
    overlaps = f"doc_id {_kind(docs, doc_id)}, item_id long, doc_token long, item_token long, length long, matches long"
    enough = over.select("doc_id", "item_id", "ranges", "start", "tokens", "item").mapInArrow(
        lambda batches: _verify(batches, least_matches, least_share), overlaps)
    best = F.max(F.struct("matches", (-F.col("length")).alias("short"), (-F.col("doc_token")).alias("early"), "item_token")).alias("b")
    return enough.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.early")).alias("doc_token"), "b.item_token", (-F.col("b.short")).alias("length"), "b.matches")


def _verify(batches: Iterator[pa.RecordBatch], least_matches: int, least_share: float) -> Iterator[pa.RecordBatch]:
    """The best run of each item laid over its stretch along the given diagonals: most matches at that share."""
    names = ["doc_id", "item_id", "doc_token", "item_token", "length", "matches"]
    for batch in batches:
        rows = []
        for doc, item_id, ranges, start, tokens, item in zip(*(batch.column(i).to_pylist() for i in range(6))):
            found = best_overlap(ranges, start, np.array(tokens), np.array(item), least_matches, least_share)
            if found is not None:
                rows.append((doc, item_id, *found))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [batch.schema.field(0).type, *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def best_overlap(ranges: list[dict], start: int, tokens: np.ndarray, item: np.ndarray, least_matches: int, least_share: float):
    """Place in the document and the item, length and matches of the best run on any diagonal of the ranges, or None.

    Diagonals are looked at by their equal tokens, most first, until the rest can't reach the best.
    """
    low, high = start - len(item) + 1, start + len(tokens) - 1
    firsts = np.unique(np.concatenate([np.arange(max(r["low"], low), min(r["high"], high) + 1) for r in ranges]))
    laid = []
    for first in firsts.tolist():
        lead, skip = max(first - start, 0), max(start - first, 0)
        length = min(len(tokens) - lead, len(item) - skip)
        if length >= least_matches:
            equal = tokens[lead : lead + length] == item[skip : skip + length]
            if (n := int(np.count_nonzero(equal))) >= least_matches:
                laid.append((n, lead, skip, equal))
    best = None
    for n, lead, skip, equal in sorted(laid, key=lambda x: -x[0]):
        if best is not None and n < best[0]:
            break
        a, b = best_run(equal, least_share)
        matches = int(np.count_nonzero(equal[a:b]))
        if matches >= least_matches:
            best = max(best or (0,), (matches, a - b, -(start + lead + a), skip + a))
    return None if best is None else (-best[2], best[3], -best[1], best[0])


def best_run(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Of the runs with at least that share of matches, the one with most matches; then the shortest, then the first."""
    part = Fraction(share).limit_denominator(10**6)  # whole numbers, so that a share of exactly 0.7 is one
    total = np.concatenate([[0], np.cumsum(np.where(equal, part.denominator - part.numerator, -part.numerator))])
    stops = np.flatnonzero(equal) + 1  # a run ends with a match
    if not len(stops):
        return 0, 0
    # The earliest start from which the total doesn't fall up to the stop; then the first match from there on.
    starts = np.searchsorted(-np.minimum.accumulate(total), -total[stops], side="left")
    first = np.searchsorted(stops - 1, starts)
    starts, matches = stops[first] - 1, np.arange(1, len(stops) + 1) - first
    best = np.lexsort((starts, stops - starts, -matches))[0]
    return int(starts[best]), int(stops[best])
