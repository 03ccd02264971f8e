"""Token counts by overlap resynchronisation.

Short texts are encoded with a memory of their parts. A huge text is encoded in chunks that
overlap; both encodings of an overlap come with character offsets, and the chunks are
spliced at a place where a token ends in both and which is *proven* stable: white space
that follows another character. No tokenizer of the ``.json`` kind lets a token or a
normalisation reach across it, whatever stands further left or right. Where an overlap
holds no such place, it is widened, up to the chunk itself, which then grows; so every
text gets the library's own ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_or_empty, texts_of
from faultline.llm.encoding import Encoder, encoder

WINDOW, OVERLAP = 1 << 15, 1 << 9
_ASCII_SPACE = frozenset(" \t\n\r\f\v")


def spliced_ids(enc: Encoder, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of one text from overlapping chunks of ``window`` characters."""
    if len(text) <= window or not enc.by_parts:
        return np.array(enc.whole([text])[0], np.uint32)
    out, cut, end = [], 0, window
    here, width = _chunk(enc, text, 0, end), overlap
    while end < len(text):
        start = max(end - width, cut)
        stop = min(start + window + width, len(text))
        following = _chunk(enc, text, start, stop)
        place = _common_boundary(text, here, following, max(start, cut) + 1, end)
        if place is not None:
            out.append(_between(here, cut, place))
            cut, here, end, width = place, following, stop, overlap
        elif start > cut:
            width *= 2
        else:  # no stable place in the whole chunk
            end, width = min(cut + 2 * (end - cut), len(text)), overlap
            here = _chunk(enc, text, cut, end)
    out.append(_between(here, cut, len(text) + 1))
    return np.concatenate(out)


def _chunk(enc: Encoder, text: str, start: int, stop: int):
    ids, first, last = enc.spans(text[start:stop])
    return ids, first + start, last + start


def _between(chunk, start: int, stop: int) -> np.ndarray:
    ids, first, _ = chunk
    return ids[np.searchsorted(first, start) : np.searchsorted(first, stop)]


def _common_boundary(text: str, left, right, start: int, stop: int) -> int | None:
    """A stable place in ``start .. stop - 1`` where both encodings have a boundary.

    The middle-most place is tried first; the ids of both must agree from there to the
    next stable place.
    """
    places = [p for p in range(start, stop) if text[p] in _ASCII_SPACE and not text[p - 1].isspace()]
    order = sorted(range(len(places)), key=lambda i: abs(2 * i - len(places)))
    for i in order:
        p, after = places[i], places[i + 1] if i + 1 < len(places) else None
        if _straddles(left, p) or _straddles(right, p):
            continue
        if after is None or np.array_equal(_between(left, p, after), _between(right, p, after)):
            return p
    return None


def _straddles(chunk, place: int) -> bool:
    _, first, last = chunk
    k = int(np.searchsorted(first, place))
    return k > 0 and int(last[k - 1]) > place


def token_counts(
    docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 512,
    window: int = WINDOW, overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``tokenizer`` is a file's path on the executors. NULL text counts as empty (0 bytes,
    0 tokens); every row gives one row, repeated rows included; an empty table gives an
    empty result. Columns of these three names in ``docs`` are replaced.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(*kept).withColumns({
        "n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True),
    }).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = texts_of(batch.column(len(kept)))
            huge = [i for i, t in enumerate(texts) if len(t) > window]
            counts = enc.count(["" if len(t) > window else t for t in texts])
            for i in huge:
                counts[i] = len(spliced_ids(enc, texts[i], window, overlap))
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], n_bytes, pa.array(counts), pa.array(counts > limit)],
                names=[*kept, *new],
            )

    # The text travels last and under no name, so that no column of ``docs`` can clash with it.
    return docs.select(*kept, text_or_empty(text)).mapInArrow(run, schema)
