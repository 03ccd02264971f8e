"""Fill-in-the-middle texts by rotations of blocks in place.

A text becomes one ``bytearray``: token ends are scanned, sentinels go in at the two cuts, and
neighbouring blocks change places by three reversals, which need no second copy of the text.
The inverse finds the sentinels, rotates back and takes them out, so it gives the exact text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_or_empty, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SCRATCH = 1 << 16  # bytes exchanged at a time
SCANNED = 1 << 22  # bytes whose token ends are sought at a time

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_ends(raw: bytes | bytearray) -> np.ndarray:
    """Byte position after each token: white space with what follows it up to the next, or that at the end.

    Only space and the characters 9 to 13 are white space, single bytes in UTF-8.
    """
    data, found = np.frombuffer(raw, np.uint8), []
    for a in range(0, len(data), SCANNED):
        space = _SPACE[data[a : a + SCANNED + 1]]
        found.append(a + 1 + np.flatnonzero(~space[:-1] & space[1:]))
    ends = np.concatenate([*found, np.array([len(data)] if len(data) else [], np.int64)])
    return ends.astype(np.int64)


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Reverse ``view[start:stop]`` in place with a bounded scratch."""
    while stop - start > 1:
        n = min(SCRATCH, (stop - start) // 2)
        held = view[start : start + n].copy()
        view[start : start + n] = view[stop - n : stop][::-1]
        view[stop - n : stop] = held[::-1]
        start, stop = start + n, stop - n


def rotate(view: np.ndarray, start: int, cut: int, stop: int) -> None:
    """Exchange the blocks ``start:cut`` and ``cut:stop`` in place by three reversals."""
    reverse(view, start, cut)
    reverse(view, cut, stop)
    reverse(view, start, stop)


def arrange(raw: bytes, first: int, second: int, form: str) -> bytearray:
    """The bytes cut at ``first`` and ``second``, in the order of ``form`` (psm or spm) with sentinels."""
    buffer = bytearray(raw)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(np.frombuffer(buffer, np.uint8), middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restored(output: bytes, form: str) -> bytearray:
    """The text that ``arrange`` had; a plain output is the text."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    prefix, suffix, middle = (buffer.find(s) for s in (PREFIX, SUFFIX, MIDDLE))
    ordered = prefix == 0 and 0 < suffix < middle if form == "psm" else suffix == 0 and 0 < prefix < middle
    if form not in ("psm", "spm") or not ordered:
        raise ValueError(f"not an output of form {form}")
    view = np.frombuffer(buffer, np.uint8)
    if form == "psm":  # prefix, suffix, middle
        rotate(view, suffix, middle, len(buffer))
        cuts = (0, suffix, suffix + len(buffer) - middle)
    else:  # suffix, prefix, middle
        rotate(view, 0, prefix, len(buffer))
        cuts = (0, middle - prefix, len(buffer) - prefix)
    del view
    for at in reversed(cuts):
        del buffer[at : at + 3]
    return buffer


def chars(raw: bytes | bytearray, start: int, stop: int) -> int:
    """Code points of the UTF-8 bytes between two cuts."""
    return sum(int(np.count_nonzero(np.frombuffer(raw, np.uint8)[a : min(a + SCANNED, stop)] & 0xC0 != 0x80)) for a in range(start, stop, SCANNED))


def plan(raw: bytes, key: str, rate: int = 50, spm: int = 80) -> tuple[int, str, int, int]:
    """Number of tokens, form and both cuts (byte positions) of a text, drawn by the hash of ``key``."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    ends = token_ends(raw)
    n = len(ends)
    if not raw or h3 % 100 >= rate or PREFIX in raw or SUFFIX in raw or MIDDLE in raw:
        return n, "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: int(ends[k - 1]) if k else 0
    return n, "spm" if h4 % 100 < spm else "psm", place(low), place(high)


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``output``, ``prefix_chars`` and ``middle_chars``.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of those with the suffix first; the hash
    of seed and id decides, so repeated ids get the same draws. Empty texts (NULL is one) and
    texts with a sentinel stay plain, with NULL lengths. A NULL id counts as no digits. Columns
    of the names above are replaced; every row gives one row, an empty table none.
    """
    added = {"n": F.lit(0).cast("long"), "form": F.lit(""), "output": F.lit(""), "prefix_chars": F.lit(0).cast("long"), "middle_chars": F.lit(0).cast("long")}
    kept = [c for c in docs.columns if c not in added]
    made = docs.limit(0).select(*kept).withColumns(added).schema
    for field in made.fields[-2:]:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(len(kept)).to_pylist(), texts_of(batch.column(len(kept) + 1))):
                raw = t.encode()
                n, form, first, second = plan(raw, f"{seed}:{key}", rate, spm)
                if form == "plain":
                    rows.append((n, form, t, None, None))
                else:
                    rows.append((n, form, arrange(raw, first, second, form).decode(), chars(raw, 0, first), chars(raw, first, second)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=made.names)

    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(*kept, key.alias("_key"), text_or_empty(text).alias("_text")).mapInArrow(run, made)


def restore(outputs: DataFrame, *, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with ``restored``, the exact text of each row, from its output and form alone.

    A NULL output is empty; a NULL form is plain. A column named ``restored`` is replaced.
    """
    kept = [c for c in outputs.columns if c != "restored"]
    schema = outputs.select(*kept).withColumn("restored", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(t.encode(), f).decode() for t, f in zip(texts_of(batch.column(len(kept))), batch.column(len(kept) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "restored"])

    return outputs.select(*kept, text_or_empty(output).alias("_output"), F.coalesce(form, F.lit("plain")).alias("_form")).mapInArrow(run, schema)
