"""Vector codes: codebooks of integer parts, fitted over Hilbert-sorted blocks.

A vector is scaled to integers and cut into equal parts; each part is coded by the nearest
entry of the codebook of its position. The vectors of a task are stored as chunks. For every
position a chunk holds its parts in the order of their Hilbert index, cut into flat blocks with
their lowest and highest components and their sums. A round compares the box of a block with
the codebook: an entry farther from the whole box than another entry can be is no candidate for
any part in it. The shortlist left is compared with the parts in exact integers; where it is a
single entry, the block's sums count without looking at its parts. Chunks keep their vectors
together, so a vector's code needs no shuffle; rounds exchange one sum per used entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from faultline.llm.common import materialise

PARTS, ENTRIES, SCALE = 16, 64, 256
BLOCK = 256  # parts of a block
CHUNK = 1 << 20  # components of a chunk, about
MOST = 1 << 26  # components stay below, so that squared distances and sums are exact in 64 bits
BROADCAST_ROWS = 100_000  # labels whose sums are broadcast, at most


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below ``2**bits``, by the transpose form.

    As many leading bits are used as fit 63 bits of index.
    """
    n, dims = points.shape
    bits = max(1, min(bits, 63 // dims)) if dims else 0
    x = points.T.astype(np.int64).copy()
    q = 1 << (bits - 1) if bits else 0
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ (q - 1), x[0])
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(n, np.int64), 1 << (bits - 1) if bits else 0
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    index = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | (((x[i] ^ turn) >> b) & 1)
    return index


def hilbert_order(parts: np.ndarray) -> np.ndarray:
    """Order of the rows along the Hilbert curve through their bounding box; ties keep their order."""
    if not parts.size:
        return np.arange(len(parts))
    # A curve through more than 31 dimensions would have one bit for each; its first 31 do.
    low = parts.min(axis=0)
    near = (parts - low)[:, :31]
    need = max(1, int(near.max()).bit_length())
    bits = max(1, min(need, 63 // near.shape[1]))
    return np.argsort(hilbert_index(near >> (need - bits), bits), kind="stable")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Blocks by entries: whether an entry can be the nearest of some point in the block's box.

    It can unless its least distance to the box exceeds another entry's greatest. Entries at
    equal distance stay, so ties are decided among all of them.
    """
    below, above = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    least = np.square(np.maximum(np.maximum(below, above), 0)).sum(axis=2)
    most = np.square(np.maximum(np.abs(below), np.abs(above))).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (lower index in ties) and the squared distance."""
    distance = np.square(parts[:, None, :] - entries[None]).sum(axis=2)
    code = distance.argmin(axis=1)
    return code, distance[np.arange(len(parts)), code]


class Chunk:
    """Vectors of one task: for every position the sorted parts and their blocks."""

    def __init__(self, order: np.ndarray, parts: np.ndarray):
        self.order, self.parts = order, parts.astype(np.int64)  # positions x rows; positions x rows x width
        starts = np.arange(0, parts.shape[1], BLOCK)
        self.starts, self.ends = starts, np.append(starts[1:], parts.shape[1])

    @classmethod
    def of_vectors(cls, x: np.ndarray, n_parts: int) -> Chunk:
        cut = x.reshape(len(x), n_parts, -1).transpose(1, 0, 2)
        order = np.stack([hilbert_order(p) for p in cut])
        return cls(order, np.stack([p[o] for p, o in zip(cut, order)]))

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowest and highest components and sums of all blocks: positions x blocks x width."""
        low, high = (f.reduceat(self.parts, self.starts, axis=1) for f in (np.minimum, np.maximum))
        return low, high, np.add.reduceat(self.parts, self.starts, axis=1)

    def sums(self, books: np.ndarray, boxes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Count and component sums of the parts nearest each entry."""
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for p, entries in enumerate(books):
            low, high, whole = (b[p] for b in boxes)
            for k, listed in enumerate(shortlists(low, high, entries)):
                picked = np.flatnonzero(listed)
                a, b = self.starts[k], self.ends[k]
                if len(picked) == 1:
                    count[p, picked[0]] += b - a
                    total[p, picked[0]] += whole[k]
                else:
                    code = picked[nearest(self.parts[p, a:b], entries[picked])[0]]
                    count[p] += np.bincount(code, minlength=len(entries))
                    np.add.at(total[p], code, self.parts[p, a:b])
        return count, total

    def codes(self, books: np.ndarray, boxes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x positions) and the error of each vector, in the order of the vectors."""
        rows = self.parts.shape[1]
        codes, error = np.zeros((rows, len(books)), np.uint8), np.zeros(rows, np.int64)
        for p, entries in enumerate(books):
            for k, listed in enumerate(shortlists(boxes[0][p], boxes[1][p], entries)):
                picked, here = np.flatnonzero(listed), slice(self.starts[k], self.ends[k])
                code, distance = nearest(self.parts[p, here], entries[picked])
                at = self.order[p, here]
                codes[at, p] = picked[code]
                error[at] += distance
        return codes, error


_CHUNK = "vec_ids binary, no_id binary, labels binary, no_label binary, rows int, orders binary, parts binary, wide boolean, low binary, high binary, sums binary"


def _flat(values: pa.Array) -> tuple[bytes, bytes]:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), values.is_null().to_numpy(zero_copy_only=False).tobytes()


def _chunks(kept: DataFrame, width: int, n_parts: int, scale: int) -> DataFrame:
    most_rows = max(1, CHUNK // width)

    def store(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        vectors = table["embedding"].chunk(0)
        x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if np.abs(x).max() >= MOST:
            raise ValueError(f"components beyond {MOST // scale} have no exact code")
        chunk = Chunk.of_vectors(x.astype(np.int64).reshape(len(vectors), width), n_parts)
        wide = bool(np.abs(x).max() >= 1 << 15)
        ids, no_id = _flat(table["vec_id"].chunk(0))
        labels, no_label = _flat(table["label"].chunk(0))
        low, high, sums = chunk.boxes()
        kind = "<i4" if wide else "<i2"
        row = [ids, no_id, labels, no_label, len(vectors), chunk.order.astype("<i4").tobytes(), chunk.parts.astype(kind).tobytes(), wide,
               low.astype(kind).tobytes(), high.astype(kind).tobytes(), sums.astype("<i8").tobytes()]
        kinds = [pa.binary()] * 4 + [pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[f.split()[0] for f in _CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, most_rows - rows)
                held.append(batch.slice(0, take))
                rows, batch = rows + take, batch.slice(take)
                if rows == most_rows:
                    yield store(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield store(pa.Table.from_batches(held))

    return kept.mapInArrow(run, _CHUNK)


def _stored(row: dict, n_parts: int, width: int) -> tuple[Chunk, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n, part = row["rows"], width // n_parts
    kind = "<i4" if row["wide"] else "<i2"
    chunk = Chunk(np.frombuffer(row["orders"], "<i4").reshape(n_parts, n), np.frombuffer(row["parts"], kind).reshape(n_parts, n, part))
    blocks = len(chunk.starts)
    low, high, sums = (np.frombuffer(row[c], k).astype(np.int64).reshape(n_parts, blocks, part) for c, k in (("low", kind), ("high", kind), ("sums", "<i8")))
    return chunk, (low, high, sums)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def first_entries(kept: DataFrame, entries: int) -> list[Row]:
    """The ``entries`` smallest ids, ascending, each with its smallest vector; fewer if there are fewer."""
    found: list[Row] = []
    left = kept.filter("vec_id is not null").select("vec_id", "embedding")
    while len(found) < entries:
        rest = left.filter(F.col("vec_id") > found[-1]["vec_id"]) if found else left
        got = rest.orderBy("vec_id", "embedding").limit(entries).collect()
        for row in got:
            if len(found) < entries and (not found or row["vec_id"] != found[-1]["vec_id"]):
                found.append(row)
        if len(got) < entries:
            break
    return found


def vector_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of each kept row, and the codebooks (parts x entries x width).

    Rows whose vector is NULL or empty or holds NULL or non-finite components are dropped. The length of the
    vector with the smallest id counts; vectors of another length, and all if no vector has an id or that length
    is no multiple of ``parts``, keep a row with NULL code and error. Repeated rows and ids all get rows; an id enters the
    first codebook once. Components of 2^26 or more after scaling raise an error. At most 256 entries; columns other than
    ``vec_id``, ``embedding`` and ``label`` are left out. An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")).filter(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    first = first_entries(kept, 1)
    width = len(first[0]["embedding"]) if first and len(first[0]["embedding"]) % parts == 0 else 0
    fits = F.size("embedding") == (width or -1)
    start = first_entries(kept.filter(fits), entries) if width else []
    if not start:  # no length to cut, or no id to start from
        return _uncoded(kept), np.zeros((parts, 0, 0), np.int64)
    seeds = np.floor(np.array([r["embedding"] for r in start], np.float64) * scale).astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    chunks = materialise(_chunks(kept.filter(fits), width, parts, scale), "chunks")
    for _ in range(rounds):
        books = _moved(chunks, books)
    return _coded(chunks, books).unionByName(_uncoded(kept.filter(~fits))), books


def _uncoded(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def _moved(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every used entry is the floor of the mean of its parts."""
    n_parts, n_entries, part = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for row in _rows_of(batches):
            chunk, boxes = _stored(row, n_parts, n_parts * part)
            n, s = chunk.sums(books, boxes)
            count, total = count + n, total + s
        p, e = np.nonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part * len(p) + 1, part), pa.int32()), pa.array(total[p, e].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), flat], names=["part", "entry", "n", "total"])

    sums = chunks.mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(part)])
    moved = books.copy()
    for row in sums.collect():  # one row for each used entry
        moved[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(part)]
    return moved


def _coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    n_parts, _, part = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            chunk, boxes = _stored(row, n_parts, n_parts * part)
            codes, error = chunk.codes(books, boxes)
            ids, labels = (pa.array(np.frombuffer(row[v], "<i8"), pa.int64(), mask=np.frombuffer(row[m], bool)) for v, m in (("vec_ids", "no_id"), ("labels", "no_label")))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(run, "vec_id long, label long, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over the rows with the same label, NULLs together."""
    coded = materialise(coded, "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    return coded.join(side.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
