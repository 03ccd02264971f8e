"""Token ids in files of a static range asymmetric numeral system.

One frequency table, counted over all documents, codes every chunk. A chunk is independent:
its symbols are dealt over interleaved lanes, each with a 64-bit state; the final states are
stored (the checkpoint a decoder starts from), with the words that the lanes have shed and a
checksum of the ids. Documents stand in ascending order; one longer than a chunk continues
in the next chunks. The index has the place of each chunk, so that any of them can be
decoded alone.

File: chunks one after another, little endian. Chunk: the fields of ``_HEAD``, then per
document id (int64), length in this chunk (uint32) and whether the id is NULL (uint8), then
states (uint64 per lane) and words (uint32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialise, new_path, pieces, text_or_empty, texts_of
from faultline.llm.encoding import encoder

BITS = 20  # precision of the frequencies
LOW, SHED = 1 << 31, 32  # states stay in [2^31, 2^63); a word has 32 bits
CHUNK, MOST_LANES = 1 << 18, 1024
_MAGIC = b"rANS"
_HEAD = "<4sIIIIII?"  # magic, table, ids, lanes, documents, words, checksum, continues
_SPOOL = "<II"  # documents, ids


class Table:
    """Frequencies that sum to 2^BITS; every id that occurs has one of at least 1."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        ends = np.cumsum(self.freq)
        self.start = ends - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), frequencies)
        self.crc = zlib.crc32(frequencies.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int = BITS) -> Table:
        total, size = int(counts.sum()), 1 << bits
        if not total:
            return cls(np.r_[size, np.zeros(max(len(counts) - 1, 0), np.int64)].astype(np.int64))
        freq = np.where(counts > 0, np.maximum(counts.astype(np.float64) * size / total, 1).astype(np.int64), 0)
        # What rounding leaves over or takes too much goes to the most frequent ids.
        rest = size - int(freq.sum())
        order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        if rest > 0:
            freq[order[0]] += rest
        while rest < 0:
            room = order[freq[order] > 1][: -rest]
            freq[room] -= 1
            rest += len(room)
        return cls(freq)


def encode_chunk(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """States and words of one chunk of ids."""
    n = len(ids)
    lanes = int(np.clip(n // 256, 1, MOST_LANES))
    x = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    most, bits, shed = freq << np.uint64(63 - BITS), np.uint64(BITS), np.uint64(SHED)
    words: list[np.ndarray] = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        stop = min(at + lanes, n)
        y, f = x[: stop - at], freq[at:stop]
        full = y >= most[at:stop]
        words.append(y[full].astype(np.uint32))
        y[full] >>= shed
        q = y // f
        y[:] = (q << bits) + (y - q * f) + start[at:stop]
    return x, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)


def decode_chunk(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    x, lanes = states.copy(), len(states)
    out, at_word = np.empty(n, np.uint32), 0
    mask, bits, shed, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(SHED), np.uint64(LOW)
    words = words.astype(np.uint64)
    for at in range(0, n, lanes):
        stop = min(at + lanes, n)
        y = x[: stop - at]
        slot = y & mask
        s = table.symbol[slot]
        out[at:stop] = s
        y[:] = table.freq[s] * (y >> bits) + slot - table.start[s]
        need = np.flatnonzero(y < low)
        y[need] = (y[need] << shed) | words[at_word : at_word + len(need)]
        at_word += len(need)
    if at_word != len(words) or (x != np.uint64(LOW)).any():
        raise ValueError("damaged chunk: the states don't return to their start")
    return out


def pack_chunk(ids: np.ndarray, doc_ids: list, lengths: list[int], continues: bool, table: Table) -> bytes:
    states, words = encode_chunk(ids, table)
    head = struct.pack(_HEAD, _MAGIC, table.crc, len(ids), len(states), len(doc_ids), len(words),
                      zlib.crc32(ids.astype("<u4").tobytes()), continues)
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
    ])


def unpack_chunk(data: bytes, table: Table) -> tuple[list, list[int], bool, np.ndarray]:
    """Document ids, their lengths here, whether the first continues, and the ids; checks the checksum."""
    magic, crc, n, lanes, n_docs, n_words, checksum, continues = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC or crc != table.crc:
        raise ValueError("not a chunk of this table")
    at = struct.calcsize(_HEAD)
    take = lambda kind, k: np.frombuffer(data, kind, k, at)
    doc_ids, at = take("<i8", n_docs).tolist(), at + 8 * n_docs
    lengths, at = take("<u4", n_docs).tolist(), at + 4 * n_docs
    null, at = take(np.uint8, n_docs), at + n_docs
    states, at = take("<u8", lanes), at + 8 * lanes
    ids = decode_chunk(n, states, take("<u4", n_words), table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("damaged chunk: checksum")
    return [None if z else d for d, z in zip(doc_ids, null)], lengths, continues, ids


def _folder(uri: str):
    fs, base = pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)
    return fs, base


_MANIFEST = "file_no long, name string, n_docs long, n_tokens long, id array<int>, n array<long>"
_INDEX = "file_no long, name string, unit long, offset long, length long, tokens_before long, n_tokens long"
_DOCUMENTS = "file_no long, tokens_before long, doc_id long, n_tokens long, ids_crc32 long, ids binary"


def write_token_files(
    docs: DataFrame, tokenizer: str, *, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text",
    folder: str | None = None, chunk: int = CHUNK,
) -> tuple[DataFrame, np.ndarray]:
    """Encode all texts and write them in ascending ``doc_id`` order; returns index and frequencies.

    Documents are dealt out by ranges of (id, hash of the text), so that a repeated id splits
    too. Each task tokenizes its range once, spools the ids to the shared folder and counts
    them; the counts of all tasks, at most ``vocabulary`` rows, make the one table; then each
    spool becomes a file. NULL ids come first; NULL text is empty and has the end id alone;
    repeated rows are all written. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, task = encoder(tokenizer), TaskContext.get()
        fs, base = _folder(folder)
        fs.create_dir(base, recursive=True)
        name = f"spool-{task.partitionId():06d}-{task.taskAttemptId()}"
        counts, n_docs, out = np.zeros(vocabulary, np.int64), 0, None
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for start, stop in pieces(texts, enc.BLOCK_CHARS):
                block, sizes = enc.encode(texts[start:stop])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for a, b in pieces(texts[start:stop]):  # what is read back at a time stays smaller
                    raw = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    if out is None:
                        out, packer = raw, zstandard.ZstdCompressor(level=1)
                    lengths = sizes[a:b]
                    ids = np.insert(block[ends[a] : ends[b]], np.cumsum(lengths), end_id).astype(np.uint32)
                    counts += np.bincount(ids, minlength=vocabulary)
                    n_docs += b - a
                    given = doc_ids[start + a : start + b]
                    body = b"".join([
                        struct.pack(_SPOOL, b - a, len(ids)), np.array([d or 0 for d in given], "<i8").tobytes(),
                        np.array([d is None for d in given], np.uint8).tobytes(), (lengths + 1).astype("<i8").tobytes(),
                        ids.astype("<u2" if vocabulary <= 1 << 16 else "<u4").tobytes(),
                    ])
                    body = packer.compress(body)
                    out.write(struct.pack("<I", len(body)) + body)
        if out is not None:
            out.close()
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pylist([{
                "file_no": task.partitionId(), "name": name, "n_docs": n_docs, "n_tokens": int(counts.sum()),
                "id": seen.tolist(), "n": counts[seen].tolist(),
            }], pa.schema([("file_no", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                           ("id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = materialise(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(spool, _MANIFEST), "spool")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, ids, n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    counted = manifest.select("id", "n").mapInArrow(combined, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in counted.collect():  # one row per id of the vocabulary at most
        counts[r["id"]] = r["n"]
    frequencies = Table.of_counts(counts).freq.astype(np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies.astype(np.int64))
        for batch in batches:
            for file_no, name in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                yield from _encode_spool(folder, file_no, name, table, vocabulary, chunk)

    index = manifest.select("file_no", "name").repartition(tasks, "file_no").mapInArrow(encode, _INDEX)
    return materialise(index.withColumn("folder", F.lit(folder)), "tokens-index"), frequencies


def _spooled(folder: str, name: str, vocabulary: int):
    """Document id, ids of each spooled document."""
    import zstandard

    fs, base = _folder(folder)
    unpack = zstandard.ZstdDecompressor()
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        while len(size := f.read(4)) == 4:
            body = unpack.decompress(f.read(struct.unpack("<I", size)[0]))
            n, total = struct.unpack_from(_SPOOL, body)
            at = struct.calcsize(_SPOOL)
            doc_ids, at = np.frombuffer(body, "<i8", n, at).tolist(), at + 8 * n
            null, at = np.frombuffer(body, np.uint8, n, at), at + n
            lengths, at = np.frombuffer(body, "<i8", n, at), at + 8 * n
            ids = np.frombuffer(body, "<u2" if vocabulary <= 1 << 16 else "<u4", total, at).astype(np.uint32)
            yield [None if z else d for d, z in zip(doc_ids, null)], lengths, ids


def _chunks(spooled, chunk: int):
    """Chunks of whole documents up to ``chunk`` ids; longer documents alone, in several."""
    held, doc_ids, lengths, size = [], [], [], 0
    for batch_ids, batch_lengths, ids in spooled:
        ends = np.cumsum(batch_lengths)
        for d, length, end in zip(batch_ids, batch_lengths.tolist(), ends.tolist()):
            if size and size + length > chunk:
                yield np.concatenate(held), doc_ids, lengths, False
                held, doc_ids, lengths, size = [], [], [], 0
            own = ids[end - length : end]
            if length > chunk:
                for a in range(0, length, chunk):
                    part = own[a : a + chunk]
                    yield part, [d], [len(part)], a > 0
                continue
            held.append(own)
            doc_ids.append(d)
            lengths.append(length)
            size += length
    if size:
        yield np.concatenate(held), doc_ids, lengths, False


def _encode_spool(folder: str, file_no: int, spool: str, table: Table, vocabulary: int, chunk: int):
    fs, base = _folder(folder)
    name = f"part-{file_no:06d}-{TaskContext.get().taskAttemptId()}.rans"
    at, before, unit, rows = 0, 0, -1, []
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        for ids, doc_ids, lengths, continues in _chunks(_spooled(folder, spool, vocabulary), chunk):
            data = pack_chunk(ids, doc_ids, lengths, continues, table)
            out.write(data)
            unit += not continues
            rows.append((file_no, name, unit, at, len(data), before, len(ids)))
            at, before = at + len(data), before + len(ids)
    names = [f.split()[0] for f in _INDEX.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.string() if n == "name" else pa.int64()) for n, c in zip(names, columns)], names=names)


def read_token_files(index: DataFrame, frequencies: np.ndarray, *, with_ids: bool = False) -> DataFrame:
    """Decode the chunks of ``index``: per document ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``.

    ``start`` counts the ids of all documents before it. Chunks are dealt out by file and
    unit (a chunk, or all chunks of one long document) and decoded in parallel.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(tasks, "file_no", "unit").sortWithinPartitions("file_no", "offset")
    dealt = dealt.select("folder", *[f.split()[0] for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, unit = Table(frequencies.astype(np.int64)), None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                fs, base = _folder(r["folder"])
                with fs.open_input_file(f"{base}/{r['name']}") as f:
                    f.seek(r["offset"])
                    data = f.read(r["length"])
                doc_ids, lengths, continues, ids = unpack_chunk(data, table)
                raw, at = ids.astype("<u4").tobytes(), 0
                for d, n in zip(doc_ids, lengths):
                    part = raw[4 * at : 4 * (at + n)]
                    if continues and held is not None and unit == (r["file_no"], r["unit"]):
                        held[3] += n
                        held[4] = zlib.crc32(part, held[4])
                        if with_ids:
                            held[5].append(part)
                    else:
                        if held is not None:
                            rows.append(held)
                        held = [r["file_no"], r["tokens_before"] + at, d, n, zlib.crc32(part), [part] if with_ids else None]
                    at, unit = at + n, (r["file_no"], r["unit"])
            yield _documents(rows)
        if held is not None:
            yield _documents([held])

    decoded = dealt.mapInArrow(run, _DOCUMENTS)
    # One row per file.
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file_no", (F.sum("total").over(Window.orderBy("file_no")) - F.col("total")).alias("before"))
    return decoded.join(F.broadcast(before), "file_no").select(
        "doc_id", (F.col("before") + F.col("tokens_before")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def _documents(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    ids = [None if p is None else b"".join(p) for p in columns[5]]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(list(c), pa.int64()) for c in columns[:5]), pa.array(ids, pa.binary())],
        names=[f.split()[0] for f in _DOCUMENTS.split(", ")])
