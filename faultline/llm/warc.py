"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing gives one row per record: file, offset, length, URL and digest. A reader selects
records in that index first; the selected ranges are dealt out by file and stretch, sorted,
joined where they touch, and each joined range is one read.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import materialise, new_path

IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STRETCH, GAP = 8 << 20, 64 << 10
_URN = "urn:record:"

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four base-32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to``.

    Of records with equal payloads of at least ``least_bytes`` the one with the largest
    ``page_id`` is the response. Repeated rows with that id are responses too, as is every
    record of a group without any id. The largest ids are few columns wide and come from a
    combined aggregation; the join on the digest has plain exchanges on both sides, so a
    payload that a third of all records share is split by adaptive execution.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", base32_sha1(payload).alias("payload_digest"),
                         F.octet_length(payload).cast("long").alias("payload_bytes"))
    largest = materialise(
        keyed.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "warc-groups",
    )
    other = (F.col("largest") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("largest").isNotNull())
    revisit = F.coalesce(other, F.lit(False))
    return keyed.join(largest, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(row: dict, date: str) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless it is a revisit."""
    page_id = row["page_id"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if row["record_type"] == "revisit" else http + (row["html"] or "").encode("utf-8", "surrogatepass")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {date}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_header_value(row['url'])}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{_URN}{row['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str | None = None, *, date: str = "1970-01-01T00:00:00Z",
               level: int = 1) -> DataFrame:
    """Write ``records`` (from ``with_revisits``) as ``.warc.gz`` files and return their index.

    Each record is a gzip member of its own. A file belongs to one task attempt; the index
    is written as a table before it is returned, so files of lost attempts are in no row of
    it and are never read. ``folder`` is a URI that all executors can write to.
    """
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(_record(row, date), level, mtime=0)
                out.write(data)
                rows.append((name, at, len(data), row["page_id"], row["url"], row["payload_digest"]))
                at += len(data)
            yield _batch(rows, INDEX)
        if out:
            out.close()

    return materialise(records.mapInArrow(run, INDEX).withColumn("folder", F.lit(folder)), "warc-index")


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = STRETCH) -> list[tuple[int, int, list[int]]]:
    """Join sorted ``(offset, length)`` ranges: ``(start, stop, numbers of the ranges inside)``."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= max(most, length):
            start, stop, members = out[-1]
            members.append(i)
            out[-1] = (start, max(stop, offset + length), members)
        else:
            out.append((offset, offset + length, [i]))
    return out


def parse_record(data: bytes) -> tuple:
    """A row of ``RECORDS``; the digest of a stored payload is checked against its bytes."""
    import base64
    import hashlib

    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest, n_bytes = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, n_bytes):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}: {found} is not {digest}")
    number = lambda value: int(value[len(_URN) + 1 : -1]) if value and value[len(_URN) + 1 : -1] else None
    return (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            number(fields.get("WARC-Refers-To")), n_bytes, digest, payload)


def read_warc(selected: DataFrame, *, payloads: bool = True, stretch: int = STRETCH, gap: int = GAP) -> DataFrame:
    """Records of the index rows ``selected``; ``payload`` is NULL for revisits.

    Rows of one stretch of one file meet in a task, in order of their offsets; one read
    covers neighbours up to ``gap`` bytes apart. A large file is read by many tasks.
    """
    spark = selected.sparkSession
    rows = selected.select("folder", "file", "offset", "length", F.floor(F.col("offset") / stretch).alias("stretch"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "folder", "file", "stretch").sortWithinPartitions("folder", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            n = len(table["file"])
            start = 0
            while start < n:
                stop = start
                where = (table["folder"][start], table["file"][start])
                while stop < n and (table["folder"][stop], table["file"][stop]) == where:
                    stop += 1
                yield from _read_file(*where, table["offset"][start:stop], table["length"][start:stop])
                start = stop

    def _read_file(folder, file, offsets, lengths):
        fs, base = pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)
        with fs.open_input_file(f"{base}/{file}") as f:
            for first, last, members in coalesced(list(zip(offsets, lengths)), gap, stretch):
                f.seek(first)
                data = f.read(last - first)
                found = []
                for i in members:
                    at = offsets[i] - first
                    row = parse_record(data[at : at + lengths[i]])
                    found.append(row if payloads else (*row[:-1], None))
                yield _batch(found, RECORDS)

    return dealt.mapInArrow(run, RECORDS)
