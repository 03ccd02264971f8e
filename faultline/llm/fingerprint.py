"""Homomorphic multiset hashes of documents, by DataFrame functions alone.

A text is cut into units: paragraphs, cut further after a word that ends a sentence and
after eight words. Each unit is hashed to a vector of 128 entries, +1 or -1 by the bits of
its MD5; the fingerprint is the sum of these vectors, entry by entry modulo 2^16. The order
of the units plays no part; inserting or deleting a unit adds or subtracts its vector.
Equal multisets have equal fingerprints. Entries that differ measure the units that
differ: the scalar product of two fingerprints estimates how many units are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialise, text_or_empty

LANES, MODULUS = 128, 1 << 16
UNIT = r"(?:[^ \t\r\n]*[^ \t\r\n.!?][ \t]+){0,7}[^ \t\r\n]+"
_PAIR = (1 << 32) + 1  # two counters of 32 bits in one long: no text has units enough to overflow one
_KEY = ["_id", "_hash"]
_NULL = -(1 << 63)


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _vector_sums(unit: str) -> list[Column]:
    """Counters of set bits: entry ``i`` of the first 32 has bits i of words 0 and 1, the others of 2 and 3."""
    word = lambda j: F.conv(F.substring(F.md5(unit), 8 * j + 1, 8), 16, 10).cast("long")
    out = []
    for a, b in ((0, 1), (2, 3)):
        both = F.shiftleft(word(b), 32).bitwiseOR(word(a))
        out += [F.sum(F.shiftrightunsigned(both, i).bitwiseAND(F.lit(_PAIR))).alias(f"s{a}_{i}") for i in range(32)]
    return out


def lanes_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``lanes``: the vector of each key's text, entries 0 .. 65535."""
    each = df.select(*keys, F.explode_outer(units(F.col(text))).alias("_unit"))
    sums = each.groupBy(*keys).agg(F.count("_unit").alias("_n"), *_vector_sums("_unit"))
    counts = [
        part
        for a in (0, 2)
        for half in (0, 32)
        for part in (F.shiftrightunsigned(F.coalesce(F.col(f"s{a}_{i}"), F.lit(0)), half).bitwiseAND(F.lit((1 << 32) - 1)) for i in range(32))
    ]
    signed = F.transform(F.array(*counts), lambda ones: F.pmod(ones * 2 - F.col("_n"), F.lit(MODULUS)).cast("int"))
    return sums.select(*keys, signed.alias("lanes"))


def fingerprint(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the two multisets together; with ``sign=-1``, of the first without the second."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * sign, F.lit(MODULUS)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common units, 0 to 1; 1 for equal fingerprints."""
    centred = lambda x: (F.pmod(x + MODULUS // 2, F.lit(MODULUS)) - MODULUS // 2).cast("long")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: centred(x) * centred(y)), F.lit(0).cast("long"), lambda s, x: s + x)
    both = dot(a, a) + dot(b, b)
    share = F.when(both > 0, F.lit(2.0) * dot(a, b) / both).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def _with_predecessor(rows: DataFrame) -> DataFrame:
    """Each key with its number of rows, the key before it and a quarter of that text's length.

    The key before the first is the last. Keys are dealt out by ranges and written with their
    range; inside one, a window finds the key before; across ranges, the ends of each do,
    one row per range.
    """
    ids = materialise(
        rows.groupBy(*_KEY).agg(F.max(F.char_length("text")).alias("n_chars"), F.count("*").alias("copies"))
        .repartitionByRange(*_KEY).withColumn("_range", F.spark_partition_id()), "order")
    here = F.struct(*_KEY, "n_chars")
    ends = ids.groupBy("_range").agg(F.max(here).alias("last"))
    by_range = Window.orderBy("_range")
    ends = ends.select("_range", F.coalesce(
        F.lag("last").over(by_range), F.max("last").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = F.lag(here).over(Window.partitionBy("_range").orderBy(*_KEY))
    found = ids.withColumn("p", inside).join(F.broadcast(ends), "_range").withColumn("p", F.coalesce("p", "before"))
    return materialise(found.select(*_KEY, "copies", F.col("p._id").alias("p_id"), F.col("p._hash").alias("p_hash"),
                                    F.floor(F.col("p.n_chars") / 4).cast("int").alias("p_quarter")), "order")


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last quarter of code points replaced by the first as many (or
    all) of the next document by ascending id (after the last: the first). Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. NULL text is empty; a NULL id comes first (the id -2^63 counts as NULL); of
    rows that share an id, those with other texts follow each other in the order of a hash,
    and repeated rows are one document with a result each. One document alone is its own
    next. No rows in, no rows out.
    """
    body = text_or_empty(text)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("_id"), F.xxhash64(body).alias("_hash"), body.alias("text"))
    order = _with_predecessor(rows)
    # Every use below needs these three columns, so that the texts are shuffled once.
    each = rows.dropDuplicates(_KEY)
    own = lanes_of(each, _KEY, "text")
    sent = each.join(order, _KEY).join(own, _KEY).select(
        F.col("p_id").alias("_id"), F.col("p_hash").alias("_hash"),
        F.expr("substring(text, 1, p_quarter)").alias("head"), F.col("lanes").alias("next_lanes"))
    edited = each.join(sent, _KEY).withColumn("n_chars", F.char_length("text")).select(
        *_KEY, "n_chars", "next_lanes",
        F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 4) as int))"), "head").alias("edited"))
    edited_lanes = lanes_of(edited, _KEY, "edited").withColumnRenamed("lanes", "edited_lanes")
    found = edited.join(own, _KEY).join(edited_lanes, _KEY).join(order.select(*_KEY, "copies"), _KEY).select(
        F.nullif("_id", F.lit(_NULL)).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("lanes")).alias("fingerprint"), fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"), "copies")
    # Whole columns are computed once per document and then repeated.
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("copies", "_copy")
