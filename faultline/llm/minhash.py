"""Near-duplicates by ProbMinHash signatures, banding and exact verification.

The weight of a shingle (five words) is how often the document has it. The similarity of two
documents is the probability Jaccard index of these weights: the sum over common shingles
d of 1 / sum over all e of max(v_e / v_d, w_e / w_d); for equal weights it is the Jaccard
index of the sets. A signature has the shingles that arrive first in each component, when
every shingle sends points at exponential gaps with its weight as rate; two signatures
agree in a component with that probability. A shingle stops as soon as its next point is
later than every component's first arrival.

Exact copies collapse by a digest of the text before any of this. Documents that share a
band are compared with the smallest id of the bucket, which links a large group of copies
by as many pairs as it has members. Buckets whose members don't all end up in one class by
that are compared in full, in blocks of bounded size, between classes only; so no link that
a shared band shows is lost, and no group is expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import WordHashes, materialise, mix, pieces, text_or_empty, texts_of, word_shingles

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
BLOCK = 512  # members of a mixed bucket in one block; two blocks meet in a task
BLOCK_CHARS = 1 << 13  # a longer text counts as several members
BROADCAST_TEXTS = 1_000_000  # keys of texts that are broadcast, at most
MEMBERS = 64  # texts compared with one centre in one stretch

_WORDS = WordHashes()


def weighted_shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    return np.unique(word_shingles(_WORDS.of(text.split()), size), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if a[1].max() == 1 == b[1].max():
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    v, w = a[1].astype(np.float64), b[1].astype(np.float64)
    # max(v_e/v_d, w_e/w_d) is v_e/v_d where v_e/w_e >= v_d/w_d: order the shingles of both by that ratio.
    union = np.union1d(a[0], b[0])
    ve, we = np.zeros(len(union)), np.zeros(len(union))
    ve[np.searchsorted(union, a[0])], we[np.searchsorted(union, b[0])] = v, w
    with np.errstate(divide="ignore"):
        ratio = np.where(we > 0, ve / we, np.inf)
    order = np.argsort(ratio, kind="stable")
    after_v = np.concatenate([np.cumsum(ve[order][::-1])[::-1], [0.0]])
    before_w = np.concatenate([[0.0], np.cumsum(we[order])])
    at = np.searchsorted(ratio[order], v[i] / w[j], side="left")
    return float((1 / (after_v[at] / v[i] + before_w[at] / w[j])).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], components: int) -> np.ndarray:
    """ProbMinHash signatures, a row of shingle hashes for each set; an empty set has zeros.

    All shingles of all sets draw their points together, round by round.
    """
    sizes = np.fromiter((len(s[0]) for s in sets), np.int64, len(sets))
    first = np.full(len(sets) * components, np.inf)
    winner = np.zeros(len(sets) * components, np.uint64)
    if not sizes.sum():
        return winner.reshape(len(sets), components)
    item = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(np.float64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    time, turn = np.zeros(len(item)), 0
    while len(item):
        draw = mix(item + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & (2**64 - 1)))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + gap / weight
        slot = doc * components + (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(components)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        winner[slot[won]] = item[won]
        # A shingle whose points are later than all first arrivals of its set has no more to win.
        last = first.reshape(len(sets), components).max(axis=1)
        go = time < last[doc]
        item, weight, doc, time, turn = item[go], weight[go], doc[go], time[go], turn + 1
    return winner.reshape(len(sets), components)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of the key."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(3) + parts[:, :, r])
    return key


def _signed(texts: list[str], bands: int, rows: int):
    """Signature, band keys and whether there is any shingle, for each text."""
    for a, b in pieces(texts):
        sets = [weighted_shingles(t) for t in texts[a:b]]
        s = signatures(sets, bands * rows)
        yield a, b, s, band_keys(s, bands, rows), np.array([len(x[0]) > 0 for x in sets])


def candidate_bands(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest, buckets`` for columns ``doc_id, text``: MD5 of the text and its band keys, none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b, _, keys, has in _signed(texts, bands, rows):
                digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts[a:b]]
                buckets = [k if h else [] for k, h in zip(keys.view(np.int64), has)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "buckets"])

    return docs.mapInArrow(run, "doc_id long, digest binary, buckets array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(doc, centre)`` whose texts are similar enough.

    Pairs of a centre are cut into stretches of bounded size; each stretch gets the centre's
    text once and streams the members' texts past it.
    """
    spark = docs.sparkSession
    n = materialise(pairs.groupBy("centre").agg(F.count("*").alias("n")), "pairs")
    cut = materialise(pairs.join(n, "centre").withColumn(
        "stretch", F.pmod(F.xxhash64("doc"), F.greatest(F.ceil(F.col("n") / MEMBERS), F.lit(1)))).drop("n"), "pairs")
    texts = docs.select("doc", "text")
    member = cut.join(texts, "doc").select("centre", "stretch", "doc", "text")
    centre = cut.select("centre", "stretch").distinct().join(texts.withColumnRenamed("doc", "centre"), "centre").select(
        "centre", "stretch", F.lit(None).cast("long").alias("doc"), "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = centre.unionByName(member).repartition(tasks, "centre", "stretch").sortWithinPartitions("centre", "stretch", F.col("doc").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for c, s, d, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if d is None:
                    at, held = (c, s), weighted_shingles(t)
                elif at == (c, s) and probability_jaccard(held, weighted_shingles(t)) >= similarity:
                    out.append((d, c))
            docs_, centres = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(docs_), pa.int64()), pa.array(list(centres), pa.int64())], names=["doc", "centre"])

    return dealt.mapInArrow(run, "doc long, centre long")


def components(edges: DataFrame) -> DataFrame:
    """``doc, label``: the smallest id of each node's connected component, for nodes with an edge.

    Each round takes the smallest label among the neighbours and then the label of that
    label, until nothing changes; the tables of a round are written to the shared folder.
    """
    both = materialise(edges.select(F.col("doc").alias("a"), F.col("centre").alias("b")).union(
        edges.select(F.col("centre").alias("a"), F.col("doc").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "doc"), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", "label", F.least("label", "near").alias("next"))
        hooked = materialise(hooked, "labels")
        jump = hooked.select(F.col("doc").alias("next"), F.col("next").alias("further"))
        after = materialise(hooked.join(jump, "next", "left").select(
            "doc", F.col("label").alias("old"), F.least("next", F.coalesce("further", "next")).alias("label")), "labels")
        changed = after.filter("old <> label").limit(1).count()
        labels = after.drop("old")
        if not changed:
            return labels


def _mixed_links(buckets: DataFrame, labels: DataFrame, docs: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """Links ``(doc, centre)`` between different classes that share a bucket.

    Only buckets with several classes are looked at. Their members are cut into blocks of
    bounded length; two blocks that may hold different classes meet in one task with their
    texts. It compares 16 bits of each component first: signatures of pairs at the threshold
    agree in that share of components give or take five deviations. What is left is verified
    there, in the first bucket that the two share, so that only links leave the task.
    """
    spark = docs.sparkSession
    size = docs.select("doc", F.greatest(F.lit(BLOCK_CHARS), F.length("text")).cast("long").alias("size"))
    of = buckets.join(labels, "doc", "left").join(size, "doc").select("doc", "bucket", F.coalesce("label", "doc").alias("label"), "size")
    of = materialise(of, "members")
    per = of.groupBy("bucket", "label").agg(F.sum("size").alias("n")).withColumn("large", F.when(F.col("n") >= BLOCK * BLOCK_CHARS, F.col("label")))
    # A class of a block or more has blocks of its own, which don't meet each other; the rest share blocks.
    groups = per.groupBy("bucket", "large").agg(F.ceil(F.sum("n") / (BLOCK * BLOCK_CHARS)).cast("int").alias("blocks"), F.count("*").alias("classes"))
    whole = Window.partitionBy("bucket")
    groups = groups.withColumns({
        "after": F.sum("blocks").over(whole.orderBy("large")), "all_blocks": F.sum("blocks").over(whole), "classes": F.sum("classes").over(whole),
    }).filter("classes > 1").select("bucket", "large", "blocks", (F.col("after") - F.col("blocks")).cast("int").alias("first"), F.col("all_blocks").cast("int"))
    same = groups.withColumnsRenamed({"bucket": "g_bucket", "large": "g_large"})
    per = materialise(per.join(same, (F.col("bucket") == F.col("g_bucket")) & F.col("large").eqNullSafe(F.col("g_large")))
                      .select("bucket", "label", "large", "blocks", "first", "all_blocks"), "mixed")
    member = materialise(of.join(per, ["bucket", "label"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")), "mixed")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for a, b, s, keys, _ in _signed(texts, bands, rows):
                low = (s & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in low], pa.binary()),
                     pa.array([k.tobytes() for k in keys.view("<i8")], pa.binary())], names=["doc", "text", "sketch", "bands"])

    needed = docs.join(member.select("doc").distinct(), "doc", "left_semi")
    sketches = materialise(needed.select("doc", "text").mapInArrow(sketch, "doc long, text string, sketch binary, bands binary"), "sketches")
    # A member goes to as many meetings as its bucket has blocks, less those of its own large class.
    others = F.filter(F.sequence(F.lit(0), F.col("all_blocks") - 1),
                      lambda j: F.col("large").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("blocks")))
    met = member.select("doc", "bucket", "label", "block", F.explode(others).alias("j")).select(
        "doc", "bucket", "label", "block", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"))
    met = met.join(sketches, "doc").select("bucket", "i", "j", "block", "doc", "label", "sketch", "bands", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    m = bands * rows
    least = m * similarity - 5 * (m * similarity * (1 - similarity)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for *row, text in zip(*columns, texts_of(batch.column(8))):
                if tuple(row[:3]) != key:
                    yield _met(key, held, m, least, similarity)
                    key, held = tuple(row[:3]), []
                held.append((*row[3:], text))
        yield _met(key, held, m, least, similarity)

    return dealt.mapInArrow(run, "doc long, centre long").distinct()


class _Shingles(dict):
    """Weighted shingles by place, made when they are asked for."""

    def __init__(self, texts):
        super().__init__()
        self.texts = list(texts)

    def __missing__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        found = self[i] = weighted_shingles(self.texts[i])
        return found


def _met(key, held, m: int, least: float, similarity: float) -> pa.RecordBatch:
    """Links between the classes of two blocks (or within one) of the bucket ``key[0]``."""
    found = []
    if key is not None and len(held) > 1:
        block, doc, label = (np.array(c) for c in zip(*(r[:3] for r in held)))
        s = np.frombuffer(b"".join(r[3] for r in held), "<u2").reshape(len(held), m)
        keys = np.frombuffer(b"".join(r[4] for r in held), "<i8").reshape(len(held), -1)
        # Shingles of survivors only, each text's once.
        sets = _Shingles(r[5] for r in held)
        a, b = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        for i in a.tolist():
            j = b[(label[b] != label[i]) & (doc[b] != doc[i])]
            if key[1] == key[2]:
                j = j[doc[j] < doc[i]]
            j = j[(s[j] == s[i]).sum(axis=1) >= least]
            j = j[keys[i][np.argmax(keys[j] == keys[i], axis=1)] == key[0]]
            found += [(max(doc[i], doc[k]), min(doc[i], doc[k])) for k in j.tolist() if probability_jaccard(sets[i], sets[k]) >= similarity]
    left, right = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["doc", "centre"])


_ODD = 1 << 62  # keys of texts without an id of their own begin here


def text_digest(text: str = "text"):
    """MD5 of a text column in UTF-8, as bytes; NULL is the empty text."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def _text_keys(signed: DataFrame) -> DataFrame:
    """``digest, id, doc``: the smallest id of each distinct text, and a key that no other text has.

    The key is the id, for the text with the smallest digest if several texts share it; the others and
    texts without an id get numbers of their own.
    """
    least = materialise(signed.groupBy("digest").agg(F.min("doc_id").alias("id")), "copies")
    known = least.filter("id is not null")
    first = known.groupBy("id").agg(F.min("digest").alias("_first"))
    own = known.join(first, "id").withColumn("_own", F.col("digest") == F.col("_first")).drop("_first")
    both = own.unionByName(least.filter("id is null").withColumn("_own", F.lit(False)))
    number = F.lit(_ODD) + F.monotonically_increasing_id()
    return materialise(both.select("digest", "id", F.when(F.col("_own"), F.col("id")).otherwise(number).alias("doc")), "keys")


def text_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS,
                 similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Classes of the distinct texts, and the digest of each row.

    The first is ``digest, id, stands, class_id, n_links``: a text's smallest id, whether it stands for its
    class (one text of each does), the class's smallest id (NULL if no text of it has one), and
    its number of verified links. The second is ``doc_id, digest`` for every row.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    signed = materialise(candidate_bands(given, bands, rows), "bands")
    keys = _text_keys(signed)
    # The row with the smallest id stands for all copies of a text.
    own = signed.withColumnRenamed("doc_id", "id").join(keys.withColumnRenamed("id", "_id"), "digest").filter(F.col("id").eqNullSafe(F.col("_id")))
    flat = materialise(own.select("doc", F.explode("buckets").alias("bucket")), "buckets")
    lowest = flat.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("high")).filter("centre <> high")
    shared = materialise(flat.join(materialise(lowest.drop("high"), "centres"), "bucket"), "shared")
    pairs = materialise(shared.filter("doc <> centre").select("doc", "centre").distinct(), "pairs")
    # The texts that share a bucket; all others are done.
    wanted = materialise(keys.join(shared.select("doc").distinct(), "doc", "left_semi").withColumnRenamed("id", "_id"), "wanted")
    # Texts stay where they are as long as the list of those wanted is short.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    found = given.withColumn("digest", text_digest()).join(side, "digest").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = materialise(found.select("doc", "text").dropDuplicates(["doc"]), "texts")
    edges = materialise(_verified(pairs, texts, similarity), "links")
    labels = components(edges)
    more = materialise(_mixed_links(shared.select("doc", "bucket"), labels, texts, bands, rows, similarity), "links")
    if more.limit(1).count():
        edges = edges.union(more)
        labels = components(edges)
    links = edges.select(F.explode(F.array("doc", "centre")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n_links"))
    joined = keys.join(labels, "doc", "left").join(links, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    joined = materialise(joined, "classes")
    # The smallest key of a class is its smallest id, but where texts share ids or have none: those classes are few.
    odd = joined.groupBy("label").agg(F.min("id").alias("least")).filter(~F.col("label").eqNullSafe(F.col("least")))
    named = joined.join(materialise(odd.withColumn("odd", F.lit(True)), "odd"), "label", "left")
    classes = named.select(
        "digest", "id", (F.col("doc") == F.col("label")).alias("stands"), F.when(F.col("odd"), F.col("least")).otherwise(F.col("label")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return classes, signed.select("doc_id", "digest")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, n_links``: the class of each document is its smallest id.

    A class is what exact copies and pairs of at least ``similarity`` connect. ``n_links``
    counts the verified pairs of the document's text with other texts. Texts of fewer than
    five words are one shingle; texts without words (NULL, empty) are copies of each other
    if equal. Texts are compared, not ids: a row with a NULL id gets the smallest id of its class, NULL
    if that has none; rows that share an id have the class of their own text each; repeated rows are
    all returned.
    """
    classes, rows_ = text_classes(docs, doc_id=doc_id, text=text, bands=bands, rows=rows, similarity=similarity)
    return rows_.join(classes, "digest").select("doc_id", "class_id", "n_links")
