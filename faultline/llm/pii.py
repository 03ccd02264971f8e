"""Personal data by base patterns and by contexts learnt from them.

Base spans are found by fixed patterns. They seed a bootstrap: the words before and after a
seed make lexical patterns; every token that looks like an identifier is an instance of the
patterns around it. Scores go to and fro over the graph of patterns and instances, to the
fixed point: a pattern is as good as its instances are on average, an instance as good as
the confident patterns around it together, those with the pattern's own last word left out.
Patterns that many different instances support with a high score mark unseen identifiers
in their contexts; these support further patterns. A pattern that seldom stands before an
identifier, as function words do, is none: all its occurrences in the corpus are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import WordHashes, hash_bitmap, materialise, mix, text_or_empty, texts_of

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"  # the kind of spans that the method adds; it sorts after the base kinds
LEAST_SCORE, LEAST_INSTANCES = 0.8, 20
OWN_VOTE = 0.75  # what a pattern's own score counts for its instances; at 0.8, half of them have to be known otherwise
LEAST_BELIEF = 0.95  # an instance that others believe in so much counts as a seed
LEAST_SHARE = 0.2  # of all occurrences of a pattern's words, those before a seed or a candidate
TOLERANCE = 1e-6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits where it didn't begin at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
# An identifier is a word of six characters or more with digits, or one with an at sign.
_CANDIDATE = re.compile(r"[^\s]*[0-9@][^\s]*")
_TRIM = "\"'()[]{}<>,;:!?.*#$%&|=/"


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start and then by kind as listed."""
    found = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _candidates(text: str, spans):
    """``(start, end, kind or None)`` of base spans and of other tokens that look like identifiers."""
    out, covered = list(spans), [(s, e) for s, e, _ in spans]
    k = 0
    covered.sort()
    for m in _CANDIDATE.finditer(text):
        word = m[0].strip(_TRIM)
        if len(word) < 6 or sum(map(str.isdigit, word)) * 3 < len(word) and "@" not in word:
            continue
        start = m.start() + m[0].index(word)
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        if k == len(covered) or covered[k][0] >= start + len(word):
            out.append((start, start + len(word), None))
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: one word, and two words, before it."""
    before = [w for w in (x.strip(_TRIM).lower() for x in text[max(0, start - 80) : start].split()[-2:]) if w]
    out = [f"<{before[-1]}"] if before else []
    return [*out, f"<{' '.join(before)}"] if len(before) == 2 else out


_MARK = "struct<start:int,end:int,kind:string,instance:long,patterns:array<string>>"
_MARKS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds (with their kind) and candidates (without) of each text, with a hash of the string and its patterns."""
    import xxhash

    for batch in batches:
        out = []
        for t in texts_of(batch.column(1)):
            out.append([
                {"start": s, "end": e, "kind": kind, "instance": xxhash.xxh64_intdigest(t[s:e].lower().encode()) - (1 << 63), "patterns": contexts(t, s, e)}
                for s, e, kind in _candidates(t, base_spans(t))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _MARKS)], names=["given", "marks"])


_WORDS = WordHashes()
_BITS = 1 << 24


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + h[1:])


def _hashed(patterns: DataFrame) -> DataFrame:
    """``pattern, hash``: of the word, or of both words in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_WORDS.of(p[1:].split(" ")) for p in batch.column(0).to_pylist()]
            h = np.array([w[0] if len(w) == 1 else _pairs(w)[0] for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64())], names=["pattern", "hash"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, hash long")


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, occurs``: how often the words of each pattern stand in all texts (a column ``text``).

    A task counts the hashes that a bitmap of bounded size knows and hands on one row for each; the join with
    the patterns' hashes decides.
    """
    hashed = materialise(_hashed(patterns), "hashed")
    packed, places = np.packbits(hash_bitmap(hashed, _BITS)), np.uint64(_BITS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed).astype(bool)
        total: dict[int, int] = {}
        for batch in batches:
            for t in texts_of(batch.column(0)):
                words = [w.strip(_TRIM) for w in t.lower().split()]
                h, empty = _WORDS.of(words), np.fromiter((not w for w in words), bool, len(words))
                both = np.concatenate([h[~empty], _pairs(h)[~(empty[:-1] | empty[1:])]]) if len(h) else h
                for k, n in zip(*(x.tolist() for x in np.unique(both[known[both & places]], return_counts=True))):
                    total[k] = total.get(k, 0) + n
        at = np.fromiter(total, np.uint64, len(total)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(total.values()), pa.int64())], names=["hash", "n"])

    counted = texts.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("occurs"))
    return hashed.join(counted, "hash").select("pattern", "occurs")


def confident_patterns(found: DataFrame, texts: DataFrame | None = None, *, least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE, least_instances: int = LEAST_INSTANCES,
                       own_vote: float = OWN_VOTE, least_belief: float = LEAST_BELIEF) -> DataFrame:
    """``pattern, score, instances, known``: patterns to discover with.

    Of all occurrences of a pattern's words in ``texts``, ``least_share`` have to stand before a seed or candidate;
    others have no part in the graph.
    The graph has an edge for each pattern and different instance, whatever its number of
    occurrences, so that copies of a document don't vote. Seeds have belief 1. For a pattern,
    the belief in another instance is the noisy-or of the confident patterns around it with
    another last word: a word and the two words that end in it see the same places and are
    one voter. With m the average belief over the pattern's instances and its own score s
    counted ``own_vote`` times, s = m + (1 - m) * own_vote * s, so s = m / (1 - (1 - m) * own_vote).
    Only patterns with ``least_score`` vote, so that weak patterns can't lift each other.

    Scores start from the seeds and only rise; where the voters stay the same, changes shrink
    by a third a round at the default values. Rounds end when no score rises by ``TOLERANCE``.
    """
    edges = materialise(
        found.select(F.explode("marks").alias("m"))
        .select("m.instance", F.col("m.kind").isNotNull().cast("int").alias("seed"), F.explode("m.patterns").alias("pattern"))
        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("places")), "graph")
    per = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("places").alias("places")).filter(F.col("n") >= least_instances)
    if texts is not None:
        per = materialise(per, "frequent")
        often = occurrences(texts, per)
        per = per.join(often, "pattern").filter(F.col("places") >= least_share * F.col("occurs"))
        edges = edges.join(materialise(per.select("pattern"), "label-like"), "pattern", "left_semi")
    # A string that is a seed anywhere is one everywhere.
    seeds = edges.filter("seed = 1").select("instance", F.lit(True).alias("is_seed")).distinct()
    edges = edges.select("pattern", "instance").join(seeds, "instance", "left").select("pattern", "instance", F.col("is_seed").isNotNull().alias("seed"))
    edges = materialise(edges, "graph")
    # Patterns with too few instances never qualify and carry no score.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum(F.col("seed").cast("long")).alias("known")).filter(F.col("instances") >= least_instances)
    wide = materialise(wide, "patterns")
    # The last word of a pattern; patterns with the same one are one voter.
    voter = F.regexp_replace(F.element_at(F.split("pattern", " "), -1), "^<", "").alias("voter")
    open_edges = materialise(edges.filter("not seed").join(wide.select("pattern"), "pattern").select("pattern", voter, "instance"), "graph")

    def scored(beliefs: DataFrame | None) -> DataFrame:
        given = wide.withColumn("belief", F.lit(0.0)) if beliefs is None else wide.join(beliefs, "pattern", "left")
        mean = (F.col("known") + F.coalesce("belief", F.lit(0.0))) / F.col("instances")
        return materialise(given.select("pattern", "instances", "known", (mean / (1 - (1 - mean) * own_vote)).alias("score")), "scores")

    score, rises = scored(None), True
    while rises:
        sure = score.filter(F.col("score") >= least_score).select("pattern", "score")
        # The logarithm of a voter's doubt.
        votes = materialise(open_edges.join(sure, "pattern").groupBy("instance", "voter").agg(
            F.log(1.0 - F.least(F.max("score"), F.lit(0.999999))).alias("doubt")), "votes")
        total = votes.groupBy("instance").agg(F.sum("doubt").alias("all"))
        others = F.col("all") - F.coalesce("doubt", F.lit(0.0))
        belief = F.greatest(1 - F.exp(others), F.lit(0.0))
        beliefs = (open_edges.join(total, "instance").join(votes, ["instance", "voter"], "left")
                   .groupBy("pattern").agg(F.sum(F.when(belief >= least_belief, 1.0).otherwise(belief)).alias("belief")))
        before, score = score, scored(beliefs)
        rises = not score.join(before.select("pattern", F.col("score").alias("before")), "pattern").filter(F.col("score") > F.col("before") + TOLERANCE).isEmpty()
    return score.filter(F.col("score") >= least_score).select("pattern", "score", "instances", "known")


def personal_data(docs: DataFrame, *, text: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) with ``spans``: an array of ``start, end, kind`` by start, then kind.

    Spans are code points, end exclusive; base spans stay as they are. The added spans have
    the kind ``context`` and overlap no base span. NULL text is empty, without spans; a
    column named ``spans`` is replaced; every row gives one row, repeated rows too; ids play
    no part. The texts are read twice, for candidates and for the occurrences of patterns; discovery joins
    the patterns with the candidates found, whatever their number.
    """
    kept = [F.col(c) for c in docs.columns if c != "spans" and (keep_text or c != text)]
    schema = docs.select(F.struct(*kept).alias("given")).schema
    found = docs.select(F.struct(*kept).alias("given"), text_or_empty(text)).mapInArrow(_marks, f"given {schema[0].dataType.simpleString()}, marks array<{_MARK}>")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "marks")
    best = materialise(confident_patterns(found, docs.select(text_or_empty(text).alias("text")), **options), "confident")
    seen = found.select("row", F.explode("marks").alias("m")).filter("m.kind is null").select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    more = seen.join(best.select("pattern"), "pattern", "left_semi").groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    base = F.transform(F.filter("marks", lambda m: m["kind"].isNotNull()),
                       lambda m: F.struct(m["start"].alias("start"), F.element_at(order, m["kind"]).alias("rank"), m["end"].alias("end"), m["kind"].alias("kind")))
    added = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")),
                        lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["end"].alias("end"), F.lit(CONTEXT).alias("kind")))
    spans = F.transform(F.array_sort(F.concat(base, added)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.join(materialise(more, "discovered"), "row", "left").select("given.*", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the first kind counts, for all of them."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(held, s):
        from_ = F.greatest(held["at"], s["start"])
        gap = F.substr(text, held["at"] + 1, from_ - held["at"])
        new = F.concat(held["out"], gap, F.when(s["start"] >= held["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
        return F.struct(new.alias("out"), F.greatest(held["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substr(text, held["at"] + 1)))
