"""Language of web pages by Bayesian fusion of evidence.

Three sources of evidence meet: the likelihood of the visible text under character
trigrams, the language that the markup declares, and the page's address. How far a
declaration or an address suffix can be trusted is counted over all pages, from the texts'
own posteriors. The address gives a prior for the host that is smoothed towards its domain,
that towards its suffix, and that towards all pages; a page doesn't vote for itself.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import materialise, text_or_empty, texts_of

BUCKETS = 1 << 15
SAMPLE = 1_000  # labelled documents of each language that the trigram model is fitted on, at most
BROADCAST_ROWS = 500_000  # sampled ids that are broadcast, at most
SMOOTH = 5.0  # pages' worth of the next level's prior in each level
TEXT_WEIGHT = 0.05  # trigrams overlap and depend on each other: their log likelihood counts by this factor

_HIDDEN = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""")


def visible_text(markup: str) -> str:
    return html_entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each run of three bytes of the lower-cased text, spaces and digits as one space."""
    raw = np.frombuffer(re.sub(r"[\s\d_]+", " ", text.lower()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)


@dataclass
class Trigrams:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS

    def likelihood(self, text: str) -> np.ndarray:
        """Weighted log likelihood of the text in each language; zeros without three bytes."""
        return TEXT_WEIGHT * self.log_p[:, trigram_buckets(text)].sum(axis=1, dtype=np.float64)


def fit_trigrams(docs: DataFrame, *, sample: int = SAMPLE) -> Trigrams:
    """Trigram model of every language that labels a document.

    Fitted on at most ``sample`` documents of each language, those with the smallest hash of their id;
    documents without id or language are left out.
    """
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.filter("doc_id is not null and lang is not null").select("lang", "doc_id").distinct()
    known = materialise(known.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= sample).drop("_r"), "sample")
    # Texts stay where they are as long as the list of those wanted is short.
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    chosen = docs.select("doc_id", "lang", "text").join(side, ["lang", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(trigram_buckets(t), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    counted = materialise(chosen.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    # At most BUCKETS rows for each language.
    rows = counted.toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    table = np.full((len(names), BUCKETS), 0.5)
    table[np.array([names.index(x) for x in rows["lang"].to_pylist()], np.int64), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return Trigrams(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user and port; empty if there is none."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


def _posterior(log: Column) -> Column:
    most = F.array_max(log)
    e = F.transform(log, lambda x: F.exp(x - most))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _sums(vector: str, k: int) -> Column:
    return F.array(*[F.sum(F.col(vector)[i]) for i in range(k)])


def page_languages(pages: DataFrame, model: Trigrams, *, smooth: float = SMOOTH) -> DataFrame:
    """``page_id, host, declared, text_lang, lang, probability`` of each page.

    ``text_lang`` is by the text alone. NULL or empty markup has no text and no declaration:
    its host decides. A NULL or odd address has the empty host, whose pages share a prior.
    Repeated rows give a row each; ties go to the language first in the alphabet; an empty
    table gives no rows. A model without languages is an error.
    """
    k = len(model.languages)
    if not k:
        raise ValueError("the model has no language")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, logs = [], []
            for t in texts_of(batch.column(2)):
                m = _DECLARED.search(t[:4096]) or _DECLARED.search(t)
                lang = m[1].lower() if m else "none"
                declared.append(lang if lang in model.languages or lang == "none" else "other")
                logs.append(model.likelihood(visible_text(t)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(logs, pa.list_(pa.float64()))],
                names=["page_id", "host", "declared", "text_log"])

    read = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), text_or_empty("html").alias("html"))
    scored = read.mapInArrow(run, "page_id long, host string, declared string, text_log array<double>")
    labels = F.split("host", r"\.")
    scored = materialise(scored.withColumns({
        "p": _posterior(F.col("text_log")), "suffix": F.element_at(labels, -1),
        "domain": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))}), "pages")
    # Counts of languages by address, by level: host, domain, suffix and all pages.
    host = materialise(scored.groupBy("suffix", "domain", "host").agg(F.count("*").alias("n"), _sums("p", k).alias("c")), "hosts")
    level = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), _sums("c", k).alias("c"))
    domain = materialise(level(host, "suffix", "domain"), "domains")
    suffix = materialise(level(domain, "suffix"), "suffixes")
    top = suffix.agg(F.sum("n").alias("n"), _sums("c", k).alias("c")).first()
    overall = [((c or 0) + 1) / ((top["n"] or 0) + k) for c in (top["c"] or [0] * k)]
    below = lambda c, n, prior: F.zip_with(c, prior, lambda a, b: (a + b * smooth) / (n + smooth))
    suffix = suffix.select("suffix", below(F.col("c"), F.col("n"), F.array(*map(F.lit, overall))).alias("prior"))
    domain = domain.join(suffix, "suffix").select("suffix", "domain", below(F.col("c"), F.col("n"), F.col("prior")).alias("prior"))
    host = materialise(host.join(domain, ["suffix", "domain"]).select("host", "n", "c", "prior"), "priors")
    # How often pages in a language declare what: as many rows as languages and two.
    said = scored.groupBy("declared").agg(_sums("p", k).alias("c")).collect()
    total = [sum(r["c"][i] for r in said) for i in range(k)]
    trust = {r["declared"]: [float(np.log((c + 0.5) / (t + 0.5 * (k + 2)))) for c, t in zip(r["c"], total)] for r in said}
    declared = F.coalesce(*[F.when(F.col("declared") == d, F.array(*map(F.lit, v))) for d, v in trust.items()], F.array(*[F.lit(0.0)] * k))
    joined = scored.join(host, "host")
    others = F.zip_with("c", "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = below(others, F.col("n") - 1, F.col("prior"))
    log = F.zip_with(F.zip_with("text_log", declared, lambda a, b: a + b), prior, lambda a, b: a + F.log(b))
    names = F.array(*map(F.lit, model.languages))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return joined.withColumn("posterior", _posterior(log)).select(
        "page_id", "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("probability"))
