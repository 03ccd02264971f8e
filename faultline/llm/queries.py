"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.llm import ans, decontam, fim, fingerprint, langid, minhash, packing, pii, quality, tokens, toxicity, vectorcodes, warc
from faultline.llm.common import read
from faultline.llm.encoding import library_path

END_ID = 2
WORD_VOCABULARY = 49_408


def op1_warc(spark, sf_dir):
    records = warc.with_revisits(read(spark, sf_dir, "pages"))
    return warc.read_warc(warc.write_warc(records), payloads=False).drop("payload")


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("doc_id", quality.held_out().alias("held_out"), "text"), model).drop("text")


def op4_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, library_path("byte_bpe_50k.json"), limit=512)


def op5_pii(spark, sf_dir):
    found = pii.personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != pii.CONTEXT)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_decontamination(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_fingerprints(spark, sf_dir):
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index, frequencies = ans.write_token_files(docs, library_path("word_bpe_49k.json"), end_id=END_ID, vocabulary=WORD_VOCABULARY)
    return ans.read_token_files(index, frequencies)


def op9_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, library_path("byte_bpe_50k.json"), end_id=END_ID, capacity=1024)


def op10_language(spark, sf_dir):
    model = langid.fit_trigrams(read(spark, sf_dir, "documents"))
    return langid.page_languages(read(spark, sf_dir, "pages"), model)


def op11_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model).drop("text")


def op12_fill_in_middle(spark, sf_dir):
    made = fim.restore(fim.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_vector_codes(spark, sf_dir):
    coded, books = vectorcodes.vector_codes(read(spark, sf_dir, "embeddings"))
    return vectorcodes.with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vectorcodes.codebooks_digest(books)).alias("codebooks_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_warc, op2_minhash, op3_quality, op4_token_counts, op5_pii, op6_decontamination, op7_fingerprints,
           op8_token_files, op9_packing, op10_language, op11_toxicity, op12_fill_in_middle, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}
