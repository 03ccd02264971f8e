"""Stages of the pipeline on odd rows, and the whole of it against plain versions of its parts."""

import re

import brute
import numpy as np
from conftest import SF

import corpus_pipeline as P
from faultline.llm import decontam, minhash, pii, quality
from faultline.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i} " for i in range(400)]
A, B = "".join(WORDS[:60]).strip(), "".join(WORDS[100:160]).strip()
NEAR_A, NEAR_B = A.replace("word30", "other"), B.replace("word130", "other")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).selectExpr("*", "'clash' as digest", "1 as stands", "2 as label", "3 as _id", "'x' as spans")


def rows_of(df):
    assert df.columns == P.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_classes_are_those_of_texts(spark):
    """An id with two texts, near copies of both, and near copies without an id."""
    docs = frame(spark, [(1, A), (1, B), (2, NEAR_A), (3, NEAR_B), (None, A + " end"), (None, "alone without an id or a copy here"), (4, "short"), (4, "short")])
    got = sorted(((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None), (4, 4), (4, 4)], key=str)
    # Two classes share the id 1 and stay apart.
    classes, _ = minhash.text_classes(docs)
    assert classes.filter("stands").count() == 4 and classes.count() == 7


def test_dedup_keeps_one_row_of_each_class_of_texts(spark):
    docs = frame(spark, [(5, NEAR_A), (1, A), (1, A), (1, B), (None, NEAR_B), (None, "nothing like it anywhere in here"), (7, None), (8, ""), (9, "long " * 30_000)])
    got = rows_of(P.dedup_stage(spark, docs, SF))
    # Of A and its near copy either may stand for both, since A shares its id with another text.
    assert len(got) == 5 and sum(r in got for r in ((1, A), (5, NEAR_A))) == 1
    assert {(1, B), (7, None), (9, "long " * 30_000), (None, "nothing like it anywhere in here")} < set(got)
    assert P.dedup_stage(spark, docs.filter("false"), SF).count() == 0


def test_decontamination_drops_rows_without_ids_too(spark):
    item = read(spark, SF, "benchmark").filter("length(text) > 80").orderBy("item_id").first()["text"]
    docs = frame(spark, [(1, f"before {item} after"), (None, f"none {item} end"), (1, "clean"), (None, None), (2, ""), (3, "tok " * 20_000), (3, "tok " * 20_000)])
    assert rows_of(P.decontamination_stage(spark, docs, SF)) == [(1, "clean"), (2, ""), (3, "tok " * 20_000), (3, "tok " * 20_000), (None, None)]
    assert P.decontamination_stage(spark, docs.filter("false"), SF).count() == 0


def test_quality_stage_on_odd_rows(spark):
    given = read(spark, SF, "documents").select(*P.COLUMNS)
    odd = frame(spark, [(None, None), (None, ""), (10**9, "x" * 100_000), (10**9, "x" * 100_000)]).select(*P.COLUMNS)
    kept = P.quality_stage(spark, given.unionByName(odd), SF)
    model = quality.fit_quality(given.unionByName(odd), read(spark, SF, "labels"))
    want = [(r["doc_id"], r["text"]) for r in given.unionByName(odd).collect() if model.scores(np.array([quality.features(r["text"] or "")]))[0] >= 0.7]
    assert rows_of(kept) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) and len(want) > 100


def test_pii_stage_on_odd_rows(spark):
    docs = frame(spark, [(1, "mail me@here.org or 10.0.0.1"), (1, "mail me@here.org or 10.0.0.1"), (None, None), (2, ""), (3, "y" * 200_000), (None, "+1 (017) 555-7713")])
    got = P.pii_stage(spark, docs, SF)
    assert sorted(r["text"] or "" for r in got.collect()) == sorted(["mail [EMAIL] or [IP]"] * 2 + ["", "", "y" * 200_000, "[PHONE]"])
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in got.collect()) and got.columns == P.COLUMNS
    assert P.pii_stage(spark, docs.filter("false"), SF).count() == 0


def test_packing_stage_on_odd_rows(spark):
    docs = frame(spark, [(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, "z " * 5_000)])
    rows = P.packing_stage(spark, docs, SF).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in brute.token_ids("byte_bpe_50k.json", ["a b c", "a b c", "", "", "z " * 5_000]))
    assert P.packing_stage(spark, docs.filter("false"), SF).count() == 0


def test_whole_pipeline_against_plain_stages(spark):
    """Every stage's decision on the given documents, recomputed on what the stage before kept."""
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    model = quality.fit_quality(read(spark, SF, "documents"), read(spark, SF, "labels"))
    kept = [(d, t or "") for d, t in docs if model.scores(np.array([quality.features(t or "")]))[0] >= 0.7]
    classes = brute.classes(kept)
    kept = [(d, t) for d, t in kept if classes[d] == d]
    items = [re.findall(r"\w+", r["text"].lower()) for r in read(spark, SF, "benchmark").collect()]
    grams = {tuple(w[k : k + 16]) for w in items for k in range(len(w) - 15)}
    clean = [(d, t) for d, t in kept if not any(g in grams for words in [re.findall(r"\w+", t.lower())] for g in zip(*(words[i:] for i in range(16))))]
    rows = P.run(spark, SF).collect()
    left = {r["doc_id"] for r in rows}
    # Passages of 16 equal tokens are caught for sure; shorter or changed ones may be as well.
    assert left <= {d for d, _ in clean} and len(left) >= len(clean) - 12
    frame_ = spark.createDataFrame([(d, t) for d, t in clean if d in left], "doc_id long, text string")
    redacted = {}
    for r in pii.personal_data(frame_, keep_text=True).collect():
        text = r["text"]
        for s in sorted(r["spans"], key=lambda s: -s["start"]):
            text = text[: s["start"]] + f"[{s['kind'].upper()}]" + text[s["end"] :]
        redacted[r["doc_id"]] = text
    ids = {d: [*i, 2] for d, i in zip(redacted, brute.token_ids("byte_bpe_50k.json", list(redacted.values())))}
    bins = {}
    for r in rows:
        assert r["ids_crc32"] == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(n for b in bins.values() for _, n in b) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024


def test_repeated_tokens_make_few_rows(spark):
    """Twenty items and documents of one repeated token: one range of diagonals for each pair, and the best overlap."""
    docs = spark.createDataFrame([(i, "again " * 400) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "again " * 40) for i in range(20)], "item_id long, text string")
    windows = decontam.benchmark_windows(bench)
    assert windows.count() == 20 * len(decontam.MASKS)
    for rows in (0, 10**6):
        got = decontam.contaminated(docs, bench, broadcast_rows=rows).collect()
        assert len(got) == 400 and {(r["matches"], r["length"], r["doc_token"], r["item_token"]) for r in got} == {(40, 40, 0, 0)}
