"""The registered queries against plain versions over the whole small tables."""

import hashlib
import zlib
from collections import defaultdict

import brute
import pytest
from conftest import SF

from faultline.llm import queries as Q
from faultline.llm.common import read


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "") for r in read(spark, SF, "documents").collect()]


def test_warc(spark):
    pages = [(r["page_id"], r["html"]) for r in read(spark, SF, "pages").collect()]
    got = Q.op1_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(brute.archives(pages))


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in Q.op2_minhash(spark, SF).collect()}
    assert got == brute.classes(docs)


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = Q.op3_quality(spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_token_counts(spark, docs):
    ids = brute.token_ids("byte_bpe_50k.json", [t for _, t in docs])
    want = {d: (len(t.encode()), len(i), len(i) > 512) for (d, t), i in zip(docs, ids)}
    assert {r["doc_id"]: tuple(r)[1:] for r in Q.op4_token_counts(spark, SF).collect()} == want


def test_personal_data(spark, docs):
    for r in Q.op5_pii(spark, SF).collect():
        want = brute.base_spans(dict(docs)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]


def test_decontamination(spark, docs):
    import re

    items = [(r["item_id"], re.findall(r"\w+", r["text"].lower())) for r in read(spark, SF, "benchmark").collect()]
    want = set()
    for d, t in docs:
        grams = {tuple(w) for words in [re.findall(r"\w+", t.lower())] for w in zip(*(words[i:] for i in range(16)))}
        want |= {(d, i) for i, w in items if any(tuple(w[k : k + 16]) in grams for k in range(len(w) - 15))}
    got = {(r["doc_id"], r["item_id"]) for r in Q.op6_decontamination(spark, SF).collect()}
    assert want and want <= got


def test_fingerprints(spark, docs):
    got = sorted(map(tuple, Q.op7_fingerprints(spark, SF).collect()))
    assert got == brute.fingerprints(docs)
    assert sum(r[5] for r in got) / len(got) > 0.5 > 0.2 > sum(r[6] for r in got) / len(got)


def test_token_files(spark, docs):
    docs = sorted(docs)
    want, start = [], 0
    for (d, _), ids in zip(docs, brute.token_ids("word_bpe_49k.json", [t for _, t in docs])):
        ids = [*ids, 2]
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = Q.op8_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_packing(spark, docs):
    ids = {d: [*i, 2] for (d, _), i in zip(docs, brute.token_ids("byte_bpe_50k.json", [t for _, t in docs]))}
    rows = Q.op9_packing(spark, SF).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, found in pieces.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(found)):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024) and 0 < length <= 1024
            assert crc == brute.crc(ids[d][at : at + length])
            at += length
        assert at == len(ids[d])
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(bins) <= 1.05 * least + 1


def test_language(spark):
    pages = {r["page_id"]: r["url"] for r in read(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = Q.op10_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    right = sum(f"/{r['lang']}/" in pages[r["page_id"]] for r in rows)
    assert right >= 0.97 * len(rows)
