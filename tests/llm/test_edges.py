"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ans, decontam, fingerprint, langid, minhash, packing, pii, quality, tokens, warc
from faultline.llm.encoding import encoder, library_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = library_path("byte_bpe_50k.json"), library_path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (2, ""), (None, "a b c d e f g"), (3, "one two"), (4, LONG), (5, "x" * 70_000), (6, "tab\there é <|endoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, None, "s", 0) for d, t in ROWS], DOCS)
    return df.selectExpr("*", "'clash' as spans", "1 as score", "2 as n_tokens", "'k' as digest", "0 as bucket")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_near_duplicates(docs, none):
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)] and (None, None) in got
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_estimate_the_similarity():
    a = (np.arange(1, 101, dtype=np.uint64), np.r_[np.full(50, 3), np.full(50, 1)])
    b = (np.arange(21, 121, dtype=np.uint64), np.ones(100, np.int64))
    exact = minhash.probability_jaccard(a, b)
    plain = brute.probability_jaccard(*(Counter({int(k): int(n) for k, n in zip(*x)}) for x in (a, b)))
    s = minhash.signatures([a, b], 4096)
    assert abs(exact - plain) < 1e-9 and abs((s[0] == s[1]).mean() - exact) < 0.03


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model)
    assert got.count() == len(ROWS) and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert quality.fit_quality(none, labels).scores(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.score_quality(none, model).count() == 0


def test_token_counts(docs, none):
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, BYTE, window=4096, overlap=64).collect())
    texts = [t or "" for _, t in ROWS]
    assert got == sorted((len(t.encode()), len(i)) for t, i in zip(texts, brute.token_ids("byte_bpe_50k.json", texts)))
    assert tokens.token_counts(none, BYTE).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splicing_gives_the_whole_text(name):
    texts = [LONG[:9_000], "y" * 3_000 + " z" * 500, "a\n\n  b " * 800, "é́   q " * 500, "don't  " * 900, "1 2\t3\r\n" * 700]
    enc = encoder(library_path(name))
    for t, whole in zip(texts, brute.token_ids(name, texts)):
        assert tokens.spliced_ids(enc, t, window=700, overlap=8).tolist() == whole
    ids, counts = enc.encode(texts)
    assert ids.tolist() == [i for w in brute.token_ids(name, texts) for i in w] and counts.tolist() == enc.count(texts).tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_plain_character_keeps_its_ids_in_parts(name):
    """Each character taken as plain, beside letters, digits, marks, spaces and its own kind, against the library."""
    from faultline.llm import encoding

    enc = encoding.Encoder(library_path(name))
    chars = sorted(encoding._PLAIN)
    texts = [f"{c}_a{c} {c}{c}.b {c}'s 1{c}2 -{c}|{c}" for c in chars] + ["İ_", "a İ. b", " | a|b | ", "|", "a  b   c\n\n d\t|", "x" * 3000, "'s 'S it's"]
    rng = np.random.default_rng(0)
    odd = list("  \n\t|.,'s1aİßéЖの中-_") + ["ab", " c", "don't", "|x"]
    texts += ["".join(rng.choice(odd, rng.integers(1, 30))) for _ in range(4_000)]
    ids, counts = enc.encode(texts)
    want = brute.token_ids(name, texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert enc.count(texts[::-1]).tolist() == counts.tolist()[::-1]


def test_personal_data(spark, docs, none):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(ROWS) and all(r["spans"] == [] for r in got)
    assert pii.personal_data(none).count() == 0
    for t in ("a@b.com_x@y.org", "@a.b a@b", "1.2.3.4.5 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111-", "+1 (017) 555-7713 +12", "9" * 5_000, "a@b@c.de"):
        assert [f"{k}:{s}:{e}" for s, e, k in pii.base_spans(t)] == brute.base_spans(t)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"filler words staff contact person{i}@mail.example.com and more") for i in range(40)]
    rows += [(100, "filler words staff contact AB-99-1234-77 and more"), (101, "other words near AB-99-1234-77 end")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in got[100]] == ["context"] and got[101] == [] and [s["kind"] for s in got[0]] == ["email"]


def test_contexts_discover_in_two_steps_and_scores_reject(spark):
    ids = [f"AB-{i}-1234" for i in range(100, 200)]
    rows = [f"filler words contact person{i}@mail.example.com and more" for i in range(40)]
    rows += [f"filler words contact {x} and more" for x in ids[:30]]
    rows += [f"look at badge {x} end" for x in ids[:40]]  # no seed, 30 of 40 known by the contact; the others are the second step
    rows += [f"back of shelf {x} end" for x in ids[25:65]]  # 15 of 40 known by contact and badge
    rows += [f"see on page {x} end" for x in ids[70:100]] + [f"see on page p{i}@mail.example.com end" for i in range(10)]  # 10 of 40 are seeds
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    for i, text in enumerate(rows):
        assert got[i] == (["email"] if "@" in text else ["context"] if "contact" in text or "badge" in text else []), text


def test_function_words_are_no_patterns_and_labels_are(spark):
    """Words before every noun stand before seeds too; a label stands before nearly nothing else. Precision and recall on planted identifiers."""
    rng = np.random.default_rng(6)
    noun = lambda: f"noun{'abcdefgh'[rng.integers(8)]}{'xyz'[rng.integers(3)]}"
    rows = [f"{noun()} the person{i}@mail.example.com and of person{i}x@mail.example.com {noun()}" for i in range(60)]
    rows += [f"the {noun()} of the {noun()} and the {noun()} of {noun()}" for _ in range(400)]
    rows += [f"see the R{i}-2024-77 of the {noun()} of Q{i}-11-2023" for i in range(30)]  # decoys
    rows += [f"{noun()} employee badge person{i}y@mail.example.com {noun()}" for i in range(40)]
    planted = {len(rows) + i: f"ZK-{1000 + i}-{i:03d}" for i in range(35)}
    rows += [f"{noun()} employee badge {x} {noun()}" for x in planted.values()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {}
    for r in pii.personal_data(docs).collect():
        for s in r["spans"]:
            if s["kind"] == pii.CONTEXT:
                found[r["doc_id"]] = rows[r["doc_id"]][s["start"] : s["end"]]
    recall = sum(found.get(d) == x for d, x in planted.items()) / len(planted)
    precision = sum(planted.get(d) == x for d, x in found.items()) / max(len(found), 1)
    assert recall == precision == 1


def test_pattern_scores_by_plain_rounds(spark):
    """The fixed point of the scores against loops over dictionaries, and occurrences against counting."""
    rng = np.random.default_rng(7)
    labels = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for i in range(600):
        a, b = rng.choice(labels, 2)
        name = f"id{rng.integers(60)}x{rng.integers(10, 99)}11" if rng.random() < 0.6 else f"u{rng.integers(80)}@mail.example.org"
        rows.append(f"{a} {b} {name} rest, {rng.choice(labels)} of it")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    marks = docs.selectExpr("struct(doc_id) as given", "text").mapInArrow(pii._marks, f"given struct<doc_id:long>, marks array<{pii._MARK}>").withColumn("row", F.monotonically_increasing_id())
    got = {r["pattern"]: r["score"] for r in pii.confident_patterns(marks, least_score=0.1, least_instances=5).collect()}
    want = brute.pattern_scores([m.asDict() for r in marks.collect() for m in r["marks"]], 0.1, 5, pii.OWN_VOTE, pii.LEAST_BELIEF)
    assert set(got) == set(want) and len(got) > 5 and all(abs(got[p] - want[p]) < 1e-4 for p in got)
    patterns = spark.createDataFrame([(p,) for p in ["<alpha", "<beta gamma", "<of it", "<rest", "<absent"]], "pattern string")
    words = [[w.strip(pii._TRIM).lower() for w in t.split()] for t in rows]
    want = {f"<{' '.join(k)}": n for size in (1, 2) for k, n in Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1)).items()}
    assert {r["pattern"]: r["occurs"] for r in pii.occurrences(docs, patterns).collect()} == {p: want[p] for p in ["<alpha", "<beta gamma", "<of it", "<rest"]}


def test_decontamination(spark, docs, none):
    item = " ".join(f"b{i}" for i in range(40))
    words = item.split()
    words[9], words[22] = "changed", "changed"
    bench = spark.createDataFrame([(7, item), (8, None), (None, "short"), (7, item)], "item_id long, text string")
    got = decontam.contaminated(docs.unionByName(spark.createDataFrame([(50, "before " * 30 + " ".join(words) + " after" * 9)], "doc_id long, text string"), allowMissingColumns=True), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["doc_token"], r["matches"], r["length"]) for r in got] == [(50, 7, 30, 38, 40)]
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.filter("false")).count() == 0


def test_longest_run_counts():
    rng = np.random.default_rng(1)
    for n in list(range(1, 41)) * 5:
        equal = rng.random(n) < rng.choice([0.5, 0.7, 0.8])
        runs = [(-int(equal[a:b].sum()), b - a, a) for a in range(n) for b in range(a + 1, n + 1) if equal[a:b].sum() * 10 >= 7 * (b - a)]
        start, stop = decontam.best_run(equal, 0.7)
        assert (-int(equal[start:stop].sum()), stop - start, start) == min(runs, default=(0, 0, 0))


def test_clustered_substitutions_are_one_run(spark):
    items = [[f"i{k}t{i}" for i in range(n)] for k, n in enumerate((24, 20, 40))]
    changed = [range(11, 15), range(9, 14), range(12, 24)]  # 20 of 24, 15 of 20, 28 of 40 tokens stay
    texts = [" ".join(f"x{i}" if i in c else w for i, w in enumerate(item)) for item, c in zip(items, changed)]
    docs = spark.createDataFrame([(k, f"before it {t} after it") for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["doc_token"], r["item_token"], r["length"], r["matches"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {k: (k, 2, 0, len(i), len(i) - len(c)) for k, (i, c) in enumerate(zip(items, changed))}


def test_masks_hit_every_qualifying_run():
    """The most equal tokens in a run that no mask hits, over all substitutions, by the last places of the run."""
    span = max(map(len, decontam.MASKS))
    places = [[len(m) - 1 - i for i, one in enumerate(m) if one == "1"] for m in decontam.MASKS]
    most = {(): 0}
    # A run of 36 or more has a half with the share; halves of 18 or more have 12 matches: lengths up to 35 decide.
    for length in range(1, 36):
        after = {}
        for last, ones in most.items():
            for bit in (0, 1):
                now = (bit, *last)[:span]
                if not any(all(p < len(now) and now[p] for p in mask) for mask in places):
                    after[now] = max(after.get(now, 0), ones + bit)
        most = after
        assert max(most.values()) < max(decontam.LEAST_MATCHES, -(-7 * length // 10))


def test_changed_copies_are_found_as_by_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [[f"i{k}t{i}" for i in range(n)] for k, n in enumerate([15] * 20 + [16] * 20 + [20] * 40 + [24] * 20 + [30] * 20 + [59])]
    texts = []
    for k, item in enumerate(items):
        n = len(item)
        changed = set(range(3, n, 4)) if k == len(items) - 1 else set(rng.choice(n, int(rng.integers(0, n // 2 + 1)), replace=False).tolist())
        texts.append(["lead", "in", *(f"x{i}" if i in changed else w for i, w in enumerate(item)), "end"])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    want = set()
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            for first in range(1 - len(item), len(text)):  # every diagonal
                equal = np.array([0 <= first + i < len(text) and text[first + i] == w for i, w in enumerate(item)])
                if equal.sum() >= 12:
                    a, b = decontam.best_run(equal, 0.7)
                    want |= {(d, k, int(equal[a:b].sum()))} if equal[a:b].sum() >= 12 else set()
    got = {(r["doc_id"], r["item_id"], r["matches"]) for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > 60 and got == want


def test_fingerprints(spark, docs, none):
    own = [(d, t) for d, t in ROWS if d is not None]
    got = sorted(map(tuple, fingerprint.edited_fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()))
    assert got == brute.fingerprints(dict(own).items())
    assert fingerprint.edited_fingerprints(docs).count() == len(ROWS) and fingerprint.edited_fingerprints(none).count() == 0


def test_token_files(docs, none):
    index, freq = ans.write_token_files(docs, WORD, end_id=2, vocabulary=49_408, chunk=512)
    got = ans.read_token_files(index, freq, with_ids=True).collect()
    want = sorted((d is not None, d or 0, [*i, 2]) for (d, _), i in zip(ROWS, brute.token_ids("word_bpe_49k.json", [t or "" for _, t in ROWS])))
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    assert found == want and all(r["ids_crc32"] == brute.crc(np.frombuffer(r["ids"], "<u4").tolist()) for r in got)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    index, freq = ans.write_token_files(none, WORD, end_id=2, vocabulary=49_408)
    assert ans.read_token_files(index, freq).count() == 0


def test_damaged_chunk():
    table = ans.Table.of_counts(np.bincount([1, 1, 2, 5, 5, 5], minlength=8))
    ids = np.array([1, 5, 5, 2, 5, 1] * 500, np.uint32)
    data = bytearray(ans.pack_chunk(ids, [1], [len(ids)], False, table))
    assert ans.unpack_chunk(bytes(data), table)[3].tolist() == ids.tolist()
    data[-3] ^= 1
    with pytest.raises(ValueError):
        ans.unpack_chunk(bytes(data), table)


def test_packing(docs, none):
    assert packing.pack(none, BYTE, end_id=2).count() == 0
    rows = packing.pack(docs, BYTE, end_id=2).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in brute.token_ids("byte_bpe_50k.json", [t or "" for _, t in ROWS]))
    bins, _ = packing.vector_best_fit(np.full(10, 10), 100, 2, 10**6)
    assert max(np.bincount(bins)) == 2
    bins, _ = packing.vector_best_fit(np.full(10, 10), 100, 10, 300, rule="dot")
    assert max(np.bincount(bins)) == 3


def test_packing_under_limits_that_bind(spark):
    """Every sequence keeps to tokens, documents and attention cost; each limit costs sequences of its own."""
    words = ["one two three", "a", "b c d e f g", "longer text with some more words in it than the others have"] * 30
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    sizes = [len(i) + 1 for i in brute.token_ids("byte_bpe_50k.json", words)]
    used = {}
    for name, limits in {"none": {}, "documents": {"max_documents": 3}, "attention": {"max_attention": 300}, "both": {"max_documents": 4, "max_attention": 400}}.items():
        for rule in ("norm", "dot"):
            rows = packing.pack(docs, BYTE, end_id=2, capacity=64, rule=rule, **limits).collect()
            bins = {}
            for r in rows:
                bins.setdefault(r["sequence_id"], []).append(r["length"])
            assert sorted(n for b in bins.values() for n in b) == sorted(sizes)
            for b in bins.values():
                assert sum(b) <= 64 and len(b) <= limits.get("max_documents", 64) and sum(n * n for n in b) <= limits.get("max_attention", 64 * 64)
            used[name, rule] = len(bins)
    assert used["none", "norm"] == -(-sum(sizes) // 64) or used["none", "norm"] <= 1.1 * sum(sizes) / 64 + 1
    assert min(used["documents", r] for r in ("norm", "dot")) >= 40 > used["none", "norm"] and used["attention", "norm"] > used["none", "norm"]
    with pytest.raises(Exception, match="no empty bin"):
        packing.pack(docs, BYTE, end_id=2, capacity=64, max_attention=max(sizes) ** 2 - 1).collect()


def plain_best_fit(lengths, capacities, weights=(1.0, 0.05, 0.05)):
    """Bins by looking at every open bin for each piece, longest first."""
    bins, of = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        item = (lengths[i], 1, lengths[i] ** 2)
        fits = [(sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, b, item, capacities)), k) for k, b in enumerate(bins) if all(r >= x for r, x in zip(b, item))]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(list(capacities))
        bins[k] = [r - x for r, x in zip(bins[k], item)]
        of[i] = k
    return of


def test_best_fit_places_pieces_as_a_full_search_does():
    rng = np.random.default_rng(4)
    for tokens, documents, attention in ((100, 100, 10_000), (100, 4, 10_000), (100, 6, 3_000)):
        lengths = rng.integers(1, 55, 120)
        got, _ = packing.vector_best_fit(lengths, tokens, documents, attention)
        want = plain_best_fit(lengths.tolist(), (tokens, documents, attention))
        # Open bins may be numbered apart where two are equally good, so the residuals have to agree.
        left = lambda of: sorted((sum(int(lengths[i]) for i in m), len(m)) for m in ([i for i in range(120) if of[i] == k] for k in set(of[i] for i in range(120))))
        assert left(dict(enumerate(got))) == left(want)


def test_archives(spark):
    rows = [(1, "http://a/b c", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<p>x"), (3, "u", "<p>x"), (4, "u\r\nX: y", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as payload", "1 as largest")
    got = warc.read_warc(warc.write_warc(warc.with_revisits(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    key = lambda r: (r[0] or 0, str(r))
    assert sorted(map(tuple, got), key=key) == sorted(brute.archives([(r[0], r[2]) for r in rows]), key=key)
    assert warc.read_warc(warc.write_warc(warc.with_revisits(pages.filter("false")))).count() == 0
    assert warc.coalesced([(0, 5), (5, 5), (100, 5)], gap=10, most=50) == [(0, 10, [0, 1]), (100, 105, [2])]


def test_languages(spark, none):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the and of to in that", "en"), ("der und die das nicht ein", "de")] * 20)], "doc_id long, text string, lang string")
    model = langid.fit_trigrams(docs)
    pages = spark.createDataFrame(
        [(1, "http://a.de/x", None), (2, None, "<html lang=en>the and that of"), (None, "http://a.de", "<p>und nicht die das ein der"), (4, "http://a.de/", "<p>der die das und"), (4, "http://a.de/", "<p>der die das und")],
        "page_id long, url string, html string")
    got = langid.page_languages(pages, model).collect()
    assert len(got) == 5 and {(r["page_id"], r["lang"]) for r in got} == {(1, "de"), (2, "en"), (None, "de"), (4, "de")}
    assert langid.page_languages(pages.filter("false"), model).count() == 0
    with pytest.raises(ValueError):
        langid.page_languages(pages, langid.fit_trigrams(none))


def test_every_language_is_modelled(spark):
    """Forty languages, one of them with a third of the rows and one with two documents only."""
    names = [f"{a}{b}" for a in "abcdefgh" for b in "vwxyz"]
    word = lambda k: f"{names[k][0]}{names[k][1]}{'qjkwz'[k % 5]}{'rstpl'[k // 8]}"
    rows = [(i, " ".join([word(k)] * 30), names[k]) for i, k in enumerate([0] * 200 + [39] * 2 + [k for k in range(1, 39) for _ in range(8)])]
    model = langid.fit_trigrams(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    assert model.languages == names
    pages = spark.createDataFrame([(k, f"http://h{k}.net/", f"<html lang={names[k]}>{word(k)} {word(k)} {word(k)} {word(k)}") for k in range(40)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["declared"], r["text_lang"]) for r in langid.page_languages(pages, model).collect()}
    assert got == {k: (names[k], names[k]) for k in range(40)}


def test_likelihoods_by_plain_counting(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the and of to in that", "en"), ("der und die das nicht ein", "de"), ("ab", "de"), (None, "en")] * 3)]
    model = langid.fit_trigrams(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for k, lang in enumerate(model.languages):
        counts = Counter(int(b) for _, t, x in rows if x == lang for b in langid.trigram_buckets(t or ""))
        total = sum(counts.values()) + 0.5 * langid.BUCKETS
        want = sum(np.log((counts[int(b)] + 0.5) / total) for b in langid.trigram_buckets("und the 12 das"))
        assert model.likelihood("und the 12 das")[k] == pytest.approx(langid.TEXT_WEIGHT * want, rel=1e-5)


def test_similarity_at_the_threshold_is_exact():
    ones = np.ones(9, np.int64)
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert minhash.probability_jaccard((a, ones), (b, ones)) == 0.8
    assert minhash.probability_jaccard((a, 2 * ones), (b, 2 * ones)) == pytest.approx(0.8)
