"""Toxicity, fill-in-the-middle and vector codes against plain versions and on odd rows."""

import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SF

from faultline.llm import fim, toxicity, vectorcodes
from faultline.llm import queries as Q
from faultline.llm.common import read

DOCS = "doc_id long, text string, extra string"


def test_buckets_are_the_grams_of_the_words():
    texts = ["", "  \n", "a", "An odd Word, an odd word", "é" * 9 + " ß", "x" * 40_000, " ".join(f"w{i}" for i in range(9_000))]
    for t in texts:
        assert toxicity.buckets(t).tolist() == brute.gram_buckets(t, toxicity.SIZES, toxicity.BUCKETS)


def test_ratios_and_score_by_hand():
    rows = [np.array(r, np.int32) for r in ([0, 1], [0], [1, 2])]
    got = toxicity.ratios(rows, np.array([1.0, 1.0, 0.0]), most=4)
    share = [np.array([3, 2, 1, 1]) / 7, np.array([1, 2, 2, 1]) / 6]
    assert np.allclose(got, np.log(share[0] / share[1]))
    model = toxicity.Linear(-1.0, np.array([0.5, 2.0, 0.0, 0.0]))
    assert model.score(rows[0]) == pytest.approx(1 / (1 + np.exp(-1.5))) and model.score(np.zeros(0, np.int32)) == pytest.approx(1 / (1 + np.e))


def test_fit_is_the_minimum():
    """No step in any direction lowers the penalised loss; blocks don't change it."""
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(30), 6)), np.int32) for _ in range(80)]
    y = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    a, b = (toxicity.fit(rows, y, y.mean() / (1 - y.mean()), most=32, ridge=0.01, rounds=300, block=n) for n in (7, 512))
    assert np.allclose(a.weight, b.weight, atol=1e-4)
    ratio = toxicity.ratios(rows, y, 32)

    def loss(base, v):
        margin = np.array([base + (v * ratio)[r].sum() for r in rows])
        return np.logaddexp(0, np.where(y > 0, -margin, margin)).mean() + 0.005 * (v @ v)

    v = np.divide(a.weight, ratio, out=np.zeros(32), where=ratio != 0)
    least = loss(a.base, v)
    for _ in range(200):
        step = np.array([rng.gauss(0, 0.05) for _ in range(33)])
        assert loss(a.base + step[0], v + step[1:]) >= least - 1e-7


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = Q.op11_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == read(spark, "/root/testdata/sf0.1", "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    score, truth = np.array([s for s, _ in judged]), np.array([t for _, t in judged])
    rank = score.argsort().argsort()
    toxic, clean = (truth == 1).sum(), (truth == 0).sum()
    assert (rank[truth == 1].sum() - toxic * (toxic - 1) / 2) / (toxic * clean) > 0.95
    assert (truth[score >= 0.7] == 1).mean() > 0.95


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, "e"), (2, "", "e"), (2, "", "e"), (None, "bad words", "e"), (3, "x" * 60_000, "e"), (4, "good", "e")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as score", "7 as y", "'f' as found")
    labels = spark.createDataFrame([(2, 0), (2, 1), (4, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and got[0]["y"] == 7
    none = docs.filter("false")
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert toxicity.fit_toxicity(docs, labels.filter("false")).score(np.zeros(0, np.int32)) == pytest.approx(0.5)


def test_insults_inside_unseen_words_are_found(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "meadow"]
    text = lambda toxic: " ".join(rng.choice(words) for _ in range(30)) + (rng.choice([" grumbleworm", " snotgoblin"]) if toxic else "")
    docs = spark.createDataFrame([(i, text(i % 5 == 0), "") for i in range(600)], DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) as toxic")
    model = toxicity.fit_toxicity(docs, labels)
    asked = spark.createDataFrame([(1, "alpha river grumbleworms, beta", ""), (2, "alpha river stone beta", ""), (3, "SNOTGOBLINS delta cloud", "")], DOCS)
    assert [r["predicted"] for r in toxicity.score_toxicity(asked, model).orderBy("doc_id").collect()] == [1, 0, 1]


def test_token_ends_over_pieces(monkeypatch):
    import re

    monkeypatch.setattr(fim, "SCANNED", 5)
    rng = random.Random(2)
    for _ in range(500):
        t = "".join(rng.choice("ab é\t\n  \x0b") for _ in range(rng.randrange(24)))
        ends, at = [], 0
        for m in re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", t):
            at += len(m.encode())
            ends.append(at)
        assert fim.token_ends(t.encode()).tolist() == ends


def test_rotation_in_place(monkeypatch):
    monkeypatch.setattr(fim, "SCRATCH", 3)
    for n in range(12):
        for cut in range(n + 1):
            view = np.arange(n + 4)
            fim.rotate(view, 2, 2 + cut, 2 + n)
            assert view.tolist() == [0, 1, *range(2 + cut, 2 + n), *range(2, 2 + cut), n + 2, n + 3]


def test_arranged_texts_come_back():
    for raw in (b"a", b"<P", b"P> x <S", b"<S<S", "é ß ñ".encode(), b"< M> <", b" \n "):
        for a in range(len(raw) + 1):
            for b in range(a, len(raw) + 1):
                p, m, s = raw[:a], raw[a:b], raw[b:]
                assert fim.arrange(raw, a, b, "psm") == b"<P>" + p + b"<S>" + s + b"<M>" + m
                assert fim.arrange(raw, a, b, "spm") == b"<S>" + s + b"<P>" + p + b"<M>" + m
                assert all(fim.restored(bytes(fim.arrange(raw, a, b, f)), f) == raw for f in ("psm", "spm"))
    with pytest.raises(ValueError):
        fim.restored(b"<P>no middle<S>", "psm")


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(1, None, "e"), (2, "", "e"), (None, "no id here", "e"), (3, "has <S> inside", "e"), (4, "tab\tnbsp x é\n\n", "e")]
    rows += [(i, f" word{i}  and more\nwords – {i} ", "e") for i in range(10, 60)] + [(7, "long " * 50_000, "e"), (8, "y" * 200_000, "e"), (8, "y" * 200_000, "e")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as output", "1 as n", "'k' as _keys")
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    assert len(got) == len(rows)
    plain = {(d, t): brute.fill_in_middle(d, t or "") for d, t, _ in rows}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain[r["doc_id"], r["text"]]
        assert r["restored"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(docs.filter("false"))).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = vectorcodes.hilbert_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(4)
    for _ in range(200):
        points, entries = rng.integers(-6, 7, (9, 2)), rng.integers(-8, 9, (7, 2))
        kept = vectorcodes.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], entries)[0]
        distance = np.square(points[:, None] - entries[None]).sum(axis=2)
        assert all(kept[e] for row in distance for e in np.flatnonzero(row == row.min()))
    near, far = np.zeros((1, 2), np.int64), np.array([[0, 1], [50, 50]])
    assert vectorcodes.shortlists(near, near + 1, far).tolist() == [[True, False]]


def _check_codes(spark, rows, schema="vec_id long, embedding array<float>, label int", **options):
    df = spark.createDataFrame([(i, v, label) for i, label, v in rows], schema).selectExpr("*", "'clash' as code", "0 as _label")
    coded, books = vectorcodes.vector_codes(df.repartition(3), **options)
    got = vectorcodes.with_label_errors(coded)
    want, plain_books = brute.vector_codes([(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], **options)
    assert books.tolist() == plain_books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in got.collect()), key=key) == \
        sorted(((i, label, code, error, sums[label]) for i, label, code, error in want), key=key)


def test_vector_codes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i % 4), (rng.normal(0, 0.3, 32) + (i % 3)).tolist()) for i in range(150)]
    rows += [(200 + i, None, rows[0][2]) for i in range(60)]  # copies of one vector
    rows += [(300, 1, None), (301, 1, [None] * 32), (302, 1, [float("nan")] * 32), (303, None, [float("inf")] + [0.0] * 31), (304, 2, [])]
    rows += [(5, 3, rows[7][2]), (5, 3, rows[7][2]), (None, 2, rows[9][2]), (305, 0, [-0.001] * 32), (306, 0, [200.0] * 32)]
    _check_codes(spark, rows)


def test_vector_codes_with_few_rows_and_other_lengths(spark):
    _check_codes(spark, [(1, 0, [0.5, -0.5] * 2), (2, None, [0.25, 0.5] * 2), (2, 0, [0.5, 0.5] * 2)], parts=2, entries=4, rounds=1)
    schema = "vec_id long, embedding array<double>, label int"
    odd = spark.createDataFrame([(1, [0.0] * 16, 0), (2, [0.0] * 8, 0), (3, [1.0] * 16, None)], schema)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vectorcodes.with_label_errors(vectorcodes.vector_codes(odd)[0]).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: (None, None, 0), 3: ("01" * 16, 0, 0)}
    assert vectorcodes.with_label_errors(vectorcodes.vector_codes(odd.filter("false"))[0]).count() == 0
    no_id = vectorcodes.vector_codes(odd.selectExpr("cast(null as long) as vec_id", "embedding", "label"))[0].collect()
    assert [r["code"] for r in no_id] == [None] * 3
    with pytest.raises(Exception, match="no exact code"):
        vectorcodes.vector_codes(spark.createDataFrame([(1, [1e9] * 16, 0)], schema))


def test_vector_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    want = {i: (code, error) for i, _, code, error in brute.vector_codes(rows)[0]}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in Q.op13_vector_codes(spark, SF).collect()} == want
