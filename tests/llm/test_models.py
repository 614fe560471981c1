"""Trained operators: recursions against enumeration, held-out accuracy, odd documents."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.llm import hmm_lm, quality_knn, toxicity
from dosewise.llm.common import id_bucket, read

CORPUS = "/root/testdata/sf0.1"


# -- hidden Markov model ----------------------------------------------------

def random_model(rng, k=3, s=5):
    p = lambda *n: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(n))
    return hmm_lm.Hmm(p(k), p(k, k), np.ascontiguousarray(p(k, s).T))


def paths(model, text):
    """Every state path and its joint probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[x, b]
        yield path, p


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
@pytest.mark.parametrize("held", [4, 7, 1 << 18])
def test_recursions_equal_enumeration(monkeypatch, held, piece):
    monkeypatch.setattr(hmm_lm, "HELD", held)
    monkeypatch.setattr(hmm_lm, "PIECE", piece)
    rng = np.random.default_rng(held)
    model = random_model(rng)
    texts = [rng.integers(0, 5, n) for n in (1, 5, 2, 7, 7, 3, 8, 1)]
    ll = hmm_lm.log_likelihoods(model, texts)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text, got in zip(texts, ll):
        total = sum(p for _, p in paths(model, text))
        assert got == pytest.approx(np.log(total))
        for path, p in paths(model, text):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for x, a in zip(text, path):
                emit[x, a] += p / total
    for got, want in zip(hmm_lm.expected_counts(model, texts, 5), (start, move, emit)):
        np.testing.assert_allclose(got, want, atol=1e-9)


def brute_base(rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = [[*hmm_lm.words(t or ""), b""] for _, t in rows]
    counts = {}
    for (d, _), ts in zip(rows, tokens):
        if not held(d):
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return sorted([(d, held(d), len(ts), sum(t in counts for t in ts), n, round(sum(np.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 5)) for (d, _), ts in zip(rows, tokens)], key=str)


def scored(docs, **kw):
    out = hmm_lm.score(docs, id_bucket(F.col("doc_id"), 10) != 0, **kw).collect()
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out], key=str)
    assert got == brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(np.isfinite(r["score"]) for r in out)
    return out


def test_scores_of_the_corpus(spark, sf, monkeypatch):
    docs = read(spark, sf, "documents")
    out = scored(docs)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # the same with all but the commonest words looked up by the join
    monkeypatch.setattr(hmm_lm, "KNOWN", 64)
    monkeypatch.setattr(hmm_lm, "OWN", 32)
    again = {r["doc_id"]: r for r in scored(docs, passes=1)}
    assert len(again) == len(out)


def test_one_state_is_the_unigram_model(spark, sf):
    for r in hmm_lm.score(read(spark, sf, "documents"), id_bucket(F.col("doc_id"), 10) != 0, states=1, passes=1).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=2e-2)


def test_scores_of_odd_documents(spark, odd_docs, no_docs):
    scored(odd_docs)
    assert hmm_lm.score(no_docs, id_bucket(F.col("doc_id"), 10) != 0).count() == 0
    alone = hmm_lm.score(odd_docs.where("doc_id = 4"), F.lit(False)).first()
    assert (alone["held_out"], alone["n_tokens"], alone["n_known"], alone["train_tokens"], alone["base_score"]) == (True, 1, 0, 0, 0.0)


@pytest.mark.parametrize("known", [512, 1 << 17])
def test_rare_words_have_states_of_their_own(spark, monkeypatch, known):
    """Two words of one ending, seen ten times each in 44,000 tokens, each among the words of one topic; tied at first where they are not broadcast."""
    monkeypatch.setattr(hmm_lm, "KNOWN", known)
    rng = np.random.default_rng(5)
    text = lambda topic, more: " ".join(f"{topic}{i}" if i < 40 else more for i in rng.permutation([*rng.integers(0, 40, 109), 40]))
    rows = [(i, text("ab"[i % 2], ("redword" if i % 2 else "blueword") if i < 20 else "ab"[i % 2] + "0")) for i in range(400)]
    ordinary = [text(t, "{}") for t in "ab"]
    rows += [(1000 + i, ordinary[i // 2].format(("redword", "blueword")[i % 2])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in hmm_lm.score(docs, F.col("doc_id") < 1000).where("held_out").collect()}
    assert got[1001]["score"] > got[1000]["score"] + 0.2 and got[1002]["score"] > got[1003]["score"] + 0.2
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])


def test_passes_go_on_until_nothing_is_gained_however_rows_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{j}" for j in rng.integers(0, 20, 12))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scores = lambda df, **kw: {r["doc_id"]: r["score"] for r in hmm_lm.score(df, F.lit(True), states=3, **kw).collect()}
    one, five, two_passes = scores(docs.coalesce(1)), scores(docs.repartition(5, "text")), scores(docs, passes=2)
    assert five == pytest.approx(one, rel=1e-4)
    # near what the source itself gives its texts: one of twenty words at a time, then one end of thirteen tokens
    source = -900 * (12 * np.log10(20 * 13 / 12) + np.log10(13))
    assert 1.04 * source < sum(one.values()) < source and sum(one.values()) > sum(two_passes.values())
    monkeypatch.setattr(hmm_lm, "TOLERANCE", 100.0)
    assert scores(docs) == pytest.approx(two_passes, rel=1e-4)


def test_a_book_lists_its_words_once_whatever_slices_its_texts_are_in(spark):
    """Before, every slice of a task listed its words anew, so that words sent and answered grew with the slices."""
    rows = [(i, i % 10 == 0, f"the w{i} w{i % 7} \x1codd\x0b\x85 Été") for i in range(300)] + [(None, False, ""), (1, None, " \t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string").coalesce(1)
    counts = hmm_lm.word_counts(docs).collect()
    seen = collections.Counter(w for _, _, x in rows for w in [*hmm_lm.words(x), b""])
    assert {(bytes(r["token"]), r["n"], r["class"]) for r in counts} == {(w, n, hmm_lm.word_class(w)) for w, n in seen.items()}
    none = np.zeros(hmm_lm.CLASSES)
    letters = hmm_lm.Alphabet(1, 2, 8, [b"the", b""], {b"the": 0, b"": 1}, np.ones(2), none, none, none, none)
    (book,) = hmm_lm.coded(docs, letters).collect()
    rare = hmm_lm._parted(book["rare"])
    assert len(rare) == len(set(rare)) and set(rare) == set(seen) - {b"the", b""}
    assert hmm_lm._unpacked(book["kinds"], "u1").tolist() == [hmm_lm.word_class(w) for w in rare]
    symbols, sizes = hmm_lm._coded_texts(book.asDict(), [*hmm_lm.SLICED, "out"], 1)
    texts = [b" ".join([b"the", b"", *rare][i] for i in x[:-1]) for x in np.split(symbols, np.cumsum(sizes)[:-1])]
    got = sorted(zip(book["ids"], book["held"], texts), key=str)
    assert got == sorted([(i, out, b" ".join(hmm_lm.words(x))) for i, out, x in rows], key=str)


def test_scores_do_not_depend_on_books(spark, monkeypatch):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{j}" for j in rng.zipf(1.4, 60) % 500)) for i in range(400)], "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(hmm_lm, "KNOWN", 256)
    whole = {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in hmm_lm.score(docs, F.col("doc_id") % 10 != 0, passes=2).collect()}
    for name, n in (("BOOK", 500), ("SPLIT", 700), ("FLUSH", 50)):
        monkeypatch.setattr(hmm_lm, name, n)
    for r in hmm_lm.score(docs, F.col("doc_id") % 10 != 0, passes=2).collect():
        assert (r["score"], r["base_score"], r["n_known"]) == pytest.approx(whole[r["doc_id"]], rel=1e-5)


# -- classifiers ------------------------------------------------------------

def held_out(spark, module, label, n, held):
    docs, labels = read(spark, CORPUS, "documents"), read(spark, CORPUS, "labels")
    test = id_bucket(F.col("doc_id"), n) == held
    model = module.fit(docs, labels, learn=~test)
    tested = labels.where(test).select("doc_id", F.col(label).alias("label"))
    rows = module.score(docs.join(tested.select("doc_id"), "doc_id"), model).join(tested, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [(r["label"], r["score"]) for r in rows]


def test_quality_on_held_out_labels(spark):
    rows = held_out(spark, quality_knn, "quality", 3, 1)
    good, bad = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    assert np.mean([s >= 0.5 for s in good]) > 0.99 and np.mean([s < 0.5 for s in bad]) > 0.9


def test_toxicity_on_held_out_labels(spark):
    rows = held_out(spark, toxicity, "toxic", 5, 0)
    toxic, clean = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    assert np.mean([s >= 0.5 for s in toxic]) > 0.8 and np.mean([s < 0.5 for s in clean]) > 0.97


@pytest.mark.parametrize("module", [quality_knn, toxicity])
def test_classifiers_take_odd_documents(spark, odd_docs, no_docs, label_rows, module):
    everything = F.lit(True)
    model = module.fit(odd_docs, label_rows, learn=everything)
    rows = module.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 12) for r in rows if r["doc_id"] in (3, 4)}) == 1
    assert module.score(no_docs, model).count() == 0
    for docs, labels in ((no_docs, label_rows), (odd_docs, label_rows.where("false"))):
        empty = module.fit(docs, labels, learn=everything)
        assert all(0 <= r["score"] <= 1 for r in module.score(odd_docs, empty).collect())


def test_blocked_votes_equal_plain_votes():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((40, 6)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels, votes = rng.integers(0, 2, 40), rng.integers(1, 4, 40).astype(float)
    idf = np.ones(quality_knn.TERMS, np.float32)
    axes = rng.standard_normal((quality_knn.TERMS, 6)).astype(np.float32)
    model = quality_knn.Model(idf, axes, vectors, labels, votes, 5, 0.5)
    counts = rng.integers(0, 3, (9, quality_knn.TERMS))
    for row, got in zip(counts, quality_knn.vote(model, counts)):
        x = np.log1p(row) @ axes
        sims = vectors @ (x / np.linalg.norm(x))
        best = np.argsort(-sims)[:5]
        w = np.clip(sims[best], 0, None) ** 3 * votes[best]
        assert got == pytest.approx((w * labels[best]).sum() / w.sum(), abs=1e-4)


# -- toxicity against a plain version ---------------------------------------

def plain_grams(text):
    """The n-grams of a text as a set, hashed one by one."""
    import re
    text = re.sub("[\t-\r]", " ", f" {text.lower()} ")
    base, mix, out = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, set()
    for n in toxicity.ORDERS:
        for k in range(len(text) - n + 1):
            h = ord(text[k])
            for c in text[k + 1 : k + n]:
                h = (h * base + ord(c)) & (1 << 64) - 1
            out.add((((h ^ h >> 29) * mix + n) & (1 << 64) - 1) >> 64 - toxicity.BITS)
    return out


def test_toxicity_is_the_plain_log_count_ratio_model(spark):
    rnd = random.Random(4)
    voc = {0: ["fine", "day", "café", "sun", "tree"], 1: ["vile", "day", "nasty", "sun", "scum"]}
    rows = [(i, " ".join(rnd.choices(voc[i % 3 == 0], k=rnd.randrange(1, 9)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows if i % 4], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") != 7, n_features=150, least_z=0.0)
    known = [(plain_grams(t), int(i % 3 == 0)) for i, t in rows if i % 4 and i != 7]
    n = [sum(y == v for _, y in known) for v in (0, 1)]
    z = {}
    for g in set().union(*(s for s, _ in known)):
        held = [sum(g in s for s, y in known if y == v) for v in (0, 1)]
        p = [(held[v] + 1) / (n[v] + 2) for v in (0, 1)]
        z[g] = (abs(p[1] - p[0]) / sum(p[v] * (1 - p[v]) / n[v] for v in (0, 1)) ** 0.5, np.log(p[1] / p[0]))
    best = sorted(sorted(z, key=lambda g: (-z[g][0], g))[:150])
    assert len(best) == 150 and set(np.flatnonzero(model.weights)) <= set(best)
    ratio = np.array([z[g][1] for g in best])
    x = np.array([[g in s for g in best] for s, _ in known], float) * ratio
    y = np.array([v for _, v in known], float)
    each = np.array([1 / n[v] for _, v in known]) / 2
    # the weights are a minimum of the weighted loss: its gradient is nearly zero, and the loss is far below that of no weights
    w = np.divide(model.weights[best], ratio, out=np.zeros(150), where=ratio != 0)
    bias = model.bias - 0.5 * np.log(n[1] / n[0])
    at = x @ w + bias
    loss = (each * (np.logaddexp(0, at) - y * at)).sum()
    assert loss < 0.1 and np.abs(x.T @ (each * (1 / (1 + np.exp(-np.clip(at, -700, 700))) - y))).max() < 0.02
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in rows:
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-(sum(float(model.weights[g]) for g in plain_grams(t)) + model.bias))), rel=1e-5)


def test_ngrams_of_a_long_text_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abcde \n\U0001f600é", k=3000))
    whole = toxicity.ngrams(text)
    assert set(whole.tolist()) == plain_grams(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert np.array_equal(toxicity.ngrams(text), whole)
    assert not len(toxicity.ngrams("")) and len(toxicity.ngrams("a")) == 1


def test_a_sample_is_bounded_though_an_id_has_many_rows(spark):
    from dosewise.llm.common import COPIES, labelled_sample
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x") for i in range(2, 20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    texts, _ = labelled_sample(docs, labels, "quality", F.lit(True), 50)
    assert texts.count() == COPIES + 18
