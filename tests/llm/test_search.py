"""Ranked search against a brute-force version: every score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dosewise.llm import lexical_search
from dosewise.llm.lexical_search import Treap, _shard, build_index, quadtree, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LAST = 1 << 62


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def scores(docs, items):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        got = []
        for (d, bag), n in zip(bags, sizes):
            if n:
                m = 50 + (50 * n * n_docs) // n_terms
                got.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in set(terms(text)) if bag[w]), d))
        got = sorted((x for x in got if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out.append((item, got))
    return out


def brute(docs, items, k):
    return sorted(((item, r + 1, d, s) for item, got in scores(docs, items) for r, (s, d) in enumerate(got[:k])), key=repr)


def run(spark, docs, items, k):
    index, n, _ = build_index(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, score int, item_id string").repartition(3))
    found = search(index, n, spark.createDataFrame(items, "item_id bigint, text string"), k)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(seed, n, voc, longest):
    rnd = random.Random(seed)
    pick = lambda m: " ".join(f"t{int(rnd.paretovariate(0.7)) % voc}" for _ in range(m))
    return [(i, pick(rnd.randrange(longest))) for i in range(n)], [(100 + i, pick(rnd.randrange(1, 12))) for i in range(9)]


@pytest.mark.parametrize(("shard", "split"), [(4096, 256), (37, 3), (1, 1)])
def test_best_of_all_documents(spark, monkeypatch, shard, split):
    monkeypatch.setattr(lexical_search, "SPLIT", split)
    docs, items = made(shard, 300, 120, 60)
    docs += [(1000 + i, docs[5][1]) for i in range(30)]  # ties
    k = 20
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_nulls_repeats_ties_and_empty(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "word1x1 WORD2x2 tail"), (1, "word1x1 WORD2x2 tail"), (None, "été SAME"), (3, None), (4, ""), (5, "absent"), (6, "long5 long59999 ☃")]
    assert run(spark, docs, items, 5) == brute(docs, items, 5)
    index, n, _ = build_index(no_docs)
    assert search(index, n, spark.createDataFrame(items, "item_id bigint, text string"), 5).collect() == []
    index, n, _ = build_index(odd_docs)
    assert search(index, n, spark.createDataFrame([], "item_id bigint, text string"), 5).collect() == []


def test_items_in_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "PASS_ITEMS", 2)
    docs, items = made(3, 60, 40, 30)
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_shards_of_every_size_hold_exact_scores():
    """All documents of a shard come back with their exact scores, long items (cells found anew from the root) included."""
    docs, items = made(8, 90, 3000, 200)
    long = " ".join(f"t{i}" for i in range(3000))
    for n in (1, 2, 3, 33, 90):
        part = docs[:n]
        held = [(d, t.encode()) for d, t in part]
        sizes = [len(terms(t)) for _, t in part]
        n_docs, n_terms = sum(x > 0 for x in sizes), sum(sizes)
        shard = _shard(held, n_docs, n_terms)
        treap = Treap(shard["docs"], shard["levels"], shard["masks"], shard["falls"], shard["places"])
        row_of = {w: i for i, w in enumerate(shard["terms"].split(b"\n"))}
        df = np.frombuffer(shard["df"], np.int32)
        for (_, want), (_, text) in zip(scores(part, [*items, (0, long)]), [*items, (0, long)]):
            known = [(row_of[t], math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[row_of[t]]) + 1)))) for t in {w.encode() for w in terms(text)} if t in row_of]
            if known:
                rows, weights = np.array(known, np.int64).T
                for k in (1, 10, n + 1):
                    col, score = treap.best(rows, weights, k, 1)
                    assert [(int(s), int(treap.docs[c])) for c, s in zip(col, score) if s > 0][:k] == want[:k]


def test_cells_of_one_point_are_not_split():
    rng = np.random.default_rng(1)
    cells = rng.choice(64 * 64, 200, replace=False)
    impact = rng.integers(1, 1000, 200)
    masks, maxima, places = quadtree(cells // 64, cells % 64, impact, 6)
    assert maxima[0] == impact.max() and len(maxima) == len(masks) == 1 + sum(bin(m).count("1") for m in masks)
    assert len(places) == 200 == (masks == 0).sum() and len(set(places.tolist())) == 200
    masks, maxima, places = quadtree(np.array([5]), np.array([3]), np.array([7]), 3)
    assert masks.tolist() == [0] and maxima.tolist() == [7] and places.tolist() == [0b100111]
