"""Operators on whole documents against brute-force versions written from their contracts."""


import re
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from dosewise.llm import mixing, quality_rules, simhash, substring_dedup
from dosewise.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# -- rules ------------------------------------------------------------------

def measures(text):
    ws = words(text)
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check_measures(docs):
    got = sorted(((r["text"] or "", *(r["rules"][c] for c in COUNTS)) for r in quality_rules.measure(docs).select("text", "rules").collect()))
    assert got == sorted((r["text"] or "", *measures(r["text"])) for r in docs.select("text").collect())


def test_measures_of_the_corpus(spark, sf):
    check_measures(read(spark, sf, "documents"))


def test_measures_of_odd_documents(spark, odd_docs, no_docs):
    check_measures(odd_docs)
    assert quality_rules.measure(no_docs).count() == 0


def test_repeats_overlap_and_ties(spark):
    texts = ["a a a a a a a", "a b c d e a b c d e", "a b c d e x a b c d e f", "x\nx\nx\n \n", "a b c d", "a b c d e " * 500]
    check_measures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))


def binomial_allowed(n, a, level):
    from math import comb
    total, k = 0.0, -1
    for i in range(n + 1):
        total += comb(n, i) * a**i * (1 - a) ** (n - i)
        if total > level:
            break
        k = i
    return k


def rules_table(spark, n_good, n_high, n_bad, lang="en"):
    shares = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "shout_share")
    rows = [(i, lang, (50, 1, 0, 0, 0, 0.12 if i < n_high else 0.0, 0.0, 0.0, 0.0, 0.0)) for i in range(n_good)]
    rows += [(10**6 + i, lang, (50, 1, 0, 0, 0, 0.9, 0.0, 0.0, 0.0, 0.0)) for i in range(n_bad)]
    struct = ", ".join([*(f"{c}: bigint" for c in COUNTS), *(f"{c}: double" for c in shares)])
    docs = spark.createDataFrame(rows, f"doc_id bigint, lang string, rules struct<{struct}>")
    labels = spark.createDataFrame([(r[0], int(r[0] < 10**6)) for r in rows], "doc_id bigint, quality int")
    return docs, labels


@pytest.mark.parametrize("n_high", [0, 3, 200])
def test_cutoffs_follow_the_exact_bound(spark, n_high):
    n = 2000
    docs, labels = rules_table(spark, n, n_high, 40)
    grid = quality_rules.GRIDS["symbol_share"]
    allowed = binomial_allowed(n, quality_rules.ALPHA / 5, quality_rules.DELTA / (5 * 6))
    assert 3 <= allowed < 200
    best = max(((40 * n - (n_high if 0.12 > c else 0) * 40, c) for c in grid if (n_high if 0.12 > c else 0) <= allowed))[1]
    got = quality_rules.cutoffs(docs, labels).collect()
    assert [(r["stratum"], r["symbol_share"], r["shout_share"]) for r in got] == [("en", best, None)]


def test_too_few_labels_give_no_cutoffs(spark, odd_docs, label_rows, no_docs):
    docs, labels = rules_table(spark, 100, 0, 40)
    assert quality_rules.cutoffs(docs, labels).count() == 0
    for d in (odd_docs, no_docs):
        m = quality_rules.measure(d)
        judged = quality_rules.judge(m, quality_rules.cutoffs(m, label_rows))
        assert judged.columns == [*m.columns, "base_failed", "kept"]
        assert all(r["kept"] != r["base_failed"] for r in judged.collect()) and judged.count() == d.count()


def test_a_null_stratum_is_judged_by_its_own_cutoffs(spark):
    docs, labels = rules_table(spark, 2000, 0, 40, lang=None)
    judged = quality_rules.judge(docs, quality_rules.cutoffs(docs, labels))
    assert {(r["doc_id"] < 10**6, r["kept"]) for r in judged.collect()} == {(True, True), (False, False)}


# -- substring dedup --------------------------------------------------------

def brute_repeats(rows, n=50):
    order = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - n + 1):
            w = tuple(ws[i : i + n])
            first[w] = min(first.get(w, 1 << 62), order(d))
    out = []
    for d, t in rows:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i : i + n])] < order(d):
                gone |= set(range(i, i + n))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def check_repeats(docs, window=50):
    got = substring_dedup.remove_repeats(docs, window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    for r in got:
        assert sum(s["to"] - s["from"] for s in r["removed"]) == r["n_removed"]
        assert all(a["to"] < b["from"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_repeats_of_the_corpus(spark, sf):
    check_repeats(read(spark, sf, "documents"))


def test_repeats_of_odd_documents(spark, odd_docs, no_docs):
    check_repeats(odd_docs)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_pasted_passages(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [f"w{i}" for i in range(40)]
    pick = lambda n: [pool[i] for i in rng.integers(0, 40, n)]
    passages = [pick(int(n)) for n in rng.integers(9, 120, 12)] + [["la"] * 130]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.integers(0, 5)):
            text += pick(int(rng.integers(0, 30)))
            p = passages[rng.integers(0, len(passages))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            text += p if rng.random() < 0.5 else p[a:b]
        rows.append((int(rng.integers(0, 50)), " ".join(text)))
    check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 20)
    check_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)


# -- simhash ----------------------------------------------------------------

def brute_fingerprint(text, n=4):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    low = defaultdict(lambda: 1 << 62)
    for i, d in enumerate(ids):
        low[root(i)] = min(low[root(i)], 1 << 62 if d is None else d)
    return [None if low[root(i)] == 1 << 62 else low[root(i)] for i in range(len(ids))]


def check_simhash(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], fps, brute_components([d for d, _ in rows], fps)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_simhash_of_the_corpus(spark, sf):
    check_simhash(read(spark, sf, "documents"))


def test_simhash_of_odd_documents(spark, odd_docs, no_docs):
    check_simhash(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_links_are_whole_in_crowded_blocks(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    for _ in range(900):  # a crowd around one fingerprint: many share every block
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node bigint, fp bigint")
    from dosewise.llm.components import components
    for blocks, chunk in ((6, 40), (5, 512), (7, 7)):
        got = {r["node"]: r["component"] for r in components(simhash.links(nodes, 4, blocks, chunk)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_one_of_each_group_stays(spark, odd_docs):
    out = simhash.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    groups = brute_components(range(len(rows)), [brute_fingerprint(t) for _, t in rows])
    assert out.count() == len(set(groups))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (1, rows[0][1]) in got and (None, rows[0][1]) not in got and got.count((1, rows[0][1])) == 1


# -- mixing -----------------------------------------------------------------

def brute_mix(rows, seed=1, weights=(1, 2, 3), epochs=3.0):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in clamped]
        level = (total - sum(clamped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > epochs * sizes[s]]
        if not over:
            break
        clamped |= {s: epochs * sizes[s] for s in over}
    return sizes, {s: clamped.get(s, level * w[s]) for s in names}


def check_mix(docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    sizes, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-9)
        assert r["target"] <= 3 * r["source_size"] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    return got


def test_mix_of_the_corpus(spark, sf):
    docs = read(spark, sf, "documents")
    got = check_mix(docs)
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r["source_size"], r["target"]][0] += r["taken"]
    for (_, target), (n, _) in per.items():
        assert n % 1 == 0 and target >= 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["taken"] for r in got}
    copied = defaultdict(int)
    for r in out.collect():
        copied[r["doc_id"]] += len(words(r["text"]))
    assert copied == {d: t for d, t in n.items() if t}


def test_mix_of_odd_documents(spark, odd_docs, no_docs):
    check_mix(odd_docs.drop("size", "score"))
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_documents(no_docs).count() == 0


def test_clamping_cascades(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 1000), ("b", 3), ("c", 40), ("d", 200), ("e", 1), (None, 7), ("f", 0)])]
    got = check_mix(spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id bigint, source string, text string"))
    assert sum(r["taken"] for r in got) == pytest.approx(1251, abs=8)


