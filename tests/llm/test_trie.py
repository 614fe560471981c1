"""Prefix tries against a brute-force version over all prefixes, and across many small shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from dosewise.llm import prefix_trie
from dosewise.llm.prefix_trie import SHARED, TernaryTree, rebuilt, sequences, shard_nodes, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, ends string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % (SHARED + 1)
        base = c - int(np.fmod(c, 100))
        full[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def result(turns):
    return sorted((tuple(r) for r in trie(rebuilt(sequences(turns))).collect()), key=repr)


def made(seed, n, ids):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(ids, n):
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "ccc", "", "é\U0001f600"])) for t in range(rnd.randrange(0, 9) or 1)]
    return rows


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_all_prefixes_whatever_the_shards(spark, parts):
    rows = made(parts, 150, list(range(-250, 420)))
    rows += [(c, t, "user", "copy") for c in range(1000, 1099) for t in range(7)]  # one group of copies over many shards
    rows += [(2000, t, "user", f"deep{t}") for t in range(300)] + [(2000 + k, t, "user", f"deep{t}") for k in (1, 2) for t in range(150)]
    saved = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert result(frame(spark, rows)) == brute(rows)
    finally:
        for c, v in saved.items():
            spark.conf.set(c, v)


def test_nulls_ties_repeats_and_turnless_conversations(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "system", "b"), (7, 0, "user", None), (7, None, "user", "x"),
            (None, 1, "user", "lost"), (105, 0, "user", "no base"), (-3, 0, "", ""), (300, 0, "user", "a" * 100_000), (301, 0, "user", "q")]
    rows += [(c, 0, "user", "short") for c in range(500, 560) if zlib.crc32(str(c).encode()) % 6]  # their bases may be absent
    rows += [(c, 0, "user", "turnless") for c in range(701, 760)]
    got = result(frame(spark, rows))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[3] > 30 for r in got)


def test_no_conversations(spark):
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(None, 1, "user", "x")])) == []


def test_tree_is_balanced_by_medians():
    tree = TernaryTree()
    seqs = [np.array([k]) for k in range(1023)]
    for k in prefix_trie._medians(len(seqs)):
        tree.insert(seqs[k], np.array([1]), 1, k)
    deepest, stack = 0, [(tree.eq[0], 1)]
    while stack:
        node, d = stack.pop()
        deepest = max(deepest, d)
        stack += [(x, d + 1) for x in (tree.lo[node], tree.hi[node]) if x]
    assert deepest == 10 and sorted(prefix_trie._medians(10)) == list(range(10))


def test_long_path_needs_no_recursion():
    rows = shard_nodes(0, [np.arange(5), np.arange(20_000)], [np.ones(5, int), np.ones(20_000, int)], np.array([2, 1]))
    assert len(rows) == 20_001 and all(r["key"] is not None for r in rows)
