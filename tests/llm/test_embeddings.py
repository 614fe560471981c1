"""Index searches against brute force: no false links, recall, components."""

import numpy as np
import pyarrow as pa
import pytest

from dosewise.llm import embed_dedup
from dosewise.llm.common import read

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, node bigint"


def brute(rows, threshold=0.95):
    """Links by row place, among sound vectors of one length."""
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in sound}:
        at = [i for i in sound if len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in at], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, row in enumerate(x @ x.T >= threshold):
            out[at[a]] |= {at[b] for b in np.flatnonzero(row) if b != a}
    return out


def groups(ids, near):
    out = [None] * len(ids)
    for i in range(len(ids)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            low = min((ids[j] for j in seen if ids[j] is not None), default=None)
            for j in seen:
                out[j] = (low,)
    return [o[0] for o in out]


def check(df, recall=0.9, exact=False, **kw):
    rows = [(r["vec_id"], None if r["embedding"] is None else list(r["embedding"])) for r in df.collect()]
    got = embed_dedup.near_duplicates(df, **kw).collect()
    near = brute(rows)
    comp = groups([r[0] for r in rows], near)
    want = sorted(((i, len(near[k]), comp[k], i == comp[k]) for k, (i, _) in enumerate(rows)), key=str)
    have = sorted((tuple(r) for r in got), key=str)
    assert len(have) == len(want)
    total, found = sum(w[1] for w in want), sum(h[1] for h in have)
    assert found <= total and found >= recall * total
    if exact:
        assert have == want
    return found, total


def test_corpus(spark, sf):
    check(read(spark, sf, "embeddings"), exact=True)
    check(read(spark, "/root/testdata/sf0.01", "embeddings"), exact=True)


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    near = x[rng.integers(0, 300, 900)] + 0.03 * rng.standard_normal((900, 24)) * np.sqrt(24)
    hot = x[0] + 0.02 * rng.standard_normal((700, 24))
    same = np.repeat(x[1:2], 800, axis=0)
    return np.concatenate([x, near, hot, same])


def test_crowded_lists_and_recall(spark, crowd):
    df = spark.createDataFrame([(int(i), [float(v) for v in row], 0, "x", 1) for i, row in enumerate(crowd)], SCHEMA)
    found, total = check(df, exact=True)
    assert total > 1_000_000 and found
    check(df, exact=True, cells=200)


@pytest.mark.parametrize(("dim", "rank"), [(3, 3), (64, 4)])
def test_no_link_is_missed_in_few_dimensions(spark, dim, rank):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((1500, rank)) @ rng.standard_normal((rank, dim))
    df = spark.createDataFrame([(int(i), [float(v) for v in row], 0, "x", 1) for i, row in enumerate(x)], SCHEMA)
    found, total = check(df, exact=True, cells=60)
    assert total > 10_000


def test_vectors_are_not_copied_for_the_lists_they_search(spark, tmp_path, monkeypatch):
    """Isotropic vectors are near the borders of very many lists; what is stored and shuffled stays within a few times the vectors."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 64)).astype("<f4")
    near = x[:300] + 0.02 * rng.standard_normal((300, 64)).astype("<f4")
    df = spark.createDataFrame([(int(i), [float(v) for v in row], 0, "x", 1) for i, row in enumerate(np.concatenate([x, near]))], SCHEMA)
    df.write.parquet(str(tmp_path / "embeddings"))
    monkeypatch.setattr("dosewise.llm.common.shared_dir", lambda *_: str(tmp_path / "shared"))
    found, total = check(spark.read.parquet(str(tmp_path / "embeddings")), exact=True, cells=80)
    assert found == total > 0
    used = sum(p.stat().st_size for p in (tmp_path / "shared").rglob("*.parquet"))
    assert used < 2 * 6300 * 64 * 4


def test_several_blocks_a_file_and_doubles(spark, crowd, monkeypatch):
    for name, value in (("LEAST_BLOCK", 64), ("MOST_BLOCK", 256), ("TOGETHER", 3)):
        monkeypatch.setattr(embed_dedup, name, value)
    rows = [(None if i % 97 == 0 else int(i) % 3000, [float(v) for v in row], 0, "x", 1) for i, row in enumerate(crowd)]
    rows += [(50_000 + i, [1.0 + i * 1e-12, *([0.5] * 23)], 0, "x", 1) for i in range(40)]  # equal as floats
    check(spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>")), exact=True, cells=9)


def test_codes_by_tables_and_decoded_agree():
    rng = np.random.default_rng(2)
    x = embed_dedup._unit(rng.standard_normal((4000, 20)) + 3 * rng.standard_normal((1, 20)))
    index = embed_dedup.train(x[:1500], 1)
    codes = np.zeros((len(x), embed_dedup.SUBSPACES), np.uint8)
    part = {"cell": np.zeros(len(x), "<i4"), "node": np.arange(len(x)), "n": np.ones(len(x), "<i8"), "vector": x.astype("<f4"), "code": codes, "off": np.full(len(x), 0.1, "<f4")}
    a = embed_dedup._Members({k: v.tobytes() for k, v in part.items()}, index, 0.3, True)
    a.code = rng.integers(0, embed_dedup.CODES, codes.shape).astype(np.uint8)
    a.decoded = index.single[a.cell] + np.concatenate([index.books[s][a.code[:, s]] for s in range(embed_dedup.SUBSPACES)], axis=1)
    a.need = np.einsum("ij,ij->i", a.decoded, a.unit).astype("<f4")
    every = np.arange(len(x))
    by_tables = embed_dedup._near_codes(a, every, a.unit[:64], index)
    decoded = np.concatenate([embed_dedup._near_codes(a, part, a.unit[:64], index) for part in np.split(every, 4)])
    away = np.abs(a.decoded @ a.unit[:64].T - a.need[:, None]) > index.slack
    assert 0.1 < by_tables.mean() < 0.9 and (by_tables == decoded)[away].all()


def test_two_vectors_of_one_node_differ_in_the_check(monkeypatch):
    real = embed_dedup._digests

    def same_node(raw, dim, salt):
        out = real(raw, dim, salt).copy()
        out[:, 0] = 7
        return out

    monkeypatch.setattr(embed_dedup, "_digests", same_node)
    named = list(embed_dedup._named(0)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1.0, 0.0], [0.0, 1.0]])], names=["vec_id", "v"])])))
    assert named[0].column("node").to_pylist() == [7, 7] and len(set(named[0].column("check").to_pylist())) == 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [0.0, 1.0]), (9, [1.0, 0.01]), (10, [-0.0, 1.0]), (None, [0.3, -0.9]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 1e-30]), (13, [3e37, 3e37]), (14, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    check(df, exact=True)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0
    check(df.where("vec_id in (3, 4, 5)"), exact=True)
