"""Embedding near-duplicates: coarse inverted lists with product-quantised residuals, exact rerank.

Unit vectors go to the list of their nearest coarse centroid; what is left
after the centroid is cut into subspaces, each kept as the code of its nearest
sub-centroid.  The lists lie in blocks, one row a block, and every two blocks
meet once, by a product of the stored table with itself: no vector is copied
for the lists that it searches, whatever their number, and nothing is
shuffled.  There a list's members search the lists of the other block:

* two vectors of which one lies further from the border of the two lists than
  the other may be from it are no link: their distance along the line between
  the centroids is part of their distance;
* the distances of the others to the codes (asymmetric: the searcher is not
  quantised) come from lookup tables, or from the decoded codes where fewer
  codes are looked up than a table has entries;
* codes near enough, given how far each code is from its vector, are reranked
  by the exact cosine in double precision.

Centroids are trained on a bounded sample; every vector is indexed and every
vector searches.  Equal vectors are one node with a count.  A crowded list is
many blocks of bounded size.  Two blocks give back counts of links and the star
edges that connect the same vectors, but no pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm.common import LAST_ID, per_batch, stored
from dosewise.llm.components import components, forest

SUBSPACES, CODES = 8, 256
#: Vectors that centroids and codes are fitted on: 16 for each list, at least and at most so many.
SAMPLE, MOST_SAMPLE = 20_000, 1 << 18
#: Vectors of a block: a sixteenth of all, at least and at most so many, and at most so many bytes.
LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 1 << 10, 1 << 16, 1 << 22
#: Blocks that make a file, of which a task reads one of either side, at most.
TOGETHER = 8
#: Searchers and members compared at once, at most; small lists are put together to so many members.
STRIP, MEMBERS, FEW = 1 << 7, 1 << 12, 1 << 8
#: Vectors unpacked at once.
STEP = 1 << 11
_PARTS = ("cell", "node", "n", "vector", "code", "off")


@dataclass
class Index:
    centroids: np.ndarray  # cells x width
    codebooks: np.ndarray  # SUBSPACES x codes x width / SUBSPACES
    dim: int
    sizes: np.ndarray  # sampled vectors of each cell
    first: np.ndarray | None = None  # each cell's first block
    chunks: np.ndarray | None = None  # and the number of blocks it is cut into
    together: int = 1  # blocks of a file

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    @cached_property
    def single(self) -> np.ndarray:
        return self.centroids.astype("<f4")

    @cached_property
    def books(self) -> np.ndarray:
        return self.codebooks.astype("<f4")

    @property
    def slack(self) -> float:
        """More than products of unit vectors in single precision are off."""
        return 8 * self.centroids.shape[1] * float(np.finfo("<f4").eps)

    def deal(self, n_nodes: int) -> int:
        """Deal the lists to blocks, whose number it gives: small lists share one, a crowded list has several."""
        most = min(MOST_BLOCK, max(1, BLOCK_BYTES // (4 * self.dim)))
        most = min(most, max(LEAST_BLOCK, math.ceil(n_nodes / 16)))
        expected = self.sizes * (n_nodes / max(1, self.sizes.sum()))
        self.chunks = np.maximum(1, np.ceil(expected / most)).astype(np.int64)
        self.first = np.zeros(len(expected), np.int64)
        block, held = 0, 0.0
        for cell, (size, chunks) in enumerate(zip(expected, self.chunks.tolist())):
            if held and held + size > most:
                block, held = block + 1, 0.0
            self.first[cell] = block
            block, held = (block + chunks, 0.0) if chunks > 1 else (block, held + max(size, 1.0))
        return int((self.first + self.chunks).max())

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector, the same whatever vectors are beside it: near ties are settled one by one."""
        score = x.astype("<f4") @ self.single.T - ((self.centroids**2).sum(axis=1) / 2).astype("<f4")
        home = score.argmax(axis=1)
        close = score >= score[np.arange(len(x)), home][:, None] - np.float32(self.slack)
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            cells = np.flatnonzero(close[r])
            home[r] = cells[((x[r] - self.centroids[cells]) ** 2).sum(axis=1).argmin()]
        return home


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, a bounded number of distances at once."""
    step = max(1, (1 << 21) // len(centers))
    return np.concatenate([_distances(x[at : at + step], centers).argmin(axis=1) for at in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def train(sample: np.ndarray, cells: int) -> Index:
    """Coarse centroids and residual codebooks from unit vectors."""
    width = math.ceil(sample.shape[1] / SUBSPACES) * SUBSPACES
    x = np.pad(sample, ((0, 0), (0, width - sample.shape[1])))
    centroids = _kmeans(x, min(cells, len(x)), 8, 5)
    home = _nearest(x, centroids)
    rest = (x - centroids[home]).reshape(len(x), SUBSPACES, -1)
    books = np.stack([_kmeans(np.ascontiguousarray(rest[:, s]), min(CODES, len(x)), 6, s) for s in range(SUBSPACES)])
    return Index(centroids, books, sample.shape[1], np.bincount(home, minlength=len(centroids)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("<f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sound(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sound vectors of one length, and their doubles.

    Scaled by a power of two so that no square overflows or vanishes; zeros
    lose their sign.
    """
    flat = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()
    length = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    for dim in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == dim)
        x = flat[starts[at][:, None] + np.arange(dim)].astype("<f8") + 0.0
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        at, x = at[ok], x[ok]
        if len(at):
            yield at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _raw(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes: of floats if they hold it exactly, else of doubles."""
    short = x.astype("<f4")
    exact = (short == x).all(axis=1).tolist()
    return [(short[i] if e else x[i]).tobytes() for i, e in enumerate(exact)]


def _digests(raw: list[bytes], dim: int, salt: int) -> np.ndarray:
    """128 bits of each vector's digest: its node, and a check on it."""
    head = b"%d:%d:" % (salt, dim)
    return np.frombuffer(b"".join(hashlib.blake2b(head + r, digest_size=16).digest() for r in raw), "<i8").reshape(-1, 2)


def _named(salt: int):
    """``vec_id, node, check, dim`` of every row; without the last three if the vector is not sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                names, dims = np.zeros((part.num_rows, 2), np.int64), np.zeros(part.num_rows, np.int32)
                for at, x in _sound(part.column("v")):
                    names[at], dims[at] = _digests(_raw(x), x.shape[1], salt), x.shape[1]
                none = dims == 0
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(names[:, 0], mask=none), pa.array(names[:, 1], mask=none), pa.array(dims, mask=none)],
                                                 names=["vec_id", "node", "check", "dim"])

    return run


def _picked(salt: int, dim: int, last: int):
    """``node, vector`` of the vectors of one length whose node is at most ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                for _, x in _sound(batch.slice(lo, STEP).column("v")):
                    if x.shape[1] == dim:
                        node = _digests(raw := _raw(x), dim, salt)[:, 0]
                        at = np.flatnonzero(node <= last)
                        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([raw[i] for i in at], pa.binary())], names=["node", "vector"])

    return run


def _postings(sent, salt: int):
    """Rows of the lists: each vector once, in the block of its nearest list; copies that come together are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        step = max(16, min(STEP, (1 << 22) // len(index.centroids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                for _, x in _sound(batch.slice(lo, step).column("v")):
                    if x.shape[1] != index.dim:
                        continue
                    node, at, n = np.unique(_digests(raw := _raw(x), index.dim, salt)[:, 0], return_index=True, return_counts=True)
                    x = index.pad(_unit(x[at]))
                    home = index.home(x)
                    rest = (x - index.centroids[home]).reshape(len(x), SUBSPACES, -1)
                    codes = np.stack([_distances(np.ascontiguousarray(rest[:, s]), index.codebooks[s]).argmin(axis=1) for s in range(SUBSPACES)], axis=1)
                    off = np.sqrt(((rest - index.codebooks[np.arange(SUBSPACES), codes]) ** 2).sum(axis=(1, 2)))
                    block = index.first[home] + node % index.chunks[home]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.astype(np.int32)), pa.array(home.astype(np.int32)), pa.array(node), pa.array(n.astype(np.int64)), pa.array([raw[i] for i in at], pa.binary()),
                         pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(off.astype("<f4"))], names=["block", "cell", "node", "n", "vector", "code", "off"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip([0, *ends], ends):
            if held and held[-1].column("block")[0].as_py() != block[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(sent):
    """One row a block, its members in the order of their lists; as many rows a file as ``together``, some of them empty."""

    def row(block: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v], pa.binary()) for v in parts)], names=["block", *_PARTS])

    def parts(rows: pa.Table, dim: int) -> list[bytes]:
        cell, node = rows.column("cell").to_numpy(), rows.column("node").to_numpy()
        order = np.lexsort((node, cell))
        new = np.flatnonzero(np.diff(node[order], prepend=node[order[0]] ^ 1) != 0)
        n = np.add.reduceat(rows.column("n").to_numpy()[order], new)
        order = order[new]
        raw = rows.column("vector").take(pa.array(order)).to_pylist()
        if any(len(r) > 4 * dim for r in raw):
            raw = [r if len(r) > 4 * dim else np.frombuffer(r, "<f4").astype("<f8").tobytes() for r in raw]
        return [cell[order].astype("<i4").tobytes(), node[order].astype("<i8").tobytes(), n.astype("<i8").tobytes(), b"".join(raw),
                b"".join(rows.column("code").take(pa.array(order)).to_pylist()), rows.column("off").to_numpy()[order].astype("<f4").tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, empty = sent.value, [b""] * len(_PARTS)
        after = 0  # the block after the last one
        for rows in _runs(batches):
            block = rows.column("block")[0].as_py()
            start = block - block % index.together
            if after <= start:
                yield from (row(b, empty) for b in range(after, after + -after % index.together))
                after = start
            yield from (row(b, empty) for b in range(after, block))
            yield row(block, parts(rows, index.dim))
            after = block + 1
        yield from (row(b, empty) for b in range(after, after + -after % index.together))

    return run


class _Members:
    """A block as arrays: members in the order of their lists.  ``decode``: their codes too, which searchers do without."""

    def __init__(self, row: dict, index: Index, reach: float, decode: bool):
        self.cell, self.node, self.n = np.frombuffer(row["cell"], "<i4"), np.frombuffer(row["node"], "<i8"), np.frombuffer(row["n"], "<i8")
        m = len(self.node)
        self.raw = np.frombuffer(row["vector"], "<f4" if len(row["vector"]) == 4 * m * index.dim else "<f8").reshape(m, index.dim)
        self.unit = np.zeros((m, index.centroids.shape[1]), "<f4")
        for at in range(0, m, MEMBERS):
            part = self.raw[at : at + MEMBERS]
            self.unit[at : at + MEMBERS, : index.dim] = part / np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
        self.own = np.einsum("ij,ij->i", self.unit, index.single[self.cell])
        if decode:
            self.code = np.frombuffer(row["code"], np.uint8).reshape(m, SUBSPACES)
            self.decoded = index.single[self.cell]
            for s, part in enumerate(np.split(self.decoded, SUBSPACES, axis=1)):
                part += index.books[s].take(self.code[:, s], axis=0)
            # a code is off its vector by a known length, the most that it can add to the distance of a true neighbour
            off = np.frombuffer(row["off"], "<f4")
            self.need = (1 + np.einsum("ij,ij->i", self.decoded, self.decoded) - (np.float32(reach) + off) ** 2) / 2 - np.float32(index.slack)
        self.cells, starts = np.unique(self.cell, return_index=True)
        self.starts = np.append(starts, m)
        self.place = np.repeat(np.arange(len(self.cells)), np.diff(self.starts))
        ends = [0]
        for i in range(1, len(self.cells) + 1):
            if self.starts[i] - self.starts[ends[-1]] >= FEW or i == len(self.cells):
                ends.append(i)
        self.groups = list(zip(ends[:-1], ends[1:]))


def _facing(a: _Members, b: _Members, index: Index, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of ``a`` and searchers of ``b`` (places) that may link, as far as their distances from the border tell.

    For ``x`` of one list and ``y`` of another, ``(x - y)(c - d)`` is at most
    their distance times that of the centroids ``c`` and ``d``.  Of one block,
    each two lists are met once.
    """
    for at in range(0, len(b.cells), 16):
        cells = b.cells[at : at + 16]
        from_border = a.own - index.single[cells] @ a.unit.T
        for k, cell in enumerate(cells):
            lo, hi = b.starts[at + k], b.starts[at + k + 1]
            apart = np.sqrt(((index.centroids[a.cells] - index.centroids[cell]) ** 2).sum(axis=1))
            room = (reach * apart + index.slack).astype("<f4") - (b.own[lo:hi, None] - b.unit[lo:hi] @ index.single[a.cells].T)
            for first, last in a.groups:
                if a is b:
                    if last <= at + k:
                        continue
                    first = max(first, at + k)
                x0, x1 = a.starts[first], a.starts[last]
                far = from_border[k, x0:x1]
                most = room[:, first:last].max(axis=1)
                who = np.flatnonzero(most >= far.min())
                who = who[np.argsort(-most[who], kind="stable")]
                for s in range(0, len(who), STRIP):
                    y = who[s : s + STRIP]
                    x = np.flatnonzero(far <= room[y, first:last].max(axis=0)[a.place[x0:x1] - first])
                    for i in range(0, len(x), MEMBERS):
                        yield x0 + x[i : i + MEMBERS], lo + y


def _near_codes(a: _Members, x: np.ndarray, searchers: np.ndarray, index: Index) -> np.ndarray:
    """Which codes (rows) are near enough to which searchers that their vectors may link."""
    if len(x) <= SUBSPACES * CODES:
        return a.decoded[x] @ searchers.T >= a.need[x][:, None]
    cells, of = np.unique(a.cell[x], return_inverse=True)
    got = (index.single[cells] @ searchers.T).take(of, axis=0)
    for s, part in enumerate(np.split(searchers, SUBSPACES, axis=1)):
        got += (index.books[s] @ part.T).take(a.code[x, s], axis=0)
    return got >= a.need[x][:, None]


def _exact(a: _Members, x: np.ndarray, b: _Members, y: np.ndarray, threshold: float) -> np.ndarray:
    hit = np.zeros(len(x), bool)
    step = max(1, (1 << 22) // a.raw.shape[1])
    for k in range(0, len(x), step):
        part = slice(k, k + step)
        hit[part] = np.einsum("ij,ij->i", _unit(a.raw[x[part]]), _unit(b.raw[y[part]])) >= threshold
    return hit


def _linked(a: _Members, b: _Members, index: Index, threshold: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of two blocks that link; each pair once."""
    for x, y in _facing(a, b, index, reach):
        searchers = b.unit[y]
        ok = _near_codes(a, x, searchers, index)
        if a is b:
            ok &= x[:, None] > y
        sure = None
        if 8 * np.count_nonzero(ok) > ok.size:
            # where many are near, only those within rounding of the threshold are left to doubles
            cosine = a.unit[x] @ searchers.T
            ok &= cosine >= threshold - index.slack
            sure = cosine > threshold + index.slack
        at = np.flatnonzero(ok)
        if len(at):
            i, j = np.divmod(at, len(y))
            hit = np.zeros(len(at), bool) if sure is None else sure.ravel()[at]
            left = np.flatnonzero(~hit)
            hit[left] = _exact(a, x[i[left]], b, y[j[left]], threshold)
            if hit.any():
                yield x[i[hit]], y[j[hit]]


def _search(sent, threshold: float):
    reach = math.sqrt(max(2 - 2 * threshold, 0))

    def meet(a: _Members, b: _Members, index: Index) -> pa.RecordBatch:
        node, n = (a.node, a.n) if a is b else (np.concatenate([a.node, b.node]), np.concatenate([a.n, b.n]))
        shift = 0 if a is b else len(a.node)
        links, low = np.zeros(len(node), np.int64), np.arange(len(node))
        for u, v in _linked(a, b, index, threshold, reach):
            v = v + shift
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            here, there = low[u], low[v]
            apart = here != there
            if apart.any():
                which, lowest = forest(here[apart], there[apart])
                new = np.arange(len(node))
                new[which] = lowest
                low = new[low]
        some, tree = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(node)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[np.concatenate([some, tree])]), pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)])),
             pa.array(node[np.concatenate([some, low[tree]])])], names=["a", "n", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, a, others = sent.value, None, None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                part = lambda end: {c: batch.column(c + end)[k].as_py() for c in _PARTS}  # noqa: B023, E731
                block, other = batch.column("block")[k].as_py(), batch.column("block_b")[k].as_py()
                if block != at:  # rows of one block come together, the first of them with its members
                    others = others if at is not None and block // index.together == at // index.together else {}
                    at, a = block, _Members(part(""), index, reach, True)
                if block % index.together == 0:  # the other file's blocks come with the first block of this one
                    others[other] = part("_b")
                b = a if other == at else _Members(others[other], index, reach, False)
                if len(a.node) and len(b.node):
                    yield meet(a, b, index)

    return run


def links(rows: DataFrame, nodes: DataFrame, n_nodes: int, dim: int, salt: int, threshold: float, sample: int | None = None, cells: int | None = None) -> DataFrame:
    """``a, n, b``: vectors that node ``a`` links to directly (``n``, copies counted), and edges ``a - b`` that connect what links connect.

    ``rows``: ``v``, arrays of which those of ``dim`` parts are looked at;
    ``nodes``: ``node`` of each different one, ``n_nodes`` of them.
    ``cells`` is the square root of the number of nodes unless given, and at
    most a sixteenth of the sample, which grows with the lists up to
    ``MOST_SAMPLE`` vectors.
    """
    spark = rows.sparkSession
    sample = sample or min(MOST_SAMPLE, max(SAMPLE, 16 * round(math.sqrt(n_nodes))))
    last = nodes.orderBy("node").limit(sample).agg(F.max("node")).first()[0]  # nodes are digests, so their order is a random one
    picked = per_batch(rows.select("v"), _picked(salt, dim, last), "node bigint, vector binary").dropDuplicates(["node"]).toArrow()
    order = np.argsort(picked["node"].to_numpy(), kind="stable")
    raw = (picked["vector"][int(i)].as_py() for i in order)
    x = np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8").astype("<f8") for r in raw])
    index = train(_unit(x), cells or max(1, min(round(math.sqrt(n_nodes)), len(x) // 16)))
    n_blocks = index.deal(n_nodes)
    index.together = max(1, min(TOGETHER, math.ceil(n_blocks / math.sqrt(6 * spark.sparkContext.defaultParallelism))))
    n_files = math.ceil(n_blocks / index.together)
    sent = spark.sparkContext.broadcast(index)  # cells and codes, whatever the data
    posted = per_batch(rows.select("v"), _postings(sent, salt), "block int, cell int, node bigint, n bigint, vector binary, code binary, off float")
    file = F.floor(F.col("block") / index.together)
    schema = ", ".join(["block int", *(f"{c} binary" for c in _PARTS)])
    # whole files in the order of their blocks: one row group, so that no task reads a part of one
    blocks = stored(per_batch(posted.repartition(file).sortWithinPartitions("block"), _blocks(sent), schema), "vector-blocks", rows_per_file=index.together, **{"parquet.block.size": str(1 << 30)})
    blocks = blocks.coalesce(n_files)
    blocks = blocks.withColumns({"place": F.col("block") % index.together, "file": F.floor(F.col("block") / index.together)})
    others = blocks.select(*(F.col(c).alias(f"{c}_b") for c in blocks.columns))
    # every two files meet in one of two tasks; a file with itself, every two blocks once
    here = F.when((F.col("file") + F.col("file_b")) % 2 == 0, F.col("file") < F.col("file_b")).otherwise(F.col("file") > F.col("file_b"))
    own = F.col("file") == F.col("file_b")
    met = blocks.join(others.hint("shuffle_replicate_nl"), (own & (F.col("block") <= F.col("block_b"))) | (~own & here))
    # a task's Python gets the members of each block once: with the first block that it meets
    first, first_b = F.when(own, F.col("block") == F.col("block_b")).otherwise(F.col("place_b") == 0), F.col("place") == 0
    met = met.select("block", "block_b", *(F.when(first, F.col(c)).alias(c) for c in _PARTS), *(F.when(first_b, F.col(f"{c}_b")).alias(f"{c}_b") for c in _PARTS))
    return per_batch(met, _search(sent, threshold), "a bigint, n bigint, b bigint")


@contextmanager
def _small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """While blocks go to Python, only a few at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample: int | None = None, cells: int | None = None,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero or hold a null, infinite or NaN link
    with nothing; vectors of different lengths do not link.  Repeated rows are
    vectors of their own, and copies link to each other.  A null id is larger
    than any other.  ``kept``: the id is its component's smallest.

    ``vectors`` is read more than once and not stored, so it must give the
    same rows each time.
    """
    v = vectors[vector_col]
    if vectors.select(v).dtypes[0][1] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), v.alias("v"))
    order = F.coalesce("vec_id", F.lit(LAST_ID))
    for salt in itertools.count():
        named = stored(per_batch(rows, _named(salt), "vec_id bigint, node bigint, check bigint, dim int"), "vectors")
        nodes = named.where("node is not null").groupBy("node").agg(
            F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min("dim").alias("dim"), (F.min("check") < F.max("check")).alias("torn"))
        nodes = stored(nodes, "vector-nodes")
        dims = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("torn").alias("torn")).collect()  # one row a dimension
        if not any(d["torn"] for d in dims):  # else two vectors have one node: other digests
            break
    found = None
    for d in dims:
        got = links(rows, nodes.where(F.col("dim") == d["dim"]).select("node"), d["n"], d["dim"], salt, threshold, sample, cells)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return named.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    with _small_batches(rows.sparkSession):
        found = stored(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    # stored before they meet: plain exchanges, so a very large group is split
    groups = components(found.select("a", "b")).withColumnRenamed("component", "group")
    grouped = stored(groups.join(counts, "node").join(nodes.select("node", "first"), "node"), "named-vectors")
    lowest = stored(grouped.groupBy("group").agg(F.min("first").alias("lowest")), "lowest-ids")
    linked = stored(grouped.join(lowest.hint("merge"), "group").select("node", "links", "lowest"), "vector-groups")
    known = stored(nodes.select("node", "n", "first").join(linked, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("lowest", "first").alias("lowest")), "known-vectors")
    lone = F.col("lowest").isNull()
    component = F.when(lone, F.col("vec_id")).when(F.col("lowest") < LAST_ID, F.col("lowest"))
    return named.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
