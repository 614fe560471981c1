"""Ranked lexical search over K2-treaps: compressed quadtrees of the term-document grid whose cells store impact maxima.

The index has a row per shard of at most ``SHARD_DOCS`` documents: its term
dictionary, and over the grid (term row x document column) a quadtree.  Level
by level every cell that is not empty has a four-bit mask of its children and
the largest impact in it (kept as the difference to its parent's); a cell of
one point is not split further and keeps the point's place.  Terms of like
frequency stand together, by their first document, so that rare terms fill a
narrow band of cells and bounds are tight.

An impact is the part of a score that does not depend on the term's weight:
``10^9 * tf div (1000 * tf + 20 * m)``, ``m`` by the document's length.

A search follows, for each document range, the path of every term row of the
item at once: the range's bound is the sum of weight times the maximum of the
cell its row is in.  The ranges with the best bounds are split first, a batch
at a time; at single documents bounds are exact scores, and ranges below the
k-th best score so far are left.  A task keeps its best k of an item from
shard to shard, so later shards start with that threshold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.common import LAST_ID, id_text, per_batch, stored, term_lists

#: Documents of a shard, and bytes of their text (a larger text is a shard of its own); shards of a file.
SHARD_DOCS, SHARD_BYTES, SHARD_FILE = 1024, 4 << 20, 8
#: Items of a search pass, and bytes of their terms (a larger item is a pass of its own).
PASS_ITEMS, PASS_BYTES = 1024, 8 << 20
#: Ranges split at a time, and the longest item (rows in the shard) whose ranges keep their cells; others' are found anew from the root.
SPLIT, KEEP = 256, 2048
INDEX = "docs array<bigint>, terms binary, df binary, levels int, masks binary, falls binary, places binary"
_ONES = np.array([bin(b).count("1") for b in range(16)], np.int64)


# -- index ------------------------------------------------------------------

def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            n = sum(map(len, term_lists(text.as_py())))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of documents with terms, and of all their terms."""
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    r = per_batch(texts, _sizes, "docs bigint, terms bigint").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r.docs or 0, r.terms or 0


def _interleave(row: np.ndarray, col: np.ndarray, levels: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for b in range(levels):
        code |= ((row >> b & 1) << (2 * b + 1)) | ((col >> b & 1) << (2 * b))
    return code


def quadtree(row: np.ndarray, col: np.ndarray, impact: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all cells, root first, each level in cell order: masks (0: one point) and maxima; and the places of the cells of one point."""
    code = _interleave(row, col, levels)
    order = np.argsort(code)
    code, impact = code[order], impact[order]
    masks, maxima, places = [], [impact.max(keepdims=True)], []
    if len(code) == 1:
        masks, places = [np.zeros(1, np.uint8)], [code]
    level = 0
    while len(code) > 1:  # the points of cells with several: their cells one level below
        level += 1
        cell = code >> 2 * (levels - level)
        first = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
        count = np.diff(np.append(first, len(code)))
        up = cell[first] >> 2
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, cell[first] & 3), np.flatnonzero(np.concatenate([[True], np.diff(up) != 0]))))
        maxima.append(np.maximum.reduceat(impact, first))
        # cells of one point have an empty mask; the others' comes with the next level
        places.append(code[first[count == 1]])
        many = np.repeat(count > 1, count)
        code, impact = code[many], impact[many]
        masks[-1] = (masks[-1], count > 1)
    if level:
        spread = [masks[0][0]]
        for (_, several), below in zip(masks, [*masks[1:], (np.empty(0, np.int64), None)]):
            each = np.zeros(len(several), np.int64)
            each[several] = below[0]
            spread.append(each)
        masks = spread
    return np.concatenate(masks).astype(np.uint8), np.concatenate(maxima), np.concatenate(places)


def _shard(held: list[tuple[int | None, bytes]], n_docs: int, n_terms: int) -> dict:
    held.sort(key=lambda d: (d[0] is None, d[0]))
    voc: defaultdict[bytes, int] = defaultdict()
    voc.default_factory = voc.__len__
    keys, counts, n = [], [], np.zeros(len(held), np.int64)
    for k, (_, text) in enumerate(held):
        parts = [np.fromiter(map(voc.__getitem__, ws), np.int64, len(ws)) for ws in term_lists(text)]
        if parts:
            terms, tf = np.unique(np.concatenate(parts), return_counts=True)
            keys.append(terms * len(held) + k)
            counts.append(tf)
            n[k] = tf.sum()
    term, doc = np.divmod(np.concatenate(keys), len(held)) if keys else (np.empty(0, np.int64),) * 2
    tf = np.concatenate(counts) if counts else np.empty(0, np.int64)
    df = np.bincount(term, minlength=len(voc))
    first = np.full(len(voc), len(held), np.int64)
    np.minimum.at(first, term, doc)
    order = np.lexsort((first, -np.floor(np.log2(np.maximum(df, 1)))))
    row = np.empty(len(voc), np.int64)
    row[order] = np.arange(len(voc))
    m = 50 + (50 * n * n_docs) // max(n_terms, 1)
    levels = max(len(held) - 1, len(voc) - 1, 1).bit_length()
    masks, maxima, places = quadtree(row[term], doc, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc]), levels) if keys else (np.empty(0, np.uint8), *(np.empty(0, np.int64),) * 2)
    parent = np.repeat(np.arange(len(masks)), _ONES[masks])  # of every cell but the root
    falls = np.concatenate([maxima[:1], maxima[parent] - maxima[1:]]).astype(np.int32)
    names = list(voc)
    return {"docs": [d[0] for d in held], "terms": b"\n".join(names[t] for t in order), "df": df[order].astype(np.int32).tobytes(),
            "levels": levels, "masks": masks.tobytes(), "falls": falls.tobytes(), "places": np.diff(places, prepend=0).tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """The stored index of all whole texts, and ``corpus_size``.

    Shards are cut where the rows lie: no text is shuffled.
    """
    n_docs, n_terms = corpus_size(docs, text_col)
    kind = pa.schema([("docs", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.binary()), ("levels", pa.int32()), ("masks", pa.binary()), ("falls", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary())):
                text = text.as_py()
                if held and (len(held) == SHARD_DOCS or size + len(text) > SHARD_BYTES):
                    yield pa.RecordBatch.from_pylist([_shard(held, n_docs, n_terms)], kind)
                    held, size = [], 0
                held.append((doc_id.as_py(), text))
                size += len(text)
        if held:
            yield pa.RecordBatch.from_pylist([_shard(held, n_docs, n_terms)], kind)

    return stored(per_batch(id_text(docs, id_col, text_col), run, INDEX), "search-index", SHARD_FILE), n_docs, n_terms


# -- search -----------------------------------------------------------------

class Treap:
    """A shard's quadtree unpacked: masks, first children and maxima of all cells; the last cell stands for an empty one."""

    def __init__(self, docs: list[int | None], levels: int, masks: bytes, falls: bytes, places: bytes):
        self.docs = np.array([LAST_ID if d is None else d for d in docs], np.int64)
        self.levels = levels
        fall = np.frombuffer(falls, np.int32)
        self.mask = np.zeros(len(fall) + 1, np.uint8)
        self.mask[:-1] = np.frombuffer(masks, np.uint8)
        n = _ONES[self.mask]
        self.first = (np.cumsum(n) - n + 1).astype(np.int32)
        parent = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.top = np.append(fall, np.int32(0))
        start, end = 0, min(1, len(fall))
        while end < len(fall):  # the level after the one from start to end
            start, end = end, end + int(n[start:end].sum())
            self.top[start:end] = self.top[parent[start - 1 : end - 1]] - fall[start:end]
        self.place = np.full(len(n), -1, np.int64)
        self.place[:-1][self.mask[:-1] == 0] = np.cumsum(np.frombuffer(places, np.int64))

    def _child(self, cells: np.ndarray, rows: np.ndarray, level: np.ndarray, half: np.ndarray | int) -> np.ndarray:
        """The cells one level below that hold ``rows`` and the left or right half of each range."""
        left = self.levels - 1 - level[:, None]
        quad = (rows[None, :] >> left & 1) * 2 + half
        mask = self.mask[cells]
        # a cell of one point stays what it is as long as the point lies there
        same = (mask == 0) & (self.place[cells] >> 2 * left & 3 == quad) & (cells < len(self.top) - 1)
        return np.where(mask >> quad & 1, self.first[cells] + _ONES[mask & ((1 << quad) - 1)], np.where(same, cells, len(self.top) - 1))

    def _from_root(self, rows: np.ndarray, level: np.ndarray, col: np.ndarray) -> np.ndarray:
        cells = np.zeros((len(level), len(rows)), np.int64)
        for lv in range(int(level.max())):
            below = np.flatnonzero(level > lv)
            half = col[below] >> (level[below] - 1 - lv) & 1
            cells[below] = self._child(cells[below], rows, np.full(len(below), lv), half[:, None])
        return cells

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` documents (columns; ties by column) that score ``least`` or more, and their scores."""
        keep = len(rows) if len(rows) <= KEEP else 0
        split = max(1, min(SPLIT, SPLIT * KEEP // len(rows)))
        # the ranges still to split: their level and number in it, their bound, the cells of the item's rows
        level, col, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([int(weights.sum()) * int(self.top[0])])
        cells = np.zeros((1, keep), np.int64)
        found_col, found = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(bound):
            chosen = np.argpartition(-bound, split - 1)[:split] if len(bound) > split else np.arange(len(bound))
            lv, at = level[chosen], col[chosen]
            c = cells[chosen] if keep else self._from_root(rows, lv, at)
            rest = bound >= least
            rest[chosen] = False
            new = [[x[rest] for x in (level, col, bound, cells)]]
            for half in (0, 1):
                child = self._child(c, rows, lv, half)
                score = (weights * self.top[child]).sum(axis=1)
                good = score >= least
                last = good & (lv + 1 == self.levels)
                found_col, found = np.concatenate([found_col, (at * 2 + half)[last]]), np.concatenate([found, score[last]])
                good &= ~last
                new.append([lv[good] + 1, (at * 2 + half)[good], score[good], child[good, :keep]])
            level, col, bound, cells = (np.concatenate(x) for x in zip(*new))
            if len(found) >= k:
                top = np.lexsort((found_col, -found))[:k]
                found_col, found = found_col[top], found[top]
                least = max(least, int(found[-1]))
        top = np.lexsort((found_col, -found))
        return found_col[top], found[top]


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """``(item, item_id, terms)`` of the items, so many as one pass takes."""
    held, size = [], 0
    for r in items.toLocalIterator():
        terms = sorted({w for ws in term_lists(r.text.encode()) for w in ws})
        weight = sum(map(len, terms)) + 64 * len(terms)
        if held and (len(held) == PASS_ITEMS or size + weight > PASS_BYTES):
            yield held
            held, size = [], 0
        held.append((r.item, r.item_id, terms))
        size += weight
    if held:
        yield held


def _frequencies(wanted) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        n: defaultdict[bytes, int] = defaultdict(int)
        for batch in batches:
            for names, df in zip(batch.column("terms"), batch.column("df")):
                for w, d in zip(names.as_py().split(b"\n"), np.frombuffer(df.as_py(), np.int32).tolist()):
                    if w in terms:
                        n[w] += d
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["term", "df"])

    return run


def _search(sent, k: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for batch in batches:
            for s in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                row_of = {w: i for i, w in enumerate(s["terms"].split(b"\n"))}
                treap = Treap(s["docs"], s["levels"], s["masks"], s["falls"], s["places"])
                if len(treap.top) == 1:
                    continue  # no terms in this shard
                for j, (_, terms) in enumerate(items):
                    known = [(row_of[t], w) for t, w in terms if t in row_of]
                    if not known:
                        continue
                    rows, weights = np.array(known, np.int64).T
                    ids, scores = best[j]
                    least = int(scores[-1]) if len(scores) == k else 1
                    col, score = treap.best(rows, weights, k, least)
                    ids, scores = np.concatenate([ids, treap.docs[col]]), np.concatenate([scores, score])
                    keep = np.lexsort((ids, -scores))[:k]
                    best[j] = ids[keep], scores[keep]
        n = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([i for i, _ in items], n), pa.int64()), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))],
            names=["item", "doc", "score"])

    return run


def _first(rows: DataFrame, k: int, *by: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank int, doc_id, score`` of the ``k`` best documents of every item that score above 0.

    Equal scores rank by ascending id (null last).  Repeated documents and
    items are rows of their own; a null text has no terms; an item without a
    match, or an empty index, gives no rows.  Items go through the index in
    passes of a bounded size.
    """
    spark = index.sparkSession
    numbered = stored(items.select(items[id_col].alias("item_id"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text"))
                      .withColumn("item", F.monotonically_increasing_id()), "search-items")
    kind = "item bigint, doc bigint, score bigint"
    parts = []
    for held in _passes(numbered):
        wanted = spark.sparkContext.broadcast({t for _, _, terms in held for t in terms})  # at most a pass's terms
        found = per_batch(index.select("terms", "df"), _frequencies(wanted), "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        df = {bytes(r.term): r.df for r in found.collect()}
        weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * d + 1)))) for t, d in df.items()}
        sent = spark.sparkContext.broadcast([(item, [(t, weight[t]) for t in terms if weight.get(t, 0) > 0]) for item, _, terms in held])
        parts.append(stored(per_batch(index, _search(sent, k), kind), "search-found"))
    found = spark.createDataFrame([], kind)
    for p in parts:
        found = found.unionByName(p)
    # a task gives k rows an item at most; thousands of tasks' rows are thinned in groups first
    some = _first(found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64))), k, "item", "part").select("item", "doc", "score")
    ranked = _first(some, k, "item")
    return ranked.join(numbered.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "score")
