"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window of ``WINDOW`` words repeats if its word sequence also starts in a
document with a smaller id; the words that repeated windows cover are merged
into maximal intervals and removed.

Every window is hashed, but windows travel as *runs*.  The word 8-grams of a
window are hashed too, and the smallest of them is its anchor: equal windows
have equal anchors in the same place.  The neighbouring windows that share an
anchor occurrence are one run, sent as one row: its anchor, a hash of all its
window hashes, and its length (about one row for 22 words).  Then

* an anchor that no second document has settles all its windows: not repeated;
* runs that are equal as a whole settle theirs: the owner of all their windows
  is the smallest id that has the run;
* only where different runs share an anchor (where copies begin, end or
  differ) are windows looked at one by one, once per distinct run, by the pair
  of anchor and window hash (128 bits together).

All counting is by hash aggregation with map-side sums, so a passage that a
third of all documents hold costs a row per task, not per document.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dosewise.llm.common import LAST_ID, per_batch, stored

WINDOW = 50
GRAM = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PIECE = 1 << 15


@functools.lru_cache(4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE)
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64, of hashed tokens) of every window of ``n`` tokens, from running sums."""
    if len(tokens) < n:
        return np.empty(0, np.uint64)
    size = 1 << (len(tokens)).bit_length()
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _powers(size, False)[: len(tokens)], out=sums[1:])
    return _mix((sums[n:] - sums[:-n]) * _powers(size, True)[: len(tokens) - n + 1])


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def runs(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """``start, length, anchor, run hash`` of the runs of a text, and the hashes of all its windows."""
    tokens = token_hashes(words)
    windows = rolling(tokens, window)
    if not len(windows):
        none = np.empty(0, np.int64)
        return none, none, none, none, windows
    grams = rolling(tokens, GRAM)
    wide = window - GRAM + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, wide)
    place = np.concatenate([views[k : k + _PIECE].argmin(axis=1) for k in range(0, len(views), _PIECE)])
    anchor_at = place + np.arange(len(windows))
    start = np.flatnonzero(np.concatenate([[True], np.diff(anchor_at) != 0]))
    length = np.diff(np.append(start, len(windows)))
    # the run's hash also tells where its anchor stands, and so which windows it is made of
    salted = _mix(windows * np.uint64(3) + place.astype(np.uint64))
    whole = _mix(np.add.reduceat(salted, start) + length.astype(np.uint64))
    return start, length, grams[anchor_at[start]].view(np.int64), whole.view(np.int64), windows


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ord`` (order key), ``row`` (hash of id and text: rows that agree in both are alike throughout), ``text``."""
    doc_id = docs[id_col].cast("bigint")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("ord"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))


def _runs_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [runs(t.as_py().encode().split(), window)[:4] for t in part.column("text")]
                n = [len(f[0]) for f in found]
                rows = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in ("ord", "row")]
                start, length, anchor, whole = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pa.RecordBatch.from_arrays([*rows, pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(anchor), pa.array(whole)], names=["ord", "row", "start", "length", "anchor", "run"])

    return run


def _windows_of(window: int):
    """Hashes of the windows of the runs that start at the places given for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                anchors, wholes, hashes = [], [], []
                for text, places in zip(part.column("text"), part.column("starts").to_pylist()):
                    start, length, anchor, whole, windows = runs(text.as_py().encode().split(), window)
                    for k in np.searchsorted(start, sorted(places)):
                        anchors.append(anchor[k])
                        wholes.append(whole[k])
                        hashes.append(windows[start[k] : start[k] + length[k]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(wholes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["anchor", "run", "windows"])

    return run


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _passages(text: bytes, gone: np.ndarray) -> bytes:
    """The passages of a text that stay, as they stand, one on a line."""
    at = [m.span() for m in _WORDS.finditer(text)]
    turn = np.flatnonzero(np.diff(np.concatenate([[0], ~gone, [0]]).astype(np.int8))).tolist()
    return b"\n".join(text[at[a][0] : at[b - 1][1]] for a, b in zip(turn[::2], turn[1::2]))


def _cut(window: int, as_is: bool):
    """Remove what the repeated windows cover; give the rest and the removed intervals of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                kept, n_words, n_removed, spans = [], [], [], []
                for text, marks in zip(part.column("text"), part.column("marks").to_pylist()):
                    words = text.as_py().encode().split()
                    n_words.append(len(words))
                    if not marks:
                        n_removed.append(0)
                        spans.append([])
                        kept.append(text.as_py() if as_is else b" ".join(words).decode())
                        continue
                    edge = np.zeros(len(words) + window + 64, np.int64)
                    for m in marks:
                        starts = m["start"] + np.flatnonzero(np.frombuffer(int(m["bits"]).to_bytes(8, "little", signed=True), np.uint8)[:, None] >> np.arange(8) & 1)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"from": int(a), "to": int(b)} for a, b in zip(turn[::2], turn[1::2])])
                    n_removed.append(int(gone.sum()))
                    rest = _passages(text.as_py().encode(), gone) if as_is else b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    kept.append(rest.decode())
                span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                names = [c for c in part.schema.names if c not in ("text", "marks")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span)],
                    names=[*names, "kept_text", "n_words", "n_removed", "removed"])

    return run


def repeated_runs(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, start, bits``: for every run with repeated windows, the window ``start + i`` is repeated if bit ``i`` is set.

    ``texts`` is what ``_texts`` makes.
    """
    if not GRAM < window <= 63 + GRAM:
        raise ValueError("a run's windows must fit the bits of a long")
    found = stored(per_batch(texts.select("ord", "row", "text"), _runs_of(window), "ord bigint, row bigint, start int, length int, anchor bigint, run bigint"), "runs")
    # what a join meets is stored first: then both its sides are plain exchanges, and a hot anchor's rows are split
    shared = stored(found.groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("anchor"), "shared-anchors")
    found = stored(found.join(shared, "anchor", "left_semi"), "shared-runs")
    # the distinct runs of each shared anchor
    kinds = stored(found.groupBy("anchor", "run").agg(F.min("ord").alias("owner"), F.max("length").alias("length")), "run-kinds")
    mixed = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "mixed-anchors")
    mixed_kinds = stored(kinds.join(mixed, "anchor", "left_semi"), "mixed-kinds")
    # one row of the owner stands for the run; its windows come from its text
    at = found.join(mixed_kinds.select("anchor", "run", F.col("owner").alias("ord")), ["anchor", "run", "ord"]).groupBy("anchor", "run").agg(F.min("row").alias("row"))
    spot = at.join(found.select("anchor", "run", "row", "start"), ["anchor", "run", "row"]).groupBy("anchor", "run", "row").agg(F.min("start").alias("start"))
    asked = stored(spot.groupBy("row").agg(F.collect_set("start").alias("starts")), "asked-runs")  # at most a text's own runs
    # merged here and in remove_repeats: the same plan, and so the same needs, at every size
    once = texts.select("row", "text").join(asked.hint("merge"), "row")
    windows = per_batch(once.select("text", "starts"), _windows_of(window), "anchor bigint, run bigint, windows array<bigint>").dropDuplicates(["anchor", "run"])
    windows = stored(windows.join(mixed_kinds.select("anchor", "run", "owner"), ["anchor", "run"]), "run-windows")
    each = windows.select("anchor", "run", "owner", F.posexplode("windows").alias("i", "hash"))
    first = each.groupBy("anchor", "hash").agg(F.min("owner").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "hash", "first")
    first = stored(first, "window-owners")
    # a run's windows that some other run has too, each with the smallest id that has it
    owners = each.join(first, ["anchor", "hash"]).where("first < owner")
    early = stored(owners.groupBy("anchor", "run").agg(F.map_from_entries(F.collect_list(F.struct("i", "first"))).alias("firsts")), "run-owners")
    # the runs' verdicts are put together first, so that their many occurrences meet one stored side
    verdicts = stored(kinds.select("anchor", "run", "owner").join(early, ["anchor", "run"], "left"), "run-verdicts")
    full = found.join(verdicts.hint("merge"), ["anchor", "run"])
    first_of = lambda i: F.coalesce(F.try_element_at("firsts", i), F.col("owner"))
    bits = F.aggregate(F.sequence(F.lit(0), F.col("length") - 1), F.lit(0).cast("bigint"),
                       lambda acc, i: F.when(first_of(i) < F.col("ord"), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(acc))
    whole = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 64 - F.col("length"))
    repeated = F.when(F.col("firsts").isNull(), F.when(F.col("owner") < F.col("ord"), whole).otherwise(0)).otherwise(bits)
    return full.select("row", "start", repeated.alias("bits")).where("bits <> 0")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                   as_is: bool = False) -> DataFrame:
    """``doc_id``, the columns ``carry``, ``kept_text`` (kept words, one space between), ``n_words, n_removed``
    and ``removed`` (maximal intervals of words, ``from`` up to ``to``) of every document.

    Words are runs of other than ASCII white space, compared as they are.  A
    null text is empty.  With ``as_is``, kept text is not split into words: a
    text without repeats stays as it is, and of others the passages that stay
    do, one on a line.  Documents of one id do not remove each other's words;
    repeated rows repeat; a null id is larger than any other.
    """
    carry = carry or []
    texts = _texts(docs, id_col, text_col)
    marks = stored(repeated_runs(texts, window).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "bits")).alias("marks")), "marks")  # at most a text's own runs
    rows = texts if not carry else docs.select(F.xxhash64(docs[id_col].cast("bigint"), F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("row"),
                                               docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in carry))
    joined = rows.join(marks.hint("merge"), "row", "left").select("doc_id", *carry, "text", "marks")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in ["doc_id", *carry]), "kept_text string, n_words bigint, n_removed bigint, removed array<struct<`from`: int, `to`: int>>"])
    return per_batch(joined, _cut(window, as_is), schema)
