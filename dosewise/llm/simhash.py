"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

A 64-bit fingerprint is cut into ``BLOCKS`` or more blocks.  Fingerprints that differ
in at most ``d`` bits agree in at least ``BLOCKS - d`` of them, so they meet
under one of the combinations of that many blocks; all that meet under a
combination are compared and none else.

Equal fingerprints are one node from the start.  A key's rows are split into
chunks of ``CHUNK`` and every pair of chunks is a unit of its own, so a key
that very many fingerprints share becomes many units of bounded size; a unit
gives back no pairs but the star edges that connect the same fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dosewise.llm.common import LAST_ID, per_batch, stored
from dosewise.llm.components import components, forest

#: Blocks of a fingerprint for few and for ever more fingerprints; keys that so many share on average ask for one more.
BLOCKS, MOST_BLOCKS, SHARED = 6, 12, 64
CHUNK = 512
SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles, repeats included."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):  # bounded memory for long texts
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, fp bigint`` (the fingerprint's bits) of every whole text, and the bigint columns ``carry``."""
    carry = carry or []
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *(batch.column(c) for c in carry)], names=["doc_id", "fp", *carry])

    return per_batch(rows, run, ", ".join(["doc_id bigint, fp bigint", *(f"{c} bigint" for c in carry)]))


def _block_masks(blocks: int) -> list[int]:
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _compare(max_bits: int):
    """Star edges of the fingerprints that link within each unit; rows come sorted by unit."""

    def links(table: pa.Table) -> pa.RecordBatch:
        fp = table.column("fp").to_numpy().view(np.uint64)
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        unit = np.cumsum(np.concatenate([[0], np.any([np.diff(table.column(c).to_numpy()) != 0 for c in ("key", "combo", "i", "j")], axis=0)])) if len(fp) else fp
        a, b = [], []
        at = np.arange(len(fp) - 1)
        step = 1
        while len(at):
            at = at[at + step < len(fp)]
            at = at[unit[at] == unit[at + step]]
            # within one chunk all pairs, between two chunks only those across
            hit = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits) & ((side[at] == 2) | (side[at] != side[at + step]))]
            a.append(node[hit])
            b.append(node[hit + step])
            step += 1
        x, y = forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            last = [rows.column(c)[-1].as_py() for c in ("key", "combo", "i", "j")]
            tail = np.all([rows.column(c).to_numpy() == v for c, v in zip(("key", "combo", "i", "j"), last)], axis=0)
            cut = int(np.argmax(tail))  # the last unit may go on in the next batch
            if cut:
                yield links(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def block_count(n: int, max_bits: int) -> int:
    """The fewest blocks (above ``max_bits + 1``) whose keys at most ``SHARED`` of ``n`` evenly spread fingerprints share."""
    fits = (b for b in range(max(BLOCKS, max_bits + 1), MOST_BLOCKS) if n >> 64 * (b - max_bits) // b <= SHARED)
    return next(fits, max(MOST_BLOCKS, max_bits + 1))


def links(nodes: DataFrame, max_bits: int, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` that connect exactly what links at ``max_bits`` or fewer connect.

    ``nodes`` has ``node bigint, fp bigint`` with distinct fingerprints.  More
    ``blocks`` make longer keys (fewer chance meetings) and more combinations;
    any number above ``max_bits`` finds every link.
    """
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    masks = [_signed(sum(m)) for m in combinations(_block_masks(blocks), blocks - max_bits)]
    keyed = nodes.select("node", "fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))).alias("x")).select("node", "fp", "x.*")
    counts = keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    # stored and merged: both sides are plain exchanges, so a crowded key's rows are split; and the planner
    # takes the exploded side for as small as the file it comes from
    counts = stored(counts.select("combo", "key", "chunks"), "crowded-keys")
    met = keyed.join(counts.hint("merge"), ["combo", "key"])
    mine = F.pmod(F.xxhash64("fp", "combo"), F.col("chunks")).cast("int")
    # a row goes to the units of its chunk with every chunk of its key; side 2: the chunk with itself
    units = (met.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("combo", "key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "node", "fp",
                     F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1).alias("side")))
    dealt = units.repartition("combo", "key", "i", "j").sortWithinPartitions("combo", "key", "i", "j")
    return per_batch(dealt, _compare(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc_id, fp bigint, component_id, group`` of every document, and its bigint columns ``carry``.

    ``component_id`` is the smallest id reachable over links, the document's
    own included.  Texts without words have fingerprint zero and link like any
    other; a text shorter than a shingle counts as one shingle.  A null id is
    larger than any other and is a component's id only where it has no other;
    repeated rows repeat.  ``group`` is the component's smallest fingerprint.
    An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col, carry), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("first")), "fingerprint-nodes")
    # fingerprints are the graph's nodes: ids may repeat, fingerprints here do not
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), max_bits, blocks or block_count(nodes.count(), max_bits)))
    # both stored before they meet: plain exchanges, so a very large group is split
    named = stored(nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group")), "named-fingerprints")
    lowest = stored(named.groupBy("group").agg(F.min("first").alias("lowest")), "lowest-ids")
    members = stored(named.join(lowest.hint("merge"), "group").select("fp", "group", "lowest"), "fingerprint-groups")
    return prints.join(members, "fp").select("doc_id", "fp", *(carry or []), F.when(F.col("lowest") < LAST_ID, F.col("lowest")).alias("component_id"), "group")


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id`` and ``text``) that stay: one of every group, in all its columns.

    It is the row with the group's smallest id; among rows of one id the text's
    hash decides, and of repeated rows one stays.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = near_duplicates(docs.select("doc_id", "text", key.alias("key")), shingle, max_bits, carry=["key"])
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    ids = stored(rows.groupBy("group", order.alias("o"), "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "near-duplicates")
    lowest = ids.groupBy("group").agg(F.min("o").alias("o"))
    first = ids.join(lowest, ["group", "o"]).groupBy("group", "o").agg(F.min("key").alias("first"))
    stays = F.coalesce((F.col("first.o") == F.col("ids.o")) & (F.col("first.first") == F.col("ids.key")), F.lit(False))
    marked = stored(ids.alias("ids").join(first.alias("first"), "group").select("doc_id", "key", stays.alias("stays"), "n").where("not stays or n > 1"), "near-duplicates")
    hashed = docs.withColumn("_key", key).alias("d")

    def matched(what: DataFrame, how: str) -> DataFrame:
        w = what.select("doc_id", "key").alias("w")
        return hashed.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._key") == F.col("w.key")), how)

    once = matched(marked, "left_anti")
    repeated = marked.where("stays")
    if not repeated.isEmpty():
        once = once.unionByName(matched(repeated, "left_semi").dropDuplicates(["doc_id", "_key"]))
    return once.drop("_key")
