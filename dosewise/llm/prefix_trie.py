"""Conversation prefix trie: ternary search trees over dictionary-encoded turns, one per range shard.

Distinct turns (role and text) get numbers; a conversation is then a row with
the numbers of its turns.  Rows are range-partitioned in the order of these
sequences and of the conversations' ids, so equal conversations may fill many
shards, and a prefix's conversations lie side by side.  A shard inserts its
distinct sequences into a ternary search tree, the median first and then the
medians of the halves, which keeps the trees of siblings balanced; a node of
the tree is a node of the trie.  An iterative traversal adds up members,
leaves and savings from the deepest nodes upwards.

Only prefixes of a shard's first or last sequence can also lie in other
shards.  These boundary nodes, at most twice the longest conversation a shard,
are merged by Spark: members and children are summed by node, each node's own
share of leaves and savings is counted by the first shard that has it, suffix
sums along a shard's two paths give its part of every subtree, and the parts
are summed by node.  Lists of ids for a digest travel in order in small pieces
and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.common import per_batch, stored

#: Most turns taken over from a group's first conversation, and ids a group spans.
SHARED, GROUP = 5, 100
#: Bytes of a piece of an id list.
PIECE = 1 << 14
NODE = ("shard int, key binary, branch int, depth bigint, conv_id bigint, parent_key binary, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, chars bigint, ends_sha256 string, ends array<string>")
_KIND = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("branch", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_key", pa.binary()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("chars", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.string()))])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# -- conversations as sequences ---------------------------------------------

def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<id, chars>>`` of every conversation, in order of turn (null first).

    ``id`` numbers the distinct (role, text); nulls in them are empty.  Rows of
    one turn number stand in the order of their content's SHA-256.  Rows
    without ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"),
                        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
                        F.char_length(text).cast("bigint").alias("chars")).where("conv_id IS NOT NULL")
    rows = stored(rows, "turns")
    numbers = stored(rows.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-numbers")
    # both sides stored: plain exchanges, so a turn that very many conversations have is split
    coded = rows.join(numbers.hint("merge"), "digest")
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "chars"))).alias("turns"))  # one conversation's turns
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its group of ``GROUP`` ids."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED).alias("head"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    joined = own.join(heads.hint("merge"), "base", "left")  # a base has at most GROUP * 2 - 1 conversations
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<id: bigint, chars: bigint>>")), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


# -- a shard ----------------------------------------------------------------

class TernaryTree:
    """A ternary search tree in parallel lists; node 0 is the textless root, and nodes linked by ``lo`` and ``hi`` are siblings."""

    def __init__(self) -> None:
        self.turn, self.lo, self.hi, self.eq = [-1], [0], [0], [0]
        self.parent, self.depth, self.chars = [-1], [0], [0]
        self.count, self.least = [0], [None]

    def insert(self, seq: np.ndarray, chars: np.ndarray, n: int, least: int) -> int:
        """Pass ``n`` members along ``seq``; the node where they end."""
        node = 0
        self._pass(0, n, least)
        for turn, size in zip(seq.tolist(), chars.tolist()):
            at, link, holder = self.eq[node], self.eq, node
            while at and self.turn[at] != turn:
                link, holder = (self.lo if turn < self.turn[at] else self.hi), at
                at = link[at]
            if not at:
                at = link[holder] = len(self.turn)
                for values, v in ((self.turn, turn), (self.lo, 0), (self.hi, 0), (self.eq, 0), (self.parent, node), (self.depth, self.depth[node] + 1),
                                  (self.chars, size), (self.count, 0), (self.least, None)):
                    values.append(v)
            node = at
            self._pass(node, n, least)
        return node

    def _pass(self, node: int, n: int, least: int) -> None:
        self.count[node] += n
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def upwards(self) -> list[int]:
        """All nodes, children before their parents."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [x for x in (self.lo[node], self.hi[node], self.eq[node]) if x]
        return order[::-1]


def _medians(n: int) -> Iterator[int]:
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (a + b) // 2
            stack += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def _pieces(ids: np.ndarray) -> list[str]:
    """The ids as text, comma-joined in pieces of about ``PIECE`` bytes."""
    step = PIECE // 16
    return [",".join(map(str, ids[k : k + step].tolist())) for k in range(0, len(ids), step)]


def _sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(_pieces(ids)).encode()).hexdigest()


def shard_nodes(shard: int, seqs: list[np.ndarray], chars: list[np.ndarray], ids: np.ndarray) -> list[dict]:
    """Nodes of the trie of a shard's sequences, given in order, ids ascending among equal ones.

    A boundary node (with a ``key``) has ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the children that are not boundary nodes only.
    """
    new = [k for k in range(len(seqs)) if not k or not np.array_equal(seqs[k], seqs[k - 1])]
    stop = [*new[1:], len(seqs)]
    tree, ends, path = TernaryTree(), {}, {}
    for j in _medians(len(new)):
        a, b = new[j], stop[j]
        node = tree.insert(seqs[a], chars[a], b - a, int(ids[a:b].min()))
        ends[node] = ids[a:b]
        if j in (0, len(new) - 1):
            path[j] = node
    # boundary nodes: the paths of the first and of the last sequence
    key, branch = {0: b""}, {}
    for side, j in ((1, 0), (2, len(new) - 1)):
        at, trail = path[j], []
        while at >= 0:
            trail.append(at)
            at = tree.parent[at]
        for node in reversed(trail):
            if node not in key:
                key[node] = hashlib.md5(key[tree.parent[node]] + tree.turn[node].to_bytes(8, "little", signed=True)).digest()
            branch[node] = 0 if node in branch else side
    if len(new) == 1:
        branch = dict.fromkeys(branch, 0)
    size = len(tree.turn)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in tree.upwards():
        if node in key:
            continue
        leaves[node] = leaves[node] or 1
        saved[node] += (tree.count[node] - 1) * tree.chars[node]
        up = tree.parent[node]
        children[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    none = np.empty(0, np.int64)
    rows = []
    for node in range(size):
        edge, up = node in key, tree.parent[node]
        inner = up >= 0 and up not in key
        rows.append({
            "shard": shard, "key": key.get(node), "branch": branch.get(node), "depth": tree.depth[node], "conv_id": tree.least[node],
            "parent_key": None if inner or up < 0 else key[up], "parent_conv_id": tree.least[up] if inner else None, "n_convs": tree.count[node],
            "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node], "chars": tree.chars[node],
            "ends_sha256": None if edge else _sha256(ends.get(node, none)), "ends": _pieces(ends[node]) if edge and node in ends else None})
    return rows


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, seqs, chars, ids = 0, [], [], []
    for batch in batches:
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        for name, held in (("seq", seqs), ("chars", chars)):
            held += [np.asarray(x.values) for x in batch.column(name)]
        ids.append(batch.column("conv_id").to_numpy())
    if seqs:
        rows = shard_nodes(shard, seqs, chars, np.concatenate(ids))
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[k : k + 4096], _KIND)


# -- merging ----------------------------------------------------------------

def _stream_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of rows sorted by key; pieces are joined by commas."""
    key, state, kind = None, None, ["key", "ends_sha256"]
    for batch in batches:
        done_keys, done = [], []
        for k, piece in zip(batch.column("key"), batch.column("piece")):
            k = k.as_py()
            if state is not None and k != key:
                done_keys.append(key)
                done.append(state.hexdigest())
                state = None
            if state is None:
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(done_keys, pa.binary()), pa.array(done, pa.string())], names=kind)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=kind)


def _merged(edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The boundary nodes, whole; and each shard's ``(shard, key)`` with the node's smallest member."""
    whole = edge.groupBy("key").agg(
        F.min("shard").alias("owner"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.max("chars").alias("chars"))
    whole = stored(whole, "boundary-nodes")
    kids = whole.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    whole = whole.join(kids, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("kids", F.lit(0)))
    whole = stored(whole.select("key", "owner", "depth", "parent_key", "conv_id", "n_convs", "n_children", "chars"), "boundary-nodes")
    mine = F.col("owner") == F.col("shard")
    parts = edge.select("shard", "key", "branch", "n_leaves", "saved_tokens").join(
        whole.select("key", "owner", "depth", F.col("conv_id").alias("least"), "n_convs", "n_children", "chars"), "key")
    parts = parts.select("shard", "key", "branch", "depth", "least",
                         (F.col("n_leaves") + F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).alias("leaves"),
                         (F.col("saved_tokens") + F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).alias("saved"))
    # below a node: the rest of its branch, and below the trunk both branches; a shard has at most two paths
    down = Window.partitionBy("shard", "branch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    shard = Window.partitionBy("shard")
    below = lambda c: F.sum(c).over(down) + F.when(F.col("branch") == 0, F.sum(F.when(F.col("branch") > 0, F.col(c)).otherwise(0)).over(shard)).otherwise(0)
    parts = stored(parts.select("shard", "key", "least", below("leaves").alias("leaves"), below("saved").alias("saved")), "boundary-parts")
    sums = parts.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    pieces = edge.select("key", "shard", F.posexplode("ends").alias("at", "piece")).repartition("key").sortWithinPartitions("key", "shard", "at")
    digests = per_batch(pieces.select("key", "piece"), _stream_sha, "key binary, ends_sha256 string")
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (whole.join(sums, "key").join(digests, "key", "left").join(up, "parent_key", "left")
             .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    return nodes.select(*RESULT), parts.select("shard", F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id"))


def trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations (``conv_id`` unique, ``turns array<struct<id, chars>>``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of the
    ids that end at the node.  A conversation without turns is a member of the
    root alone.  Without conversations there are no nodes.
    """
    rows = stored(convs.select("conv_id", F.col("turns.id").alias("seq"), F.col("turns.chars").alias("chars")), "sequences")
    dealt = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("shard", F.spark_partition_id())
    nodes = stored(per_batch(dealt, _shards, NODE), "trie-nodes")
    edges, of_shard = _merged(nodes.where("key IS NOT NULL"))
    inner = nodes.where("key IS NULL")
    top = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(of_shard, ["shard", "parent_key"])
    return inner.where("parent_key IS NULL").select(*RESULT).unionByName(top.select(*RESULT)).unionByName(edges)
