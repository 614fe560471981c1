"""WARC archives: written and read by Spark, records verified by their boundary chain.

Writing: one record per page, in as many archive files as there are tasks.  A
record ends in two line ends, which is the separator Spark's text writer puts
after every row, so its files are WARC files wherever the output folder is.
Of pages with equal payloads one is stored, the others refer to it.

Reading: Spark's text source splits any archive at the magic that opens a
record, into *pieces*, which are numbered in their split and stored; but a
payload may hold that magic too, even whole records.  So each split's task reads from every piece where the record that
would start there ends (its successor), and follows successors inside the
split.  What leads from split to split is one edge for each place that a chain
enters; pointer jumping over these edges from every file's start finds the
entries that are reached, in a number of rounds that grows with the logarithm
of a file's splits.  Only pieces on the chain start records; the others are
given back to the payload that holds them, or are dropped if no record does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.llm.common import LAST_ID, per_batch, stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: A content length as a header line of its own.
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,15})[ \t]*\r?$")
_HEX32, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five bytes are eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX32, _B32)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for every row; the payload is the page's text in UTF-8 (null: empty).

    Of equal payloads of at least ``min_revisit_bytes`` the one with the
    smallest id is a ``response`` (all its rows, where an id repeats); the
    others are ``revisit`` records without a payload.  A null id is larger than
    any other.  Line ends in a URL become spaces; a null URL is empty.
    """
    def lean(df: DataFrame, *more: Column) -> DataFrame:
        body = F.coalesce(df[payload_col].cast("string"), F.lit("")).cast("binary")
        return df.select(df[id_col].cast("bigint").alias("id"), base32_sha1(body).alias("digest"), F.octet_length(body).cast("bigint").alias("n"), *more)

    order = F.coalesce("id", F.lit(LAST_ID))
    known = stored(lean(pages), "page-digests")
    groups = (known.where(F.col("n") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "first"))
    # its real size lets the planner broadcast it where it is small, and shuffle where it is not
    again = stored(known.join(groups, "digest").where(order != F.col("first")).select("id", "digest", "first").distinct(), "revisits")
    text = F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("body")
    url = F.translate(F.coalesce(pages[url_col].cast("string"), F.lit("")), "\r\n", "  ").alias("url")
    rows = lean(pages, url, text).alias("p").join(again.alias("a"), F.col("p.id").eqNullSafe(F.col("a.id")) & (F.col("p.digest") == F.col("a.digest")), "left")
    revisit = F.col("a.first").isNotNull()
    page = F.coalesce(F.col("p.id").cast("string"), F.lit("none"))
    line = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("\r\n"))
    record = F.concat(
        line(MAGIC[:-2]),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", page, ">"),
        line("WARC-Target-URI: ", F.col("url")),
        line("WARC-Date: 2000-01-01T00:00:00Z"),
        F.when(revisit, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        F.when(revisit, line("WARC-Refers-To: <urn:page:", F.col("a.first").cast("string"), ">")).otherwise(""),
        line("WARC-Payload-Digest: sha1:", F.col("p.digest")),
        line("X-Payload-Length: ", F.col("n").cast("string")),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.when(revisit, "0").otherwise(F.col("n").cast("string"))),
        line(),
        F.when(revisit, "").otherwise(F.col("body")))
    rows.select(record.alias("record")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, piece binary``: the bytes between magics, in file order within a split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece")))


def _extent(piece: bytes) -> int:
    """Bytes from a record's content to its successor's content as its header says; -1 if it is no record."""
    end = piece.find(b"\r\n\r\n")
    said = _LENGTH.search(piece[:end]) if end >= 0 else None
    return end + 4 + int(said[1]) + len(END) + len(MAGIC) if said else -1


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces with their number in the split, their bytes with the magic, and the extent of the record that would start there."""
    here, k = None, 0
    for batch in batches:
        ks, sizes, extents = [], [], []
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece"))):
            here, k = ((file, block), 0) if (file, block) != here else (here, k + 1)
            ks.append(k)
            sizes.append(len(piece) + len(MAGIC))
            extents.append(-1 if block == 0 and k == 0 else _extent(piece))  # what stands before a file's first magic is no record
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ks, pa.int32()), pa.array(sizes, pa.int64()), pa.array(extents, pa.int64())], names=[*batch.schema.names, "k", "size", "extent"])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: where its pieces start, where their records end, and where the chain from each leaves the split."""
    for batch in batches:
        for r in batch.to_pylist():
            starts = np.cumsum([0, *r["sizes"]])
            extents = np.array(r["extents"])
            ends = np.where(extents < 0, -1, starts[:-1] + extents)
            place = {s: i for i, s in enumerate(starts[:-1].tolist())}
            leaves = [-1] * len(extents)
            for i in range(len(extents) - 1, -1, -1):
                e = int(ends[i])
                leaves[i] = e if e >= starts[-1] else leaves[place[e]] if e in place else -1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([starts[:-1].tolist()], pa.list_(pa.int64())),
                 pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([leaves], pa.list_(pa.int64()))],
                names=["file", "block", "size", "starts", "ends", "leaves"])


_STRAY = "array<struct<k: int, at: bigint, owner: bigint>>"


def _stray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: its pieces that are not just one record of the chain, and the last record that starts in it."""
    kind = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int64()), ("owner", pa.int64())]))
    for batch in batches:
        for r in batch.to_pylist():
            base, starts, ends = r["base"], r["starts"], r["ends"]
            place = {s: i for i, s in enumerate(starts)}
            nexts = [*starts[1:], r["size"]]
            chain, i = [], place.get(-1 if r["entry"] is None else r["entry"] - base)
            while i is not None:
                chain.append(i)
                i = place.get(ends[i]) if ends[i] > starts[i] else None
            owner, out, on = None, [], set(chain)
            for k in range(len(starts)):
                if k in on:
                    owner = k
                if k not in on or ends[k] != nexts[k]:
                    inside = owner is not None and starts[k] < ends[owner]
                    out.append({"k": k, "at": base + starts[k], "owner": base + starts[owner] if inside else -1 if owner is not None else None})
            last = chain[-1] if chain else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([out], kind), pa.array([None if last is None else base + starts[last]], pa.int64()),
                 pa.array([None if last is None else base + ends[last]], pa.int64())],
                names=["file", "block", "stray", "last_at", "last_end"])


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``file, at`` of the places reached from ``starts`` over ``edges`` (``file, at, to``; one edge a place), by pointer jumping."""
    seen, jump = stored(starts.select("file", "at"), "reached"), stored(edges, "jumps")
    while not jump.isEmpty():
        further = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        seen = stored(seen.unionByName(further).distinct(), "reached")
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = stored(jump.join(onward, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jumps")
    return seen


def verified(pieces: DataFrame) -> DataFrame:
    """``file, block, k, at, owner`` of the stray pieces: pieces of a payload (``owner``: where its record starts), others (-1)."""
    lists = pieces.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("k", "size", "extent"))).alias("x"))
    splits = per_batch(lists.select("file", "block", F.col("x.size").alias("sizes"), F.col("x.extent").alias("extents")), _splits, "file string, block bigint, size bigint, starts array<bigint>, ends array<bigint>, leaves array<bigint>")
    # windows over one row per split of a file
    by = Window.partitionBy("file").orderBy("block")
    splits = stored(splits.withColumn("base", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))), "splits")
    nodes = (splits.select("file", "block", "base", F.explode(F.arrays_zip("starts", "leaves")).alias("x"))
             .select("file", "block", (F.col("base") + F.col("x.starts")).alias("at"), F.when(F.col("x.leaves") >= 0, F.col("base") + F.col("x.leaves")).alias("to")))
    starts = splits.select("file").distinct().withColumn("at", F.lit(len(MAGIC)).cast("bigint"))
    entered = nodes.select("file", F.col("to").alias("at")).where("at is not null").unionByName(starts).distinct()
    # merged: the planner takes the exploded side for as small as the file it comes from
    entries = stored(nodes.join(entered.hint("merge"), ["file", "at"]), "entries")
    edges = entries.where("to is not null").select("file", "at", "to")
    on = entries.join(reached(edges, starts), ["file", "at"]).select("file", "block", F.col("at").alias("entry"))
    marked = per_batch(splits.join(on, ["file", "block"], "left").select("file", "block", "base", "size", "starts", "ends", "entry"), _stray,
                       f"file string, block bigint, stray {_STRAY}, last_at bigint, last_end bigint")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = stored(marked, "marked").select("file", "block", "stray", F.last("last_at", True).over(before).alias("prev_at"), F.last("last_end", True).over(before).alias("prev_end"))
    each = marked.select("file", "block", "prev_at", "prev_end", F.explode("stray").alias("x")).select("file", "block", "prev_at", "prev_end", "x.*")
    owner = F.when(F.col("owner").isNotNull(), F.col("owner")).when(F.col("at") < F.col("prev_end"), F.col("prev_at")).otherwise(F.lit(-1))
    return stored(each.select("file", "block", "k", "at", owner.cast("bigint").alias("owner")), "strays")


def _page(text: str | None) -> int | None:
    """The number at the end of a record id of ours; null for foreign ones."""
    tail = (text or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?[0-9]{1,19}", tail) and -(1 << 63) <= int(tail) < 1 << 63 else None


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean"


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for content in batch.slice(at, 256).column("pieces"):
                    head, _, rest = MAGIC.encode().join(content.as_py()).partition(b"\r\n\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
                    size = _LENGTH.search(head)
                    payload = rest[: int(size[1]) if size else 0]
                    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    revisit = kind == "revisit"
                    n = fields.get("x-payload-length", "")
                    row = {"page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
                           "payload_bytes": (int(n) if n.isdigit() else None) if revisit else len(payload), "payload_digest": said if revisit else own, "digest_ok": None if revisit or said is None else said == own}
                    out.append(row | ({"payload": None if revisit else payload} if with_payload else {}))
                kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds + [("payload", pa.binary())] * with_payload))

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for every record on its file's boundary chain, with the columns of ``RECORD`` and ``payload binary``.

    Digest and length are computed from a response's payload; ``digest_ok``
    tells whether its header agrees.  Those of a revisit, whose payload is
    null, are the header's.  Records after a broken one, whose place in the
    file cannot be known, are not read.
    """
    # the archives are read once: another read may be split in another way, and the numbers would then mean other pieces
    pieces = stored(per_batch(_pieces(spark, path), _numbered, "file string, block bigint, piece binary, k int, size bigint, extent bigint"), "pieces")
    stray = verified(pieces)
    joined = pieces.alias("p").join(stray.alias("s"), ["file", "block", "k"], "left").select("file", F.col("p.piece").alias("piece"), "s.at", "s.owner")
    whole = joined.where("at is null").select("piece")
    # a payload's pieces are put together again: a group is one record
    parts = joined.where("owner >= 0").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    # joined in the task, by one pass over the pieces
    return per_batch(whole.select(F.array("piece").alias("pieces")).unionByName(parts.select(F.col("parts.piece").alias("pieces"))), _parsed(with_payload), RECORD + ", payload binary" * with_payload)
