"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* a null text counts as the empty text;
* only the columns an operator names are read, so extra input columns with
  any name (also one that equals an output column) are ignored;
* rows are never merged: repeated rows give repeated result rows;
* where documents are ordered by id, a null id comes last.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.plans.session import shared_dir

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Order key of a row without an id.
LAST_ID = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id bigint, text string`` of the documents; null texts become empty."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Terms are ASCII letters (lower-cased) and digits and everything beyond ASCII; other bytes become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of about ``piece`` bytes, so that a very long text's are not held at once."""
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = len(text) if at + piece >= len(text) else text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        if words := text[at:end].split():
            yield words
        at = end


def stored(df: DataFrame, name: str, rows_per_file: int = 0, **options: str) -> DataFrame:
    """Write ``df`` once into the session's shared folder and read it back; wide rows in files of ``rows_per_file``.

    ``options``: of Spark's Parquet writer.

    Cuts lineage; survives executor loss; the planner then knows the real
    size, so its own size-checked broadcast rule applies to what is read back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED = "dosewise.llm.shipped"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, None):
        return
    root = Path(__file__).resolve().parents[2]
    path = f"{tempfile.mkdtemp()}/dosewise-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "dosewise").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def per_batch(df: DataFrame, work, schema: str) -> DataFrame:
    """``df.mapInArrow(work, schema)`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


#: Rows of one id that a sample may hold.
COPIES = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """Texts of at most ``per_class`` labelled ids of either class, at most ``COPIES`` rows of an id, and each class's weight.

    ``learn`` is a condition on ``doc_id``: other ids are never looked at.  The
    ids are the first in the order of a seeded hash.  Labels other than 0 and 1
    are ignored; an id with both labels counts as 1; of an id's rows count the
    first in the order of the text's hash.  The weight is the number of labelled ids a sampled one
    stands for.  Returns ``(label int, text string)`` and ``{label: weight}``.
    """
    known = (labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("label"))
             .where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    texts = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    of_id = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    texts = texts.withColumn("_nth", F.row_number().over(of_id)).where(F.col("_nth") <= COPIES).select("label", "text")
    weights = {v: n / min(n, per_class) for v, n in totals.items()}
    return texts, weights
