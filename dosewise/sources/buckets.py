"""A keyed table without a table format, rewritten bucket by bucket (SNK-9, STR-6).

Rows live in ``buckets`` hash buckets of their key.  A commit writes the
buckets it changes to a folder of its own and then appends one manifest row
per changed bucket, all in one file, so a commit is there as a whole or not at
all.  A reader takes each bucket's row of the highest version: buckets that a
commit did not touch are still the files of older ones, and nothing written
before is ever overwritten.  A commit may carry a tag (a micro-batch's id);
``applied`` tells whether it is there, so a replay is a no-op.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.sources.sinks import read_if_there

MANIFEST = "version bigint, tag string, bucket int, buckets int, path string, n bigint, max_id bigint"


class BucketedTable:
    """``schema`` rows with unique ``keys``; ``id_col`` is a number whose largest value the manifest keeps.

    ``buckets`` counts for a new table; an old one keeps its own.  The driver
    holds at most a manifest row for each bucket.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, keys: list[str], buckets: int = 64, id_col: str = "id"):
        self.spark, self.base, self.schema, self.keys, self.id_col = spark, base.rstrip("/"), schema, list(keys), id_col
        self.live = self._live(None)
        self.buckets = self.live[0].buckets if self.live else buckets

    def _manifest(self) -> DataFrame | None:
        return read_if_there(self.spark, f"{self.base}/_manifest", MANIFEST)

    def _live(self, version: int | None) -> list[Row]:
        m = self._manifest()
        if m is None:
            return []
        if version is not None:
            m = m.where(F.col("version") <= version)
        last = m.groupBy("bucket").agg(F.max(F.struct("version", "buckets", "path", "n", "max_id")).alias("r"))
        return last.select("bucket", "r.*").orderBy("bucket").collect()

    @property
    def version(self) -> int:
        return max((r.version for r in self.live), default=-1)

    @property
    def max_id(self) -> int:
        return max((r.max_id or 0 for r in self.live), default=0)

    def applied(self, tag: str) -> bool:
        m = self._manifest()
        return m is not None and not m.where(F.col("tag") == tag).isEmpty()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets, now or as of a version."""
        rows = self.live if version is None else self._live(version)
        paths = [r.path for r in rows if (only is None or r.bucket in only) and r.n]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, df: DataFrame, touched: list[int], tag: str | None = None) -> int:
        """Put ``df``, all rows of the buckets ``touched``, in their place; the new version."""
        version = self.version + 1
        folder = f"{self.base}/data/{version}-{uuid.uuid4().hex[:8]}"
        names = self.schema.fieldNames()
        (df.select(*names, self.bucket().alias("_bucket")).repartition("_bucket")
           .write.partitionBy("_bucket").option("compression", "zstd").parquet(folder))
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(folder)
        found = {r["_bucket"]: r for r in written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.max(self.id_col).cast("bigint").alias("max_id")).collect()}
        if not set(found) <= set(touched):
            raise ValueError("rows of buckets that are not being replaced")
        rows = [(version, tag, b, self.buckets, f"{folder}/_bucket={b}", found[b].n if b in found else 0, found[b].max_id if b in found else None) for b in sorted(touched)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.base}/_manifest")
        self.live = self._live(None)
        return version

    def replace(self, rows: DataFrame, tag: str | None = None) -> int:
        """Put ``rows`` (one a key) in the place of the rows of their keys; the version afterwards."""
        from dosewise.operators.util import stored
        rows = stored(rows.select(*self.schema.fieldNames()), "replaced")  # read three times below
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most the table's buckets
        if not touched:
            return self.version
        kept = self.read(only=touched).join(rows.select(*self.keys), self.keys, "left_anti")
        return self.commit(kept.unionByName(rows), touched, tag)
