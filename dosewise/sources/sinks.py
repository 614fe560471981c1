"""Writers for the typed, scoped and read-model layers (SNK-1..8).

Batching and retries of the reference loaders are Spark task behaviour:
a failed task is retried and its output committed once by the file
output committer, so there is nothing to hand-write here.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-2: truncate and load."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-1: append."""
    df.write.mode("append").format(fmt).save(path)


def replace_partition(df: DataFrame, path: str, column: str = "yr") -> None:
    """SNK-3: replace the partitions present in ``df`` (one year), keep the rest.

    Dynamic partition overwrite, set for this write.  Rows are rebalanced by
    the value: from the sizes seen in the shuffle, small values share a task
    and a value of many advisory partition sizes is written by that many, as
    far as ``df`` has partitions: a value is split along them.  They are
    observed, since the optimizer would drop a ``repartition`` right below.
    """
    df = df.observe(Observation(), F.count(F.lit(1)).alias("n"))
    even = df.sparkSession.sql(f"SELECT /*+ REBALANCE(`{column}`) */ * FROM {{df}}", df=df)
    (even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(column).parquet(path))


def _once(df: DataFrame) -> DataFrame:
    """``df`` stored: ranges are found from a sample first, so what is ranged is read twice and should be computed once."""
    from dosewise.operators.util import stored
    return stored(df, "ranged")


def write_scoped(df: DataFrame, path: str, keys=("drug_key", "npi"), partitions: int | None = None) -> None:
    """SNK-4: the grain tables laid out for key skipping: one folder per
    ``drug_key`` (partition pruning), rows sorted by ``npi`` inside (Parquet
    min/max row-group skipping).

    ``repartitionByRange`` on the full key splits a hot drug over several
    tasks instead of sending it to one, and each task writes few folders.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    (_once(df).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
       .write.mode("overwrite").partitionBy(keys[0]).parquet(path))


def write_clustered(df: DataFrame, path: str, key: str, partitions: int | None = None, group_bytes: int = 16 << 20, expected_keys: int = 1 << 20) -> None:
    """SNK-4 / FLT-15: a read model for lookups by ``key``: files are ranges of
    it, rows sorted by it, in row groups of ``group_bytes`` with page indexes
    and a Bloom filter, so that a filter on one key reads a row group or two of
    one file.  Without ``partitions``, AQE sizes the files."""
    df = _once(df)
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    (ranged.sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_bytes)
           .option(f"parquet.bloom.filter.enabled#{key}", True).option(f"parquet.bloom.filter.expected.ndv#{key}", expected_keys).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-6: CSV with header; NULL written as an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def empty_to_null(df: DataFrame) -> DataFrame:
    """SNK-7's rule: empty strings become NULL in the relational store."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, mode: str = "overwrite") -> None:
    """SNK-7: bulk load into a relational store, empty -> NULL."""
    empty_to_null(df).write.jdbc(url, table, mode=mode, properties=properties or {})


def write_json_dump(df: DataFrame, path: str) -> int:
    """SNK-8: raw JSON landing dump; returns the row count written, observed while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


# ---------------------------------------------------------------- snapshots
#
# A mutable table without a table format: every version is written to its
# own folder ``v=<n>``; only after that write job has committed is a row
# (version, path) appended to the table's commit log ``_log``.  Readers take
# the highest logged version, so a failed or half-written version is never
# read and the path being read is never overwritten.

COMMIT_LOG = "_log"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table, or None where the path does not exist.  Any other
    failure is raised: a log that cannot be read is not an empty log."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _log(spark: SparkSession, base: str) -> DataFrame | None:
    return read_if_there(spark, f"{base.rstrip('/')}/{COMMIT_LOG}", "version long, path string")


def snapshot_versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions, ascending."""
    log = _log(spark, base)
    if log is None:
        return []
    return sorted(r.version for r in log.select("version").distinct().collect())


def read_snapshot(spark: SparkSession, base: str, schema: T.StructType | None = None) -> DataFrame | None:
    log = _log(spark, base)
    if log is None:
        return None
    last = log.orderBy(F.desc("version")).limit(1).collect()
    if not last:
        return None
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(last[0].path)


def swap_snapshot(spark: SparkSession, df: DataFrame, base: str) -> str:
    """Write the next version beside the current one, then log it as committed.

    Every attempt writes a folder of its own, so nothing written before is
    ever overwritten, committed or not."""
    v = snapshot_versions(spark, base)
    n = (v[-1] + 1) if v else 0
    nxt = f"{base.rstrip('/')}/v={n}-{uuid.uuid4().hex[:8]}"
    df.write.mode("error").parquet(nxt)
    spark.createDataFrame([(n, nxt)], "version long, path string").write.mode("append") \
         .parquet(f"{base.rstrip('/')}/{COMMIT_LOG}")
    return nxt
