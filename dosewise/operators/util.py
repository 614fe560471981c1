"""Small shared helpers: size-checked broadcast, money sums, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.sources import schemas


def checked_broadcast(df: DataFrame, max_rows: int, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven <= ``max_rows``.

    ``known_rows`` is a bound the caller has by construction (a literal list,
    a ``limit(n)``); otherwise ``limit(max_rows + 1).count()`` checks it with
    one small job that stops early.  Beyond the bound the frame is returned
    unhinted and AQE picks the join strategy from real shuffle statistics.
    """
    if known_rows is None:
        known_rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if known_rows <= max_rows else df


def money_sum(c) -> Column:
    """Exact decimal sum, cast back to the money type."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col).cast(schemas.MONEY)


def long_sum(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col).cast("bigint")


def mean(c) -> Column:
    """avg as sum/count in double: exact sums keep the result order-independent."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col).cast("double") / F.count(col)


#: Rows that one task may number.
ONE_TASK = 1 << 17


def dense_ids(df: DataFrame, order_cols, offset=None, partitions: int | None = None, known_rows: int | None = None) -> DataFrame:
    """Adds ``id`` = ``offset`` + 1-based position of each row in ``order_cols``
    order, without moving all rows into one task, unless they are known to be
    at most ``ONE_TASK``.

    Rows are range-partitioned on the order (sampling splits even a hot
    value range), the result is checkpointed into the shared folder so both
    uses below see the same partitioning, each partition is counted (one row
    per partition), the counts are turned into start offsets by a window over
    those few rows, and every row gets its partition's offset plus its local
    position.  ``order_cols`` must be unique per row for determinism.
    """
    from pyspark.sql import Window
    spark = df.sparkSession
    base = F.lit(0).cast("bigint") if offset is None else offset
    if known_rows is not None and known_rows <= ONE_TASK:
        return df.withColumn("id", base + F.row_number().over(Window.orderBy(*order_cols)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(spark, df.repartitionByRange(n, *order_cols)
                         .sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    starts = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
                    .withColumn("_start", F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt"))
                    .select("_pid", "_start"))
    local = Window.partitionBy("_pid").orderBy(*order_cols)
    return (ranged.join(F.broadcast(starts), "_pid")
                  .withColumn("id", base + F.col("_start") + F.row_number().over(local))
                  .drop("_pid", "_start"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the session's shared folder and read
    back: cuts lineage, survives executor loss, and later reads take only the
    columns they need."""
    import uuid
    from dosewise.plans.session import shared_dir
    path = f"{shared_dir(df.sparkSession, 'stored')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(spark: SparkSession, df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder.

    Survives executor loss (unlike ``localCheckpoint``) and bounds lineage for
    iterative or incremental jobs.
    """
    from dosewise.plans.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=eager)
