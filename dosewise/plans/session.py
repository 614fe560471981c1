"""SparkSession construction and the shared checkpoint folder.

On a cluster the operator sets ``spark.checkpoint.dir`` to a shared,
fault-tolerant folder (HDFS / object store).  We only ever read that
setting; a private scratch folder is created only when it is unset, which
is the case in local tests.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Fixed session settings every job in this package assumes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "dosewise",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only
    when the session runs in one process (``local[...]``) and names none.

    On any other master a missing ``spark.checkpoint.dir`` is an error: a
    machine-local folder would lose whatever executors write there."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(
                f"spark.checkpoint.dir is not set and the master is {master!r}: executors "
                "would not share a scratch folder made here; name a shared one")
        conf_dir = tempfile.mkdtemp(prefix="dosewise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def sized_conf(input_bytes: int, cores: int, shuffle_fraction: float = 0.25,
               target_bytes: int = 256 << 20, layer_fraction: float = 0.05,
               bucket_bytes: int = 512 << 20) -> dict:
    """Partition sizing for a given input size and cluster core count.

    * scan splits of ``target_bytes`` (``spark.sql.files.maxPartitionBytes``);
    * initial shuffle partitions so that the expected shuffle volume
      (``input_bytes * shuffle_fraction``; the plans project and
      partial-aggregate before every exchange) lands near ``target_bytes`` per
      task, never fewer than 3 tasks per core; AQE then
      coalesces small partitions to the advisory size and splits skewed ones;
    * the bucket count for ``build_layers`` sizes one bucket file of the
      grain layers (``input_bytes * layer_fraction``: one row per product and
      entity) near ``bucket_bytes``, rounded up to a power of two and at
      least one bucket per core.

    At 100 TB on 1,000 executors x 8 cores this gives ~93k shuffle
    partitions (~250 MB each) and 16,384 buckets (~300 MB files).
    """
    import math
    parts = max(cores * 3, math.ceil(input_bytes * shuffle_fraction / target_bytes))
    want = max(cores, math.ceil(input_bytes * layer_fraction / bucket_bytes))
    buckets = 1 << max(0, math.ceil(math.log2(want)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_bytes * 2),
        "dosewise.layer.buckets": str(buckets),
    }
