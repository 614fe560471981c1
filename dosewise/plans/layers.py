"""The typed inputs and derived grain layers of one data directory.

``Layers`` defines every layer lazily from the provided tables.  One
instance is kept per (session, directory), so the plans of shared layers
are built once.  ``build_layers`` materialises the grain layers as
bucketed tables in the shared folder (the reference's pre-aggregation
step): all of them are bucketed and sorted on the same key
(``drug_key``, ``npi``) with the same bucket count, so later joins and
aggregations on that key read co-partitioned files without a shuffle.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import SparkSession

from dosewise.operators import match as M
from dosewise.operators import peers as P
from dosewise.operators import rollup as R
from dosewise.sources import fixtures as FX
from dosewise.sources import sinks

GRAIN_KEYS = ("drug_key", "npi")
# Layers materialised by ``build_layers``, in dependency order.  The typed raw
# tables are stored partitioned by year (year pins prune folders); the grain
# layers are bucketed on the grain key.
BUILT = ("partd", "payments", "rx", "pay", "claims", "pays", "mfr", "dd", "doctors")
RAW_PARTITION = {"partd": "yr", "payments": "program_year"}
BUCKET_KEYS = {"doctors": ("npi",)}


class Layers:
    """Typed inputs and derived layers of one data directory (all lazy).

    By default the inputs are the fixture projection of the provided tables
    under ``sf_dir``; ``Layers.of`` takes typed inputs read from real files.
    """

    map_rows = len(FX.FIXTURE_DRUG_MAP)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = FX.Tables(spark, sf_dir)

    @classmethod
    def of(cls, spark: SparkSession, *, partd, payments, drug_map, identities,
           pay_identities=None, map_rows: int | None = None, key: str = "inputs") -> "Layers":
        """Layers over typed input tables (e.g. from ``sources.readers``).
        ``map_rows`` is the map's size when known; otherwise it is checked
        before the map is broadcast."""
        lay = cls(spark, key)
        lay.map_rows = map_rows
        lay.__dict__.update(partd=partd, payments=payments, drug_map=drug_map,
                            identities=identities, pay_identities=pay_identities)
        return lay

    @cached_property
    def pay_identities(self):
        return None

    @cached_property
    def drug_map(self):
        return FX.drug_map(self.spark)

    @cached_property
    def partd(self):
        return FX.partd_raw(self.t)

    @cached_property
    def payments(self):
        return FX.payments_raw(self.t)

    @cached_property
    def identities(self):
        return FX.identities(self.t)

    @cached_property
    def review_changes(self):
        return FX.review_changes(self.t)

    @cached_property
    def rx(self):
        return R.rx_by_key(self.partd, self.drug_map, map_rows=self.map_rows)

    @cached_property
    def pay(self):
        return R.pay_by_key(self.payments, self.drug_map, map_rows=self.map_rows)

    @cached_property
    def claims(self):
        return R.entity_drug_claims(self.partd, self.drug_map, map_rows=self.map_rows)

    @cached_property
    def pays(self):
        return R.entity_drug_payments(self.payments, self.drug_map, map_rows=self.map_rows)

    @cached_property
    def mfr(self):
        return R.entity_drug_manufacturer(self.payments, self.drug_map, map_rows=self.map_rows)

    @cached_property
    def pay_rows(self):
        """Matched, scoped payment rows (one per row and drug), SQL matching rule."""
        return M.match_payments(R.scoped_payments(self.payments), self.drug_map, map_rows=self.map_rows)

    @cached_property
    def dd(self):
        return P.entity_drug(self.claims, self.pays)

    @cached_property
    def doctors(self):
        return R.entities(self.claims, self.pays, self.identities, self.pay_identities)


_INSTANCES: dict[tuple, Layers] = {}


def layers_for(spark: SparkSession, sf_dir: str) -> Layers:
    # DataFrames belong to one session: key by application and session.
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _INSTANCES:
        _INSTANCES[key] = Layers(spark, sf_dir)
    return _INSTANCES[key]


def _table_name(sf_dir: str, name: str) -> str:
    return f"dw_{hashlib.sha1(sf_dir.encode()).hexdigest()[:10]}_{name}"


# Dependency waves of the build: layers inside one wave are independent.
WAVES = (("partd", "payments"), ("rx", "pay", "claims", "pays", "mfr"), ("dd", "doctors"))


def _write_layer(spark: SparkSession, lay: Layers, name: str, root: str, n: int, cache: bool = False) -> None:
    df = getattr(lay, name)
    if name in RAW_PARTITION:
        path = f"{root}/{name}"
        sinks.replace_partition(df, path, RAW_PARTITION[name])
        lay.__dict__[name] = spark.read.parquet(path).select(*df.columns)
        return
    keys = BUCKET_KEYS.get(name, GRAIN_KEYS)
    tbl = _table_name(lay.sf_dir, name)
    # Hash-partition on the bucket key into exactly ``n`` tasks first (the
    # same hash as the bucket id), so each task writes one bucket file: n
    # files in total instead of up to tasks x n.  Grain keys are unique, so
    # no bucket can be hot.
    (df.repartition(n, *keys).write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys)
       .option("path", f"{root}/{name}").saveAsTable(tbl))
    table = spark.table(tbl)
    if cache:
        # Serving sessions keep the grain layers warm (the reference's shared
        # result cache); MEMORY_AND_DISK spills instead of failing, and a lost
        # executor's blocks are rebuilt from the written table.
        from pyspark import StorageLevel
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        table.count()
    lay.__dict__[name] = table


def build_layers(spark: SparkSession, sf_dir: str, buckets: int | None = None,
                 base: str | None = None, names=BUILT, parallel: bool = True,
                 layers: Layers | None = None, cache: bool = False) -> dict[str, float]:
    """Write every layer once under the shared folder — typed raw tables
    partitioned by year, grain layers bucketed and sorted on the grain key —
    and point this session's ``Layers`` at them.

    Independent layers of a wave are submitted as concurrent Spark jobs
    (one driver thread each), so small stages of different layers share the
    cluster instead of queueing.  Returns wall seconds per wave.
    ``buckets`` defaults to the shuffle partition count; ``sized_conf``
    gives the figure for a target input size.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    from dosewise.plans.session import shared_dir
    lay = layers if layers is not None else layers_for(spark, sf_dir)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = base or shared_dir(spark, f"layers/{_table_name(sf_dir, 'v1')}")
    lay.drug_map  # resolve shared inputs once, before threads start
    took = {}
    for i, wave in enumerate(WAVES):
        todo = [w for w in wave if w in names]
        if not todo:
            continue
        t0 = time.perf_counter()
        if parallel and len(todo) > 1:
            with ThreadPoolExecutor(max_workers=len(todo)) as pool:
                for f in [pool.submit(_write_layer, spark, lay, w, root, n, cache) for w in todo]:
                    f.result()
        else:
            for w in todo:
                _write_layer(spark, lay, w, root, n, cache)
        took["+".join(todo)] = round(time.perf_counter() - t0, 3)
    return took
