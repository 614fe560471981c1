"""Review queue: top-N seed, keyed upsert, append-only event log, latest state.

No table format with MERGE is assumed: ``upsert`` computes the next state of
the rows it is given with one full outer join on the key, and the caller
writes it beside them, never over the path being read.  ``upsert_buckets``
gives it only the hash buckets that hold a changed key, and rewrites only
these (``sources.buckets``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dosewise.operators.util import dense_ids, stored
from dosewise.sources import schemas
from dosewise.sources.buckets import BucketedTable

KEYS = ["drug_key", "npi"]
DEFAULT_STATUS = "flagged"


def seed_top_n(rx: DataFrame, pay: DataFrame, n: int = 10) -> DataFrame:
    """WIN-1: top-n paid entities per drug with their claims (pay INNER JOIN rx).

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit``
    before the shuffle, so each task forwards at most n rows per drug even
    when one drug holds most of the data.  Ties broken by npi (D-12).
    """
    j = pay.select(*KEYS, "pay_amount").join(rx.select(*KEYS, "clms"), KEYS)
    w = Window.partitionBy("drug_key").orderBy(F.desc("pay_amount"), F.asc("npi"))
    return (j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
             .select("drug_key", "npi", "pay_amount", F.col("clms").cast("double").alias("avg_claims")))


def latest_per_key(source: DataFrame, keys, cols, order=()) -> DataFrame:
    """One row (``keys``, ``cols``) per key: the last by ``order``.

    Mergeable aggregates only, so a key with very many changes is combined in
    each task first.  Where rows of a key tie in the whole order, they must
    agree; if they do not, no row is the latest and the job fails.
    """
    vals = F.struct(*cols)
    per = source.groupBy(*keys, *order).agg(F.min(vals).alias("lo"), F.max(vals).alias("hi"))
    if order:
        per = (per.groupBy(*keys).agg(F.max(F.struct(*order, "lo", "hi")).alias("last"))
                  .select(*keys, "last.lo", "last.hi"))
    clash = F.raise_error(F.lit("changes of one key at the same place in the order disagree"))
    return per.select(*keys, F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo"))
                      .otherwise(clash.cast(per.schema["lo"].dataType)).alias("v")).select(*keys, "v.*")


def upsert(target: DataFrame, source: DataFrame, now, keys=KEYS,
           update_cols=("pay_amount", "avg_claims"), default_status: str = DEFAULT_STATUS,
           order=(), max_id: int | None = None) -> DataFrame:
    """JOIN-9 / SNK-9 / STR-7: insert new keys with the default status; on a key
    conflict update only ``update_cols``; status and assignee are kept.

    The source is first reduced to the latest row per key by ``order``
    (``latest_per_key``), so the result has one row per key and ids stay
    unique whatever a batch holds.  ``updated_at`` moves to ``now`` only where
    a value actually changed (the trigger of the reference, STR-7).  New ids
    are ``max_id`` (by default the target's largest) + the dense position of the
    new key in key order (``dense_ids``): deterministic and computed across
    partitions.
    """
    ts_type = target.schema["updated_at"].dataType
    now_c = (F.lit(now) if not hasattr(now, "_jc") else now).cast(ts_type)
    t = target.select(*[F.col(c).alias(f"t_{c}") if c not in keys else F.col(c) for c in target.columns])
    s = latest_per_key(source, list(keys), list(update_cols), list(order))
    s = s.select(*keys, *[F.col(c).alias(f"s_{c}") for c in update_cols])
    j = t.join(s, list(keys), "full")
    is_new = F.col("t_id").isNull()
    changed = F.lit(False)
    for c in update_cols:
        changed = changed | (F.col(f"s_{c}").isNotNull() & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")))
    cols = [F.col("t_id").alias("id"), *[F.col(k) for k in keys]]
    for c in update_cols:
        cols.append(F.coalesce(F.col(f"s_{c}"), F.col(f"t_{c}")).alias(c))
    cols += [
        F.coalesce(F.col("t_status"), F.lit(default_status)).alias("status"),
        F.col("t_assigned_to").alias("assigned_to"),
        F.when(is_new | changed, now_c).otherwise(F.col("t_updated_at")).alias("updated_at"),
    ]
    # Read twice below (kept rows, new rows): joined and written once.
    merged = stored(j.select(*cols), "upsert")
    top = F.coalesce(target.agg(F.max("id").cast("bigint")).scalar(), F.lit(0).cast("bigint")) if max_id is None else F.lit(max_id).cast("bigint")
    fresh = merged.where(F.col("id").isNull()).drop("id")
    new = dense_ids(fresh, list(keys), offset=top, known_rows=fresh.count())
    return merged.where(F.col("id").isNotNull()).unionByName(new.select(*merged.columns))


def upsert_buckets(table: BucketedTable, source: DataFrame, now, update_cols=("pay_amount", "avg_claims"), order=(),
                   tag: str | None = None) -> int:
    """JOIN-9 / SNK-9 / STR-6: ``upsert`` that reads and rewrites only the buckets
    of the source's keys; the table's version afterwards."""
    latest = stored(latest_per_key(source, table.keys, list(update_cols), list(order)).withColumn("_bucket", table.bucket()), "changes")
    touched = sorted(r["_bucket"] for r in latest.select("_bucket").distinct().collect())  # at most the table's buckets
    if not touched:
        return table.version
    nxt = upsert(table.read(only=touched), latest.drop("_bucket"), now, keys=table.keys, update_cols=update_cols, max_id=table.max_id)
    return table.commit(nxt, touched, tag)


STATE_COLS = ("drug_key", "npi", "pay_amount", "status", "assigned_to")


def latest_state(events: DataFrame, id_col: str = "review_id", order=("synced_at",),
                 cols=STATE_COLS) -> DataFrame:
    """AGG-25 / STR-5: last value of each column per id by the log order,
    plus ``max(updated_at)``.

    One aggregate with a partial step: a task sends on one row per id, so an
    id with very many events is combined before the shuffle.  Rows that tie in
    the whole order resolve to the largest values.
    """
    cols = [c for c in cols if c in events.columns]
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), *(F.col(c).alias(f"v{k}") for k, c in enumerate(cols)))
    last = events.groupBy(id_col).agg(F.max(row).alias("_last"), F.max("updated_at").alias("updated_at"))
    return last.select(id_col, *(F.col(f"_last.v{k}").alias(c) for k, c in enumerate(cols)), "updated_at")


def queue_from_log(events: DataFrame) -> DataFrame:
    """Current queue rows (id, drug_key, npi, pay_amount, avg_claims, status,
    assigned_to, updated_at) from a change log, latest row per id."""
    order = ("updated_at", "event_id") if "event_id" in events.columns else ("synced_at",)
    ls = latest_state(events, order=order)
    return ls.select(
        F.col("review_id").alias("id"), "drug_key", "npi", "pay_amount",
        (F.col("avg_claims") if "avg_claims" in ls.columns else F.lit(None).cast("double")).alias("avg_claims"),
        "status",
        (F.col("assigned_to") if "assigned_to" in ls.columns else F.lit("")).alias("assigned_to"),
        "updated_at")


def review_by_pay(queue: DataFrame) -> DataFrame:
    """ORD-10: review queue by payment desc (rounded dollars, id tie-break)."""
    return queue.select("id", "drug_key", "npi", F.round("pay_amount", 0).cast("decimal(18,0)").alias("pay_amount"),
                        "status", "assigned_to", "updated_at").orderBy(F.desc("pay_amount"), "id")


def to_event_rows(changes: DataFrame, synced_at=None) -> DataFrame:
    """STR-4: change rows as log rows, NULL -> ''/0, stamped with ``synced_at``."""
    ts = F.current_timestamp() if synced_at is None else F.lit(synced_at).cast("timestamp")
    return changes.select(
        F.col("id").cast("bigint").alias("review_id"), "drug_key", F.col("npi").cast("bigint"),
        F.coalesce(F.col("pay_amount"), F.lit(0).cast(schemas.MONEY)).alias("pay_amount"),
        F.coalesce(F.col("avg_claims"), F.lit(0.0)).alias("avg_claims"), "status",
        F.coalesce(F.col("assigned_to"), F.lit("")).alias("assigned_to"),
        F.col("updated_at").cast("timestamp").alias("updated_at"), ts.alias("synced_at"))

