"""Substring search over names by an inverted index of character grams (FLT-12/13, ORD-2, API-3/4).

Every lower-cased name is listed under each of its different grams of two and
three characters.  Postings lie in folders by a hash of the gram, sorted by
gram, and carry the name and what results are ordered by.  A name that
contains the query contains all of its grams, so a search reads the folder of
the query's rarest gram alone, where Parquet's statistics skip other grams,
and checks the names it finds there; details of the few results are fetched by
key.  Many searches at once are one join of the different texts' rarest grams
with the different names of those grams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.operators import search as S
from dosewise.operators.util import stored

SIZES = (2, 3)


def grams(low: Column) -> Column:
    """The different grams of a text, as an array."""
    n = F.length(low)

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(k) for k in SIZES)))


def query_grams(q: str) -> list[str]:
    """The grams a lower-cased query is looked up by: its longest."""
    k = min(len(q), max(SIZES))
    return sorted({q[i : i + k] for i in range(len(q) - k + 1)}) if k >= min(SIZES) else []


@dataclass
class NameIndex:
    spark: SparkSession
    path: str
    folders: int

    def _folder(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.folders)).cast("int")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, npi bigint, name string, low string, total_claims bigint, folder int").parquet(f"{self.path}/postings")

    @property
    def frequencies(self) -> DataFrame:
        return self.spark.read.schema("gram string, n bigint").parquet(f"{self.path}/frequencies")

    @classmethod
    def build(cls, entities: DataFrame, path: str, folders: int = 256) -> "NameIndex":
        """Index ``npi, name, total_claims``; a gram of very many names is written by as many tasks as its size needs."""
        spark, low = entities.sparkSession, F.lower(F.coalesce("name", F.lit("")))
        index = cls(spark, path, folders)
        rows = entities.select("npi", "name", F.col("total_claims").cast("bigint").alias("total_claims"), F.explode(grams(low)).alias("gram"))
        rows = rows.withColumn("folder", index._folder(F.col("gram")))
        even = spark.sql("SELECT /*+ REBALANCE(folder) */ * FROM {rows}", rows=rows).select("gram", "npi", "name", low.alias("low"), "total_claims", "folder")
        even.sortWithinPartitions("folder", "gram", "npi").write.mode("errorifexists").partitionBy("folder").option("compression", "zstd").parquet(f"{path}/postings")
        index.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sort("gram").write.option("compression", "zstd").parquet(f"{path}/frequencies")
        return index

    def candidates(self, q: str) -> DataFrame | None:
        """Postings of names that contain the lower-cased ``q``; None where a gram of it has no name."""
        asked = query_grams(q)
        found = self.frequencies.where(F.col("gram").isin(asked)).orderBy("n", "gram").collect()  # at most a row for each character of q
        if not asked or len(found) < len(asked):
            return None
        rarest = found[0].gram
        number = self.spark.range(1).select(self._folder(F.lit(rarest))).first()[0]
        return self.postings.where((F.col("folder") == number) & (F.col("gram") == rarest) & (F.instr("low", q) > 0))

    def _details(self, best: DataFrame, entities: DataFrame, limit: int, order: list[Column], cols: list) -> DataFrame:
        """The entities of at most ``limit`` hits, fetched by key."""
        rows = best.limit(limit).collect()
        hits = self.spark.createDataFrame(rows, best.schema) if rows else self.spark.createDataFrame([], best.schema)
        few = entities.where(F.col("npi").isin([r.npi for r in rows]))
        return few.join(F.broadcast(hits), "npi").orderBy(*order).select(*cols)

    def search(self, entities: DataFrame, q: str, limit: int = 20) -> DataFrame:
        """``search.search_entities`` by the index: same rows in the same order."""
        ql = (q or "").strip().lower()
        hits = self.candidates(ql) if len(ql) >= S.MIN_QUERY_LEN else None
        if hits is None:
            return S.search_entities(entities.limit(0), ql, limit)
        hits = hits.withColumn("match_rank", S.match_rank(F.col("low"), ql))
        order = ["match_rank", F.col("total_claims").desc_nulls_last(), "name", "npi"]
        best = hits.orderBy(*order).select("npi", "match_rank")
        return self._details(best, entities, limit, order, [*S.SEARCH_COLS, "match_rank"])

    def find(self, entities: DataFrame, name: str, limit: int = 25) -> DataFrame:
        """``search.find_entity`` by the index; a query of one character has no gram and is a scan."""
        q = (name or "").lower()
        if len(q) < min(SIZES):
            return S.find_entity(entities, name, limit)
        hits = self.candidates(q)
        if hits is None:
            return S.find_entity(entities.limit(0), name, limit)
        order = [F.desc("total_claims"), F.col("npi")]
        best = hits.orderBy(*order).select("npi")
        return self._details(best, entities, limit, order, ["npi", "name", "specialty", "city", "state", F.round("total_pay", 0).cast("decimal(18,0)").alias("total_pay"), "total_claims"])

    def find_many(self, queries: DataFrame, limit: int = 25) -> DataFrame:
        """``q_id, q, n_hits, rank, npi, name, total_claims``: the first hits of each query (``q_id`` unique, ``q`` of two characters or more) in ``find``'s order.

        Different texts meet different names: a text asked many times is looked
        up once, in the names of its rarest gram, and a name of many entities
        is checked once and stands for their number and their first ``limit``.
        A name has few pieces, so hits of texts in names grow with the names,
        however many entities share them or queries ask for them.
        """
        low = F.lower("q")
        # in the end rows are put together by q_id: dealt by it here
        queries = queries.where(F.col("q_id").isNotNull()).select("q_id", "q", low.alias("ql")).repartition("q_id").distinct()
        asked = queries.select("ql").distinct().withColumn("gram", F.explode(F.filter(grams(F.col("ql")), lambda g: F.length(g) == F.least(F.length("ql"), F.lit(max(SIZES))))))
        seen = asked.join(self.frequencies, "gram", "left")
        rarest = seen.groupBy("ql").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("ql", F.col("r.gram").alias("gram"))
        rarest = stored(rarest.withColumn("folder", self._folder(F.col("gram"))), "asked")
        names = self.postings.join(rarest.select("folder", "gram").distinct(), ["folder", "gram"], "left_semi").groupBy("folder", "gram", "low").agg(F.count(F.lit(1)).alias("n"))
        pairs = stored(rarest.join(names, ["folder", "gram"]).where(F.expr("instr(low, ql) > 0")).select("ql", "low", "n"), "pairs")
        # of an entity's postings, the one of its name's first gram
        entities = self.postings.where(F.col("gram") == F.substring("low", 1, min(SIZES))).select("low", "npi", "name", "total_claims")
        order = [F.desc("total_claims"), F.col("npi")]
        first = entities.withColumn("nth", F.row_number().over(Window.partitionBy("low").orderBy(*order))).where(F.col("nth") <= limit)
        best = pairs.select("ql", "low").join(first, "low").withColumn("nth", F.row_number().over(Window.partitionBy("ql").orderBy(*order))).where(F.col("nth") <= limit)
        hits = best.groupBy("ql").agg(F.collect_list(F.struct("npi", "name", "total_claims")).alias("best")).join(pairs.groupBy("ql").agg(F.sum("n").alias("n")), "ql")
        of_id = Window.partitionBy("q_id")
        met = queries.join(stored(hits, "hits"), "ql").withColumn("n_hits", F.sum("n").over(of_id))
        met = met.select("q_id", "q", "n_hits", F.inline("best")).withColumn("rank", F.row_number().over(of_id.orderBy(*order)))
        return met.where(F.col("rank") <= limit).select("q_id", "q", "n_hits", "rank", "npi", "name", "total_claims")
