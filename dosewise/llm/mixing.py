"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

All sources share the corpus's total size in proportion to their weights; a
source stops at ``max_epochs`` times its own size and what it cannot take is
shared by the others in proportion, until none is above.  That is the water
level ``L`` with ``sum(min(cap, L * weight)) = total``: sources are clamped in
the order of ``cap / weight``, so running sums over the sources find it.

A source's target is met to the word.  Every document is taken ``floor(target
/ size)`` times; for the rest, the source's documents are laid out in a seeded
random order and the first so many words of that line are taken once more:
whole documents, but for the one in which the line ends.  Where the line ends
is found from sums over ever narrower ranges of the order, so no source's
documents are gathered or sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.llm.common import LAST_ID, stored
from dosewise.llm.quality_rules import words

#: Hexadecimal digits of the random order that each narrowing step looks at.
STEPS = (2, 3)
DIGITS = sum(STEPS)


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, ord`` of every document; null texts have no words."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[source_col].cast("string").alias("source"),
                       F.size(words(F.coalesce(docs[text_col], F.lit("")))).cast("bigint").alias("size"),
                       order_key(docs[id_col].cast("bigint"), seed).alias("ord"))


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """``source, source_size, target`` for each source; weights repeat along the sources in code-point order, null last.

    The windows below run over one row per source.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    each = sums.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), at + 1)).withColumn("cap", max_epochs * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # the level if all sources before this one are clamped and none from here on
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    levels = each.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap")).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """For each source: ``source, source_size, target, whole`` (repetitions of every document), ``rest`` (words taken
    once more), and where the line of the rest ends: the range ``prefix`` of the order and the words ``base`` before it.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("bigint")
    out = stored(targets(rows, weights, max_epochs).withColumn("whole", whole)
                 .withColumn("rest", F.floor(F.col("target") - F.col("whole") * size + 0.5).cast("bigint"))
                 .withColumn("prefix", F.lit("")).withColumn("base", F.lit(0).cast("bigint")), "mix-plan")
    taken = 0
    for digits in STEPS:
        inside = rows.alias("r").join(out.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & F.col("r.ord").startswith(F.col("p.prefix")))
        taken += digits
        sums = inside.groupBy(F.col("p.source").alias("source"), F.substring("r.ord", 1, taken).alias("next")).agg(F.sum("r.size").alias("n"), F.max("p.base").alias("from"), F.max("p.rest").alias("rest"))
        # at most 16^digits rows a source
        upto = F.col("from") + F.sum("n").over(Window.partitionBy("source").orderBy("next"))
        ends = sums.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min("next").alias("next"), F.min("upto").alias("upto"))
        ends = ends.alias("e").join(sums.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")) & (F.col("e.next") == F.col("s.next"))).select("e.source", "e.next", (F.col("upto") - F.col("n")).alias("base"))
        # no range is reached where the rest is all of the source: then everything lies before the end
        out = stored(out.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select(
            "p.source", "source_size", "target", "whole", "rest", F.coalesce("next", F.lit("g" * taken)).alias("prefix"), F.coalesce("e.base", "p.base").alias("base")), "mix-plan")
    return out


def ending(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The documents of the range in which a source's line ends: ``source, doc_id, size, part``.

    ``part`` is the words of the document on the line.  Repeated rows share
    theirs evenly, rounded down.  A range holds a 16^-5 share of a source.
    """
    near = rows.alias("r").join(planned.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & F.col("r.ord").startswith(F.col("p.prefix")))
    same = near.groupBy(F.col("p.source").alias("source"), "doc_id", "size", "ord").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("base"), F.max("rest").alias("rest"))
    line = Window.partitionBy("source").orderBy("ord", F.coalesce("doc_id", F.lit(LAST_ID)), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(line), F.lit(0))
    words_in = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size") * F.col("n"), F.col("rest") - start))
    return stored(same.select("source", "doc_id", "size", F.floor(words_in / F.col("n")).cast("bigint").alias("part")), "mix-ends")


def taken(rows: DataFrame, planned: DataFrame, ends: DataFrame) -> DataFrame:
    """All columns of ``rows`` (with ``doc_id, source, size, ord``) and ``source_size, target, taken`` (such columns are replaced).

    One row per source and the few rows of ``ends`` are joined the way their
    size suggests to the planner.  Reruns agree: the order is a hash of the id.
    """
    kept = [F.col(f"r.`{c}`") for c in rows.columns if c not in ("source_size", "target", "taken")]
    here = F.substring("r.ord", 1, DIGITS)
    part = F.when(here < F.col("p.prefix"), F.col("r.size")).when(here > F.col("p.prefix"), F.lit(0)).otherwise(F.coalesce("e.part", F.lit(0)))
    return (rows.alias("r").join(planned.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.size") == F.col("e.size")), "left")
            .select(*kept, "p.source_size", "p.target", (F.col("whole") * F.col("r.size") + part).cast("bigint").alias("taken")))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    An empty table gives an empty result; documents without words take none.
    """
    rows = stored(sized(docs, seed, id_col, text_col, source_col), "mix-sizes")
    planned = plan(rows, weights, max_epochs)
    return taken(rows, planned, ending(rows, planned)).drop("ord")


def mixed_documents(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken whole, and once cut off after its last taken word.

    ``docs`` has ``doc_id, text, lang, source, n_chars``, which the result has
    too; ``n_chars`` of a cut text is its new length.  Texts stay in their task.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    lean = stored(sized(docs, seed), "mix-sizes")
    planned = plan(lean, weights, max_epochs)
    ends = ending(lean, planned)
    rows = docs.select(*names, F.size(words(F.coalesce("text", F.lit("")))).cast("bigint").alias("size"), order_key(F.col("doc_id").cast("bigint"), seed).alias("ord"))
    got = taken(rows, planned, ends).withColumn("left", F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)) + (F.col("left") > 0).cast("int")
    each = got.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    last = (F.col("left") > 0) & (F.col("copy") == copies)
    cut = F.array_join(F.slice(words(F.coalesce("text", F.lit(""))), 1, F.col("left").cast("int")), " ")
    text = F.when(last, cut).otherwise(F.col("text"))
    return each.select("doc_id", text.alias("text"), "lang", "source", F.when(last, F.length(cut)).otherwise(F.col("n_chars")).cast("bigint").alias("n_chars"))
