"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

``measure`` counts, row by row and without a shuffle, what the rules look at.
``cutoffs`` selects, for every stratum (language), a cutoff for each rule from
a fixed grid.  Labelled documents are the holdout: nothing else is fitted to
them.  A grid value may be used only where the exact binomial test proves, at
level ``delta`` divided by the number of tests made (strata x rules x grid
values: Bonferroni), that the rule rejects at most ``alpha / rules`` of the
stratum's good documents; so all rules together reject at most ``alpha`` of
them, in every stratum at once, with probability ``1 - delta``.  Among the
proven values the one that best tells bad from good labelled documents is
taken (the higher one on a tie); a rule that rejects no labelled bad document
net of good ones is not used.  A stratum with too few labels gets no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules: a share that is high in bad text, and the cutoffs that may be chosen.
GRIDS = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "capital_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "shout_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
}
ALPHA, DELTA = 0.05, 0.05


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * 5), " "), "")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``rules`` (one of that name is replaced).

    Its counts: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``;
    its shares: the keys of ``GRIDS``.  A null or empty text has counts and
    shares of zero.  Every step is a function of one row: a document's words
    never leave its task.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "rules"]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    first = docs.select(
        *kept,
        words(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("_lines"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("_chars"),
        _count(text, SYMBOLS).alias("_symbols"),
        _count(text, CAPITALS).alias("_capitals"),
        _count(text, "!").alias("_shouts"),
    )
    # windows of five words by hash; two windows of a text count as equal if the 64-bit hashes are
    hashed = first.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_hash")
    n = F.size(h)
    windows = hashed.withColumn("_windows", F.when(n >= 5, F.transform(
        F.slice(h, 1, n - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4))))
        .otherwise(F.array().cast("array<bigint>")))
    found = windows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    s = F.col("_sorted")
    again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
    # each repeated window adds the words that the one before it does not cover
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    counted = found.select(
        *kept,
        F.size("_words").cast("bigint").alias("_n"), F.col("_chars"), F.col("_symbols"), F.col("_capitals"), F.col("_shouts"),
        F.size("_lines").cast("bigint").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("_dup_lines"),
        covered.alias("_repeats"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counted.select(*kept, F.struct(
        F.col("_n").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"), F.col("_repeats").alias("n_repeat_words"),
        share("_symbols", "_chars").alias("symbol_share"), share("_dup_lines", "_n_lines").alias("dup_line_share"),
        share("_repeats", "_n").alias("repeat_share"), share("_capitals", "_chars").alias("capital_share"),
        share("_shouts", "_n").alias("shout_share")).alias("rules"))


def base_failed(rules: Column) -> Column:
    return (rules["n_words"] < 10) | (100 * rules["n_repeat_words"] > 20 * rules["n_words"])


def cutoffs(measured: DataFrame, labels: DataFrame, label_col: str = "quality", stratum_col: str = "lang",
            alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id") -> DataFrame:
    """One row per stratum with proven cutoffs: ``stratum`` and a nullable double for each rule.

    ``measured`` holds ``id_col``, ``stratum_col`` and ``rules``.  Labels other
    than 0 and 1 are ignored; an id with both counts as bad.  A null stratum is
    a stratum of its own.  Without labels the result is empty.
    """
    known = (labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_good"))
             .where(F.col("_good").isin(0, 1)).groupBy("_id").agg(F.min("_good").alias("_good")))
    seen = measured.select(measured[id_col].alias("_id"), measured[stratum_col].alias("stratum"), "rules").join(known, "_id")
    cells = [(r, c) for r, grid in GRIDS.items() for c in grid]
    over = lambda r, c, good: F.sum(((F.col("rules")[r] > c) & (F.col("_good") == good)).cast("bigint"))
    counts = seen.groupBy("stratum").agg(
        F.sum((F.col("_good") == 1).cast("bigint")).alias("n_good"), F.sum((F.col("_good") == 0).cast("bigint")).alias("n_bad"),
        *(over(r, c, good).alias(f"k{good}_{i}") for i, (r, c) in enumerate(cells) for good in (0, 1)))
    # a window over one row per stratum
    tests = F.count(F.lit(1)).over(Window.partitionBy()) * len(cells)
    counts = counts.where("n_good > 0").withColumn("tests", tests.cast("double"))
    a = alpha / len(GRIDS)
    # the most false rejections k of n with P(X <= k) <= level for X ~ Binomial(n, a): then the true rate is below a
    step = lambda s, i: F.struct(
        (s["log_p"] + F.log((F.col("n_good") - i) / (i + 1.0)) + F.log(F.lit(a / (1 - a)))).alias("log_p"),
        (s["cdf"] + F.exp(s["log_p"])).alias("cdf"),
        F.when(s["cdf"] + F.exp(s["log_p"]) <= delta / F.col("tests"), i).otherwise(s["k"]).alias("k"))
    allowed = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.col("n_good") * a).cast("int")),
        F.struct((F.col("n_good") * F.log1p(F.lit(-a))).alias("log_p"), F.lit(0.0).alias("cdf"), F.lit(-1).alias("k")),
        step, lambda s: s["k"])
    tested = counts.withColumn("allowed", allowed)
    rows = tested.select("stratum", "n_good", "n_bad", "allowed", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k1_{i}").alias("k_good"), F.col(f"k0_{i}").alias("k_bad"))
        for i, (r, c) in enumerate(cells)))).alias("t")).select("stratum", "n_good", "n_bad", "allowed", "t.*")
    gain = F.col("k_bad") * F.col("n_good") - F.col("k_good") * F.col("n_bad")
    proven = rows.where("k_good <= allowed").withColumn("gain", gain).where("gain > 0")
    best = proven.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in GRIDS))


def judge(measured: DataFrame, chosen: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """All columns of ``measured`` and ``base_failed, kept boolean`` (columns of these names are replaced).

    A document is kept unless it fails the base rules or a share is over its
    stratum's cutoff.  Which join the strata's few rows take is the planner's
    choice by their size.
    """
    kept = [F.col(f"d.`{c}`") for c in measured.columns if c not in ("base_failed", "kept")]
    over = [F.coalesce(F.col("d.rules")[r] > F.col(f"c.{r}"), F.lit(False)) for r in GRIDS]
    rejected = over[0]
    for o in over[1:]:
        rejected = rejected | o
    failed = base_failed(F.col("d.rules"))
    joined = measured.alias("d").join(chosen.alias("c"), F.col(f"d.`{stratum_col}`").eqNullSafe(F.col("c.stratum")), "left")
    return joined.select(*kept, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
