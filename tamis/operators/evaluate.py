"""Evaluation: recall, AUC, thresholds, label replay, dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import norm
from tamis.operators.prefix import sums_before
from tamis.session import cut


def recall_at_k(ranked: DataFrame, truth: DataFrame, query: str, key: str, ranks: dict[str, str], k: int = 8) -> DataFrame:
    """`liste`, `questions` (with truth), `trouvees` (with one of it among the first `k`), `rappel`. `ranks`: list name -> column."""
    t = truth.select(query, key).distinct()
    n = t.agg(F.count_distinct(query)).first()[0]
    hits = ranked.join(t, [query, key], "left_semi")
    each = hits.agg(*[F.count_distinct(F.when(F.col(c) <= k, F.col(query))).alias(name) for name, c in ranks.items()])
    rows = each.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ranks)), F.array(*ranks))).alias("liste", "trouvees"))
    return rows.select("liste", F.lit(n).cast("bigint").alias("questions"), "trouvees", F.round(F.try_divide("trouvees", F.lit(n)), 6).alias("rappel"))


def by_score(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """`s`, `pos`, `neg`, `avant_pos`, `avant_neg`: rows per distinct score, unrounded, and rows of lower scores. Null scores
    and labels are left out."""
    g = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    return sums_before(g, "s", ["pos", "neg"])


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: `auc` (Mann-Whitney, ties half; null without both classes), `n_pos`, `n_neg`."""
    g = by_score(rows, score, positive)
    return g.agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("avant_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))


def threshold_sweep(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """`seuil`, `faux_refus` (positives below), `fuites` (negatives at or above) for each distinct score."""
    g = cut(by_score(rows, score, positive))
    negatives = F.lit(g.agg(F.sum("neg")).first()[0]).cast("bigint")
    return g.select(F.col("s").alias("seuil"), F.col("avant_pos").alias("faux_refus"), (negatives - F.col("avant_neg")).alias("fuites"))


def zero_leak(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the highest negative score, the lowest positive one above it, the middle of the trough between them, and the positives it refuses."""
    hi = F.lit(rows.where(~F.col(positive)).agg(F.max(score)).first()[0]).cast("double")
    out = rows.where(F.col(positive)).withColumn("plancher", hi).groupBy("plancher").agg(F.min(F.when(F.col(score) > F.col("plancher"), F.col(score))).alias("plafond"), F.count_if(F.col(score) <= F.col("plancher")).alias("refuses"), F.count(score).alias("sur"))
    return out.withColumn("milieu", F.round((F.col("plancher") + F.col("plafond")) / 2, 6))


def dispersion(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Per group of at least two values: n, mean, min, max, range and sample standard deviation in percent of the mean."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.min(value).alias("mini"), F.max(value).alias("maxi"), F.stddev_samp(value).alias("sd")).where("n >= 2")
    pct = lambda c: F.round(F.try_divide(c, F.col("m")) * 100, 4)
    return g.select(group, "n", F.round("m", 6).alias("moyenne"), "mini", "maxi", pct(F.col("maxi") - F.col("mini")).alias("etendue_pct"), pct(F.col("sd")).alias("cv_pct"))


def label_replay(found: DataFrame, labels: DataFrame, query: str) -> DataFrame:
    """One row: labelled questions, and those whose set of levels is the expected one. Both sides: `query`, `niveaux` (array)."""
    both = labels.select(query, F.array_sort(F.array_distinct("niveaux")).alias("a")).join(found.select(query, F.array_sort(F.array_distinct("niveaux")).alias("b")), query, "left")
    return both.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("justes"))


def match_prompts(prompts: DataFrame, labels: DataFrame) -> DataFrame:
    """`prompt_id`, `id`: the label of each prompt by its text, blanks around aside; null without one. A prompt with two
    different labels is an error."""
    t = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    both = prompts.select("prompt_id", t(F.col("prompt")).alias("t")).join(labels.select("id", t(F.col("requete")).alias("t")).distinct(), "t", "left")
    one = both.groupBy("prompt_id").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    return one.select("prompt_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several labels for prompt "), "prompt_id")).cast("string")).otherwise(F.col("id")).alias("id"))


def citation_difference(a: DataFrame, b: DataFrame, query: str) -> DataFrame:
    """Per query of either side: citations (`chunk`, `citation`, white space aside) only in `a`, only in `b`, in both, and
    whether a's are a strict subset of b's."""
    c = lambda d, side: d.select(query, "chunk", norm(F.col("citation")).alias("citation")).distinct().withColumn(side, F.lit(1))
    both = c(a, "x").join(c(b, "y"), [query, "chunk", "citation"], "full_outer")
    g = both.groupBy(query).agg(F.count_if(F.col("y").isNull()).alias("seul_a"), F.count_if(F.col("x").isNull()).alias("seul_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("communes"))
    return g.withColumn("sous_ensemble_strict", (F.col("seul_a") == 0) & (F.col("seul_b") > 0))
