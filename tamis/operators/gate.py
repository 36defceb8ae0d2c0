"""Statistics by which a question is accepted, flagged or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.rulepack import STOP_WORDS
from tamis.operators.lexical import corpus_stats, counted_for, idf, idf_ceiling, query_terms
from tamis.session import cut, small


def score_statistics(candidates: DataFrame, selection: DataFrame, query: str) -> DataFrame:
    """Per query the statistics that need scores only; null where a list or the selection is empty (agreement, bm25_top1: 0)."""
    by_query = candidates.groupBy(query).agg(
        F.sort_array(F.collect_list(F.when(F.col("rang_dense").isNotNull(), F.struct("rang_dense", "i", "cos")))).alias("d"),
        (F.count_if((F.col("rang_bm25") <= 10) & (F.col("rang_dense") <= 10)) / 10.0).alias("accord_bm25_dense_top10"),
        F.coalesce(F.min_by(F.when(F.col("rang_bm25").isNotNull(), F.col("score_bm25")), F.coalesce("rang_bm25", F.lit(1 << 30))), F.lit(0.0)).alias("bm25_top1"),
    )
    first, second = (F.try_element_at("d", F.lit(k)).cos for k in (1, 2))
    by_query = by_query.select(query, first.alias("cos_top1_dense"), F.round(first - second, 6).alias("ecart_dense_1_2"), "accord_bm25_dense_top10", "bm25_top1")
    cos = F.transform("retenus", lambda r: r.cos)
    kept = selection.select(
        query,
        F.try_element_at(cos, F.lit(1)).alias("cos_du_retenu_1"),
        F.array_max(cos).alias("cos_max_retenus"),
        F.size("retenus").cast("bigint").alias("n_retenus"),
        F.size(F.array_distinct(F.array_compact(F.transform("retenus", lambda r: r.doc)))).cast("bigint").alias("docs_distincts"),
    )
    return by_query.join(kept, query, "left")


def coverage(queries: DataFrame, chunks: DataFrame, kept: DataFrame, query: str, query_text: str, key: str = "i", text: str = "texte", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Per query: how much of its tokens, weighted by idf, the corpus and the kept passages (`query`, `key`, `rang`) have.

    A token that the corpus lacks weighs as much as the rarest possible. Queries without tokens have 0 everywhere.
    """
    terms = cut(query_terms(queries, query, query_text, stop))
    both = cut(counted_for(chunks, key, text, terms, stop).select(key, "terme", "dl"))
    n = corpus_stats(both.where("terme is null")).first().n
    rows = both.where("terme is not null")
    df = small(cut(rows.groupBy("terme").agg(F.count(F.lit(1)).alias("df"))))
    w = terms.join(df, "terme", "left").withColumn("idf", idf(F.col("df"), n)).withColumn("poids", F.coalesce("idf", idf_ceiling(F.lit(n))))
    whole = w.groupBy(query).agg(F.count(F.lit(1)).alias("n_jetons"), F.count("idf").alias("n_presents"), F.sum("idf").alias("si"), F.sum("poids").alias("sp"), F.max("idf").alias("mi"))
    inside = kept.select(query, key, "rang").join(w.where("idf is not null"), query).join(rows, [key, "terme"], "left_semi")
    by_chunk = inside.groupBy(query, key, "rang").agg(F.sum("idf").alias("s"), F.max("idf").alias("m"))
    best = by_chunk.groupBy(query).agg(F.max("s").alias("s_max"), F.max(F.when(F.col("rang") == 1, F.col("s"))).alias("s_1"), F.max(F.when(F.col("rang") == 1, F.col("m"))).alias("m_1"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    out = queries.select(query).distinct().join(whole, query, "left").join(best, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        query,
        F.round(F.coalesce(F.try_divide(F.col("n_presents"), F.col("n_jetons")), F.lit(0.0)), 6).alias("jetons_couverts"),
        part("si", "sp").alias("idf_couvert_requete"),
        part("s_1", "si").alias("idf_couvert_retenu_1"),
        part("s_max", "si").alias("idf_couvert_max_retenus"),
        part("m_1", "mi").alias("idf_rare_dans_retenu_1"),
        zero("n_jetons").alias("n_jetons"),
        zero("n_presents").alias("n_jetons_dans_corpus"),
    )


def gate_value(statistic: Column, fallback: Column, names: tuple[str, ...]) -> Column:
    """The value of the statistic named by a column, or of the fallback where that is null."""
    pick = lambda name: F.coalesce(*[F.when(name == n, F.col(n)) for n in names])
    return F.coalesce(pick(statistic), pick(fallback))


def refused(value: Column, threshold: Column) -> Column:
    """Whether a question is refused: no value, or one below the threshold."""
    return F.coalesce(value < threshold, F.lit(True))
