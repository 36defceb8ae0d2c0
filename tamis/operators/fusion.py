"""Reciprocal-rank fusion, diversified selection and neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags of structural noise, demoted in the fusion.
DEMOTED = ("bibliographie", "sommaire", "mots_cles")


@dataclass(frozen=True)
class SearchParams:
    k_final: int = 8
    k_pool: int = 60
    max_per_doc: int = 3
    penalty: int = 5
    rrf_k: int = 60


def doc_key(doc: Column) -> Column:
    """One spelling for the ways a source's id is written: case, blanks around, hyphens and a file's ending set aside."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(doc, r"(?U)^\s+|\s+$", "")), "-", "_"), r"\.(pdf|txt)$", "")


def rrf(rank_a: Column, rank_b: Column, penalty: Column, k: int = 60) -> Column:
    """Sum of 1 / (k + rank + penalty) over the lists that have the row; null for no list."""
    term = lambda r: F.coalesce(1 / (F.lit(k) + r + penalty), F.lit(0.0))
    return F.when(rank_a.isNotNull() | rank_b.isNotNull(), term(rank_a) + term(rank_b))


def fuse(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, query: str, key: str = "i", params: SearchParams = SearchParams()) -> DataFrame:
    """Candidates of both ranked lists (`query`, `key`, `rang`, `score` / `cos`), of each the first `k_pool`, with their fused
    score. Any two lists will do."""
    lexical, dense = lexical.where(F.col("rang") <= params.k_pool), dense.where(F.col("rang") <= params.k_pool)
    a = lexical.select(query, key, F.col("rang").alias("rang_bm25"), F.col("score").alias("score_bm25"))
    b = dense.select(query, key, F.col("rang").alias("rang_dense"), "cos")
    both = a.join(b, [query, key], "full_outer").join(chunks.select(key, "doc", "off", "structure"), key, "left")
    pen = F.when(F.col("structure").isin(*DEMOTED), params.penalty).otherwise(0)
    return both.withColumn("penalite", pen).withColumn("rrf", rrf(F.col("rang_bm25"), F.col("rang_dense"), F.col("penalite"), params.rrf_k))


def select(candidates: DataFrame, query: str, params: SearchParams = SearchParams(), cap: str | None = None) -> DataFrame:
    """`query`, `retenus`, `ecartes`: greedy selection in order of (rrf desc, i asc; null scores last).

    A candidate is rejected if its offsets overlap those of one already kept in the same document, else if its document has
    already `max_per_doc` kept (or the number in the column `cap`; null: no cap); the selection stops at `k_final` kept,
    and what comes after isn't reported. Rejects have their `motif`. A candidate without document or offsets neither
    overlaps nor is capped. The fold's state depends on what was kept, so a query's pool is one array; candidates with ranks
    count only up to rank `k_pool` of a list, so that it holds two lists of `k_pool` at most.
    """
    if {"rang_bm25", "rang_dense"} <= set(candidates.columns):
        near = [F.coalesce(F.col(c) <= params.k_pool, F.lit(False)) for c in ("rang_bm25", "rang_dense")]
        candidates = candidates.where(near[0] | near[1] | (F.col("rang_bm25").isNull() & F.col("rang_dense").isNull()))
    c = candidates.select(
        query,
        F.struct((-F.coalesce("rrf", F.lit(-1.0))).alias("o"), "i", "doc", F.col("off.a").alias("a"), F.col("off.b").alias("b"), "rrf", "cos", (F.col(cap) if cap else F.lit(params.max_per_doc)).cast("int").alias("p")).alias("c"),
    )
    pools = c.groupBy(query).agg(F.sort_array(F.collect_list("c")).alias("pool"))
    kept = "array<struct<i: bigint, doc: string, a: bigint, b: bigint, rrf: double, cos: double>>"
    start = F.struct(F.array().cast(kept).alias("k"), F.array().cast("array<struct<i: bigint, motif: string>>").alias("e"))

    def step(s: Column, x: Column) -> Column:
        clash = F.filter(s.k, lambda r: (r.doc == x.doc) & (x.a < r.b) & (r.a < x.b))
        n = F.size(F.filter(s.k, lambda r: r.doc == x.doc))
        why = F.when(F.size(clash) > 0, F.concat(F.lit("chevauche i="), F.try_element_at(clash, F.lit(1)).i.cast("string"), F.lit(" (offsets)")))
        why = why.when(F.coalesce(n >= x.p, F.lit(False)), F.concat(F.lit("plafond "), x.p.cast("string"), F.lit("/document sur "), x.doc))
        row = F.struct(x.i.alias("i"), x.doc.alias("doc"), x.a.alias("a"), x.b.alias("b"), x.rrf.alias("rrf"), x.cos.alias("cos"))
        full, out = F.size(s.k) >= params.k_final, why.isNotNull()
        k = F.when(full | out, s.k).otherwise(F.array_append(s.k, row))
        e = F.when(full | ~out, s.e).otherwise(F.array_append(s.e, F.struct(x.i.alias("i"), why.alias("motif"))))
        return F.struct(k.alias("k"), e.alias("e"))

    folded = pools.select(query, F.aggregate("pool", start, step).alias("s"))
    return folded.select(query, F.col("s.k").alias("retenus"), F.col("s.e").alias("ecartes"))


def kept_rows(selection: DataFrame, query: str) -> DataFrame:
    """`query`, `i`, `rang` from 1, `doc`, `rrf`, `cos`."""
    return selection.select(query, F.posexplode("retenus").alias("p", "r")).select(query, F.col("r.i").alias("i"), (F.col("p") + 1).alias("rang"), F.col("r.doc").alias("doc"), F.col("r.rrf").alias("rrf"), F.col("r.cos").alias("cos"))


def restrict(kept: DataFrame, chunks: DataFrame, regime: str = "committed") -> DataFrame:
    """The kept rows whose passage is of a regime, their ranks as they were."""
    return kept.join(chunks.where(F.col("regime") == regime).select("i").distinct(), "i", "left_semi").select(*kept.columns)


def same_page_neighbours(chunks: DataFrame) -> DataFrame:
    """`i`, `avant`, `apres`: the passages i-1 and i+1 where they are of the same document and page, else null. They are
    met by number, so a document or page of any size is no hot key."""
    place = chunks.select("i", "doc", "page")
    here = place.where("i is not null and doc is not null and page is not null")
    at = lambda d, n: here.select((F.col("i") + d).alias("i"), "doc", "page", F.col("i").alias(n)).dropDuplicates(["i"])
    return place.join(at(1, "avant"), ["i", "doc", "page"], "left").join(at(-1, "apres"), ["i", "doc", "page"], "left").select("i", "avant", "apres")


def overlapping(a: Column, b: Column) -> Column:
    """Whether two structs (doc, a, b) overlap."""
    return F.coalesce((a.doc == b.doc) & (a.a < b.b) & (b.a < a.b), F.lit(False))
