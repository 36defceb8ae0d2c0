"""Sinks: JSON lines with sorted keys, one-document JSON, encoded vectors, a resumable vector cache, the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.rulepack import STOP_WORDS
from tamis.functions.vectors import to_int8
from tamis.operators.audit import below_minimum, cache_misses, perimeter
from tamis.session import cut


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys sorted, UTF-8, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_document(rows: dict, path: str) -> None:
    """A small document, keys sorted, indented by one."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(rows, f, ensure_ascii=False, sort_keys=True, indent=1)
        f.write("\n")


def vectors(df: DataFrame, path: str, vector: str = "embedding", dtype: str = "float32") -> None:
    """Vectors as float32 or, in 127 levels on each side, as int8."""
    if dtype not in ("float32", "int8"):
        raise ValueError(dtype)
    v = to_int8(F.col(vector)) if dtype == "int8" else F.col(vector).cast("array<float>")
    df.withColumn(vector, v).write.mode("overwrite").parquet(path)


def embed_missing(texts: DataFrame, text: str, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, pooling: str = "cls") -> None:
    """Appends the vectors of the texts that the cache (`cle`, `text`, vector) doesn't have. `embed` turns (cle, text) rows
    into (cle, text, embedding) rows; a run that ended halfway goes on where it stopped, as what is there isn't asked again."""
    key = F.sha2(F.concat_ws("|", F.lit(pooling), F.octet_length(text).cast("string"), F.col(text)), 256)
    new = texts.where(F.col(text).isNotNull()).select(key.alias("cle"), F.col(text)).dropDuplicates(["cle"])
    embed(new.join(cut(cache_misses(texts, cache, text, pooling)), "cle", "left_semi")).write.mode("append").parquet(path)


def manifest(chunks: DataFrame, terms: DataFrame, corpus: DataFrame, least: int = 220, sources: DataFrame | None = None, embedding: dict | None = None) -> DataFrame:
    """One row on what was built: passages and their sizes, `ids_sous_mini` (sorted `doc:pN` of those below `least`), terms,
    mean length, the stop list's digest; `perimetre` (state -> sources of the registry `sources`) and `embeddings` (identity
    of the embedder as given: model, dimension, pooling, digest), null where not given."""
    n = F.length("texte")
    c = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("car_total"), F.min(n).alias("car_min"), F.floor(F.median(n)).alias("car_median"), F.round(F.avg(n), 1).alias("car_moyen"), F.max(n).alias("car_max"), F.count_if(n < least).alias("sous_mini"), F.count_distinct("doc").alias("documents")).first().asDict()
    t, s = terms.count(), corpus.first()
    row = {**c, "n_termes": t, "avgdl": round(s.avgdl, 1), "liste_arret_n": len(STOP_WORDS)}
    df = chunks.sparkSession.createDataFrame([tuple(row.values())], list(row))
    df = df.withColumn("liste_arret_sha", F.left(F.sha2(F.lit(",".join(sorted(STOP_WORDS))), 256), F.lit(16)))
    df = df.crossJoin(below_minimum(chunks, least).agg(F.sort_array(F.collect_list("id")).alias("ids_sous_mini")))
    states = perimeter(sources).groupBy("etat").agg(F.count(F.lit(1)).alias("n")).collect() if sources is not None else []
    counts = F.create_map(*[F.lit(x) for r in sorted(states) for x in (r.etat, r.n)]) if states else F.lit(None).cast("map<string, bigint>")
    who = F.create_map(*[F.lit(str(x)) for kv in sorted(embedding.items()) for x in kv]) if embedding else F.lit(None).cast("map<string, string>")
    return df.withColumns({"perimetre": counts, "embeddings": who})
