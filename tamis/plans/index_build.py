"""Registry and raw texts to an index: pages, passages with provenance, postings, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import structure
from tamis.operators import audit, lexical, segment
from tamis.operators.prefix import global_index
from tamis.session import cut


@dataclass
class Index:
    chunks: DataFrame
    documents: DataFrame
    postings: DataFrame
    lengths: DataFrame


def build(registry: DataFrame, texts: DataFrame, target: int = 700, most: int = 955, least: int = 220, overlap: int = 1) -> Index:
    """The index of the registry's indexed sources. `texts`: `fichier` (the source's id with .txt) and `text`.

    Passages are numbered in order of (source, page, offset), by range partitions and their sizes.
    """
    keep = audit.perimeter(registry).where("etat = 'indexe'").select("id")
    reg = registry.join(keep, "id", "left_semi").dropDuplicates(["id"])
    docs = cut(texts.withColumn("id", F.regexp_replace("fichier", r"\.txt$", "")).join(keep, "id", "left_semi"))
    packed = cut(segment.pack(segment.page_segments(docs, "id", "text"), ["id", "page"], "texte", "a", target, most, least, overlap))
    sizes = packed.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"))
    rows = global_index(packed, ["id", "page", "a"], "i")
    heads = segment.headers(docs, "id", "text")
    meta = reg.join(heads.select("id", "entete"), "id", "left")
    given = lambda c: F.coalesce(F.col(c), F.col("entete")[c], F.lit(""))
    chunks = rows.join(meta, "id").select("i", F.col("id").alias("doc"), *[given(c).alias(c) for c in ("titre", "editeur", "annee", "langue")], "licence", "regime", "page", F.coalesce(F.col("entete")["citation_verbatim_autorisee"], F.lit("")).alias("citation_verbatim_autorisee"), "sujet", "portee", "utilite_conseil", F.struct("a", "b").alias("off"), F.length("texte").alias("car"), structure(F.col("texte")).alias("structure"), "texte")
    chunks = cut(chunks)
    documents = heads.join(sizes, "id", "left").join(docs.select("id", F.sha2("text", 256).alias("sha256_txt"), F.length("text").alias("car_txt"), F.col("fichier").alias("chemin_txt")), "id")
    return Index(chunks, documents, lexical.postings(chunks, "i", "texte"), lexical.lengths(chunks, "i", "texte"))
