"""Queries p1 to p8 over the project's tables, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import canon, cap, langid, mixture, split, subject, terms, tokens
from tamis.llm.oracle import ORACLE  # noqa: F401
from tamis.operators.delivery import first_delivery
from tamis.session import cut, read_table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of `chunks` and `qcm` with their labels: `origine`, `cle`, `langue`, `le`, `texte`."""
    tables = (("chunks", "i", "charge_le", "texte"), ("qcm", "ligne", "recu_le", "requete"))
    a, b = (read_table(spark, sf_dir, t).select(F.lit(t).alias("origine"), F.col(k).alias("cle"), "langue", F.col(at).alias("le"), F.col(x).alias("texte")) for t, k, at, x in tables)
    return a.unionByName(b)


def _languages(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return langid.languages(rows, "texte", ["origine", "cle", "langue", "le"], langid.train(_texts(spark, sf_dir), "texte", "langue"))


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, first_delivery(_texts(spark, sf_dir), ["origine", "cle"], "le"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = langid.mislabelled(_languages(spark, sf_dir, _texts(spark, sf_dir)), "langue").where("cle is not null")
    once = cases.groupBy("origine", "cle").agg(F.min_by(F.col("segments.langue"), F.coalesce("le", F.lit("9999-01-01").cast("timestamp"))).alias("langues"))
    return once.select("origine", "cle", F.posexplode("langues").alias("seg", "langue")).withColumn("seg", F.col("seg").cast("bigint"))


def _pieces(spark: SparkSession, sf_dir: str, rows: DataFrame, *more: str) -> DataFrame:
    rows = split.passages(rows, read_table(spark, sf_dir, "manifest"))
    return split.split_oversized(rows, "texte", "maxi", "mini", "chevauchement", ["i", "doc", "page", "charge_le", *more], "off", "cible")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").select("i", "doc", "page", "off", "texte", "lot", "charge_le")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, first_delivery(_passages(spark, sf_dir), ["i"], "charge_le"))


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized passage: pieces beyond its limit, the non-blank characters of the pieces' own parts, where these start and end."""
    own = F.substring("texte_morceau", (F.col("propre") - F.col("a") + 1).cast("int"), F.length("texte_morceau"))
    rows = _pieces(spark, sf_dir, first_delivery(_passages(spark, sf_dir), ["i"], "charge_le"), "maxi")
    return rows.groupBy("i", F.col("maxi").alias("limite")).agg(F.count_if(F.length("texte_morceau") > F.col("maxi")).alias("hors_limite"), F.sum(F.length(F.regexp_replace(own, r"(?U)\s+", ""))).alias("caracteres"), F.min("propre").alias("debut"), F.max("b").alias("fin"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _pieces(spark, sf_dir, _passages(spark, sf_dir)).groupBy("i", "charge_le").agg(F.max("forcee").alias("f"))
    return cases.groupBy("i").agg(F.min_by("f", F.coalesce("charge_le", F.lit("9999-01-01").cast("timestamp"))).alias("f")).select("i", F.when(F.col("f"), "forcee").otherwise("naturelle").alias("coupe"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`origine`, `cle`, `texte` of the two tables."""
    return _texts(spark, sf_dir).select("origine", "cle", "texte")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir)
    return canon.consistent(rows, "texte", "forme", canon.vocabulary(rows, "texte")).drop("texte")


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir)
    return cut(canon.same_look(rows, "cle", "texte", ["origine"], canon.vocabulary(rows, "texte")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.look_alike_pairs(_digests(spark, sf_dir), "cle", ["origine"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.look_alike_classes(_digests(spark, sf_dir), "cle", ["origine"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(read_table(spark, sf_dir, "chunks"), words=canon.vocabulary(_read(spark, sf_dir), "texte"))


def p5_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = partial(read_table, spark, sf_dir)
    return cap.cap_candidates(read("candidats"), read("chunks"), read("sources"), read("seuils"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_lists(spark, sf_dir).where("retire").select("ligne", "i")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


def _mixtures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = read_table(spark, sf_dir, "documents")
    levels = mixture.levels_of(documents, read_table(spark, sf_dir, "etiquettes"))
    return mixture.mixtures(documents, read_table(spark, sf_dir, "melange"), levels)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixtures(spark, sf_dir)[1].where("manque").select("melange", "source")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.select(*_mixtures(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, plan = _mixtures(spark, sf_dir)
    return mixture.shares(mixture.select(found, plan), plan)


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mixture and source: the target share, whether a document came out more often than allowed, whether the tokens that
    came out exceed the budget or miss it by more than the source's longest document."""
    found, plan = _mixtures(spark, sf_dir)
    got = mixture.select(found, plan).groupBy("melange", "source").agg(F.sum(F.col("jetons") * F.col("fois")).alias("sortis"), F.max("fois").alias("fois"))
    longest = found.groupBy("source").agg(F.max("jetons").alias("plus_long"))
    rows = plan.join(got, ["melange", "source"], "left").join(longest, "source", "left").na.fill(0, ["sortis", "fois", "plus_long"])
    off = (F.col("sortis") > F.col("budget") + 1e-3) | (F.col("sortis") < F.col("budget") - F.col("plus_long") - 1e-3)
    return rows.select("melange", "source", F.round("poids", 6).alias("part_cible"), (F.col("fois") > F.col("repetitions_max")).alias("trop_repete"), off.alias("hors_budget"))


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = subject.train(documents, read_table(spark, sf_dir, "etiquettes"), read_table(spark, sf_dir, "domaines"))
    return subject.subjects(documents, model, ["doc_id"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", F.explode("domaines").alias("d")).where("d.traite").select("doc_id", F.col("d.domaine").alias("domaine")).distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject.composition(p8_subjects(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_pieces, p2_check, p3_found, p3_forms, p3_classes, p4_found, p5_found, p5_lists, p6_ids, p7_found, p7_selection, p7_shares, p7_check, p8_found, p8_subjects, p8_composition)}
