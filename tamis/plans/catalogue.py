"""Queries of the core over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.functions.rulepack import DEFAULT_PACK
from tamis.operators import audit, dense, evaluate, fusion, gate, lexical, policy, segment
from tamis.operators.delivery import among, first_delivery
from tamis.plans.oracle import ORACLE, QUESTION  # noqa: F401
from tamis.session import cut, read_table, small

FLAGSHIP = "hybrid_live"


def _once(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """The rows of a table, each once though delivered again."""
    key, by = {"chunks": (["i"], "charge_le"), "qcm": (["ligne"], "recu_le"), "candidats": (["ligne", "i"], "calcule_le")}[table]
    df = read_table(spark, sf_dir, table)
    return first_delivery(df.select(*dict.fromkeys([*key, by, *cols])) if cols else df, key, by, key_rows=df)


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates with document, offsets and cap, selection) of every question."""
    cands = _once(spark, sf_dir, "candidats")
    docs = _once(spark, sf_dir, "chunks", "doc", "off").select("i", fusion.doc_key(F.col("doc")).alias("doc"), "off")
    caps = read_table(spark, sf_dir, "seuils").select("calib", F.col("parametres_retrieve_au_moment_.max_par_doc").alias("plafond")).dropDuplicates(["calib"])
    rows = cut(cands.drop("calcule_le").join(docs, "i", "left").join(caps, "calib", "left"))
    return rows, fusion.select(rows, "ligne", cap="plafond")


def perimeter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.perimeter_counts(read_table(spark, sf_dir, "sources"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(_once(spark, sf_dir, "chunks", "texte"), "i", "texte"))


def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lexical.corpus_stats(lexical.lengths(_once(spark, sf_dir, "chunks", "texte"), "i", "texte"))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(0, QUESTION)], "ligne bigint, requete string")
    return lexical.search(_once(spark, sf_dir, "chunks", "texte"), q, "i", "texte", "ligne", "requete")


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _once(spark, sf_dir, "qcm", "requete").where("ligne % 100 = 0")
    return lexical.search(_once(spark, sf_dir, "chunks", "texte"), q, "i", "texte", "ligne", "requete")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    return dense.search(v, q, "vec_id", "embedding", "q", "e", k=10, itself=False)


def dense_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"), F.col("label").alias("l"))
    return dense.margins_each(v, q, "vec_id", "embedding", "label", "q", "e", "l")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _once(spark, sf_dir, "candidats")
    return c.select("ligne", "i", F.round(fusion.rrf(F.col("rang_bm25"), F.col("rang_dense"), F.coalesce("penalite", F.lit(0))), 6).alias("rrf_recalcule"))


def hybrid_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.kept_rows(_stats(spark, sf_dir)[1], "ligne").select("ligne", "i", F.col("rang").cast("bigint").alias("rang"), "rrf")


def hybrid_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)[1].select("ligne", F.explode("ecartes").alias("e")).select("ligne", "e.i", "e.motif")


def hybrid_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fusion.kept_rows(_stats(spark, sf_dir)[1], "ligne").select("ligne", "i", F.col("rang").cast("bigint").alias("rang"))
    return fusion.restrict(kept, _once(spark, sf_dir, "chunks", "regime"))


def _live(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Fused candidates from texts and vectors, of every question: BM25 over all passages, inner products over all passages that
    have a vector. The tables hold no vectors of questions; that of number `ligne` stands for them."""
    q = _once(spark, sf_dir, "qcm", "requete").select("ligne", "requete")
    q = q if every == 1 else q.where(F.col("ligne") % every == 0)
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "embedding")
    chunks = _once(spark, sf_dir, "chunks", "doc", "off", "texte").select("i", fusion.doc_key(F.col("doc")).alias("doc"), "off", "texte")
    words = lexical.search(chunks, q, "i", "texte", "ligne", "requete")
    near = dense.search(v, q.select("ligne").join(v.withColumnRenamed("i", "ligne"), "ligne"), "i", "embedding", "ligne", "embedding")
    found = cut(words.select("ligne", "i", "rang", "score")), cut(near.select("ligne", "i", "rang", "cos"))
    ids = cut(found[0].select("i").union(found[1].select("i")).distinct())
    places = among(chunks, "i", ids).select("i", "doc", "off", tx.structure(F.col("texte")).alias("structure")).join(small(ids), "i")
    return cut(fusion.fuse(*found, places, "ligne"))


def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("ligne", "i", "rang_bm25", "rang_dense", "penalite", F.round("rrf", 6).alias("rrf"))


def hybrid_live(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    kept = fusion.kept_rows(fusion.select(_live(spark, sf_dir, every), "ligne"), "ligne")
    return kept.select("ligne", "i", F.col("rang").cast("bigint").alias("rang"), "doc", F.round("rrf", 6).alias("rrf"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.id_check(read_table(spark, sf_dir, "chunks"))


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scope_check(read_table(spark, sf_dir, "sources"))


def gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.score_statistics(*_stats(spark, sf_dir), "ligne")


def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir, *_stats(spark, sf_dir))


def _decisions(spark: SparkSession, sf_dir: str, rows: DataFrame, selection: DataFrame) -> DataFrame:
    s = gate.score_statistics(rows, selection, "ligne").join(rows.select("ligne", "calib").distinct(), "ligne")
    names = ("cos_top1_dense", "cos_du_retenu_1", "cos_max_retenus")
    s = s.join(read_table(spark, sf_dir, "seuils").select("calib", "porte_niveau_2_contre_3.*"), "calib", "left")
    value = gate.gate_value(F.col("statistique"), F.col("repli_si_absente"), names)
    return s.select("ligne", value.alias("valeur"), "seuil", gate.refused(value, F.col("seuil")).alias("refus"))


def idf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _once(spark, sf_dir, "qcm", "requete")
    kept = cut(fusion.kept_rows(_stats(spark, sf_dir)[1], "ligne"))
    return gate.coverage(q, _once(spark, sf_dir, "chunks", "texte"), kept, "ligne", "requete")


def structure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "chunks", "texte").select("i", tx.structure(F.col("texte")).alias("etiquette"))


def structure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").groupBy("structure").agg(F.count_distinct("i").alias("n"))


def citation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "chunks", "texte").select("i", F.posexplode(tx.units(F.col("texte"))).alias("rang", "unite")).withColumn("rang", F.col("rang").cast("bigint"))


def citations_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _once(spark, sf_dir, "chunks", "texte").select("i", "texte", F.explode(tx.units(F.col("texte"))).alias("u")).withColumn("c", tx.truncate(F.col("u")))
    return u.groupBy("i").agg(F.count(F.lit(1)).alias("unites"), F.count_if("c.tronquee").alias("tronquees"), F.max(F.length("c.verbatim")).cast("bigint").alias("plus_longue"), F.count_if(tx.is_verbatim(F.col("c.verbatim"), F.col("texte"))).alias("verbatim"), F.count_if(tx.is_table_line(F.col("u"))).alias("lignes_de_tableau"))


def same_page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _once(spark, sf_dir, "chunks", "doc", "page")
    return fusion.same_page_neighbours(c.withColumn("doc", fusion.doc_key(F.col("doc"))))


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _once(spark, sf_dir, "chunks", "doc", "off").where("doc is not null")
    return audit.interval_coverage(c.select(fusion.doc_key(F.col("doc")).alias("source"), "off.*"), "source", "a", "b")


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chunk_sizes(_once(spark, sf_dir, "chunks", "texte", "lot"), "lot")


def provenance_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ("titre", "editeur", "annee", "licence", "regime", "sujet", "portee", "utilite_conseil")
    return audit.provenance_mismatches(_once(spark, sf_dir, "chunks", "doc", *f), read_table(spark, sf_dir, "sources"), f)


def offset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.offset_check(_once(spark, sf_dir, "chunks", "off", "car", "texte"))


def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _once(spark, sf_dir, "chunks", "doc", "page", "texte")
    return audit.shared_edges(c.withColumn("doc", fusion.doc_key(F.col("doc"))))


def sources_without_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = read_table(spark, sf_dir, "chunks").where("doc is not null").select(fusion.doc_key(F.col("doc")).alias("k"))
    return audit.id_difference(read_table(spark, sf_dir, "sources").where("id is not null").select("id"), have)


def value_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = policy.unit_table(_once(spark, sf_dir, "chunks", "texte"))
    return policy.value_hits(u, DEFAULT_PACK).groupBy("type").agg(F.count(F.lit(1)).alias("unites"), F.sum(F.size("valeurs")).alias("valeurs"), F.count_distinct("i").alias("passages"))


def demand_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.demands(_once(spark, sf_dir, "qcm", "requete"), "ligne", "requete").select("ligne", "ordre", "type")


def entities_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _once(spark, sf_dir, "qcm", "requete")
    return q.where("requete is not null").select("ligne", F.posexplode(policy.entities_by_position(F.col("requete"), DEFAULT_PACK)).alias("rang", "entite")).withColumn("rang", F.col("rang").cast("bigint"))


def answer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_plan(spark, sf_dir).select("ligne", "niveaux", F.size("demandes").cast("bigint").alias("n_demandes"), "appels_generateur")


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.cited(*_asked(spark, sf_dir))
    return found.select("ligne", "type", "cible", F.lit(1).alias("niveau"), F.explode("citations").alias("c")).select("ligne", "type", "cible", "niveau", "c.*")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, kept passages, decisions, passages), as the policy takes them."""
    chunks = _once(spark, sf_dir, "chunks", "doc", "page", "titre", "editeur", "annee", "langue", "licence", "regime", "citation_verbatim_autorisee", "texte")
    chunks = cut(chunks.withColumn("doc", fusion.doc_key(F.col("doc"))).drop("charge_le"))
    rows, selection = _stats(spark, sf_dir)
    selection = cut(selection)
    kept = cut(fusion.kept_rows(selection, "ligne").select("ligne", "i", "rang", "cos"))
    return _once(spark, sf_dir, "qcm", "requete").select("ligne", "requete"), kept, cut(_decisions(spark, sf_dir, rows, selection)), chunks


def policy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.analyse(*_asked(spark, sf_dir))


def recall_at_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, selection = _stats(spark, sf_dir)
    kept = fusion.kept_rows(selection, "ligne").select("ligne", "i", F.col("rang").alias("rang_rrf"))
    truth = _once(spark, sf_dir, "qcm", "bons").select("ligne", F.explode("bons").alias("i"))
    ranked = rows.join(kept, ["ligne", "i"], "left")
    return evaluate.recall_at_k(ranked, truth, "ligne", "i", {"bm25": "rang_bm25", "dense": "rang_dense", "rrf": "rang_rrf"})


def _gate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gate.score_statistics(*_stats(spark, sf_dir), "ligne").select("ligne", "cos_du_retenu_1")
    q = _once(spark, sf_dir, "qcm", "niveau_attendu").select("ligne", (~F.array_contains(tx.levels(F.col("niveau_attendu")), 3)).alias("agricole"))
    return s.join(q, "ligne")


def gate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_gate_labels(spark, sf_dir), "cos_du_retenu_1", "agricole")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(_gate_labels(spark, sf_dir), "cos_du_retenu_1", "agricole")


def expected_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "qcm", "niveau_attendu").groupBy(tx.levels(F.col("niveau_attendu")).alias("n")).agg(F.count(F.lit(1)).alias("questions")).select(F.array_join(F.col("n").cast("array<string>"), "+").alias("niveaux"), "questions")


def int8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.int8_error(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.norm_deviation(read_table(spark, sf_dir, "embeddings"), "embedding")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "chunks").select("texte", "lot")
    return audit.cache_misses(c, c.where("lot <= 4"), "texte")


def run_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dispersion(read_table(spark, sf_dir, "events"), "event_type", "value")


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.page_segments(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.headers(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.explode("entete").alias("cle", "valeur"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.pack(segment.page_segments(read_table(spark, sf_dir, "documents"), "doc_id", "text"), ["doc_id", "page"], "texte", "a")


_ALL = (perimeter_counts, scope_check, chunk_ids, hybrid_committed, bm25_term_stats, bm25_corpus_stats, bm25_topk, bm25_batch, dense_topk, dense_margins, hybrid_rrf, hybrid_fused, hybrid_live, hybrid_selected, hybrid_rejected, gate_stats, gate_decisions, idf_coverage, structure_tags, structure_histogram, citation_units, citations_truncated, same_page_neighbours, interval_coverage, chunk_sizes, provenance_mismatches, offset_check, shared_edges, sources_without_chunks, value_pattern_hits, demand_routing, entities_in_questions, answer_reports, answer_citations, recall_at_8, gate_auc, threshold_sweep, expected_levels, int8_error, norm_check, cache_misses, run_dispersion, page_segments, document_headers, packed_chunks)


QUERIES = {f.__name__: f for f in _ALL}
