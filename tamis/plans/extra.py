"""Further queries of the core, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.functions.rulepack import ENTITIES
from tamis.operators import audit, dense, evaluate, fusion, lexical, policy, segment
from tamis.operators.prefix import global_index
from tamis.plans import catalogue as base
from tamis.plans.oracle import CHUNKS, GATE, LABELLED, PERIMETER, QCM, TOKENS, WS, bm25, doc_key, lit, norm
from tamis.session import read_table, shared_folder

NEEDLES = ("licence", "mil ", "total")


def perimeter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.perimeter_overlap(read_table(spark, sf_dir, "sources"))


def perimeter_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.perimeter(read_table(spark, sf_dir, "sources"))


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_batch by an index that is written first."""
    at = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    lexical.write_index(base._once(spark, sf_dir, "chunks", "texte"), "i", "texte", at, buckets=16, parts=2)
    return lexical.search_index(spark, at, base._once(spark, sf_dir, "qcm", "requete").where("ligne % 100 = 0"), "ligne", "requete")


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = lexical.posting_lists(lexical.postings(base._once(spark, sf_dir, "chunks", "texte"), "i", "texte"), "i", 1_000)
    return lists.select("terme", "bloc", F.array_join(F.transform("liste", lambda x: F.concat(x.i.cast("string"), F.lit(":"), x.tf.cast("string"))), ",").alias("liste"))


def passage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense number of the passages by source, page and key."""
    c = base._once(spark, sf_dir, "chunks", "doc", "page").select("i", fusion.doc_key(F.col("doc")).alias("doc"), "page")
    return global_index(c, [F.col("doc").asc_nulls_first(), F.col("page").asc_nulls_first(), F.col("i").asc_nulls_first()], "numero").select("i", "numero")


def page_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base._once(spark, sf_dir, "chunks", "doc", "page").select("i", fusion.doc_key(F.col("doc")).alias("source"), "page")
    return audit.page_order(c, "source", "i", "page")


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the vector of their number: its length and first coordinate."""
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.size("embedding").cast("bigint").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("premiere"))
    return base._once(spark, sf_dir, "chunks", "page").select("i", "page").join(v, "i")


def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings")
    first = v.where("vec_id = 0").select("embedding").first()
    return dense.all_cosines(v, first.embedding if first else [], "vec_id", "embedding")


def gate_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.zero_leak(base._gate_labels(spark, sf_dir), "cos_du_retenu_1", "agricole")
    return found.select("plancher", "plafond", "refuses", "sur", F.round("milieu", 4).alias("milieu"))


def gate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions the gate alone levels as labelled: 3 if refused, else 2."""
    found = base.gate_decisions(spark, sf_dir).select("ligne", F.array(F.when(F.col("refus"), 3).otherwise(2)).alias("niveaux"))
    labels = base._once(spark, sf_dir, "qcm", "niveau_attendu").where("niveau_attendu is not null").select("ligne", tx.levels(F.col("niveau_attendu")).alias("niveaux"))
    return evaluate.label_replay(found, labels, "ligne")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.lines_with(read_table(spark, sf_dir, "documents"), "doc_id", "text", list(NEEDLES), "=== ", "=== TEXTE ===")
    return found.withColumn("ligne", F.col("ligne").cast("bigint"))


def seen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_segments with page lines however they are typed."""
    return segment.page_segments(read_table(spark, sf_dir, "documents"), "doc_id", "text", marker=segment.SEEN_MARKER)


def seen_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentinel_lines(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def resolved_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """same_page_neighbours, checked by SQL that resolves the source too."""
    return base.same_page_neighbours(spark, sf_dir)


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shared_edges, checked by SQL that resolves the source and counts all passages."""
    return base.shared_edges(spark, sf_dir)


def exact_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threshold_sweep, checked by SQL on unrounded scores."""
    return base.threshold_sweep(spark, sf_dir)


def margins_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dense_margins, checked by SQL for every query."""
    return base.dense_margins(spark, sf_dir)


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the citations of all questions, by kind: not in the passage's text, more than two and one sewn on, of a passage
    neither kept nor beside a kept one, longer than 300 characters."""
    questions, kept, decisions, chunks = base._asked(spark, sf_dir)
    found = policy.cited(questions, kept, decisions, chunks)
    c = found.select("ligne", "ordre", F.explode("citations").alias("c")).select("ligne", "ordre", "c.*")
    c = c.join(chunks.select(F.col("i").alias("chunk"), "texte"), "chunk", "left").join(kept.select("ligne", F.col("i").alias("chunk"), F.lit(True).alias("k1")), ["ligne", "chunk"], "left")
    c = c.join(kept.select("ligne", F.col("i").alias("couture_de"), F.lit(True).alias("k2")), ["ligne", "couture_de"], "left")
    out = F.coalesce(F.when(F.col("couture_de").isNull(), F.col("k1")).otherwise(F.col("k2")), F.lit(False))
    a = c.agg(F.count_if(~F.coalesce(tx.is_verbatim(F.col("citation"), F.col("texte")), F.lit(False))).alias("non_textuelles"), F.count_if(~out).alias("hors_retenus"), F.count_if(F.length("citation") > 300).alias("trop_longues"))
    b = found.agg(F.count_if((F.size(F.filter("citations", lambda x: x.couture_de.isNull())) > 2) | (F.size(F.filter("citations", lambda x: x.couture_de.isNotNull())) > 1)).alias("trop_nombreuses"))
    return a.crossJoin(b)


def _position(text: str, name: str) -> str:
    """SQL of the place of an entity's first mention in `text`, null if there is none."""
    e, folded = ENTITIES[name], f"translate(lower({text}), {lit(tx.FOLD_FROM)}, {lit(tx.FOLD_TO)})"
    at = lambda t, p: f"CASE WHEN regexp_matches({t}, {lit(p)}) THEN length(regexp_extract({t}, {lit('(?s)^(.*?)' + p)}, 1)) END"
    edge = lambda t, w, out: at(f"' ' || {t} || ' '", f"{out}(?:{w}){out}")
    ways = [edge(folded, "|".join(map(tx.fold_word, e["tokens"])), "[^0-9a-z]")] if e["tokens"] else []
    latin = e["latin"].replace(r"\s", WS)
    ways.append(at(text, "(?i:" + latin + ")"))
    if name == "mais":
        word = r"[^\p{L}\p{N}_]"
        ways += [at(text, "(?i:ma[ïÏ]s)"), edge(text, "(?i:maize)", word), edge(text, rf"(?i:le|du|de|au|sur{WS}+le|pour{WS}+le|mon|ce|un|des){WS}+(?i:ma[iï]s)", word)]
    return "least(" + ", ".join(ways) + ")"


_MARK = segment.SEEN_MARKER.replace("(?md)", "(?m)")
_PAGES = rf"""p AS (SELECT doc_id, regexp_split_to_array(text, {lit(_MARK)}) AS p, regexp_extract_all(text, {lit(_MARK)}) AS m FROM documents WHERE text IS NOT NULL),
  x AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS k FROM p WHERE len(m) > 0),
  y AS (SELECT doc_id, CAST(regexp_replace(translate(m[k], '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') AS INTEGER) AS page, p[k + 1] AS raw, list_sum(list_transform(p[1:k], lambda v: length(v))) + list_sum(list_transform(m[1:k], lambda v: length(v))) AS s FROM x),
  z AS (SELECT doc_id, page, s + length(raw) - length(regexp_replace(raw, '^{WS}+', '')) AS a, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS texte FROM y)"""
_SENTINEL = segment.SEEN_SENTINEL.replace("(?md)", "(?m)")

ORACLE = {
    "perimeter_sets": "WITH s AS (SELECT id, bool_or(coalesce(trim(exclusion) <> '', false)) AS x, bool_or(coalesce(utilite_conseil = 'methodologique', false)) AS m FROM sources WHERE id IS NOT NULL GROUP BY 1), e AS (SELECT 'sources' AS etat, count(*) AS n FROM s UNION ALL SELECT 'methodologique', count(*) FILTER (m) FROM s UNION ALL SELECT 'exclu', count(*) FILTER (x) FROM s UNION ALL SELECT 'indexe', count(*) FILTER (NOT x AND NOT m) FROM s) SELECT * FROM e WHERE n > 0",
    "perimeter_members": f"SELECT DISTINCT id, {PERIMETER} AS etat FROM sources WHERE id IS NOT NULL",
    "bm25_indexed": bm25("SELECT ligne, requete FROM qcm_1 WHERE ligne % 100 = 0"),
    "bm25_postings": f"WITH {CHUNKS}, {TOKENS} SELECT terme, CAST(floor(i / 1000) AS BIGINT) AS bloc, string_agg(i || ':' || tf, ',' ORDER BY i) AS liste FROM tf GROUP BY 1, 2",
    "passage_order": f"WITH {CHUNKS} SELECT i, row_number() OVER (ORDER BY {doc_key('doc')} NULLS FIRST, page NULLS FIRST, i NULLS FIRST) - 1 AS numero FROM chunks_1",
    "page_reversals": f"WITH {CHUNKS}, x AS (SELECT {doc_key('doc')} AS source, page, lag(page) OVER (PARTITION BY {doc_key('doc')} ORDER BY i) AS avant FROM chunks_1 WHERE doc IS NOT NULL AND page IS NOT NULL) SELECT source, count(*) FILTER (page < avant) AS reculs FROM x GROUP BY 1",
    "passage_vectors": f"WITH {CHUNKS} SELECT i, page, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS premiere FROM chunks_1 JOIN embeddings ON vec_id = i",
    "cosines": "SELECT v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cos FROM embeddings v, embeddings q WHERE q.vec_id = 0",
    "gate_trough": LABELLED + ", h AS (SELECT max(c) AS plancher FROM lab WHERE NOT pos) SELECT plancher, min(c) FILTER (c > plancher) AS plafond, count(*) FILTER (c <= plancher) AS refuses, count(*) AS sur, round((plancher + min(c) FILTER (c > plancher)) / 2, 4) AS milieu FROM lab, h WHERE pos GROUP BY plancher",
    "gate_replay": GATE + f""", {QCM}, v AS (SELECT ligne, porte.seuil AS seuil, coalesce(CASE porte.statistique WHEN 'cos_top1_dense' THEN cos_top1_dense WHEN 'cos_du_retenu_1' THEN cos_du_retenu_1 WHEN 'cos_max_retenus' THEN cos_max_retenus END, CASE porte.repli_si_absente WHEN 'cos_top1_dense' THEN cos_top1_dense WHEN 'cos_du_retenu_1' THEN cos_du_retenu_1 WHEN 'cos_max_retenus' THEN cos_max_retenus END) AS valeur FROM g),
      d AS (SELECT ligne, CASE WHEN coalesce(valeur < seuil, true) THEN '3' ELSE '2' END AS n FROM v) SELECT count(*) AS questions, count(*) FILTER (n = niveau_attendu) AS justes FROM qcm_1 LEFT JOIN d USING (ligne) WHERE niveau_attendu IS NOT NULL""",
    "numbered_lines": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, k AS ligne, ls[k] AS l, list_max(list_filter(range(1, k + 1), lambda j: contains(ls[j], '=== '))) AS o, list_max(list_filter(range(1, k), lambda j: contains(ls[j], '=== TEXTE ==='))) AS f FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM l))
      SELECT doc_id, ligne, mot FROM n, (SELECT unnest([{', '.join(map(lit, NEEDLES))}]) AS mot) WHERE (o IS NULL OR coalesce(f >= o, false)) AND contains(lower(l), mot)""",
    "seen_pages": f"WITH {_PAGES} SELECT doc_id, page, CAST(a AS BIGINT) AS a, CAST(a + length(texte) AS BIGINT) AS b, texte FROM z WHERE length(texte) >= 40",
    "seen_sentinels": f"SELECT doc_id, length(regexp_split_to_array(text, {lit(_SENTINEL)})[1]) + length(regexp_extract(text, {lit(_SENTINEL)})) AS corps FROM documents WHERE regexp_matches(text, {lit(_SENTINEL)})",
    "resolved_neighbours": f"WITH {CHUNKS}, k AS (SELECT i, {doc_key('doc')} AS doc, page FROM chunks_1) SELECT c.i, p.i AS avant, n.i AS apres FROM k c LEFT JOIN k p ON p.i = c.i - 1 AND p.doc = c.doc AND p.page = c.page LEFT JOIN k n ON n.i = c.i + 1 AND n.doc = c.doc AND n.page = c.page",
    "resolved_edges": f"""WITH {CHUNKS}, x AS (SELECT i, {doc_key('doc')} AS doc, page, {norm('texte')} AS t FROM chunks_1 WHERE doc IS NOT NULL AND page IS NOT NULL AND texte IS NOT NULL),
      y AS (SELECT c.i, coalesce(contains(p.t, right(c.t, 60)), false) OR coalesce(contains(n.t, right(c.t, 60)), false) AS q, coalesce(contains(p.t, left(c.t, 60)), false) OR coalesce(contains(n.t, left(c.t, 60)), false) AS h FROM x c LEFT JOIN x p ON p.i = c.i - 1 AND p.doc = c.doc AND p.page = c.page LEFT JOIN x n ON n.i = c.i + 1 AND n.doc = c.doc AND n.page = c.page WHERE c.t <> '')
      SELECT (SELECT count(*) FROM chunks_1) AS n, count(*) FILTER (q) AS queue, count(*) FILTER (h) AS tete, count(*) FILTER (q OR h) AS "union" FROM y""",
    "exact_thresholds": LABELLED + ", x AS (SELECT DISTINCT c AS seuil FROM lab) SELECT seuil, (SELECT count(*) FROM lab WHERE pos AND c < seuil) AS faux_refus, (SELECT count(*) FROM lab WHERE NOT pos AND c >= seuil) AS fuites FROM x",
    "margins_of_queries": """WITH c AS (SELECT q.vec_id AS q, coalesce(v.label = q.label, false) AS r, v.label = q.label AS r3, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cos FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id), b AS (SELECT q, max(cos) FILTER (r) AS best FROM c GROUP BY 1)
      SELECT q, round(max(cos) FILTER (r) - max(cos) FILTER (NOT r3), 6) AS marge, round(median(cos) FILTER (r) - median(cos) FILTER (NOT r3), 6) AS marge_medianes, count(*) FILTER (cos > best) + 1 AS rang_premier FROM c JOIN b USING (q) GROUP BY 1""",
    "citation_check": "SELECT CAST(0 AS BIGINT) AS non_textuelles, CAST(0 AS BIGINT) AS hors_retenus, CAST(0 AS BIGINT) AS trop_longues, CAST(0 AS BIGINT) AS trop_nombreuses",
    "entities_in_questions": f"WITH {QCM}, p AS (" + " UNION ALL ".join(f"SELECT ligne, '{n}' AS entite, {_position('requete', n)} AS place FROM qcm_1 WHERE requete IS NOT NULL" for n in ENTITIES) + ") SELECT ligne, row_number() OVER (PARTITION BY ligne ORDER BY place, entite) - 1 AS rang, entite FROM p WHERE place IS NOT NULL",
}

_ALL = (perimeter_sets, perimeter_members, bm25_indexed, bm25_postings, passage_order, page_reversals, passage_vectors, cosines, gate_trough, gate_replay, numbered_lines, seen_pages, seen_sentinels, resolved_neighbours, resolved_edges, exact_thresholds, margins_of_queries, citation_check)

QUERIES = {f.__name__: f for f in _ALL}
