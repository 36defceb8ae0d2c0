"""SQL of the core's queries, for DuckDB on the same tables. It shares constants with the engine, not logic."""

from __future__ import annotations

from tamis.functions import text as tx
from tamis.functions.rulepack import DEMANDS, STOP_WORDS, UPPER

QUESTION = "À quelle période faut-il semer le mil, et avec quel cumul de pluie ?"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: White space as the engine sees it, for RE2.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNKS = "chunks_1 AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY i ORDER BY charge_le) = 1)"
QCM = "qcm_1 AS (SELECT * FROM qcm QUALIFY row_number() OVER (PARTITION BY ligne ORDER BY recu_le) = 1)"
CAND = "cand_1 AS (SELECT * FROM candidats QUALIFY row_number() OVER (PARTITION BY ligne, i ORDER BY calcule_le) = 1)"


def fold(x: str) -> str:
    out = f"lower({x})"
    for a, b in tx.FOLD_LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, {lit(tx.FOLD_FROM + tx.FOLD_DROP)}, {lit(tx.FOLD_TO)})"


def tokens(x: str) -> str:
    stop = "[" + ", ".join(map(lit, STOP_WORDS)) + "]"
    pieces = "list_filter(string_split(t, '-'), lambda p: length(p) >= 2 OR regexp_matches(p, '^[0-9]+$'))"
    both = f"flatten(list_transform(regexp_extract_all({fold(x)}, {lit(tx.TOKEN)}), lambda t: CASE WHEN contains(t, '-') THEN list_concat([t], {pieces}) ELSE {pieces} END))"
    return f"list_filter({both}, lambda t: NOT list_contains({stop}, t))"


def wide(p: str) -> str:
    """A pattern whose white space and word characters are Unicode's, for RE2."""
    return p.replace(r"\s", WS).replace(r"\w", r"[\p{L}\p{N}_]")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def doc_key(x: str) -> str:
    return rf"regexp_replace(replace(lower({strip(x)}), '-', '_'), '\.(pdf|txt)$', '')"


def units(x: str) -> str:
    lines = f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"
    joined = rf"regexp_replace({lines}, '\n([\p{{Ll}}\p{{Nd}}(,;)’''])', ' \1', 'g')"
    bare = rf"regexp_replace({joined}, '(^|\n)[-•*▪][ \t]*', '\1', 'g')"
    cut = rf"regexp_replace({bare}, '([.!?]){WS}+([{UPPER}])', '\1' || chr(10) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(10)), lambda u: {strip('u')}), lambda u: u <> '')"


PERIMETER = "CASE WHEN coalesce(trim(exclusion) <> '', false) THEN 'exclu' WHEN coalesce(utilite_conseil = 'methodologique', false) THEN 'methodologique' ELSE 'indexe' END"
TOKENS = f"t AS (SELECT i, {tokens('texte')} AS js FROM chunks_1), d AS (SELECT i, coalesce(len(js), 0) AS dl FROM t), o AS (SELECT i, unnest(js) AS terme FROM t), tf AS (SELECT i, terme, count(*) AS tf FROM o GROUP BY 1, 2), df AS (SELECT terme, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d)"


def bm25(questions: str, k: int = 60) -> str:
    return f"""WITH {CHUNKS}, {QCM}, {TOKENS}, q AS (SELECT ligne, unnest(list_distinct({tokens('requete')})) AS terme FROM ({questions})),
    sc AS (SELECT ligne, i, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN tf USING (terme) JOIN df USING (terme) JOIN d USING (i), s GROUP BY 1, 2)
    SELECT ligne, i, score, CAST(row_number() OVER (PARTITION BY ligne ORDER BY score DESC, i) AS INTEGER) AS rang FROM sc QUALIFY rang <= {k}"""


POOL = f"""{CHUNKS}, {CAND}, pool AS (SELECT c.ligne, c.calib, c.i, c.rang_bm25, c.rang_dense, c.score_bm25, c.cos, c.rrf, {doc_key('k.doc')} AS doc, k.off.a AS a, k.off.b AS b,
    s.parametres_retrieve_au_moment_.max_par_doc AS p, s.porte_niveau_2_contre_3 AS porte, row_number() OVER (PARTITION BY c.ligne ORDER BY coalesce(c.rrf, -1) DESC, c.i) AS r
    FROM cand_1 c LEFT JOIN chunks_1 k ON k.i = c.i LEFT JOIN seuils s ON s.calib = c.calib),
  st AS (SELECT ligne, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(i BIGINT, doc VARCHAR, a BIGINT, b BIGINT, rrf DOUBLE, cos DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS ei, CAST(NULL AS VARCHAR) AS motif FROM (SELECT DISTINCT ligne FROM pool)
    UNION ALL
    SELECT ligne, r, CASE WHEN full_ OR why IS NOT NULL THEN kept ELSE list_append(kept, {{'i': i, 'doc': doc, 'a': a, 'b': b, 'rrf': rrf, 'cos': cos}}) END, CASE WHEN NOT full_ AND why IS NOT NULL THEN i END, CASE WHEN NOT full_ THEN why END
    FROM (SELECT st.ligne, p.r, st.kept, p.i, p.doc, p.a, p.b, p.rrf, p.cos, len(st.kept) >= 8 AS full_,
        CASE WHEN len(list_filter(st.kept, lambda x: coalesce(x.doc = p.doc AND p.a < x.b AND x.a < p.b, false))) > 0
            THEN 'chevauche i=' || list_filter(st.kept, lambda x: coalesce(x.doc = p.doc AND p.a < x.b AND x.a < p.b, false))[1].i || ' (offsets)'
          WHEN coalesce(len(list_filter(st.kept, lambda x: coalesce(x.doc = p.doc, false))) >= p.p AND p.doc IS NOT NULL, false) THEN 'plafond ' || p.p || '/document sur ' || p.doc END AS why
      FROM st JOIN pool p ON p.ligne = st.ligne AND p.r = st.r + 1)),
  fin AS (SELECT ligne, kept FROM st QUALIFY row_number() OVER (PARTITION BY ligne ORDER BY r DESC) = 1)"""

GATE = f"""WITH RECURSIVE {POOL},
  l AS (SELECT ligne, any_value(porte) AS porte, list({{'r': rang_dense, 'i': i, 'cos': cos}} ORDER BY rang_dense, i) FILTER (rang_dense IS NOT NULL) AS d, count(*) FILTER (rang_bm25 <= 10 AND rang_dense <= 10) / 10.0 AS accord, arg_min(score_bm25, rang_bm25) FILTER (rang_bm25 IS NOT NULL) AS b1 FROM pool GROUP BY 1),
  g AS (SELECT ligne, porte, d[1].cos AS cos_top1_dense, round(d[1].cos - d[2].cos, 6) AS ecart_dense_1_2, CAST(accord AS DOUBLE) AS accord_bm25_dense_top10, coalesce(b1, 0.0) AS bm25_top1, kept[1].cos AS cos_du_retenu_1,
      list_max(list_transform(kept, lambda x: x.cos)) AS cos_max_retenus, CAST(len(kept) AS BIGINT) AS n_retenus, CAST(len(list_distinct(list_filter(list_transform(kept, lambda x: x.doc), lambda y: y IS NOT NULL))) AS BIGINT) AS docs_distincts FROM l JOIN fin USING (ligne))"""

LABELLED = GATE + f""", {QCM}, lab AS (SELECT cos_du_retenu_1 AS c, NOT list_contains(string_split(niveau_attendu, '+'), '3') AS pos FROM g JOIN qcm_1 USING (ligne) WHERE cos_du_retenu_1 IS NOT NULL AND niveau_attendu IS NOT NULL)"""

PAGES = rf"""p AS (SELECT doc_id, regexp_split_to_array(text, '(?m)^\[\[page \d+\]\][ \t]*$') AS p, regexp_extract_all(text, '(?m)^\[\[page \d+\]\][ \t]*$') AS m FROM documents WHERE text IS NOT NULL),
  x AS (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS k FROM p WHERE len(m) > 0),
  y AS (SELECT doc_id, CAST(regexp_extract(m[k], '\d+') AS INTEGER) AS page, p[k + 1] AS raw, list_sum(list_transform(p[1:k], lambda v: length(v))) + list_sum(list_transform(m[1:k], lambda v: length(v))) AS s FROM x),
  z AS (SELECT doc_id, page, s + length(raw) - length(regexp_replace(raw, '^{WS}+', '')) AS a, {strip('raw')} AS texte FROM y)"""

def greedy(pool: str) -> str:
    """CTEs st, fin: the greedy selection over `pool` (ligne, r, i, doc, a, b, rrf, p)."""
    hit = "list_filter(st.kept, lambda x: coalesce(x.doc = p.doc AND p.a < x.b AND x.a < p.b, false))"
    return f"""st AS (SELECT ligne, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(i BIGINT, doc VARCHAR, a BIGINT, b BIGINT, rrf DOUBLE)[]) AS kept FROM (SELECT DISTINCT ligne FROM {pool})
    UNION ALL
    SELECT st.ligne, p.r, CASE WHEN len(st.kept) >= 8 OR len({hit}) > 0 OR coalesce(p.doc IS NOT NULL AND len(list_filter(st.kept, lambda x: coalesce(x.doc = p.doc, false))) >= p.p, false) THEN st.kept
      ELSE list_append(st.kept, {{'i': p.i, 'doc': p.doc, 'a': p.a, 'b': p.b, 'rrf': p.rrf}}) END FROM st JOIN {pool} p ON p.ligne = st.ligne AND p.r = st.r + 1),
  fin AS (SELECT ligne, kept FROM st QUALIFY row_number() OVER (PARTITION BY ligne ORDER BY r DESC) = 1)"""


STRUCTURE = f"""CASE WHEN texte IS NULL THEN NULL WHEN len(regexp_extract_all(texte, {lit(tx.DOT_LEADERS)})) >= 3 THEN 'sommaire'
        WHEN len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, {lit(tx.REFERENCE_LINE)}) OR (length(x) < 130 AND (regexp_matches(x, {lit(tx.REFERENCE_SIGN)}) OR regexp_matches(x, {lit(tx.REFERENCE_YEAR)}))))) >= 0.5 * len(ls) THEN 'bibliographie'
        WHEN regexp_matches(texte, {lit(tx.KEYWORDS)}) THEN 'mots_cles' ELSE '' END"""

#: Both lists of every question, fused.
LIVE = f"""WITH RECURSIVE {CHUNKS}, {QCM}, b AS ({bm25("SELECT ligne, requete FROM qcm_1")}),
  vs AS (SELECT q.vec_id AS ligne, v.vec_id AS i, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cos FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id IN (SELECT ligne FROM qcm_1)),
  d AS (SELECT ligne, i, cos, row_number() OVER (PARTITION BY ligne ORDER BY cos DESC, i) AS rang FROM vs QUALIFY rang <= 60),
  l AS (SELECT i, {doc_key('doc')} AS doc, off, texte, list_filter(string_split(texte, chr(10)), lambda x: {strip('x')} <> '') AS ls FROM chunks_1),
  k AS (SELECT i, doc, off, {STRUCTURE} AS structure FROM l),
  f AS (SELECT ligne, i, b.rang AS rang_bm25, CAST(d.rang AS INTEGER) AS rang_dense, k.doc, k.off.a AS a, k.off.b AS b, CASE WHEN k.structure IN ('bibliographie', 'sommaire', 'mots_cles') THEN 5 ELSE 0 END AS penalite FROM b FULL JOIN d USING (ligne, i) LEFT JOIN k USING (i)),
  g AS (SELECT *, coalesce(1.0 / (60 + rang_bm25 + penalite), 0) + coalesce(1.0 / (60 + rang_dense + penalite), 0) AS rrf, 3 AS p FROM f)"""

SHARED = ("titre", "editeur", "annee", "licence", "regime", "sujet", "portee", "utilite_conseil")

ORACLE: dict[str, str] = {
    "perimeter_counts": f"WITH e AS (SELECT DISTINCT id, {PERIMETER} AS etat FROM sources WHERE id IS NOT NULL) SELECT etat, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM e GROUP BY 1",
    "bm25_term_stats": f"WITH {CHUNKS}, {TOKENS} SELECT terme, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1",
    "bm25_corpus_stats": f"WITH {CHUNKS}, {TOKENS} SELECT n, round(coalesce(avgdl, 0), 6) AS avgdl FROM s",
    "bm25_topk": bm25(f"SELECT CAST(0 AS BIGINT) AS ligne, {lit(QUESTION)} AS requete"),
    "bm25_batch": bm25("SELECT ligne, requete FROM qcm_1 WHERE ligne % 100 = 0"),
    "dense_topk": """WITH s AS (SELECT q.vec_id AS q, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS cos FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
      SELECT q, vec_id, cos, CAST(row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id) AS INTEGER) AS rang FROM s QUALIFY rang <= 10""",
    "dense_margins": """WITH q AS (SELECT embedding AS e, label AS l FROM embeddings WHERE vec_id = 0), c AS (SELECT label = l AS r, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS cos FROM embeddings, q WHERE vec_id <> 0)
      SELECT round(max(cos) FILTER (r) - max(cos) FILTER (NOT r), 6) AS marge, round(median(cos) FILTER (r) - median(cos) FILTER (NOT r), 6) AS marge_medianes, count(*) FILTER (cos > (SELECT max(cos) FROM c WHERE r)) + 1 AS rang_premier FROM c""",
    "hybrid_rrf": f"WITH {CAND} SELECT ligne, i, CASE WHEN rang_bm25 IS NOT NULL OR rang_dense IS NOT NULL THEN round(coalesce(1.0 / (60 + rang_bm25 + coalesce(penalite, 0)), 0) + coalesce(1.0 / (60 + rang_dense + coalesce(penalite, 0)), 0), 6) END AS rrf_recalcule FROM cand_1",
    "hybrid_fused": LIVE + " SELECT ligne, i, rang_bm25, rang_dense, penalite, round(rrf, 6) AS rrf FROM g",
    "hybrid_live": LIVE + f", pool AS (SELECT *, row_number() OVER (PARTITION BY ligne ORDER BY rrf DESC, i) AS r FROM g), {greedy('pool')} SELECT ligne, kept[k].i AS i, k AS rang, kept[k].doc AS doc, round(kept[k].rrf, 6) AS rrf FROM (SELECT ligne, kept, unnest(range(1, len(kept) + 1)) AS k FROM fin)",
    "hybrid_selected": f"WITH RECURSIVE {POOL} SELECT ligne, kept[k].i AS i, k AS rang, kept[k].rrf AS rrf FROM (SELECT ligne, kept, unnest(range(1, len(kept) + 1)) AS k FROM fin)",
    "hybrid_committed": f"WITH RECURSIVE {POOL}, k AS (SELECT ligne, kept, unnest(range(1, len(kept) + 1)) AS rang FROM fin) SELECT ligne, kept[rang].i AS i, rang FROM k WHERE kept[rang].i IN (SELECT i FROM chunks_1 WHERE regime = 'committed')",
    "chunk_ids": "SELECT count(*) AS n, count(DISTINCT i) AS cles, min(i) AS mini, max(i) AS maxi, coalesce(min(i) = 0 AND max(i) = count(DISTINCT i) - 1, true) AS dense FROM chunks",
    "scope_check": f"SELECT DISTINCT id, utilite_conseil FROM sources WHERE id IN (SELECT id FROM sources WHERE {PERIMETER} = 'indexe') AND NOT coalesce(utilite_conseil IN ('directe', 'indirecte'), false)",
    "hybrid_rejected": f"WITH RECURSIVE {POOL} SELECT ligne, ei AS i, motif FROM st WHERE ei IS NOT NULL",
    "gate_stats": GATE + " SELECT * EXCLUDE (porte) FROM g",
    "gate_decisions": GATE + """, v AS (SELECT ligne, porte.seuil AS seuil, coalesce(CASE porte.statistique WHEN 'cos_top1_dense' THEN cos_top1_dense WHEN 'cos_du_retenu_1' THEN cos_du_retenu_1 WHEN 'cos_max_retenus' THEN cos_max_retenus END, CASE porte.repli_si_absente WHEN 'cos_top1_dense' THEN cos_top1_dense WHEN 'cos_du_retenu_1' THEN cos_du_retenu_1 WHEN 'cos_max_retenus' THEN cos_max_retenus END) AS valeur FROM g)
      SELECT ligne, valeur, seuil, coalesce(valeur < seuil, true) AS refus FROM v""",
    "idf_coverage": f"""WITH RECURSIVE {POOL}, {QCM}, {TOKENS}, q AS (SELECT ligne, unnest(list_distinct({tokens('requete')})) AS terme FROM qcm_1),
      w AS (SELECT q.ligne, q.terme, CASE WHEN df IS NOT NULL THEN ln(1 + (n - df + 0.5) / (df + 0.5)) END AS idf, ln(1 + (n + 0.5) / 0.5) AS plein FROM q LEFT JOIN df USING (terme), s),
      a AS (SELECT ligne, count(*) AS nj, count(idf) AS np, sum(idf) AS si, sum(coalesce(idf, plein)) AS sp, max(idf) AS mi FROM w GROUP BY 1),
      k AS (SELECT ligne, unnest(range(1, len(kept) + 1)) AS rang, kept FROM fin), kk AS (SELECT ligne, rang, kept[rang].i AS i FROM k),
      c AS (SELECT kk.ligne, kk.rang, sum(w.idf) AS s, max(w.idf) AS m FROM kk JOIN w USING (ligne) JOIN tf ON tf.i = kk.i AND tf.terme = w.terme WHERE w.idf IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT ligne, max(s) AS smax, max(s) FILTER (rang = 1) AS s1, max(m) FILTER (rang = 1) AS m1 FROM c GROUP BY 1)
      SELECT x.ligne, round(coalesce(np / nj, 0), 6) AS jetons_couverts, round(coalesce(si / sp, 0), 6) AS idf_couvert_requete, round(coalesce(s1 / si, 0), 6) AS idf_couvert_retenu_1, round(coalesce(smax / si, 0), 6) AS idf_couvert_max_retenus, round(coalesce(m1 / mi, 0), 6) AS idf_rare_dans_retenu_1, coalesce(nj, 0) AS n_jetons, coalesce(np, 0) AS n_jetons_dans_corpus
      FROM (SELECT DISTINCT ligne FROM qcm_1) x LEFT JOIN a USING (ligne) LEFT JOIN b USING (ligne)""",
    "structure_tags": f"""WITH {CHUNKS}, l AS (SELECT i, texte, list_filter(string_split(texte, chr(10)), lambda x: {strip('x')} <> '') AS ls FROM chunks_1)
      SELECT i, CASE WHEN texte IS NULL THEN NULL WHEN len(regexp_extract_all(texte, {lit(tx.DOT_LEADERS)})) >= 3 THEN 'sommaire'
        WHEN len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, {lit(tx.REFERENCE_LINE)}) OR (length(x) < 130 AND (regexp_matches(x, {lit(tx.REFERENCE_SIGN)}) OR regexp_matches(x, {lit(tx.REFERENCE_YEAR)}))))) >= 0.5 * len(ls) THEN 'bibliographie'
        WHEN regexp_matches(texte, {lit(tx.KEYWORDS)}) THEN 'mots_cles' ELSE '' END AS etiquette FROM l""",
    "structure_histogram": "SELECT structure, count(DISTINCT i) AS n FROM chunks GROUP BY 1",
    "citation_units": f"WITH {CHUNKS}, u AS (SELECT i, {units('texte')} AS us FROM chunks_1) SELECT i, k - 1 AS rang, us[k] AS unite FROM (SELECT i, us, unnest(range(1, len(us) + 1)) AS k FROM u)",
    "citations_truncated": f"""WITH {CHUNKS}, u AS (SELECT i, texte, unnest({units('texte')}) AS u FROM chunks_1), n AS (SELECT i, {norm('texte')} AS t, {norm('u')} AS u FROM u),
      c AS (SELECT i, t, u, length(u) > 300 AS tr, CASE WHEN length(u) > 300 THEN regexp_replace(left(u, 300), ' [^ ]*$', '') ELSE u END AS v FROM n)
      SELECT i, count(*) AS unites, count(*) FILTER (tr) AS tronquees, max(length(v)) AS plus_longue, count(*) FILTER (contains(t, {norm('v')})) AS verbatim, count(*) FILTER (NOT regexp_matches(u, '[.!?]$')) AS lignes_de_tableau FROM c GROUP BY 1""",
    "same_page_neighbours": f"WITH {CHUNKS} SELECT c.i, p.i AS avant, n.i AS apres FROM chunks_1 c LEFT JOIN chunks_1 p ON p.i = c.i - 1 AND p.doc = c.doc AND p.page = c.page LEFT JOIN chunks_1 n ON n.i = c.i + 1 AND n.doc = c.doc AND n.page = c.page",
    "interval_coverage": f"""WITH {CHUNKS}, x AS (SELECT {doc_key('doc')} AS source, off.a AS a, off.b AS b FROM chunks_1 WHERE doc IS NOT NULL AND off.a < off.b),
      y AS (SELECT *, max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM x),
      z AS (SELECT *, sum(CASE WHEN h IS NULL OR a > h THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS ile FROM y), w AS (SELECT source, ile, min(a) AS a, max(b) AS b FROM z GROUP BY 1, 2)
      SELECT source, CAST(sum(b - a) AS BIGINT) AS couvert, count(*) AS iles, max(b) - min(a) AS etendue, round(sum(b - a) / (max(b) - min(a)), 6) AS part FROM w GROUP BY 1""",
    "chunk_sizes": f"WITH {CHUNKS}, x AS (SELECT lot, length(texte) AS n FROM chunks_1 WHERE texte IS NOT NULL) SELECT lot, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(min(n) AS INTEGER) AS mini, CAST(floor(median(n)) AS BIGINT) AS mediane, round(avg(n), 1) AS moyenne, CAST(max(n) AS INTEGER) AS maxi, count(*) FILTER (n < 220) AS sous_mini FROM x GROUP BY 1",
    "provenance_mismatches": f"WITH {CHUNKS}, r AS (SELECT DISTINCT ON (k) * FROM (SELECT {doc_key('id')} AS k, * FROM sources WHERE id IS NOT NULL)), b AS (SELECT c.i, r.k AS ok, " + ", ".join(f"coalesce(c.{f}, '') AS c_{f}, coalesce(r.{f}, '') AS r_{f}" for f in SHARED) + f" FROM chunks_1 c LEFT JOIN r ON r.k = {doc_key('c.doc')}) " + " UNION ALL ".join([*(f"SELECT '{f}' AS champ, count(*) FILTER (ok IS NOT NULL AND c_{f} <> r_{f}) AS differences FROM b" for f in SHARED), "SELECT 'source', count(*) FILTER (ok IS NULL) FROM b"]),
    "offset_check": rf"WITH {CHUNKS} SELECT count(*) AS n, count(*) FILTER (off.a > off.b) AS inverses, count(*) FILTER (off.b - off.a <> length(texte)) AS largeur_differente, count(*) FILTER (car <> length(texte)) AS car_different, count(*) FILTER (regexp_matches(texte, '\[\[page \d+\]\]')) AS avec_marqueur FROM chunks_1",
    "shared_edges": f"""WITH {CHUNKS}, x AS (SELECT i, doc, page, {norm('texte')} AS t FROM chunks_1 WHERE doc IS NOT NULL AND page IS NOT NULL AND texte IS NOT NULL),
      y AS (SELECT c.i, coalesce(contains(p.t, right(c.t, 60)), false) OR coalesce(contains(n.t, right(c.t, 60)), false) AS q, coalesce(contains(p.t, left(c.t, 60)), false) OR coalesce(contains(n.t, left(c.t, 60)), false) AS h FROM x c LEFT JOIN x p ON p.i = c.i - 1 AND p.doc = c.doc AND p.page = c.page LEFT JOIN x n ON n.i = c.i + 1 AND n.doc = c.doc AND n.page = c.page WHERE c.t <> '')
      SELECT count(*) AS n, count(*) FILTER (q) AS queue, count(*) FILTER (h) AS tete, count(*) FILTER (q OR h) AS "union" FROM y""",
    "sources_without_chunks": f"WITH a AS (SELECT DISTINCT id AS cle FROM sources WHERE id IS NOT NULL), b AS (SELECT DISTINCT {doc_key('doc')} AS cle FROM chunks WHERE doc IS NOT NULL) SELECT cle, 'gauche' AS cote FROM a WHERE cle NOT IN (SELECT cle FROM b) UNION ALL SELECT cle, 'droite' FROM b WHERE cle NOT IN (SELECT cle FROM a)",
    "demand_routing": f"WITH {QCM} " + " UNION ALL ".join(f"SELECT ligne, CAST({k} AS BIGINT) AS ordre, '{t}' AS type FROM qcm_1 WHERE regexp_matches(requete, {lit('(?i)' + wide(p))})" for k, (t, p) in enumerate(DEMANDS)),
    "recall_at_8": f"""WITH RECURSIVE {POOL}, {QCM}, t AS (SELECT DISTINCT ligne, unnest(bons) AS i FROM qcm_1), n AS (SELECT count(DISTINCT ligne) AS questions FROM t),
      k AS (SELECT ligne, kept, unnest(range(1, len(kept) + 1)) AS rang FROM fin), h AS (SELECT p.ligne, p.rang_bm25, p.rang_dense, k.rang AS rang_rrf FROM pool p JOIN t ON t.ligne = p.ligne AND t.i = p.i LEFT JOIN k ON k.ligne = p.ligne AND k.kept[k.rang].i = p.i),
      e AS ("""
    + " UNION ALL ".join(f"SELECT '{x}' AS liste, count(DISTINCT ligne) FILTER (rang_{x} <= 8) AS trouvees FROM h" for x in ("bm25", "dense", "rrf"))
    + ") SELECT liste, questions, trouvees, round(trouvees / questions, 6) AS rappel FROM e, n",
    "gate_auc": LABELLED + ", s AS (SELECT round(c, 4) AS s, pos FROM lab) SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, (SELECT count(*) FROM lab WHERE pos) AS n_pos, (SELECT count(*) FROM lab WHERE NOT pos) AS n_neg FROM s a JOIN s b ON a.pos AND NOT b.pos",
    "threshold_sweep": LABELLED + ", x AS (SELECT DISTINCT round(c, 2) AS seuil FROM lab) SELECT seuil, (SELECT count(*) FROM lab WHERE pos AND round(c, 2) < seuil) AS faux_refus, (SELECT count(*) FROM lab WHERE NOT pos AND round(c, 2) >= seuil) AS fuites FROM x",
    "expected_levels": f"WITH {QCM} SELECT array_to_string(list_sort(string_split(niveau_attendu, '+')), '+') AS niveaux, count(*) AS questions FROM qcm_1 GROUP BY 1",
    "int8_error": "SELECT vec_id, round(abs(list_dot_product(v, v) - list_dot_product(v, list_transform(v, lambda x: greatest(-127, least(127, round_even(x * 127, 0))) / 127))), 6) AS erreur FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "norm_check": "SELECT count(*) AS n, round(max(abs(sqrt(list_dot_product(v, v)) - 1)), 6) AS ecart_max, count(*) FILTER (abs(sqrt(list_dot_product(v, v)) - 1) > 1e-3) AS hors_tolerance FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)",
    "cache_misses": "WITH k AS (SELECT DISTINCT sha256('cls|' || strlen(texte) || '|' || texte) AS cle, lot <= 4 AS vieux FROM chunks WHERE texte IS NOT NULL) SELECT DISTINCT cle FROM k WHERE cle NOT IN (SELECT cle FROM k WHERE vieux)",
    "run_dispersion": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS moyenne, min(value) AS mini, max(value) AS maxi, round((max(value) - min(value)) / avg(value) * 100, 4) AS etendue_pct, round(stddev_samp(value) / avg(value) * 100, 4) AS cv_pct FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(value) >= 2",
    "page_segments": f"WITH {PAGES} SELECT doc_id, page, CAST(a AS BIGINT) AS a, CAST(a + length(texte) AS BIGINT) AS b, texte FROM z WHERE length(texte) >= 40",
    "document_headers": r"""WITH h AS (SELECT doc_id, chr(10) || text AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, string_split(substr(t, 2, greatest(instr(t, chr(10) || '=== TEXTE ===' || chr(10)) - 2, 0)), chr(10)) AS ls FROM h WHERE contains(t, chr(10) || '=== TEXTE ===' || chr(10))),
      l AS (SELECT doc_id, k, ls[k] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM x)), p AS (SELECT doc_id, k, trim(split_part(l, ':', 1)) AS cle, trim(regexp_replace(l, '^[^:]*:', '')) AS v FROM l WHERE NOT starts_with(l, '===') AND (contains(l, ': ') OR ends_with(l, ':')))
      SELECT doc_id, cle, CASE WHEN v = 'null' THEN '' ELSE v END AS valeur FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, cle ORDER BY k) = 1""",
}
