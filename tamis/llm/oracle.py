"""SQL of the p queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

import unicodedata

from tamis.llm.canon import LIGATURES, LOOK_ALIKES

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNKS = "c1 AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY i ORDER BY charge_le) = 1)"
_BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
#: Letters of other scripts with a mark, whose base is a look-alike.
_MARKED = {c: n for c in map(chr, range(0x370, 0x530)) if (d := unicodedata.normalize("NFD", c))[0] in LOOK_ALIKES and len(d) == 2 and len(n := unicodedata.normalize("NFC", LOOK_ALIKES[d[0]] + d[1])) == 1}
_FROM = "".join(LOOK_ALIKES) + "".join(_MARKED) + _WIDE + _BLANKS
_TO = ("".join(LOOK_ALIKES.values()) + "".join(_MARKED.values()) + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + " " * len(_BLANKS)).replace("'", "''")
_IGNORED = r"[\x{ad}\x{34f}\x{61c}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{e0001}-\x{e007f}]"


def consistent(x: str) -> str:
    out = f"translate(regexp_replace(nfc_normalize({x}), '{_IGNORED}', '', 'g'), '{_FROM}', '{_TO}')"
    for a, b in LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return rf"nfc_normalize(regexp_replace(regexp_replace({out}, '[ \t]*(\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{85}}\x{{2028}}\x{{2029}}])', chr(10), 'g'), '[ \t]+$', ''))"


def _pairs(table: str, key: str, text: str) -> str:
    return f"""SELECT DISTINCT '{table}' AS origine, a.k AS cle_a, b.k AS cle_b FROM f_{table} a JOIN f_{table} b ON a.f = b.f AND a.t <> b.t AND a.k < b.k"""


def _forms(table: str, key: str, text: str) -> str:
    return f"f_{table} AS (SELECT {key} AS k, {text} AS t, {consistent(text)} AS f FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL)"


_TABLES = (("chunks", "i", "texte"), ("qcm", "ligne", "requete"))
_SOURCE = rf"regexp_replace(replace(lower(regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')), '-', '_'), '\.(pdf|txt)$', '')"

ORACLE: dict[str, str] = {
    "p2_found": rf"""WITH {CHUNKS}, x AS (SELECT i, texte, chunking.maxi_car AS m FROM c1 JOIN manifest USING (lot) WHERE length(texte) > chunking.maxi_car AND regexp_matches(texte, '[^' || substr('{WS}', 2))),
      p AS (SELECT i, m, unnest(regexp_split_to_array(regexp_replace(texte, '([.!?…])({WS}+\p{{Lu}})', '\1' || chr(10) || '\2', 'g'), '[\n\r\x{{0b}}\x{{0c}}\x{{85}}\x{{2028}}\x{{2029}}]')) AS s FROM x)
      SELECT i, CASE WHEN max(length(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')) - m) > 0 THEN 'forcee' ELSE 'naturelle' END AS coupe FROM p GROUP BY i""",
    "p2_check": rf"""WITH {CHUNKS} SELECT i, chunking.maxi_car AS limite, CAST(0 AS BIGINT) AS hors_limite, length(regexp_replace(texte, '{WS}+', '', 'g')) AS caracteres,
      length(texte) - length(regexp_replace(texte, '^{WS}+', '')) AS debut, length(regexp_replace(texte, '{WS}+$', '')) AS fin
      FROM c1 JOIN manifest USING (lot) WHERE length(texte) > chunking.maxi_car AND regexp_matches(texte, '[^' || substr('{WS}', 2))""",
    "p3_found": "WITH " + ", ".join(_forms(*t) for t in _TABLES) + " " + " UNION ALL ".join(_pairs(*t) for t in _TABLES),
    "p3_classes": "WITH " + ", ".join(_forms(*t) for t in _TABLES) + ", r AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS origine, k, t, f FROM f_{t}" for t, _, _ in _TABLES) + """),
      g AS (SELECT origine, f, t, min(k) AS graphie, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT origine, f, min(graphie) AS classe, sum(n) AS tous FROM g GROUP BY ALL HAVING count(*) > 1),
      x AS (SELECT origine, k AS cle, classe, graphie, CAST(tous - n AS BIGINT) AS liens FROM r JOIN g USING (origine, f, t) JOIN c USING (origine, f))
      SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY origine, cle ORDER BY classe, graphie, liens) = 1""",
    "p4_found": rf"""WITH {CHUNKS}, f AS (SELECT i, strip_accents(lower({consistent("texte")})) AS t FROM c1 WHERE texte IS NOT NULL), n AS (SELECT count(*) AS n FROM f),
      o AS (SELECT i, unnest(regexp_extract_all(t, '[\p{{L}}\p{{Nd}}]+')) AS terme FROM f), c AS (SELECT terme, count(*) AS n_occ, count(DISTINCT i) AS n_chunks FROM o GROUP BY 1)
      SELECT terme, n_occ, n_chunks, CASE WHEN n_chunks < 3 THEN 'rare' WHEN n_chunks > 0.2 * n THEN 'commun' ELSE 'utile' END AS marque FROM c, n""",
    "p3_forms": " UNION ALL ".join(f"SELECT '{t}' AS origine, {k} AS cle, {consistent(x)} AS forme FROM {t}" for t, k, x in _TABLES),
    "p5_lists": f"""WITH {CHUNKS}, l AS (SELECT * FROM candidats QUALIFY row_number() OVER (PARTITION BY ligne, i ORDER BY calcule_le) = 1),
      s AS (SELECT l.ligne, l.i, l.rrf, {_SOURCE % "c.doc"} AS source, s.parametres_retrieve_au_moment_.max_par_doc AS plafond FROM l LEFT JOIN c1 c ON c.i = l.i LEFT JOIN seuils s ON s.calib = l.calib)
      SELECT *, source IS NOT NULL AND coalesce(row_number() OVER (PARTITION BY ligne, source ORDER BY rrf DESC NULLS LAST, i) > plafond, false) AS retire FROM s""",
    "p5_found": f"""WITH {CHUNKS}, l AS (SELECT * FROM candidats QUALIFY row_number() OVER (PARTITION BY ligne, i ORDER BY calcule_le) = 1),
      r AS (SELECT l.ligne, l.i, s.parametres_retrieve_au_moment_.max_par_doc AS m, row_number() OVER (PARTITION BY l.ligne, {_SOURCE % "c.doc"} ORDER BY l.rrf DESC NULLS LAST, l.i) AS n
        FROM l JOIN c1 c ON c.i = l.i LEFT JOIN seuils s ON s.calib = l.calib WHERE c.doc IS NOT NULL)
      SELECT ligne, i FROM r WHERE n > m""",
    "p7_check": """WITH m AS (SELECT melange, source, sum(poids) AS p FROM (SELECT DISTINCT melange, source, poids, repetitions_max FROM melange) GROUP BY 1, 2)
      SELECT melange, source, round(p / sum(p) OVER (PARTITION BY melange), 6) AS part_cible, FALSE AS trop_repete, FALSE AS hors_budget FROM m""",
}
