import re

import pytest
from pyspark.sql import functions as F

from tamis.functions.rulepack import DEFAULT_PACK, PolicyConfig
from tamis.operators import policy


def frame(spark, rows, names="x"):
    return spark.createDataFrame([(r,) for r in rows], f"{names} string")


def test_conjunction_is_no_crop(spark):
    texts = ["Semer à la mi-mai, mais le rendement baisse", "Le maïs est semé", "Maize is sown", "mille plants", "FT_niebe_x.pdf", "niébé-mil", "Vigna unguiculata"]
    got = [r.n for r in frame(spark, texts).select(policy.named(F.col("x")).alias("n")).collect()]
    assert got == [[], ["mais"], ["mais"], [], ["niebe"], ["mil", "niebe"], ["niebe"]]


@pytest.mark.parametrize("kind,text,n", [("seuil_intervention", "5 larves par plant", 1), ("seuil_intervention", "seuil … 10 % de plants", 1), ("seuil_intervention", "3 chenilles par pied", 1), ("dose_engrais", "apport de 6 g de 15-15-15 par poquet", 0), ("dose_engrais", "2 g/poquet (20 kg/ha)", 2), ("periode_semis", "semer en juin", 1), ("mesure_lutte", "control of weeds", 0), ("mesure_lutte", "control of striga", 1), ("cycle_duree", "cycle de 45 jours après semis", 0), ("cycle_duree", "cycle de 90 jours", 1), ("zone_pluie", "zone de 300 à 500 mm", 1)])
def test_values(spark, kind, text, n):
    got = frame(spark, [text]).select(policy.values(kind, F.col("x")).alias("v")).first().v
    assert len(got) == n
    if kind != "cycle_duree" and kind not in DEFAULT_PACK.conjunctive:
        assert got == [" ".join(m.group().split()) for p in DEFAULT_PACK.patterns[kind] for m in re.finditer(p, text, re.I)]


def test_entities_by_position(spark):
    texts = ["Quand semer le niébé et le mil ?", "mil puis NIEBE", "dose pour du mais", "rien", "maïs ou mil"]
    got = [r.n for r in frame(spark, texts).select(policy.entities_by_position(F.col("x")).alias("n")).collect()]
    assert got == [["niebe", "mil"], ["mil", "niebe"], ["mais"], [], ["mais", "mil"]]


def test_demands(spark):
    q = spark.createDataFrame([(1, "À quelle période semer le mil et quel cumul de pluie ?"), (2, "Quelle est la variété EL MARADI ?"), (3, None), (4, "Bonjour")], "ligne bigint, requete string")
    got = {(r.ligne, r.type): r for r in policy.demands(q, "ligne", "requete").collect()}
    assert set(got) == {(1, "periode_semis"), (1, "cumul_pluie"), (2, "identite_variete")}
    assert got[1, "periode_semis"].cible == "mil" and got[2, "identite_variete"].cible == "variete" and got[2, "identite_variete"].noms == ["EL MARADI"]


def arbitrated(spark, rows):
    df = spark.createDataFrame(rows, "k string, c string, u string")
    return [tuple(r.x) for r in df.select(policy.co_mention(F.col("k"), F.col("c"), F.col("u")).alias("x")).collect()]


def test_arbitration(spark):
    t = "Après le premier sarclage du mil, le niébé est semé à 40 cm x 50 cm"
    k = "densite_ecartement"
    got = arbitrated(spark, [(k, "niebe", t), (k, "mil", t), (k, "mil", "mil à 4 cm x 5 cm"), (k, "mil", None), (k, "sorgho", t), (k, "mil", "le mil et le niébé"), ("mesure_lutte", "mil", "lutte contre les oiseaux : mil, niébé"), ("mesure_lutte", "mil", "lutte contre le striga : niébé, mil")])
    assert [r[:2] for r in got] == [(True, True), (True, False), (False, True), (False, True), (False, True), (False, True), (False, True), (True, False)]
    assert got[0][2] < got[0][3] and got[2][2:] == (None, None)
    tie = arbitrated(spark, [(k, c, "mil 4 cm x 5 cm niébé") for c in ("mil", "niebe")])
    assert [r[:2] for r in tie] == [(True, True), (True, True)] and tie[0][2] == tie[0][3]


def test_spans_and_distance_equal_brute_force(spark):
    texts = ["mil le mil, mil", "rien", "", "mil", "amil mil.", "sorgho mil sorgho", "mil  sorgho", None, "milmil"]
    df = frame(spark, texts)
    got = [tuple(r) for r in df.select(policy.spans(F.col("x"), F.lit("mil")).alias("a"), policy.spans(F.col("x"), F.lit(r"\bsorgho")).alias("b")).select("a", "b", policy.nearest(F.col("a"), F.col("b"))).collect()]
    for t, (a, b, d) in zip(texts, got):
        if t is None:
            assert a is None
            continue
        x, y = ([m.span() for m in re.finditer(p, t)] for p in ("mil", r"\bsorgho"))
        assert [tuple(s) for s in a] == x and [tuple(s) for s in b] == y
        assert d == (min(max(0, q[0] - p[1], p[0] - q[1]) for p in x for q in y) if x and y else None)


def test_needs_are_necessary(spark):
    texts = ["à la mi-mai jusqu'à la mi-juin", "TROISIÈME DÉCADE", "Semer en AOÛT", "20 kg/ha", "semence : ٣ kg", "DÉNOMINATION : EL MARADI", "AUTRE DENOMINATION: X2", "cycle de 90 jours", "cumul de 20 mm", "seuil de 3 larves"]
    from dataclasses import replace

    free = replace(DEFAULT_PACK, needs={})
    for k in DEFAULT_PACK.patterns:
        for r in frame(spark, texts).select(policy.values(k, F.col("x")).alias("a"), policy.values(k, F.col("x"), free).alias("b")).collect():
            assert r.a == r.b


CHUNKS = [
    (1, "d1", 1, "Semer le mil en juin. Le mil aime le sable.", "Fiche mil", "committed", "oui"),
    (2, "d1", 1, "Semer le mil en juillet dans la zone nord.", "Fiche mil", "committed", "oui"),
    (3, "d2", 4, "Semer le sorgho en mai au Mali.", "Fiche sorgho", "fetched", "non"),
    (4, "d3", 2, "Semer en août. Oryza sativa.", "Note sur le mil", "fetched", "non"),
    (5, "d4", 1, "Varietes resistantes au striga du sorgho. Arracher le striga du sorgho.", "x", "fetched", "non"),
    (6, "d5", 1, None, None, None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame([(i, d, p, t, ti, r, o, "Ed", "2020", "fr", None) for i, d, p, t, ti, r, o in CHUNKS], "i bigint, doc string, page int, texte string, titre string, regime string, citation_verbatim_autorisee string, editeur string, annee string, langue string, licence string")
    q = spark.createDataFrame([(1, "Quand semer le mil ?"), (2, "Quand semer le niébé à Maradi ?"), (3, "Bonjour"), (4, "Quand semer le mil ?"), (5, "Comment lutter contre le striga du sorgho ?"), (6, None)], "ligne bigint, requete string")
    kept = spark.createDataFrame([(1, 1, 1, 0.7), (1, 4, 2, 0.6), (2, 3, 1, 0.5), (3, 1, 1, 0.5), (4, 1, 1, 0.2), (5, 5, 1, 0.6)], "ligne bigint, i bigint, rang int, cos double")
    dec = spark.createDataFrame([(k, 0.5, 0.4, False) for k in (1, 2, 3, 5, 6)] + [(4, 0.2, 0.4, True)], "ligne bigint, valeur double, seuil double, refus boolean")
    return q, kept, dec, c


def test_reports(spark, tables):
    got = {r.ligne: r for r in policy.analyse(*tables).collect()}
    assert {k: r.niveaux for k, r in got.items()} == {1: [1], 2: [2], 3: [2], 4: [3], 5: [1], 6: [2]}
    cites = got[1].demandes[0].citations
    assert [(c.chunk, c.citation, c.etage, c.couture_de) for c in cites] == [(1, "Semer le mil en juin.", "a1", None), (2, "Semer le mil en juillet dans la zone nord.", "a1", 1)]
    v = got[2].demandes[0]
    assert v.voisin.i == 1 and v.ecarts[0] == "culture mil ≠ niebe"
    assert got[3].pistes[0].i == 1 and got[3].demandes == [] and got[4].demandes == []
    assert all(r.appels_generateur == 0 for r in got.values())
    assert got[5].demandes[0].citations[0].citation.startswith("Varietes resistantes")
    msg = {r.ligne: r.message for r in policy.compose(policy.analyse(*tables)).collect()}
    assert "Semer le mil en juin. (Ed, « Fiche mil », 2020, page 1, licence non declaree" in msg[1] and "sortent" not in msg[4] and "sort de ce" in msg[4]


def test_switches(spark, tables):
    q, kept, dec, c = tables
    wanted = policy.demands(q.where("ligne = 1"), "ligne", "requete")
    one = policy.level_one(wanted, kept, c, "ligne", cfg=PolicyConfig(stitches_per_demand=0)).first().citations
    assert [x.chunk for x in one] == [1]
    none = policy.level_one(wanted, kept.where("false"), c, "ligne").count()
    assert none == 0


def test_species_veto(spark, tables):
    q, kept, dec, c = tables
    wanted = policy.demands(q.where("ligne = 1"), "ligne", "requete")
    got = policy.level_one(wanted, kept.where("i = 4"), c, "ligne").count()
    assert got == 0
