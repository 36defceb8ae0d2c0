import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import text as tx
from tamis.functions.rulepack import DEFAULT_PACK, STOP_WORDS, value_patterns


def one(spark, col, *values, types=None):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], types or ", ".join(f"{n} string" for n in names))
    return df.select(col(*map(F.col, names)).alias("x")).first().x


def test_stop_list():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 169
    assert tx.stop_list_collisions() == []
    assert tx.stop_list_collisions((*STOP_WORDS, "mais")) == ["mais"]


@pytest.mark.parametrize("t,want", [("Apport de 15-15-15 au semis", ["apport", "15-15-15", "15", "15", "15", "semis"]), ("septembre-octobre", ["septembre-octobre", "septembre", "octobre"]), ("NIÉBÉ ﬁn cœur a-b x 7", ["niebe", "fin", "ur", "a-b", "7"]), ("", []), (None, None)])
def test_tokens(spark, t, want):
    assert one(spark, tx.tokens, t) == want
    if t is not None:
        assert tx.Tokenizer()(t) == want


def test_tokens_in_python_and_jvm_agree(spark):
    texts = ["L'été, dose 15-15-15 --a--", "ＷＩＤＥ é ﬄ", "Ünïcödé À-B-c 1-2 le la", "ça œuvre æon ß İ ñandú"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(tx.tokens(F.col("t")).alias("x")).collect()] == [tx.Tokenizer()(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcéÀñü ﬁ’1-ｅ́", max_size=30))
def test_fold_is_compatibility_decomposition(t):
    t = t.lower()
    for a, b in tx.FOLD_LIGATURES.items():
        t = t.replace(a, b)
    mine = t.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO, tx.FOLD_DROP))
    assert mine == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_units(spark):
    t = "Semer en\njuin. Puis\n(20 kg)\n- puce: une\n* Autre. Fin\n\n  \nTITRE: EL MARADI"
    assert one(spark, tx.units, t) == ["Semer en juin.", "Puis (20 kg)", "puce: une", "Autre.", "Fin", "TITRE: EL MARADI"]
    assert one(spark, tx.units, "") == [] and one(spark, tx.units, " \n") == []


@pytest.mark.parametrize("n,cut", [(300, False), (301, True)])
def test_truncate(spark, n, cut):
    t = ("mot " * 100)[: n - 1] + "x"
    r = one(spark, tx.truncate, t)
    assert r.tronquee == cut and len(r.verbatim) <= 300 and "[…]" not in r.verbatim
    assert (r.affichee == r.verbatim + " […]") if cut else r.affichee == t
    assert t.startswith(r.verbatim)


def test_structure(spark):
    assert one(spark, tx.structure, "a ..... 1\nb ..... 2\nc ..... 3") == "sommaire"
    assert one(spark, tx.structure, "[1] Diallo, A. B., sols\n[2] Sow M., riz (2001)\ntexte") == "bibliographie"
    assert one(spark, tx.structure, "Mots clés : mil") == "mots_cles"
    assert one(spark, tx.structure, "Du texte.") == "" and one(spark, tx.structure, None) is None


def test_small_functions(spark):
    assert one(spark, tx.norm, "  a \n\tb ") == "a b"
    assert one(spark, tx.numbers, "3 180 passages et 12") == [3180, 12]
    assert one(spark, tx.levels, "1+2") == [1, 2] and one(spark, tx.levels, "x") == []
    assert one(spark, lambda c: tx.places(c, DEFAULT_PACK.places), "au Nigeria et à Tillabéri") == ["Tillab", "Nigeria"]
    assert one(spark, tx.upper_runs, "La variété EL MARADI, de A.") == ["EL MARADI"]
    assert one(spark, tx.is_table_line, "Cycle : 90") and not one(spark, tx.is_table_line, "Fin.")
    assert one(spark, tx.is_prescriptive, "1. Arracher les plants") and not one(spark, tx.is_prescriptive, "Il faut arracher")
    assert one(spark, lambda a, b: tx.is_verbatim(a, b), "trois décades de juin", "en trois décades de\njuin.")
    assert one(spark, lambda a: tx.all_named(F.array(F.lit("EL"), F.lit("MARADI")), a), "el maradi")
    assert one(spark, lambda a, b: tx.contains_folded(a, b), "niebe", "le NIÉBÉ")
    assert one(spark, lambda c: tx.preview(c, 3), "a  bcd") == "a b"
    p = one(spark, lambda *c: tx.provenance_line(dict(zip(("editeur", "titre", "annee", "page", "licence", "regime"), c))), None, "T", "2020", "4", None, "fetched")
    assert p == "editeur non renseigne, « T », 2020, page 4, licence non declaree dans le PDF (regime fetched)"


def test_plural_veto():
    fixed, compat = value_patterns()["cycle_duree"][1], value_patterns(compat=True)["cycle_duree"][1]
    assert not re.search(fixed, "cycle de 45 jours après semis", re.I) and re.search(compat, "cycle de 45 jours après semis", re.I)
    assert re.search(fixed, "cycle de 90 jours", re.I)
