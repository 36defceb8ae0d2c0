from collections import Counter

import pytest

from tamis.llm import terms

TEXTS = ["L'été à l'eau, l'eau!", "ETE éte 12,5 x²", None, "", "  ", "ｍｉｌ mil Mil", "a̱b _c_ Ⅻ½ ١٢"]


def test_terms_of_a_text():
    of = terms.Terms()
    assert of(TEXTS[0]) == ["l", "ete", "a", "l", "eau", "l", "eau"]
    assert of(TEXTS[1]) == ["ete", "ete", "12", "5", "x"]
    assert of(TEXTS[5]) == ["mil"] * 3
    assert of(TEXTS[6]) == ["ab", "c", "١٢"]


@pytest.mark.parametrize("heavy", [(), ("mil", "eau", "absent"), terms.heavy_terms(("mil", "Été", "été", "l'eau"))])
def test_counts_equal_brute_force(spark, heavy):
    of = terms.Terms()
    rows = [(k, t) for k, t in enumerate(TEXTS * 7)]
    lists = [of(t) for _, t in rows if t is not None]
    occ, rec = Counter(w for x in lists for w in x), Counter(w for x in lists for w in set(x))
    df = spark.createDataFrame(rows, "i int, texte string").repartition(3)
    parts = terms.count_parts(df, "texte", heavy=heavy, light_rows=2)
    assert parts.where("terme is null").agg({"n_chunks": "sum"}).first()[0] == len(lists)
    assert not {r.terme for r in parts.collect()} & set(heavy)
    out = terms.merge_parts(parts, heavy).collect()
    got = {r.terme: (r.n_occ, r.n_chunks) for r in out}
    assert len(out) == len(got) and got == {w: (occ[w], rec[w]) for w in occ}


def test_frequencies_count_a_delivery_once(spark):
    rows = [(k, f"mot{k} commun", None) for k in range(9)] + [(0, "mot0 commun", None)] * 3
    df = spark.createDataFrame(rows, "i bigint, texte string, charge_le timestamp")
    got = {r.terme: (r.n_occ, r.n_chunks, r.marque) for r in terms.term_frequencies(df).collect()}
    assert got["commun"] == (9, 9, "commun") and got["mot0"] == (1, 1, "rare")


def test_heavy_terms_are_the_first_of_the_vocabulary():
    assert terms.heavy_terms(("mil", "Été", "été", "l'eau"), 3) == ("mil", "ete", "l")


def test_no_rows(spark):
    df = spark.createDataFrame([], "i bigint, texte string, charge_le timestamp")
    assert terms.term_frequencies(df).count() == 0 and terms.term_frequencies(df, words=("mil",)).count() == 0
