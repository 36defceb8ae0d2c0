import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamis.llm import canon

SAME = [("a​b", "ab"), ("é", "é"), ("ａ１", "a1"), ("аео", "aeo"), ("a b", "a b"), ("ﬁn", "fin"), ("a‑b", "a-b"), ("ё", "ë"), ("e​́", "é"), ("x \n y ", "x\n y"), ("a\r\nb", "a\nb"), ("co­op", "coop"), ("힣", "힣")]
OTHER = [("a", "A"), ("e", "é"), ("1", "l"), ("0", "O"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("a.", "a"), ("—", "-"), ("", "\n")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert canon.by_table(a) == canon.by_table(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert canon.by_table(a) != canon.by_table(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abÉé́̈​­  \n\tаеВａﬁ-‑'1", max_size=25))
def test_vocabulary_agrees_with_the_table_on_signs_of_one_letter(t):
    words = ["ab", "aé", "é", "fi", "a", "Be", "ëa"]
    assert canon.Canon(words)(t) == canon.Canon()(t) == canon.by_table(t)
    assert canon.by_table(canon.by_table(t)) == canon.by_table(t)


def test_vocabulary_decides_what_a_sign_stands_for():
    form = canon.Canon(["mil", "Ibrahima", "Il", "ll", "Straße"])
    assert form("le miǀ dﾞ") == canon.by_table("le mil dﾞ")
    assert form("ǀbrahima") == form("Ӏbrahima") == "Ibrahima" and form("mi\u200bӀ") == "mil"
    assert form("Straβe") == "Straße"
    assert canon.Canon()("miǀ") == "miǀ" and form("xǀ") == "xǀ"  # no word: the table, which leaves the sign
    assert form("Ӏl") == "Il" and form("ǀl") == "ll"  # the usual letter is cheaper
    assert canon.Canon(["lb", "Ib"])("ǀb") == "lb" and canon.Canon(["Ib"])("ǀb") == "Ib"


def test_weights_and_budget():
    assert canon.Vocabulary(["mil"]).read("mіll") is None and canon.Vocabulary(["mil"]).read("ml") is None
    one = canon.Vocabulary(["mil", "mille"], budget=1)
    assert [one.read(t) for t in ("mіll", "ml", "mxl", "mil", "x")] == ["mil", "mil", "mil", "mil", None]
    assert canon.Vocabulary(["mille"], budget=2).read("mil") == "mille"
    assert canon.Vocabulary(["b", "a"], budget=1).read("c") == "b"  # equally cheap: the more frequent


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abl", max_size=4), min_size=1, max_size=6, unique=True), st.text(alphabet="abl", max_size=5), st.integers(0, 2))
def test_automaton_equals_edit_distance(words, token, budget):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, last = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        return row[-1]

    best = min((distance(token, w), k) for k, w in enumerate(words))
    assert canon.Vocabulary(words, budget=budget).read(token) == (words[best[1]] if best[0] <= budget else None)


def test_every_character_is_stable():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        f = canon.by_table("x" + c + "y")
        assert canon.by_table(f) == f and unicodedata.is_normalized("NFC", f)


def test_column_equals_function(spark):
    texts = [None, "", " ", "a​b", "plain", "x \n", "é" * 5000, "Сомt"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "i int, texte string, __t string")
    got = {r.i: r.f for r in canon.consistent(df, "texte", "f").collect()}
    assert got == {k: None if t is None else canon.by_table(t) for k, t in enumerate(texts)}


def test_vocabulary_counts_all_texts(spark):
    df = spark.createDataFrame([("le mil, le sol",), (None,), ("",), ("mil-eau mіl le",), ("eau le\u00a0mil",)], "t string").repartition(3)
    assert canon.vocabulary(df, "t", table_rows=1) == ("le", "mil", "eau", "sol")
    assert canon.vocabulary(df, "t", size=2) == ("le", "mil")


def brute(rows):
    seen = {(k, t) for k, t in rows if k is not None and t is not None}
    return {(a, b) for a, x in seen for b, y in seen if a < b and x != y and canon.by_table(x) == canon.by_table(y)}


def test_pairs_equal_brute_force(spark):
    random.seed(5)
    base = ["sol sableux", "le mil", "niébé", ""]
    noise = ["{}", "{}​", "­{}", "{} ", "{} "]
    rows = [(k, None if random.random() < 0.1 else random.choice(noise).format(random.choice(base))) for k in range(60)]
    rows += rows[:10] + [(None, "le mil")]
    df = spark.createDataFrame([("c", *r) for r in rows], "origine string, cle bigint, texte string")
    out = canon.look_alike_pairs(canon.same_look(df, "cle", "texte", ["origine"]), "cle", ["origine"]).collect()
    assert len(out) == len({(r.cle_a, r.cle_b) for r in out})
    assert {(r.cle_a, r.cle_b) for r in out} == brute(rows)
    salted = canon.look_alike_pairs(canon.same_look(df, "cle", "texte", ["origine"]), "cle", ["origine"], part=2).collect()
    assert sorted(salted) == sorted(out)
    degree = {k: sum(k in p for p in brute(rows)) for k, t in rows if k is not None}
    classes = canon.look_alike_classes(canon.same_look(df, "cle", "texte", ["origine"]), "cle", ["origine"]).collect()
    assert {r.cle: r.liens for r in classes} == {k: n for k, n in degree.items() if n}
    of = {r.cle: r for r in classes}
    assert all(of[a].classe == of[b].classe and of[a].graphie != of[b].graphie for a, b in brute(rows))


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "cle bigint, texte string")
    assert canon.look_alike_pairs(canon.same_look(df, "cle", "texte"), "cle").count() == 0
    assert canon.look_alike_classes(canon.same_look(df, "cle", "texte"), "cle").count() == 0
    assert canon.vocabulary(df, "texte") == ()
