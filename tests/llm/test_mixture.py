import random

import pytest

from tamis.llm import mixture


def test_share_out_fills_by_weight():
    assert mixture.share_out(100, [1, 1, 2], [1000, 10, 1000]) == pytest.approx([30, 10, 60])
    assert sum(mixture.share_out(100, [1, 1], [20, 30])) == pytest.approx(50)
    assert mixture.share_out(10, [0, 0], [5, 5]) == [0, 0]


def test_shortage_stays_among_siblings():
    got = mixture.budget_tree([(("a", "x"), 1, 5), (("a", "y"), 1, 1000), (("b", "z"), 2, 1000)], 100)
    assert got == pytest.approx({("a", "x"): 5, ("a", "y"): 45, ("b", "z"): 50})
    got = mixture.budget_tree([(("a", "x"), 1, 5), (("a", "y"), 1, 10), (("b", "z"), 2, 1000)], 100)
    assert got == pytest.approx({("a", "x"): 5, ("a", "y"): 10, ("b", "z"): 85})


def test_mixture(spark):
    docs = [(k, "le mil pousse bien " * (1 + k % 5), "f_a") for k in range(200)] + [(1000 + k, "court", "f_b") for k in range(5)] + [(2000, None, "f_a"), (2001, "", "f_b"), (2002, "autre", "hors")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = spark.createDataFrame([("m", "f_a", 1.0, 3), ("m", "f_a", 1.0, 3), ("m", "f_b", 1.0, 4), ("m", "vide", 1.0, 2), ("m2", "f_a", None, None)], "melange string, source string, poids double, repetitions_max int")
    tokens, plan = mixture.mixtures(d, m)
    p = {(r.melange, r.source): r for r in plan.collect()}
    assert {k for k, r in p.items() if r.manque} == {("m", "f_b"), ("m", "vide")}
    sel = mixture.select(tokens, plan).collect()
    assert len({(r.melange, r.doc_id) for r in sel}) == len(sel)
    a, b = (sum(r.jetons * r.fois for r in sel if r.melange == "m" and r.source == s) for s in ("f_a", "f_b"))
    assert b == p["m", "f_b"].jetons * 4
    budget = p["m", "f_a"].budget
    assert budget - 40 < a <= budget + 1e-6
    assert max(r.fois for r in sel if r.source == "f_a") <= 3
    assert sel == mixture.select(tokens, plan).collect() or sorted(sel) == sorted(mixture.select(tokens, plan).collect())
    s = {(r.melange, r.source): r for r in mixture.shares(mixture.select(tokens, plan), plan).collect()}
    assert s["m", "f_a"].part_atteinte + s["m", "f_b"].part_atteinte == pytest.approx(1)
    assert s["m", "vide"].jetons_sortis == 0


def test_short_leaves_are_those_below_their_share():
    r = random.Random(4)
    for _ in range(300):
        leaves = [((r.choice("ab"), r.choice("xy"), k), r.choice([0.2, 1.0, 3.7]), r.randint(0, 400)) for k in range(r.randint(1, 8))]
        total = float(sum(x[2] for x in leaves)) / 2
        got, weight = mixture.budget_tree(leaves, total), sum(x[1] for x in leaves)
        short = {p for p, w, _ in leaves if got[p] < w / weight * total * (1 - 1e-12)}
        assert short == {p for p, w, room in leaves if room < w / weight * total * (1 - 1e-12)}
        assert sum(got.values()) == pytest.approx(min(total, sum(x[2] for x in leaves)))


def test_levels_come_from_labels_and_languages(spark):
    docs = [(1, "a", "a", "FR"), (2, "b", "a", "fr"), (3, "c", "a", "en"), (4, "d", "b", None), (5, None, None, "pt")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, "sol"), (1, "sol"), (2, "eau"), (3, "eau"), (9, "eau"), (4, None)], "doc_id bigint, domaine string")
    assert {tuple(r) for r in mixture.levels_of(d, labels).collect()} == {("a", "eau", "fr"), ("b", "", "")}
    m = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "b", 1.0, 9), ("m", "absent", 1.0, 1)], "melange string, source string, poids double, repetitions_max int")
    _, plan = mixture.mixtures(d, m, mixture.levels_of(d, labels))
    assert {r.source for r in plan.where("manque").collect()} == {"absent"}
    assert mixture.levels_of(d.where("false"), labels).count() == 0 and mixture.levels_of(d).count() == 2


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    m = spark.createDataFrame([], "melange string, source string, poids double, repetitions_max int")
    tokens, plan = mixture.mixtures(d, m)
    assert plan.count() == 0 and mixture.select(tokens, plan).count() == 0
