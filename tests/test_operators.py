import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import vectors as vx
from tamis.operators import audit, dense, evaluate, fusion, gate, lexical, segment
from tamis.operators.delivery import first_delivery
from tamis.session import small


def test_first_delivery(spark):
    rows = [(1, "a", 2, "x"), (1, "b", 1, "x"), (1, "c", None, "y"), (2, "d", 1, "z"), (None, "e", 1, "z"), (None, "e", 1, "z")]
    df = spark.createDataFrame(rows, "i bigint, t string, le int, __delivery string")
    out = first_delivery(df, ["i"], "le")
    assert out.columns == df.columns
    assert sorted(r.t for r in out.collect()) == ["b", "d", "e", "e"]
    assert first_delivery(df.where("false"), ["i"], "le").count() == 0


@pytest.mark.parametrize("bits", [1, 1 << 27])
def test_first_delivery_joins_no_list_of_keys(spark, bits):
    random.seed(3)
    rows = [(random.choice([None, *range(400)]), random.choice("ab"), f"{random.random()}", random.choice([None, 1, 2])) for _ in range(1000)]
    df = spark.createDataFrame(rows, "i bigint, __n string, texte string, le int").repartition(3)
    out = first_delivery(df, ["i", "__n"], "le", most_bits=bits)
    want = {}
    for r in rows:
        if r[0] is not None:
            want.setdefault(r[:2], []).append(r)
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[2] for r in got if r[0] is None) == sorted(r[2] for r in rows if r[0] is None)
    got = {r[:2]: r for r in got if r[0] is not None}
    assert got.keys() == want.keys()
    assert all(r in want[k] and (r[3] is None or r[3] == min(x[3] for x in want[k] if x[3] is not None)) and (r[3] is not None or all(x[3] is None for x in want[k])) for k, r in got.items())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = first_delivery(df, ["i", "__n"], "le", most_bits=bits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_small_looks_at_bytes_and_rows(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 5, "t string")
    hinted = lambda **k: "ResolvedHint" in small(df, **k)._jdf.queryExecution().analyzed().toString()
    assert hinted() and not hinted(rows=4) and not hinted(size=4000)


def test_bm25_equals_brute_force(spark):
    docs = [(0, "le mil et le sorgho"), (1, "mil mil mil"), (2, None), (3, ""), (4, "eau du puits"), (5, "mil mil mil")]
    q = [(9, "mil eau mil"), (8, "absent"), (7, None)]
    d, qq = spark.createDataFrame(docs, "i bigint, texte string"), spark.createDataFrame(q, "ligne bigint, requete string")
    got = [(r.ligne, r.i, r.score) for r in lexical.search(d, qq, "i", "texte", "ligne", "requete", 10).orderBy("rang").collect()]
    toks = {0: ["mil", "sorgho"], 1: ["mil"] * 3, 2: [], 3: [], 4: ["eau", "puits"], 5: ["mil"] * 3}
    avg = np.mean([len(x) for x in toks.values()])
    want = {}
    for t in ("mil", "eau"):
        df = sum(t in x for x in toks.values())
        for i, x in toks.items():
            if t in x:
                tf = x.count(t)
                want[i] = want.get(i, 0) + np.log(1 + (6 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    assert got == [(9, i, pytest.approx(s, abs=1e-6)) for i, s in sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))]
    assert lexical.search(d.where("false"), qq, "i", "texte", "ligne", "requete").count() == 0
    assert {r.i: r.dl for r in lexical.lengths(d, "i", "texte").collect()} == {k: len(v) for k, v in toks.items()}


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_equals_brute_force(spark, block):
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [1.0])], "i bigint, e array<float>").repartition(3)
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 50, 10)], "q bigint, x array<double>")
    got = {(x.q, x.rang): x.i for x in dense.search(df, q, "i", "e", "q", "x", 5, block=block).collect()}
    s = np.round(v.astype(np.float32).astype(float) @ v.T, 6)
    for k in range(0, 50, 10):
        best = sorted(range(200), key=lambda i: (-s[i, k], i))[:5]
        assert [got[k, n] for n in range(1, 6)] == best
    assert dense.search(df, q.where("false"), "i", "e", "q", "x").count() == 0


def greedy(pool, k, cap):
    kept, out = [], []
    for c in sorted(pool, key=lambda c: (-(c["rrf"] if c["rrf"] is not None else -1), c["i"])):
        hit = next((r for r in kept if r["doc"] is not None and r["doc"] == c["doc"] and c["off"][0] < r["off"][1] and r["off"][0] < c["off"][1]), None)
        if hit:
            out.append((c["i"], f"chevauche i={hit['i']} (offsets)"))
        elif c["doc"] is not None and sum(r["doc"] == c["doc"] for r in kept) >= cap:
            out.append((c["i"], f"plafond {cap}/document sur {c['doc']}"))
        else:
            kept.append(c)
            if len(kept) == k:
                break
    return [c["i"] for c in kept], out


def test_selection_equals_a_greedy_loop(spark):
    random.seed(8)
    rows = []
    for q in range(60):
        for i in random.sample(range(500), 40):
            a = random.randrange(1000)
            rows.append((q, i, random.choice(["a", "b", "c", "d", None]), (a, a + random.randrange(1, 200)), random.choice([None, 0.01, 0.02, random.random()]), 0.5))
    df = spark.createDataFrame(rows, "q bigint, i bigint, doc string, off struct<a: bigint, b: bigint>, rrf double, cos double")
    for r in fusion.select(df, "q").collect():
        pool = [dict(zip(("i", "doc", "off", "rrf"), x[1:5])) for x in rows if x[0] == r.q]
        kept, out = greedy(pool, 8, 3)
        assert [x.i for x in r.retenus] == kept and [(x.i, x.motif) for x in r.ecartes] == out
    assert fusion.select(df.where("false"), "q").count() == 0


def test_fuse_takes_fabricated_lists(spark):
    a = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], "q bigint, i bigint, score double, rang int")
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2)], "q bigint, i bigint, cos double, rang int")
    c = spark.createDataFrame([(10, "a", (0, 5), "sommaire"), (11, "a", (9, 12), ""), (12, "b", (0, 5), None)], "i bigint, doc string, off struct<a: bigint, b: bigint>, structure string")
    got = {r.i: r.rrf for r in fusion.fuse(a, b, c, "q").collect()}
    assert got == pytest.approx({10: 1 / 66, 11: 1 / 62 + 1 / 61, 12: 1 / 62})
    n = {r.i: (r.avant, r.apres) for r in fusion.same_page_neighbours(spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, None, 2), (6, "a", 2)], "i bigint, doc string, page int")).collect()}
    assert n == {1: (None, 2), 2: (1, None), 3: (None, None), 4: (None, None), 6: (None, None)}


def test_gate(spark):
    c = spark.createDataFrame([(1, 10, 1, None, 7.0, None, 0.5), (1, 11, None, 2, None, 0.6, 0.4), (1, 12, 3, 1, 2.0, 0.8, 0.3), (2, 13, None, None, None, None, None)], "q bigint, i bigint, rang_bm25 int, rang_dense int, score_bm25 double, cos double, rrf double").withColumns({"doc": F.lit("a"), "off": F.expr("named_struct('a', i * 10, 'b', i * 10 + 5)")})
    s = {r.q: r for r in gate.score_statistics(c, fusion.select(c, "q"), "q").collect()}
    assert (s[1].cos_top1_dense, s[1].ecart_dense_1_2, s[1].accord_bm25_dense_top10, s[1].bm25_top1) == (0.8, pytest.approx(0.2), 0.1, 7.0)
    assert (s[1].cos_du_retenu_1, s[1].cos_max_retenus, s[1].n_retenus, s[1].docs_distincts) == (None, 0.8, 3, 1)
    assert (s[2].cos_top1_dense, s[2].bm25_top1, s[2].n_retenus) == (None, 0.0, 1)
    r = spark.createDataFrame([(None, 0.4), (0.3, 0.4), (0.4, 0.4)], "v double, s double").select(gate.refused(F.col("v"), F.col("s")).alias("x")).collect()
    assert [x.x for x in r] == [True, True, False]


def test_evaluation(spark):
    rows = [(0.9, True), (0.8, False), (0.8, True), (0.1, False), (None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, p boolean")
    assert tuple(evaluate.auc(df, "s", "p").first()) == (0.875, 2, 2)
    assert {r.seuil: (r.faux_refus, r.fuites) for r in evaluate.threshold_sweep(df, "s", "p").collect()} == {0.1: (0, 2), 0.8: (0, 1), 0.9: (1, 0)}
    z = evaluate.zero_leak(df, "s", "p").first()
    assert (z.plancher, z.plafond, z.milieu, z.refuses) == (0.8, 0.9, 0.85, 1)
    assert evaluate.auc(df.where("false"), "s", "p").first().auc is None
    d = evaluate.dispersion(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("a", None)], "g string, v double"), "g", "v").collect()
    assert len(d) == 1 and d[0].etendue_pct == 100.0 and d[0].cv_pct == pytest.approx(70.7107)
    f, w = spark.createDataFrame([(1, [2, 1]), (2, [3])], "q int, niveaux array<int>"), spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, [1])], "q int, niveaux array<int>")
    assert tuple(evaluate.label_replay(f, w, "q").first()) == (3, 1)


def test_audits(spark):
    c = audit.interval_coverage(spark.createDataFrame([("g", 0, 5), ("g", 5, 8), ("g", 3, 6), ("g", 10, 12), ("g", None, 3), ("h", 2, 2)], "g string, x int, y int"), "g", "x", "y").collect()
    assert [(r.g, r.couvert, r.iles, r.etendue) for r in c] == [("g", 10, 2, 12)]
    s = spark.createDataFrame([("a", "directe", None), ("a", "directe", None), ("b", "methodologique", ""), ("c", "methodologique", "oui"), (None, None, None)], "id string, utilite_conseil string, exclusion string")
    assert {r.etat: (r.n, r.ids) for r in audit.perimeter_counts(s).collect()} == {"indexe": (1, "a"), "methodologique": (1, "b"), "exclu": (1, "c")}
    v = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, None)], "i bigint, e array<float>")
    assert tuple(audit.norm_deviation(v, "e").first()) == (2, pytest.approx(0.414214), 1)
    q = spark.createDataFrame([([0.5 / 127, 1.5 / 127, 2.0, -2.0],)], "e array<double>").select(vx.to_int8(F.col("e")).alias("q")).first().q
    assert q == [0, 2, 127, -127]
    t = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "texte string")
    assert audit.cache_misses(t, t.where("texte = 'a'"), "texte").count() == 1
    p = spark.createDataFrame([("d", 1, 1), ("d", 2, 3), ("d", 3, 2)], "d string, o int, p int")
    assert audit.page_order(p, "d", "o", "p").first().reculs == 1
    assert audit.profiler_scores(20, 10, 512, 1.0) == (100.0, 50.0)


RAW = "titre: Un titre\nlicence: null\nvide:\n=== x ===\n=== TEXTE ===\n[[page 1]]\n" + "Une phrase assez longue pour la page. " * 2 + "\n[[page 2]]\ncourt\n[[page 5]]  \n  " + "Autre page avec du texte suffisant. " * 30


def test_pages_and_headers(spark):
    d = spark.createDataFrame([(1, RAW), (2, "sans page"), (3, None), (4, "=== TEXTE ===\n[[page 2]]\nx\n[[page 2]]\ny"), (5, "avant\n[[page 7]]\napres")], "doc bigint, text string")
    p = segment.page_segments(d, "doc", "text").collect()
    assert [(r.doc, r.page) for r in p] == [(1, 1), (1, 5)]
    assert all(RAW[r.a : r.b] == r.texte == r.texte.strip() for r in p)
    h = {r.doc: r for r in segment.headers(d, "doc", "text").collect()}
    assert h[1].entete == {"titre": "Un titre", "licence": "", "vide": ""} and RAW[h[1].corps :].startswith("[[page 1]]")
    assert {r.doc: r.probleme for r in segment.page_problems(d, "doc", "text").collect()} == {2: "sans page", 4: "pages non croissantes", 5: "texte avant la premiere page"}


def test_packing(spark):
    random.seed(6)
    t = "".join(random.choice(["Une phrase de taille moyenne. ", "Voir cf. le tableau. ", "M. B. Sow écrit. ", "\n\n", "x" * random.randrange(1200), "Court. "]) for _ in range(60)).strip()
    units = segment.index_units(t, 955)
    assert all(0 < b - a <= 955 and t[a:b].strip() for a, b in units)
    ps = segment.pack_text(t)
    assert all(b - a <= 955 + 220 for a, b in ps) and ps == sorted(ps)
    seen = set().union(*(range(a, b) for a, b in ps))
    assert all(k in seen for k, c in enumerate(t) if not c.isspace())
    cut = segment.index_units("Voir cf. Tableau. Selon M. Sow. Puis env. 3 kg. Fin! oui.", 955)
    assert len(cut) == 4
    df = spark.createDataFrame([(1, 1, t, 100), (1, 2, None, 0), (1, 3, "", 0)], "doc bigint, page int, texte string, a bigint")
    out = segment.pack(df, ["doc", "page"], "texte", "a").orderBy("rang").collect()
    assert [(r.a - 100, r.b - 100) for r in out] == ps and all(r.texte == t[r.a - 100 : r.b - 100] for r in out)


def test_global_index(spark):
    from tamis.operators.prefix import global_index

    random.seed(3)
    rows = [(random.choice("aab"), random.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, __m int").repartition(5)
    got = {r["__m"]: r.n for r in global_index(df, ["g", "x", "__m"], "n").collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows))}
    assert global_index(df.where("false"), ["g"], "n").count() == 0


def test_more_audits(spark):
    s = spark.createDataFrame([("a", "directe", None), ("b", "autre", None), ("c", None, "oui")], "id string, utilite_conseil string, exclusion string")
    audit.lock(s, {"indexe": 2, "exclu": 1})
    with pytest.raises(ValueError):
        audit.lock(s, {"indexe": 3})
    assert [r.id for r in audit.scope_check(s).collect()] == ["b"]
    ids = lambda *x: audit.id_check(spark.createDataFrame([(k,) for k in x], "i bigint")).first().dense
    assert ids(0, 1, 2, 2) and not ids(0, 2) and not ids(1, 2) and ids()
    c = spark.createDataFrame([(1, "d", 1, (0, 5)), (2, "d", 1, (3, 12)), (3, "x", 1, (0, 1))], "i bigint, doc string, page int, off struct<a: bigint, b: bigint>")
    assert sorted(r.i for r in audit.page_containment(c, spark.createDataFrame([("d", 1, 0, 10)], "doc string, page int, a int, b int")).collect()) == [2, 3]
    t = spark.createDataFrame([(1, "un Mil\n<<\nmil\n>>\nsorgho mil"), (2, None)], "i int, t string")
    assert [(r.i, r.ligne, r.mot) for r in audit.lines_with(t, "i", "t", ["mil", "sorgho"], "<<", ">>").orderBy("ligne", "mot").collect()] == [(1, 1, "mil"), (1, 5, "mil"), (1, 5, "sorgho")]
    assert audit.lines_with(t, "i", "t", ["mil"]).count() == 3
    k = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "q int, i bigint, rang int")
    assert fusion.restrict(k, spark.createDataFrame([(2, "committed"), (1, "fetched")], "i bigint, regime string")).collect() == [(1, 2, 2)]


def test_prompts_and_citations(spark):
    p = spark.createDataFrame([("1", " q "), ("2", "r")], "prompt_id string, prompt string")
    lab = spark.createDataFrame([("x", "q"), ("x", "q"), ("y", "s")], "id string, requete string")
    assert {r.prompt_id: r.id for r in evaluate.match_prompts(p, lab).collect()} == {"1": "x", "2": None}
    with pytest.raises(Exception, match="several labels"):
        evaluate.match_prompts(p, lab.union(spark.createDataFrame([("z", "q")], "id string, requete string"))).collect()
    a = spark.createDataFrame([(1, 5, "a  b")], "q int, chunk bigint, citation string")
    b = spark.createDataFrame([(1, 5, "a b"), (1, 6, "c"), (2, 7, "d")], "q int, chunk bigint, citation string")
    d = {r.q: (r.seul_a, r.seul_b, r.communes, r.sous_ensemble_strict) for r in evaluate.citation_difference(a, b, "q").collect()}
    assert d == {1: (0, 1, 1, True), 2: (0, 1, 0, True)}
