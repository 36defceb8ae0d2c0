import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import audit, dense, lexical, segment
from tamis.plans import catalogue, extra


def covered(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sum(b - a for a, b in out), len(out), out[-1][1] - out[0][0]


@pytest.mark.parametrize("stretch", [3, 10, 100_000])
def test_interval_coverage_equals_brute_force(spark, stretch):
    r = random.Random(stretch)
    rows = [(r.choice(["a", "b", None]), a := r.randint(-40, 60), a + r.randint(-1, 25)) for _ in range(60)] + [("c", 0, 3), ("c", 3, 6), ("c", 9, 12), ("d", None, 2), ("e", 5, 5)]
    got = {x.g: (x.couvert, x.iles, x.etendue) for x in audit.interval_coverage(spark.createDataFrame(rows, "g string, x int, y int"), "g", "x", "y", stretch).collect()}
    spans = {}
    for g, a, b in rows:
        if a is not None and a < b:
            spans.setdefault(g, []).append((a, b))
    assert got == {g: covered(s) for g, s in spans.items()}


@pytest.mark.parametrize("block,few", [(1, True), (3, False), (100, True)])
def test_blocks_find_what_all_pairs_find(spark, block, few, monkeypatch):
    r = np.random.default_rng(1)
    v = [(k, [float(x) for x in np.round(r.normal(size=4), 2)]) for k in range(40)] + [(90, None), (None, [1.0] * 4), (91, [1.0]), (92, [1.0, None, 1.0, 1.0]), (93, [0.0] * 4), (94, [0.0] * 4)]
    df = spark.createDataFrame(v, "i bigint, e array<double>").repartition(3)
    monkeypatch.setattr(dense, "ROWS", 7)
    if not few:
        monkeypatch.setattr(dense, "small", lambda d: d)
    got = {(x.q, x.i, x.cos, x.rang) for x in dense.search(df, df.where("i < 7").select(F.col("i").alias("q"), "e"), "i", "e", "q", "e", 5, False, block).collect()}
    rows = {k: np.array(e) for k, e in v if k is not None and e and len(e) == 4 and None not in e}
    want = set()
    for q in range(7):
        best = sorted((-round(float(rows[q] @ e), 6) + 0.0, k) for k, e in rows.items() if k != q)[:5]
        want |= {(q, k, -s + 0.0, n + 1) for n, (s, k) in enumerate(best)}
    assert got == want
    q = df.select(F.col("i").alias("q"), "e")
    assert dense.search(df, q.where("false"), "i", "e", "q", "e").count() == 0 and dense.search(df.where("false"), q, "i", "e", "q", "e").count() == 0


def test_page_order_counts_across_partitions(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.choice([None, 1, 2, 3])) for k in range(300)]
    got = {x.d: x.reculs for x in audit.page_order(spark.createDataFrame(rows, "d string, i int, p int").repartition(5), "d", "i", "p").collect()}
    for d in ("a", "b"):
        p = [x[2] for x in rows if x[0] == d and x[2] is not None]
        assert got[d] == sum(y < x for x, y in zip(p, p[1:]))
    assert set(got) == {"a", "b"}


def test_index_finds_what_search_finds(spark, tmp_path):
    docs = spark.createDataFrame([(0, "le mil et le sorgho"), (1, "mil mil mil"), (2, None), (3, ""), (4, "eau du puits"), (5, "mil-eau mil")], "i bigint, texte string")
    q = spark.createDataFrame([(9, "mil eau mil"), (8, "absent"), (7, None)], "ligne bigint, requete string")
    lexical.write_index(docs, "i", "texte", str(tmp_path / "x"), buckets=4, parts=2)
    got = lexical.search_index(spark, str(tmp_path / "x"), q, "ligne", "requete").collect()
    assert sorted(got) == sorted(lexical.search(docs, q, "i", "texte", "ligne", "requete").collect()) and len(got) == 4
    lexical.write_index(docs.where("false"), "i", "texte", str(tmp_path / "y"))
    assert lexical.search_index(spark, str(tmp_path / "y"), q, "ligne", "requete").count() == 0
    lists = {(r.terme, r.bloc): [tuple(x) for x in r.liste] for r in lexical.posting_lists(lexical.postings(docs, "i", "texte"), "i", 5).collect()}
    assert lists["mil", 0] == [(0, 1), (1, 3)] and lists["mil", 1] == [(5, 2)]


def test_marks_however_typed(spark):
    body = "Une phrase assez longue pour une page du document."
    t = f"titre: x\n＝== ТЕXTE ===\n[[page 1]]\n{body}\n［[pаge １​２］] \n{body}\n[[page 3]] suite\n"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, text string")
    got = [(r.page, r.a, r.b, r.texte) for r in segment.page_segments(d, "k", "text", marker=segment.SEEN_MARKER).orderBy("page").collect()]
    assert [p for p, *_ in got] == [1, 12] and all(t[a:b] == x for _, a, b, x in got) and "[[page 3]] suite" in got[1][3]
    assert [r.page for r in segment.page_segments(d, "k", "text").collect()] == [1]
    (r,) = segment.sentinel_lines(d.withColumn("text", F.replace("text", F.lit("ТЕXTE"), F.lit("TEXTE"))), "k", "text").collect()
    assert t[: r.corps].endswith("===") and t[r.corps :].startswith("\n[[page 1]]")


def test_perimeter_sets_overlap(spark):
    s = spark.createDataFrame([("a", None, "directe"), ("b", " hors ", "methodologique"), ("b", " hors ", "methodologique"), ("c", " ", "methodologique"), ("d", "double", None), (None, "x", None)], "id string, exclusion string, utilite_conseil string")
    assert {tuple(r) for r in audit.perimeter_overlap(s).collect()} == {("sources", 4), ("methodologique", 2), ("exclu", 2), ("indexe", 1)}
    assert {r.entree for r in audit.exclusions(s).collect()} == {"b:hors", "d:double"}


def test_every_query_has_a_name_of_its_own():
    assert not set(catalogue.QUERIES) & set(extra.QUERIES) and set(extra.ORACLE) <= set(catalogue.QUERIES) | set(extra.QUERIES)
    assert not set(catalogue.ORACLE) & set(extra.ORACLE)
