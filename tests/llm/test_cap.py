import random

from pyspark.sql import functions as F

from tamis.llm import cap


def test_ranks_equal_brute_force(spark):
    random.seed(1)
    rows = [(random.choice(["a", "b", None, "chaud"] + ["chaud"] * 6), random.choice([None, 0.5, 0.25, float(k % 7)]), k, "x") for k in range(2_000)]
    df = spark.createDataFrame(rows, "s string, q double, i bigint, p string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    out = cap.rank_in_contributor(df, ["s"], [F.col("q").desc_nulls_last(), F.col("i").asc()]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert {r.i: r.rang_source for r in out} == want and len(out) == len(rows)


def test_caps(spark):
    df = spark.createDataFrame([("a", k, 2, None) for k in range(5)] + [("b", 9, None, None)], "s string, i bigint, m int, exempte string")
    kept = {r.i for r in cap.cap_contributors(df, ["s"], [F.col("i").asc()], "m").where("not retire").collect()}
    assert kept == {0, 1, 9}
    kept = {r.i for r in cap.cap_contributors(df, ["s"], [F.col("i").asc()], share=0.5).where("not retire").collect()}
    assert kept == {0, 1, 2, 9}
    assert cap.cap_contributors(df, ["s"], [F.col("i").asc()], 1, exempt=F.col("s") == "a").where("retire").count() == 0
    assert cap.cap_contributors(df.where("false"), ["s"], [F.col("i").asc()], 1).count() == 0


def test_candidates(spark):
    cand = spark.createDataFrame([(1, 1, i, r, None) for i, r in ((1, 0.3), (2, 0.3), (3, None), (4, 0.9), (5, 0.1), (1, 0.3))] + [(2, 9, 1, 0.5, None)], "ligne bigint, calib int, i bigint, rrf double, calcule_le timestamp")
    chunks = spark.createDataFrame([(1, "S_1.PDF", None), (2, " s-1", None), (3, "s_1", None), (4, None, None), (5, "autre", None)], "i bigint, doc string, charge_le timestamp")
    src = spark.createDataFrame([("s_1",), ("s_1",)], "id string")
    seuils = spark.createDataFrame([(1, (1,), None)], "calib int, parametres_retrieve_au_moment_ struct<max_par_doc: int>, calibre_le timestamp")
    out = cap.cap_candidates(cand, chunks, src, seuils).collect()
    assert len(out) == 6
    assert {(r.ligne, r.i) for r in out if r.retire} == {(1, 2), (1, 3)}
