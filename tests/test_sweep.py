import random

from tamis.operators import evaluate


def test_sweep_and_auc_are_exact(spark):
    random.seed(4)
    rows = [(random.choice([round(random.random(), 6), 0.7460, 0.75, 0.70001, 0.70002]), random.random() < 0.6) for _ in range(800)]
    df = spark.createDataFrame(rows, "s double, p boolean").repartition(5)
    got = {r.seuil: (r.faux_refus, r.fuites) for r in evaluate.threshold_sweep(df, "s", "p").collect()}
    assert got == {t: (sum(p and s < t for s, p in rows), sum(not p and s >= t for s, p in rows)) for t, _ in rows}
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert tuple(evaluate.auc(df, "s", "p").first()) == (round(want, 6), len(pos), len(neg))
    near = spark.createDataFrame([(0.50001, True), (0.50002, False)], "s double, p boolean")
    assert evaluate.auc(near, "s", "p").first().auc == 0.0
    assert evaluate.threshold_sweep(df.where("false"), "s", "p").count() == 0
