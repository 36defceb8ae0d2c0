from datetime import datetime

from tamis.plans import catalogue

CHUNKS = "i bigint, doc string, page int, texte string, lot int, charge_le timestamp"
AT = datetime(2026, 1, 1)


def test_same_page_neighbours_resolve_the_source(spark, tmp_path):
    docs = ["Guide_mil", " guide-MIL.pdf ", "guide_mil.txt", "autre", None]
    spark.createDataFrame([(k, d, 1, "x", 1, AT) for k, d in enumerate(docs)], CHUNKS).write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.i: (r.avant, r.apres) for r in catalogue.same_page_neighbours(spark, str(tmp_path)).collect()}
    assert got == {0: (None, 1), 1: (0, 2), 2: (1, None), 3: (None, None), 4: (None, None)}


def test_shared_edges_resolve_the_source_and_count_all(spark, tmp_path):
    rows = [("Guide_mil", 1, "a" * 40 + "b" * 80), (" guide-MIL.pdf ", 1, "b" * 80 + "c"), ("guide_mil.txt", 2, "b" * 80), (None, 1, "b" * 80), ("autre", 1, " "), ("autre", 1, None)]
    spark.createDataFrame([(k, *r, 1, AT) for k, r in enumerate(rows)], CHUNKS).write.parquet(str(tmp_path / "chunks.parquet"))
    assert catalogue.shared_edges(spark, str(tmp_path)).first().asDict() == {"n": 6, "queue": 1, "tete": 1, "union": 2}
    spark.createDataFrame([], CHUNKS).write.parquet(str(tmp_path / "none" / "chunks.parquet"))
    assert catalogue.shared_edges(spark, str(tmp_path / "none")).first().asDict() == {"n": 0, "queue": 0, "tete": 0, "union": 0}


def test_dense_margins_of_every_query(spark, tmp_path):
    rows = [(100, [1.0, 0.0], 1), (101, [0.9, 0.1], 1), (102, [0.5, 0.5], 2), (103, [0.95, 0.0], 2), (200, [0.0, 1.0], 2), (300, [0.0, 0.2], None)]
    t = "vec_id bigint, embedding array<float>, label int"
    spark.createDataFrame(rows, t).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.q: (r.marge, r.marge_medianes, r.rang_premier) for r in catalogue.dense_margins(spark, str(tmp_path)).collect()}
    assert got == {100: (-0.05, 0.4, 2), 200: (0.4, 0.2, 1), 300: (None, None, 1)}
    spark.createDataFrame([], t).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert catalogue.dense_margins(spark, str(tmp_path / "none")).count() == 0
