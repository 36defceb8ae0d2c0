import random
from datetime import datetime

import pytest

from tamis.operators import lexical
from tamis.plans import catalogue


@pytest.fixture
def kept(monkeypatch):
    """What is written between the steps of a search."""
    made = []

    def cut(df, real=lexical.cut):
        made.append(real(df))
        return made[-1]

    for module in (lexical, catalogue):
        monkeypatch.setattr(module, "cut", cut)
    return made


def texts(spark, n):
    rng = random.Random(4)
    words = [f"mot{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=20)) if k % 50 else None) for k in range(n)], "i bigint, texte string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(rng.sample(words, 8))) for k in range(12)], "ligne bigint, requete string")
    return docs, asked


def test_search_keeps_blocks_not_a_row_per_posting(spark, kept):
    docs, asked = texts(spark, 1_000)
    assert lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).count() == 120
    assert sum(df.count() for df in kept) < 500


def test_more_terms_than_a_task_gets_are_searched_in_groups(spark, monkeypatch):
    docs, asked = texts(spark, 300)
    want = sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect()))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 30)
    assert sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect())) == want and len(want) == 120


def test_keys_of_strings_and_blocks_of_few_documents(spark):
    docs, asked = texts(spark, 300)
    docs = docs.selectExpr("concat('d', lpad(i, 4, '0')) AS i", "texte")
    want = sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect()))
    assert sorted(map(tuple, lexical.search(docs.repartition(43), asked, "i", "texte", "ligne", "requete", 10).collect())) == want and len(want) == 120


def test_index_keeps_packed_lists_not_a_row_per_posting(spark, kept, tmp_path):
    docs, asked = texts(spark, 1_000)
    lexical.write_index(docs, "i", "texte", str(tmp_path / "x"), buckets=4, parts=2)
    rows = spark.read.parquet(str(tmp_path / "x" / "postings")).count()
    assert rows < 500 and sum(df.count() for df in kept) < 500
    got = lexical.search_index(spark, str(tmp_path / "x"), asked, "ligne", "requete", k=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect()))


def test_hybrid_search_keeps_no_texts(spark, kept, tmp_path):
    at = datetime(2026, 1, 1)
    chunks = [(k, "d", (100 * k, 100 * k + 90), f"mil semis {'pluie' if k % 2 else 'sorgho'}", at) for k in range(6)]
    spark.createDataFrame(chunks, "i bigint, doc string, off struct<a: bigint, b: bigint>, texte string, charge_le timestamp").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "pluie", at), (2, "sorgho", at), (100, "pluie", at)], "ligne bigint, requete string, recu_le timestamp").write.parquet(str(tmp_path / "qcm.parquet"))
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.ligne, r.rang): r.i for r in catalogue.hybrid_live(spark, str(tmp_path), every=1).where("ligne < 100").collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 2, (2, 2): 0, (2, 3): 1}
    assert kept and not any("texte" in df.columns for df in kept)
    kept.clear()
    assert {(r.ligne, r.i): (r.rang_bm25, r.rang_dense) for r in catalogue.hybrid_fused(spark, str(tmp_path)).collect()} == {(100, 1): (1, None), (100, 3): (2, None), (100, 5): (3, None)}
    assert kept and not any("texte" in df.columns for df in kept)


def test_a_task_passes_on_the_best_of_all_its_blocks(spark, monkeypatch):
    docs, asked = texts(spark, 1_000)
    want = sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect()))
    passed = []

    def top(scored, *args, real=lexical.top):
        passed.append(scored.count())
        return real(scored, *args)

    monkeypatch.setattr(lexical, "top", top)
    monkeypatch.setattr(lexical, "TASKS", 1, raising=False)
    for held in (1_000_000, 50):
        monkeypatch.setattr(lexical, "HELD", held, raising=False)
        assert sorted(map(tuple, lexical.search(docs.repartition(43), asked, "i", "texte", "ligne", "requete", 10).collect())) == want
    assert passed[0] < 1_000 and passed[0] <= passed[1] < 3_000


def test_texts_stay_where_they_are_for_any_number_of_passages_found(spark, monkeypatch):
    places = []

    def fuse(a, b, chunks, *args, real=catalogue.fusion.fuse):
        places.append(chunks)
        return real(a, b, chunks, *args)

    monkeypatch.setattr(catalogue.fusion, "fuse", fuse)
    few = sorted(map(str, catalogue._live(spark, "/root/testdata/sf0.001", every=1).collect()))
    monkeypatch.setattr(catalogue, "small", lambda df: df)
    assert sorted(map(str, catalogue._live(spark, "/root/testdata/sf0.001", every=1).collect())) == few and len(few) > 100

    def joins(node):
        if node.nodeName() == "Join" and "broadcast" not in node.hint().toString():
            yield node.left().output().toString()
        for k in range(node.children().size()):
            yield from joins(node.children().apply(k))

    at = list(joins(places[1]._jdf.queryExecution().optimizedPlan()))
    assert at and not any("texte" in x for x in at)


def three_questions(spark, at):
    """Tables of six passages and questions 1, 2 and 100, of which the last has no vector."""
    when = datetime(2026, 1, 1)
    chunks = [(k, "d", (100 * k, 100 * k + 90), f"mil semis {'pluie' if k % 2 else 'sorgho'}", when) for k in range(6)]
    spark.createDataFrame(chunks, "i bigint, doc string, off struct<a: bigint, b: bigint>, texte string, charge_le timestamp").write.parquet(f"{at}/chunks.parquet")
    spark.createDataFrame([(1, "pluie", when), (2, "sorgho", when), (100, "pluie", when)], "ligne bigint, requete string, recu_le timestamp").write.parquet(f"{at}/qcm.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_hybrid_fused_has_every_question(spark, tmp_path):
    got = {(r.ligne, r.i): (r.rang_bm25, r.rang_dense) for r in catalogue.QUERIES["hybrid_fused"](spark, three_questions(spark, tmp_path)).collect()}
    assert got == {(1, 1): (1, 1), (1, 3): (2, None), (1, 5): (3, None), (1, 2): (None, 2), (2, 0): (1, None), (2, 2): (2, 1), (2, 4): (3, None), (2, 1): (None, 2), (100, 1): (1, None), (100, 3): (2, None), (100, 5): (3, None)}
    assert "ligne %" not in catalogue.ORACLE["hybrid_fused"]


def test_hybrid_live_has_every_question(spark, tmp_path):
    got = {(r.ligne, r.rang): r.i for r in catalogue.QUERIES["hybrid_live"](spark, three_questions(spark, tmp_path)).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 2, (2, 2): 0, (2, 3): 1, (100, 1): 1, (100, 2): 3, (100, 3): 5}
    assert "ligne %" not in catalogue.ORACLE["hybrid_live"]


def test_many_queries_are_dealt_out_and_meet_all_blocks(spark, monkeypatch):
    docs, asked = texts(spark, 1_000)
    want = sorted(map(tuple, lexical.search(docs, asked, "i", "texte", "ligne", "requete", 10).collect()))
    passed = []

    def top(scored, *args, real=lexical.top):
        passed.append(scored.count())
        return real(scored, *args)

    monkeypatch.setattr(lexical, "top", top)
    monkeypatch.setattr(lexical, "QUERIES", 5)
    for often in (50, 1):  # with rows for frequent terms, and with none
        monkeypatch.setattr(lexical, "OFTEN", often, raising=False)
        assert sorted(map(tuple, lexical.search(docs.repartition(43), asked, "i", "texte", "ligne", "requete", 10).collect())) == want
    assert max(passed) < 500
