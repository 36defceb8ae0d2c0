import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.plans import index_build, search
from tamis.sources import readers, sinks
from tamis.streaming import queries as stream

TEXT = "titre: Fiche\nlicence: null\ncitation_verbatim_autorisee: oui\n=== TEXTE ===\n[[page 1]]\n" + "Le mil se sème en juin dans le sable. " * 30 + "\n[[page 2]]\n" + "Le sorgho aime la pluie du mois de mai. " * 5


def test_index_and_search(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    for n in ("a", "b", "hors"):
        (tmp_path / "txt" / f"{n}.txt").write_text(TEXT, encoding="utf-8", newline="")
    reg = [{"id": "a", "annee": 2020, "utilite_conseil": "directe", "regime": "committed", "fichier": "a.txt", "octets_attendus": len(TEXT.encode())}, {"id": "b", "annee": "s.d.", "utilite_conseil": "indirecte", "regime": "fetched", "fichier": "b.txt", "octets_attendus": 3}, {"id": "hors", "utilite_conseil": "methodologique"}, {"id": "z", "utilite_conseil": "directe", "fichier": "z.txt", "regime": "fetched"}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in reg).replace("2020", '"2020"'))
    r = readers.registry(spark, str(tmp_path / "r.json"))
    assert {x.fichier: x.etat for x in readers.fetched(spark, str(tmp_path / "txt"), r).collect()} == {"a.txt": "ok", "b.txt": "taille", "z.txt": "absent"}
    assert readers.fetched(spark, str(tmp_path / "txt"), r, "committed").count() == 1
    idx = index_build.build(r, readers.provenance_texts(spark, str(tmp_path / "txt")))
    rows = idx.chunks.orderBy("i").collect()
    assert [x.i for x in rows] == list(range(len(rows))) and {x.doc for x in rows} == {"a", "b"}
    assert all(TEXT[x.off.a : x.off.b] == x.texte and x.titre == "Fiche" and x.citation_verbatim_autorisee == "oui" for x in rows)
    assert [(x.doc, x.page, x.off.a) for x in rows] == sorted((x.doc, x.page, x.off.a) for x in rows)
    assert {x.id: x.n_chunks for x in idx.documents.collect()} == {"a": len(rows) // 2, "b": len(rows) // 2}
    v = spark.createDataFrame([(x.i, [1.0, 0.0] if x.page == 1 else [0.0, 1.0]) for x in rows], "i bigint, embedding array<float>")
    q = spark.createDataFrame([(1, "Quand semer le mil ?", [1.0, 0.0]), (2, "sorgho", [0.0, 1.0])], "ligne bigint, requete string, vecteur array<float>")
    f = search.search(q, idx.chunks, v)
    pages = {x.i: x.page for x in rows}
    kept = {x.ligne: [pages[k.i] for k in x.retenus] for x in f.selection.collect()}
    assert kept[1][0] == 1 and kept[2][0] == 2 and f.gate.count() == 2
    m = sinks.manifest(idx.chunks, idx.postings.select("terme").distinct(), idx.lengths.agg(F.avg("dl").alias("avgdl"))).first()
    assert m.n == len(rows) and m.liste_arret_n == 169 and len(m.liste_arret_sha) == 16


def test_yaml_registry(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump({"sources": [{"id": "a", "annee": 2019, "pages": 3, "caveats": ["x"], "licence": None}]}))
    r = readers.registry(spark, str(tmp_path / "s.yaml")).first()
    assert (r.id, r.annee, r.pages, r.caveats, r.licence) == ("a", "2019", 3, ["x"], None)


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"i": 0, "doc": "d", "off": [3, 9], "texte": "abcdef"}) + "\n" + json.dumps({"i": 1}) + "\n")
    a, b = readers.chunks(spark, str(tmp_path / "c.jsonl")).orderBy("i").collect()
    assert (a.off.a, a.off.b, b.off) == (3, 9, None)
    x = np.random.default_rng(0).normal(size=(10, 4)).astype(np.float16)
    np.save(tmp_path / "v.npy", x)
    got = readers.vectors(spark, str(tmp_path / "v.npy"), rows_per_part=3).orderBy("i").collect()
    assert np.allclose([r.embedding for r in got], x.astype(np.float32)) and [r.i for r in got] == list(range(10))
    (tmp_path / "b.json").write_text(json.dumps({"k1": 1.2, "b": 0.75, "n_chunks": 2, "avgdl": 1.5, "doclen": [1, 2], "postings": {"mil": [[0, 1], [1, 2]]}}))
    p, d, s = readers.postings(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, p.collect())) == [("mil", 0, 1), ("mil", 1, 2)] and s["avgdl"] == 1.5 and d.count() == 2
    (tmp_path / "q.jsonl").write_text('{"id": "x", "niveau_attendu": "1+2"}\n\n')
    assert readers.labels(spark, str(tmp_path / "q.jsonl")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"test_prompts": [{"prompt_id": "1", "prompt": "p"}, {"prompt_id": "2"}]}))
    with pytest.raises(Exception, match="prompt"):
        readers.prompts(spark, str(tmp_path / "m.json")).collect()
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "run1.json").write_text(json.dumps({"throughput": {"tokens_per_second_generation": 2.5}}))
    (tmp_path / "runs" / "run2.json").write_text("{broken")
    assert [r.throughput.tokens_per_second_generation for r in readers.profiler_runs(spark, str(tmp_path / "runs")).collect()] == [2.5]


@pytest.mark.parametrize("change,ok", [({}, True), ({"sens": "<"}, False), ({"repli_si_absente": None}, False), ("first", False)])
def test_threshold_guards(tmp_path, change, ok):
    doc = {"porte_niveau_1_contre_2": "AUCUN seuil scalaire", "porte_niveau_2_contre_3": {"statistique": "a", "repli_si_absente": "b", "seuil": 0.4, "sens": "valeur >= seuil"}}
    if change == "first":
        doc["porte_niveau_1_contre_2"] = {"seuil": 0.5}
    else:
        doc["porte_niveau_2_contre_3"].update(change)
    (tmp_path / "s.json").write_text(json.dumps(doc))
    if ok:
        assert readers.thresholds(str(tmp_path / "s.json"))["seuil"] == 0.4
    else:
        with pytest.raises(ValueError):
            readers.thresholds(str(tmp_path / "s.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", [0.5, -2.0])], "i int, b string, embedding array<double>")
    sinks.json_lines(df.drop("embedding"), str(tmp_path / "j"))
    line = "".join((tmp_path / "j" / f).read_text(encoding="utf-8") for f in os.listdir(tmp_path / "j") if f.startswith("part"))
    assert line == '{"b":"é","i":1}\n'
    sinks.json_document({"b": 1, "a": [2]}, str(tmp_path / "d.json"))
    assert open(tmp_path / "d.json").read().startswith('{\n "a"')
    sinks.vectors(df, str(tmp_path / "v8"), dtype="int8")
    assert spark.read.parquet(str(tmp_path / "v8")).first().embedding == [64, -127]
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "texte string")
    none = spark.createDataFrame([], "cle string, texte string, embedding array<float>")
    add = lambda d: d.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    sinks.embed_missing(texts.where("texte = 'a'"), "texte", none, add, str(tmp_path / "cache"))
    sinks.embed_missing(texts, "texte", spark.read.parquet(str(tmp_path / "cache")), add, str(tmp_path / "cache"))
    assert sorted(r.texte for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == ["a", "b"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", "fr"), (1, "q", "fr"), (2, "r", "en")], "ligne bigint, requete string, langue string").withColumn("recu_le", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.answer_stream(s, lambda df: df.select("ligne", F.upper("requete").alias("r")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.ligne, r.r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "Q"), (2, "R")]
    w = stream.question_counts(s).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert {r.langue: r["count"] for r in spark.sql("select * from w").collect()} == {"fr": 2, "en": 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() >= 0
