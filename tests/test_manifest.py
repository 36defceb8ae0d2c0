from tamis.operators import audit
from tamis.sources import sinks


def test_below_minimum_and_manifest(spark):
    rows = [("b", 2, "x" * 219), ("b", 2, "x"), ("a", 10, ""), ("a", 1, "x" * 220), (None, None, "x"), ("c", 1, None)]
    c = spark.createDataFrame(rows, "doc string, page int, texte string")
    assert [r.id for r in audit.below_minimum(c).collect()] == [":p", "a:p10", "b:p2"]
    s = spark.createDataFrame([("a", "directe", None), ("a", "directe", None), ("b", "methodologique", None), ("c", None, "oui")], "id string, utilite_conseil string, exclusion string")
    corpus = spark.createDataFrame([(2.5,)], "avgdl double")
    m = sinks.manifest(c, c, corpus, sources=s, embedding={"modele": "m", "dim": 8}).first()
    assert m.ids_sous_mini == [":p", "a:p10", "b:p2"] and m.sous_mini == 4
    assert m.perimetre == {"indexe": 1, "methodologique": 1, "exclu": 1} and m.embeddings == {"modele": "m", "dim": "8"}
    m = sinks.manifest(c, c, corpus).first()
    assert m.perimetre is None and m.embeddings is None
