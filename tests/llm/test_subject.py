import random

import numpy as np
from pyspark.sql import functions as F

from tamis.llm import subject

WORDS = {"sport": ["arbitre", "tournoi", "ballon", "maillot", "finale"], "droit": ["tribunal", "decret", "bail", "juge", "article"], "sante": ["vaccin", "paludisme", "nourrisson", "infirmier", "fievre"]}
FILLER = ["Une reunion a ete tenue avec les participants du village.", "Le tableau resume les observations faites cette annee.", "Voir aussi la page du present recueil pour la methode."]


def sentence(r, area):
    a, b, c = r.choices(WORDS[area], k=3)
    return f"Le {a} de la saison concerne le {b} et le {c}."


def corpus(n, seed):
    r, docs, truth = random.Random(seed), [], []
    for _ in range(n):
        own = r.sample(sorted(WORDS), r.choice([1, 1, 2]))
        s = [sentence(r, a) for a in own for _ in range(3)] + r.choices(FILLER, k=3)
        r.shuffle(s)
        docs.append("editeur: x\nlangue: fr\n=== TEXTE ===\n[[page 1]]\n" + " ".join(s))
        truth.append(own)
    return docs, truth


def test_held_out_accuracy():
    docs, truth = corpus(150, 1)
    model = subject.fit(docs, [[t[0]] if k % 11 else ["sport"] for k, t in enumerate(truth)], tuple(sorted(WORDS)))
    docs, truth = corpus(100, 2)
    hits, n = subject.classify(docs, model)
    found = hits / n[:, None] >= subject.SHARE
    want = np.array([[a in t for a in model.areas] for t in truth])
    assert (found == want).mean() > 0.97
    assert n.tolist() == [3 * len(t) + 3 for t in truth]


def test_sentences():
    s = subject.sentences(["Un deux trois quatre. cinq six sept huit! Neuf dix onze douze\nsuite de la phrase.\n\nTitre court\n[[page 3]]", "", "Rien"])
    assert s.of.tolist() == [0, 0]
    assert len(subject.sentences([]).of) == 0 and len(subject.sentences(["", "\n"]).of) == 0


def test_operator(spark):
    docs, truth = corpus(80, 3)
    rows = [(k, d) for k, d in enumerate(docs)] + [(900, None), (901, ""), (902, "  "), (0, docs[0]), (903, "mot " * 50_000)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, phrases string")
    lab = spark.createDataFrame([(k, t[0]) for k, t in enumerate(truth)] + [(0, "inconnu"), (1, None)], "doc_id bigint, domaine string")
    areas = spark.createDataFrame([(a,) for a in WORDS] + [(None,)], "domaine string")
    model = subject.train(d, lab, areas)
    out = subject.subjects(d, model, ["doc_id"], chars=500)
    got = {r.doc_id: {x.domaine for x in r.domaines if x.traite} for r in out.collect()}
    assert got[900] == got[901] == got[902] == set()
    assert sum(got[k] == set(t) for k, t in enumerate(truth)) >= 72
    assert {r.domaine for r in subject.composition(out).collect()} == set(WORDS)
    none = subject.subjects(d.where("false"), model, ["doc_id"])
    assert none.count() == 0 and out.where(F.col("phrases") == 0).count() >= 3


def test_train_on_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    model = subject.train(d, spark.createDataFrame([], "doc_id bigint, domaine string"), spark.createDataFrame([("a",)], "domaine string"))
    hits, n = subject.classify(["Un deux trois quatre cinq."], model)
    assert hits.sum() == 0 and n.tolist() == [1]


def test_thresholds_follow_held_back_labels():
    # Six sentences a document; one at 0.7 in documents with the label, one at 0.4 in those without.
    given = np.array([[1.0]] * 30 + [[0.0]] * 30)
    p = np.full((360, 1), 0.1)
    p[::6, 0] = np.where(given[:, 0] > 0, 0.7, 0.4)
    (t,), recall, precision = subject.calibrate(p, np.repeat(np.arange(60), 6), given)
    assert 0.4 < t <= 0.7 and recall == precision == 1
    (t,), recall, precision = subject.calibrate(p[:180], np.repeat(np.arange(30), 6), given[:30])
    assert t <= 0.7 and recall == precision == 1


def test_thresholds_come_from_documents_that_no_stage_saw():
    docs, truth = corpus(150, 4)
    labels = [[t[0]] for t in truth]
    seen = []
    old = subject.attribute
    subject.attribute = lambda s, g: seen.append(len(g)) or old(s, g)
    try:
        model = subject.fit(docs, labels, tuple(sorted(WORDS)))
    finally:
        subject.attribute = old
    assert sorted(seen) == [120, 150] and model.recall > 0.9 and 0.5 < model.precision <= 1
    part = subject._of(subject.many_sentences(docs), np.arange(150) % 5 == 4)
    own = subject.many_sentences(docs[4::5])
    assert all((a == b).all() for a, b in zip(part, own))


def test_header_mark_anywhere():
    assert subject.body("a: b\n" * 5_000 + "=== TEXTE ===\nCorps.") == "\nCorps."
