import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import langid

FR = ["Le semis se fait après la première pluie utile du mois de juin.", "Les producteurs gardent le mil jusqu'à la soudure pour profiter des prix.", "Il faut choisir entre le labour et la jachère.", "Merci de citer la source et la page."]
EN = ["Sowing is done after the first useful rain of the month of June.", "Farmers keep the millet until the lean season to profit from prices.", "A choice has to be made between ploughing and fallow.", "Please quote the source and the page."]
ES = ["La siembra se hace después de la primera lluvia útil del mes de junio.", "Los productores guardan el mijo hasta la escasez para aprovechar los precios.", "Hay que elegir entre la labranza y el barbecho.", "Por favor, cite la fuente y la página."]
PT = ["A sementeira faz-se depois da primeira chuva útil do mês de junho.", "Os produtores guardam o milheto até junho para aproveitar os preços altos.", "É preciso escolher entre a lavoura e o pousio.", "Por favor, cite a fonte e a página."]
TEXTS = {"fr": FR, "en": EN, "es": ES, "pt": PT}


@pytest.fixture(scope="module")
def model():
    t, x = zip(*[(s, k) for k, v in TEXTS.items() for s in v for _ in range(5)])
    return langid.fit(list(t), list(x))


def langs(found):
    return [langid.LANGUAGES[s[2]] for s in found]


def test_single(model):
    texts = [s for v in TEXTS.values() for s in v]
    assert [langs(x) for x in langid.infer(texts, model)] == [[k] for k, v in TEXTS.items() for _ in v]
    assert [langs(x) for x in langid.infer([t.upper() for t in texts[:8]], model)] == [["fr"]] * 4 + [["en"]] * 4


def test_mixed(model):
    t = " ".join(FR) + "\n" + " ".join(EN) + " " + " ".join(PT)
    (found,) = langid.infer([t], model)
    assert langs(found) == ["fr", "en", "pt"]
    assert found[0][0] == 0 and found[-1][1] == len(t) and [s[1] for s in found[:-1]] == [s[0] for s in found[1:]]
    assert all(0.5 < s[3] <= 1 for s in found)
    assert t[found[1][0] : found[1][1]].strip().startswith("Sowing") or t[found[1][0] :].startswith("Sowing")


def test_quotes_and_numbers_say_nothing(model):
    t = "Le semis se fait après la pluie. Voir « A choice has to be made between ploughing » page 9 du présent recueil. - 12 % 45,3 8 - - 99\n1 | 2 | 3"
    assert [langs(x) for x in langid.infer([t], model)] == [["fr"]]
    assert langid.infer(["", "  ", "12 - 3 %", "\n"], model) == [[], [], [], []]


def test_a_text_depends_on_itself(model):
    texts = [" «" + EN[0], FR[0][:9], "", "a", FR[1] + " »", EN[1][:14], "«Merci» " + ES[0], " ", " ".join(FR) + "\n" + " ".join(EN), PT[2][:12] + "  ", "qu", "« la page » of the month"]
    alone = [langid.infer([t], model)[0] for t in texts]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), (4, 0, 11, 2, 6, 9, 1, 5, 3, 10, 8, 7)):
        for k, found in zip(order, langid.infer([texts[k] for k in order], model)):
            assert [s[:3] for s in found] == [s[:3] for s in alone[k]]
            assert [s[3] for s in found] == pytest.approx([s[3] for s in alone[k]], abs=1e-9)


def test_pruning_is_exact(model):
    lut, _ = langid.symbols()
    ll = np.array([[3.0, 0, 1, 0], [2.0, 1, 0, 0], [1.0, 1.5, 0, 0]])
    chosen, share = langid.mixture(ll, penalty=8.0)
    assert chosen == (0,) and share.sum() == pytest.approx(1)
    chosen, share = langid.mixture(np.array([[30.0, 0, 0, 0], [0, 30.0, 0, 0]]), penalty=8.0)
    assert chosen == (0, 1) and share == pytest.approx([0.5, 0.5])


def test_named(spark):
    rows = [("français", ["fr"]), ("fr-XX", ["fr"]), ("EN", ["en"]), ("fr/en/es", ["fr", "en", "es"]), (" pt-PT ", ["pt"]), ("n/a", []), (None, []), ("", []), ("de", []), ("español", ["es"])]
    df = spark.createDataFrame([(a,) for a, _ in rows], "l string")
    assert [r.n for r in df.select(langid.named(F.col("l")).alias("n")).collect()] == [b for _, b in rows]


def test_operator(spark, model):
    rows = [(1, FR[0], "en"), (2, FR[0] + " " + FR[1] + "\n" + EN[0] + " " + EN[1], "fr"), (3, None, None), (4, " ", "fr"), (5, EN[1], "English"), (1, FR[0], "en"), (6, "x" * 100_000, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "i bigint, texte string, langue string, segments string")
    out = langid.languages(df, "texte", ["i", "langue"], model, chars=50)
    got = {r.i: r for r in out.collect()}
    assert got[1].langue_trouvee == "fr" and got[5].langue_trouvee == "en" and got[3].segments == [] and got[4].confiance is None
    assert [(s.seg, s.langue) for s in got[2].segments] == [(0, "fr"), (1, "en")]
    assert {r.i for r in langid.mislabelled(out, "langue").where("i < 6").collect()} == {1, 2}
    assert langid.languages(df.where("false"), "texte", ["i"], model).count() == 0


def test_train_on_nothing(spark):
    m = langid.train(spark.createDataFrame([], "texte string, langue string"), "texte", "langue")
    assert langid.infer(["Bonjour le monde"], m) == [[]]
