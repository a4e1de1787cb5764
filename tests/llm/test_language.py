import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import language as lg

SAMPLES = {
    "en": ["The careful engineer finds the old map behind the house.", "Who sells the warm blanket at the market when the mayor sleeps?", "Every morning my sister opens the kitchen window."],
    "de": ["Der Bäcker reinigt den gelben Regenschirm hinter dem Rathaus.", "Wer verkauft die warme Decke auf dem Markt, und warum schläft der Bürgermeister?", "Jeden Morgen öffnet meine Schwester das Küchenfenster."],
    "fr": ["Le boulanger nettoie le parapluie jaune derrière la mairie.", "Qui vend la couverture chaude au marché lorsque le maire dort ?", "Chaque matin ma sœur ouvre la fenêtre de la cuisine."],
    "ru": ["Пекарь чистит жёлтый зонт за ратушей.", "Кто продаёт тёплое одеяло на рынке, пока мэр спит?", "Каждое утро моя сестра открывает окно кухни."],
}
PAIRS = [(t, l) for l, ts in SAMPLES.items() for t in ts * 3]


@pytest.fixture(scope="module")
def model():
    return lg.train([lg.normal(f(t)) for f in (str, lg.without_accents) for t, _ in PAIRS], [l for _ in range(2) for _, l in PAIRS], epochs=12)


def langs(texts, model):
    return [[(n, l) for n, l, _, _ in r] for r in lg.runs_of(texts, model)]


def test_runs(model):
    en, de, fr, ru = (SAMPLES[k] for k in ("en", "de", "fr", "ru"))
    assert langs([en[0] + " " + en[1], de[0].upper(), lg.without_accents(fr[1]), f"{ru[0]}\n{ru[2]} {en[2]} {de[1]} 12345."], model) == [
        [(0, "en")], [(0, "de")], [(0, "fr")], [(0, "ru"), (1, "en"), (2, "de")]]
    assert langs([None, "", "   ", "123 % 45.6: 7", "!?"], model) == [[(0, "und")]] * 5
    (run,) = lg.runs_of([" ".join(en * 300)], model)
    assert len(run) == 1 and run[0][3] == 900 and 0.5 < run[0][2] <= 1


def test_confidence_is_a_probability_and_short_texts_are_doubtful(model):
    p = model.probabilities([lg.normal(SAMPLES["en"][0]), lg.normal("a"), " "])
    assert np.allclose(p.sum(axis=1), 1) and p[0].max() > p[1].max() and 0 < model.temperature


def test_sparse(model):
    strong = lg.train([lg.normal(t) for t, _ in PAIRS], [l for _, l in PAIRS], l1=0.2)
    assert (strong.weights != 0).sum() < (model.weights != 0).sum() < model.weights.size / 2


def test_ngrams_match_counting():
    texts = [" ab a ", "", " ab", "é" * 3]
    row, slot, n = lg.ngrams(texts)
    for i, t in enumerate(texts):
        grams = [t[k : k + m] for m in lg.LENGTHS for k in range(len(t) - m + 1)]
        assert n[row == i].sum() == len(grams) and (row == i).sum() == len(set(grams))


def test_labels(spark):
    cases = [("en", "en"), ("EN", "en"), ("en-GB", "en"), ("de_AT", "de"), ("eng", "en"), ("Ger", "de"), ("French", "fr"), (" es ", "es"), ("pt_BR", "pt"), ("und", "und"), ("unk", None), ("??", None), ("", None), (None, None), ("en x", None)]
    df = spark.createDataFrame(cases, "l string, want string")
    assert not df.where(~lg.label_language(F.col("l")).eqNullSafe(F.col("want"))).collect()


def test_tables(spark, model):
    en, de = SAMPLES["en"], SAMPLES["de"]
    rows = [(1, en[0], "en", 9), (2, en[0], "de", 9), (3, en[0] + " " + de[0], "en", 9), (4, en[1], "English", 9), (5, "12 %", "und", 9), (6, "12 %", "en", 9), (7, None, None, 9), (8, de[1], None, 9), (2, en[0], "de", 9), (None, de[0], "??", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, run_no int")
    got = sorted((r.doc_id or 0, r.run_no, r.lang) for r in lg.wrong_labels(df, model).collect())
    assert got == [(0, 0, "de"), (2, 0, "en"), (3, 0, "en"), (3, 1, "de"), (6, 0, "und"), (7, 0, "und"), (8, 0, "de")]
    runs = lg.language_runs(df, model)
    assert runs.columns == ["doc_id", "lang", "run_no", "run_lang", "confidence", "n_sentences"] and runs.count() == 11
    assert lg.wrong_labels(df.limit(0), model).count() == 0


def test_fit(spark):
    samples = spark.createDataFrame([*PAIRS, (None, "en"), ("x", None)], "text string, lang string")
    fitted = lg.fit(samples)
    assert fitted.languages == ("de", "en", "fr", "ru")
    with pytest.raises(ValueError):
        lg.fit(samples.limit(0))


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    """Trained on half of the clean sentences, right on the other half."""
    rows = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet").orderBy("sample_id").collect()]
    train, test = rows[::2], rows[1::2]
    m = lg.train(*lg._with_accents_lost([t for t, _ in train], [l for _, l in train]))
    p = m.probabilities([lg.normal(t) for t, _ in test])
    right = np.array([m.languages[k] == l for k, (_, l) in zip(p.argmax(axis=1), test)])
    assert right.mean() > 0.97 and abs(p.max(axis=1).mean() - right.mean()) < 0.15


def test_a_language_of_the_samples_needs_no_list(spark):
    """A seventh language, which stands in no list of names, is learnt and told from the others; its label is right."""
    tlh = ["Qapla batlh je tlhInganpu, Qo nuqneH vavoy.", "HIja tlhIngan maH taHjaj wo, batlh Daqawlu taH.", "nuqDaq yuch Dapol, qaStaH nuq jay."]
    samples = spark.createDataFrame([*PAIRS, *[(t, "tlh") for t in tlh * 3]], "text string, lang string")
    docs = spark.createDataFrame([(1, tlh[0] + " " + tlh[2], "tlh"), (2, tlh[1], "en"), (3, SAMPLES["de"][0] + " " + tlh[0] + " " + tlh[1], "TLH-x")], "doc_id long, text string, lang string")
    fitted = lg.fit(samples, docs)
    assert "tlh" in fitted.languages
    assert sorted((r.doc_id, r.run_no, r.lang) for r in lg.wrong_labels(docs, fitted).collect()) == [(2, 0, "tlh"), (3, 0, "de"), (3, 1, "tlh")]


def test_frequencies_cover_all_documents(spark):
    texts = ["ab ab", None, "", "ab", "12", "zz " * 100_000]
    df, n = lg.document_frequencies(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t")
    own = [lg.normal(t) for t in texts if t]
    assert n == 4 and df.sum() == sum(len(set(lg.ngrams([t])[1])) for t in own)
