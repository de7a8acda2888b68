"""Quality, language and toxicity models: defined cases and held-out behaviour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata3d.llm import language, quality, textvec, toxicity

WORDS = {"en": "the of and house water morning light", "de": "der und haus wasser morgen licht nicht",
         "fr": "le de et maison eau matin lumière", "es": "el y casa agua mañana luz niño"}


def prose(words, i, n=40):
    w = words.split()
    return " ".join(w[(i * 7 + k * k) % len(w)] for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 4]
        text = prose(WORDS[lang], i)
        if i % 3 == 0:
            text = " | ".join(text.split())                       # the low quality of these rows
        if i % 5 == 0:
            text += " zorgle" * (1 + i % 4)                       # the toxic word of these rows
        rows.append((i, text, lang, "x", 1.0))
    rows += [(900, None, "en", "x", 1.0), (901, "", "en", "x", 1.0), (902, "12 34 !!", None, "x", 1.0),
             (None, prose(WORDS["de"], 1), None, "x", 1.0), (1, rows[1][1], "de", "x", 1.0),
             (903, prose(WORDS["fr"], 2, 60_000), None, "x", 1.0), (904, "\U0001f642 \U0001f642", None, "x", 1.0)]
    # `score` and `label` are names the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, label string, "
                                       "score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 3 != 0), int(i % 5 == 0), "extra") for i in range(240)] + [(None, 1, 0, ""), (5, None, None, "")],
        "doc_id long, quality int, toxic int, text string")


def test_tokens_do_not_depend_on_the_batch():
    alone = textvec.tokens(["ab, 12 cd"])[0]
    among = textvec.tokens(["x", "ab, 12 cd", None, ""])
    assert (among[0][among[1] == 1] == alone).all() and len(alone) == 4


def test_quality_learns_and_covers_edge_cases(docs, labels):
    sample = quality.sampled(labels, "quality", 150, F.col("doc_id") % 4 != 2)
    assert sample.count() == 150
    model = quality.fit(docs, sample)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(240) if i % 4 == 2]
    assert np.mean([(by[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert by[900] == by[901] == pytest.approx(1 / (1 + np.exp(-model.bias)))
    assert all(0 <= s <= 1 for s in by.values())


def test_quality_without_labels_scores_half(docs, labels):
    model = quality.fit(docs, quality.sampled(labels.limit(0), "quality", 10, F.lit(True)))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}


def test_language_learns_and_covers_edge_cases(docs):
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    got = language.identify(docs, model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == docs.count()
    held = [i for i in range(0, 240, 5)]
    assert all(by[i][0] == list(WORDS)[i % 4] for i in held)
    assert by[900] == by[901] == by[902] == by[904] == ("und", 0.0)
    assert by[None][0] == "de" and by[903][0] == "fr"


def test_language_without_rows_and_with_one(docs):
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'fr'"), F.lit(True))
    assert language.identify_texts(one, ["abc", None])[0] == ["fr", "und"]
    assert language.identify(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 7, 9, 20])
def test_codewords_lie_apart(k):
    w = language.codewords(k)
    gaps = [(w[i] != w[j]).sum() for i in range(k) for j in range(i)]
    assert min(gaps) >= max(1, w.shape[1] // 2 if k > 7 else 2 ** (k - 2))


def test_an_error_in_one_bit_is_corrected():
    model = language.Model(list("abcd"), language.codewords(4), np.zeros((1, 7)), np.zeros(7), np.full(7, 1 / 7))
    margin = model.words[2].copy()
    margin[3] *= -1
    assert language.decode(model, margin[None])[0][0] == 2


def test_ambiguity_is_flagged():
    model = language.Model(list("ab"), language.codewords(2), np.zeros((1, 1)), np.zeros(1), np.ones(1))
    assert language.decode(model, np.array([[0.01], [1.0]]))[2].tolist() == [True, False]


def test_toxicity_orders_grades(docs, labels):
    model = toxicity.train(docs, labels, "toxic", F.col("doc_id") % 4 != 2)
    assert (np.diff(model.threshold) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    held = [i for i in range(240) if i % 4 == 2]
    assert all((got[i]["p_toxic"] >= 0.5) == (i % 5 == 0) for i in held)
    base = got[900]["severity"]
    assert base == got[901]["severity"] and 0 <= base < 0.5


def test_toxicity_shares_weights_over_grades(spark):
    texts = ["calm day"] * 60 + ["calm zorgle"] * 40 + ["calm zorgle zorgle blat zorgle"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    grade = spark.createDataFrame([(i, 0 if i < 60 else 1 if i < 100 else 2) for i in range(140)], "doc_id long, label int")
    model = toxicity.fit_sample(toxicity.sample(docs, grade))
    s, _ = toxicity.severity_texts(model, [texts[0], texts[70], texts[-1], None])
    assert s[0] < s[1] < s[2]


def test_toxicity_with_one_grade_is_zero(docs, labels):
    model = toxicity.train(docs, labels.where("toxic = 0"), "toxic", F.lit(True))
    assert {r["severity"] for r in toxicity.severity(docs, model).collect()} == {0.0}
