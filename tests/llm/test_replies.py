import numpy as np
import pytest

from sestante.llm import abuse as B
from sestante.llm import defects as D
from sestante.llm.language import fit_language
from tests.llm.test_language import PROSE, sample

QUESTIONS = {
    "it": "Quando apre il cancello della casa?", "en": "When does the gate of the house open?", "de": "Wann öffnet das Tor des Hauses?", "fr": "Quand ouvre le portail de la maison ?", "es": "¿Cuándo abre la puerta de la casa?",
}


@pytest.fixture(scope="module")
def fitted():
    model = fit_language(sample(), certain=[(q, k) for k, q in QUESTIONS.items()])
    endings = np.full(1 << D.ENDING_BITS, -1.0, np.float32)
    rows = [(QUESTIONS[k], PROSE[k], n % 20 == 0) for k in QUESTIONS for n in range(60)]
    rows += [(QUESTIONS["it"], "Su tale faccenda le mie note restano mute.", n % 3 > 0) for n in range(20)]
    return D.fit_clauses(rows, model, endings), model, endings


def judge(fitted, question, text):
    field, model, endings = fitted
    parts, f = D.describe(question, text, True, endings)
    D.language_features(model, [question], [parts], [f])
    return field.judged([parts], [f])[0][0]


def test_defects(fitted):
    q, a = QUESTIONS["it"], PROSE["it"]
    assert judge(fitted, q, a) is None
    assert judge(fitted, q, a + " [x.md#1]\n\n__Affidabilità 80 % · staff__") is None
    assert judge(fitted, q, PROSE["de"]) == "wrong_language"
    assert judge(fitted, q, a[:-20]) == "truncated"
    assert judge(fitted, q, "Ha chiesto: " + q) == "copy"
    assert judge(fitted, q, "Non sono in grado di aiutarla con ciò.") == "refusal"
    # A wording known only from flagged rows, though a third of its flags are missing.
    assert judge(fitted, q, "Su tale faccenda le mie note restano mute. [x.md#1]") == "refusal"
    for filler in (None, "", " \n", "​", "N/D", "-", "…", "<br>", "[x.md#1]", "\n\n__Affidabilità 80 % · staff__"):
        assert judge(fitted, q, filler) == "empty"


def test_reply_rows(spark):
    turns = [(n, q) for n, q in enumerate(QUESTIONS.values())] * 2 + [(50, None)]
    langs = list(QUESTIONS)
    rows = [(i, i % 5, PROSE[langs[i % 5]] + f" {i}.", ["a#1"], False) for i in range(60)] + [(99, 0, "", None, None), (99, 0, "", None, None), (98, 77, None, [], True), (97, 50, PROSE["it"], ["a#1"], None), (96, 1, "word " * 30_000 + ".", [], False)]
    a = spark.createDataFrame([(*r, "x") for r in rows], "answer_id long, turn_id long, text string, citations array<string>, refused boolean, question string")
    t = spark.createDataFrame(turns, "turn_id long, question string")
    got = {r.answer_id: r.defect for r in D.reply_defects(a, t, sample()).collect()}
    assert len(got) == 64 and got[99] == got[98] == "empty" and got[97] is None
    assert D.reply_defects(a.where("false"), t, sample()).count() == 0


def test_abuse_seeds_held_out():
    import random

    model = B.fit_abuse()
    fresh = B.seed_sentences(random.Random(991), draws=3)
    p = model([" ".join(w) for w, _, _ in fresh])
    y = np.array([y for _, y, _ in fresh])
    assert ((p > 0.5) == y).mean() > 0.97


def test_obfuscations_and_groups():
    model = B.fit_abuse()
    bad = ["Certo che sei idiota", "certo che sei 1d1ot4", "CERTO CHE SEI I D I O T A!", "certo che sei id​iota", "certo che sei idiotaaaa"]
    assert (model(bad) > 0.5).all()
    fine = ["Gli stranieri del terzo piano organizzano una cena.", "Le donne del terzo piano organizzano una cena.", None, "", "12:30"]
    s = model(fine)
    assert (s < 0.5).all() and abs(s[0] - s[1]) < 0.2


def test_abuse_rows(spark):
    rows = [(1, "s", "If I catch you alone I will break your teeth."), (1, "s", "If I catch you alone I will break your teeth."), (2, "s", None), (3, None, ""), (None, "t", "The office opens at nine. " * 20_000), (4, "t", "Good morning to all. " * 9000 + "Shut up you idiot, nobody wants you here!")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, text string, score double")
    scores = B.abuse_scores(df).cache()
    assert {(r.doc_id, r.abusive) for r in scores.collect()} == {(1, True), (2, False), (3, False), (None, False), (4, True)}
    rates = {r.source: (r.documents, r.abusive_documents) for r in B.abuse_rates(scores).collect()}
    assert rates == {"s": (3, 2), None: (1, 0), "t": (2, 1)}
    assert B.abuse_scores(df.where("false")).count() == 0


def test_labels_teach_new_wordings():
    """A wording that no seed has is learnt from labelled texts, of which most is harmless; a wrong label teaches nothing."""
    prose = ["Gli ospiti firmano il registro all'ingresso. La sala grande chiude alle dieci di sera.", "Il bagno del piano si pulisce ogni lunedì. Le chiavi restano in portineria fino a domenica."]
    harmless = tuple(f"{prose[n % 2]} Nota numero {n}." for n in range(60))
    abusive = tuple(f"{prose[n % 2]} Sparati zimbello quaquaraquà. Nota numero {n}." for n in range(12)) + (prose[0] + " Nota numero 99.",)
    model = B.fit_abuse(harmless, abusive)
    told = B.telling_sentences(list(abusive), list(harmless), model)
    assert {" ".join(s) for s in told} == {"sparati zimbello quaquaraqua"} and len(told) == 12
    assert model(["Sparati zimbello quaquaraquà"])[0] > 0.95 and model(list(harmless)).max() < 0.5


def test_long_sentences_are_trained_whole():
    rows = [([f"w{i}" for i in range(30)] + ["zut"], 1, None), ([f"w{i}" for i in range(30)] + ["ok"], 0, None)] * 20
    model = B._fit(rows, __import__("random").Random(1))
    assert model(["zut"])[0] > model(["ok"])[0] + 0.05
