import random

from sestante.llm.language import LANGS, SEEDS, fit_language, language_labels, language_segments, sentences

SCHEMA = "id string, text string, lang string, label int"
PROSE = {
    "it": "Il portiere apre il cancello ogni mattina prima delle sette. Chi perde la tessera deve chiederne una nuova in ufficio.",
    "en": "The porter opens the gate every morning before seven. Anyone who loses the card has to ask for a new one in the office.",
    "de": "Der Pförtner öffnet das Tor jeden Morgen vor sieben Uhr. Wer die Karte verliert, muss im Büro eine neue beantragen.",
    "fr": "Le gardien ouvre le portail chaque matin avant sept heures. Celui qui perd sa carte doit en demander une autre au bureau.",
    "es": "El portero abre la puerta cada mañana antes de las siete. Quien pierde la tarjeta debe pedir una nueva en la oficina.",
}


def sample():
    rng = random.Random(1)
    rows = []
    for lang, text in SEEDS.items():
        parts = [s for _, _, s, _ in sentences(text)]
        rows += [(" ".join(rng.sample(parts, 4)).capitalize(), lang if rng.random() < 0.9 else rng.choice(LANGS)) for _ in range(30)]
    return rows


def test_held_out_accuracy_and_calibration():
    model = fit_language(sample())
    texts = [(s, lang) for lang, t in PROSE.items() for _, _, s, _ in sentences(t)]
    p = model.scores([s for s, _ in texts])
    assert [LANGS[k] for k in p.argmax(1)] == [lang for _, lang in texts]
    plain = [s.translate(str.maketrans("àèéìòùçñäöüß", "aeeioucnaous")) for s, _ in texts]
    assert [LANGS[k] for k in model.scores(plain).argmax(1)] == [lang for _, lang in texts]
    assert model.scores(["12 34 :: 9"]).max() < model.threshold


def test_segments_and_labels(spark):
    model = fit_language(sample())
    mixed = PROSE["it"] + " " + PROSE["de"]
    rows = [
        ("ok", PROSE["it"], " IT_it ", 1), ("ok", PROSE["it"], " IT_it ", 1), ("wrong", PROSE["fr"], "en", 2), ("none", PROSE["es"], None, 3), ("mixed", mixed, "it", 4), ("codes", "A-12 | 33,40 | K99\nB-7 | 1", "xx", 5),
        ("null", None, "it", 6), ("empty", "", None, 7), ("quote", PROSE["it"] + " Sul cartello c'è scritto «please keep the gate shut at all times» in grande.", "it", 8), ("long", (PROSE["en"] + "\n") * 800, "en", 9), (None, PROSE["en"], "it", 10),
        ("caps", PROSE["de"].upper(), "de-AT", 11),
    ]
    seg = language_segments(spark.createDataFrame(rows, SCHEMA), model=model).cache()
    got = {(r.chunk_id, r.lang) for r in language_labels(seg).where("is_case").collect()}
    assert got == {("wrong", "fr"), ("none", "es"), ("mixed", "it"), ("mixed", "de"), (None, "en")}
    pieces = sorted((r.segment, r.lang, r.start, r.end) for r in seg.where("chunk_id = 'mixed'").collect())
    assert [p[1] for p in pieces] == ["it", "de"] and pieces[0][3] <= pieces[1][2] and mixed[pieces[1][2] :].startswith("Der")
    assert {r.lang for r in seg.where("chunk_id IN ('codes', 'null', 'empty')").collect()} == {"und"}
    assert seg.where("chunk_id = 'ok'").count() == 1
    assert language_segments(spark.createDataFrame([], SCHEMA), model=model).count() == 0
