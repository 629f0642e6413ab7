import copy
import functools
import random

import numpy as np

from sestante.llm.private import find_spans, fit_private, masked, private_data, seed_texts


@functools.lru_cache
def fitted():
    return fit_private()


def test_held_out_sentences():
    field = fitted()
    data = seed_texts(seed=77, draws=2)
    found = find_spans(field, [t for t, _ in data])
    kinds = ("none", "email", "phone", "identity", "address", "name")
    right = wrong = missed = 0
    for (_, spans), got in zip(data, found):
        want, have = {kinds[k] for _, _, k in spans}, {k for _, _, k in got}
        right += len(want & have)
        wrong += len(have - want)
        missed += len(want - have)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93


def test_mask_leaves_the_rest_untouched():
    field = fitted()
    rng = random.Random(4)
    for text, _ in rng.sample(seed_texts(seed=78, draws=1), 60):
        spans = find_spans(field, [text])[0]
        clean = masked(text, spans)
        at = 0
        for lo, hi, kind in spans:
            assert clean.startswith(text[at:lo]) and clean[len(text[at:lo]) :].startswith(f"[{kind.upper()}]")
            clean, at = clean[len(text[at:lo]) + len(kind) + 2 :], hi
        assert clean == text[at:]


def test_rows(spark):
    rows = [("f", 1, "Il mio numero è 3331234567."), ("f", 1, "Il mio numero è 3331234567."), ("f", 2, None), ("f", 3, ""), ("f", 4, "La ricevuta è la n. 3331234567."), ("g", 5, "Scrivete a [EMAIL] o [PHONE]."), ("g", None, "x " * 40_000 + "Codice fiscale RSSMRA80A01H501U.")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "field string, row_id long, text string, kinds string")
    got = private_data(df).collect()
    assert len(got) == len(rows)
    by = {(r.field, r.row_id): r for r in got}
    assert by["f", 1].kinds == ["phone"] and by["f", 1].text == "Il mio numero è [PHONE]."
    assert by["f", 2].text is None and by["f", 3].text == "" and by["f", 4].kinds == [] and by["g", 5].kinds == []
    assert by["g", None].kinds == ["identity"]
    assert private_data(df.where("false")).count() == 0


def test_skip_edges_carry_a_name():
    """Repeated names in plain words are found through the skip edges: without them most are missed."""
    field, bare = fitted(), copy.copy(fitted())
    bare.skip = np.zeros_like(bare.skip)
    between = "Gli ospiti sono attesi, le stanze sono contate. Le visite finiscono presto. " * 3
    names = ("Trumbetto", "Zavorrini", "Quarzella", "Brinomeo", "Kestrup", "Olvandro", "Fenicorsi", "Dulmanni")
    texts = [f"mi chiamo Giulia {n}, camera 12. {between}{again.format(n)}" for n in names for again in ("Domani {} passa a ritirare.", "E per {} basta la firma.")]
    twice = [sum(sum(k == "name" for _, _, k in s) == 2 for s in find_spans(f, texts)) for f in (field, bare)]
    assert twice[0] >= 12 and twice[1] <= 8


def test_short_surnames_and_neighbours():
    field = fitted()
    for text, want in (("Il pacco di Marco Rho è arrivato?", "Marco Rho"), ("Ho chiesto a Anna Lin e non lo sapeva.", "Anna Lin"), ("Sono Ginevra Marolenghi, camera 3.", "Ginevra Marolenghi"), ("Il pacco di MAROLENGHI non è arrivato", "MAROLENGHI")):
        assert [text[lo:hi] for lo, hi, kind in find_spans(field, [text])[0] if kind == "name"] == [want]


def test_a_recurring_sentence_with_a_name_is_not_ordinary(spark):
    said = ["Per le chiavi rivolgersi a Carla Bertoni in portineria.", "Scrivetemi: abito in via dei Tigli 12."]
    rows = [("f", i, said[i % 2]) for i in range(40)]
    got = private_data(spark.createDataFrame(rows, "field string, row_id long, text string"))
    assert {(r.row_id % 2, *r.kinds) for r in got.collect()} == {(0, "name"), (1, "address")}


def test_skip_edges_reach_any_distance_and_other_cases():
    between = "La sala resta aperta fino alle 22:00 e le chiavi si ritirano al piano terra prima di cena, poi il corridoio viene pulito ogni mattina e la porta resta chiusa. "
    for again in ("Marolenghi", "MAROLENGHI", "marolenghi"):
        text = f"Sono Ginevra Marolenghi, camera 3. {between}Il pacco per {again} resta in portineria."
        spans = [text[lo:hi] for lo, hi, kind in find_spans(fitted(), [text])[0] if kind == "name"]
        assert spans == ["Ginevra Marolenghi", again]
