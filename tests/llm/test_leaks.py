import random

from sestante.llm.leaks import names_of, passage_words, template_leaks, verbatim_leaks

ITEM = "Nel 1402 il rettore Dorelvo fece murare 4699 porte fra Molanto e Sabiro, poi la torre Vernica rimase vuota per 12 mesi."
DOCS = "doc_id long, text string, doc int, template string"
ITEMS = "item_id long, text string"


def brute(docs, items, n=12):
    out = set()
    for i, t in docs:
        w = passage_words(t)
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for j, u in items:
            v = passage_words(u)
            if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                out.add((i, j))
    return out


def test_words():
    assert passage_words("> **Vere-\n> nica**, È l'«ora» <br> ﬁne") == ["verenica", "e", "l", "ora", "fine"]
    assert passage_words(None) == [] and "dorelvo" in names_of([ITEM])


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"parola{i}" for i in range(30)] + [str(i) for i in range(10)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(15)]
    docs = []
    for d in range(120):
        w = [rng.choice(words) for _ in range(60)]
        v = rng.choice(items)[1].split()
        at, n = rng.randrange(18), rng.randrange(6, 20)
        w[20:20] = v[at : at + n]
        docs.append((d, " ".join(w).upper() if d % 3 else " ,\n".join(w)))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS)
    got = verbatim_leaks(df, spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_cases(spark):
    other = ITEM.replace("1402", "1699").replace("Dorelvo", "Sabiro").replace("4699", "88").replace("Vernica", "Molanto")
    docs = [(1, "Prima. " + ITEM + " Dopo."), (1, "Prima. " + ITEM + " Dopo."), (2, ITEM.upper().replace(" ", "  \n")), (3, other), (4, None), (5, ""), (6, "Nel 1402 il rettore"), (7, "testo " * 50_000 + ITEM), (None, ITEM)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    items = spark.createDataFrame([(9, ITEM), (9, ITEM), (10, None), (11, "corto")], ITEMS)
    assert {(r.doc_id, r.item_id) for r in verbatim_leaks(df, items).collect()} == {(1, 9), (2, 9), (7, 9), (None, 9)}
    changed = {(r.doc_id, r.item_id) for r in template_leaks(df, items.where("text IS NOT NULL")).collect()}
    assert (3, 9) in changed and (6, 9) not in changed
    assert verbatim_leaks(df.where("false"), items).count() == 0 and verbatim_leaks(df, items.where("false")).count() == 0


def test_new_names_and_separated_figures(spark):
    item = "Dopo la piena del 1402 rimasero 4699 tegole a Molanto e 388 travi a Sabiro, ma la torre rimase vuota."
    new = item.replace("4699", "8.531").replace("388", "8 729").replace("Molanto", "Lamtapoli").replace("Sabiro", "Torre")
    docs = [(1, new), (2, new.replace("la torre", "La Torre")), (3, item.replace("Molanto", "casa")), (4, item)]
    found = template_leaks(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS), spark.createDataFrame([(9, item)], ITEMS))
    assert {(r.doc_id, r.changed_slots) for r in found.collect() if r.doc_id != 3} == {(1, 4), (2, 4)}


def test_slots_must_be_consistent_and_most_words_match(spark):
    item = "Dal 12 maggio il signor Dorelvo paga 40 euro al giorno e il signor Dorelvo lascia la stanza 40 entro 9 ore."
    one = item.replace("Dorelvo", "Vernik").replace("40", "75")
    torn = item.replace("Dorelvo", "Vernik", 1).replace("40", "75")
    part = " ".join(one.split()[:13]) + " e poi si parla di altro senza che nessuno lo riporti a quanto detto prima di qui."
    docs = [(1, one), (2, torn), (3, part), (4, " ".join(["7 euro"] * 300))]
    hot = " ".join(["5 euro"] * 8)
    found = template_leaks(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS), spark.createDataFrame([(9, item), (8, hot)], ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 9), (4, 8)}
