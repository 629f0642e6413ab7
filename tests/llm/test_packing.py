import random

import numpy as np

from sestante.llm import packing as P


def test_sizes_are_those_of_the_tokenizer(spark):
    texts = [(1, "Una frase breve."), (1, "Una frase breve."), (2, None), (3, " \n "), (4, "parola " * 60_000), (None, "x")]
    got = {r.doc_id: r.tokens for r in P.token_sizes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    encoder = P._encoder(f"{P.TOKENIZERS}/{P.VOCABULARY}")
    assert got == {1: len(encoder.encode_ordinary(texts[0][1])), 4: len(encoder.encode_ordinary(texts[4][1]))}


def test_operators_keep_every_item_once():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 200)
    a, b = (P._repaired(np.full(200, -1, np.int32), sizes, 100, np.random.default_rng(s)) for s in (1, 2))
    for child in (P.crossover(a, b, sizes, 100, rng), P.mutation(a, sizes, 100, rng)):
        assert (child.bin >= 0).all() and child.load.max() <= 100 and child.load.sum() == sizes.sum()
        assert (np.bincount(child.bin, sizes, len(child.load)) == child.load).all()


def test_evolution_finds_a_tight_packing():
    rng = random.Random(5)
    sizes = []
    for _ in range(25):  # 25 bins that can be filled to the brim
        cuts = sorted(rng.sample(range(1, 100), 2))
        sizes += [cuts[0], cuts[1] - cuts[0], 100 - cuts[1]]
    rng.shuffle(sizes)
    best, _ = P.evolve(np.array(sizes), 100, 3, generations=60)
    assert len(best.load) <= 26


def test_containers(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(1, 900)) for i in range(600)] + [(1000, 2500), (1001, 3000), (1002, 1000), (1003, 0)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = P.fill_containers(df, 1000, block_items=700).toPandas()
    loads = got.groupby("container").tokens.sum()
    total = sum(t for _, t in rows)
    assert loads.max() <= 1000 and loads.sum() == total
    pieces = np.array(sorted([t for _, t in rows if 0 < t <= 1000] + [1000] * 5 + [500], reverse=True))
    plain = P.best_fit(np.full(len(pieces), -1, np.int32), [], np.arange(len(pieces)), pieces, 1000)[1]
    assert len(loads) <= len(plain)
    assert got.groupby("doc_id").tokens.sum().to_dict() == {i: t for i, t in rows if t}
    assert set(got[got.pieces > 1].doc_id) == {1000, 1001}
    again = P.fill_containers(df.repartition(7), 1000, block_items=700).toPandas()
    key = ["doc_id", "piece"]
    assert got.sort_values(key).container.tolist() == again.sort_values(key).container.tolist()
    blocks = P.fill_containers(df, 1000, block_items=150).toPandas()
    assert blocks.groupby("container").tokens.sum().max() <= 1000 and blocks.tokens.sum() == total
    assert P.fill_containers(df.where("false"), 1000).count() == 0
