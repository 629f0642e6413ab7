import math
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sestante.functions import text as T
from sestante.functions.tiers import caller_rank, visible
from sestante.operators import retrieve
from sestante.operators.retrieve import corpus, fuse, fused_top, keyword_ranking, keyword_search, vector_ranking

CHUNKS = [
    ("a.md#1", "La lavanderia apre alle 7:30 e chiude alle 23:00.", "a.md", "public", "it", None),
    ("a.md#1", "La lavanderia apre alle 7:30 e chiude alle 23:00.", "a.md", "public", "it", None),
    ("a.md#2", "Le lavatrici della lavanderia costano 2,50 euro.", "a.md", "public", "it", "Costi"),
    ("b.md#1", "La cucina del personale e la lavanderia riservata.", "b.md", "staff", "it", None),
    ("b.md#10", "Il personale può entrare.", "b.md", "staff ", "it", None),
    ("c.md#1", None, "c.md", "resident", None, None),
    ("c.md#2", "lavanderia lavanderia lavanderia", "c.md", "resident", "it", None),
    (None, "lavanderia", "c.md", "public", "it", None),
]
SCHEMA = "id string, text string, source string, tier string, lang string, section string"


def plain_tokens(text):
    s = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    out = []
    for w in re.findall(r"\d+(?:[.,:/]\d+)*|\w+", s):
        if w not in T.STOPWORDS:
            out.append(w[:-1] if len(w) > 4 and w[-1] in "aeio" and not w[0].isdigit() else w)
    return out


def test_tokens(spark):
    texts = ["Può entrare alle 23:00? 10.450 euro", "È già così: università!", None, "", "singola singole singoli"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [plain_tokens(t) for t in texts]


@pytest.mark.parametrize("tier", ["public", "resident", "staff"])
def test_keyword_ranking_equals_a_plain_statement(spark, tier):
    rank = {"public": 0, "resident": 1, "staff": 2}
    seen = [c for c in dict.fromkeys(CHUNKS) if c[0] and c[3] in rank and rank[c[3]] <= rank[tier]]
    docs = {c[0]: plain_tokens(c[1]) for c in seen}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for t in set(plain_tokens("Quando apre la lavanderia del personale?")):
        df = sum(t in d for d in docs.values())
        for i, d in docs.items():
            if t in d:
                tf = d.count(t)
                want[i] = want.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
    df = spark.createDataFrame(CHUNKS, SCHEMA)
    asked = spark.createDataFrame([("q", "Quando apre la lavanderia del personale?", tier), ("n", None, tier), ("x", "lavanderia", "guest")], "qid string, question string, tier string")
    for parts in (1, 5):
        got = keyword_ranking(corpus(df.repartition(parts)), asked).collect()
        assert {r.id: r.score for r in got} == {i: round(s, 6) for i, s in want.items()}
        assert sorted(r.position for r in got) == list(range(1, len(want) + 1)) and {r.qid for r in got} == {"q"}


def test_tiers(spark):
    with pytest.raises(ValueError):
        caller_rank("Staff")
    df = spark.createDataFrame([("public",), ("staff",), ("PUBLIC",), (None,)], "tier string")
    assert [r.tier for r in df.where(visible(F.col("tier"), "resident")).collect()] == ["public"]
    assert corpus(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_fuse(first, second, k=2, weight=0.5, evidence=5):
    top = [i for i, _ in first[:evidence]]
    kept = [i for i, s in second if s > 0 and i in top]
    score = defaultdict(float)
    for n, (i, _) in enumerate(first, 1):
        score[i] += 1 / (k + n)
    for n, i in enumerate(kept, 1):
        score[i] += weight / (k + n)
    place = {i: n for n, (i, _) in enumerate(first)}
    order = sorted(score, key=lambda i: (-round(score[i], 12), place[i]))
    best = next((i for i, s in second if s > 0), None)
    if best in order and order.index(best) >= evidence and len(order) > evidence:
        order.remove(best)
        order.insert(evidence - 1, best)
    return order


def test_fusion_with_rescue(spark):
    import random

    rng = random.Random(2)
    a, b, want = [], [], {}
    for q in range(12):
        ids = list(range(rng.randrange(2, 15)))
        rng.shuffle(ids)
        first = [(i, 1 - n / 20) for n, i in enumerate(ids)]
        rng.shuffle(ids)
        second = [(i, float(max(0, 5 - n))) for n, i in enumerate(ids)]
        a += [(q, i, s, n) for n, (i, s) in enumerate(first, 1)]
        b += [(q, i, s, n) for n, (i, s) in enumerate(second, 1)]
        want[q] = plain_fuse(first, second)
    schema = "qid long, id long, score double, position int"
    got = defaultdict(dict)
    for r in fuse(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect():
        got[r.qid][r.position] = r.id
    assert {q: [p[n] for n in sorted(p)] for q, p in got.items()} == want


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vector_ranking(df, df.where("vec_id % 20 = 0"), 4).orderBy("qid", "position").collect():
        got[r.qid].append(r.vec_id)
    for q in range(0, 120, 20):
        assert got[q] == sorted(range(120), key=lambda i: (-round(float(x[q] @ x[i]), 6), i))[:4]


def test_rescue_from_any_depth(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(150, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = {q: sorted(range(150), key=lambda i: (-round(float(x[q] @ x[i]), 6), i)) for q in (0, 50, 100)}
    second = {q: [(near[q][at], 3.0), (near[q][2], 2.0), (near[q][130], 1.0)] for q, at in ((0, 120), (50, 5), (100, 3))}
    second[100].insert(0, (999, 4.0))  # without a vector: not in the ranking
    hits = [(q, i, s, n) for q, kept in second.items() for n, (i, s) in enumerate(kept, 1)]
    got = fused_top(df, df.where("vec_id % 50 = 0"), spark.createDataFrame(hits, "qid long, id long, score double, position int")).collect()
    for q in near:
        assert [r.id for r in sorted(got, key=lambda r: r.position) if r.qid == q] == plain_fuse([(i, 0.0) for i in near[q]], second[q])[:5]


@pytest.mark.parametrize("blocks", [(32_768, 64), (3, 2)])
def test_keyword_search_by_blocks(spark, monkeypatch, blocks):
    """The first rows of the whole ranking, ties and rows without a common term in corpus order; no pair is shuffled."""
    monkeypatch.setattr(retrieve, "POSTING_BLOCK", blocks[0])
    monkeypatch.setattr(retrieve, "GROUP", blocks[1])
    monkeypatch.setattr(retrieve, "FORM_BLOCK", 2)
    words = ["luce", "porta", "sala", "cane", "vento"]
    more = [(f"{'xyz'[i % 3]}.md#{i}", " ".join(words[j] for j in range(5) if (i * 7 + j * 3) % 4 < 2), f"{'xyz'[i % 3]}.md" if i % 11 else None, ["public", "resident", "staff"][i % 3], "it", None) for i in range(60)]
    rows = corpus(spark.createDataFrame(CHUNKS + more, SCHEMA).repartition(3))
    texts = ["luce e porta?", "Porta luce!", "cane vento sala", "lavanderia", "niente", None, "lavatrici porta porta"]
    asked = spark.createDataFrame([(f"{t}{i}", q, t) for t in ("public", "resident", "staff", "guest") for i, q in enumerate(texts)], "qid string, question string, tier string")
    whole, seen = {}, {t: [c for c in rows.collect() if (r := {"public": 0, "resident": 1, "staff": 2}.get(c.tier)) is not None and r <= n] for n, t in enumerate(("public", "resident", "staff"))}
    for r in keyword_ranking(rows, asked).orderBy("qid", "position").collect():
        whole.setdefault(r.qid, []).append((r.id, r.score))
    place = lambda c: (c.source is not None, c.source or "", c.n, c.id)
    for k in (1, 4, 40):
        got = {}
        for r in keyword_search(rows, asked, k).orderBy("qid", "position").collect():
            got.setdefault(r.qid, []).append((r.id, r.score))
            assert r.position == len(got[r.qid])
        for q in asked.collect():
            hits = whole.get(q.qid, [])
            rest = [(c.id, 0.0) for c in sorted(seen.get(q.tier, []), key=place) if c.id not in dict(hits)]
            want = (hits + rest)[:k]
            assert [i for i, _ in got.get(q.qid, [])] == [i for i, _ in want]
            assert [s for _, s in got.get(q.qid, [])] == pytest.approx([s for _, s in want], abs=2e-6)


def test_message_replies_plan(spark):
    """Search and answers stand in the plan once: before, it had 182 exchanges and outgrew the driver."""
    import __spark_entry__ as E

    plan = E.queries()["message_replies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60


def test_redteam_rows_plan(spark):
    """The answers are read several times, but made once, before the plan that is returned."""
    import __spark_entry__ as E

    plan = E.queries()["redteam_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 60
