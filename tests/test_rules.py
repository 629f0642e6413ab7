from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sestante.functions import text as T
from sestante.operators import conversation, evaluate, guardrails, ingest, scanner
from sestante.sources import files


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,flag", [("I documenti non specificano il costo.", True), ("Non sono disponibili camere triple.", False), ("The sources do not mention it.", True), ("Ecco i dettagli. Non vale.", False), (None, False)])
def test_gap(spark, text, flag):
    assert one(spark, guardrails.admits_gap, text) is flag


def test_citations_and_footer(spark):
    t = "Sì. [a.md#1] Poi [a.md#1] e [b.md#2].\n\n__Affidabilità 80 % · staff__"
    assert one(spark, T.cited_ids, t) == ["a.md#1", "b.md#2"]
    assert one(spark, T.footer, t) == "__Affidabilità 80 % · staff__" and one(spark, T.body, t).endswith("[b.md#2].")
    assert one(spark, T.without_citations, "Uno [x#1] , due [y#2].") == "Uno, due."
    assert one(spark, T.footer, None) == ""
    assert one(spark, guardrails.confidence, ["a#1", "a#2", None], "array<string>") == 0.6
    assert one(spark, guardrails.confidence, None, "array<string>") == 0.0


def test_truncate_and_shorten(spark):
    s = "Prima frase. " * 30
    cut = one(spark, lambda c: T.truncate(c, 100), s)
    assert cut.endswith(". …") and len(cut) <= 102
    assert one(spark, lambda c: T.truncate(c, 100), "x" * 150) == "x" * 100 + " …"
    assert one(spark, lambda c: T.shorten(c, 5), "a  b\n c d e") == "a b …"
    assert one(spark, T.slug, "  ") == "unnamed" and one(spark, T.slug, "Anna B.") == "Anna-B"


def test_shared_shingles(spark):
    docs = spark.createDataFrame([(1, "uno due tre quattro cinque sei sette"), (2, None), (3, "uno due tre")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "DUE tre quattro cinque sei sette otto")], "item_id long, text string")
    assert [tuple(r) for r in guardrails.shared_shingles(docs, items).collect()] == [(1, 7, 1)]


def test_scanner(spark):
    mail, code = "mario" + "@" + "posta.it", "RSSMRA" + "80A01H501U"
    lines = [("p", 1, f"scrivi a {mail}"), ("p", 2, f"{code} # data-scan: allow"), ("p", 3, "nome.cognome@example.com"), ("p", 4, None), ("p", 5, code), ("p", 6, "via Roma 12"), ("p", 7, "")]
    got = scanner.findings(spark.createDataFrame(lines, "path string, line_no int, line string")).collect()
    assert {(r.line_no, r.kind) for r in got} == {(1, "email address"), (5, "codice fiscale"), (6, "Italian address")}
    assert all(mail not in r.excerpt and code not in r.excerpt for r in got)
    paths = spark.createDataFrame([("data/x.txt",), ("data/README.md",), ("src/a.py",), ("b/c.CSV",), ("m/x.eml",), ("k/a.pem",), ("x/.csv",)], "p string").select(scanner.path_fault(F.col("p")).alias("f")).collect()
    assert [r.f for r in paths] == ["forbidden location", None, None, "forbidden file type", "forbidden file type", None, None]
    tree = [("a.py", f"# {mail}\nx".encode()), (".git/a.py", f"# {mail}".encode()), ("b.bin", f"# {mail}".encode()), ("c.txt", b"\xff\xfe"), ("d.txt", None), ("e.zip", b"")]
    got = scanner.scan(spark.createDataFrame(tree, "path string, content binary")).collect()
    assert {(r.path, r.line_no, r.kind) for r in got} == {("a.py", 1, "email address"), ("e.zip", 0, "forbidden file type")}


def test_manifest(spark):
    rows = [("a.md", "public", "it"), ("b.md", "Public", "it"), ("c.md", "staff", "IT"), (None, "staff", "it"), ("d.md", "staff", "en"), ("d.md", "staff", "en")]
    df = spark.createDataFrame(rows, "filename string, tier string, lang string")
    assert sorted((r.filename or "", r.problem) for r in ingest.manifest_problems(df).collect()) == [("", "no filename"), ("b.md", "unknown tier"), ("c.md", "bad language"), ("d.md", "listed twice"), ("d.md", "listed twice")]
    assert {r.filename for r in ingest.valid_entries(df).collect()} == {"a.md", "d.md"}


def test_page_cleaning(spark):
    pages = [(n, f"CASA\nriga {n} prima parte\ntesto {n} centrale\nseconda {n} parte\nfondo {n}\n{n}") for n in range(1, 5)]
    rows = ingest.lines(spark.createDataFrame(pages, "doc_id long, text string"))
    own = spark.createDataFrame([(n, "s") for n in range(1, 5)], "doc_id long, source string")
    found = ingest.furniture(rows, own)
    assert [r.line for r in found.collect()] == ["CASA"]
    left = ingest.without_furniture(rows, own, found)
    assert left.where("line = 'CASA'").count() == 0 and left.count() == rows.count() - 4
    assert ingest.page_numbers(rows, F.col("doc_id")).count() == 4
    labels = spark.createDataFrame([(1, "BAR\nSALA\nORTO"), (2, "Singola 450 euro\nA\nB"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in ingest.label_pages(ingest.lines(labels)).collect()] == [1]


def test_fingerprint_ignores_order_and_tier(spark):
    rows = [("a#1", "x", "public"), ("a#2", None, "staff"), ("b#1", "y", None)]
    df = spark.createDataFrame(rows, "id string, text string, tier string")
    a = ingest.fingerprint(df).first().fingerprint
    assert a == ingest.fingerprint(df.repartition(3).withColumn("tier", F.lit("x"))).first().fingerprint
    assert a != ingest.fingerprint(df.where("id <> 'a#2'")).first().fingerprint


NOW = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)


def turns(spark):
    rows = [(1, "u", NOW, "ciao", "a"), (2, "u", NOW + timedelta(minutes=10), "/reset", None), (3, "u", NOW + timedelta(minutes=11), "poi", "b"), (4, "v", NOW, None, None), (5, None, NOW, "x", "y"), (6, "u", None, "x", "y")]
    return spark.createDataFrame(rows, "turn_id long, user_id string, ts timestamp, question string, answer string")


def test_context_and_sessions(spark):
    df = turns(spark)
    assert {r.turn_id: r.recent for r in conversation.recent_counts(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r.turn_id: [x.question for x in r.recent] for r in conversation.recent_context(df).collect()} == {1: [], 2: ["ciao"], 3: [], 4: []}
    assert {(r.user_id, r.session, r.turns) for r in conversation.sessions(df).collect()} == {("u", 0, 2), ("u", 1, 1), ("v", 0, 1)}
    assert [one(spark, conversation.route, q) for q in ("/START@casa_bot", "help", " ", "Quanto costa?", None)] == ["start", "help", "blank", "question", "blank"]
    r = spark.createDataFrame([("q", "nuova"), ("q", ""), ("q", "a\nb"), ("q", "x" * 501), ("q", None)], "a string, b string").select(conversation.accepted_rewrite(F.col("a"), F.col("b")).alias("x")).collect()
    assert [x.x for x in r] == ["nuova", "q", "q", "q", "q"]


def test_stream_equals_batch(spark, tmp_path):
    from sestante.streaming.chat import rule_counts, tracked, windowed_counts

    df = turns(spark)
    for n in range(3):  # three micro-batches, state kept between them
        df.where(f"turn_id % 3 = {(n + 1) % 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracked(stream()).writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.turn_id: r.session for r in spark.table("tracked").collect()}.keys() == {1, 2, 3, 4}
    q = rule_counts(stream().selectExpr("coalesce(question, 'none') AS rule")).writeStream.format("memory").queryName("rules").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.rule, r["count"]) for r in spark.table("rules").collect()} == {("ciao", 1), ("/reset", 1), ("poi", 1), ("none", 1), ("x", 2)}
    assert windowed_counts(stream()).isStreaming


def test_evaluation(spark):
    rows = [("answer", False, True, True, True, 0), ("answer", True, False, False, True, 0), ("refusal", True, True, False, False, 1)]
    df = spark.createDataFrame(rows, "expect string, refused boolean, correct boolean, hit boolean, has_sources boolean, leaked int")
    r = evaluate.scorecard(df).first()
    assert (r.n_questions, r.retrieval_hit_rate, r.answer_correctness, r.refusal_precision, r.refusal_recall, r.tier_leaks) == (3, 0.5, 0.5, 0.5, 1.0, 1)
    assert evaluate.scorecard(df.where("false")).first().refusal_recall == 0.0
    red = spark.createDataFrame([(None, [], [], False, {"a": 0}), (None, [], [], False, {"a": 1}), ("e", [], [], True, {}), (None, ["x"], [], True, {})], "error string, leaked array<string>, repeated array<string>, refused boolean, guardrails_fired map<string,int>")
    assert [x.review for x in evaluate.redteam_review(red).collect()] == [True, False, True, True]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("README.md", b"x"), ("sub/README.md", b"\xef\xbb\xbfciao"), ("a.txt", b"\xff\xfe\xff"), (".h.md", b"x"), ("b.PDF", b"no pdf")):
        (tmp_path / name).write_bytes(content)
    found = files.scan(spark, str(tmp_path))
    assert {r.relative for r in found.collect()} == {"sub/README.md", "a.txt", "b.PDF"}
    got = {r.source: r for r in files.pages(found).collect()}
    assert got["README.md"].text == "ciao" and got["a.txt"].problem.startswith("UnicodeDecodeError") and got["b.PDF"].problem
    chunks = spark.createDataFrame([("a#1", "tè", "a", "public", "it", None)], files.CHUNK_SCHEMA)
    files.write_chunks(chunks, str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out")).collect() == chunks.collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"id": "a#1"}\n')
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "bad")).collect()
