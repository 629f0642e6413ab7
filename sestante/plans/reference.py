"""Queries of the document-search engine itself, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.prompt import PROMPT
from ..functions.tiers import TIERS, default_tier, tier_rank, tier_table, visible
from ..operators import answering, conversation, evaluate, guardrails, indexing, ingest, scanner
from ..operators.answering import prompt_shingles
from ..operators.retrieve import corpus, fused_top, keyword_ranking, keyword_scores, search, vector_ranking
from ..session import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


RANK = "CASE {0} WHEN 'public' THEN 0 WHEN 'resident' THEN 1 WHEN 'staff' THEN 2 END"
CHUNKS = f"ch AS (SELECT DISTINCT ON (id) id, text, source, tier, section, coalesce(try_cast(regexp_extract(id, '#([0-9]+)$', 1) AS INT), 0) AS n, {RANK.format('tier')} AS rank FROM chunks WHERE id IS NOT NULL)"
PLAIN = f"translate(regexp_replace(lower(coalesce({{0}}, '')), '\\p{{{{M}}}}', '', 'g'), '{T.ACCENTED}', '{T.PLAIN}')"
TOKENS = f"list_transform(list_filter(regexp_extract_all({PLAIN}, '\\d+(?:[.,:/]\\d+)*|[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: w NOT IN ({_in(T.STOPWORDS)})), lambda w: CASE WHEN length(w) > 4 AND regexp_matches(w, '[aeio]$') AND NOT regexp_matches(w, '^[0-9]') THEN w[:length(w)-1] ELSE w END)"
CITED = "list_distinct(regexp_extract_all(coalesce({0}, ''), '\\[([^\\[\\]]+#[^\\[\\]]+)\\]', 1))"


def _tok(column: str) -> str:
    return TOKENS.format(column)


# -- tiers and manifest ------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS}, t(caller, r) AS (VALUES ('public', 0), ('resident', 1), ('staff', 2)) SELECT caller, count(id) AS visible_chunks FROM t LEFT JOIN ch ON rank <= r GROUP BY caller")
def tier_visible_counts(spark: SparkSession, d: str) -> DataFrame:
    """Visible chunks of each caller: one count per tier, then a running sum over the ranks."""
    per = corpus(table(spark, d, "chunks")).groupBy(tier_rank(F.col("tier")).alias("rank")).agg(F.count("*").alias("n")).where("rank IS NOT NULL")
    w = Window.orderBy("rank")  # three rows
    return tier_table(spark).join(per, "rank", "left").select(F.col("tier").alias("caller"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("visible_chunks"))


@query(f"WITH {CHUNKS}, t(tier) AS (VALUES ('public'), ('resident'), ('staff')) SELECT t.tier, count(id) AS chunks FROM t LEFT JOIN ch ON ch.tier = t.tier GROUP BY t.tier")
def chunks_per_tier(spark: SparkSession, d: str) -> DataFrame:
    per = corpus(table(spark, d, "chunks")).groupBy("tier").agg(F.count("*").alias("n"))
    return tier_table(spark).join(per, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("chunks"))


GOOD = "tier IN ('public', 'resident', 'staff') AND regexp_full_match(lang, '[a-z]{2}') AND filename IS NOT NULL"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.valid_entries(table(spark, d, "manifest"))


@query(f"WITH {CHUNKS}, m AS (SELECT DISTINCT filename, tier, lang FROM manifest WHERE {GOOD}) SELECT m.filename, m.tier, m.lang, count(*) AS chunks FROM ch JOIN m ON ch.source = m.filename GROUP BY ALL")
def manifest_inner(spark: SparkSession, d: str) -> DataFrame:
    per = corpus(table(spark, d, "chunks")).groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("chunks"))
    return _listed(spark, d).join(per, "filename").select("filename", "tier", "lang", "chunks")


@query(f"WITH {CHUNKS} SELECT source, count(*) AS chunks FROM ch WHERE source IS NOT NULL AND source NOT IN (SELECT filename FROM manifest WHERE filename IS NOT NULL) GROUP BY source")
def docs_unlisted_anti(spark: SparkSession, d: str) -> DataFrame:
    per = corpus(table(spark, d, "chunks")).where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("chunks"))
    return per.join(table(spark, d, "manifest").select(F.col("filename").alias("source")).distinct(), "source", "left_anti")


@query("SELECT DISTINCT filename FROM manifest WHERE filename IS NOT NULL AND filename NOT IN (SELECT source FROM chunks WHERE source IS NOT NULL)")
def manifest_missing_anti(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "chunks").select(F.col("source").alias("filename")).distinct()
    return table(spark, d, "manifest").where("filename IS NOT NULL").select("filename").distinct().join(seen, "filename", "left_anti")


@query(
    "SELECT filename, tier, lang, CASE WHEN filename IS NULL OR trim(filename) = '' THEN 'no filename' WHEN tier IS NULL OR tier NOT IN ('public', 'resident', 'staff') THEN 'unknown tier' "
    "WHEN lang IS NULL OR NOT regexp_full_match(lang, '[a-z]{2}') THEN 'bad language' WHEN n > 1 THEN 'listed twice' END AS problem "
    "FROM (SELECT filename, tier, lang, count(*) OVER (PARTITION BY filename) AS n FROM manifest) WHERE problem IS NOT NULL"
)
def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest_problems(table(spark, d, "manifest"))


@query("SELECT filename, count(*) AS listed FROM manifest WHERE filename IN (SELECT source FROM chunks) GROUP BY filename HAVING count(*) > 1")
def duplicate_source_guard(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "chunks").select(F.col("source").alias("filename")).distinct()
    return table(spark, d, "manifest").join(seen, "filename", "left_semi").groupBy("filename").agg(F.count("*").alias("listed")).where("listed > 1")


# -- users, turns and sessions -----------------------------------------------------------------------------------


USERS = "u AS (SELECT user_id, max(CASE WHEN tier IN ('public', 'resident', 'staff') THEN tier END) AS tier, max(display_name) AS display_name FROM members WHERE user_id IS NOT NULL GROUP BY user_id)"
TURNS = "tu AS (SELECT DISTINCT turn_id, user_id, ts, question, answer FROM turns)"


@query(f"WITH {USERS}, {TURNS} SELECT coalesce(u.tier, 'public') AS tier, count(*) AS turns, count(DISTINCT tu.user_id) AS users FROM tu LEFT JOIN u ON tu.user_id = u.user_id GROUP BY 1")
def user_tier_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns and users per asker tier; users without a known tier are public. One row per user before the join."""
    per = conversation.turns(table(spark, d, "turns")).groupBy("user_id").agg(F.count("*").alias("n"))
    tiers = conversation.members(table(spark, d, "members"))
    joined = per.join(tiers, "user_id", "left").select(default_tier(F.col("tier")).alias("tier"), "n", "user_id")
    return joined.groupBy("tier").agg(F.sum("n").alias("turns"), F.count("user_id").alias("users"))


@query(f"WITH {USERS}, {TURNS} SELECT user_id, count(*) AS turns FROM tu WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM u) GROUP BY user_id")
def denied_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Turns of people who are not members (null ids too)."""
    per = conversation.turns(table(spark, d, "turns")).groupBy("user_id").agg(F.count("*").alias("turns"))
    return per.join(conversation.members(table(spark, d, "members")).select("user_id"), "user_id", "left_anti")


@query(
    f"WITH {TURNS}, x AS (SELECT *, epoch_us(ts) AS t, CASE WHEN lower(trim(question)) = '/reset' THEN 1 ELSE 0 END AS reset FROM tu WHERE user_id IS NOT NULL AND ts IS NOT NULL), "
    "y AS (SELECT turn_id, user_id, t, coalesce(sum(reset) OVER (PARTITION BY user_id ORDER BY ts, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM x) "
    "SELECT turn_id, least(count(*) OVER (PARTITION BY user_id, session ORDER BY t RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) - 1, 4) AS recent FROM y"
)
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    """How many turns of the last ten minutes (four at most) a turn's context holds."""
    return conversation.recent_counts(conversation.turns(table(spark, d, "turns")))


@query(
    f"WITH {TURNS}, x AS (SELECT *, CASE WHEN lower(trim(question)) = '/reset' THEN 1 ELSE 0 END AS reset FROM tu WHERE user_id IS NOT NULL AND ts IS NOT NULL), "
    "y AS (SELECT *, coalesce(sum(reset) OVER (PARTITION BY user_id ORDER BY ts, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM x) "
    "SELECT user_id, session::BIGINT AS session, count(*) AS turns, min(turn_id) AS first_turn FROM y GROUP BY ALL"
)
def chat_sessions_by_marker(spark: SparkSession, d: str) -> DataFrame:
    return conversation.sessions(conversation.turns(table(spark, d, "turns")))


@query(
    f"WITH {TURNS} SELECT turn_id, CASE WHEN c IN ('/start', 'start') THEN 'start' WHEN c IN ('/help', 'help') THEN 'help' WHEN c IN ('/reset', 'reset') THEN 'reset' WHEN c = '' THEN 'blank' ELSE 'question' END AS route "
    "FROM (SELECT turn_id, lower(trim(regexp_replace(coalesce(question, ''), '^(\\s*/[A-Za-z]+)@\\w+', '\\1'))) AS c FROM tu)"
)
def command_routes(spark: SparkSession, d: str) -> DataFrame:
    return conversation.turns(table(spark, d, "turns")).select("turn_id", conversation.route(F.col("question")).alias("route"))


@query(
    f"WITH {TURNS}, x AS (SELECT turn_id, ts, trim(regexp_replace(replace(coalesce(question, ''), chr(160), ' '), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(replace(coalesce(answer, ''), chr(160), ' '), '\\s+', ' ', 'g')) AS a FROM tu) "
    "SELECT turn_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] user: ' || CASE WHEN length(q) > 500 THEN q[:499] || '…' ELSE q END || chr(10) || 'assistant: ' || CASE WHEN length(a) > 300 THEN a[:299] || '…' ELSE a END AS line FROM x WHERE ts IS NOT NULL"
)
def rewrite_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines by which a turn enters a later rewrite prompt."""
    return conversation.turns(table(spark, d, "turns")).where("ts IS NOT NULL").select("turn_id", conversation.prompt_line(F.col("ts"), F.col("question"), F.col("answer")).alias("line"))


# -- tokens and keyword search -----------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS terms FROM (SELECT id, {_tok('text')} AS t FROM ch)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    x = corpus(table(spark, d, "chunks")).select("id", T.tokens(F.col("text")).alias("t"))
    return x.select("id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@query(f"WITH {CHUNKS} SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct({_tok('text')})) AS term FROM ch WHERE rank <= 1) GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term over what a resident may see."""
    rows = corpus(table(spark, d, "chunks")).where(visible(F.col("tier"), "resident"))
    return rows.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


BM25 = f"""WITH {CHUNKS}, d AS (SELECT id, source, n, rank, {_tok('text')} AS ts FROM ch WHERE rank IS NOT NULL),
    l AS (SELECT id, source, n, rank, len(ts) AS dl, ts FROM d),
    c(caller) AS (VALUES (0), (1), (2)),
    s AS (SELECT caller, count(*) AS rows_n, avg(dl) AS mean_dl FROM l JOIN c ON rank <= caller GROUP BY caller),
    p AS (SELECT id, source, n, rank, dl, term, count(*) AS tf FROM (SELECT id, source, n, rank, dl, unnest(ts) AS term FROM l) GROUP BY ALL),
    f AS (SELECT term, caller, count(*) AS df FROM p JOIN c ON rank <= caller GROUP BY ALL),
    q AS (SELECT DISTINCT id AS qid, {RANK.format('tier')} AS caller, unnest(list_distinct({_tok('question')})) AS term FROM questions),
    h AS (SELECT q.qid, p.id, p.source, p.n, round(sum(ln(1 + (rows_n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl))), 6) AS score
          FROM q JOIN f USING (term, caller) JOIN s USING (caller) JOIN p ON p.term = q.term AND p.rank <= q.caller GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, n, id)::INT AS position FROM h)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.questions(table(spark, d, "questions"))


def _ranked(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    return keyword_ranking(corpus(table(spark, d, "chunks")), _questions(spark, d).select(F.col("id").alias("qid"), "question", "tier"), k)


@query(BM25 + " SELECT qid, id, round(score, 4) AS score, position FROM r WHERE position <= 5")
def bm25_topk_visible(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of each question of the evaluation set, among those its asker may see."""
    return _ranked(spark, d, 5).select("qid", "id", F.round("score", 4).alias("score"), "position")


@query(BM25 + " SELECT caller_tier AS tier, count(*) AS hits, count_if(leak) AS leaks FROM (SELECT qs.tier AS caller_tier, NOT (" + RANK.format("ch.tier") + " <= " + RANK.format("qs.tier") + ") AS leak FROM r JOIN ch USING (id) JOIN (SELECT DISTINCT id, tier FROM questions) qs ON qs.id = r.qid WHERE position <= 10) GROUP BY 1")
def leaks_by_tier(spark: SparkSession, d: str) -> DataFrame:
    """Hits shown to each tier and how many of them it may not see (none)."""
    hits = _ranked(spark, d, 10).select("qid", "id").join(corpus(table(spark, d, "chunks")).select("id", "tier"), "id")
    asked = _questions(spark, d).select(F.col("id").alias("qid"), F.col("tier").alias("caller"))
    leak = ~F.coalesce(visible(F.col("tier"), F.col("caller")), F.lit(False))
    return hits.join(asked, "qid").groupBy(F.col("caller").alias("tier")).agg(F.count("*").alias("hits"), F.count_if(leak).alias("leaks"))


@query(
    BM25 + ", a AS (SELECT DISTINCT ON (id) * FROM questions), rc AS (SELECT DISTINCT a.id AS qid, ch.id FROM (SELECT id, expect, expected_answer, unnest(expected_sources) AS source FROM a) a JOIN ch ON ch.source = a.source "
    "WHERE expect = 'answer' AND expected_answer <> '' AND contains(lower(ch.text), lower(expected_answer))), "
    "g AS (SELECT a.id AS qid, a.tier, a.id IN (SELECT qid FROM rc) AS scored, (SELECT min(position) FROM r JOIN rc ON rc.qid = r.qid AND rc.id = r.id WHERE r.qid = a.id) AS rank, "
    "(SELECT min(position) FROM r WHERE r.qid = a.id AND list_contains(a.expected_sources, r.source)) AS doc_rank FROM a) "
    "SELECT tier, count_if(scored) AS n_scored, round(coalesce(count_if(scored AND rank <= 1) / nullif(count_if(scored), 0), 0), 6) AS piece_1st, round(coalesce(count_if(scored AND rank <= 3) / nullif(count_if(scored), 0), 0), 6) AS piece_top3, "
    "round(coalesce(count_if(scored AND rank <= 5) / nullif(count_if(scored), 0), 0), 6) AS piece_top5, round(coalesce(sum(CASE WHEN scored THEN coalesce(1.0 / rank, 0) END) / nullif(count_if(scored), 0), 0), 6) AS mrr, "
    "round(coalesce(count_if(scored AND doc_rank = 1) / nullif(count_if(scored), 0), 0), 6) AS doc_1st, 0::BIGINT AS leaks FROM g GROUP BY tier"
)
def mrr_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """By tier: shares of questions whose right chunk is first, in the first three and five, and its mean reciprocal rank."""
    return evaluate.measures(evaluate.measured(_ranked(spark, d, None), _questions(spark, d), corpus(table(spark, d, "chunks"))), "tier")


@query(
    f"WITH {CHUNKS}, q AS (SELECT DISTINCT id AS qid, expected_answer, unnest(expected_sources) AS source FROM questions WHERE expect = 'answer' AND expected_answer IS NOT NULL AND expected_answer <> '') "
    "SELECT DISTINCT qid, ch.id FROM q JOIN ch ON ch.source = q.source AND contains(lower(ch.text), lower(q.expected_answer))"
)
def right_chunks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.right_chunks(_questions(spark, d), corpus(table(spark, d, "chunks")))


# -- vectors and fusion ------------------------------------------------------------------------------------------


RANKED = RANK.format("tier")
DOCS = f"dt AS (SELECT doc_id, max({RANKED}) AS rank, max(coalesce({RANKED}, 0)) AS caller FROM documents GROUP BY doc_id)"
VECTORS = f"""{DOCS}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, rank, caller FROM embeddings JOIN dt ON doc_id = vec_id),
    vs AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.rank <= a.caller WHERE a.vec_id % 20 = 0),
    vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS position FROM vs)"""


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with the tier of their document, and as queries (ids divisible by 20) with the tier of an asker."""
    tiers = table(spark, d, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("tier").alias("tier"))
    rows = table(spark, d, "embeddings").join(tiers, "vec_id").select("vec_id", "embedding", "tier")
    return rows, rows.where("vec_id % 20 = 0").withColumn("tier", default_tier(F.col("tier")))


def _vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    return vector_ranking(*_embedded(spark, d), k)


@query(f"WITH {VECTORS} SELECT qid, id AS vec_id, round(score, 4) AS score, position FROM vr WHERE position <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 10).select("qid", "vec_id", F.round("score", 4).alias("score"), "position")


@query(f"WITH {VECTORS}, t AS (SELECT score FROM vr WHERE position = 2) SELECT median(score) AS median_score, count(*) AS queries FROM t")
def median_top1(spark: SparkSession, d: str) -> DataFrame:
    """Median likeness of the nearest other vector."""
    return _vectors(spark, d, 2).where("position = 2").agg(F.median("score").alias("median_score"), F.count("*").alias("queries"))


KEYWORD = f"""b AS (SELECT d.doc_id AS id, rank, {_tok('text')} AS ts FROM documents d JOIN dt USING (doc_id) WHERE rank IS NOT NULL AND d.doc_id IN (SELECT vec_id FROM embeddings)),
    bl AS (SELECT id, rank, len(ts) AS dl, ts FROM b), cl(caller) AS (VALUES (0), (1), (2)),
    st AS (SELECT caller, count(*) AS rows_n, avg(dl) AS mean_dl FROM bl JOIN cl ON rank <= caller GROUP BY caller),
    p AS (SELECT id, rank, dl, term, count(*) AS tf FROM (SELECT id, rank, dl, unnest(ts) AS term FROM bl) GROUP BY ALL),
    f AS (SELECT term, caller, count(*) AS df FROM p JOIN cl ON rank <= caller GROUP BY ALL),
    kq AS (SELECT d.doc_id AS qid, caller, unnest(list_distinct({_tok("coalesce(title, source)")})) AS term FROM documents d JOIN dt USING (doc_id) WHERE d.doc_id % 20 = 0 AND d.doc_id IN (SELECT vec_id FROM embeddings)),
    ks AS (SELECT qid, p.id, round(sum(ln(1 + (rows_n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl))), 6) AS score FROM kq JOIN f USING (term, caller) JOIN st USING (caller) JOIN p ON p.term = kq.term AND p.rank <= kq.caller GROUP BY ALL),
    kr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS position FROM ks)"""
FUSED = """kk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY position) AS position FROM kr WHERE score > 0 AND (qid, id) IN (SELECT (qid, id) FROM vr WHERE position <= 5)),
    u AS (SELECT qid, id, 1.0::DOUBLE / (2 + position) AS s, position FROM vr UNION ALL SELECT qid, id, 0.5::DOUBLE / (2 + position), NULL FROM kk),
    fu AS (SELECT qid, id, round(sum(s), 12) AS score, min(position) AS corpus FROM u GROUP BY ALL),
    fp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, corpus, id) AS position, count(*) OVER (PARTITION BY qid) AS size FROM fu),
    be AS (SELECT qid, arg_min(id, position) AS best FROM kr WHERE score > 0 GROUP BY qid),
    ba AS (SELECT fp.qid, fp.position AS best_at FROM fp JOIN be ON be.qid = fp.qid AND be.best = fp.id),
    mo AS (SELECT fp.qid, fp.id, CASE WHEN best_at > 5 AND size > 5 AND position = best_at THEN 5 WHEN best_at > 5 AND size > 5 AND position >= 5 AND position < best_at THEN position + 1 ELSE position END AS position FROM fp LEFT JOIN ba USING (qid))"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Keyword scores of the documents with a vector, asked with their titles by askers of their own tier."""
    rows = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    docs = rows.select(F.col("doc_id").alias("id"), "text", F.lit("").alias("source"), F.lit(0).alias("n"), "tier")
    asked = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("title", "source").alias("question"), default_tier(F.col("tier")).alias("tier"))
    return keyword_scores(docs, asked).select("qid", "id", "score")


@query(f"WITH {VECTORS}, {KEYWORD}, {FUSED} SELECT qid, mo.id, round(fp.score, 6) AS score, mo.position::INT AS position FROM mo JOIN fp USING (qid, position) WHERE mo.position <= 5")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vector and keyword rankings of the same documents, fused, with the rescue of the best keyword hit, tier by tier."""
    return fused_top(*_embedded(spark, d), _titled(spark, d)).select("qid", "id", F.round("score", 6).alias("score"), "position")


@query(f"WITH {VECTORS}, {KEYWORD} SELECT qid, id, CASE WHEN k.position < v.position THEN 'better' WHEN k.position > v.position THEN 'worse' ELSE 'same' END AS verdict FROM vr v JOIN (SELECT qid, id, position FROM kr) k USING (qid, id) WHERE v.position <= 10")
def rank_compare(spark: SparkSession, d: str) -> DataFrame:
    """Whether the keyword ranking puts a near document higher than the vector ranking does."""
    first = _vectors(spark, d, 10).select("qid", F.col("vec_id").alias("id"), F.col("position").alias("v"))
    scores = _titled(spark, d)
    # Only the near documents' places are wanted: the better hits of their queries are counted, not sorted.
    mine = scores.join(first, ["qid", "id"]).select("qid", "id", "v", "score")
    above = scores.select("qid", F.col("id").alias("other"), F.col("score").alias("s")).join(mine, "qid").where("s > score OR (s = score AND other < id)")
    places = mine.join(above.groupBy("qid", "id").agg(F.count("*").alias("above")), ["qid", "id"], "left").withColumn("k", F.coalesce("above", F.lit(0)) + 1)
    verdict = F.when(F.col("k") < F.col("v"), "better").when(F.col("k") > F.col("v"), "worse").otherwise("same")
    return places.select("qid", "id", verdict.alias("verdict"))


@query(
    f"WITH {VECTORS}, {KEYWORD}, {FUSED}, h AS (SELECT 'vector' AS method, qid, id FROM vr WHERE position <= 10 UNION ALL SELECT 'keyword', qid, id FROM kr WHERE position <= 10 UNION ALL SELECT 'hybrid', qid, id FROM mo WHERE position <= 5) "
    "SELECT method, count(*) AS hits, count_if(NOT coalesce(a.rank <= q.caller, false)) AS leaks FROM h JOIN dt a ON a.doc_id = h.id JOIN dt q ON q.doc_id = h.qid GROUP BY method"
)
def leaks_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each method and how many of them their askers may not see (none)."""
    rows, asked = _embedded(spark, d)
    scores = _titled(spark, d)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    hits = vector_ranking(rows, asked, 10).select(F.lit("vector").alias("method"), "qid", F.col("vec_id").alias("id"))
    hits = hits.unionByName(scores.withColumn("p", F.row_number().over(best)).where("p <= 10").select(F.lit("keyword").alias("method"), "qid", "id"))
    hits = hits.unionByName(fused_top(rows, asked, scores).select(F.lit("hybrid").alias("method"), "qid", "id"))
    seen = hits.join(rows.select(F.col("vec_id").alias("id"), tier_rank(F.col("tier")).alias("rank")), "id").join(asked.select(F.col("vec_id").alias("qid"), tier_rank(F.col("tier")).alias("caller")), "qid")
    return seen.groupBy("method").agg(F.count("*").alias("hits"), F.count_if(~F.coalesce(F.col("rank") <= F.col("caller"), F.lit(False))).alias("leaks"))


# -- answers, citations and guardrails ---------------------------------------------------------------------------


ANSWERS = "an AS (SELECT DISTINCT answer_id, turn_id, text, citations, confidence, refused FROM answers)"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "answers").distinct()


@query(f"WITH {ANSWERS} SELECT answer_id, len({CITED.format('text')})::BIGINT AS cited FROM an")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("answer_id", F.size(T.cited_ids(F.col("text"))).cast("long").alias("cited"))


@query(f"WITH {ANSWERS}, x AS (SELECT DISTINCT answer_id, unnest(citations) AS id FROM an) SELECT answer_id, count_if(id IN (SELECT id FROM chunks)) AS known, count_if(id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)) AS invented FROM x WHERE id IS NOT NULL GROUP BY answer_id")
def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.citation_validity(_answers(spark, d), corpus(table(spark, d, "chunks")))


@query(f"WITH {ANSWERS} SELECT answer_id, CASE WHEN s >= 2 THEN 0.8 WHEN s = 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT answer_id, len(list_distinct(list_transform(list_filter(coalesce(citations, []), lambda c: c IS NOT NULL), lambda c: regexp_replace(c, '#[^#]*$', '')))) AS s FROM an)")
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("answer_id", guardrails.confidence(F.col("citations")).alias("confidence"))


@query(f"WITH {ANSWERS}, {CHUNKS}, x AS (SELECT DISTINCT answer_id, unnest(citations) AS id FROM an) SELECT a.answer_id, CASE coalesce(max(rank), 0) WHEN 0 THEN 'public' WHEN 1 THEN 'resident' ELSE 'staff' END AS tier FROM (SELECT DISTINCT answer_id FROM an) a LEFT JOIN x ON a.answer_id = x.answer_id LEFT JOIN ch ON x.id = ch.id GROUP BY a.answer_id")
def highest_cited_tier(spark: SparkSession, d: str) -> DataFrame:
    return guardrails.highest_cited_tier(_answers(spark, d), corpus(table(spark, d, "chunks")))


@query(f"WITH {ANSWERS} SELECT answer_id, regexp_extract(coalesce(text, ''), '\\n\\n(__[^\\n]*__)\\s*$', 1) AS footer FROM an")
def footer_text(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("answer_id", T.footer(F.col("text")).alias("footer"))


def _flag(pattern: str) -> str:
    return f"WITH {ANSWERS} SELECT answer_id FROM an WHERE text IS NOT NULL AND regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}', 'i') GROUP BY answer_id"


@query(
    f"WITH {ANSWERS} SELECT DISTINCT answer_id FROM an WHERE len(list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+'), lambda s: regexp_matches(s, '{guardrails.GAP_NEGATION.replace(chr(39), chr(39) * 2)}', 'i') AND regexp_matches(s, '{guardrails.GAP_SUBJECT}', 'i'))) > 0"
)
def gap_admission(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where(guardrails.admits_gap(F.col("text"))).select("answer_id").distinct()


@query(_flag(guardrails.INJECTION))
def injection_flags(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where(F.col("text").rlike("(?i)" + guardrails.INJECTION)).select("answer_id").distinct()


@query(_flag(guardrails.HOSTILE))
def hostile_flags(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where(F.col("text").rlike("(?i)" + guardrails.HOSTILE)).select("answer_id").distinct()


SIX = "list_distinct(list_transform(range(1, greatest(len({0}) - 4, 1)), lambda i: array_to_string({0}[i:i+5], ' ')))"
SIXES = "CASE WHEN len(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')) < 6 THEN [] ELSE " + SIX.format("regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')") + " END"
BODY = "regexp_replace(coalesce(text, ''), '\\n\\n(__[^\\n]*__)\\s*$', '')"
PHONES = r"list_transform(regexp_extract_all(coalesce(text, ''), '(?:^|\D)((?:\+?39[\s.-]?)?3\d{2}[\s.-]?\d{6,7})(?:\D|$)', 1), lambda x: regexp_replace(x, '\D', '', 'g'))"
GUARDED = f"""{ANSWERS}, {CHUNKS}, {USERS},
    ca AS (SELECT turn_id, min(CASE tier WHEN 'resident' THEN 1 WHEN 'staff' THEN 2 ELSE 0 END) AS caller FROM (SELECT DISTINCT turn_id, user_id FROM turns) JOIN u USING (user_id) GROUP BY turn_id),
    g AS (SELECT row_number() OVER () AS rid, a.*, coalesce(caller, 0) AS caller FROM an a LEFT JOIN ca USING (turn_id)),
    c AS (SELECT rid, caller, unnest(list_distinct(list_filter(coalesce(citations, []), lambda x: x IS NOT NULL))) AS id FROM g),
    k AS (SELECT rid, ch.text, ch.id IS NOT NULL AS known, coalesce(ch.rank <= caller, false) AS seen FROM c LEFT JOIN ch ON ch.id = c.id),
    s AS (SELECT rid, count_if(NOT known) AS made, count_if(known AND NOT seen) AS hidden, count_if(seen) AS kept, coalesce(string_agg(lower(coalesce(text, '')), ' ') FILTER (seen), '') AS seen_text, coalesce(flatten(list({SIXES.format('text')}) FILTER (known AND NOT seen)), []) AS secret FROM k GROUP BY rid),
    x AS (SELECT g.*, coalesce(made, 0) AS made, coalesce(hidden, 0) AS hidden, coalesce(kept, 0) AS kept, coalesce(seen_text, '') AS seen_text, coalesce(secret, []) AS secret, {SIXES.format('text')} AS own FROM g LEFT JOIN s USING (rid)),
    y AS (SELECT *, CASE WHEN coalesce(refused, false) THEN NULL WHEN list_has_any(own, secret) THEN 'hidden_chunk_text' WHEN list_has_any(own, [{_in(prompt_shingles(PROMPT))}]) THEN 'system_prompt_leak'
        WHEN regexp_matches(coalesce(text, ''), '{guardrails.INJECTION}', 'i') THEN 'injection_in_output'
        WHEN len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i){guardrails.PROMISE}'), lambda p: NOT contains(seen_text, lower(p)[:6]))) > 0 THEN 'unsupported_promise'
        WHEN caller < 2 AND (len(list_filter({PHONES}, lambda p: NOT contains(regexp_replace(seen_text, '\\D', '', 'g'), p))) > 0 OR len(list_filter(regexp_extract_all(coalesce(text, ''), '{guardrails.EMAIL}'), lambda m: NOT contains(seen_text, lower(m)))) > 0) THEN 'personal_data'
        WHEN regexp_matches(coalesce(text, ''), '{guardrails.HOSTILE}', 'i') THEN 'hostile_tone' WHEN kept = 0 THEN 'uncited_answer' END AS rule FROM x),
    fi AS (SELECT unnest(list_filter([CASE WHEN made > 0 THEN 'invented_citation' END, CASE WHEN hidden > 0 THEN 'hidden_citation' END, rule, CASE WHEN NOT coalesce(refused, false) AND rule IS NULL AND length({BODY}) > 1200 THEN 'too_long' END], lambda r: r IS NOT NULL)) AS rule FROM y)"""


@query(f"WITH {GUARDED} SELECT rule, count(*) AS answers FROM fi GROUP BY rule")
def guardrail_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule fires over all answers, by the tier of the member who asked; the known cited chunks stand for the retrieved ones."""
    turns = table(spark, d, "turns").select("turn_id", "user_id").distinct()
    tiers = conversation.members(table(spark, d, "members")).select("user_id", default_tier(F.col("tier")).alias("tier"))
    ranks = turns.join(tiers, "user_id").groupBy("turn_id").agg(F.min_by("tier", tier_rank(F.col("tier"))).alias("tier"))
    rows = _answers(spark, d).join(ranks, "turn_id", "left").withColumn("row", F.xxhash64("answer_id", "turn_id", "text", F.to_json("citations"), "confidence", "refused"))
    cited = rows.select("row", F.explode("citations").alias("id")).distinct()
    held = answering.supplied(cited.select(F.col("row").alias("qid"), "id", F.lit(0).alias("position")), corpus(table(spark, d, "chunks")))
    return answering.firing_counts(answering.apply_guardrails(rows.join(held, rows.row == held.qid, "left").drop("qid")))


@query(f"WITH {ANSWERS}, {TURNS}, {USERS} SELECT a.answer_id, CASE WHEN coalesce(u.tier, 'public') <> 'public' THEN '[withheld: ' || u.tier || ']' ELSE a.text END AS answer FROM an a JOIN tu USING (turn_id) LEFT JOIN u USING (user_id)")
def redacted_details(spark: SparkSession, d: str) -> DataFrame:
    asked = conversation.turns(table(spark, d, "turns")).select("turn_id", "user_id").join(conversation.members(table(spark, d, "members")), "user_id", "left")
    return evaluate.redacted(_answers(spark, d).join(asked, "turn_id")).select("answer_id", "answer")


@query(
    f"WITH {ANSWERS}, h AS (SELECT *, list_filter(coalesce(citations, []), lambda c: c IS NOT NULL) AS held FROM an WHERE text IS NOT NULL), "
    f"w AS (SELECT answer_id, CASE WHEN len(held) > 0 AND NOT coalesce(refused, false) THEN text || '{guardrails.SOURCES}' || array_to_string(held, ', ') ELSE text END AS t FROM h) "
    "SELECT answer_id, regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^__(.+)__$', '<i>\\1</i>', 'g') AS reply FROM w"
)
def reply_format(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("text IS NOT NULL").select("answer_id", guardrails.reply(F.col("text"), F.col("citations"), F.col("refused")).alias("reply"))


@query(f"WITH {ANSWERS}, x AS (SELECT coalesce(refused, false) AS refused, text IS NULL OR regexp_full_match(replace(text, chr(160), ' '), '\\s*') OR regexp_matches(text, 'NON[_ ]TROVATO', 'i') AS said FROM an) SELECT refused, said, count(*) AS answers FROM x GROUP BY ALL")
def refusal_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Refusal flags against what the text says."""
    said = F.col("text").isNull() | F.col("text").rlike(r"(?U)\A\s*\z") | F.col("text").rlike("(?i)NON[_ ]TROVATO")
    return _answers(spark, d).groupBy(F.coalesce("refused", F.lit(False)).alias("refused"), said.alias("said")).agg(F.count("*").alias("answers"))


@query(
    "WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents), s AS (SELECT doc_id, unnest(" + SIX.format("ws") + ") AS sh FROM w WHERE len(ws) >= 6), "
    "v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM heldout), h AS (SELECT item_id, unnest(" + SIX.format("ws") + ") AS sh FROM v WHERE len(ws) >= 6) "
    "SELECT doc_id, item_id, count(*) AS shared FROM s JOIN h USING (sh) GROUP BY ALL"
)
def protected_text_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Six-word runs that a document shares with a protected text."""
    return guardrails.shared_shingles(table(spark, d, "documents"), table(spark, d, "heldout"))


# -- answers from the corpus ----------------------------------------------------------------------------------------


WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
GAPPED = "len(list_filter(regexp_extract_all(bare, '[^.!?\\n]+'), lambda s: regexp_matches(s, '{0}', 'i') AND regexp_matches(s, '{1}', 'i'))) > 0".format(guardrails.GAP_NEGATION.replace("'", "''"), guardrails.GAP_SUBJECT)
PIPELINE = (
    BM25
    + f""", aq AS (SELECT DISTINCT ON (id) id AS qid, question, tier, {RANK.format('tier')} AS caller FROM questions),
    fv AS (SELECT caller, arg_min(ch.id, (source, n, ch.id)) AS id FROM (VALUES (0), (1), (2)) c(caller) JOIN ch ON rank <= caller GROUP BY caller),
    fc AS (SELECT aq.qid, aq.tier, coalesce(r.id, fv.id) AS id FROM aq LEFT JOIN (SELECT qid, id FROM r WHERE position = 1) r USING (qid) LEFT JOIN fv USING (caller)),
    ra AS (SELECT qid, fc.tier, fc.id, ch.rank, ch.tier AS level, trim(trim(regexp_replace(string_split(coalesce(ch.text, ''), chr(10) || chr(10) || '[')[1], '{WHITE}', ' ', 'g'))[:200]) AS w FROM fc LEFT JOIN ch ON ch.id = fc.id),
    rb AS (SELECT *, CASE WHEN w = '' THEN 'NON_TROVATO' ELSE w || ' [' || id || ']' END AS raw FROM ra),
    rd AS (SELECT *, {CITED.format('raw')} AS found, trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\s*\\[([^\\[\\]]+#[^\\[\\]]+)\\]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g')) AS bare FROM rb),
    re AS (SELECT *, CASE WHEN id IS NULL THEN 'no_chunks' WHEN regexp_matches(raw, '{guardrails.MARKER}') THEN 'not_found' WHEN NOT list_contains(found, id) OR bare = '' THEN 'no_citation' WHEN len(found) > 1 THEN 'invented_citation' WHEN {GAPPED} THEN 'gap' END AS reason FROM rd),
    rf AS (SELECT *, CASE WHEN reason IS NOT NULL THEN NULL WHEN regexp_matches(bare, '{guardrails.INJECTION}', 'i') THEN 'injection_in_output' WHEN regexp_matches(bare, '{guardrails.HOSTILE}', 'i') THEN 'hostile_tone' END AS rule FROM re),
    pa AS (SELECT qid, tier, id, coalesce(reason, '') AS reason, coalesce(rule, '') AS rule, reason IS NOT NULL OR rule IS NOT NULL AS refused,
        CASE WHEN reason IS NOT NULL OR rule IS NOT NULL THEN '{answering.REFUSAL.replace(chr(39), chr(39) * 2)}' ELSE bare || chr(10) || chr(10) || '__Affidabilità: 60% · Il tuo livello: ' || (CASE tier WHEN 'public' THEN 'pubblico' WHEN 'resident' THEN 'residente' ELSE 'staff' END)
            || ' · Livello richiesto: ' || (CASE level WHEN 'public' THEN 'pubblico' WHEN 'resident' THEN 'residente' ELSE 'staff' END) || '__' END AS text,
        CASE WHEN reason IS NOT NULL OR rule IS NOT NULL THEN '' ELSE bare END AS said FROM rf)"""
)


def _asked(spark: SparkSession, d: str, tier: str | None = None) -> DataFrame:
    """Answers of the deterministic stand-in model to the evaluation set, by keyword search."""
    rows = corpus(table(spark, d, "chunks"))
    q = _questions(spark, d).select(F.col("id").alias("qid"), "question", (F.lit(tier) if tier else F.col("tier")).alias("tier"))
    return answering.ask(rows, q, method="keyword")


@query(PIPELINE + " SELECT qid, refused, reason, rule, text, CASE WHEN refused THEN '' ELSE id END AS cited FROM pa WHERE tier IN ('public', 'resident', 'staff')")
def pipeline_answers(spark: SparkSession, d: str) -> DataFrame:
    """Search, second filter, generation and guardrails for every question of the evaluation set."""
    a = _asked(spark, d).where(F.col("tier").isin(*TIERS))
    rule = F.coalesce(F.try_element_at("fired", F.lit(1)), F.lit(""))
    return a.select("qid", "refused", F.coalesce("reason", F.lit("")).alias("reason"), rule.alias("rule"), "text", F.array_join("citations", ",").alias("cited"))


SCORED = (
    PIPELINE
    + """, q1 AS (SELECT DISTINCT ON (id) * FROM questions), ri AS (SELECT q1.id AS qid, bool_or(list_contains(q1.expected_sources, s5.source)) AS hit FROM q1 JOIN (SELECT qid, source FROM (SELECT aq.qid, ch.source, row_number() OVER (PARTITION BY aq.qid ORDER BY coalesce(r.score, 0) DESC, ch.source, ch.n, ch.id) AS p FROM aq JOIN ch ON ch.rank <= aq.caller LEFT JOIN r ON r.qid = aq.qid AND r.id = ch.id) WHERE p <= 5) s5 ON s5.qid = q1.id GROUP BY q1.id),
    de AS (SELECT coalesce(expect, 'answer') = 'refusal' AS ref, coalesce(pa.refused, true) AS refused, len(coalesce(expected_sources, [])) > 0 AS has, coalesce(hit, false) AS hit,
        CASE WHEN coalesce(expect, 'answer') = 'refusal' THEN coalesce(pa.refused, true) AND len(list_filter(coalesce(forbidden, []), lambda f: contains(lower(regexp_replace(coalesce(pa.text, ''), '\\n\\n(__[^\\n]*__)\\s*$', '')), lower(f)))) = 0
        ELSE NOT coalesce(pa.refused, true) AND trim(coalesce(expected_answer, '')) <> '' AND contains(lower(said), lower(trim(expected_answer))) END AS correct FROM q1 LEFT JOIN pa ON pa.qid = q1.id LEFT JOIN ri ON ri.qid = q1.id)
    SELECT count(*) AS n_questions, round(coalesce(count_if(hit AND has) / nullif(count_if(has), 0), 0), 6) AS retrieval_hit_rate, round(coalesce(count_if(NOT ref AND correct AND NOT refused) / nullif(count_if(NOT ref), 0), 0), 6) AS answer_correctness,
        round(coalesce(count_if(ref AND refused AND correct) / nullif(count_if(refused), 0), 0), 6) AS refusal_precision, round(coalesce(count_if(ref AND refused AND correct) / nullif(count_if(ref), 0), 0), 6) AS refusal_recall, 0::BIGINT AS tier_leaks FROM de"""
)


@query(SCORED)
def evaluation_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation set answered and scored: retrieval hits, correctness, refusal precision and recall, leaks."""
    a = _asked(spark, d)
    hits = a.select("qid", F.explode("retrieved").alias("id"))
    card = evaluate.scorecard(evaluate.details(_questions(spark, d), a, hits, corpus(table(spark, d, "chunks"))))
    ratios = ("retrieval_hit_rate", "answer_correctness", "refusal_precision", "refusal_recall")
    return card.select("n_questions", *[F.round(c, 6).alias(c) for c in ratios], F.col("tier_leaks").cast("long").alias("tier_leaks"))


@query()
def redteam_rows(spark: SparkSession, d: str) -> DataFrame:
    """The questions that must be refused, sent as attacks: what leaked, what was repeated, which rules fired (checked by tests)."""
    q = _questions(spark, d).where("expect = 'refusal'")
    rows = corpus(table(spark, d, "chunks"))
    attacks = q.select("id", F.lit("question").alias("category"), "tier", F.col("question").alias("attack"))
    asked = attacks.select(F.col("id").alias("qid"), F.col("attack").alias("question"), "tier")
    # Read four times below: answered once.
    a = cut(answering.ask(rows, asked, method="keyword").select("qid", "text", "refused", "fired", "retrieved")).withColumn("error", F.lit(None).cast("string"))
    staff = search(rows, asked.withColumn("tier", F.lit(TIERS[-1])), "keyword")
    found = evaluate.redteam(attacks, a, a.select("qid", F.explode("retrieved").alias("id")), staff, rows)
    return found.select("qid", "category", "tier", "refused", F.array_join("leaked", ",").alias("leaked"), F.array_join("repeated", ",").alias("repeated"), F.to_json("guardrails_fired").alias("fired"), "review")


@query()
def message_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every message of the log handled: command or question, its asker's tier, its answer as it is sent (checked by tests)."""
    rows = corpus(table(spark, d, "chunks"))
    log = conversation.turns(table(spark, d, "turns")).where("turn_id IS NOT NULL").dropDuplicates(["turn_id"])
    # Equal questions of askers of one tier have one answer: they are answered once.
    def answer(queries: DataFrame) -> DataFrame:
        keyed = queries.withColumn("question", F.coalesce("question", F.lit("")))
        once = cut(keyed.select("tier", "question").distinct().select(F.monotonically_increasing_id().cast("string").alias("qid"), "question", "tier"))
        said = answering.ask(rows, once, method="keyword").select("qid", "text", "citations", "refused")
        form = once.select(F.col("qid").alias("form"), "question", "tier")
        return keyed.join(form, ["tier", "question"]).select("qid", "form").join(said.withColumnRenamed("qid", "form"), "form")

    return conversation.handled(log, conversation.members(table(spark, d, "members")), answer).select("turn_id", "user_id", "route", "reply")


@query(f"WITH {CHUNKS} SELECT count(*) AS vectors, count(*) AS kept, 0::BIGINT AS off FROM ch WHERE text IS NOT NULL")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """The vector index built, and built again over the same corpus: vectors, those taken over, and any not of unit length."""
    import uuid

    rows = corpus(table(spark, d, "chunks"))
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    first = indexing.build_index(rows, path)
    again = indexing.build_index(rows, path)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return again.join(first.select("id", F.lit(1).alias("old")), "id", "left").agg(F.count("*").alias("vectors"), F.count("old").alias("kept"), F.count_if((F.abs(length - 1) > 1e-3) & (length > 0)).alias("off"))


# -- ingest ------------------------------------------------------------------------------------------------------

LINES = "li AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS raw_pos, unnest(ls) AS raw, row_number() OVER () AS x FROM (SELECT doc_id, string_split(replace(text, chr(12), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) z, LATERAL (SELECT trim(regexp_replace(replace(raw, chr(160), ' '), '[ \\t\\r]+', ' ', 'g')) AS line, raw_pos AS pos) WHERE line <> '')"


@query(f"WITH {LINES} SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM li GROUP BY doc_id")
def line_normalise(spark: SparkSession, d: str) -> DataFrame:
    return ingest.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(
    f"WITH {LINES}, e AS (SELECT d.source, li.doc_id, line, row_number() OVER (PARTITION BY li.doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY li.doc_id ORDER BY pos DESC) AS z FROM li JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL), "
    "p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM e GROUP BY source), f AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM e WHERE a <= 3 OR z <= 3 GROUP BY ALL) "
    "SELECT source, line, n FROM f JOIN p USING (source) WHERE pages >= 3 AND n >= 2 AND 2 * n >= pages"
)
def line_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Lines at the edges of half of a source's pages or more (documents stand for pages)."""
    return ingest.furniture(ingest.lines(table(spark, d, "documents")), table(spark, d, "documents").select("doc_id", "source"))


@query(
    f"WITH {LINES}, x AS (SELECT doc_id, line, len(regexp_extract_all(line, '\\p{{L}}')) AS l, len(regexp_extract_all(line, '\\p{{Lu}}')) AS u, regexp_matches(line, '{ingest.DAY_OR_MONTH}', 'i') AS dated FROM li) "
    f"SELECT doc_id FROM x GROUP BY doc_id HAVING count_if(regexp_matches(line, '{ingest.DATE_RANGE}', 'i')) < 2 AND NOT bool_or(regexp_matches(line, '{ingest.PRICE_OR_TIME}', 'i')) "
    "AND CASE WHEN count(*) < 3 THEN NOT bool_or(NOT (l >= 3 AND u > 0.85 * l) AND (len(string_split(line, ' ')) >= 4 OR regexp_matches(line, '[\\p{L}\\p{N}_]: \\S') OR dated)) ELSE avg(length(line)) < 15 AND count_if(length(line) >= 50) < 3 END"
)
def label_pages(spark: SparkSession, d: str) -> DataFrame:
    return ingest.label_pages(ingest.lines(table(spark, d, "documents")))


@query(
    f"WITH {LINES}, h AS (SELECT doc_id, pos, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS nxt, len(regexp_extract_all(line, '\\p{{L}}')) AS l, len(regexp_extract_all(line, '\\p{{Lu}}')) AS u FROM li), "
    "k AS (SELECT *, len(regexp_extract_all(nxt, '\\p{L}')) AS nl, len(regexp_extract_all(nxt, '\\p{Lu}')) AS nu FROM h), "
    f"v AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^#+')) WHEN regexp_matches(line, '{ingest.NUMBERED_CLAUSE.replace(chr(39), chr(39) * 2)}') THEN 1 "
    f"WHEN regexp_matches(line, '{ingest.SUB_CLAUSE}') AND length(nxt) >= 50 AND NOT regexp_matches(nxt, '^[a-z]\\.\\s') THEN 2 "
    "WHEN length(line) <= 45 AND l >= 3 AND u > 0.85 * l AND NOT regexp_matches(line, '[.?:,]$') AND length(replace(line, '(', '')) = length(replace(line, ')', '')) AND (length(nxt) >= 50 OR (nxt LIKE '%?' AND nl >= 3 AND nu > 0.85 * nl)) THEN 0 END::INT AS level FROM k) "
    "SELECT doc_id, pos::INT AS pos, level FROM v WHERE level IS NOT NULL"
)
def heading_lead(spark: SparkSession, d: str) -> DataFrame:
    return ingest.headings(ingest.lines(table(spark, d, "documents")))


@query(
    f"WITH {LINES}, h AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN trim(regexp_replace(line, '^#+', '')) END AS t FROM li), s AS (SELECT doc_id, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h) SELECT doc_id, section, count(*) AS lines FROM s GROUP BY ALL"
)
def running_section(spark: SparkSession, d: str) -> DataFrame:
    return ingest.running_sections(ingest.lines(table(spark, d, "documents")))


@query()
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents cut into sections and packed chunks (checked by tests: SQL has no greedy fold)."""
    return ingest.build_chunks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


@query()
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One hash of ids and texts, whatever the partitioning."""
    return ingest.fingerprint(corpus(table(spark, d, "chunks")))


# -- scanner -----------------------------------------------------------------------------------------------------


@query(scanner.sql("SELECT 'answers' AS path, answer_id AS line_no, text AS line FROM (SELECT DISTINCT answer_id, text FROM answers) UNION ALL SELECT 'turns', turn_id, question FROM (SELECT DISTINCT turn_id, question FROM turns)"))
def scan_findings(spark: SparkSession, d: str) -> DataFrame:
    """Secrets and personal data by pattern, one finding per kind and line, excerpts redacted."""
    a = table(spark, d, "answers").select(F.lit("answers").alias("path"), F.col("answer_id").alias("line_no"), F.col("text").alias("line")).distinct()
    t = table(spark, d, "turns").select(F.lit("turns").alias("path"), F.col("turn_id").alias("line_no"), F.col("question").alias("line")).distinct()
    return scanner.findings(a.unionAll(t))


# -- projections and reports -------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT id, row_number() OVER (PARTITION BY source ORDER BY n, id)::INT AS ordinal FROM ch")
def chunk_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Place of each chunk in its document."""
    w = Window.partitionBy("source").orderBy("n", "id")
    return corpus(table(spark, d, "chunks")).select("id", F.row_number().over(w).cast("int").alias("ordinal"))


@query(f"WITH {CHUNKS} SELECT id, '[' || id || '] (fonte: ' || coalesce(source, '') || CASE WHEN section IS NULL THEN '' ELSE ', sezione: ' || section END || ')' || chr(10) || text AS entry FROM ch WHERE text IS NOT NULL")
def context_layout(spark: SparkSession, d: str) -> DataFrame:
    """How a chunk enters the prompt's context."""
    section = F.when(F.col("section").isNull(), "").otherwise(F.concat(F.lit(", sezione: "), F.col("section")))
    entry = F.concat(F.lit("["), F.col("id"), F.lit("] (fonte: "), F.coalesce("source", F.lit("")), section, F.lit(")\n"), F.col("text"))
    return corpus(table(spark, d, "chunks")).where("text IS NOT NULL").select("id", entry.alias("entry"))


@query("SELECT user_id, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS folder FROM (SELECT DISTINCT user_id, regexp_replace(regexp_replace(coalesce(display_name, ''), '[^\\p{L}\\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM members WHERE user_id IS NOT NULL)")
def user_folders(spark: SparkSession, d: str) -> DataFrame:
    """Names of the log folders of users."""
    return table(spark, d, "members").where("user_id IS NOT NULL").select("user_id", T.slug(F.col("display_name")).alias("folder")).distinct()


@query(f"WITH {ANSWERS} SELECT answer_id, CASE WHEN length(text) > 200 THEN (CASE WHEN length(regexp_extract(text[:200], '^((?s:.*)[.!?])\\s', 1)) > 100 THEN regexp_extract(text[:200], '^((?s:.*)[.!?])\\s', 1) ELSE rtrim(text[:200]) END) || ' …' ELSE text END AS short FROM an WHERE text IS NOT NULL")
def truncated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut to 200 characters at a sentence end where there is one in the second half."""
    return _answers(spark, d).where("text IS NOT NULL").select("answer_id", T.truncate(F.col("text"), 200).alias("short"))


PROMISED = (
    f"w AS (SELECT answer_id, citations, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i){guardrails.PROMISE}'), lambda x: lower(x)[:6]))) AS stem FROM an), "
    "wc AS (SELECT answer_id, stem, unnest(CASE WHEN len(coalesce(citations, [])) = 0 THEN [NULL] ELSE list_distinct(citations) END) AS id FROM w), "
    "pr AS (SELECT answer_id FROM (SELECT wc.answer_id, stem, bool_or({0}) AS held FROM wc LEFT JOIN ch ON wc.id = ch.id {1} GROUP BY ALL) WHERE NOT held GROUP BY answer_id)"
)


@query(f"WITH {ANSWERS}, {CHUNKS}, " + PROMISED.format("coalesce(contains(lower(coalesce(ch.text, '')), stem), false)", "") + " SELECT answer_id FROM pr")
def promise_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers that promise something no cited chunk speaks of."""
    return guardrails.unsupported_promises(_answers(spark, d), corpus(table(spark, d, "chunks")))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS events, round(avg(value), 4) AS mean FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and hour."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {TURNS}, x AS (SELECT *, CASE WHEN lower(trim(question)) = '/reset' THEN 1 ELSE 0 END AS reset FROM tu WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT turn_id, coalesce(sum(reset) OVER (PARTITION BY user_id ORDER BY ts, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM x")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Marker sessions by the streaming operator, the whole table as one available-now run."""
    import uuid

    from ..streaming.chat import tracked

    rows = conversation.turns(table(spark, d, "turns"))
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    out = tracked(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("turn_id", "session")


@query()
def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    """Vectors on their first two principal axes (signs are arbitrary, so there is no SQL twin)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", array_to_vector("embedding").alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    flat = vector_to_array("p")
    return PCA(k=2, inputCol="c", outputCol="p").fit(centred).transform(centred).select("vec_id", F.round(flat[0], 5).alias("x"), F.round(flat[1], 5).alias("y"))
