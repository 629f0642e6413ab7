"""Queries of the text operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .abuse import abuse_rates, abuse_scores
from .defects import reply_defects
from .language import labelled_sample, language_labels, language_segments
from .leaks import template_leaks, verbatim_leaks
from .neardup import group_pairs, similar_groups
from .packing import fill_containers, token_sizes
from .private import private_data
from .splitting import split_items


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "chunks"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return language_labels(p1_segments(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_labels(spark, d).where("is_case").select("chunk_id", "lang").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return verbatim_leaks(table(spark, d, "documents"), table(spark, d, "heldout")).select("doc_id", "item_id")


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    return verbatim_leaks(table(spark, d, "documents"), table(spark, d, "heldout"))


def p7_templates(spark: SparkSession, d: str) -> DataFrame:
    return template_leaks(table(spark, d, "documents"), table(spark, d, "heldout"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("abusive AND doc_id IS NOT NULL").select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(p8_scores(spark, d))


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    labelled = labelled_sample(table(spark, d, "chunks"), "id", "text", "lang")
    return reply_defects(table(spark, d, "answers"), table(spark, d, "turns"), labelled)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_defects(spark, d).where("defect IS NOT NULL AND answer_id IS NOT NULL").select("answer_id", "defect")


def _private_fields(spark: SparkSession, d: str) -> DataFrame:
    turns, answers = table(spark, d, "turns"), table(spark, d, "answers")
    return (
        turns.select(F.lit("turns.question").alias("field"), F.col("turn_id").alias("row_id"), F.col("question").alias("text"))
        .unionAll(turns.select(F.lit("turns.answer"), "turn_id", "answer"))
        .unionAll(answers.select(F.lit("answers.text"), "answer_id", "text"))
    )


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return private_data(_private_fields(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = private_data(_private_fields(spark, d).where("text IS NOT NULL"), mask=False)
    return found.select("field", "row_id", F.explode("kinds").alias("kind")).distinct()


CAPACITY = 4096


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(token_sizes(table(spark, d, "documents")), CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_containers(spark, d).groupBy("doc_id").agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > CAPACITY).select("doc_id")


LIMIT, OVERLAP = 1400, 150
SHINGLE, LIKENESS, LEAST_WORDS = 3, 0.6, 20


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(table(spark, d, "chunks"), "id", "text", "section", LIMIT, OVERLAP)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 1").select("chunk_id", "finest_cut").distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar_groups(table(spark, d, "chunks"), "id", "text", SHINGLE, LIKENESS, LEAST_WORDS).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return group_pairs(p5_groups(spark, d).withColumnRenamed("chunk_id", "id"))


QUERIES = {"p1_segments": p1_segments, "p1_labels": p1_labels, "p1_found": p1_found, "p7_found": p7_found, "p7_words": p7_words, "p7_templates": p7_templates, "p8_scores": p8_scores, "p8_found": p8_found, "p8_rates": p8_rates, "p6_containers": p6_containers, "p6_found": p6_found, "p3_masked": p3_masked, "p3_found": p3_found, "p2_defects": p2_defects, "p2_found": p2_found, "p4_pieces": p4_pieces, "p4_found": p4_found, "p5_groups": p5_groups, "p5_found": p5_found}

#: The splitting as a recursive query: each step takes the best boundary of a window, first with room for the overlap.
_PIECES = """
    WITH RECURSIVE c AS (SELECT id, text, min(CASE WHEN t = '' THEN '' WHEN length(t) > 200 THEN '…' || ltrim(right(t, 199)) || chr(10) ELSE t || chr(10) END) AS head
        FROM (SELECT id, text, trim(coalesce(section, '')) AS t FROM chunks WHERE length(text) > 1400) GROUP BY id, text),
    p AS (
        SELECT id, text, head, greatest(1, 1250 - length(head))::INT AS room, 0 AS no, 1 AS nxt, 0 AS s, 0 AS n, 0 AS raw FROM c
        UNION ALL
        SELECT id, text, head, room, no + 1, s2 + n2, s2, n2, nxt FROM (
            SELECT *, CASE
                WHEN length(rest) <= room THEN length(rest) WHEN l1 > 0 THEN least(l1, room)
                WHEN length(rest) <= 1400 THEN length(rest) WHEN l2 > 0 THEN least(l2, 1400)
                WHEN s1 > 0 THEN s1 WHEN sb > 0 THEN sb WHEN w1 > 0 THEN w1 WHEN w2 > 0 THEN w2 ELSE room END AS n2
            FROM (SELECT *,
                length(regexp_extract(substr(rest, 1, room + 1), '^((?s:.*)\\n)', 1)) AS l1, length(regexp_extract(substr(rest, 1, 1401), '^((?s:.*)\\n)', 1)) AS l2,
                length(regexp_extract(substr(rest, 1, room + 1), '^((?s:.*)[.!?])\\s', 1)) AS s1, length(regexp_extract(substr(rest, 1, 1401), '^((?s:.*)[.!?])\\s', 1)) AS sb,
                length(regexp_extract(substr(rest, 1, room + 1), '^((?s:.+))\\s', 1)) AS w1, length(regexp_extract(substr(rest, 1, 1401), '^((?s:.+))\\s', 1)) AS w2
            FROM (SELECT *, substr(text, s2) AS rest FROM (SELECT *, nxt + length(regexp_extract(substr(text, nxt), '^\\s*')) AS s2 FROM p)))
        ) WHERE s2 <= length(text)
    ),
    k AS (SELECT *, substr(text, s + n, 1) AS f, substr(text, s + n - 1, 1) AS z, lag(raw) OVER (PARTITION BY id, text ORDER BY no) AS before, count(*) OVER (PARTITION BY id, text) AS n_pieces,
        CASE WHEN no > 1 AND length(head) + n <= 1400 THEN head ELSE '' END AS h FROM p WHERE no > 0),
    q AS (SELECT *, CASE WHEN f = '' OR f = chr(10) OR z = chr(10) THEN 0 WHEN z IN ('.', '!', '?') AND regexp_matches(f, '\\s') THEN 1 WHEN regexp_matches(f, '\\s') THEN 2 ELSE 3 END AS kind,
        CASE WHEN no > 1 THEN greatest(0, least(150, s - before, 1400 - length(h) - n)) ELSE 0 END AS back FROM k),
    r AS (SELECT *, max(kind) OVER (PARTITION BY id, text) AS worst, substr(text, s - back, back) AS taken, CASE WHEN s - back > 1 THEN substr(text, s - back - 1, 1) ELSE '' END AS edge FROM q),
    u AS (SELECT *, regexp_extract(taken, '(?s)^\\S*\\s+(\\S.*)$', 1) AS whole FROM r),
    v AS (SELECT *, CASE WHEN no = 1 OR (h <> '' AND trim(taken) = trim(replace(h, chr(10), ' '))) OR regexp_replace(taken, '\\s+', '', 'g') = '' THEN ''
        WHEN s - 1 = back OR regexp_matches(edge, '^\\s$') OR whole = '' THEN taken ELSE whole END AS lap FROM u)
"""
_CUT = "(['line', 'sentence', 'word', 'hard'])[{0} + 1]"
_GROUPS = """
    WITH RECURSIVE w AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
    d AS (SELECT ws, min(id) AS rep FROM w WHERE len(ws) >= 20 GROUP BY ws),
    g AS (SELECT rep, unnest(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS gram FROM d),
    n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
    o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.rep < b.rep GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT rep, rep FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a AS rep, min(b) AS class FROM r GROUP BY a),
    groups AS (SELECT w.id, min(class) AS class_id, min(rep) AS copies_of FROM w JOIN d USING (ws) JOIN k USING (rep) GROUP BY w.id)
"""
_PASSAGE = (
    "regexp_extract_all(lower(regexp_replace(strip_accents(regexp_replace(regexp_replace(coalesce(text, ''), '([\\p{L}\\p{N}_])[-\\x{2010}\\x{00AD}][ \\t]*\\r?\\n[\\s>*|#]*([\\p{L}\\p{N}_])', '\\1\\2', 'g'), "
    "'</?[a-zA-Z][^<>\\n]{0,60}>|&#?\\w{1,8};', ' ', 'g')), '[\\x{0300}-\\x{036F}\\x{00AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g')), '[\\p{L}\\p{N}]+')"
)
_TWELVE = "unnest(list_distinct(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' ')))) AS g"
_LEAKED = f"""
    WITH d AS (SELECT doc_id, {_TWELVE} FROM (SELECT doc_id, {_PASSAGE} AS ws FROM documents) WHERE len(ws) >= 12),
    h AS (SELECT item_id, {_TWELVE} FROM (SELECT item_id, {_PASSAGE} AS ws FROM heldout) WHERE len(ws) >= 12)
    SELECT doc_id, item_id, count(DISTINCT g) + 11 AS words FROM d JOIN h USING (g) GROUP BY ALL
"""
SQL: dict[str, str] = {
    "p7_words": _LEAKED,
    "p7_found": f"SELECT doc_id, item_id FROM ({_LEAKED})",
    "p4_found": """
        WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE length(text) > 1400),
        m AS (SELECT id,
            list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS line,
            list_max(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(trim(x)))) AS sentence,
            list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) AS word
          FROM c)
        SELECT DISTINCT id AS chunk_id, CASE WHEN line <= 1400 THEN 'line' WHEN sentence <= 1400 THEN 'sentence' WHEN word <= 1400 THEN 'word' ELSE 'hard' END AS finest_cut FROM m
    """,
    "p4_pieces": _PIECES
    + f"SELECT id AS chunk_id, no::INT AS piece_no, n_pieces::INT AS n_pieces, h || lap || substr(text, s, n) AS piece, (s - 1)::INT AS start, n::INT AS body_chars, length(lap)::INT AS overlap_chars, CASE WHEN no = n_pieces THEN 'end' ELSE {_CUT.format('kind')} END AS cut, {_CUT.format('worst')} AS finest_cut FROM v",
    "p5_groups": _GROUPS + "SELECT id AS chunk_id, class_id, copies_of FROM groups",
    "p5_found": _GROUPS + "SELECT a.id AS chunk_id_a, b.id AS chunk_id_b FROM groups a JOIN groups b USING (class_id) WHERE a.id < b.id",
}
