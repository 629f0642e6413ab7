"""Turns, recent context, marker-ended sessions, routing and rewrite prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten

#: How far back the context reaches, and how many turns it holds.
RECENT_SECONDS, RECENT_TURNS = 600, 4


def turns(rows: DataFrame) -> DataFrame:
    """Distinct turns; arrival time does not count."""
    return rows.select("turn_id", "user_id", "ts", "question", "answer").distinct()


def members(rows: DataFrame) -> DataFrame:
    """One row per user: a known tier if any row has one."""
    known = F.when(F.col("tier").isin("public", "resident", "staff"), F.col("tier"))
    return rows.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(known).alias("tier"), F.max("display_name").alias("display_name"))


def recent_counts(rows: DataFrame) -> DataFrame:
    """Turns of the same user and session in the ten minutes up to each turn, itself excluded, four at most.

    The window is a running frame over sorted rows: nothing of a user is gathered, however many turns there are.
    """
    w = Window.partitionBy("user_id", "session").orderBy(F.unix_micros("ts")).rangeBetween(-RECENT_SECONDS * 1_000_000, 0)
    return _in_session(rows).select("turn_id", F.least(F.count("*").over(w) - 1, F.lit(RECENT_TURNS)).alias("recent"))


def recent_context(rows: DataFrame) -> DataFrame:
    """``(turn_id, recent)``: the turns of the same session before each turn, oldest first, four at most and ten minutes back at most."""
    w = Window.partitionBy("user_id", "session").orderBy("ts", "turn_id").rowsBetween(-RECENT_TURNS, -1)
    held = F.collect_list(F.struct("ts", "question", "answer")).over(w)  # four rows at most
    limit = F.col("ts") - F.expr(f"INTERVAL {RECENT_SECONDS} SECONDS")
    return _in_session(rows).withColumn("held", held).withColumn("limit", limit).select("turn_id", F.filter("held", lambda x: x["ts"] >= F.col("limit")).alias("recent"))


def _in_session(rows: DataFrame) -> DataFrame:
    """Turns of known users and times with the number of the session they stand in."""
    w = Window.partitionBy("user_id").orderBy("ts", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("session", F.coalesce(F.sum(is_reset(F.col("question")).cast("long")).over(w), F.lit(0)))


def is_reset(question: Column) -> Column:
    return F.coalesce(F.lower(F.trim(question)) == "/reset", F.lit(False))


def sessions(rows: DataFrame) -> DataFrame:
    """Sessions end with the user's reset, which still belongs to them; there is no time-out."""
    return _in_session(rows).groupBy("user_id", "session").agg(F.count("*").alias("turns"), F.min("turn_id").alias("first_turn"))


def route(question: Column) -> Column:
    """start, help, reset, blank or question; a bot's name behind a slash command is ignored."""
    c = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"^(\s*/[A-Za-z]+)@\w+", "$1")))
    return F.when(c.isin("/start", "start"), "start").when(c.isin("/help", "help"), "help").when(c.isin("/reset", "reset"), "reset").when(c == "", "blank").otherwise("question")


def prompt_line(ts: Column, question: Column, answer: Column) -> Column:
    """How a turn enters a rewrite prompt: stamped, with shortened texts."""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("] user: "), shorten(question, 500), F.lit("\nassistant: "), shorten(answer, 300))


def accepted_rewrite(original: Column, rewritten: Column) -> Column:
    """The rewritten question, or the original where the rewrite is blank, multi-line or over 500 characters."""
    r = F.trim(F.coalesce(rewritten, F.lit("")))
    return F.when((r == "") | r.contains("\n") | (F.length(r) > 500), original).otherwise(r)


#: What the commands are answered with.
CANNED = {
    "start": "Benvenuto: chieda pure qualcosa sulla casa.",
    "help": "Scriva una domanda per volta. /reset fa ricominciare la conversazione.",
    "reset": "Va bene, ricominciamo.",
    "blank": "",
}


def rewrite_prompt(recent: Column, question: Column) -> Column:
    """The prompt by which a follow-up becomes a question of its own; empty where there is nothing to look back to."""
    held = F.coalesce(recent, F.array().cast("array<struct<ts:timestamp,question:string,answer:string>>"))
    lines = F.array_join(F.transform(held, lambda t: prompt_line(t["ts"], t["question"], t["answer"])), "\n")
    return F.when((F.size(held) == 0) | (F.trim(F.coalesce(question, F.lit(""))) == ""), "").otherwise(F.concat(lines, F.lit("\nnow: "), shorten(question, 500)))


def standalone(rows: DataFrame, model=None, system: str = "") -> DataFrame:
    """``rows(turn_id, question, recent)`` with ``asked``: the question made complete by ``model(prompt, system)``.

    The model is called only where there are recent turns; a failing call or an unusable rewrite keeps the question.
    """
    from .answering import model_replies

    if model is None:
        return rows.withColumn("asked", F.col("question"))
    prompts = rows.select(F.col("turn_id").cast("string").alias("qid"), rewrite_prompt(F.col("recent"), F.col("question")).alias("prompt")).where("prompt <> ''")
    said = model_replies(prompts, model, system).withColumnRenamed("qid", "_qid")
    met = rows.join(said, rows["turn_id"].cast("string") == said["_qid"], "left")
    return met.withColumn("asked", accepted_rewrite(F.col("question"), F.col("raw"))).drop("_qid", "raw")


def handled(rows: DataFrame, users: DataFrame, answer, model=None) -> DataFrame:
    """One reply a message of ``rows(turn_id, user_id, ts, question, answer)``: ``(turn_id, user_id, route, asked, text, reply)``.

    Commands are answered from ``CANNED``; a question gets its asker's tier (the lowest where unknown), is completed from
    the turns before it, goes through ``answer(queries(qid, question, tier)) -> (qid, text, citations, refused)`` and comes
    back formatted. ``asked`` and ``text`` are what a later context holds.
    """
    from .guardrails import reply

    kinds = rows.select("turn_id", "user_id", "question", route(F.col("question")).alias("route"))
    open_ = kinds.where("route = 'question'")
    if model is None:  # nothing looks back
        asked = standalone(open_)
    else:
        # Commands are no part of a context, but a reset ends it.
        recent = recent_context(rows.where(route(F.col("question")).isin("question", "reset")))
        asked = standalone(open_.join(recent, "turn_id", "left"), model)
    tiers = users.select("user_id", "tier")
    queries = asked.join(tiers, "user_id", "left").select(F.col("turn_id").cast("string").alias("qid"), F.col("asked").alias("question"), F.when(F.col("tier").isin("public", "resident", "staff"), F.col("tier")).otherwise("public").alias("tier"))
    said = answer(queries).select("qid", "text", reply(F.col("text"), F.col("citations"), F.col("refused")).alias("reply"))
    answered = asked.join(said, asked["turn_id"].cast("string") == said["qid"], "left").select("turn_id", "user_id", "route", "asked", "text", "reply")
    canned = F.element_at(F.create_map(*[x for k, v in CANNED.items() for x in (F.lit(k), F.lit(v))]), F.col("route"))
    rest = kinds.where("route <> 'question'").select("turn_id", "user_id", "route", F.col("question").alias("asked"), canned.alias("text"), canned.alias("reply"))
    return answered.unionByName(rest)
