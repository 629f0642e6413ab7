"""Answers from retrieved chunks: the model call as a replaceable function, and every rule around it as a column.

A row holds one question with at most ``k`` chunks as an array of structs, so a question's answer is settled inside its
row: refusals, citations, confidence, footer and guardrails are one chain of expressions that whole-stage codegen runs,
and only the model call itself leaves the JVM (batched, and only for rows that need it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompt import PROMPT
from ..functions.text import body, cited_ids, footer, source_of, truncate, without_citations, word_list
from ..functions.tiers import TIERS, default_tier, tier_rank
from .guardrails import EMAIL, HOSTILE, INJECTION, LONGEST, MARKER, PHONE, SHINGLE, admits_gap, promise_stems
from .retrieve import EVIDENCE, search

CHUNK = "array<struct<position:int,id:string,text:string,source:string,tier:string,section:string>>"
ANSWER = ("text", "citations", "confidence", "refused")
#: The text of every refusal.
REFUSAL = "Non ho trovato la risposta nei documenti che posso consultare. Per sicurezza chieda alla segreteria."
#: How the footer names its parts and the tiers.
LABELS = {"confidence": "Affidabilità", "asker": "Il tuo livello", "needed": "Livello richiesto"}
TIER_NAMES = {"public": "pubblico", "resident": "residente", "staff": "staff"}
#: A model: prompt and system prompt in, reply out; whatever it raises counts as no reply.
Model = Callable[[str, str], str]


def quoting_model(prompt: str, system: str) -> str:
    """A deterministic stand-in for a model: the beginning of the first chunk of the prompt, with its citation."""
    entry = prompt.split("\n\n## Domanda\n\n")[0].removeprefix("## Documenti\n\n")
    head, _, text = entry.partition("\n")
    words = " ".join(text.split("\n\n[")[0].split())[:200].strip()
    return f"{words} {head[: head.find(']') + 1]}" if words else "NON_TROVATO"


def supplied(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """``(qid, chunks)``: the chunks of ``hits(qid, id, position)`` in order; as many as the search gave, at most ``k``."""
    held = hits.select("qid", "id", "position").join(rows.select("id", "text", "source", "tier", "section"), "id")
    packed = F.array_sort(F.collect_list(F.struct("position", "id", "text", "source", "tier", "section"))).cast(CHUNK)
    return held.groupBy("qid").agg(packed.alias("chunks"))


def visible_chunks(chunks: Column, caller: Column) -> Column:
    """The second, independent filter: chunks whose tier the caller may see."""
    return F.filter(chunks, lambda c: F.coalesce(tier_rank(c["tier"]) <= caller, F.lit(False)))


def context(chunks: Column) -> Column:
    """The chunks as they are laid out for the model, ids included."""
    section = lambda c: F.when(F.coalesce(c["section"], F.lit("")) == "", "").otherwise(F.concat(F.lit(", sezione: "), c["section"]))
    entry = lambda c: F.concat(F.lit("["), c["id"], F.lit("] (fonte: "), F.coalesce(c["source"], F.lit("")), section(c), F.lit(")\n"), F.coalesce(c["text"], F.lit("")))
    return F.array_join(F.transform(chunks, entry), "\n\n")


def confidence_of(citations: Column) -> Column:
    """0.8 for two cited documents or more, else 0.6."""
    return F.when(F.size(F.array_distinct(F.transform(citations, source_of))) >= 2, F.lit(0.8)).otherwise(F.lit(0.6))


def footer_line(confidence: Column, chunks: Column, asker: Column | None = None) -> Column:
    """The footer: confidence, the asker's tier if known, the highest tier among the cited chunks."""
    names = F.create_map(*[x for t, n in TIER_NAMES.items() for x in (F.lit(t), F.lit(n))])
    top = F.element_at(F.array(*[F.lit(TIER_NAMES[t]) for t in TIERS]), F.coalesce(F.array_max(F.transform(chunks, lambda c: tier_rank(c["tier"]))), F.lit(0)) + 1)
    parts = [F.concat(F.lit(LABELS["confidence"] + ": "), F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))]
    if asker is not None:
        parts.append(F.when(asker.isNotNull(), F.concat(F.lit(LABELS["asker"] + ": "), F.coalesce(F.try_element_at(names, asker), asker))))
    parts.append(F.concat(F.lit(LABELS["needed"] + ": "), top))
    return F.concat(F.lit("__"), F.concat_ws(" · ", *parts), F.lit("__"))


def _said(model: Model, system: str):
    def run(prompts: pd.Series) -> pd.Series:
        replies = []
        for prompt in prompts:
            try:
                replies.append(None if prompt is None else model(prompt, system) or None)
            except Exception:  # no reply: the rules turn it into a refusal
                replies.append(None)
        return pd.Series(replies, dtype=object)

    return run


def _called(model: Model, system: str):
    said = _said(model, system)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["qid"]].assign(raw=said(frame["prompt"]).to_numpy())

    return run


def model_replies(rows: DataFrame, model: Model, system: str = PROMPT) -> DataFrame:
    """``(qid, raw)`` from ``rows(qid, prompt)``; a failing call gives null."""
    return rows.select(F.col("qid").cast("string").alias("qid"), "prompt").mapInPandas(_called(model, system), "qid string, raw string")


def generate(asked: DataFrame, model: Model = quoting_model, system: str = PROMPT) -> DataFrame:
    """Answers to ``asked(qid, question, tier, chunks)``: its columns with ``text, citations, confidence, refused, reason``.

    Refusals are settled in this order: no chunks (the model is not called), no reply, the reply's marker, no known
    citation or no text, an invented citation, an admitted gap. Duplicate ``qid`` must not occur.
    """
    rows = asked.withColumn("qid", F.col("qid").cast("string"))
    prompt = F.concat(F.lit("## Documenti\n\n"), context(F.col("chunks")), F.lit("\n\n## Domanda\n\n"), F.coalesce("question", F.lit("")))
    # A column of the same row: nothing is joined back, and a plan that reads it twice still calls the model once a row.
    said = F.pandas_udf(_said(model, system), "string").asNondeterministic()(F.when(F.size("chunks") > 0, prompt))
    judged = rows.withColumn("raw", said).withColumn("chunks", F.coalesce("chunks", F.array().cast(CHUNK)))
    found = cited_ids(F.col("raw"))
    judged = judged.withColumn("found", found).withColumn("known", F.array_intersect("found", F.transform("chunks", lambda c: c["id"]))).withColumn("bare", without_citations(F.coalesce("raw", F.lit(""))))
    reason = (
        F.when(F.size("chunks") == 0, "no_chunks")
        .when(F.coalesce("raw", F.lit("")) == "", "no_reply")
        .when(F.col("raw").rlike(MARKER), "not_found")
        .when((F.size("known") == 0) | (F.col("bare") == ""), "no_citation")
        .when(F.size("known") < F.size("found"), "invented_citation")
        .when(admits_gap(F.col("bare")), "gap")
    )
    judged = judged.withColumn("reason", reason).withColumn("level", confidence_of(F.col("known")))
    kept = F.filter("chunks", lambda c: F.array_contains(F.col("known"), c["id"]))
    good = F.col("reason").isNull()
    none = F.array().cast("array<string>")
    out = judged.withColumns(
        {
            "text": F.when(good, F.concat("bare", F.lit("\n\n"), footer_line(F.col("level"), kept, F.col("tier")))).otherwise(REFUSAL),
            "citations": F.when(good, F.col("known")).otherwise(none),
            "confidence": F.when(good, F.col("level")).otherwise(F.lit(0.0)),
            "refused": ~good,
        }
    )
    return out.drop("raw", "found", "known", "bare", "level")


def _shingles(text: Column) -> Column:
    """The runs of ``SHINGLE`` words; the words are bound to a variable, so that they are split once, not once a run."""
    runs = lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(word_list(text)), runs), 1)


def prompt_shingles(prompt: str) -> list[str]:
    """The distinct runs of words of a prompt, its comments left out."""
    import re

    words = re.findall(r"\w+", re.sub(r"(?s)<!--.*?-->", "", prompt).lower())
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def apply_guardrails(rows: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """The last check of ``rows(tier, chunks, text, citations, confidence, refused)``; adds ``fired``, the rules in order.

    Invented and hidden citations are dropped (and the footer rebuilt from those that are left); a refusal is then left as
    it is. Of the rest the first rule that fires turns the answer into the refusal: hidden text, system prompt,
    injection, unsupported promise, personal data, hostile tone, no citation left. Too long an answer is cut, its footer
    kept. Only ``chunks`` count as retrieved. Null texts are empty, null flags false, unknown tiers the lowest.
    """
    caller = F.coalesce(tier_rank(default_tier(F.col("tier"))), F.lit(0))
    none = F.array().cast("array<string>")
    x = rows.withColumns({"chunks": F.coalesce("chunks", F.array().cast(CHUNK)), "text": F.coalesce("text", F.lit("")), "citations": F.filter(F.coalesce("citations", none), lambda c: c.isNotNull()), "refused": F.coalesce("refused", F.lit(False)), "_caller": caller})
    ids = lambda chunks: F.transform(chunks, lambda c: c["id"])
    x = x.withColumn("_seen", visible_chunks(F.col("chunks"), F.col("_caller")))
    x = x.withColumn("_kept", F.filter("citations", lambda c: F.array_contains(ids(F.col("_seen")), c))).withColumn("_lost", F.array_except("citations", "_kept"))
    hidden = F.array_except(ids(F.col("chunks")), ids(F.col("_seen")))
    x = x.withColumn("_hidden", F.array_intersect("_lost", hidden)).withColumn("_made", F.array_except("_lost", "_hidden"))
    rebuilt = (F.size("_lost") > 0) & (F.size("_kept") > 0) & (footer(F.col("text")) != "")
    cited = F.filter("_seen", lambda c: F.array_contains(F.col("_kept"), c["id"]))
    level = F.when(rebuilt, confidence_of(F.col("_kept"))).otherwise(F.col("confidence"))
    shown = F.when(footer(F.col("text")).contains(LABELS["asker"]), F.col("tier"))
    x = x.withColumn("_text", F.when(rebuilt, F.concat(body(F.col("text")), F.lit("\n\n"), footer_line(confidence_of(F.col("_kept")), cited, shown))).otherwise(F.col("text"))).withColumn("confidence", level)
    text, own = F.col("_text"), _shingles(F.col("_text"))
    unseen = F.filter("chunks", lambda c: ~F.coalesce(tier_rank(c["tier"]) <= F.col("_caller"), F.lit(False)))
    cited_text = F.lower(F.array_join(F.transform(F.filter("chunks", lambda c: F.array_contains(F.col("_kept"), c["id"])), lambda c: F.coalesce(c["text"], F.lit(""))), " "))
    known = F.array_join(F.transform("_seen", lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    digits = lambda c: F.regexp_replace(c, r"(?U)\D", "")
    x = x.withColumns({"_own": own, "_cited_text": cited_text, "_known": known})
    numbers = F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0))
    mails = F.regexp_extract_all(text, F.lit("(?U)" + EMAIL), F.lit(0))
    personal = (F.col("_caller") < len(TIERS) - 1) & (F.exists(numbers, lambda p: ~F.contains(digits(F.col("_known")), digits(p))) | F.exists(mails, lambda m: ~F.contains(F.lower("_known"), F.lower(m))))
    secret = F.array(*[F.lit(s) for s in prompt_shingles(prompt)]).cast("array<string>")
    rule = (
        F.when(F.col("refused"), None)
        .when(F.exists(unseen, lambda c: F.arrays_overlap(F.col("_own"), _shingles(c["text"]))), "hidden_chunk_text")
        .when(F.arrays_overlap(F.col("_own"), secret), "system_prompt_leak")
        .when(text.rlike("(?i)" + INJECTION), "injection_in_output")
        .when(F.exists(promise_stems(text), lambda s: ~F.contains(F.col("_cited_text"), s)), "unsupported_promise")
        .when(personal, "personal_data")
        .when(text.rlike("(?i)" + HOSTILE), "hostile_tone")
        .when(F.size("_kept") == 0, "uncited_answer")
    )
    x = x.withColumn("_rule", rule)
    long = ~F.col("refused") & F.col("_rule").isNull() & (F.length(body(text)) > LONGEST)
    fired = F.array_compact(F.array(F.when(F.size("_made") > 0, "invented_citation"), F.when(F.size("_hidden") > 0, "hidden_citation"), F.col("_rule"), F.when(long, "too_long")))
    gone = F.col("_rule").isNotNull()
    end = F.when(footer(text) == "", "").otherwise(F.concat(F.lit("\n\n"), footer(text)))
    out = x.withColumns(
        {
            "fired": fired,
            "text": F.when(gone, REFUSAL).when(long, F.concat(truncate(body(text), LONGEST), end)).otherwise(text),
            "citations": F.when(gone, none).otherwise(F.col("_kept")),
            "confidence": F.when(gone, F.lit(0.0)).otherwise(F.col("confidence")),
            "refused": F.col("refused") | gone,
        }
    )
    return out.drop("_caller", "_seen", "_kept", "_lost", "_hidden", "_made", "_text", "_own", "_cited_text", "_known", "_rule")


def firing_counts(rows: DataFrame) -> DataFrame:
    """``(rule, answers)`` of every rule in ``fired``."""
    return rows.select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("answers"))


def ask(rows: DataFrame, queries: DataFrame, model: Model = quoting_model, method: str = "hybrid", k: int = EVIDENCE, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, system: str = PROMPT) -> DataFrame:
    """Answers to ``queries(qid, question, tier)`` over the chunks ``rows``: search, second filter, generation, guardrails.

    One row a query with ``text, citations, confidence, refused, reason, fired``; a query that finds nothing, and one of
    an unknown tier, is refused. ``retrieved`` keeps the ids as the search gave them, so that leaks are measured before any filter.
    """
    hits = search(rows, queries, method, k, vectors, query_vectors)
    found = supplied(hits, rows)
    asked = queries.select("qid", "question", "tier").join(found, "qid", "left").withColumn("retrieved", F.coalesce(F.transform("chunks", lambda c: c["id"]), F.array().cast("array<string>")))
    asked = asked.withColumn("chunks", visible_chunks(F.coalesce("chunks", F.array().cast(CHUNK)), tier_rank(F.col("tier"))))
    return apply_guardrails(generate(asked, model, system), system)
