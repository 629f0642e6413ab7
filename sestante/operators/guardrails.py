"""Checks of answers: citations, confidence, gaps, forbidden wording, shared text, and the first rule that fires."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, source_of
from ..functions.tiers import TIERS, tier_rank
from ..functions.words import WordHasher, window_hashes
from ..session import spread

# The phrasings that the rules look for, portable between the regular-expression engines used here.
GAP_NEGATION = r"\b(?:non|nessun\w*|parzial\w*|not|no|only\s+partial)\b|n't\b"
GAP_SUBJECT = r"\b(?:document[oi]|documents?|fonti?|contesto|informazion\w*|dettagl\w*|indicat\w*|specificat\w*|menzionat\w*|riportat\w*|descritt\w*|trovat[oaie]|trovare|sources?|context|information|details?|specif\w*|mention\w*|stated?)\b"
INJECTION = r"ignor\w*\s+(?:tutte\s+)?(?:le\s+)?(?:istruzioni|regole)|\[/?system\]|modalit[àa]\s+(?:sviluppatore|developer|admin|dev)\b|senza\s+(?:nessuna\s+|alcuna\s+)?(?:regola|regole|restrizioni|limiti)|accesso\s+(?:completo|totale)\s+(?:concesso|garantito|attivato)|(?:ora|adesso|da ora)\s+(?:sei|sono|siete)\s+(?:un\s+)?(?:staff|admin|amministratore)"
PROMISE = r"\bgarantisc\w+|\bgarantit[oaie]\b|\bti assicuro\b|\bvi assicuro\b|\bassicuriamo\b|\bprometto\b|\bpromettiamo\b|\bsicuramente\s+(?:avrai|avrete|ottien\w+|sarai|sarete)\b"
HOSTILE = r"\bazion[ei]\s+legal\w*\b|\bti\s+(?:denunc|quereler)\w*|\bvi\s+(?:denunc|quereler)\w*|\bfaremo\s+causa\b|\bci vedremo in tribunale\b"
PHONE = r"(?<!\d)(?:\+?39[\s.-]?)?3\d{2}[\s.-]?\d{6,7}(?!\d)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
MARKER = r"NON[_ ]TROVATO"
SOURCES = "\n\n📄 Fonti: "
SHINGLE = 6
LONGEST = 1200


def _cited(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", F.explode("citations").alias("id")).where("id IS NOT NULL").distinct()


def citation_validity(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Known and invented ids among the distinct citations of each answer that cites any."""
    seen = _cited(answers).join(chunks.select("id", F.lit(True).alias("ok")), "id", "left")
    return seen.groupBy("answer_id").agg(F.count("ok").alias("known"), F.count_if(F.col("ok").isNull()).alias("invented"))


def confidence(citations: Column) -> Column:
    """0.8 for two documents or more, 0.6 for one, else 0."""
    n = F.size(F.array_distinct(F.transform(F.filter(F.coalesce(citations, F.array().cast("array<string>")), lambda c: c.isNotNull()), source_of)))
    return F.when(n >= 2, F.lit(0.8)).when(n == 1, F.lit(0.6)).otherwise(F.lit(0.0))


def highest_cited_tier(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """The highest tier among the cited chunks, the lowest tier where nothing known is cited."""
    ranks = _cited(answers).join(chunks.select("id", tier_rank(F.col("tier")).alias("rank")), "id").groupBy("answer_id").agg(F.max("rank").alias("rank"))
    names = F.array(*[F.lit(t) for t in TIERS])
    return answers.select("answer_id").distinct().join(ranks, "answer_id", "left").select("answer_id", F.element_at(names, F.coalesce("rank", F.lit(0)) + 1).alias("tier"))


def admits_gap(text: Column) -> Column:
    """Whether one sentence both negates and speaks of documents or information."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+"), F.lit(0))
    return F.exists(parts, lambda s: s.rlike("(?i)" + GAP_NEGATION) & s.rlike("(?i)" + GAP_SUBJECT))


def reply(text: Column, citations: Column, refused: Column) -> Column:
    """The answer ready to send: its sources below unless it is a refusal, escaped, the footer line in italics."""
    held = F.filter(F.coalesce(citations, F.array().cast("array<string>")), lambda c: c.isNotNull())
    whole = F.when((F.size(held) > 0) & ~F.coalesce(refused, F.lit(False)), F.concat(text, F.lit(SOURCES), F.array_join(held, ", "))).otherwise(text)
    return F.regexp_replace(html_escape(whole), r"(?m)^__(.+)__$", "<i>$1</i>")


def promise_stems(text: Column) -> Column:
    """The first six letters of every promise word."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)(?:" + PROMISE + ")"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.substring(F.lower(w), 1, 6)))


def unsupported_promises(answers: DataFrame, chunks: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """``(answer_id)`` of answers with a promise word whose beginning is in no cited chunk (that the caller may see)."""
    said = answers.select("answer_id", "citations", F.explode(promise_stems(F.col("text"))).alias("stem"))
    cited = said.select("answer_id", "stem", F.explode_outer(F.array_distinct("citations")).alias("id"))
    rows = chunks.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("cited_text"), tier_rank(F.col("tier")).alias("rank"))
    met = cited.join(rows, "id", "left")
    holds = F.coalesce(F.contains("cited_text", "stem"), F.lit(False))
    if callers is not None:
        met = met.join(callers, "answer_id", "left")
        holds = holds & F.coalesce(F.col("rank") <= F.coalesce("caller", F.lit(0)), F.lit(False))
    return met.groupBy("answer_id", "stem").agg(F.bool_or(holds).alias("held")).where("NOT held").select("answer_id").distinct()


def _runs(id_col: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, word = WordHasher(), re.compile(r"\w+")
        for batch in batches:
            ids, runs = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = np.unique(window_hashes(hasher(word.findall((text or "").lower())), n))
                ids.append(np.full(len(h), i, np.int64))
                runs.append(h.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64))], names=[id_col, "run"])

    return run


def shared_shingles(documents: DataFrame, items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``(doc_id, item_id, shared)``: distinct runs of ``n`` words in common, by an equi-join on the runs' 64-bit hashes.

    Only hashes travel, eight bytes a run; a run that very many documents share is spread by AQE's skew join. Rows
    with a null id or text, and texts under ``n`` words, share nothing.
    """
    a = spread(documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")).mapInArrow(_runs("doc_id", n), "doc_id long, run long")
    b = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(_runs("item_id", n), "item_id long, run long").distinct()
    return a.join(b, "run").groupBy("doc_id", "item_id").agg(F.countDistinct("run").alias("shared"))
