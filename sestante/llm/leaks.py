"""Held-out passages in documents: hash join of canonicalised word windows, then a check of the slots.

Words are compared without case, accents, punctuation, markup, quote marks and line-end hyphens. In each window of
``window`` successive words, numbers, names and units give way to typed placeholders; equal templates are joined by
hash, and the concrete words behind the placeholders (the slots) tell a verbatim passage (all slots equal) from a
re-parameterised one (each slot of the item answers to one value in the document throughout).
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import WORD, mix
from ..session import ready, spread

#: Item windows up to this number go to the workers as a filter; beyond it the join is a plain shuffle.
FILTER_WINDOWS = 2_000_000

#: Unit words that become a placeholder.
UNITS = frozenset(
    "euro euros eur dollar dollars cent cents km kilometri metri metro metres meters meter mètres metros cm mm kg chili grammi gramm grams "
    "ore ora minuti secondi giorni settimane mesi anni hours hour minutes seconds days weeks months years stunden minuten tage wochen monate jahre "
    "heures minutes jours semaines mois ans horas minutos dias semanas meses anos litri litres liter litros gradi percento percent prozent "
    "scudi crowns kronen couronnes coronas".split()
)

_HYPHEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[\s>*|#]*(?=\w)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>|&#?\w{1,8};")
_GROUP = re.compile(r"(?<=\d)[.,'’ \u00a0\u202f](?=\d{3}(?!\d))")
_SPLIT = re.compile(r"(?<=\d)[.,:/](?=\d)")
_MARK = re.compile("[̀-ͯ­​-‏⁠﻿]")


def passage_words(text: str | None, raw: bool = False) -> list[str]:
    """The words that count, in order; ``raw`` keeps their case and makes one word of a separated figure."""
    if not text:
        return []
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    if raw:
        return WORD.findall(_SPLIT.sub("x", _GROUP.sub("", text)))
    return WORD.findall(text.casefold())


def _uses(text: str | None) -> tuple[set[str], set[str]]:
    """Words written with a capital inside sentences, and words written without one."""
    capital: set[str] = set()
    small: set[str] = set()
    for m in re.finditer(r"[^\W\d_]+", text or ""):
        w = m.group()
        if w[0].islower():
            small.update(passage_words(w))
        elif m.start() > 1 and text[m.start() - 2] not in ".!?" and text[m.start() - 1] != "\n":
            capital.update(passage_words(w))
    return capital, small


def names_of(texts: list[str]) -> frozenset[str]:
    """Words written with a capital inside sentences and never without one: the names of the items."""
    uses = [_uses(text) for text in texts]
    return frozenset(set().union(*[c for c, _ in uses]) - set().union(*[x for _, x in uses]))


def _words_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            capital, small = _uses(text)
            words = sorted(set(passage_words(text)) | {w.casefold() for w in passage_words(text, True)})
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([w in capital for w in words], pa.bool_()), pa.array([w in small for w in words], pa.bool_())], names=["word", "capital", "small"])


def vocabulary(items: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Names and other words of ``items(text)``, whatever their number: one row a word comes to the driver."""
    used = items.select("text").mapInArrow(_words_used, "word string, capital boolean, small boolean").groupBy("word").agg(F.bool_or("capital").alias("capital"), F.bool_or("small").alias("small"))
    rows = used.select("word", F.expr("capital AND NOT small").alias("name")).toArrow().to_pylist()
    return frozenset(r["word"] for r in rows if r["name"]), frozenset(r["word"] for r in rows if not r["name"])


def _h(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Windows:
    """Template and exact hashes of all word windows of a batch of texts, with a bounded memo of words.

    With ``plain``, the items' words that are no names, words keep their case and a word with a capital is a name too.
    Where such a word is in ``plain`` it may be either: windows holding one are given once in each reading.
    """

    def __init__(self, names: frozenset[str], window: int, plain: frozenset[str] | None = None, items: bool = False) -> None:
        self.names, self.window, self.plain, self.raw = names, window, plain, plain is not None or items
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.exact: list[int] = []
        self.canon: list[int] = []
        self.other: list[int] = []

    def slot(self, word: str, other: bool = False) -> str | None:
        if any(c.isdigit() for c in word):
            return "number"
        low = word.casefold()
        if low in self.names:
            return "name"
        if self.plain is not None and word[0].isupper() and (other or low not in self.plain and low not in UNITS):
            return "name"
        return "unit" if low in UNITS else None

    def _add(self, word: str) -> int:
        n = self.at[word] = len(self.exact)
        self.exact.append(_h(word.casefold()))
        for values, other in ((self.canon, False), (self.other, True)):
            kind = self.slot(word, other)
            values.append(_h("<" + kind + ">") if kind else self.exact[-1])
        return n

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """``(text number, position, template, exact, other reading)`` of each window, and the words of each text."""
        if len(self.exact) > 400_000:
            self._reset()
        words = [passage_words(t, self.raw) for t in texts]
        at, add = self.at, self._add
        ids = np.array([at[w] if w in at else add(w) for ws in words for w in ws], np.int64)
        lengths = np.array([len(ws) for ws in words], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        position = np.arange(len(ids)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths, lengths)
        k = len(ids) - self.window + 1
        if k <= 0:
            e = np.zeros(0, np.int64)
            return e, e, e.view(np.uint64), e.view(np.uint64), e.astype(bool), words
        inside = owner[:k] == owner[self.window - 1 :]
        out = []
        for values in (self.canon, self.exact, self.other) if self.plain is not None else (self.canon, self.exact):
            v, power, total = np.array(values, np.uint64)[ids], 1, np.zeros(k, np.uint64)
            for i in range(self.window):
                total += v[i : i + k] * np.uint64(power)
                power = power * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            out.append(mix(total[inside]))
        who, pos = owner[:k][inside], position[:k][inside]
        if self.plain is None:
            return who, pos, out[0], out[1], np.zeros(len(who), bool), words
        more = np.flatnonzero(out[0] != out[2])
        join = lambda x, y: np.concatenate([x, y[more]])
        return join(who, who), join(pos, pos), join(out[0], out[2]), join(out[1], out[1]), np.arange(len(who) + len(more)) >= len(who), words


_WINDOW_ROWS = "doc long, pos int, template long, exact long, slots array<string>"


def _lengths():
    """How many words each item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(passage_words(t, True)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc"), pa.array(n, pa.int64())], names=["item_id", "n"])

    return run


def _windows(names, window: int, wanted, with_slots: bool, items: bool, forms: bool):
    """Windows with their slots; with ``forms`` a capital inside a sentence of a document makes a name too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, plain = names.value
        windows = Windows(known, window, plain if forms and not items else None, forms)
        table = flags = None
        if wanted is not None:
            table = wanted.value
            flags = np.zeros(1 << 20, bool)
            flags[(table >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            ids, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            for lo in range(0, len(ids), 500):
                who, pos, template, exact, other, words = windows(texts[lo : lo + 500])
                if table is not None:
                    hit = np.flatnonzero(flags[(template >> np.uint64(44)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(table, template[hit]), max(len(table) - 1, 0))
                    hit = hit[table[place] == template[hit]] if len(table) else hit[:0]
                    who, pos, template, exact, other = who[hit], pos[hit], template[hit], exact[hit], other[hit]
                slots = [[w.casefold() for w in words[a][p : p + window] if windows.slot(w, o)] for a, p, o in zip(who.tolist(), pos.tolist(), other.tolist())] if with_slots else [None] * len(who)
                yield pa.record_batch(
                    [pa.array([ids[lo + a] for a in who.tolist()], pa.int64()), pa.array(pos.astype(np.int32)), pa.array(template.view(np.int64)), pa.array(exact.view(np.int64)), pa.array(slots, pa.list_(pa.string()))],
                    names=["doc", "pos", "template", "exact", "slots"],
                )

    return run


def _both(documents: DataFrame, items: DataFrame, window: int, forms: bool) -> tuple[DataFrame, DataFrame, bool]:
    """Windows of documents and of items as ``(doc, pos, template, exact, slots)``, and whether the items' are few."""
    spark = ready(documents.sparkSession)
    held = items.select(F.col("item_id").cast("long").alias("doc"), "text").where("text IS NOT NULL")
    names = spark.sparkContext.broadcast(vocabulary(held))
    item_windows = held.mapInArrow(_windows(names, window, None, True, True, forms), _WINDOW_ROWS)
    small = item_windows.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS
    wanted = None
    if small:
        templates = item_windows.select("template").distinct().toArrow().column("template").to_numpy()
        wanted = spark.sparkContext.broadcast(np.sort(templates.view(np.uint64)))
    picked = documents.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text IS NOT NULL")
    return spread(picked).mapInArrow(_windows(names, window, wanted, True, False, forms), _WINDOW_ROWS), item_windows, small


def template_matches(documents: DataFrame, items: DataFrame, window: int = 12, forms: bool = False) -> DataFrame:
    """``(doc_id, item_id, p, q, ds, hs)``: windows of a document (at word ``p``) and of an item (at ``q``) of one template, with their slots.

    Few item windows (``FILTER_WINDOWS`` at most) are broadcast, so that no document window is shuffled and a template that
    very many windows share, such as one of placeholders alone, is met where it stands. Of more items, equal windows of a
    document are folded first, and adaptive execution splits what is left of a hot template.
    """
    docs, held, small = _both(documents, items, window, forms)
    a = docs.select(F.col("doc").alias("doc_id"), F.col("pos").alias("p"), "template", F.col("slots").alias("ds"))
    b = held.select(F.col("doc").alias("item_id"), F.col("pos").alias("q"), "template", F.col("slots").alias("hs")).distinct()
    return a.join(F.broadcast(b) if small else b, "template")


def verbatim_leaks(documents: DataFrame, items: DataFrame, window: int = 12) -> DataFrame:
    """``(doc_id, item_id, words)``: documents holding ``window`` or more successive words of an item.

    Windows meet by their templates; of these the slots are checked, and only those count in which every slot of the item
    answers to itself. ``words`` is the least number of item words so covered (windows matched + window - 1 if they are one
    run). Null or blank texts and texts shorter than the window hold nothing; repeated rows count once; a null id is kept.
    """
    same = template_matches(documents, items, window).where("ds = hs").select("doc_id", "item_id", F.xxhash64("template", "hs").alias("w")).distinct()
    return same.groupBy("doc_id", "item_id").agg((F.count("*") + window - 1).alias("words"))


def template_leaks(documents: DataFrame, items: DataFrame, window: int = 12, share: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, windows, changed_slots)``: re-parameterised items, the wording kept, the slots changed.

    A document and an item are aligned at one offset; there windows that match by template must cover ``share`` of the item's
    words, each slot of the item answering to a single value of the document (slot consistency) and at least one value
    changed. (Not all of the words: a window in which a word is once a name and once not has no reading that fits.)
    """
    met = template_matches(documents, items, window, True).withColumn("shift", F.col("p") - F.col("q"))
    whole = items.select(F.col("item_id").cast("long").alias("doc"), "text").where("text IS NOT NULL").mapInArrow(_lengths(), "item_id long, n long").groupBy("item_id").agg(F.max("n").alias("n"))
    # At most as many windows as an item has words.
    runs = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("q").alias("qs")).withColumn("windows", F.size("qs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + (window - 1))))))
    runs = runs.join(whole, "item_id").where(covered >= F.lit(share) * F.col("n") - F.lit(1e-9)).select("doc_id", "item_id", "shift", "windows")
    full = met.join(runs, ["doc_id", "item_id", "shift"])
    pairs = full.select("doc_id", "item_id", "shift", "windows", F.explode(F.arrays_zip("hs", "ds")).alias("z"))
    slots = pairs.select("doc_id", "item_id", "shift", "windows", "z.hs", "z.ds").distinct()
    agreed = slots.groupBy("doc_id", "item_id", "shift", "windows").agg(F.count("*").alias("n"), F.countDistinct("hs").alias("h"), F.sum((F.col("hs") != F.col("ds")).cast("long")).alias("changed_slots")).where("n = h AND changed_slots > 0")
    return agreed.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.min("changed_slots").alias("changed_slots"))
