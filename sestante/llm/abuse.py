"""Abusive, hateful or sexual language: a counterfactual-regularised linear classifier over words and word pairs.

Every word weighs the mean of hashed features (the word, its character n-grams), every pair of neighbours one more.
Weights are fitted by stochastic gradient descent on labelled sentences. For each of them that names a group of
people, a twin with another group is made, and the squared difference of the two scores is a penalty beside the
loss, so that the mention of a group by itself moves no score. A text's score is that of its worst run of words.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready, spread
from .abuse_seeds import GROUPS, NEGATIVE, POSITIVE
from .language import SEEDS
from .sampling import sampled

BITS = 17
#: Words of the longest run that is scored by itself.
RUN = 12
#: Labelled documents of either label used at most, whatever the size of the tables.
SAMPLE_DOCS = 2500
#: Slots of the table of pairs of words: fixed size, whatever the corpus.
PAIR_BITS = 18
#: Mean log-ratio of a sentence's pairs, texts of its label to harmless ones, from which it may be what its text was labelled for.
TELLS = 1.5
#: Runs of words of those documents used at most.
SAMPLE_RUNS = 25_000
#: Sentences drawn from each seed.
DRAWS = 24
THRESHOLD = 0.95

#: Look-alike letters of other alphabets, and signs read as letters inside words.
_ALIKE = str.maketrans("аеорсухіѕјԁһкмтвнɡαοεικνρτυЅАЕОРСХІКМТВН", "aeopcyxisjdhkmtbhgaoeiknptusaeopcxikmtbh")
_SIGNS = str.maketrans("0134578@$!", "oieastbasi")
_SIGNS_L = str.maketrans("0134578@$!", "oleastbasl")
_MARK = re.compile("[̀-ͯ­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$!]*[^\W_])?|[.!?…]+(?=\s|$)|\n")
_END = re.compile(r"[.!?…\n]")


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def folded(text: str) -> str:
    """Lower case without accents, invisible characters, foreign look-alikes and blanks between letters."""
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text)).translate(_ALIKE)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text)
    return text


def plain_word(word: str, known=frozenset()) -> str:
    """The word behind signs for letters and stretched letters; a masked word (c***e) stays as it is."""
    if "*" in word:
        return word
    w = re.sub(r"(.)\1{2,}", r"\1", word)
    if w not in known and w != word and (twice := re.sub(r"(.)\1{2,}", r"\1\1", word)) in known:
        w = twice
    if not w.isalpha() and any(c.isalpha() for c in w):
        for table in (_SIGNS, _SIGNS_L):
            if (v := w.translate(table)).isalpha() and v in known:
                return v
        v = w.translate(_SIGNS)
        if v.isalpha() and sum(c.isalpha() for c in w) > 1 and w[0].isalpha() and w[-1:].isalnum() and re.search(r"[^\W\d_][\d@$!]+[^\W\d_]", w):
            return v
    return w


def features(word: str) -> np.ndarray:
    """Rows of the weight table that a word averages over."""
    p = f"^{word}$"
    grams = [p[i : i + n] for n in (4, 5) for i in range(len(p) - n + 1)]
    return np.array([_digest("w " + word), _digest("w2 " + word), _digest("w3 " + word), *(_digest("g " + g) for g in grams)], np.uint64) >> np.uint64(64 - BITS)


class AbuseModel:
    """Weight table, the vocabulary of the training sentences, and a bounded memo of words."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, bias: float, known: frozenset[str], abusive: tuple[str, ...]) -> None:
        self.weights, self.pairs, self.bias, self.known, self.abusive = weights, pairs, bias, known, abusive
        self._reset()

    def __getstate__(self) -> tuple:
        return self.weights, self.pairs, self.bias, self.known, self.abusive

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.value: list[float] = []
        self.key: list[int] = []

    def _add(self, word: str) -> int:
        n = self.at[word] = len(self.value)
        if _END.match(word):
            self.value.append(np.nan)
            self.key.append(0)
            return n
        w = plain_word(word, self.known)
        if "*" in w:
            # A masked word counts as the most abusive training word that fits the mask.
            fits = re.compile("".join("." if c == "*" else re.escape(c) for c in w))
            fitting = [x for x in self.abusive if fits.fullmatch(x)]
            w = max(fitting, key=lambda x: self.weights[features(x).astype(np.int64)].mean(), default="****" if w.count("*") > 2 else w.replace("*", ""))
        self.value.append(float(self.weights[features(w).astype(np.int64)].mean()))
        self.key.append(_digest(w))
        return n

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The highest probability of any run of words of each text; 0 for texts without words."""
        if len(self.value) > 300_000:
            self._reset()
        tokens = [_TOKEN.findall(folded(t)) if t else [] for t in texts]
        at, add = self.at, self._add
        ids = np.array([at[w] if w in at else add(w) for ws in tokens for w in [*ws, "\n"]], np.int64)
        lengths = np.array([len(ws) + 1 for ws in tokens], np.int64)
        v = np.array(self.value)[ids]
        k = np.array(self.key, np.uint64)[ids]
        ends = np.isnan(v)
        pair = np.zeros(len(v))
        if len(v) > 1:
            both = ~ends[1:] & ~ends[:-1]
            h = (k[:-1] * np.uint64(0x9E3779B97F4A7C15) + k[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
            pair[1:] = np.where(both, self.pairs[h.astype(np.int64)], 0)
        v = np.where(ends, 0, v)
        words, links = np.cumsum(v), np.cumsum(pair)
        index = np.arange(len(v))
        start = np.maximum.accumulate(np.where(ends, index, -1))
        low = np.maximum(start, index - RUN)
        z = words - np.where(low >= 0, words[low], 0) + links - np.where(low + 1 <= index, links[np.minimum(low + 1, index)], 0)
        # A run is scored where it is full or where its sentence ends.
        whole = (index - start >= RUN) | np.append(ends[1:], True)
        z = np.where(ends | ~whole, -30.0, z + self.bias)
        top = np.maximum.reduceat(z, np.concatenate([[0], np.cumsum(lengths)[:-1]])) if len(lengths) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def _expand(seed: str, groups: list[str], rng: random.Random, group: str | None = None) -> tuple[str, str | None]:
    while m := re.search(r"\{([^{}]*)\}", seed):
        seed = seed[: m.start()] + rng.choice(m.group(1).split("|")) + seed[m.end() :]
    if "<G>" in seed:
        group = group or rng.choice(groups)
        return seed.replace("<G>", group), group
    return seed, None


def _words(sentence: str, known=frozenset()) -> list[str]:
    return [plain_word(w, known) for w in _TOKEN.findall(folded(sentence)) if not _END.match(w)]


def seed_sentences(rng: random.Random, draws: int = DRAWS) -> list[tuple[list[str], int, list[str] | None]]:
    """``(words, label, words of the twin with another group)``."""
    out = []
    for seeds, label in ((POSITIVE, 1), (NEGATIVE, 0)):
        for lang, rows in seeds.items():
            groups = GROUPS[lang].split("|")
            for row in rows:
                for _ in range(draws):
                    state = rng.getstate()
                    sentence, group = _expand(row, groups, rng)
                    twin = None
                    if group:
                        after = rng.getstate()
                        rng.setstate(state)
                        twin = _words(_expand(row, groups, rng, groups[(groups.index(group) + 1 + rng.randrange(len(groups) - 1)) % len(groups)])[0])
                        rng.setstate(after)
                    out.append((_words(sentence), label, twin))
    return out


def _harmless_runs(texts: tuple[str, ...], rng: random.Random) -> list[tuple[list[str], int, None]]:
    rows, seen = [], set()
    for text in texts:
        run: list[str] = []
        for w in [*_TOKEN.findall(folded(text)), "\n"]:
            if _END.match(w) or len(run) == RUN:
                # Equal wordings but for figures teach nothing new.
                shape = " ".join(run[-3:])
                if len(run) > 2 and shape not in seen:
                    seen.add(shape)
                    rows.append(([plain_word(x) for x in run], 0, None))
                run = [] if _END.match(w) else run[RUN // 3 :]
            if not _END.match(w):
                run.append(w)
    return rows


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for w in _TOKEN.findall(folded(text)):
        if _END.match(w):
            out.append([])
        else:
            out[-1].append("0" if w[0].isdigit() else plain_word(w))
    return [s for s in out if len(s) > 2]


def _pair_slots(words: list[str]) -> list[int]:
    return [zlib.crc32((a + " " + b).encode("utf-8", "surrogatepass")) >> (32 - PAIR_BITS) for a, b in zip(words, words[1:])]


def pair_counts(texts: list[str | None]) -> np.ndarray:
    """How many of the texts hold each pair of neighbouring words (in a table of fixed size)."""
    total = np.zeros(1 << PAIR_BITS, np.int64)
    for t in texts:
        slots = {x for s in _sentences(t or "") for x in _pair_slots(s)}
        total[np.fromiter(slots, np.int64, len(slots))] += 1
    return total


def telling_sentences(abusive: list[str], harmless: list[str], model: "AbuseModel") -> list[list[str]]:
    """The sentence of each abusive text that speaks most for its label.

    A label belongs to a whole text, of which most is harmless. What tells is that a sentence's pairs of words are more
    frequent among the texts of its label than among the harmless ones, and what the seeds' fit makes of it. A text whose best
    sentence says neither is taken for wrongly labelled and gives none.
    """
    own = pair_counts(abusive)
    ratio = np.log((own + 0.2) / (len(abusive) + 0.4)) - np.log((pair_counts(harmless) + 0.2) / (len(harmless) + 0.4))
    out = []
    for t in abusive:
        doc = _sentences(t)
        if not doc:
            continue
        seeds = model([" ".join(s) for s in doc])
        tells = np.array([ratio[_pair_slots(s)].mean() for s in doc])
        both = tells + 2 * np.log(np.maximum(seeds, 0.01) / 0.1)
        best = int(both.argmax())
        if tells[best] > TELLS:
            out.append(doc[best])
    return out


def fit_abuse(harmless: tuple[str, ...] = (), abusive: tuple[str, ...] = (), seed: int = 11) -> AbuseModel:
    """Fit on the seeds, on the sentences of ``harmless`` texts (label 0) and on the telling one of each ``abusive`` text.

    Reviewers overlook things: runs of words of harmless texts that
    the first fit finds abusive all the same are left out of the second, unless several texts hold them.
    """
    rng = random.Random(seed)
    rows = seed_sentences(rng)
    plain = _harmless_runs(tuple(SEEDS.values()), rng) * 8
    runs = _harmless_runs(harmless, rng)
    rng.shuffle(runs)
    runs = runs[:SAMPLE_RUNS]
    model = _fit(rows + plain + runs, random.Random(seed))
    if not runs and not abusive:
        return model
    # What several harmless texts say was not overlooked.
    held = pair_counts(list(harmless))
    common = [len(r[0]) > 1 and held[_pair_slots(["0" if w[0].isdigit() else w for w in r[0]])].mean() >= 4 for r in runs]
    for _ in range(2):
        told = [(w, 1, None) for w in telling_sentences(list(abusive), list(harmless), model)] * 6
        score = model([" ".join(r[0]) for r in runs]) if runs else []
        kept = [r for r, usual, p in zip(runs, common, score) if usual or p < 0.6]
        # Harmless wordings that look abusive so far count several times.
        kept += [r for r, usual, p in zip(runs, common, score) if usual and p > 0.2] * 8
        model = _fit(rows + plain + kept + told, random.Random(seed))
    return model


def _fit(rows: list, rng: random.Random, epochs: int = 12, penalty: float = 0.5) -> AbuseModel:
    rows = [r for r in rows if r[0]]
    # The bias stays: words never seen in training speak for a harmless text.
    weights, pairs, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), -3.5
    memo: dict[str, np.ndarray] = {}

    def active(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = [memo[w] if w in memo else memo.setdefault(w, features(w).astype(np.int64)) for w in words]
        k = np.array([_digest(w) for w in words], np.uint64)
        h = (k[:-1] * np.uint64(0x9E3779B97F4A7C15) + k[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
        return np.concatenate(f), np.concatenate([np.full(len(x), 1 / len(x)) for x in f]), h.astype(np.int64)

    data = [(active(w), y, active(t) if t else None) for w, y, t in rows]
    order = list(range(len(data)))
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = 0.8 * (1 - epoch / epochs) + 0.05
        for n in order:
            (a, c, p), y, twin = data[n]
            z = bias + weights[a] @ c + pairs[p].sum()
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            if abs(g) < 0.02 and twin is None:
                continue
            steps = [(a, c, p, g)]
            if twin is not None:
                # The twin shares the label, and the difference of the two scores is pulled to nought.
                a2, c2, p2 = twin
                z2 = bias + weights[a2] @ c2 + pairs[p2].sum()
                d = float(np.clip(penalty * (z - z2), -1, 1))
                steps = [(a, c, p, 0.5 * g + d), (a2, c2, p2, 0.5 * (1 / (1 + np.exp(-np.clip(z2, -30, 30))) - y) - d)]
            for f, w, q, s in steps:
                np.add.at(weights, f, -6 * rate * s * w)
                pairs[q] -= 0.3 * rate * s
        weights *= 0.99
    known = frozenset(w for r in rows for w in r[0] if len(w) > 2)
    abusive = tuple(sorted({w for r in rows if r[1] for w in r[0] if len(w) > 2}))
    return AbuseModel(weights, pairs, float(bias), known, abusive)


def trained(documents: DataFrame, labels: DataFrame | None, sample_docs: int = SAMPLE_DOCS) -> AbuseModel:
    """Fit on the seeds and on documents with reviewers' labels, whole texts, at most ``sample_docs`` of either label (by a hash of the id).

    Documents whose reviewers disagree are left out.
    """
    if labels is None:
        return fit_abuse()
    agreed = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("toxic").alias("u")).where("t = u")
    picked = sampled(agreed.where("t = 0").select("doc_id", "t"), sample_docs, "doc_id").union(sampled(agreed.where("t = 1").select("doc_id", "t"), sample_docs, "doc_id"))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL").select("t", "text").distinct().collect()
    harmless, abusive = (tuple(sorted(r["text"] for r in rows if r["t"] == t)) for t in (0, 1))
    return fit_abuse(harmless, abusive)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: AbuseModel = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [m(texts[lo : lo + 400]) for lo in range(0, len(texts), 400)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "source", "score"])

    return run


def abuse_scores(documents: DataFrame, labels: DataFrame | None = None, model: AbuseModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, source, score, abusive)``: the score of each document's worst run of words.

    Null, empty and wordless texts score 0. Every row is scored, repeated ones too; null ids and sources are kept.
    No shuffle at all.
    """
    spark = ready(documents.sparkSession)
    shared = spark.sparkContext.broadcast(model or trained(documents, labels))
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    scored = spread(picked).mapInArrow(_scored(shared), "doc_id long, source string, score double")
    return scored.withColumn("abusive", F.col("score") >= threshold)


def abuse_rates(scores: DataFrame) -> DataFrame:
    """Per source: documents, abusive ones and their share; a source is combined map-side, however large."""
    rows = scores.select("doc_id", "source", "abusive").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("abusive").cast("long")).alias("abusive_documents"))
    return rows.withColumn("share", F.col("abusive_documents") / F.col("documents"))
