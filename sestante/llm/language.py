"""Language of texts and of their stretches: averaged hashed subword embeddings with a linear softmax.

Every character n-gram of a sentence is hashed to a row of an embedding table; the rows' mean goes through a linear
softmax. Both are trained by stochastic gradient descent in numpy on seed sentences and a bounded sample of labelled
rows (whose labels may be wrong: rows the first fit contradicts are left out of the second). Confidence is
temperature-scaled on held-out sentences, and a sentence under the threshold found there is rejected ("und").
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready, spread
from .sampling import sampled

LANGS = ("it", "en", "de", "fr", "es")
BITS, DIM, ORDERS = 16, 12, (2, 3, 4)
#: Rows of the labelled sample, whatever the table's size.
SAMPLE_ROWS = 1500
#: Words that make a sentence count as evidence of its language.
LEAST_WORDS = 6

# Seed sentences, invented here: they name the languages where labels are few or wrong.
SEEDS = {
    "it": "Il treno per la città parte ogni mattina alle nove e arriva prima di mezzogiorno. Non so se abbiamo ancora del pane, ma possiamo comprarlo dopo il lavoro. La riunione è stata spostata perché il direttore non può venire. Gli studenti che hanno perso la chiave devono chiederne una nuova. Questa sera mangiamo insieme nella sala grande con tutti gli amici. Chi vuole partecipare scriva il proprio nome sul foglio entro venerdì. Le finestre vanno chiuse quando si esce dalla stanza. Per favore, lasciate pulito il tavolo dopo la cena. Dove posso lasciare la valigia? Quando apre il negozio? Come si arriva alla stazione? Quanto costa il biglietto? Chi porta la posta? Si può entrare dopo cena? Posso usare il telefono? C'è un medico? Quali sono i prezzi? A che ora finisce lo spettacolo?",
    "en": "The train to the city leaves every morning at nine and arrives before noon. I do not know whether we still have bread, but we can buy some after work. The meeting was moved because the director cannot come. Students who have lost their key must ask for a new one. Tonight we eat together in the big hall with all our friends. Anyone who wants to join should write their name on the sheet by Friday. The windows have to be shut when you leave the room. Please keep the table clean after dinner. Where can I put my suitcase? When does the shop open? How do I get to the station? How much is a ticket? Who brings the mail? May we enter after dinner? Can I use the phone? Is there a doctor? What are the prices? What time does the show end? How many people can I bring?",
    "de": "Der Zug in die Stadt fährt jeden Morgen um neun ab und kommt vor dem Mittag an. Ich weiß nicht, ob wir noch Brot haben, aber wir können nach der Arbeit welches kaufen. Die Sitzung wurde verschoben, weil der Leiter nicht kommen kann. Wer seinen Schlüssel verloren hat, muss einen neuen beantragen. Heute Abend essen wir zusammen im großen Saal mit allen Freunden. Wer mitmachen will, schreibt seinen Namen bis Freitag auf das Blatt. Die Fenster sind zu schließen, wenn man das Zimmer verlässt. Bitte den Tisch nach dem Essen sauber halten. Wo kann ich den Koffer lassen? Wann öffnet der Laden? Wie komme ich zum Bahnhof? Wie viel kostet die Karte? Wer bringt die Post? Darf man nach dem Essen noch hinein? Kann ich das Telefon benutzen? Gibt es einen Arzt? Welche Preise gelten? Wann endet die Vorstellung?",
    "fr": "Le train pour la ville part chaque matin à neuf heures et arrive avant midi. Je ne sais pas si nous avons encore du pain, mais nous pouvons en acheter après le travail. La réunion a été déplacée parce que le directeur ne peut pas venir. Les étudiants qui ont perdu leur clé doivent en demander une nouvelle. Ce soir nous mangeons ensemble dans la grande salle avec tous les amis. Ceux qui veulent participer écrivent leur nom sur la feuille avant vendredi. Les fenêtres doivent être fermées quand on quitte la chambre. Merci de laisser la table propre après le dîner. Où puis-je laisser ma valise ? Quand ouvre le magasin ? Comment aller à la gare ? Combien coûte le billet ? Qui apporte le courrier ? Peut-on entrer après le dîner ? Puis-je utiliser le téléphone ? Y a-t-il un médecin ? Quels sont les prix ? À quelle heure finit le spectacle ?",
    "es": "El tren a la ciudad sale cada mañana a las nueve y llega antes del mediodía. No sé si todavía tenemos pan, pero podemos comprarlo después del trabajo. La reunión se ha cambiado porque el director no puede venir. Los estudiantes que han perdido la llave deben pedir una nueva. Esta noche cenamos juntos en el salón grande con todos los amigos. Quien quiera participar escriba su nombre en la hoja antes del viernes. Las ventanas se cierran cuando se sale de la habitación. Por favor, dejen limpia la mesa después de la cena. ¿Dónde puedo dejar la maleta? ¿Cuándo abre la tienda? ¿Cómo se llega a la estación? ¿Cuánto cuesta el billete? ¿Quién trae el correo? ¿Se puede entrar después de cenar? ¿Puedo usar el teléfono? ¿Hay un médico? ¿Cuáles son los precios? ¿A qué hora termina la función?",
}

# A day's number with its full stop before a month ("10. November") ends no sentence.
_MONTH = "Januar|Jänner|Februar|März|Maerz|Marz|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SENTENCE = re.compile(rf"(?:(?<=[!?…])|(?<=\D\.)|(?<=\d\.)(?!\s+(?:{_MONTH}|bis|und)\b))[\"”»)\]*_]*\s+|\n+|\s[|•]\s", re.I)
_QUOTED = re.compile(r"«[^»\n]{1,160}»|“[^”\n]{1,160}”|\"[^\"\n]{1,160}\"|„[^“”\n]{1,160}[“”]")
_WORD = re.compile(r"(?<![\d\w])[^\W\d_]+(?![\d_])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüý", "aaaaaaceeeeiiiinooooouuuuy")


def sentences(text: str | None) -> list[tuple[int, int, str, int]]:
    """``(start, end, cleaned, words)`` of each sentence; headings and quoted terms are cleaned away."""
    text = text or ""
    out, at = [], 0
    lines_end = text.find("\n")
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = text[at:end]
        if raw.strip():
            clean = _QUOTED.sub(" ", _INVISIBLE.sub("", raw))
            heading = " > " in raw or (at == 0 and 0 < lines_end == end and not raw.rstrip().endswith((".", "!", "?", "…", ";", ":")) and len(raw) <= 80) or raw.lstrip().startswith("#")
            if _SPACED.search(clean):
                clean = _SPACED.sub(lambda s: s.group().replace(" ", ""), clean)
            words = 0 if heading else len(_WORD.findall(clean))
            out.append((at, end, clean.lower(), words))
        at = m.end() if m else end
    return out


_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def ngram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all texts and, per n-gram, the text it belongs to (both sorted by text)."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = _LETTER[np.minimum(cp, len(_LETTER) - 1)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp, owner = np.where(letter, cp, np.uint32(32))[keep], owner[keep]
    rows, owners = [], []
    for n in ORDERS:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n * 7919, np.uint32)
        for i in range(n):
            h = (h ^ cp[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = owner[: len(h)] == owner[n - 1 :]
        rows.append((h >> np.uint32(32 - BITS))[inside])
        owners.append(owner[: len(h)][inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


@dataclass
class LanguageModel:
    """Embedding table times softmax matrix, folded: one row of logits per n-gram slot."""

    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, one row per text; even ones where a text has no letters."""
        out = np.zeros((len(texts), len(LANGS)), np.float32)
        for lo in range(0, len(texts), 400):
            part = texts[lo : lo + 400]
            rows, owner = ngram_rows(part)
            n = np.bincount(owner, minlength=len(part)).astype(np.float32)
            for c in range(len(LANGS)):
                out[lo : lo + len(part), c] = np.bincount(owner, self.logits[c][rows], len(part)) / np.maximum(n, 1)
            out[lo : lo + len(part)] += self.bias * (n > 0)[:, None]
        z = out / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _sgd(texts: list[str], labels: np.ndarray, epochs: int, seed: int = 7, lr: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, len(LANGS))).astype(np.float32)
    bias = np.zeros(len(LANGS), np.float32)
    rows, owner = ngram_rows(texts)
    order = np.argsort(owner, kind="stable")
    rows, ends = rows[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    for epoch in range(epochs):
        step = lr * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 48)):
            batch = batch[ends[batch + 1] > ends[batch]]
            if not len(batch):
                continue
            picked = [rows[ends[b] : ends[b + 1]] for b in batch]
            sizes = np.array([len(p) for p in picked])
            flat, at = np.concatenate(picked), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(table[flat], at) / sizes[:, None]
            z = hidden @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            back = p @ weight.T
            weight -= step * hidden.T @ p / len(batch)
            bias -= 0.1 * step * p.mean(0)
            slots, inverse = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, np.repeat(back[:, k] / sizes, sizes), len(slots)) for k in range(DIM)], 1)
            table[slots] -= (20 * step * grad).astype(np.float32)
    return table, weight, bias


def fit_language(labelled: list[tuple[str, str]], seed: int = 7, certain: list[tuple[str, str]] = ()) -> LanguageModel:
    """Train on ``(text, language)`` rows and the seeds; wrong labels are tolerated if they are the minority.

    ``certain`` rows are short texts whose language is known; they join the seeds.
    """
    texts, labels, trusted = [], [], []
    for text, lang in certain:
        for form in {text.lower(), text.lower().translate(_ACCENTS)}:
            texts.append(form)
            labels.append(LANGS.index(lang))
            trusted.append(True)
    for k, lang in enumerate(LANGS):
        for s in sentences(SEEDS[lang]):
            for form in {s[2], s[2].translate(_ACCENTS)}:
                texts.append(form)
                labels.append(k)
                trusted.append(True)
    for text, lang in labelled:
        for _, _, s, n in sentences(text):
            if n >= 4:
                texts.append(s)
                labels.append(LANGS.index(lang))
                trusted.append(False)
    y, sure = np.array(labels), np.array(trusted)
    rng = np.random.default_rng(seed)
    first = LanguageModel(*_fold(*_sgd(texts[: sure.sum()], y[sure], 30, seed)), 1.0, 0.0)
    if not sure.all():
        p = first.scores(texts)
        # A labelled sentence stays only where the seeds' fit does not clearly contradict it.
        keep = sure | (p.argmax(1) == y) | (p[np.arange(len(y)), y] > 0.5 * p.max(1))
        held = ~sure & keep & (rng.random(len(y)) < 0.15)
        train = np.flatnonzero(keep & ~held)
        # A third of the accented sentences come a second time without accents.
        more = [i for i in train if texts[i] != texts[i].translate(_ACCENTS)][::3]
        fit_texts = [texts[i] for i in train] + [texts[i].translate(_ACCENTS) for i in more]
        fit_y = np.concatenate([y[train], y[more]]) if more else y[train]
        folded = _fold(*_sgd(fit_texts, fit_y, 4, seed))
        test = np.flatnonzero(held)
    else:
        folded, test = _fold(*_sgd(texts, y, 30, seed)), np.arange(len(y))
    return _calibrate(folded, [texts[i] for i in test], y[test])


def _fold(table: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray((table @ weight).T), bias


def _calibrate(folded: tuple[np.ndarray, np.ndarray], texts: list[str], y: np.ndarray) -> LanguageModel:
    """Temperature with the least held-out loss, then the least threshold under which errors would pass."""
    best, model = None, None
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        m = LanguageModel(*folded, t, 0.5)
        if not len(texts):
            return m
        p = m.scores(texts)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-6)).mean()
        if best is None or loss < best:
            best, model = loss, m
    p = model.scores(texts)
    wrong = p.max(1)[p.argmax(1) != y]
    # Held-out labels are partly wrong themselves, so sure "errors" say nothing about the threshold.
    model.threshold = float(np.clip(np.quantile(wrong, 0.9) if len(wrong) >= 5 else 0.6, 0.55, 0.75))
    return model


def named_language(label):
    """The two-letter code a label names (any case, blanks or region suffix around it), else null."""
    code = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " "))), r"^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1)
    return F.when(code.isin(*LANGS), code)


def labelled_sample(rows: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``sample_rows`` rows whose label names a language, picked by a hash of the id."""
    sample = rows.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), named_language(F.col(label_col)).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    got = sampled(sample, sample_rows, "i", "t").collect()
    return [(r["t"], r["l"]) for r in got]


def trained(rows: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the seeds and the labelled sample."""
    return fit_language(labelled_sample(rows, id_col, text_col, label_col, sample_rows))


def _segments(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for batch in batches:
            ids, labels, texts = (batch.column(c).to_pylist() for c in ("id", "label", "text"))
            parts = [sentences(t) for t in texts]
            flat = [s for p in parts for s in p]
            scores = m.scores([s[2] for s in flat]) if flat else np.zeros((0, len(LANGS)))
            which, sure = scores.argmax(1), scores.max(1) if len(flat) else np.zeros(0)
            cols: list[list] = [[] for _ in range(8)]
            at = 0
            for i, label, p in zip(ids, labels, parts):
                runs: list[list] = []
                for start, end, _, words in p:
                    proof = words >= LEAST_WORDS and sure[at] >= m.threshold
                    lang = LANGS[which[at]] if proof else None
                    if runs and (lang is None or runs[-1][2] is None or runs[-1][2] == lang):
                        r = runs[-1]
                        r[1], r[2] = end, r[2] or lang
                    else:
                        r = [start, end, lang, 0.0, 0]
                        runs.append(r)
                    if proof:
                        r[3] += float(sure[at]) * words
                        r[4] += words
                    at += 1
                for n, (start, end, lang, weight, words) in enumerate(runs or [[0, 0, None, 0.0, 0]]):
                    for c, v in zip(cols, (i, label, n + 1, start, end, lang or "und", round(weight / words, 4) if words else 0.0, words)):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()))], names=["chunk_id", "label", "segment", "start", "end", "lang", "confidence", "words"])

    return run


def language_segments(rows: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """One row per stretch of one language of every row: ``(chunk_id, label, segment, start, end, lang, confidence, words)``.

    ``lang`` is ``und`` with confidence 0 where no sentence of six or more words passes the rejection (figures,
    codes, headings, blanks, null). ``confidence`` is the mean over the stretch, weighted by words. Repeated rows
    (same id, text and label) count once; a null id stays null. Only the stretches are shuffled, to fold repeats.
    """
    spark = ready(rows.sparkSession)
    model = model or trained(rows, id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(model)
    picked = rows.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    # Repeated rows have equal stretches: these are folded, so that no text is shuffled.
    found = spread(picked).mapInArrow(_segments(shared), "chunk_id string, label string, segment int, start int, end int, lang string, confidence double, words int")
    return found.dropDuplicates()


def language_labels(segments: DataFrame) -> DataFrame:
    """One row per chunk and language of its text, with the share of words and the case test of the label."""
    known = segments.where("lang <> 'und'")
    per = known.groupBy("chunk_id", "label", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    whole = per.groupBy("chunk_id", "label").agg(F.collect_set(F.struct("lang", "words", "confidence")).alias("all"))  # five languages at most
    named = named_language(F.col("label"))
    names = F.transform("all", lambda s: s["lang"])
    out = whole.withColumn("languages", F.size("all")).withColumn("is_case", (F.size("all") > 1) | named.isNull() | ~F.array_contains(names, F.coalesce(named, F.lit("")))).withColumn("s", F.explode("all"))
    return out.select("chunk_id", "label", F.col("s.lang").alias("lang"), F.col("s.words").alias("words"), F.round("s.confidence", 4).alias("confidence"), "languages", "is_case")
