"""Defective replies: a conditional random field over the clauses of each reply.

Clauses are tagged answer, refusal, echo, foreign, unfinished or void from features of their wording, their likeness to
the question, their language and the way they end; the chain's transition weights carry what one clause says about the
next. The tags' coverage of the reply then gives its single defect. The field is trained at run time, by gradient
ascent on the likelihood, on replies of a bounded sample of rows with a ``refused`` flag (true and false) that are taken
as they are, cut, echoed or swapped between languages, so that every clause has a known tag. Wrong flags are outvoted
by the other rows that share their words.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ready, spread
from .language import LANGS, LanguageModel, fit_language
from .sampling import sampled

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "void")
A, R, E, X, U, V = range(6)
#: Coverage from which a tag makes a defect, where no rows are there to fit it on.
LEAST = {R: 0.5, E: 0.6, X: 0.5, U: 0.5, V: 0.5}
#: Rows with the refused flag, and as many without it, from which training replies are made.
SAMPLE_ROWS = 1000
#: Slots of the table of clause endings: fixed size, whatever the corpus.
ENDING_BITS = 18

_FOOTER = re.compile(r"(?:\s*\n|^)\s*__[^\n]*(?:__)?\s*$")
_CITATION = re.compile(r"\[[^\[\]\n]*#[^\[\]\n]*\]")
_OPEN = re.compile(r"\[[^\[\]\n]{0,80}$")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"<[^<>\n]{0,20}>")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"»”)]*\s+(?=[^\sa-z])|\n+")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…][\"'»”)*\]]*$")

#: Fillers that stand for no value, in lower case without punctuation around them.
FILLERS = frozenset({"", "null", "none", "nan", "n/d", "n/a", "nd", "na", "nil", "undefined", "todo", "tbd", "br", "empty", "vuoto", "keine angabe", "k.a", "s/d", "s.o", "n.d", "n.a", "<na>"})
#: How a question asks for a language.
_WANTS = {
    "it": re.compile(r"\b(?:italian[oa]?|italienisch|italien|italiano)\b", re.I),
    "en": re.compile(r"\b(?:inglese|english|englisch|anglais|inglés|ingles)\b", re.I),
    "de": re.compile(r"\b(?:tedesco|german|deutsch|allemand|alemán|aleman)\b", re.I),
    "fr": re.compile(r"\b(?:francese|french|französisch|français|francais|francés|frances)\b", re.I),
    "es": re.compile(r"\b(?:spagnolo|spanish|spanisch|espagnol|español|espanol|castellano)\b", re.I),
}

# Seed refusals, written for this module; the corpus' own wordings are learnt from rows with a ``refused`` flag.
REFUSALS = {
    "it": "Non sono in grado di aiutarla con ciò.|Su questo non ho notizie, mi perdoni.|Non mi è concesso discuterne.|Rifiuto di commentare.|La cosa va oltre le mie possibilità.|Nessuna delle mie schede ne fa cenno.|Ignoro la risposta, mi scuso.|NON_TROVATO|Non trovato.",
    "en": "I'm not in a position to help here.|No answer is available to me, my apologies.|I must decline to comment on that.|Discussing it is beyond my remit.|None of my records mentions it.|I don't know, regrettably.|I won't be able to assist you with that one.|NON_TROVATO",
    "de": "Dabei kann ich Ihnen nicht helfen.|Mir liegt keine Antwort vor, ich bedaure.|Das fällt nicht in meine Zuständigkeit.|Ich lehne es ab, mich hierzu zu äußern.|In keiner meiner Akten steht etwas davon.|Keine Ahnung, bedaure.|NON_TROVATO",
    "fr": "Je ne suis pas en mesure de vous aider ici.|Aucune réponse à vous donner, navré.|Cela dépasse mes attributions.|Je refuse de commenter.|Aucune de mes fiches n'en fait mention.|Je l'ignore, hélas.|NON_TROVATO",
    "es": "No estoy en condiciones de ayudarle.|Carezco de respuesta, disculpe.|Eso excede mis funciones.|Me niego a comentarlo.|Ninguna de mis fichas lo menciona.|Lo ignoro, lamentablemente.|NON_TROVATO",
}
APOLOGIES = {
    "it": "Chiedo scusa per il tempo trascorso.|Eccomi, perdoni l'indugio.|Grazie di avermi scritto.",
    "en": "Apologies that this took a while.|Pardon my slow reply.|Good of you to ask.",
    "de": "Verzeihen Sie die späte Antwort.|Schön, dass Sie fragen.",
    "fr": "Pardon d'avoir tardé.|C'est gentil de demander.",
    "es": "Disculpe la tardanza.|Qué bien que pregunte.",
}
#: Words after which a sentence must go on.
OPEN_ENDS = {"it": "perché|ma se|e anche|entro il|che|oppure|con la", "en": "because|but if|and also|by the|which|or with", "de": "weil|aber wenn|und auch|bis zum|oder mit", "fr": "parce que|mais si|et aussi|avant le|ou avec", "es": "porque|pero si|y también|antes del|o con"}
ECHOES = {
    "it": "{}|La sua domanda è: «{}»|Ha chiesto: {}|Lei chiede: {}|Domanda: {}|Vuole sapere: {}",
    "en": "{}|Your question is: \"{}\"|You asked: {}|You are asking: {}|Question: {}|You want to know: {}",
    "de": "{}|Ihre Frage lautet: „{}“|Sie fragen: {}|Gefragt wurde: {}|Frage: {}",
    "fr": "{}|Votre question est : « {} »|Vous demandez : {}|Vous avez demandé : {}|Question : {}",
    "es": "{}|Su pregunta es: «{}»|Usted pregunta: {}|Ha preguntado: {}|Pregunta: {}",
}


def body_of(text: str | None) -> str:
    """The reply without footer, citations, tags and invisible characters."""
    t = _FOOTER.sub("", text or "")
    return _CITATION.sub(" ", _TAG.sub(" ", _INVISIBLE.sub("", t))).strip().replace(" .", ".")


def is_empty(body: str) -> bool:
    return body.strip(" \t\r\n.-–—_…*\"'«»()[]|/\\:;, ").lower() in FILLERS


def clauses(body: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(body)) if _WORD.search(c)]


def _shape(word: str) -> str:
    return re.sub(r"\d+", "0", word.lower())


def _slot(words: list[str]) -> int:
    return zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")) >> (32 - ENDING_BITS)


def _endings(columns: tuple[str, ...]):
    """Of each pair of words: how often it stands before a full stop, and how often at all (in a table of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed, every = np.zeros(1 << ENDING_BITS, np.int64), np.zeros(1 << ENDING_BITS, np.int64)
        token = re.compile(r"[^\W_]+|[.!?…\n]")
        memo: dict[tuple[str, str], int] = {}
        for batch in batches:
            for c in columns:
                for text in batch.column(c).to_pylist():
                    if not text:
                        continue
                    before, last = "", ""
                    for t in token.findall(re.sub(r"\d+(?:[:.,]\d+)*", "0", _CITATION.sub("", text).lower())):
                        if t in ".!?…\n":
                            if last:
                                closed[s] += 1
                            before = last = ""
                            continue
                        before, last = last, t
                        key = (before, last)
                        s = memo.get(key)
                        if s is None:
                            if len(memo) > 300_000:
                                memo.clear()
                            s = memo[key] = _slot([before, last])
                        every[s] += 1
        at = np.flatnonzero(every)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(closed[at]), pa.array(every[at])], names=["slot", "closed", "every"])

    return run


def ending_table(rows: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Share of each pair of words that closes a clause, over all rows; -1 where the pair never occurs."""
    got = spread(rows.select(*columns)).mapInArrow(_endings(columns), "slot int, closed long, every long").groupBy("slot").agg(F.sum("closed").alias("closed"), F.sum("every").alias("every")).toArrow()
    table = np.full(1 << ENDING_BITS, -1.0, np.float32)
    table[got.column("slot").to_numpy()] = got.column("closed").to_numpy() / np.maximum(got.column("every").to_numpy(), 1)
    return table


#: Slots of the lexical weights of the refusal tag.
LEXICON_BITS = 14
N_FEATURES = 24


def lexical(clause: str) -> np.ndarray:
    """Slots of the words and pairs of words of a clause, figures folded."""
    words = _WORD.findall(re.sub(r"\d+(?:[:.,]\d+)*", "0", clause.lower()))
    pairs = [a + " " + b for a, b in zip(["^", *words], [*words, "$"])]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) >> (32 - LEXICON_BITS) for g in [*words, *pairs]], np.int64)


def describe(question: str | None, text: str | None, cited: bool, endings: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Clauses of the reply and their features but for those of the language; a reply without words is one void clause."""
    t = _FOOTER.sub("", text or "")
    body = body_of(text)
    parts = [] if is_empty(body) else clauses(body)
    f = np.zeros((max(len(parts), 1), N_FEATURES), np.float32)
    if not parts:
        f[0, :2] = 1
        return [""], f
    asked = [w.lower() for w in _WORD.findall(question or "")]
    asked_set = set(asked)
    broken = bool(_OPEN.search(t.rstrip())) or body.rstrip().endswith(("(", "[", ",", ":", "-", "«", "/"))
    told = [[w.lower() for w in _WORD.findall(c)] for c in parts]
    every = [w for ws in told for w in ws]
    share_in = sum(w in asked_set for w in every) / len(every)
    for n, (c, words) in enumerate(zip(parts, told)):
        last, bullet = n == len(parts) - 1, bool(_BULLET.match(c))
        done = bool(_END.search(c))
        inside = sum(w in asked_set for w in words) / len(words)
        covered = len(asked_set) > 0 and len(asked_set & set(words)) / len(asked_set) > 0.7
        new = len([w for w in words if w not in asked_set and len(w) > 3])
        f[n, 0] = 1
        f[n, 2] = inside
        f[n, 3] = inside > 0.8
        f[n, 4] = covered
        f[n, 5] = new <= 3 and (covered or inside > 0.6)
        f[n, 6] = min(len(words), 30) / 30
        f[n, 7] = len(words) <= 4
        f[n, 8] = n == 0
        f[n, 9] = last
        f[n, 10] = share_in > 0.7
        f[n, 11] = not cited
        f[n, 12] = done and c.rstrip("\"»”’) ").endswith("?")
        if last:
            end = re.sub(r"\d+(?:[:.,]\d+)*", "0", c.lower())
            tail = _WORD.findall(end)[-2:]
            share = endings[_slot(tail if len(tail) == 2 else ["", *tail])]
            # How the reply ends where no full stop does it.
            f[n, 13] = not done and not bullet
            f[n, 14] = not done and bullet
            f[n, 15] = broken
            f[n, 16] = not done and share < 0.02
            f[n, 17] = not done and share >= 0.02
            f[n, 18] = not done and share > 0.25
            f[n, 19] = not done and len(words) <= 9 and share >= 0.02
            f[n, 20] = done
            f[n, 21] = not done and not bullet and len(words) > 9
        # 22, 23: the language, filled in for whole batches.
    return parts, f


def language_features(model: LanguageModel, questions: list[str | None], parts: list[list[str]], features: list[np.ndarray]) -> None:
    """Whether a clause is of the question's language or of another, as far as both are sure."""
    forms: dict[str, int] = {}
    which = [forms.setdefault(re.sub(r"\d+", "0", (q or "").lower()), len(forms)) for q in questions]
    p_asked = model.scores(list(forms))[which]
    flat = [c.lower() for p in parts for c in p]
    p_flat = model.scores(flat) if flat else np.zeros((0, len(LANGS)), np.float32)
    at = 0
    for q, pq, part, f in zip(questions, p_asked, parts, features):
        n = len(part)
        k = int(pq.argmax())
        words = len([w for w in _WORD.findall(q or "") if not w.isdigit()])
        sure = words >= 3 and pq[k] > 0.6
        f[:, 22:24] = -1.0  # a question without a language is answered in any
        if sure and n and part[0]:
            # The question's language, or one it asks for.
            allowed = np.array([j == k or bool(_WANTS[code].search(q)) for j, code in enumerate(LANGS)])
            mine = np.where(p_flat[at : at + n].max(1) > 0.6, p_flat[at : at + n] @ allowed, 0.5)
            length = np.array([len(c) for c in part], float)
            whole_in = float(mine @ length / length.sum())
            f[:, 22] = np.clip(2 * (0.5 - mine), -1, 1)
            f[:, 23] = 1.0 if whole_in < 0.2 else -1.0 if whole_in > 0.8 else 0.0
        at += n


class ClauseField:
    """Linear-chain conditional random field in numpy, over padded batches of clause sequences.

    Emissions are linear in the dense features; the refusal tag has hashed words and pairs of words besides.
    """

    def __init__(self) -> None:
        self.emit = np.zeros((N_FEATURES, len(TAGS)))
        self.move = np.zeros((len(TAGS), len(TAGS)))
        self.words = np.zeros(1 << LEXICON_BITS)
        self.least = dict(LEAST)

    @staticmethod
    def _pad(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = max((len(f) for f in features), default=0)
        x = np.zeros((len(features), n, N_FEATURES), np.float32)
        for i, f in enumerate(features):
            x[i, : len(f)] = f
        return x, np.array([len(f) for f in features])

    def marginals(self, x: np.ndarray, lengths: np.ndarray, spoken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag marginals of each clause by forward-backward, and the expected transitions; ``spoken``: lexical scores."""
        b, n, k = x.shape[0], x.shape[1], len(TAGS)
        e = x @ self.emit
        e[:, :, R] += spoken
        # Scaled messages: each position's are normalised, which changes no marginal.
        here, step = np.exp(e - e.max(2, keepdims=True)), np.exp(self.move)
        ahead, back = np.ones((b, n, k)), np.ones((b, n, k))
        for t in range(n):
            ahead[:, t] = here[:, t] * (ahead[:, t - 1] @ step if t else 1)
            ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
        moves = np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            live = np.flatnonzero(t + 1 < lengths)
            after = here[live, t + 1] * back[live, t + 1]
            got = after @ step.T
            back[live, t] = got / got.sum(1, keepdims=True)
            total = (ahead[live, t] * got).sum(1, keepdims=True)
            moves += (ahead[live, t] / total).T @ after * step
        p = ahead * back
        return p / p.sum(2, keepdims=True), moves

    def tagged(self, parts: list[list[str]], features: list[np.ndarray]) -> list[np.ndarray]:
        """Tag marginals of the clauses of each reply."""
        x, lengths = self._pad(features)
        spoken = np.zeros(x.shape[:2])
        for i, ps in enumerate(parts):
            for n, c in enumerate(ps):
                slots = lexical(c)
                spoken[i, n] = self.words[slots].sum() / np.sqrt(max(len(slots), 1))
        p, _ = self.marginals(x, lengths, spoken)
        return [p[i, : len(ps)] for i, ps in enumerate(parts)]

    def judged(self, parts: list[list[str]], features: list[np.ndarray]) -> list[tuple[str | None, float]]:
        """``(defect, confidence)`` of each reply."""
        return [defect_of(ps, p, self.least) for ps, p in zip(parts, self.tagged(parts, features))]

    def fit(self, parts: list[list[str]], features: list[np.ndarray], tags: list[list[int]], rounds: int = 150, rate: float = 0.4, shrink: float = 1e-3) -> "ClauseField":
        x, lengths = self._pad(features)
        mask = np.arange(x.shape[1])[None] < lengths[:, None]
        gold = np.zeros((*x.shape[:2], len(TAGS)))
        moves = np.zeros_like(self.move)
        for i, t in enumerate(tags):
            gold[i, np.arange(len(t)), t] = 1
            for a, c in zip(t, t[1:]):
                moves[a, c] += 1
        slots = [lexical(c) for ps in parts for c in ps]
        size = np.array([max(len(g), 1) for g in slots])
        flat, of = np.concatenate(slots), np.repeat(np.arange(len(slots)), [len(g) for g in slots])
        weight = 1 / np.sqrt(size)
        at = np.flatnonzero(mask.ravel())
        ge, gm, gw = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6), np.full_like(self.words, 1e-6)
        for _ in range(rounds):
            spoken = np.zeros(mask.size)
            spoken[at] = np.bincount(of, self.words[flat], len(slots)) * weight
            p, expected = self.marginals(x, lengths, spoken.reshape(mask.shape))
            d = (gold - p) * mask[:, :, None]
            dw = np.bincount(flat, (d[:, :, R].ravel()[at] * weight)[of], len(self.words)) / len(tags) - 0.1 * shrink * self.words
            de = np.einsum("bnf,bnk->fk", x, d) / len(tags) - shrink * self.emit
            dm = (moves - expected) / len(tags) - shrink * self.move
            for value, g, square in ((self.emit, de, ge), (self.move, dm, gm), (self.words, dw, gw)):
                square += g * g
                value += rate * g / np.sqrt(square)
        return self


def flag_weights(rows: list[tuple[str, bool]], rounds: int = 80, rate: float = 0.5) -> np.ndarray:
    """Logistic weights of hashed words and pairs for ``(clause, refused flag)`` rows; the last entry is the bias.

    Flags are wrong at times; a wording's flag is that of most rows that share its words.
    """
    slots = [lexical(c) for c, _ in rows]
    flat, of = np.concatenate(slots), np.repeat(np.arange(len(slots)), [len(g) for g in slots])
    scale = 1 / np.sqrt(np.maximum([len(g) for g in slots], 1))
    y, w, bias, square = np.array([float(f) for _, f in rows]), np.zeros((1 << LEXICON_BITS) + 1), 0.0, np.full((1 << LEXICON_BITS) + 1, 1e-4)
    for _ in range(rounds):
        z = np.bincount(of, w[flat], len(slots)) * scale + w[-1]
        d = y - 1 / (1 + np.exp(-z))
        g = np.append(np.bincount(flat, (d * scale)[of], len(w) - 1), d.sum()) / len(rows) - 1e-5 * w
        square += g * g
        w += rate * g / np.sqrt(square)
    return w


def refusal_share(w: np.ndarray, clause: str) -> float:
    slots = lexical(clause)
    return float(1 / (1 + np.exp(-(w[slots].sum() / np.sqrt(max(len(slots), 1)) + w[-1]))))


def training_rows(sample: list[tuple[str | None, str, bool | None]], model: LanguageModel, seed: int = 3) -> list[tuple[str, str, bool, str, int]]:
    """``(question, reply, cited, kind, tag)`` made from ``(question, reply, refused)`` rows."""
    rng = random.Random(seed)
    bodies = [(q, body_of(a), r) for q, a, r in sample]
    clean = [(q, b, r) for q, b, r in bodies if not is_empty(b) and clauses(b)]
    flags = [(c, bool(r)) for _, b, r in clean if r is not None for c in clauses(b)]
    flags += [(c, True) for block in REFUSALS.values() for c in block.split("|")] * 2 + [(c, False) for block in APOLOGIES.values() for c in block.split("|")] * 2
    w = flag_weights(flags)
    out, sound = [], []
    for q, b, _ in clean:
        shares = [refusal_share(w, c) for c in clauses(b)]
        if min(shares) > 0.5:
            out.append((q or "", b, rng.random() < 0.4, "refusal", R))
        elif max(shares) < 0.5 and len(b) >= 25 and len(_WORD.findall(q or "")) >= 3:
            sound.append((q, b))
    # Seeds stand in where few rows are flagged.
    everyone = [q for q, _ in sound] or [""]
    for block in REFUSALS.values():
        out += [(rng.choice(everyone), c, rng.random() < 0.4, "refusal", R) for c in block.split("|")]
    out += [(rng.choice(everyone), x, rng.random() < 0.2, "void", V) for x in [*sorted(FILLERS), "", " ", "...", "-"] * 2]
    if not sound:
        return out
    langs = model.scores([a.lower() for _, a in sound]).argmax(1)
    asked = model.scores([q.lower() for q, _ in sound]).argmax(1)
    by = {k: [i for i in range(len(sound)) if langs[i] == k] for k in range(len(LANGS))}
    for i, (q, a) in enumerate(sound):
        if langs[i] != asked[i]:
            continue
        lang = LANGS[langs[i]]
        inside = set(w.lower() for w in _WORD.findall(q))
        told = [w.lower() for w in _WORD.findall(a)]
        if sum(w in inside for w in told) > 0.6 * len(told):
            continue
        whole = bool(_END.search(a)) or bool(_BULLET.match(clauses(a)[-1])) or len(told) <= 8
        cited = rng.random() < 0.9
        if whole:
            out.append((q, a, cited, "answer", A))
            if rng.random() < 0.3:
                first = clauses(a)[0]
                out.append((q, re.sub(r"[.\s]+$", "", a) if len(_WORD.findall(first)) <= 8 or _BULLET.match(first) else a, cited, "answer", A))
            if rng.random() < 0.25:
                out.append((q, rng.choice(APOLOGIES[lang].split("|")) + " " + a, cited, "answer", A))
            if rng.random() < 0.3:
                out.append((q, q + rng.choice(["\n", " "]) + a, cited, "restated", A))
            if rng.random() < 0.5 and len(a) > 40:
                at = rng.randrange(20, len(a) - 3)
                out.append((q, a[:at].rstrip(" .!?…"), cited, "unfinished", U))
            if rng.random() < 0.15:
                part = a if rng.random() < 0.5 else clauses(a)[0]
                out.append((q, re.sub(r"[.!?…\s]+$", "", part) + rng.choice([", ", " "]) + rng.choice(OPEN_ENDS[lang].split("|")), cited, "unfinished", U))
        pick = rng.random()
        if pick < 0.35:
            form = rng.choice(ECHOES[lang].split("|")).format(rng.choice([q, q, q.upper(), q.lower(), q.rstrip("?! ."), q.replace(",", ""), q + " " + q, q.replace("?", " ...")]))
            out.append((q, form + rng.choice(["", "", ".", " ..."]), rng.random() < 0.8, "echo", E))
        elif pick < 0.65:
            others = [k for k in by if k != asked[i] and by[k]]
            if others:
                a2 = sound[rng.choice(by[rng.choice(others)])][1]
                if _END.search(a2) or _BULLET.match(clauses(a2)[-1]):
                    out.append((q, a2, rng.random() < 0.9, "foreign", X))
    return out


_DEFECT = {"void": "empty", "unfinished": "truncated", "foreign": "wrong_language", "refusal": "refusal", "echo": "copy"}


def fit_clauses(sample: list[tuple[str | None, str, bool | None]], model: LanguageModel, endings: np.ndarray, seed: int = 3) -> ClauseField:
    """The field, and the coverage from which each tag makes a defect, fitted on made replies kept out of training."""
    rows = training_rows(sample, model, seed)
    seen = [describe(q, a, cited, endings) for q, a, cited, _, _ in rows]
    parts, features = [s[0] for s in seen], [s[1] for s in seen]
    language_features(model, [r[0] for r in rows], parts, features)
    tags = []
    for (q, _, _, kind, tag), ps in zip(rows, parts):
        t = [tag] * len(ps)
        if kind == "unfinished":
            t = [A] * (len(ps) - 1) + [U]
        elif kind == "restated":
            t = [E if n < max(1, len(clauses(q))) else A for n in range(len(ps))]
        tags.append(t)
    held = [n for n in range(len(rows)) if n % 5 == 4]
    train = [n for n in range(len(rows)) if n % 5 != 4]
    pick = lambda values, which: [values[n] for n in which]
    field = ClauseField().fit(pick(parts, train), pick(features, train), pick(tags, train), rounds=70)
    # The sample's own replies were taken for sound; those the first fit finds defective are left out of the second.
    found = field.judged(parts, features)
    keep = [n for n in train if rows[n][3] not in ("answer", "restated") or found[n][0] is None]
    field = ClauseField().fit(pick(parts, keep), pick(features, keep), pick(tags, keep), rounds=110)
    held = [n for n in held if rows[n][3] not in ("answer", "restated") or found[n][0] is None]
    want, tagged = [_DEFECT.get(rows[n][3]) for n in held], field.tagged(pick(parts, held), pick(features, held))
    for tag in (U, V, X, R, E):
        best = None
        for level in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
            got = [defect_of(parts[n], p, field.least | {tag: level})[0] for n, p in zip(held, tagged)]
            # Sound replies are several times as many in the tables as among the made ones.
            cost = sum((1 if w else 4) for g, w in zip(got, want) if g != w)
            if best is None or cost < best[0]:
                best = cost, level
        field.least = field.least | {tag: best[1]}
    return field


def defect_of(parts: list[str], marginals: np.ndarray, least: dict[int, float]) -> tuple[str | None, float]:
    """The reply's single defect from its clauses' tags, by the words they cover, and how sure the tags are."""
    words = np.maximum([len(_WORD.findall(c)) for c in parts], 1).astype(float)
    cover = marginals.T @ words / words.sum()
    sure = float(marginals.max(1).mean())
    if marginals[-1, U] >= least[U]:
        return "truncated", sure
    over = {k: cover[k] - least[k] for k in (V, X, R, E) if cover[k] >= least[k]}
    return (_DEFECT[TAGS[max(over, key=over.get)]] if over else None), sure


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, model, endings = shared.value
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("answer_id", "question", "text", "cited")]
            out: list[str | None] = []
            sure: list[float] = []
            for lo in range(0, batch.num_rows, 1000):
                rows = list(zip(*(c[lo : lo + 1000] for c in cols)))
                seen = [describe(q, t, bool(c), endings) for _, q, t, c in rows]
                parts, features = [s[0] for s in seen], [s[1] for s in seen]
                language_features(model, [r[1] for r in rows], parts, features)
                # Replies of like length go together, so that a very long one pads no others.
                order = sorted(range(len(rows)), key=lambda n: len(parts[n]))
                done: list[tuple[str | None, float]] = [(None, 0.0)] * len(rows)
                at = 0
                while at < len(order):
                    end = at + 1
                    while end < len(order) and len(parts[order[end]]) <= 2 * len(parts[order[at]]) + 4:
                        end += 1
                    for n, d in zip(order[at:end], field.judged([parts[n] for n in order[at:end]], [features[n] for n in order[at:end]])):
                        done[n] = d
                    at = end
                out += [d for d, _ in done]
                sure += [c for _, c in done]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(out, pa.string()), pa.array(sure, pa.float64())], names=["answer_id", "defect", "confidence"])

    return run


def question_language(labelled: list[tuple[str, str]], pairs: list[tuple[str | None, str]]) -> LanguageModel:
    """A language model that also knows questions: what begins alike in the sample has the language of most replies to it."""
    base = fit_language(labelled)
    votes: dict[str, np.ndarray] = {}
    forms: dict[str, str] = {}
    for (q, _), p in zip(pairs, base.scores([body_of(a).lower() for _, a in pairs])):
        if p.max() > 0.9:
            for part in clauses(q or ""):
                form = re.sub(r"\d+", "0", part.lower())
                forms[form] = " ".join(_WORD.findall(form)[:3])
                votes.setdefault(forms[form], np.zeros(len(LANGS)))[int(p.argmax())] += 1
    certain = [(form, LANGS[int(v.argmax())]) for form, start in sorted(forms.items()) if (v := votes[start]).max() >= 2 and v.max() > 0.7 * v.sum()]
    return fit_language(labelled, certain=certain * 2)


def reply_defects(answers: DataFrame, turns: DataFrame, labelled: list[tuple[str, str]], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(answer_id, defect, confidence)``, one row per ``answer_id``; ``defect`` is null where there is none.

    Defects: empty, truncated, refusal, copy, wrong_language. A reply without a turn, or with a null question, is
    judged without it. A null text is empty. ``labelled`` are ``(text, language)`` rows for the language model.
    Repeated rows count once; of several texts of one id the surest defect is given. At most ``sample_rows`` rows
    with the flag ``refused`` and as many without it are trained on; the flag of a row itself decides nothing.
    """
    spark = ready(answers.sparkSession)
    cited = F.size(F.coalesce("citations", F.array().cast("array<string>"))) > 0
    endings = ending_table(answers.select("text").union(turns.select(F.col("question").alias("text"))), ("text",))
    # The sample's rows are found by their ids; both tables are cut to them before they meet.
    flagged = answers.where("text IS NOT NULL AND refused IS NOT NULL").select("answer_id", "turn_id", "refused")
    picked = cut(sampled(flagged.where("refused"), sample_rows, "answer_id").union(sampled(flagged.where("NOT refused"), sample_rows, "answer_id")))
    sample_turns = turns.select("turn_id", "question").join(F.broadcast(picked.select("turn_id").distinct()), "turn_id", "left_semi").distinct()
    sample = answers.select("answer_id", "text").join(F.broadcast(picked), "answer_id").join(sample_turns, "turn_id", "left").select("answer_id", "question", "text", "refused").distinct().collect()
    rows = [(r["question"], r["text"], r["refused"]) for r in sorted(sample, key=lambda r: (r["answer_id"], r["question"] or "", r["text"]))]
    language = question_language(labelled, [(q, a) for q, a, flag in rows if not flag])
    field = fit_clauses(rows, language, endings)
    shared = spark.sparkContext.broadcast((field, language, endings))
    asked = turns.where("turn_id IS NOT NULL").select("turn_id", "question").distinct()
    joined = answers.select("answer_id", "turn_id", "text", cited.alias("cited")).join(asked, "turn_id", "left").select("answer_id", "question", "text", "cited")
    # A fixed number of even partitions: the work is in Python, and AQE would fold a small join into few tasks.
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = joined.repartition(width).mapInArrow(_judged(shared), "answer_id long, defect string, confidence double")
    best = F.max(F.struct(F.col("defect").isNotNull().alias("bad"), F.round("confidence", 6).alias("confidence"), "defect"))
    return found.groupBy("answer_id").agg(best.alias("b")).select("answer_id", "b.defect", "b.confidence")
