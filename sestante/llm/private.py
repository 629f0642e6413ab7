"""Personal data in free text: a skip-chain conditional random field over words.

Chain factors tie neighbouring words; skip factors tie repeated rare words of one document, so that a name recognised
once is recognised again. Marginals come from loopy belief propagation with a flooding schedule: the words of a whole
batch of texts form one factor graph whose messages are numpy arrays. The field is trained at run time on sentences
made from seeds, by gradient ascent on the likelihood with the same propagation.
"""

from __future__ import annotations

import functools
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
from .private_seeds import AGAIN, ENDS, FIRST, FOOTERS, PLAIN, STEMS, STREETS, TITLES, TOWNS, WITH, WITHOUT

KINDS = ("none", "email", "phone", "identity", "address", "name")
K = len(KINDS)
BITS = 15
OFFSETS = (-2, -1, 0, 1, 2)
#: Placeholders of the masked texts.
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS[1:]}

_EMAIL = r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"
_TOKEN = re.compile(rf"\[[^\[\]\n]*#[^\[\]\n]*\]|\[[A-Z_ ]{{2,20}}\]|{_EMAIL}|@\w+|[^\W_]+(?:\.(?=[a-z]{{1,3}}\.?\s))?|\n|[^\w\s]|_")
#: Spans whose outline speaks for a kind; the field weighs them with the words around.
_OUTLINES = (
    ("email", re.compile(_EMAIL)),
    ("email_spelt", re.compile(r"[\w.+\-]+\s?(?:\(at\)|\[at\]|\{at\}|@|\bchiocciola\b|\barroba\b|\barobase\b|\bklammeraffe\b|\bat\b)\s?[\w\-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\bpunto\b|\bdot\b|\bpunkt\b|\bpoint\b)\s?[\w\-]+)+", re.I)),
    ("tax", re.compile(r"(?<![A-Z0-9])(?:[A-Z][\s.\-]?){6}(?:[\dLMNPQRSTUV][\s.\-]?){2}[A-Z][\s.\-]?(?:[\dLMNPQRSTUV][\s.\-]?){2}[A-Z][\s.\-]?(?:[\dLMNPQRSTUV][\s.\-]?){3}[A-Z](?![A-Z0-9])", re.I)),
    ("tax_short", re.compile(r"(?<![A-Za-z0-9])(?=(?:[A-Z]*\d){3})[A-Z]{5,6}[0-9A-Z]{8,11}(?![A-Za-z0-9])", re.I)),
    ("passport", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[\s\-]?\d{7}(?![A-Za-z0-9])", re.I)),
    ("card", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[\s\-]?\d{5}[\s\-]?[A-Z]{2}(?![A-Za-z0-9])", re.I)),
    ("coded", re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[\s\-]?\d{6,8}[A-Z]?(?![A-Za-z0-9])", re.I)),
    ("digits", re.compile(r"(?<![\w/.])(?:\+|\()?\d(?:[\s().\-]{0,2}\d){6,14}(?![\w/]|\.\d)")),
    ("slash", re.compile(r"\d+(?:/\d+)+")),
    ("street", re.compile(r"\b(?i:via|viale|v\.le|vicolo|piazza|p\.zza|piazzale|corso|largo|strada|contrada|salita|calle|plaza|avenida|paseo|callejón)\s(?:(?:d[aeio]\w{0,4}|del?\s\w{2,3}|la|las|los|el|le)\s|dell['’])?(?:[^\W\d_a-zà-ÿ][\w'’.]*[\s,]+){1,4}(?:n\.?\s?)?\d{1,4}(?:/[A-Z])?(?:,\s\d{5}\s[^\W\d_]+(?:\s[A-ZÀ-Ý]\w+)?)?")),
    ("street_small", re.compile(r"\b(?:via|viale|v\.le|vicolo|piazza|p\.zza|piazzale|corso|largo|strada|contrada|salita|calle|plaza|avenida|paseo|callejón)\s(?:[\w'’.]+[\s,]+){1,4}?(?:n\.?\s?)?\d{1,4}(?:/[a-z])?\b", re.I)),
    ("street_after", re.compile(r"\b\d{1,4}(?:/[A-Z])?,?\s(?:rue|avenue|impasse|place|chemin|boulevard|allée)\s(?:[\w'’]+\s?){1,4}|\b\d{1,4}\s(?:[A-Z]\w+\s){1,3}(?:Street|Road|Lane|Row|Avenue|Square|Close|Rise|Drive|Terrace|Court|Walk|Gate|Hill|Yard|Way|Mews)\b")),
    ("street_german", re.compile(r"\b(?:(?:Alte|Neue|Am|An der|Im|Zum|Zur)\s)?(?:[A-ZÄÖÜ]\w+\s)?\w*(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer|ring|hof|teich|graben|markt)\s\d{1,4}(?:/[A-Z])?\b", re.I)),
)
#: What a text must hold for an outline to be there at all: a quick look before the slow ones.
_AT = re.compile(r"@|\bat\b|chiocciola|arroba|arobase|klammeraffe", re.I)
_NEEDS = {"email": re.compile("@"), "email_spelt": _AT, "slash": re.compile(r"\d/\d"), "street": re.compile(r"\d"), "street_small": re.compile(r"\d"), "street_german": re.compile(r"(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer|ring|hof|teich|graben|markt)\s\d", re.I), "street_after": re.compile(r"\d,?\s(?:rue|avenue|impasse|place|chemin|boulevard|allée)\s|\d/[A-Z],?\s|\s(?:Street|Road|Lane|Row|Avenue|Square|Close|Rise|Drive|Terrace|Court|Walk|Gate|Hill|Yard|Way|Mews)\b")}
_NAMES = {name: n for n, (name, _) in enumerate(_OUTLINES)}
_PATTERNS = len(_OUTLINES) * 4
#: Log-odds by which a word must come near a kind, and words around it, for the propagation to look there.
SLACK, REACH = 1.5, 7
#: Probability that a word is personal from which it counts as such; names have no outline that speaks for them.
LEAST = {"email": 0.3, "phone": 0.3, "identity": 0.3, "address": 0.3, "name": 0.4}
_HINTS = frozenset("chiocciola arroba arobase klammeraffe".split())
_FIRST = frozenset(x.lower() for x in FIRST)
_STREET = frozenset(t.lower().rstrip(".") for ts, _ in STREETS.values() for t in ts) | {"str", "strasse"}
_TITLE = frozenset(t.lower().rstrip(".") for ts in TITLES.values() for t in ts.split())
_ENDS = tuple(sorted(ENDS, key=len, reverse=True))


def _id(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def likeness(w: str) -> str:
    """What repeated and similar words have in common: no case, no accents, no final vowel or ``s``."""
    low = "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c))
    return low[:-1] if len(low) > 5 and low[-1] in "aeious" else low


def form_features(w: str) -> list[int]:
    """Hashed features of a word form."""
    low = w.lower()
    if low[:1] == "[":
        return [_id("placeholder")]
    if "@" in low:
        return [_id("@mail" if "." in low else "@handle"), _id("@sample") if low.split("@")[-1].endswith("example.com") else _id("@other")]
    if low.isdigit():
        return [_id("digits"), _id(f"digits {min(len(low), 11)}"), _id("digits from " + low[:2])]
    if not low[0].isalnum():
        return [_id("sign " + low)]
    base = low.rstrip(".")
    shape = "digit" if any(c.isdigit() for c in w) else "small" if w.islower() else "caps" if w.isupper() and len(base) > 1 else "initial" if len(base) == 1 else "title" if w[0].isupper() else "mixed"
    out = [_id("word " + base), _id("shape " + shape), _id(f"shape {shape} {min(len(base), 8)}"), _id("end3 " + base[-3:])]
    if len(base) > 5:
        out += [_id("end4 " + base[-4:]), _id("end5 " + base[-5:]), _id(f"long end4 {shape == 'small'} " + base[-4:])]
    if shape == "digit":
        out.append(_id("outline " + re.sub(r"\d+", "0", re.sub(r"[a-z]+", "a", base))))
    if base in _FIRST:
        out.append(_id("first name"))
        out.append(_id("first name " + shape))
    if base in _STREET:
        out.append(_id("street"))
    if base in _TITLE:
        out.append(_id("honorific"))
    if base.endswith(("weg", "straße", "strasse", "gasse", "platz", "allee")) and len(base) > 6:
        out.append(_id("street compound"))
    if len(base) > 6 and base.endswith(_ENDS):
        out.append(_id("surname end"))
        out.append(_id("surname end " + shape))
    return out


class Graph:
    """Words of a batch as one graph: chain edges inside texts, skip edges between rare words of a text of equal ``like``.

    All message arrays are kinds times edges, so that sums over kinds run along the outer axis.
    """

    def __init__(self, owner: np.ndarray, like: np.ndarray, rare: np.ndarray, place: np.ndarray | None = None) -> None:
        self.n = len(owner)
        same = owner[:-1] == owner[1:] if self.n else np.zeros(0, bool)
        if place is not None and self.n:
            same &= place[1:] == place[:-1] + 1
        self.chain = np.flatnonzero(same)
        at = np.flatnonzero(rare)
        order = at[np.lexsort((at, like[at], owner[at]))] if len(at) else at
        again = (owner[order[:-1]] == owner[order[1:]]) & (like[order[:-1]] == like[order[1:]]) if len(order) > 1 else np.zeros(0, bool)
        self.skip_a, self.skip_b = order[:-1][again], order[1:][again]
        self.a = np.concatenate([self.chain, self.skip_a])
        self.b = np.concatenate([self.chain + 1, self.skip_b])
        self.split = len(self.chain)

    def beliefs(self, emit: np.ndarray, move: np.ndarray, skip: np.ndarray, rounds: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of the words and of the edges (chain and skip) after ``rounds`` of flooding."""
        e, c = len(self.a), self.split
        base = np.ascontiguousarray(emit.T, np.float32)
        ahead, back = np.zeros((K, e), np.float32), np.zeros((K, e), np.float32)
        em, es = np.exp(move).astype(np.float32), np.exp(skip).astype(np.float32)

        def total() -> np.ndarray:
            z = base.copy()
            z[:, self.chain + 1] += ahead[:, :c]
            z[:, self.chain] += back[:, :c]
            for k in range(K) if e > c else ():
                z[k] += np.bincount(self.skip_b, ahead[k, c:], self.n).astype(np.float32)
                z[k] += np.bincount(self.skip_a, back[k, c:], self.n).astype(np.float32)
            return z

        def send(z: np.ndarray, chain: np.ndarray, skips: np.ndarray) -> np.ndarray:
            z = np.exp(z - z.max(0))
            out = np.concatenate([chain.T @ z[:, :c], skips.T @ z[:, c:]], 1) if e > c else chain.T @ z
            out = np.log(out + 1e-12)
            return out - out.max(0)

        for _ in range(rounds):
            z = total()
            ahead, back = send(z[:, self.a] - back, em, es), send(z[:, self.b] - ahead, em.T, es.T)
        z = total()
        p = np.exp(z - z.max(0))
        p /= p.sum(0)
        za, zb = z[:, self.a] - back, z[:, self.b] - ahead
        za, zb = np.exp(za - za.max(0)), np.exp(zb - zb.max(0))
        out = []
        for lo, hi, m in ((0, c, em), (c, e, es)):
            q = za[:, None, lo:hi] * m[:, :, None] * zb[None, :, lo:hi]
            out.append((q / np.maximum(q.sum((0, 1)), 1e-12)).sum(2) if hi > lo else np.zeros((K, K)))
        return p.T, out[0], out[1]


class PrivateField:
    """Weights of the field and a bounded memo of word forms."""

    def __init__(self) -> None:
        self.words = np.zeros((len(OFFSETS), 1 << BITS, K), np.float32)
        self.patterns = np.zeros((_PATTERNS, K), np.float32)
        self.bias = np.zeros(K, np.float32)
        self.move = np.zeros((K, K))
        self.skip = np.zeros((K, K))
        self._reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "rows", "rare", "set", "hint", "wordy", "digits", "kin", "like")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.kin: dict[str, int] = {}
        self.rows = np.zeros((1024, len(OFFSETS), K), np.float32)
        self.rare = np.zeros(1024, bool)
        self.set = np.zeros(1024, bool)
        self.hint = np.zeros(1024, bool)
        self.wordy = np.zeros(1024, bool)
        self.digits = np.zeros(1024, np.int32)
        self.like = np.zeros(1024, np.int64)

    def _add(self, w: str) -> int:
        n = self.at[w] = len(self.at)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rare = np.concatenate([self.rare, np.zeros_like(self.rare)])
            for name in ("set", "hint", "wordy", "digits", "like"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.rows[n] = self.words[:, form_features(w)].sum(1)
        self.rare[n] = len(w) > 4 and w[0].isalpha()
        self.like[n] = self.kin.setdefault(likeness(w), len(self.kin))
        self.set[n] = len(w) > 2 and w[0] == "["
        low = w.lower()
        self.digits[n] = 0 if self.set[n] else sum(c.isdigit() for c in w)
        self.wordy[n] = w.isalpha() and not (len(w) == 3 and w.isupper()) or w in ":;,!?\n"
        self.hint[n] = not self.set[n] and ("@" in w or low in _HINTS or (self.digits[n] > 3 and len(w) > 6) or (self.digits[n] == 5 and len(w) == 5) or low.rstrip(".") in _STREET or low.rstrip(".") in ("v", "p") or low.endswith(("weg", "straße", "strasse", "gasse", "teich", "graben")))
        return n

    def emissions(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, form, emission)`` of all words, patterns not yet counted."""
        if len(self.at) > 200_000:
            self._reset()
        at = self.at
        try:
            forms = np.array([at[w] for ws in tokens for w in ws], np.int64)
        except KeyError:
            for ws in tokens:
                for w in ws:
                    if w not in at:
                        self._add(w)
            forms = np.array([at[w] for ws in tokens for w in ws], np.int64)
        owner = np.repeat(np.arange(len(tokens)), [len(ws) for ws in tokens])
        return owner, forms, self._gather(owner, forms, self.rows)

    def _gather(self, owner: np.ndarray, forms: np.ndarray, rows: np.ndarray) -> np.ndarray:
        emit = np.tile(self.bias, (len(forms), 1))
        for k, off in enumerate(OFFSETS):
            if off == 0:
                emit += rows[forms, k]
            elif off < 0:
                if len(forms) > -off:
                    emit[-off:] += rows[forms[:off], k] * (owner[-off:] == owner[:off])[:, None]
            elif len(forms) > off:
                emit[:-off] += rows[forms[off:], k] * (owner[off:] == owner[:-off])[:, None]
        return emit


def outline_ids(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """``(token, pattern)`` of each outline found in the text; patterns tell the kind, a leading sign and the length."""
    found = []
    for n, (name, pattern) in enumerate(_OUTLINES):
        if name in _NEEDS and not _NEEDS[name].search(text):
            continue
        for m in pattern.finditer(text):
            s = m.group()
            variant = 0
            if name == "digits":
                d = re.sub(r"\D", "", s)
                variant = 1 if s[0] in "+(" or d.startswith("00") else 2 if len(d) >= 9 and s != d else 3 if len(d) in (9, 10) else 0
            elif name.startswith("email"):
                variant = 1 if re.search(r"@\s?example\.com$", s, re.I) else 0
            elif name == "card" or name == "passport":
                variant = 1 if re.fullmatch(r"[A-Z]{2}[\s\-]?\d{5}[\s\-]?[A-Z]{2}|[A-Z]{2}\d{7}", s) else 0
            lo, hi = np.searchsorted(starts, (m.start(), m.end()))
            found += [(t, 4 * n + variant) for t in range(int(lo), int(hi))]
    return found


# -- training ---------------------------------------------------------------------------------------------------


def _surname(rng: random.Random) -> str:
    if rng.random() < 0.3:  # endings of no list, so that the words around must tell
        s = "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) + rng.choice(["", "n", "s", "l", "rt", "nghi", "nk", "x", "sk"])
        return s.capitalize()
    s = rng.choice(STEMS) + rng.choice(["", "", rng.choice(["o", "a", "e", "i"]) + rng.choice(["n", "l", "r", "d", "t", "v"])]) + rng.choice(ENDS)
    return s.capitalize()


def _name(rng: random.Random, lang: str) -> str:
    s = _surname(rng)
    if rng.random() < 0.12:
        s += "-" + _surname(rng)
    first = rng.choice(FIRST)
    pick = rng.random()
    if pick < 0.45:
        out = f"{first} {s}"
    elif pick < 0.6:
        out = f"{s.upper()} {first}"
    elif pick < 0.7:
        out = f"{first[0]}. {s}"
    elif pick < 0.82:
        out = f"{rng.choice(TITLES[lang].split())} {s}"
    elif pick < 0.9:
        out = f"{first} {rng.choice(FIRST)} {s}"
    else:
        out = f"{s} {first}"
    return out.lower() if rng.random() < 0.12 else out


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _fill(slot: str, rng: random.Random, lang: str) -> tuple[str, int]:
    d = functools.partial(_digits, rng)
    if slot == "NAME":
        return _name(rng, lang), 5
    if slot == "SURNAME":
        return _surname(rng), 0
    if slot == "PHONE":
        n = "3" + d(9)
        forms = [n, f"+39 {n[:3]} {n[3:6]} {n[6:]}", f"0039-{n[:3]}-{n[3:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"({n[:3]}) {n[3:6]} {n[6:8]} {n[8:]}", " ".join(n), f"+44 7700 {d(6)}", f"+49 1{d(2)} {d(8)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(8)}", f"{n[:3]} {n[3:]}", f"{n[:3]}/{n[3:]}"]
        return rng.choice(forms), 2
    if slot == "EMAIL":
        first, last, dom = rng.choice(FIRST).lower(), _surname(rng).lower(), rng.choice(["posta.test", "mail.borgo.test", "box3.invalid", "studio.example", "lettera.example.org", "cassetta.example.net", "web.it", "post.de"])
        user = first + rng.choice([".", "_", "-", ""]) + last + rng.choice(["", "", d(2)])
        pick = rng.random()
        at = "@" if pick < 0.45 else rng.choice([" (at) ", "[at]", "[at]", " @ ", " @ ", "(at)"]) if pick < 0.85 else " chiocciola " if lang == "it" else " at "
        dom = dom.replace(".", "[dot]") if at == "[at]" and rng.random() < 0.7 else dom if pick < 0.8 else dom.replace(".", " punto ") if "chiocciola" in at else dom
        out = user + at + dom
        return out.upper() if rng.random() < 0.12 else out, 1
    if slot == "TAX":
        c = "".join(rng.choice("BCDFGLMNPRSTVZ") for _ in range(6)) + d(2) + rng.choice("ABCDEHLMPRST") + rng.choice(["0", "1", "2", "4", "5"]) + d(1) + rng.choice("ABCDZ") + d(3) + rng.choice("ABCDEFGHIL")
        pick = rng.random()
        c = c[:8] + c[8:].replace("1", "M", 1) if pick < 0.06 else f"{c[:3]} {c[3:6]} {c[6:11]} {c[11:]}" if pick < 0.22 else c
        return c.lower() if rng.random() < 0.15 else c, 3
    if slot == "PASS":
        return "Y" + rng.choice("ABC") + d(7), 3
    if slot == "CARD":
        return rng.choice([f"C{rng.choice('ABCX')} {d(5)} {rng.choice('ABDMN')}{rng.choice('KMNVA')}", f"CA{d(5)}{rng.choice('ABC')}{rng.choice('XYZ')}", f"A{rng.choice('SXY')}{d(7)}", f"{rng.choice('IL')}{d(8)}"]), 3
    if slot == "ADDR":
        where = lang if rng.random() < 0.8 else rng.choice(list(STREETS))
        types, names = STREETS[where]
        name, number = rng.choice(names), str(rng.randrange(1, 190)) + rng.choice(["", "", "", "/A", "/B"])
        if rng.random() < 0.4:  # streets are named after anybody and anything
            before = {"it": ["", "", "della ", "del ", "dei ", "di "], "fr": ["", "du ", "de la ", "des "], "es": ["", "del ", "de la ", "de los "]}.get(where, [""])
            name = rng.choice(before) + rng.choice([_surname(rng), _surname(rng) + " " + _surname(rng)] if where != "de" else [_surname(rng)])
        elif where == "it" and rng.random() < 0.3:  # or told apart by a further word
            name += rng.choice([" Vecchi", " Nuova", " Alti", " di Sopra", " Grande", " Lunghi"])
        if where == "de":
            s = f"{name}{rng.choice(types)} {number}" if rng.random() < 0.75 else f"Am {rng.choice(['Alten', 'Krummen', 'Neuen'])} {rng.choice(['Teich', 'Markt', 'Graben'])} {number}"
        elif where == "en":
            s = f"{number} {name} {rng.choice(types)}"
        elif where == "fr":
            s = f"{number} {rng.choice(types)} {name}"
        else:
            s = f"{rng.choice(types)} {name}{rng.choice([' ', ', ', ' n. '])}{number}"
            s = s[0].upper() + s[1:] if rng.random() < 0.4 else s
        if rng.random() < 0.4:
            s += f", 0{d(4)} {rng.choice(TOWNS)}"
        return s, 4
    if slot == "RCPT":
        return d(10) if rng.random() < 0.8 else d(8), 0
    if slot == "PROT":
        return f"20{d(2)}/{d(6)}", 0
    if slot == "LOCK":
        return rng.choice(["AR", "QX", "K"]) + d(6) + "X", 0
    if slot == "MONEY":
        return rng.choice([d(3), f"{rng.randrange(1, 12)}.{d(3)}", f"1,{d(3)}"]), 0
    if slot == "DATE":
        return f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/2026", 0
    if slot == "TIME":
        return f"{rng.randrange(6, 24)}:{rng.choice(['00', '10', '15', '30', '45'])}", 0
    if slot == "NUM":
        return str(rng.randrange(1, 450)), 0
    return rng.choice(["casa", "info", "piano"]), 0


def seed_texts(seed: int = 5, draws: int = 9) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``(text, spans)`` with ``(start, end, kind)`` of each personal slot."""
    rng, later = random.Random(seed), random.Random(-seed)
    out = []
    for source, times in ((WITH, draws), (WITHOUT, draws)):
        for lang, block in source.items():
            templates: list[str] = []
            depth, part = 0, ""
            for c in block:
                depth += (c == "{") - (c == "}")
                if c == "|" and not depth:
                    templates.append(part)
                    part = ""
                else:
                    part += c
            templates.append(part)
            others = WITHOUT[lang].split("|")
            for template in templates:
                for _ in range(times):
                    t = template
                    while m := re.search(r"\{([^{}]*)\}", t):
                        t = t[: m.start()] + rng.choice(m.group(1).split("|")) + t[m.end() :]
                    if rng.random() < 0.5:
                        t = t[0].upper() + t[1:]
                    if rng.random() < 0.4:
                        o = rng.choice(others)
                        if "{" not in o:
                            t = f"{o[0].upper()}{o[1:]} {t}" if rng.random() < 0.5 else f"{t} {o[0].upper()}{o[1:]}"
                    if rng.random() < 0.2:
                        t = "- " + t[0].upper() + t[1:]
                    if rng.random() < 0.25:
                        t += "\n\n__" + rng.choice(FOOTERS[lang].split("|")) + f" {rng.choice([60, 80])} % · {rng.choice(['public', 'resident', 'staff'])}__"
                    text, spans, at = "", [], 0
                    for m in re.finditer(r"<(\w+)>", t):
                        text += t[at : m.start()]
                        value, kind = _fill(m.group(1), rng, lang)
                        if kind:
                            spans.append((len(text), len(text) + len(value), kind))
                        text += value
                        at = m.end()
                    text += t[at:]
                    named = [w for lo, hi, k in spans if k == 5 for w in re.findall(r"[^\W\d_]+", text[lo:hi]) if len(w) > 4 and w.lower() not in _FIRST | _TITLE]
                    if later.random() < (0.4 if named else 0.1):  # a name said before comes again, however far on
                        start, end = later.choice(AGAIN[lang].split("|")).split("{}")
                        form = later.choice([str, str, str.capitalize, str.upper, str.lower])
                        word = form(later.choice(named)) if named else later.choice(PLAIN[lang].split())
                        text += " " + "".join(o + " " for o in later.choices([x for x in others if not set("{<") & set(x)], k=later.randrange(4))) + start
                        if named:
                            spans.append((len(text), len(text) + len(word), 5))
                        text += word + end
                    if rng.random() < 0.08:
                        text = text.upper()
                    elif rng.random() < 0.06:
                        text = text.lower()
                    out.append((text, spans))
    return out


def _tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    ms = list(_TOKEN.finditer(text))
    return [m.group() for m in ms], [m.start() for m in ms], [m.end() for m in ms]


def fit_private(rounds: int = 100, rate: float = 0.25, shrink: float = 2e-5) -> PrivateField:
    """Gradient ascent on the likelihood of the seed sentences, expectations by loopy propagation."""
    field = PrivateField()
    data = seed_texts()
    tokens, tags, hits = [], [], []
    base = 0
    for text, spans in data:
        ws, starts, ends = _tokens(text)
        tokens.append(ws)
        tags += [next((k for lo, hi, k in spans if s >= lo and e <= hi), 0) for s, e in zip(starts, ends)]
        hits += [(base + t, p) for t, p in outline_ids(text, starts)]
        base += len(ws)
    owner = np.repeat(np.arange(len(tokens)), [len(w) for w in tokens])
    index: dict[str, int] = {}
    forms = np.array([index.setdefault(w, len(index)) for ws in tokens for w in ws], np.int64)
    feats = [form_features(w) for w in index]
    flat, of = np.concatenate(feats).astype(np.int64), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    rare = np.array([len(w) > 4 and w[0].isalpha() for w in index])[forms]
    kin: dict[str, int] = {}
    like = np.array([kin.setdefault(likeness(w), len(kin)) for w in index])[forms]
    graph = Graph(owner, like, rare)
    hit = np.array(hits, np.int64).reshape(-1, 2)
    gold = np.eye(K, dtype=np.float32)[np.array(tags)]
    gold_move = np.zeros((K, K))
    np.add.at(gold_move, (np.array(tags)[graph.chain], np.array(tags)[graph.chain + 1]), 1)
    gold_skip = np.zeros((K, K))
    np.add.at(gold_skip, (np.array(tags)[graph.skip_a], np.array(tags)[graph.skip_b]), 1)
    gw, gp, gb = np.full_like(field.words, 1e-8), np.full_like(field.patterns, 1e-8), np.full_like(field.bias, 1e-8)
    gm, gs = np.full((K, K), 1e-8), np.full((K, K), 1e-8)
    n = len(tokens)
    u = len(feats)
    for _ in range(rounds):
        rows = np.zeros((u, len(OFFSETS), K), np.float32)
        for k in range(len(OFFSETS)):
            for c in range(K):
                rows[:, k, c] = np.bincount(of, field.words[k, flat, c], u)
        emit = field._gather(owner, forms, rows)
        np.add.at(emit, hit[:, 0], field.patterns[hit[:, 1]])
        p, move, skip = graph.beliefs(emit, field.move, field.skip, 5)
        d = gold - p
        gradient = np.zeros_like(field.words)
        for k, off in enumerate(OFFSETS):
            if off == 0:
                f, dd = forms, d
            elif off < 0:
                ok = owner[-off:] == owner[:off]
                f, dd = forms[:off][ok], d[-off:][ok]
            else:
                ok = owner[off:] == owner[:-off]
                f, dd = forms[off:][ok], d[:-off][ok]
            for c in range(K):
                gradient[k, :, c] = np.bincount(flat, np.bincount(f, dd[:, c], u)[of], 1 << BITS)
        for value, g, square in (
            (field.words, gradient / n - shrink * field.words, gw),
            (field.patterns, np.stack([np.bincount(hit[:, 1], d[hit[:, 0], c], _PATTERNS) for c in range(K)], 1) / n - shrink * field.patterns, gp),
            (field.bias, d.sum(0) / n, gb),
            (field.move, (gold_move - move) / n - shrink * field.move, gm),
            (field.skip, (gold_skip - skip) / n - shrink * field.skip, gs),
        ):
            square += g * g
            value += rate * g / np.sqrt(square)
    return field


# -- use --------------------------------------------------------------------------------------------------------

_NEVER = np.array([0] + [-30] * (K - 1), np.float32)


def plausible(kind: str, s: str) -> bool:
    """The exact check that follows the field: what a span of the kind must hold at least."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(_AT.search(s)) and not re.search(r"example\.com\s*$", s, re.I)
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "identity":
        return digits >= 5 and any(c.isalpha() for c in s) and len(re.sub(r"\W", "", s)) >= 7
    if kind == "address":
        return digits >= 1 and sum(c.isalpha() for c in s) >= 5
    words = re.findall(r"[^\W\d_]+", s)
    surname = any(len(w) >= 4 and w.lower() not in _FIRST for w in words)
    # A short surname counts beside a known first name.
    short = any(w.lower() in _FIRST for w in words) and any(len(w) >= 2 and w[0].isupper() and w.lower().rstrip(".") not in _FIRST | _TITLE for w in words)
    return (surname or short) and digits == 0


def find_spans(field: PrivateField, texts: list[str | None], least: dict[str, float] = LEAST) -> list[list[tuple[int, int, str]]]:
    """``(start, end, kind)`` of all personal spans of each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    live = [n for n, t in enumerate(texts) if t]
    if not live:
        return out
    tokens = [_TOKEN.findall(texts[n]) for n in live]
    owner, forms, emit = field.emissions(tokens)
    if not len(owner):
        return out
    first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    # Outlines are looked for where figures run on without a word between, or a word hints at them.
    digits = field.digits[forms]
    run = np.cumsum((digits == 0) & field.wordy[forms] | (np.diff(owner, prepend=owner[0]) != 0))
    long = np.bincount(run, digits) >= 7
    spelt = np.isin(forms, [field.at.get(w, -1) for w in ("at", "AT", "At")])
    spelt[1:] &= np.isin(forms[:-1], [field.at.get(w, -1) for w in "([{"])
    suspects = np.unique(owner[long[run] & (digits > 0) | field.hint[forms] | spelt])
    at: dict[int, tuple[list[int], list[int]]] = {}
    hits: list[tuple[int, int]] = []
    for k in suspects.tolist():
        _, starts, ends = _tokens(texts[live[k]])
        at[k] = starts, ends
        hits += [(first[k] + t, p) for t, p in outline_ids(texts[live[k]], starts)]
    if hits:
        hit = np.array(hits, np.int64)
        np.add.at(emit, hit[:, 0], field.patterns[hit[:, 1]])
    emit[field.set[forms]] = _NEVER  # citations and placeholders already set
    # Beyond a few words from any word that may be personal, messages change nothing: only these stretches are propagated.
    near = emit[:, 1:].max(1) > emit[:, 0] - SLACK
    reach = np.convolve(near, np.ones(2 * REACH + 1), "same")[: len(near)] > 0 if len(near) > 2 * REACH + 1 else np.full(len(near), near.any())
    # A skip edge carries further: the like words of the same text are taken in with their surroundings, and theirs.
    at_rare = np.flatnonzero(field.rare[forms])
    _, kin, times = np.unique(owner[at_rare] * (len(field.kin) + 1) + field.like[forms[at_rare]], return_inverse=True, return_counts=True)
    again = times[kin] > 1
    at_rare, kin = at_rare[again], kin[again]
    while True:
        inside = reach[at_rare]
        touched = np.zeros(len(times), bool)
        touched[kin[inside]] = True
        linked = at_rare[~inside & touched[kin]]
        if not len(linked):
            break
        for t in linked.tolist():
            reach[max(t - REACH, 0) : t + REACH + 1] = True
    kept = np.flatnonzero(reach)
    if not len(kept):
        return out
    p, _, _ = Graph(owner[kept], field.like[forms[kept]], field.rare[forms[kept]], kept).beliefs(emit[kept], field.move, field.skip)
    kind_of = 1 + p[:, 1:].argmax(1)
    tag = np.where(1 - p[:, 0] >= np.array([1.1, *(least[k] for k in KINDS[1:])])[kind_of], kind_of, 0)
    previous = -2
    for j in np.flatnonzero(tag).tolist():
        t = int(kept[j])
        k = int(owner[t])
        if k not in at:
            at[k] = _tokens(texts[live[k]])[1:]
        i, spans, kind = int(t - first[k]), out[live[k]], KINDS[tag[j]]
        starts, ends = at[k]
        if spans and previous == t - 1 and spans[-1][2] == kind:
            spans[-1] = (spans[-1][0], ends[i], kind)
        else:
            spans.append((starts[i], ends[i], kind))
        previous = t
    for k in at:
        n = live[k]
        out[n] = [s for s in out[n] if plausible(s[2], texts[n][s[0] : s[1]])]
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind's placeholder and all else untouched."""
    parts, at = [], 0
    for lo, hi, kind in spans:
        parts += [text[at:lo], PLACEHOLDER[kind]]
        at = hi
    return "".join([*parts, text[at:]])


def _run(shared, mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: PrivateField = shared.value
        for batch in batches:
            ids, texts = batch.column("row_id").to_pylist(), batch.column("text").to_pylist()
            spans = [s for lo in range(0, len(texts), 4000) for s in find_spans(field, texts[lo : lo + 4000])]
            kinds = [sorted({k for _, _, k in s}) for s in spans]
            clean = [masked(t, s) if t and s else t for t, s in zip(texts, spans)] if mask else [None] * len(texts)
            yield pa.record_batch([batch.column("field"), pa.array(ids, pa.int64()), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["field", "row_id", "text", "kinds"])

    return run


def private_data(rows: DataFrame, mask: bool = True, field: PrivateField | None = None) -> DataFrame:
    """``rows(field, row_id, text)``; returns ``(field, row_id, text, kinds)`` with the spans of ``text`` replaced.

    ``kinds`` lists what was found (empty where nothing was); with ``mask=False`` the text comes back null. A null
    text stays null; every row comes back once, repeated rows too. No shuffle at all.
    """
    spark = ready(rows.sparkSession)
    if field is None:
        field = fit_private()
    shared = spark.sparkContext.broadcast(field)
    return spread(rows.select("field", F.col("row_id").cast("long").alias("row_id"), "text")).mapInArrow(_run(shared, mask), "field string, row_id long, text string, kinds array<string>")
