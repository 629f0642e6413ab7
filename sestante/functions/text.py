"""Text functions as JVM column expressions: tokens, shingles, citations, footers, shortening."""

from __future__ import annotations

import unicodedata
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for keyword search, Italian then English, without accents.
STOPWORDS = (
    "a ad al alla alle allo agli ai anche che chi ci con cosa come da dal dalla dei del della delle dello degli di e ed gli ha ho i il in io la le lo ma mi "
    "ne nei nel nella non o per piu puo se si sia sono su sul sulla ti tra tu un una uno vi "
    "an and are at be by can do does for from how i in is it of on or the to what when where which who will with you your"
).split()
# Letters of the Latin blocks that decompose to one plain letter, and that letter: made by rule, not listed.
_PAIRS = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(d := [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]) == 1 and d[0] != c]
ACCENTED = "".join(c for c, _ in _PAIRS)
PLAIN = "".join(d for _, d in _PAIRS)
#: Fixed value: a number with its separators is one token, else a run of word characters.
TOKEN = r"\d+(?:[.,:/]\d+)*|[\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}_]+"
#: A bracketed citation, and the footer line between double underscores.
CITATION = r"\[([^\[\]]+#[^\[\]]+)\]"
FOOTER = r"(?s)\n\n(__[^\n]*__)\s*\z"


def tokens(text: Column) -> Column:
    """Search tokens: lower case, accents and stopwords dropped, longer words without their last vowel."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}", ""), ACCENTED, PLAIN)
    words = F.filter(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    trimmed = lambda w: F.when((F.length(w) > 4) & w.rlike("[aeio]$") & ~w.rlike("^[0-9]"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    return F.transform(words, trimmed)


def word_list(text: Column) -> Column:
    """Runs of word characters in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def cited_ids(text: Column) -> Column:
    """Ids in brackets, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)))


def without_citations(text: Column) -> Column:
    """The text without bracketed ids, blanks tidied."""
    bare = F.regexp_replace(text, r"\s*" + CITATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r" +([.,;:!?])", "$1"))


def footer(text: Column) -> Column:
    """The footer line, or an empty string."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), FOOTER, 1)


def body(text: Column) -> Column:
    """The text without its footer line."""
    return F.regexp_replace(text, FOOTER, "")


def source_of(chunk_id: Column) -> Column:
    """The document of a chunk id: all before its last ``#``."""
    return F.regexp_replace(chunk_id, "#[^#]*$", "")


def shorten(text: Column, limit: int) -> Column:
    """White space collapsed, then at most ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def truncate(text: Column, limit: int = 1200) -> Column:
    """At most ``limit`` characters, cut after the last full sentence of the second half, else where the limit falls."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)\A(.*[.!?])\s", 1)
    cut = F.when(F.length(sentence) > limit // 2, sentence).otherwise(F.rtrim(head))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(" …"))).otherwise(text)


def slug(text: Column) -> Column:
    """Runs of other than word characters become one hyphen; a default word where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Letters that a line needs, and the share of capitals above which it counts as written in capitals.
UPPER_LETTERS, UPPER_SHARE = 3, 0.85


def is_upper(line: Column) -> Column:
    """Three letters or more, over 85 % of them capitals."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    return (letters >= UPPER_LETTERS) & (F.regexp_count(line, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1)) > UPPER_SHARE)


def in_capitals(line: str) -> bool:
    """``is_upper`` of one line, for the folds over the lines of a document."""
    kinds = Counter(unicodedata.category(c) for c in line)
    letters = sum(n for kind, n in kinds.items() if kind[0] == "L")
    return letters >= UPPER_LETTERS and kinds["Lu"] > UPPER_SHARE * letters


def end_of(text: Column, limit: int) -> Column:
    """The text, or where it is longer than ``limit`` an ellipsis and its end."""
    return F.when(F.length(text) > limit, F.concat(F.lit("…"), F.ltrim(F.substring(text, -(limit - 1), limit - 1)))).otherwise(text)
