"""Cutting oversized texts at natural boundaries, wholly in SQL expressions.

One regular expression with bounded quantifiers eats the text piece by piece: its alternatives are ordered by
boundary strength (line end, sentence end, blank, any character); each takes as much as leaves room for the overlap
and, failing that, as much as the limit allows, so that no line or sentence within the limit is cut for the sake of the
overlap. Positions are then running sums over the array of bodies, and overlaps are look-backs from those positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles longer than this are shortened to their end before they are repeated.
TITLE_LIMIT = 200

#: Boundaries from the strongest to the weakest.
CUTS = ("line", "sentence", "word", "hard")


def _alternatives(limit: int) -> str:
    """The regular expression, with ``%1$d`` for the characters of a body that leave room for title and overlap."""
    line, sentence, word = r"(?:(?<=\n)|(?=\n)|\z)", r"(?<=[.!?])(?=\s)", r"(?=\s)"
    sizes = (f"1,{limit}", "1,%1$d")
    strong = "|".join(f".{{{size}}}{end}" for end in (line, sentence, word) for size in reversed(sizes))
    # Blanks before a body belong to no piece.
    return rf"(?s)\s*(?:(?=\S)(?:{strong}|.{{1,%1$d}})|\z)"


def split_items(rows: DataFrame, id_col: str = "id", text_col: str = "text", title_col: str | None = "section", limit: int = 1400, overlap: int = 150) -> DataFrame:
    """Pieces of every row whose text has more than ``limit`` characters (code points).

    Returns ``(chunk_id, piece_no, n_pieces, piece, start, body_chars, overlap_chars, cut, finest_cut)``. A piece is
    the title line (from the second piece on, if the row has a title and there is room), the overlap and the body;
    together they have at most ``limit`` characters. ``start`` is the body's offset in the text; bodies in order give
    the text back but for blanks between them. ``cut`` is the boundary at which the piece ends, from the alternative that
    matched, and ``finest_cut`` the weakest of the row's. The overlap repeats up to ``overlap`` characters from the end of
    what came before, starting at a word where there is one; it shrinks where the body needs the room.
    Null texts, texts within the limit and texts of blanks alone give no row; a null or blank title counts as none;
    repeated rows (same id and text) are cut once; a null id is kept as null. No shuffle but that of the repeats.
    """
    text = F.col("text")
    title = F.trim(F.coalesce(F.col(title_col), F.lit(""))) if title_col else F.lit("")
    title = F.when(F.length(title) > TITLE_LIMIT, F.concat(F.lit("…"), F.ltrim(F.substring(title, -(TITLE_LIMIT - 1), TITLE_LIMIT - 1)))).otherwise(title)
    head = F.when(title == "", F.lit("")).otherwise(F.concat(title, F.lit("\n")))
    big = (
        rows.where(F.length(text_col) > limit)
        .select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"), head.alias("head"))
        .groupBy("chunk_id", "text")
        .agg(F.min("head").alias("head"))
        .withColumn("room", F.greatest(F.lit(1), F.lit(limit - overlap) - F.length("head")))
    )
    matched = F.regexp_extract_all("text", F.format_string(_alternatives(limit), "room"), F.lit(0))
    cut = big.withColumn("raw", F.filter(matched, lambda x: F.length(x) > 0))
    ends = F.aggregate("raw", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    cut = cut.withColumn("ends", ends)
    after = F.transform("raw", lambda x, i: F.substr("text", F.element_at("ends", i + 2) + 1, F.lit(1)))
    body = F.transform("raw", lambda x: F.regexp_extract(x, r"(?s)\A\s*(.*)\z", 1))

    def kind(x, following):
        return (
            F.when((following == "") | following.startswith("\n") | x.endswith("\n"), 0)
            .when(x.rlike(r"[.!?]\z") & following.rlike(r"\s"), 1)
            .when(following.rlike(r"\s"), 2)
            .otherwise(3)
        )

    cut = cut.withColumn("kinds", F.zip_with("raw", after, kind)).withColumn("bodies", body)
    names = F.array(*[F.lit(c) for c in CUTS])
    # A last body of blanks alone is no piece.
    cut = cut.withColumn("n_pieces", F.size(F.filter("bodies", lambda x: F.length(x) > 0)).cast("int")).where("n_pieces > 0")
    cut = cut.withColumn("finest_cut", F.element_at(names, F.array_max("kinds") + 1))
    flat = cut.select("chunk_id", "text", "head", "ends", "kinds", "finest_cut", "n_pieces", F.posexplode("bodies").alias("at", "body")).where("body <> ''")
    start = F.element_at("ends", F.col("at") + 2) - F.length("body")
    head = F.when((F.col("at") > 0) & (F.length("head") + F.length("body") <= limit), F.col("head")).otherwise("")
    flat = flat.withColumn("start", start).withColumn("head", head)
    # The overlap reaches back over the piece before and ends where this body begins.
    before = F.when(F.col("at") > 0, F.col("start") - F.element_at("ends", F.greatest(F.col("at"), F.lit(1)))).otherwise(0)
    back = F.greatest(F.lit(0), F.least(F.lit(overlap), before, F.lit(limit) - F.length("head") - F.length("body")))
    flat = flat.withColumn("back", back)
    taken = F.substr("text", F.col("start") - F.col("back") + 1, F.col("back"))
    edge = F.substr("text", F.col("start") - F.col("back"), F.lit(1))
    # Inside a word, skip to the next word's start; a stretch without blanks is repeated as it is.
    whole = F.regexp_extract(taken, r"(?s)\A\S*\s+(\S.*)\z", 1)
    same_as_head = (F.col("head") != "") & (F.trim(taken) == F.trim(F.regexp_replace("head", "\n", " ")))
    lap = F.when((F.col("at") == 0) | same_as_head | (F.trim(F.regexp_replace(taken, r"\s+", "")) == ""), "").when((F.col("start") == F.col("back")) | edge.rlike(r"\A\s\z") | (whole == ""), taken).otherwise(whole)
    out = flat.withColumn("lap", lap)
    return out.select(
        "chunk_id",
        (F.col("at") + 1).alias("piece_no"),
        "n_pieces",
        F.concat("head", "lap", "body").alias("piece"),
        F.col("start").cast("int").alias("start"),
        F.length("body").alias("body_chars"),
        F.length("lap").alias("overlap_chars"),
        F.when(F.col("at") + 1 == F.col("n_pieces"), "end").otherwise(F.element_at(names, F.element_at("kinds", F.col("at") + 1) + 1)).alias("cut"),
        "finest_cut",
    )
