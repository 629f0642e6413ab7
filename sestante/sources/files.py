"""Documents and tables on files: a recursive scan with its gates, page readers, JSON lines."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read, and control files that are no documents at the top of a corpus.
SUFFIXES = ("pdf", "md", "txt", "docx")
CONTROL = ("manifest.yaml", "inventory.yaml", "README.md", "allowlist.json", "testers.json", ".gitkeep")
CHUNK_SCHEMA = "id string, text string, source string, tier string, lang string, section string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``(path, relative, suffix, content)`` of the documents below ``root``; control files and hidden paths are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", "^(?:file:)?/*" + base.lstrip("/").replace(".", r"\.") + "/", "")
    out = files.select("path", relative.alias("relative"), "content")
    top = F.size(F.split("relative", "/")) == 1
    return out.where(~(top & F.col("relative").isin(*CONTROL)) & ~F.col("relative").rlike(r"(^|/)\.")).withColumn("suffix", F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1)))


def read_pages(suffix: str, content: bytes) -> list[str]:
    """Text of each page; raises where the file cannot be read or its reader is not installed."""
    if suffix in ("md", "txt"):
        return [content.decode("utf-8-sig")]
    if suffix == "pdf":
        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    if suffix == "docx":
        from docx import Document
        from docx.table import Table

        lines = []
        for block in Document(io.BytesIO(content)).iter_inner_content():
            if isinstance(block, Table):
                for row in block.rows:
                    cells, seen = [], set()
                    for c in row.cells:
                        if id(c._tc) not in seen and c.text.strip():
                            cells.append(" ".join(c.text.split()))
                        seen.add(id(c._tc))
                    lines.append(" | ".join(cells))
            else:
                name = block.style.name if block.style is not None else ""
                level = 1 if name == "Title" else int(name[8:]) if name.startswith("Heading ") and name[8:].isdigit() else 0
                lines.append("#" * level + " " * bool(level) + block.text)
        return ["\n".join(lines)]
    raise ValueError(f"no reader for {suffix!r}")


def _pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for relative, suffix, content in zip(frame["relative"], frame["suffix"], frame["content"]):
            source = relative.rsplit("/", 1)[-1]
            try:
                out += [(source, n, text, None) for n, text in enumerate(read_pages(suffix, content), 1)]
            except Exception as problem:  # one bad file must not stop the others
                out.append((source, 0, None, f"{type(problem).__name__}: {problem}"[:200]))
        yield pd.DataFrame(out, columns=["source", "page_no", "text", "problem"])


def pages(files: DataFrame) -> DataFrame:
    """``(source, page_no, text, problem)``: unreadable files come back as one row with their problem."""
    return files.select("relative", "suffix", "content").mapInPandas(_pages, "source string, page_no int, text string, problem string")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; a broken line or a missing id or text raises when the rows are used."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "FAILFAST").json(path)
    sound = F.col("id").isNotNull() & F.col("text").isNotNull()
    return rows.withColumn("id", F.when(sound, F.col("id")).otherwise(F.raise_error(F.lit("a chunk without id or text"))))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks to JSON lines, nulls left out."""
    chunks.select("id", "text", "source", "tier", "lang", "section").write.mode("overwrite").json(path)
