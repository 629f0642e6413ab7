"""The vector index: embeddings by a replaceable function, kept in step with the corpus by row hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import fingerprint

#: An embedding model: texts in, one vector a text out.
Embedder = Callable[[list[str]], np.ndarray]
#: What models of the e5 family want before a text.
PREFIXES = {"query": "query: ", "passage": "passage: "}


def hashed_embedder(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashes of the words, summed."""
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 40 & 1 else -1
    return out


def _embedded(model: Embedder, prefix: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = np.asarray(model([prefix + t for t in frame["text"]]), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield frame[["id"]].assign(embedding=list(v))

    return run


def embed(rows: DataFrame, model: Embedder = hashed_embedder, kind: str = "passage", model_name: str = "") -> DataFrame:
    """``(id, embedding)`` of unit length of ``rows(id, text)``; models named e5 get their prefix. Null texts are left out."""
    prefix = PREFIXES[kind] if "e5" in model_name.lower() else ""
    return rows.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("string").alias("id"), "text").mapInPandas(_embedded(model, prefix), "id string, embedding array<float>")


def _row_hash(model_name: str):
    return F.xxhash64(F.lit(model_name), "id", F.coalesce("text", F.lit("")))


def read_index(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame | None:
    """``(id, embedding, hash)`` of the index at ``path``; null where there is none or its fingerprint is another one.

    The meta row is written last, so an index without one was never finished and does not count.
    """
    try:
        meta = spark.read.parquet(f"{path}/meta").orderBy(F.desc("version")).first()
    except AnalysisException:
        return None
    if meta is None or (wanted is not None and meta["fingerprint"] != wanted):
        return None
    return spark.read.parquet(f"{path}/vectors-{meta['version']}")


def build_index(chunks: DataFrame, path: str, model: Embedder = hashed_embedder, model_name: str = "hashed", force: bool = False) -> DataFrame:
    """The index of ``chunks(id, text)`` at ``path``, read back.

    With an equal fingerprint nothing is done. Otherwise only rows whose hash is new are embedded, the others' vectors are
    taken over, and rows that are gone are left out. Vectors first, then the meta row ``(version, fingerprint, model, n_chunks)``.
    Neither tier nor text is kept beside a vector.
    """
    spark = chunks.sparkSession
    rows = chunks.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text").dropDuplicates(["id"])
    mark = fingerprint(rows, model_name).first()
    if not force and (known := read_index(spark, path, mark["fingerprint"])) is not None:
        return known
    wanted = rows.withColumn("hash", _row_hash(model_name))
    old = None if force else read_index(spark, path)
    if old is None:
        vectors = embed(wanted, model, "passage", model_name).join(wanted.select("id", "hash"), "id")
    else:
        kept = old.join(wanted.select("id", "hash"), ["id", "hash"], "left_semi")
        fresh = wanted.join(old.select("id", "hash"), ["id", "hash"], "left_anti")
        vectors = kept.unionByName(embed(fresh, model, "passage", model_name).join(fresh.select("id", "hash"), "id").select(*kept.columns))
    try:
        version = (spark.read.parquet(f"{path}/meta").agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException:
        version = 1
    vectors.select("id", "embedding", "hash").write.mode("overwrite").parquet(f"{path}/vectors-{version}")
    spark.createDataFrame([(version, mark["fingerprint"], model_name, mark["chunks"])], "version int, fingerprint string, model string, n_chunks long").write.mode("append").parquet(f"{path}/meta")
    return spark.read.parquet(f"{path}/vectors-{version}")


def warmed(*frames: DataFrame) -> int:
    """The frames cached and counted, so that the first question finds them in memory."""
    return sum(f.cache().count() for f in frames)
