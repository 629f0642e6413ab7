"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Items are dealt by hash into blocks of bounded size, and each block is evolved on several islands. A chromosome is a
set of bins. Crossover injects whole well-filled bins of one parent into another, drops the bins that now hold
duplicates, and best-fits the displaced items; mutation empties badly filled bins. Between epochs the elite of each
island migrates to the next island of its block. An island stops once no better number of bins is possible. Bins that
stay badly filled in their block are opened again, and their items go through another round of fewer blocks.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ready, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters handed to the tokenizer at a time; a longer text is cut after a blank, where the pattern cuts as well.
STRETCH = 200_000

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: str, encoder) -> int:
    """Tokens of the whole text."""
    if len(text) <= STRETCH:
        return len(encoder.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(at + STRETCH, len(text))
        if end < len(text):
            space = text.rfind(" ", at + STRETCH // 2, end)
            end = space if space > at else end
        n += len(encoder.encode_ordinary(text[at:end]))
        at = end
    return n


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)`` of every text that is not blank; repeated rows of an id count once. No shuffle but that."""
    ready(documents.sparkSession)
    path = os.path.join(tokenizers, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([token_count(t, encoder) for t in batch.column("text").to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    picked = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text RLIKE '(?U)\\\\S'")
    return spread(picked).mapInArrow(run, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class Packing:
    """One chromosome: the bin of each item, and the load of each bin."""

    __slots__ = ("bin", "load")

    def __init__(self, bin_: np.ndarray, load: np.ndarray) -> None:
        self.bin, self.load = bin_, load

    @classmethod
    def of(cls, bin_: np.ndarray, sizes: np.ndarray) -> "Packing":
        used, at = np.unique(bin_, return_inverse=True)
        return cls(at.astype(np.int32), np.bincount(at, sizes, len(used)).astype(np.int64))

    def fitness(self, capacity: int) -> float:
        return float(((self.load / capacity) ** 2).mean()) - len(self.load)


def best_fit(bin_: np.ndarray, load: list[int], items: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Put each item, in the order given, into the fullest bin that takes it, else into a new one."""
    room = sorted((capacity - w, b) for b, w in enumerate(load))
    for i in items.tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, len(load)
            load.append(0)
        bin_[i] = b
        load[b] += s
        bisect.insort(room, (left - s, b))
    return bin_, load


def _repaired(bin_: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Best-fit the items without a bin (-1), largest first with a little disorder."""
    kept = bin_ >= 0
    used, at = np.unique(bin_[kept], return_inverse=True)
    new = np.full(len(bin_), -1, np.int32)
    new[kept] = at
    load = np.bincount(at, sizes[kept], len(used)).astype(np.int64).tolist() if kept.any() else []
    free = np.flatnonzero(~kept)
    order = free[np.argsort(-sizes[free] * rng.uniform(0.9, 1.1, len(free)))]
    new, load = best_fit(new, load, order, sizes, capacity)
    return Packing(new, np.array(load, np.int64))


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with whole well-filled bins of ``b`` put in."""
    good = np.argsort(-b.load)[: max(1, len(b.load) // 2)]
    chosen = good[rng.random(len(good)) < 0.3]
    if not len(chosen):
        chosen = good[:1]
    injected = np.isin(b.bin, chosen)
    child = a.bin.astype(np.int32).copy()
    child[np.isin(a.bin, np.unique(a.bin[injected]))] = -1
    child[injected] = b.bin[injected] + len(a.load)
    return _repaired(child, sizes, capacity, rng)


def mutation(a: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with its worst bins and a few others emptied and filled anew."""
    worst = np.argsort(a.load)[: 1 + len(a.load) // 12]
    others = rng.choice(len(a.load), min(len(a.load), 2), replace=False)
    child = a.bin.astype(np.int32).copy()
    child[np.isin(a.bin, np.concatenate([worst, others]))] = -1
    return _repaired(child, sizes, capacity, rng)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray] = (), population: int = 8, generations: int = 24) -> tuple[Packing, bool]:
    """The best packing found, and whether its number of bins is the least possible."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    least = int(-(-int(sizes.sum()) // capacity))
    pool = [Packing.of(e, sizes) for e in elites]
    while len(pool) < population and not any(len(p.load) <= least for p in pool):
        # The first members are filled in falling order, with a little disorder; the others in any order.
        order = np.argsort(-sizes * (rng.uniform(0.8, 1.2, n) if len(pool) < 2 else 1)) if len(pool) < 3 else rng.permutation(n)
        b, load = best_fit(np.full(n, -1, np.int32), [], order, sizes, capacity)
        pool.append(Packing(b, np.array(load, np.int64)))
    key = lambda p: p.fitness(capacity)
    pool.sort(key=key, reverse=True)
    for _ in range(generations):
        if len(pool[0].load) <= least:
            break
        children = []
        for _ in range(population // 2):
            i, j = np.sort(rng.integers(0, len(pool), 2))
            child = crossover(pool[i], pool[j], sizes, capacity, rng)
            children.append(mutation(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        pool = sorted([*pool, *children], key=key, reverse=True)[:population]
    return pool[0], len(pool[0].load) <= least


_ISLAND = "block long, island int, ids array<string>, sizes array<int>, elite array<int>, fitness double, done boolean"


def _epoch(capacity: int, epoch: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                elites = [np.asarray(e, np.int32) for e in (r.elite, r.guest) if e is not None and len(e)]
                if r.done and elites:
                    best, done = Packing.of(elites[0], sizes), True
                else:
                    best, done = evolve(sizes, capacity, hash((seed, int(r.block), int(r.island), epoch)) & 0x7FFFFFFF, elites)
                out.append((r.block, r.island, list(r.ids), sizes.tolist(), best.bin.tolist(), best.fitness(capacity), done))
            yield pd.DataFrame(out, columns=["block", "island", "ids", "sizes", "elite", "fitness", "done"])

    return run


def _round(items: DataFrame, capacity: int, blocks: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """``items(item, size)`` to ``(item, size, block, bin, load)``."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)).cast("long"))
    # A block holds a bounded number of items by its making, so gathering it is safe.
    gathered = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("x"))
    start = gathered.select("block", F.transform("x", lambda s: s["item"]).alias("ids"), F.transform("x", lambda s: s["size"].cast("int")).alias("sizes"))
    none = F.lit(None).cast("array<int>")
    world = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select("block", "island", "ids", "sizes", none.alias("elite"), none.alias("guest"), F.lit(False).alias("done"))
    state = None
    for epoch in range(epochs):
        if state is not None:
            guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            world = state.join(guests, ["block", "island"]).select("block", "island", "ids", "sizes", "elite", "guest", "done")
        state = cut(world.repartition(F.col("block"), F.col("island")).mapInPandas(_epoch(capacity, epoch, seed), _ISLAND))
        if not state.groupBy("block").agg(F.max("done").alias("d")).where("NOT d").limit(1).count():
            break
    best = state.groupBy("block").agg(F.max_by(F.struct("ids", "sizes", "elite"), F.struct("fitness", -F.col("island"))).alias("b"))
    flat = best.select("block", F.explode(F.arrays_zip(F.col("b.ids").alias("item"), F.col("b.sizes").alias("size"), F.col("b.elite").alias("bin"))).alias("z")).select("block", "z.item", "z.size", "z.bin")
    loads = flat.groupBy("block", "bin").agg(F.sum("size").alias("load"))
    return flat.join(loads, ["block", "bin"]).select("item", "size", "block", "bin", "load")


def fill_containers(sizes: DataFrame, capacity: int = 4096, block_items: int = 1500, islands: int = 3, epochs: int = 3, rounds: int = 2, well_filled: float = 0.985, seed: int = 1) -> DataFrame:
    """``sizes(doc_id, tokens)`` to ``(doc_id, piece, pieces, tokens, container)``.

    Only a text larger than a container is divided: into full containers and a remainder, which is packed like any
    other item. Each container's tokens are at most ``capacity``. Texts without tokens get no row; an empty table
    gives an empty result. Equal input gives an equal result.
    """
    whole = sizes.where("tokens > 0").withColumn("pieces", F.ceil(F.col("tokens") / capacity).cast("int"))
    parts = whole.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    parts = cut(parts.select("doc_id", "piece", "pieces", F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("tokens") - (F.col("pieces") - 1) * capacity).cast("int").alias("size")).withColumn("item", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"))))
    out = parts.where(F.col("size") == capacity).select("item", F.concat(F.lit("full-"), "item").alias("container"))
    rest = parts.where(F.col("size") < capacity).select("item", "size")
    count = rest.count()
    for r in range(rounds):
        blocks = max(1, -(-count // block_items))
        packed = cut(_round(rest, capacity, blocks, islands, epochs, seed + r))
        last = r == rounds - 1 or blocks == 1
        good = packed if last else packed.where(F.col("load") >= F.lit(well_filled * capacity))
        out = out.unionByName(good.select("item", F.concat_ws("-", F.lit(f"r{r}"), F.col("block").cast("string"), F.col("bin").cast("string")).alias("container")))
        if last:
            break
        rest = packed.where(F.col("load") < F.lit(well_filled * capacity)).select("item", "size")
        count = rest.count()
        if not count:
            break
    return parts.join(out, "item").select("doc_id", "piece", "pieces", F.col("size").cast("long").alias("tokens"), "container")
