"""Keyword, vector and fused ranking of a batch of queries over the rows each asker may see."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.tiers import TIERS, tier_rank
from ..session import cut

#: Fixed values of the keyword score and of the fusion.
K1, B = 1.5, 0.75
FUSE_K, KEYWORD_WEIGHT, EVIDENCE = 2, 0.5, 5
#: Query vectors and row vectors of a block, about; more are taken in further blocks.
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536
#: Keyword search: rows of a block of postings (under 2^16) and rankings of a block; rows whose best score is taken together.
POSTING_BLOCK, FORM_BLOCK, GROUP = 32_768, 16_384, 64
#: Scores held at a time, about: what stays in a core's cache.
SCORES = 1 << 17


def corpus(chunks: DataFrame) -> DataFrame:
    """Distinct chunks with their number inside the document; the order ``(source, n, id)`` breaks all ties."""
    n = F.expr("try_cast(regexp_extract(id, '#([0-9]+)$', 1) AS int)")
    return chunks.where("id IS NOT NULL").select("id", "text", "source", "tier", "lang", "section").dropDuplicates(["id"]).withColumn("n", F.coalesce(n, F.lit(0)))


def postings(rows: DataFrame) -> DataFrame:
    """``(id, source, n, rank, term, tf, dl)``: one row per chunk and term."""
    counted = rows.select("id", "source", "n", tier_rank(F.col("tier")).alias("rank"), tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))
    return counted.select("id", "source", "n", "rank", "dl", F.explode("ts").alias("term")).groupBy("id", "source", "n", "rank", "dl", "term").agg(F.count("*").alias("tf"))


def keyword_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 of every query ``(qid, question, tier)`` over the rows visible to its tier, in one job, unranked.

    Statistics (rows, mean length, document frequency) are over visible rows only, and are kept per tier: three
    aggregates of the postings, whatever the number of queries. Postings are cut to the queries' terms before they
    meet the queries, so frequent terms that nobody asks for are never shuffled to the join. Returns ``(qid, id,
    source, n, score)`` of the rows that share a term; a query of an unknown tier sees nothing.
    """
    asked = queries.select("qid", tier_rank(F.col("tier")).alias("caller"), F.explode(F.array_distinct(tokens(F.col("question")))).alias("term")).where("caller IS NOT NULL")
    callers = F.explode(F.sequence(F.col("rank"), F.lit(len(TIERS) - 1)))
    seen = rows.select(tier_rank(F.col("tier")).alias("rank"), F.size(tokens(F.col("text"))).alias("dl")).where("rank IS NOT NULL")
    stats = seen.select("dl", callers.alias("caller")).groupBy("caller").agg(F.count("*").alias("rows_n"), F.avg("dl").alias("mean_dl"))
    wanted = asked.select("term").distinct()
    entries = postings(rows.where(tier_rank(F.col("tier")).isNotNull())).join(wanted, "term", "left_semi")
    df = entries.select("term", callers.alias("caller")).groupBy("term", "caller").agg(F.count("*").alias("df"))
    weighted = asked.join(df, ["term", "caller"]).join(F.broadcast(stats), "caller")  # stats: three rows
    hits = weighted.join(entries, "term").where("rank <= caller")
    idf = F.log(1 + (F.col("rows_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("mean_dl"))
    return hits.groupBy("qid", "id", "source", "n").agg(F.round(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)), 6).alias("score"))


def keyword_ranking(rows: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """The scores of ``keyword_scores`` ranked: ``(qid, id, source, n, score, position)``, best first, ties in corpus order."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "source", "n", "id")
    ranked = keyword_scores(rows, queries).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k) if k else ranked


def _hashes(text) -> Column:
    """The tokens' 64-bit hashes."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


_HEAD = "array<struct<id:string,source:string,n:int,rank:int>>"
_PACKED = f"ids array<string>, sources array<string>, ns array<int>, ranks binary, dl binary, terms binary, starts binary, at binary, tf binary, heads {_HEAD}"


def _packed(k: int):
    """Blocks of rows as postings sorted by term; rows are numbered in corpus order, ``heads`` are the first ``2 k`` of each tier."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids, sources, ns = (rows.column(c).to_pylist() for c in ("id", "source", "n"))
        order = sorted(range(len(ids)), key=lambda i: (sources[i] is not None, sources[i] or "", ns[i], ids[i]))
        rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
        ids, sources, ns = ([x[i] for i in order] for x in (ids, sources, ns))
        ranks = rows.column("rank").to_numpy().astype(np.uint8)
        terms = rows.column("terms").combine_chunks()
        dl = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, owner = terms.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), dl)
        by = np.lexsort((owner, flat))
        flat, owner = flat[by], owner[by]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        tf = np.diff(np.concatenate([first, [len(flat)]]))
        term, at = flat[first], owner[first]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        heads = sorted({int(i) for caller in range(len(TIERS)) for i in np.flatnonzero(ranks <= caller)[: 2 * k]})
        held = [{"id": ids[i], "source": sources[i], "n": ns[i], "rank": int(ranks[i])} for i in heads]
        small = lambda x: [zlib.compress(x.tobytes(), 1)]
        columns = [pa.array([ids], pa.list_(pa.string())), pa.array([sources], pa.list_(pa.string())), pa.array([ns], pa.list_(pa.int32()))]
        columns += [pa.array(small(x), pa.binary()) for x in (ranks, dl.astype(np.int32), term[starts], np.append(starts, len(term)), at.astype(np.uint16), tf.astype(np.int32))]
        head = pa.struct([("id", pa.string()), ("source", pa.string()), ("n", pa.int32()), ("rank", pa.int32())])
        return pa.record_batch([*columns, pa.array([held], pa.list_(head))], names=["ids", "sources", "ns", "ranks", "dl", "terms", "starts", "at", "tf", "heads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, POSTING_BLOCK - held), batch.slice(POSTING_BLOCK - held)
                waiting.append(part)
                held += part.num_rows
                if held == POSTING_BLOCK:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if held:
            yield block(pa.Table.from_batches(waiting))

    return run


_KINDS = {"ranks": np.uint8, "dl": np.int32, "terms": np.int64, "starts": np.int64, "at": np.uint16, "tf": np.int32}


def _unpacked(batch: pa.RecordBatch, row: int, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(batch.column(c)[row].as_py()), _KINDS[c]) for c in names]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each tier a block has for each term; without a term, rows of each tier and their lengths."""
    for batch in batches:
        for row in range(batch.num_rows):
            ranks, dl, terms, starts, at = _unpacked(batch, row, ("ranks", "dl", "terms", "starts", "at"))
            for rank in np.unique(ranks).tolist():
                own = np.concatenate([[0], np.cumsum(ranks[at] == rank)])
                count = own[starts[1:]] - own[starts[:-1]]
                held = count > 0
                n, total = int((ranks == rank).sum()), int(dl[ranks == rank].sum())
                yield pa.record_batch([pa.array([None, *terms[held].tolist()], pa.int64()), pa.array([rank] * (1 + int(held.sum())), pa.int32()), pa.array([n, *count[held].tolist()], pa.int64()), pa.array([total] + [0] * int(held.sum()), pa.int64())], names=["term", "rank", "c", "length"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted terms of a partition's rankings, sorted by ranking, as one row."""
    rows = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is not None:
        yield pa.record_batch([pa.array([rows.column(c).to_numpy().tobytes()], pa.binary()) for c in ("form", "caller", "mean_dl", "term", "idf")], names=["form", "caller", "mean_dl", "term", "idf"])


def _best(k: int):
    """The ``k`` best rows of a block for each ranking; ties go by the rows' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch, row)

    def one(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        ranks, dl, terms, starts, at, tf = _unpacked(batch, row, tuple(_KINDS))
        form, caller, mean, term, idf = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("form", np.int64), ("caller", np.int32), ("mean_dl", np.float64), ("term", np.int64), ("idf", np.float64)))
        at = at.astype(np.intp)
        place = np.searchsorted(terms, term)
        ok = place < len(terms)
        ok[ok] = terms[place[ok]] == term[ok]
        form, caller, mean, place, idf = form[ok], caller[ok], mean[ok], place[ok], idf[ok]
        low, high = starts[place].tolist(), starts[place + 1].tolist()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(form)) + 1, [len(form)]]) if len(form) else np.zeros(1, np.int64)
        width = -(-len(ranks) // GROUP) * GROUP
        groups, step = width // GROUP, max(1, SCORES // max(1, width))
        score = np.zeros((step, width))
        weights: dict[int, np.ndarray] = {}
        which, places, values = [], [], []
        by, factor = cuts.tolist(), idf.tolist()
        for lo in range(0, len(by) - 1, step):
            own = by[lo : lo + step + 1]
            part = score[: len(own) - 1]
            part.fill(0.0)
            for line, a, b in zip(part, own[:-1], own[1:]):
                c = int(caller[a])
                if c not in weights:
                    weights[c] = np.where(ranks[at] <= c, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / mean[a])), 0.0)
                w = weights[c]
                for i in range(a, b):
                    line[at[low[i] : high[i]]] += factor[i] * w[low[i] : high[i]]
            # At least k rows reach the k-th of the groups' best scores; rows that round to the same stay in.
            least = np.zeros(len(part)) if groups < k else np.partition(part.reshape(-1, groups, GROUP).max(2), groups - k, axis=1)[:, groups - k] - 2e-6
            f, near = np.nonzero(part >= np.where(least > 0, least, 5e-324)[:, None])
            said = np.floor(part[f, near] * 1e6 + 0.5) / 1e6
            top = np.lexsort((near, -said, f))
            f = f[top]
            kept = np.arange(len(f)) - np.searchsorted(f, f) < k
            which.append(form[np.array(own[:-1], np.int64)][f[kept]])
            places.append(near[top][kept])
            values.append(said[top][kept])
        which, places, values = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((which, np.int64), (places, np.int64), (values, np.float64)))
        take = pa.array(places)
        names = [batch.column(c).slice(row, 1).flatten().take(take) for c in ("ids", "sources", "ns")]
        return pa.record_batch([pa.array(which), *names, pa.array(values)], names=["form", "id", "source", "n", "score"])

    return run


def keyword_search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, id, score, position)``: the ``k`` best visible rows of each query, those without a common term last.

    The ranking is that of ``keyword_ranking``, but no pair of query and row is ever shuffled. Rows are packed once into
    blocks of postings (terms by 64-bit hash); queries of one tier with the same terms have one ranking; each pair of a
    block of rows and a block of rankings is scored in one task, of which only the best ``k`` rows of a ranking leave.

    Rows without a common term score 0 and stand in corpus order, so a query of a known tier gets ``k`` rows if it may see
    as many. Only the first ``2 k`` rows of the corpus order are looked at for them, tier by tier: at most ``k`` of
    these can be hits already.
    """
    terms = F.array_sort(F.array_distinct(_hashes(F.col("question"))))
    asked = cut(queries.select("qid", tier_rank(F.col("tier")).alias("caller"), terms.alias("terms")).where("caller IS NOT NULL").distinct())
    forms = cut(asked.select("caller", "terms").distinct().select(F.monotonically_increasing_id().alias("form"), "caller", "terms"))
    ranked = rows.select("id", "source", "n", tier_rank(F.col("tier")).alias("rank"), _hashes(F.col("text")).alias("terms")).where("rank IS NOT NULL")
    packed = cut(ranked.mapInArrow(_packed(k), _PACKED))
    counts = packed.select("ranks", "dl", "terms", "starts", "at").mapInArrow(_counted, "term long, rank int, c long, length long")
    callers = F.explode(F.sequence(F.col("rank"), F.lit(len(TIERS) - 1)))
    stats = counts.where("term IS NULL").select("c", "length", callers.alias("caller")).groupBy("caller").agg(F.sum("c").alias("rows_n"), (F.sum("length") / F.sum("c")).alias("mean_dl"))
    df = counts.where("term IS NOT NULL").groupBy("term", "rank").agg(F.sum("c").alias("c"))
    wanted = forms.select("form", "caller", F.explode("terms").alias("term"))
    seen = wanted.join(df, "term").where("rank <= caller").groupBy("form", "caller", "term").agg(F.sum("c").alias("df")).join(F.broadcast(stats), "caller")  # stats: three rows
    idf = F.log(1 + (F.col("rows_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    blocks = max(1, -(-forms.count() // FORM_BLOCK))
    weighted = seen.select("form", "caller", "mean_dl", "term", idf.alias("idf")).repartition(blocks, "form").sortWithinPartitions("form", "term")
    together = cut(weighted.mapInArrow(_together, "form binary, caller binary, mean_dl binary, term binary, idf binary"))
    pairs = packed.drop("heads").hint("shuffle_replicate_nl").crossJoin(together)
    order = Window.partitionBy("form").orderBy(F.desc("score"), "source", "n", "id")
    best = pairs.mapInArrow(_best(k), "form long, id string, source string, n int, score double").withColumn("position", F.row_number().over(order))
    hits = cut(best.where(F.col("position") <= k).select("form", "id", "score", "position"))
    heads = packed.select(F.explode("heads").alias("h")).select("h.*")
    first = None
    for caller in range(len(TIERS)):
        part = heads.where(F.col("rank") <= caller).orderBy("source", "n", "id").limit(2 * k).select(F.lit(caller).alias("caller"), "id", "source", "n")
        first = part if first is None else first.unionAll(part)
    found = hits.groupBy("form").agg(F.count("*").cast("int").alias("found"))
    short = forms.select("form", "caller").join(found, "form", "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") < k)
    rest = short.join(F.broadcast(first), "caller").join(hits.select("form", "id"), ["form", "id"], "left_anti")
    rest = rest.withColumn("at", F.row_number().over(Window.partitionBy("form").orderBy("source", "n", "id"))).where(F.col("found") + F.col("at") <= k)
    filled = rest.select("form", "id", F.lit(0.0).alias("score"), (F.col("found") + F.col("at")).cast("int").alias("position"))
    numbered = asked.join(forms, ["caller", "terms"]).select("qid", "form")
    return numbered.join(hits.unionByName(filled), "form").select("qid", "id", "score", "position")


def _block_top(k: int):
    def run(_: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "vec_id": [], "score": []}).astype({"qid": "int64", "vec_id": "int64"})
        if not len(asked) or not len(rows):
            return empty
        q, x = (np.array(v.tolist(), np.float64).reshape(len(v), -1) for v in (asked["vector"], rows["place"]))
        at, ids = rows["id"].to_numpy(), asked["qid"].to_numpy()
        score = np.round(q @ x.T, 6)
        # Rows that the asker may not see are out before anything is ranked.
        score[rows["rank"].to_numpy()[None, :] > asked["caller"].to_numpy()[:, None]] = -np.inf
        order = np.lexsort((np.broadcast_to(at, score.shape), -score), axis=1)[:, :k]
        out = pd.DataFrame({"qid": np.repeat(ids, order.shape[1]), "vec_id": at[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})
        return out[np.isfinite(out["score"])]

    return run


def vector_ranking(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest visible ``vectors(vec_id, embedding, tier)`` of each of ``queries(vec_id, embedding, tier)``.

    Nearness is the dot product, ties go by id. Rows and queries are cut into blocks of bounded size by a hash of their
    ids; each pair of blocks is one matrix product in one task, of which only the best ``k`` of a query leave. Nothing
    goes through the driver but the two counts. Without a ``tier`` column all rows are public. Rows and queries with a null id
    or vector and rows or queries of an unknown tier are left out. Returns ``(qid, vec_id, score, position)``.
    """
    tier = lambda df: tier_rank(F.col("tier")) if "tier" in df.columns else F.lit(0)
    rows = vectors.select("vec_id", "embedding", tier(vectors).alias("rank")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND rank IS NOT NULL")
    asked = queries.select("vec_id", "embedding", tier(queries).alias("caller")).where("vec_id IS NOT NULL AND embedding IS NOT NULL AND caller IS NOT NULL")
    nr, nq = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(block(nq).alias("b"), every(nr).alias("g"), F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "caller")
    right = rows.select(every(nq).alias("b"), block(nr).alias("g"), F.col("vec_id").alias("id"), F.col("embedding").alias("place"), "rank")
    best = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(_block_top(k), "qid long, vec_id long, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def fuse(first: DataFrame, second: DataFrame, weight: float = KEYWORD_WEIGHT, k: int = FUSE_K, evidence: int = EVIDENCE) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings ``(qid, id, score, position)``, with the rescue.

    The second ranking counts only where its score is above 0 and the row is among the first ``evidence`` of the
    first one; positions are then counted anew. If the best row of the second ranking is missing from the first
    ``evidence`` fused rows and there are more, it takes the last of these places. Returns ``(qid, id, score, position)``.
    """
    top = first.where(F.col("position") <= evidence).select("qid", "id")
    w = Window.partitionBy("qid").orderBy("position")
    kept = second.where("score > 0").join(top, ["qid", "id"], "left_semi").withColumn("position", F.row_number().over(w))
    parts = first.select("qid", "id", (F.lit(1.0) / (k + F.col("position"))).alias("s"), "position").unionAll(kept.select("qid", "id", (F.lit(weight) / (k + F.col("position"))).alias("s"), F.lit(None).cast("int")))
    fused = parts.groupBy("qid", "id").agg(F.round(F.sum("s"), 12).alias("score"), F.min("position").alias("corpus"))
    fused = fused.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "corpus", "id")))
    best = second.where("score > 0").groupBy("qid").agg(F.min_by("id", "position").alias("best"))
    size = fused.groupBy("qid").agg(F.count("*").alias("size"))
    at = fused.join(best, "qid").where("id = best").select("qid", F.col("position").alias("best_at"))
    moved = fused.join(size, "qid").join(at, "qid", "left")
    rescue = (F.col("best_at") > evidence) & (F.col("size") > evidence)
    place = F.when(rescue & (F.col("position") == F.col("best_at")), evidence).when(rescue & (F.col("position") >= evidence) & (F.col("position") < F.col("best_at")), F.col("position") + 1).otherwise(F.col("position"))
    placed = moved.select("qid", "id", place.cast("int").alias("position"))
    return placed.join(fused.select("qid", "score", "position"), ["qid", "position"]).select("qid", "id", "score", "position")


def fused_top(vectors: DataFrame, queries: DataFrame, second: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """The first ``evidence`` rows of the fusion of the whole vector ranking with ``second(qid, id, score)``.

    Only the first ``evidence`` rows and the best row of ``second`` can stand there, wherever that one lies in the
    vector ranking. So the ranking is cut one row later, which tells that it is longer, and the best row of ``second``
    is added behind if it has a vector: its own place beyond the cut changes nothing above. ``second`` is likewise cut to
    these rows before it is ranked, so that no query's hits are sorted as a whole; its ties go by ``source``, ``n`` (where
    given) and ``id``.
    """
    first = vector_ranking(vectors, queries, evidence + 1).select("qid", F.col("vec_id").alias("id"), "score", "position")
    ties = [c for c in ("source", "n", "id") if c in second.columns]
    best = second.where("score > 0").groupBy("qid").agg(F.max("score").alias("top"))
    best = second.join(best, "qid").where("score = top").groupBy("qid").agg(F.min(F.struct(*ties)).alias("s")).select("qid", "s.id")
    held = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"))
    asked = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("qid"))
    deep = best.join(held, "id", "left_semi").join(asked, "qid", "left_semi").join(first, ["qid", "id"], "left_anti")
    whole = first.unionByName(deep.select("qid", "id", F.lit(None).cast("double").alias("score"), F.lit(evidence + 2).alias("position")))
    near = second.join(first.where(F.col("position") <= evidence).select("qid", "id").unionByName(best).distinct(), ["qid", "id"], "left_semi")
    ranked = near.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *ties)))
    return fuse(whole, ranked.select("qid", "id", "score", "position"), evidence=evidence).where(F.col("position") <= evidence)


def asserted(hits: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The same hits, or an error if any of them may not be seen by its asker: the last check after every ranking."""
    checked = hits.join(rows.select("id", tier_rank(F.col("tier")).alias("_rank")), "id", "left").join(queries.select("qid", tier_rank(F.col("tier")).alias("_caller")), "qid", "left")
    good = F.coalesce(F.col("_rank") <= F.col("_caller"), F.lit(False))
    return checked.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.lit("a hit that its asker may not see")).cast(dict(hits.dtypes)["id"]))).select(*hits.columns)


METHODS = ("keyword", "vector", "hybrid")


def search(rows: DataFrame, queries: DataFrame, method: str = "hybrid", k: int = EVIDENCE, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score, position)``: the ``k`` best rows of each of ``queries(qid, question, tier)`` that its asker may see.

    ``vectors(id, embedding)`` and ``query_vectors(qid, embedding)`` hold the embeddings; without them every method is the
    keyword one. ``hybrid`` gives at most the ``EVIDENCE`` rows for which it is defined. An unknown method or ``k`` under 1
    is refused before anything is read, a query of an unknown tier gets nothing, and a hit above its asker's tier raises.
    """
    if method not in METHODS or k < 1:
        raise ValueError(f"method must be one of {', '.join(METHODS)} and k at least 1")
    if method == "keyword" or vectors is None or query_vectors is None:
        return asserted(keyword_search(rows, queries, k), rows, queries)
    # Vector ids are numbers: ids stand under their 64-bit hash there.
    number = rows.select("id", "tier", F.xxhash64("id").alias("vec_id"))
    asked = queries.select("qid", "tier", F.xxhash64("qid").alias("q"))
    v = vectors.join(number, "id").select("vec_id", "embedding", "tier")
    q = query_vectors.join(asked, "qid").select(F.col("q").alias("vec_id"), "embedding", "tier")
    if method == "vector":
        found = vector_ranking(v, q, k).select(F.col("qid").alias("q"), "vec_id", "score", "position")
    else:
        second = keyword_scores(rows, queries).join(asked.select("qid", "q"), "qid").select(F.col("q").alias("qid"), F.xxhash64("id").alias("id"), "source", "n", "score")
        found = fused_top(v, q, second).where(F.col("position") <= k).select(F.col("qid").alias("q"), F.col("id").alias("vec_id"), "score", "position")
    out = found.join(number.select("vec_id", "id"), "vec_id").join(asked.select("q", "qid"), "q").select("qid", "id", "score", "position")
    return asserted(out, rows, queries)
