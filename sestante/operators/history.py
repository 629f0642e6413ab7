"""The history of retrieval runs: appended rows, old ones filled in, the current run, verdicts and shades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "struct<id:string,question:string,tier:string,expect:string,scored:boolean,rank:int,doc_rank:int,top:array<struct<id:string,score:double>>>"
RUN = f"seq long, label string, at string, questions string, chunks int, corpus string, model string, method string, n_scored int, piece_1st double, piece_top3 double, piece_top5 double, mrr double, doc_1st double, leaks int, ms_max double, rows array<{ROW}>"


def append_runs(runs: DataFrame, path: str) -> None:
    """Runs added to the history; ``seq`` numbers appended rows across calls."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All runs of several files. Old ones lack ``corpus`` and ``piece_top5``: these follow from the rest of the row."""
    runs = spark.read.schema(RUN).json(paths)
    scored = F.filter("rows", lambda r: r["scored"])
    five = F.size(F.filter(scored, lambda r: r["rank"] <= 5)) / F.greatest(F.size(scored), F.lit(1))
    corpus = F.concat("questions", F.lit(" ("), F.col("chunks").cast("string"), F.lit(" chunks)"))
    return runs.withColumn("corpus", F.coalesce("corpus", corpus)).withColumn("piece_top5", F.coalesce("piece_top5", five))


def current_runs(runs: DataFrame) -> DataFrame:
    """One run per corpus: of the label appended last, the hybrid one if there is any, else the last."""
    last = runs.groupBy("corpus").agg(F.max_by("label", "seq").alias("label"))
    order = Window.partitionBy("corpus").orderBy(F.desc(F.coalesce(F.col("method") == "hybrid", F.lit(False))), F.desc("seq"))
    mine = runs.join(last, (runs["corpus"] == last["corpus"]) & runs["label"].eqNullSafe(last["label"]), "left_semi")
    return mine.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def shade(rank: Column) -> Column:
    """The class of a rank: first, three, five, ten, low or none."""
    return F.when(rank.isNull(), "none").when(rank <= 1, "first").when(rank <= 3, "three").when(rank <= 5, "five").when(rank <= 10, "ten").otherwise("low")


def verdict(rank: Column, other: Column) -> Column:
    """better, worse or same, no rank being the worst."""
    worst = F.lit(2**31 - 1)
    a, b = F.coalesce(rank, worst), F.coalesce(other, worst)
    return F.when(a < b, "better").when(a > b, "worse").otherwise("same")


def paired(runs: DataFrame, first: str = "vector", second: str = "hybrid") -> DataFrame:
    """``(corpus, label, id, first, second, verdict, shade)``: how the second method changes each question's rank within a label."""
    rows = runs.where(F.col("method").isin(first, second)).select("corpus", "label", "method", "seq", F.explode("rows").alias("r"))
    both = rows.groupBy("corpus", "label", F.col("r.id").alias("id")).agg(*[F.max_by("r.rank", F.when(F.col("method") == m, F.col("seq"))).alias(n) for m, n in ((first, "first"), (second, "second"))])
    return both.withColumn("verdict", verdict(F.col("second"), F.col("first"))).withColumn("shade", shade(F.col("second")))
