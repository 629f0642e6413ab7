"""Structured Streaming over chat turns: keyed sessions and recent context, running counts, routed sinks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import slug
from ..operators.conversation import RECENT_SECONDS, RECENT_TURNS, is_reset, route
from ..sources.readers import read_lookup

_OUT = "user_id string, turn_id long, session long, recent int"
_STATE = "session long, times array<long>"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a user: the session's number and the times of the last turns (four at most)."""
    session, times = state.get if state.exists else (0, [])
    times = list(times)
    rows = pd.concat(list(frames)).sort_values(["us", "turn_id"])
    out = []
    for turn, us, reset in zip(rows["turn_id"], rows["us"], rows["reset"]):
        recent = [t for t in times if t >= us - RECENT_SECONDS * 1_000_000]
        out.append((key[0], turn, session, len(recent)))
        # A reset still belongs to the session that it ends, and clears the context.
        times = [] if reset else [*recent, us][-RECENT_TURNS:]
        session += bool(reset)
    state.update((session, times))
    yield pd.DataFrame(out, columns=["user_id", "turn_id", "session", "recent"])


def tracked(stream: DataFrame) -> DataFrame:
    """``stream(turn_id, user_id, ts, question)`` to ``(user_id, turn_id, session, recent)``.

    Sessions end at a user's reset; ``recent`` counts the turns that the context holds. State is a number and four
    times per user, kept by the state store, so it outlives a restart. Turns without a user or a time are left out.
    """
    rows = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "turn_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), is_reset(F.col("question")).alias("reset"))
    return rows.groupBy("user_id").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def rule_counts(stream: DataFrame) -> DataFrame:
    """Running number of events per rule (update or complete mode)."""
    return stream.groupBy("rule").count()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Turns per window and route under a watermark; later rows are dropped once their window is closed."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), route(F.col("question")).alias("route")).count().select("window.start", "window.end", "route", "count")


def messages(spark: SparkSession, form: str, schema: str | None = None, **options) -> DataFrame:
    """A stream of messages that begins with what comes next: sources with offsets start at the latest ones.

    File sources have no offsets: of these, rows of a ``ts`` before the stream was made are dropped.
    """
    reader = spark.readStream.format(form).options(**({"startingOffsets": "latest"} | options))
    stream = (reader.schema(schema) if schema else reader).load()
    if "ts" not in stream.columns:
        return stream
    began = datetime.now(timezone.utc).isoformat()
    return stream.where(F.col("ts").cast("timestamp") >= F.to_timestamp(F.lit(began)))


def admitted(batch: DataFrame, path: str, open_to_all: bool = False) -> DataFrame:
    """The batch with ``allowed``: whether its user stands in the lookup at ``path``, which is read anew for every batch.

    A missing or broken lookup admits nobody. ``open_to_all`` admits everybody.
    """
    if open_to_all:
        return batch.withColumn("allowed", F.lit(True))
    known = read_lookup(batch.sparkSession, path, "name").select("user_id", F.lit(True).alias("allowed")).dropDuplicates(["user_id"])
    return batch.join(known, "user_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def route_batch(out: str, lookup: str | None = None):
    """``foreachBatch`` writer of exchanges to append-only folders: answered and failed by user and session, denied by day.

    A user's folder is named by display name and id. With ``lookup`` access is settled batch by batch. Failed ones go to
    ``failed`` with their error as well as to the user's own folder; denied ones never do.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = admitted(batch, lookup) if lookup else batch
        name = slug(F.col("display_name")) if "display_name" in batch.columns else F.lit("user")
        session = F.col("session") if "session" in batch.columns else F.lit(0)
        rows = rows.withColumn("user_key", F.concat_ws("-", name, slug(F.col("user_id").cast("string")))).withColumn("session_key", session).withColumn("day", F.to_date("ts")).persist()
        try:
            rows.where("NOT allowed").drop("user_key", "session_key").write.mode("append").partitionBy("day").json(f"{out}/denied")
            rows.where("allowed AND error IS NOT NULL").write.mode("append").partitionBy("user_key", "session_key").json(f"{out}/failed")
            rows.where("allowed").drop("traceback").write.mode("append").partitionBy("user_key", "session_key").json(f"{out}/answered")
        finally:
            rows.unpersist()

    return write
