"""Streaming forms of three rules. Each takes a batch or streaming DataFrame where Spark allows both."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuemill.functions import rules
from cuemill.session import shared_folder


def latest_stage(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Per run and stage: last status and exit code, first start, last finish, events. Use update mode on a stream.
    Events at one instant rank by ``seq`` when there is one."""
    tie = F.col("seq") if "seq" in events.columns else F.lit(0)
    at = F.struct("at", tie)
    done = F.col("status").isin("succeeded", "failed", "blocked", "skipped")
    e = events.withWatermark("at", watermark) if events.isStreaming else events
    return e.groupBy("run_id", "stage").agg(
        F.max_by("status", at).alias("status"), F.max_by("exit_code", at).alias("exit_code"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(done, F.col("at"))).alias("finished_at"), F.count(F.lit(1)).alias("n_events"))


def pause_sessions(events: DataFrame, gap: str, key: str = "media_id", watermark: str = "1 hour") -> DataFrame:
    """Groups of events with no pause of ``gap`` or longer between neighbours. Append mode on a stream."""
    e = events.withWatermark("at", watermark) if events.isStreaming else events
    return e.groupBy(key, F.session_window("at", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at")).select(
        key, F.col("s.start").alias("start_at"), "last_at", "n")


REGION = "media_id long, start_frame long, end_frame long, peak double"
STATE = "next_frame long, active boolean, start_frame long, below_frame long, peak double, held_frames array<long>, held_values array<double>"


def _region_step(enter: float, leave: float, run: int, first: int | None, hold: int, idle_ms: int | None):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        nxt, active, start, below, peak, waiting, out = first, False, -1, -1, 0.0, {}, []
        if state.exists:
            nxt, active, start, below, peak, held_f, held_v = state.get
            waiting = dict(zip(held_f or [], held_v or []))
        for b in batches:
            waiting.update(zip(b["frame"].tolist(), b["p_speech"].tolist()))
        over = state.hasTimedOut
        # Frames may come late: go on as far as they follow one another. A gap is passed when ``hold`` later frames wait, or
        # when the item is over; a frame that comes after that is left out.
        while waiting:
            if nxt not in waiting:
                if nxt is not None and len(waiting) <= hold and not over:
                    break
                for late in [f for f in waiting if nxt is not None and f < nxt]:
                    del waiting[late]
                if not waiting:
                    break
                nxt = min(waiting)
            p = waiting.pop(nxt)
            if not active:
                if p >= enter:
                    active, start, below, peak = True, nxt, -1, p
            else:
                peak = max(peak, p)
                if p < leave:
                    below = nxt if below < 0 else below
                    if nxt - below + 1 >= run:
                        out.append((key[0], start, below, peak))
                        active, start, below, peak = False, -1, -1, 0.0
                else:
                    below = -1
            nxt += 1
        if over:
            if active:
                out.append((key[0], start, nxt, peak))
            state.remove()
        else:
            state.update((nxt, active, start, below, peak, list(waiting), list(waiting.values())))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["media_id", "start_frame", "end_frame", "peak"])

    return step


def speech_regions_stream(
    frames: DataFrame, enter: float = rules.ENTER_THRESHOLD, leave: float = rules.EXIT_THRESHOLD, run: int = rules.EXIT_RUN,
    first: int | None = 0, hold: int = 100_000, idle_ms: int | None = None,
) -> DataFrame:
    """Closed speech regions as frames (media_id, frame, p_speech) arrive. State per item is a few numbers and at most ``hold``
    frames that came ahead of a missing one. ``first`` is the number of an item's first frame; None begins with the smallest
    frame of its first batch. With ``idle_ms`` an item that is quiet so long is over: its open region is closed after its
    last frame and its state goes. Without, the open region has no row yet."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("media_id").applyInPandasWithState(_region_step(enter, leave, run, first, hold, idle_ms), REGION, STATE, "append", timeout)


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run an append-mode stream over all input at hand into files of the shared folder, and read them as a table."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start(f"{base}/rows"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
