"""Streams: debounce, throttle, consecutive de-duplication, scores and timers.

Aggregates have watermarks, so state is dropped once it can't change; state that isn't an aggregate is held by key in
``applyInPandasWithState`` with timeouts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(stream: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """The last value of each burst, once the pause is over."""
    seen = stream.withWatermark(time, late)
    return seen.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.max_by(value, F.struct(time, value)).alias(value), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), value, "n")


def throttled(stream: DataFrame, key: str, time: str, value: str, size: str, late: str) -> DataFrame:
    """First and last value of each slot."""
    edge = F.struct(time, value)
    seen = stream.withWatermark(time, late)
    return seen.groupBy(key, F.window(time, size).alias("w")).agg(F.min_by(value, edge).alias("leading"), F.max_by(value, edge).alias("trailing")).select(key, F.col("w.start").alias("start"), "leading", "trailing")


def scores(stream: DataFrame, time: str, late: str, points: int = 1) -> DataFrame:
    """client, score: correct answers, each (question, client) once however often it arrives."""
    once = stream.withWatermark(time, late).where("correct").dropDuplicatesWithinWatermark(["question", "client"])
    return once.groupBy("client").agg(F.sum(F.lit(points)).cast("long").alias("score"))


def once_in_a_row(stream: DataFrame, key: str, time: str, value: str, idle_ms: int | None = 86_400_000) -> DataFrame:
    """Rows whose value differs from the last one of their key; a key that is idle for a day is forgotten.

    A stream that is to end once it has read everything keeps its keys (``idle_ms`` None): it would wait for the idle ones."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([time, value], kind="stable")
        last = state.get[0] if state.exists else None
        before = rows[value].shift(1, fill_value=last)
        out = rows[(rows[value] != before) | (pd.Series(range(len(rows)), index=rows.index).eq(0) & (last is None))]
        state.update((rows[value].iloc[-1],))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out[[key, time, value]]

    schema = stream.select(key, time, value).schema
    return stream.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def counters(stream: DataFrame, key: str, time: str) -> DataFrame:
    """Timers: rows are (key, time, action, start, end) with action start, pause or tick. Gives key, time, value, ended.

    The value follows from the time passed since the start, so that late ticks don't drift; a pause keeps it. It stops
    at the end, and ``ended`` is true for the first tick that reaches it only."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, held, start, end, done = state.get if state.exists else (None, 0.0, 0.0, 0.0, True)
        out = []
        for row in pd.concat(list(frames)).sort_values([time, "action"], kind="stable").itertuples(index=False):
            at = getattr(row, time)
            now = held + ((at.timestamp() - began) if began is not None else 0.0)
            if row.action == "start":
                began, done = at.timestamp(), False
                if held == 0.0:
                    start, end = float(row.start), float(row.end)
            elif row.action == "pause":
                began, held = None, now
            elif not done:
                up = start <= end
                value = min(start + now, end) if up else max(start - now, end)
                finished = value == end
                out.append((k[0], at, value, finished))
                if finished:
                    began, held, done = None, 0.0, True
        state.update((began, held, start, end, done))
        yield pd.DataFrame(out, columns=[key, time, "value", "ended"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} {kinds[time]}, value double, ended boolean", "began double, held double, start double, end double, done boolean", "append", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Each micro-batch goes to a versioned table; rows that didn't change aren't written again."""
    from quillon.sources.files import write_changed

    def write(batch: DataFrame, _: int) -> None:
        write_changed(batch, path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame], None]):
    """Every subscriber gets each micro-batch, which is computed once."""

    def send(batch: DataFrame, _: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triggered(stream: DataFrame, actions: DataFrame, activation: str) -> DataFrame:
    """Events with the actions that their activation id starts: a join of the stream with a table."""
    return stream.join(actions, activation)


def fetched(stream: DataFrame, key: str, time: str, life_s: float) -> DataFrame:
    """key, time, fetched of requests: whether the cached answer is older than its life, which a fetch starts anew."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for at in rows[time]:
            due = last is None or (at - last).total_seconds() >= life_s
            last = at if due else last
            out.append(due)
        state.update((last,))
        yield rows[[key, time]].assign(fetched=out)

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} {kinds[time]}, fetched boolean", f"last {kinds[time]}", "append", GroupStateTimeout.NoTimeout)


def closing(stream: DataFrame, opened: DataFrame, time: str, limit_s: int, late: str) -> DataFrame:
    """Answers given before their question closes, ``limit_s`` seconds after it opened: a join of the stream with a table."""
    seen = stream.withWatermark(time, late).join(opened, "question")
    return seen.where(F.col(time) < F.col("opened") + F.expr(f"interval {limit_s} seconds")).drop("opened")
