"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import compare
from ..session import ship_package


def windowed_counts(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and totals of events (ts timestamp, event_type, value) by event-time window; later rows than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's events that are no further apart than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def watch_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of task files (task_id, expected_text, asr_text), each read once; the checkpoint stands for deleting them."""
    return spark.readStream.schema("task_id string, expected_text string, asr_text string").option("pathGlobFilter", "*.task.json").json(folder)


def scored_tasks(tasks: DataFrame) -> DataFrame:
    """Results of tasks; a task without a transcript, or whose comparison fails, has an error and no score, and so counts as no failure."""
    rows = compare.compare_rows(tasks, "expected_text", "asr_text", ["task_id", "asr_text"], errors=True)
    lost = F.col("asr_text").isNull()
    return rows.select("task_id", F.when(~lost, F.col("passed")).alias("passed"), F.when(~lost, F.col("score")).alias("score"), F.when(lost, "no transcript").otherwise(F.col("error")).alias("error"))


def filled_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Each task with its result; an error row where there is none."""
    return tasks.select("task_id").join(results, "task_id", "left").withColumn("error", F.when(F.col("score").isNull(), F.coalesce("error", F.lit("no result"))).otherwise(F.col("error")))


def packs(rows: DataFrame, key: str, size: int, timeout: str = "1 minute") -> DataFrame:
    """Count windows: ids of `size` rows of a key at a time; a shorter pack when the key is quiet for `timeout`."""
    ship_package(rows.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], number, held))
            state.remove()
        else:
            for b in batches:
                held += sorted(b["id"].tolist())
            while len(held) >= size:
                out.append((k[0], number, held[:size]))
                held, number = held[size:], number + 1
            state.update((held, number))
            state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame([(a, n, h) for a, n, h in out if h], columns=[key, "pack", "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "id").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, pack int, ids array<long>", "held array<long>, number int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def positions(rows: DataFrame) -> DataFrame:
    """rows (seq, step, position): the furthest position so far, and jumps of less than -4 or more than 7; state is kept by sequence."""
    ship_package(rows.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, most, jumps = state.get if state.exists else (0, 0, 0)
        for b in batches:
            for p in b.sort_values("step")["position"].tolist():
                jumps += not -4 <= p - last <= 7
                last, most = p, max(most, p)
        state.update((last, most, jumps))
        yield pd.DataFrame([(k[0], most, jumps)], columns=["seq", "furthest", "jumps"])

    return rows.groupBy("seq").applyInPandasWithState(step, "seq long, furthest long, jumps long", "last long, most long, jumps long", "update", GroupStateTimeout.NoTimeout)


#: Fixed values of the step monitor: jumps that are no break, marks of a start, of an end, of a tail and of a repetition.
JUMP, EDGE, FIRM, END_TOKENS, TAIL, AGAIN = (-4, 7), 0.1, 0.5, 3, 10.0, 5.0


class StepMonitor:
    """Follows the weights of one step after another over the tokens of a text; `values` is its whole memory."""

    def __init__(self, values: list[float] | None = None):
        # steps, position, started at, completed at (-1: not yet), firmest early weight, last-two weight of the step before, tails, again
        self.values = list(values) if values else [0.0, 0.0, -1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]

    def step(self, weights: list[float]) -> dict:
        steps, position, started, completed, firm, edge, *tails, again = self.values
        row = np.array(weights, np.float64)
        row[int(steps) + 1 :] = 0.0  # nothing is said before its time
        steps += 1
        here = int(row.argmax()) if len(row) else 0
        broken = not JUMP[0] < here - position < JUMP[1]
        if not broken:
            position = float(here)
        firm, last = max(firm, float(row[:4].max(initial=0.0))), float(row[-2:].max(initial=0.0))
        false_start = started < 0 and (max(edge, last) > EDGE or firm < FIRM)
        if started < 0 and not false_start:
            started = steps
        if completed >= 0:
            tail = row[-END_TOKENS:] if len(row) >= END_TOKENS else np.zeros(END_TOKENS)
            tails = [float(a + b) for a, b in zip(tails, tail, strict=True)]
            again += float(row[:-5].max(initial=0.0))
        elif position >= len(row) - END_TOKENS:
            completed = steps
        self.values = [steps, position, started, completed, firm, last, *tails, again]
        done = completed >= 0
        return {"step": int(steps), "position": int(position), "discontinuity": broken, "false_start": false_start, "complete": done, "long_tail": done and max(tails) >= TAIL, "repetition": done and again > AGAIN}


FLAGS = "seq long, step long, position long, discontinuity boolean, false_start boolean, complete boolean, long_tail boolean, repetition boolean"


def monitored(rows: DataFrame) -> DataFrame:
    """rows (seq, step, weights array<double>) of a stream or a table: the flags of each step; the state of a sequence is ten numbers."""
    ship_package(rows.sparkSession)
    if not rows.isStreaming:

        def whole(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            monitor = StepMonitor()
            return pd.DataFrame([{"seq": k[0], **monitor.step(list(w))} for w in pdf.sort_values("step")["weights"]])

        return rows.groupBy("seq").applyInPandas(whole, FLAGS)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitor = StepMonitor(state.get[0] if state.exists else None)
        for b in batches:
            found = [{"seq": k[0], **monitor.step(list(w))} for w in b.sort_values("step")["weights"]]
            yield pd.DataFrame(found)
        state.update((monitor.values,))

    return rows.groupBy("seq").applyInPandasWithState(step, FLAGS, "values array<double>", "append", GroupStateTimeout.NoTimeout)
