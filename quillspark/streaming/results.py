"""Live results: what a caller waits for, packs with an end mark, a watched folder with its sink, and status events.

Each form takes streams and tables alike, so that a stream's result can be held against the same function over a table.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..session import ship_package

#: Packs of one key that a task takes at a time.
MANY = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which packs need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# results by key with a time limit


def awaited(tasks: DataFrame, results: DataFrame, limit: str, late: str = "0 seconds") -> DataFrame:
    """tasks (task_id, submitted timestamp) with the result that comes within `limit` of the submission, once each.

    results (task_id, done_at timestamp, passed, score, error). A stream-stream left outer join: both sides keep their rows only until
    the watermark, which is `late` behind the newest rows of the slower side, says that nothing can match any more; a task without a
    result in time then gives its error row. A task that still waits has no row yet in a stream, while a table is taken as complete. Repeats of a
    result are equal: a stream takes the first that comes, a table the earliest and of several the least, null last. A result earlier than its task, of an older task of that
    name, is not the task's. Null ids and times match nothing.
    """
    if results.isStreaming:
        tasks, results = tasks.withWatermark("submitted", late), results.withWatermark("done_at", late)
        tasks, results = tasks.dropDuplicates(["task_id", "submitted"]), results.dropDuplicatesWithinWatermark(["task_id"])
        first = results.select(F.col("task_id").alias("_id"), "done_at", "passed", "score", "error")
        found = tasks.join(first, _in_time(limit), "left_outer")
    else:
        first = results.select(F.col("task_id").alias("_id"), "done_at", "passed", "score", "error")
        found = tasks.join(first, _in_time(limit), "left_outer")
        # null behind all values, as in SQL
        ordered = [x for c in ("done_at", "passed", "score", "error") for x in (F.col(c).isNull().alias(f"no_{c}"), c)]
        earliest = F.min(F.struct(*ordered)).alias("r")
        found = found.groupBy("task_id", "submitted").agg(earliest).select("task_id", "submitted", "r.done_at", "r.passed", "r.score", "r.error")
    there = F.col("done_at").isNotNull()
    error = F.when(there, F.col("error")).otherwise(F.lit(f"no result within {limit}"))
    return found.select("task_id", "submitted", "done_at", F.when(there, F.col("passed")).otherwise(F.lit(False)).alias("passed"), F.when(there, F.col("score")).otherwise(F.lit(0.0)).alias("score"), error.alias("error"))


def _in_time(limit: str) -> Column:
    return (F.col("task_id") == F.col("_id")) & (F.col("done_at") >= F.col("submitted")) & (F.col("done_at") <= F.col("submitted") + F.expr(f"interval {limit}"))


# packs


def tried(pack: pd.DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], number: int) -> list[tuple]:
    """(number, id, value, alone, error) of a pack's rows; where the pack fails its rows are run once more, one by one, and a row that fails
    alone gives its error."""
    try:
        found = run(pack)
        return [(number, i, v, False, None) for i, v in zip(found["id"].tolist(), found["value"].tolist(), strict=True)]
    except Exception:
        out = []
        for k, i in enumerate(pack["id"].tolist()):
            try:
                out.append((number, i, float(run(pack.iloc[k : k + 1])["value"].iloc[0]), True, None))
            except Exception as e:
                out.append((number, i, math.nan, True, f"{type(e).__name__}: {e}"))
        return out


def _framed(rows: list[tuple], key: str, value: Any) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["pack", "id", "value", "alone", "error"]).astype({"error": object})
    out.insert(0, key, [value] * len(out))
    return out


class _Packer(StatefulProcessor):
    """Holds the rows of a key that make no full pack yet, and the number of the next pack."""

    def __init__(self, key: str, size: int, run: Callable, quiet_ms: int | None, ttl_ms: int | None):
        self.key, self.size, self.run, self.quiet_ms, self.ttl_ms = key, size, run, quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id long, payload string", self.ttl_ms)
        self.number = handle.getValueState("number", "number int", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        ended = bool(new["is_end"].any())
        new = new[~new["is_end"]].sort_values("id", kind="stable")
        held = [*self.held.get(), *new[["id", "payload"]].itertuples(index=False, name=None)] if self.held.exists() else list(new[["id", "payload"]].itertuples(index=False, name=None))
        cut = len(held) if ended else len(held) // self.size * self.size
        yield from self._packs(key, held[:cut])
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held[cut:]:
            self.held.put(held[cut:])
            if self.quiet_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        else:
            self.held.clear()
        if ended:
            self.number.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        self.held.clear()
        yield from self._packs(key, held)

    def close(self) -> None:
        pass

    def _packs(self, key: Any, rows: list) -> Iterator[pd.DataFrame]:
        number = self.number.get()[0] if self.number.exists() else 0
        step = MANY * self.size
        for low in range(0, len(rows), step):
            some = pd.DataFrame(rows[low : low + step], columns=["id", "payload"]).assign(**{self.key: key[0]})
            packs = [some.iloc[k : k + self.size] for k in range(0, len(some), self.size)]
            yield _framed([r for k, pack in enumerate(packs) for r in tried(pack, self.run, number + k)], self.key, key[0])
            number += len(packs)
        if rows:
            self.number.update((number,))


def packed(rows: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], size: int = 8, quiet: str | None = None, keep: str | None = None) -> DataFrame:
    """rows (key, id long, payload string, is_end boolean) of a stream or a table, `size` at a time through `run`, which takes a pack (key, id,
    payload) and gives (id, value double).

    A key's rows go into packs in the order of their ids in a batch, batches in their order. The last pack is shorter: it is closed by
    the key's end mark (a row with is_end, itself in no pack), or, where `quiet` is set, when the key was quiet for so long (such a stream always waits
    for the clock, so it does not end by itself as one without does under availableNow). A pack that fails is run once more row by row; `alone` tells that, and a row that fails alone has an error. Packs are numbered from 0, after an end mark anew.
    `keep` (a duration) bounds how long rows of a key that never ends are kept. A table is cut by place in (key, id): no end mark is needed,
    and packs of one key are spread over tasks. Intake of a stream is bounded by its source (maxFilesPerTrigger). Null end marks count as none.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pack int, id long, value double, alone boolean, error string"
    rows = rows.select(key, F.col("id").cast("long").alias("id"), "payload", F.coalesce("is_end", F.lit(False)).alias("is_end"))
    if not rows.isStreaming:
        place = F.row_number().over(W.partitionBy(key).orderBy("id", "payload")) - 1
        cut = rows.where("not is_end").drop("is_end").withColumn("_place", place)

        def some(table: pa.Table) -> pa.RecordBatch:
            """The results of whole packs."""
            places = table.column("_place").to_numpy()
            cuts = [*np.flatnonzero(places % size == 0), len(places)]
            pdf, keys = table.drop_columns("_place").to_pandas(integer_object_nulls=True), table.column(key).to_pylist()
            out = [(keys[low], *r) for low, high in zip(cuts[:-1], cuts[1:], strict=True) for r in tried(pdf.iloc[low:high], run, int(places[low]) // size)]
            kinds = {key: table.schema.field(key).type, "pack": pa.int32(), "id": pa.int64(), "value": pa.float64(), "alone": pa.bool_(), "error": pa.string()}
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t, from_pandas=True) for c, t in zip(columns, kinds.values(), strict=True)], [*kinds])

        def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # the last pack of a batch may go on in the next one
            for b in batches:
                table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                last = int(np.flatnonzero(table.column("_place").to_numpy() % size == 0)[-1]) if len(table) else 0
                if last:
                    yield some(table.slice(0, last))
                held = table.slice(last)
            if held is not None and len(held):
                yield some(held)

        # the work for a row is far more than its transport; by their bytes the rows would be put together in few tasks
        spark = rows.sparkSession
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return cut.repartition(tasks, key, F.floor(F.col("_place") / (MANY * size))).sortWithinPartitions(key, "_place").mapInArrow(packs, schema)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    processor = _Packer(key, size, run, ms(quiet) if quiet else None, ms(keep) if keep else None)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if quiet or keep else "None")


# a watched folder and its results


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: the batch's number decides its folder, and a batch that is run again replaces what it wrote before."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").json(f"{folder}/batch={number}")

    return write


def saved_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Results under a folder of `write_batch`: of each task the one of the last batch; batches that were not finished are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    done = [f.getPath().getParent().toString() for f in found]
    kind = T._parse_datatype_string(schema)
    if not done:
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).option("basePath", folder).json(done)
    best = F.max_by(F.struct(*kind.names), "batch").alias("r")
    return rows.groupBy("task_id").agg(best).select("r.*")


def serve(tasks: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, **trigger: Any) -> StreamingQuery:
    """Start a stream that scores each task once and saves its result under `folder`, also over restarts: the checkpoint remembers which
    task files were read, and the sink makes a repeated batch harmless. Counts by batch are observed as `results`."""
    results = with_counts(score(tasks), "results")
    return results.writeStream.foreachBatch(sink or write_batch(folder)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


# status


def with_counts(results: DataFrame, name: str) -> DataFrame:
    """results (passed, error) with counts that are taken as rows go by: rows, errors, passed, failed."""
    wrong = F.coalesce(F.col("error"), F.lit("")) != ""
    good = F.coalesce(F.col("passed"), F.lit(False))
    counts = {"rows": F.lit(True), "errors": wrong, "passed": good & ~wrong, "failed": ~good & ~wrong}
    return results.observe(name, *(F.count_if(c).alias(k) for k, c in counts.items()))


class StatusEvents(StreamingQueryListener):
    """Gives one event for each batch of every stream that carries counts called `name`: batch, the counts, rows so far, the text of the phase, elapsed seconds."""

    def __init__(self, name: str, label: str, tell: Callable[[dict], None], phase: int | None = None, total: int | None = None):
        self.name, self.label, self.tell, self.phase, self.total, self.done, self.spent = name, label, tell, phase, total, 0, 0.0

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        counts = p.observedMetrics.get(self.name)
        if counts is None:
            return
        counts = {k: int(v) for k, v in counts.asDict().items()}
        self.done += counts["rows"]
        self.spent += p.batchDuration / 1000
        text = f"{self.label} ({self.done}/{self.total})" if self.total else self.label
        self.tell({"batch": p.batchId, **counts, "done": self.done, "operation": text if self.phase is None else f"Phase {self.phase}: {text}", "elapsed": round(self.spent, 3)})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.tell({"ended": str(event.id), "error": event.exception, "done": self.done})
