"""Live results: time limits, packs, the watched folder and its sink, status events."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.streaming import results as R

T0 = dt.datetime(2024, 1, 1)
TASK, RESULT = "task_id string, submitted timestamp", "task_id string, done_at timestamp, passed boolean, score double, error string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def put(spark, rows, schema, folder, name):
    """One file of a stream's folder, with a time of change that grows with its name."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    assert name


def run(df, tmp, name, mode="append"):
    q = df.writeStream.format("parquet").option("path", str(tmp / f"{name}-out")).option("checkpointLocation", str(tmp / f"{name}-ck")).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def rows_of(spark, tmp, name, *cols):
    return sorted((tuple(r[c] for c in cols) for r in spark.read.parquet(str(tmp / f"{name}-out")).collect()), key=repr)


def test_results_within_the_limit_over_restarts_and_late_files(spark, tmp_path):
    (tmp_path / "tasks").mkdir()
    (tmp_path / "results").mkdir()
    tasks, results = [], []

    def step(new_tasks, new_results):
        tasks.extend(new_tasks)
        results.extend(new_results)
        for rows, schema, folder in ((new_tasks, TASK, "tasks"), (new_results, RESULT, "results")):
            if rows:
                put(spark, rows, schema, tmp_path / folder, folder)
        stream = lambda schema, folder: spark.readStream.schema(schema).parquet(str(tmp_path / folder))
        run(R.awaited(stream(TASK, "tasks"), stream(RESULT, "results"), "60 seconds", "10 seconds"), tmp_path, "a")

    ok = lambda k, s: (k, at(s), True, 0.9, None)
    step([("a", at(0)), ("b", at(0)), ("c", at(5)), (None, at(5))], [ok("b", 30)])  # b's result comes before its task is old
    step([("d", at(40))], [ok("b", 30), ok("a", 20), ok("d", 101)])  # a repeat, one out of order, one after the limit
    assert not [r for r in rows_of(spark, tmp_path, "a", "task_id", "error") if r[0] == "c"]  # still waits
    step([("e", at(500))], [ok("e", 520), ("f", at(520), False, 0.1, "broken")])
    step([("g", at(2000))], [ok("g", 2001)])
    got = rows_of(spark, tmp_path, "a", "task_id", "passed", "score", "error")
    late = "no result within 60 seconds"
    assert got == sorted([("a", True, 0.9, None), ("b", True, 0.9, None), ("c", False, 0.0, late), ("d", False, 0.0, late), ("e", True, 0.9, None), ("g", True, 0.9, None), (None, False, 0.0, late)], key=repr)
    table = R.awaited(spark.createDataFrame(tasks, TASK), spark.createDataFrame(results, RESULT), "60 seconds")
    assert got == sorted((tuple(r[c] for c in ("task_id", "passed", "score", "error")) for r in table.collect()), key=repr)


def test_of_results_of_one_time_a_null_is_the_last(spark):
    done = spark.createDataFrame([("a", at(5), None, None, None), ("a", at(5), True, 0.5, None), ("a", at(5), True, 0.5, "line 2"), ("b", at(5), None, 0.1, None)], RESULT)
    got = R.awaited(spark.createDataFrame([("a", at(0)), ("b", at(0)), ("c", at(0))], TASK), done, "60 seconds")
    assert sorted(tuple(r)[3:] for r in got.collect() if r.task_id == "a") == [(True, 0.5, "line 2")] and got.where("done_at is null").count() == 1


def test_packs_of_a_table_lie_in_many_tasks_and_go_on_over_batches(spark):
    rows = [(k if k else None, n, "bad" if n == 9 else "x" * n, False) for k in range(3) for n in range(700)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "13")
    try:
        found = R.packed(spark.createDataFrame(rows, ITEM), "k", score, 8).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, before)
    assert len({r.task for r in found}) > 2
    want = [(k, n // 8, n, 3.0 if n == 9 else float(n), n // 8 == 1, None) for k, n, *_ in rows]
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(want, key=repr)


def score(pack):
    """Fails for packs with a bad row, and for the worst rows alone too."""
    if (pack["payload"] == "bad").any() and len(pack) > 1:
        raise RuntimeError("pack")
    if (pack["payload"] == "worst").any():
        raise ValueError("row")
    return pd.DataFrame({"id": pack["id"], "value": pack["payload"].str.len().astype(float)})


ITEM = "k long, id long, payload string, is_end boolean"


def test_packs_with_end_mark_and_second_try(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKS)
    try:
        rows = [(k, i, "bad" if (k, i) == (1, 9) else "worst" if (k, i) == (2, 3) else "x" * i, False) for k in (1, 2, 3) for i in range({1: 19, 2: 8, 3: 5}[k])]
        stream = lambda: spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        parts = [[r for r in rows if r[1] < 6], [r for r in rows if r[1] >= 6], [(1, 99, None, True), (2, 99, None, True), (3, 99, None, True)]]
        for part in parts:  # the stream is stopped after each file and goes on from its state
            put(spark, part, ITEM, tmp_path / "in", "in")
            run(R.packed(stream(), "k", score, 8), tmp_path, "p")
        cols = ("k", "pack", "id", "value", "alone", "error")
        nan = lambda rows: [tuple(None if v != v else v for v in r) for r in rows]
        got = nan(rows_of(spark, tmp_path, "p", *cols))
        want = nan(sorted((tuple(r[c] for c in cols) for r in R.packed(spark.createDataFrame(rows, ITEM), "k", score, 8).collect()), key=repr))
        assert got == want and len(got) == len(rows)
        assert {(r[0], r[1]) for r in got if r[4]} == {(1, 1), (2, 0)} and [r[2] for r in got if r[5]] == [3]
        assert [r[1] for r in got if r[0] == 1].count(2) == 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_quiet_keys_close_their_pack(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKS)
    try:
        put(spark, [(1, i, "x", False) for i in range(3)], ITEM, tmp_path / "in", "in")
        stream = spark.readStream.schema(ITEM).parquet(str(tmp_path / "in"))
        q = R.packed(stream, "k", score, 8, "1 second").writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("quiet").count():
                break
        q.stop()
        assert sorted((r.pack, r.id) for r in spark.table("quiet").collect()) == [(0, 0), (0, 1), (0, 2)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


WORK = "task_id string, n long"


def judged(tasks):
    return tasks.select("task_id", (F.col("n") % 2 == 0).alias("passed"), (F.col("n") / 10).alias("score"), F.when(F.col("n").isNull(), "no number").alias("error"))


def test_watched_folder_gives_each_task_one_result(spark, tmp_path):
    (tmp_path / "q").mkdir()

    def tasks(names):
        for name, n in names:
            (tmp_path / "q" / f"{name}.task.json").write_text(json.dumps({"task_id": name, "n": n}))
        return spark.readStream.schema(WORK).option("maxFilesPerTrigger", 2).option("pathGlobFilter", "*.task.json").json(str(tmp_path / "q"))

    out, ck, write = str(tmp_path / "out"), str(tmp_path / "ck"), R.write_batch(str(tmp_path / "out"))
    wrote = []

    def killed(rows, number):
        write(rows, number)
        wrote.append(number)
        if number == 1:
            raise SystemError("killed after the write, before the batch was noted")

    stream = tasks([("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 5)])
    q = R.serve(stream, judged, out, ck, killed)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(60)
    assert wrote == [0, 1]
    seen, listener = [], None
    listener = R.StatusEvents("results", "Scoring", seen.append, 1, 6)
    spark.streams.addListener(listener)
    try:
        assert R.serve(tasks([("f", 6)]), judged, out, ck).awaitTermination(60)
        schema = "task_id string, passed boolean, score double, error string"
        for _ in range(100):
            if any("ended" in e for e in seen):
                break
            spark.range(1).count()
    finally:
        spark.streams.removeListener(listener)
    got = sorted(map(tuple, R.saved_results(spark, out, schema).collect()))
    assert got == [("a", False, 0.1, None), ("b", True, 0.2, None), ("c", None, None, "no number"), ("d", True, 0.4, None), ("e", False, 0.5, None), ("f", True, 0.6, None)]
    assert spark.read.json(out).count() == 6  # the repeated batch has replaced what it wrote before
    batches = {e["batch"]: e for e in seen if "batch" in e}
    files = {r.batch: r["count"] for r in spark.read.json(out).groupBy("batch").count().collect()}
    assert batches and {b: e["rows"] for b, e in batches.items() if e["rows"]} == {b: n for b, n in files.items() if b in batches}
    assert all(e["rows"] == e["errors"] + e["passed"] + e["failed"] for e in batches.values())
    assert any(e["operation"].startswith("Phase 1: Scoring (") for e in batches.values())
    assert R.saved_results(spark, str(tmp_path / "nothing"), schema).count() == 0
