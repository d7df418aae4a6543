"""Jobs, queues, progress lines, cuts in any script, step monitors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import segments
from quillspark.functions import text as X
from quillspark.operators import jobs, lookup, ordered
from quillspark.sources import reports
from quillspark.streaming import events

JOB = T.StructType([T.StructField("id", T.LongType()), T.StructField("book", T.StringType())])


def test_queue_keeps_order_and_refuses_other_shapes(spark, tmp_path):
    path = str(tmp_path / "queue.json")
    assert reports.load_queue(spark, path, JOB).count() == 0
    jobs_in = spark.createDataFrame([(2, "b", 1), (1, None, 2), (3, "ä", 0)], "id long, book string, ord int")
    for _ in range(2):  # the second replaces the first
        reports.save_queue(jobs_in, path, "ord")
    assert [(r.ord, r.id, r.book) for r in reports.load_queue(spark, path, JOB).orderBy("ord").collect()] == [(0, 3, "ä"), (1, 2, "b"), (2, 1, None)]
    assert not list(tmp_path.glob(".queue*.tmp"))
    for bad in ('{"id": 1}', "[1, 2]", "nothing"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="array of objects"):
            reports.load_queue(spark, str(tmp_path / "bad.json"), JOB).collect()


def test_parameter_keys_keep_types(spark):
    df = spark.sql("""select k, from_json(j, 'map<string,string>') as m from values (1, '{"a": 1, "b": 2}'), (2, '{"b": 2, "a": 1}') t(k, j)""")
    assert len({r[0] for r in df.select(jobs.parameter_key(F.col("m"))).collect()}) == 1
    typed = spark.createDataFrame([({"a": "1"},), ({"a": '"1"'},), ({"a": "1.0"},), ({"a": None},)], "m map<string,string>")
    assert len({r[0] for r in typed.select(jobs.parameter_key(F.col("m"))).collect()}) == 4


def test_first_seen_groups_with_nulls(spark):
    df = spark.createDataFrame([("b", 0), (None, 1), ("a", 2), ("b", 3), (None, 4)], "k string, i int")
    assert [r.group for r in jobs.first_seen_groups(df, ["k"], "i").orderBy("i").collect()] == [0, 1, 2, 0, 1]


def test_evidence_without_columns(spark):
    (r,) = jobs.evidence(spark.createDataFrame([(1, "", "said")], "id int, asr_text string, transcript string"), ["id"]).collect()
    assert r.asr_text == "said" and r.expected_text == "" and r.missing_words == [] and r.coverage_score is None and r.error is None


def test_phase_clock(spark):
    (r,) = spark.range(1).select(jobs.clock(F.lit(3661.9)).alias("a"), jobs.clock(F.lit(None).cast("double")).alias("b")).collect()
    assert (r.a, r.b) == ("1:01:01", None)


def test_casefold_is_that_of_python(spark):
    words = ["Straße", "STRASSE", "ΟΔΟΣ", "οδός", "ﬁne", "ŉ", "µm", "Ärger", "abc"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.casefold(F.col("w"))).collect()]
    assert got == [w.casefold() for w in words]


def test_cuts_keep_every_letter_and_the_limit():
    rng = random.Random(2)
    for _ in range(200):
        east = rng.random() < 0.5
        alphabet = "漢字かなカ한글、。" if east else "abcdef  ,.;! "
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200)))
        pieces = segments.cut_at_words(text, 12)
        assert all(len(p) <= 12 for p in pieces)
        assert "".join("".join(pieces).split()) == "".join(text.split())
    assert segments.cut_at_words("漢字漢字漢字", 4) == ["漢字漢字", "漢字"]
    assert segments.segmented("One. Two.\n\nThree is much longer than that, you see.", 5, 20) == ["One. Two.", "Three is much longer", "than that,", "you see."]


def test_enriched_chunks(spark):
    docs = spark.createDataFrame([(1, "Chapter 1. \"It began.\" Then ~500 it went on, and on! Did it end?")], "doc int, text string")
    out = jobs.enriched_chunks(docs, ["doc"], lambda t: F.regexp_count(t, F.lit("on")) / 2, {"temperature": 0.8, "min_p": 0.05}, {"temperature": 5.0}, most=6, least=2).orderBy("index").collect()
    assert " ".join(r.text for r in out) == "Chapter 1. It began. Then [pause:500ms] it went on, and on! Did it end?"
    assert {r.chapter_id for r in out} == {1} and {r.chapter_title for r in out} == {"Chapter 1"}
    raw = [r.sentiment_raw for r in out]
    for k, r in enumerate(out):
        mean = sum(raw[max(0, k - 2) : k + 1]) / len(raw[max(0, k - 2) : k + 1])
        assert r.sentiment_compound == pytest.approx(mean) and r.word_count == len(r.text.split())
        assert r.tts_params.temperature == pytest.approx(min(2.35, round(0.8 + mean * 5.0, 2))) and r.tts_params.min_p == 0.05
    assert out[-1].boundary_type == "paragraph_end" and all(r.boundary_type for r in out)


def test_run_counts_without_rows_or_time(spark):
    none = spark.createDataFrame([], "chunk_id long, passed boolean, score double, error string")
    (r,) = jobs.run_counts(lookup.cascade(none, none, 0.5), None, 0.0).collect()
    assert r.stage1_failed == 0 and r.rows_per_second is None


def test_progress_lines_hide_equal_neighbours(spark):
    lines = ["Sampling: 1/10 [, 5it/s]", "🌀 Chunk 1/9 a", "other", "🌀 Chunk 1/9 a", "🌀 Chunk 2/9 a", "🌀 Chunk 9/9 Realtime: Calculating...", "🌀 Chunk 9/9 b", "", "a noise b"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "run int, pos int, line string")
    got = {r.pos: r for r in ordered.progress_lines(df, ["run"], "pos", 5, ("noise",)).collect()}
    assert {k: r.shown for k, r in got.items()} == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 8: False}
    assert (got[0].tokens, got[0].total, got[0].rate) == (1, 10, 5.0)


def brute_monitor(rows):
    """The flags of all steps from the whole matrix of weights."""
    out, position, started, completed = [], 0, None, None
    size = len(rows[0])
    a = np.array([[x if j <= i else 0.0 for j, x in enumerate(r)] for i, r in enumerate(rows)])
    for n in range(1, len(rows) + 1):
        seen = a[:n]
        here = int(seen[-1].argmax())
        broken = not -4 < here - position < 7
        position = position if broken else here
        false_start = started is None and (seen[-2:, -2:].max() > 0.1 or seen[:, :4].max() < 0.5)
        started = n if started is None and not false_start else started
        completed = n if completed is None and position >= size - 3 else completed
        done = completed is not None
        after = seen[completed:] if done else seen[:0]
        tail = bool(done and len(after) and after[:, -3:].sum(axis=0).max() >= 10)
        again = bool(done and len(after) and after[:, :-5].max(axis=1).sum() > 5)
        out.append((n, position, broken, false_start, done, tail, again))
    return out


def test_step_monitor_matches_the_whole_matrix():
    rng = np.random.default_rng(4)
    ends = set()
    for _ in range(60):
        size = int(rng.integers(8, 16))
        rows = []
        for step in range(60):
            w = rng.random(size) * 0.1
            w[min(size - 1, max(0, step // 2 + int(rng.integers(-1, 2)) * int(rng.random() < 0.2) * 8))] = rng.random() * 0.6 + 0.3
            rows.append(w.tolist())
        monitor, got = events.StepMonitor(), []
        for r in rows:
            monitor = events.StepMonitor(monitor.values)  # what is kept between batches is enough
            got.append(tuple(monitor.step(r).values()))
        assert got == brute_monitor(rows)
        ends.add(got[-1][4:])
    assert len(ends) > 1


def test_monitor_as_a_stream(spark, tmp_path):
    rows = [(s, k, [float(j == min(k, 9)) for j in range(10)]) for s in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "seq long, step long, weights array<double>")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = events.monitored(stream).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from flags").collect()
    assert len(got) == 60 and sum(r.complete for r in got) == 2 * 23 and any(r.long_tail for r in got)
