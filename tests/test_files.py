"""Formats with a header or a frame: sound parts, one JSON array, a report that two jobs extend."""

import json
import threading
import wave

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files


def sound(path, n, channels=1, width=2, rate=8000, seed=0):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        body = bytes((seed + 31 * k) % 251 for k in range(n * channels * width))
        w.writeframes(body)
    return body


def content(path):
    with wave.open(str(path), "rb") as w:
        return (w.getnchannels(), w.getsampwidth(), w.getframerate()), w.readframes(w.getnframes())


def test_sound_parts_by_byte_range(spark, tmp_path):
    files.ready(spark)
    bodies = {f"c{k}.wav": sound(tmp_path / f"c{k}.wav", n, 2, 3, seed=k) for k, n in enumerate([0, 1, 1000, 4321])}
    rows = spark.read.format("wav_parts").option("partBytes", "1000").load(str(tmp_path / "*.wav"))
    assert rows.rdd.getNumPartitions() > 20
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.offset)):
        name = r.path.rsplit("/", 1)[1]
        assert (r.channels, r.width, r.rate) == (2, 3, 8000) and len(r.payload) <= 1000 and len(r.payload) % 6 == 0
        assert r.offset == len(got.get(name, b""))
        got[name] = got.get(name, b"") + r.payload
    assert got == bodies
    heads = spark.read.format("wav_parts").option("headerOnly", "true").load(str(tmp_path)).collect()
    assert sorted((r.bytes, r.payload) for r in heads) == [(len(b), None) for b in sorted(bodies.values(), key=len)]
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    with pytest.raises(Exception, match="no WAV file"):
        spark.read.format("wav_parts").load(str(tmp_path / "bad.wav")).collect()


def test_stitched_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bodies = [sound(tmp_path / "in" / f"c{k}.wav", n, seed=k) for k, n in enumerate([900, 0, 1, 700, 650])]
    clips = [("one.wav", 2, 0), ("one.wav", 1, 3), ("two.wav", 5, 4), ("two.wav", 7, 1), ("two.wav", 6, 2)]
    df = spark.createDataFrame([(n, i, f"file:{tmp_path}/in/c{k}.wav") for n, i, k in clips], "name string, index int, path string")
    files.stitch(df, str(tmp_path / "in"), str(tmp_path / "out"), 512)
    assert content(tmp_path / "out" / "one.wav") == ((1, 2, 8000), bodies[3] + bodies[0])
    assert content(tmp_path / "out" / "two.wav") == ((1, 2, 8000), bodies[4] + bodies[2] + bodies[1])
    sound(tmp_path / "in" / "other.wav", 5, rate=16000)
    more = df.union(spark.createDataFrame([("one.wav", 3, f"{tmp_path}/in/other.wav")], df.schema))
    with pytest.raises(ValueError, match="one.wav: clips differ in format"):
        files.stitch(more, str(tmp_path / "in"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="clips are missing"):
        files.stitch(df.withColumn("path", F.concat("path", F.lit("x"))), str(tmp_path / "in"), str(tmp_path / "out"))
    # a job that breaks off leaves the old file and nothing else
    broken = spark.createDataFrame([("one.wav", 1, 2, 8000, 4, 0, b"ab"), ("one.wav", 1, 2, 8000, 4, 3, b"cd")], "name string, channels int, width int, rate int, total long, offset long, payload binary")
    with pytest.raises(Exception, match="samples at 3"):
        broken.coalesce(1).write.format("wav_parts").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.wav", "two.wav"]
    assert content(tmp_path / "out" / "one.wav")[1] == bodies[3] + bodies[0]


def test_one_array(spark, tmp_path):
    path = tmp_path / "chunks.json"
    rows = spark.range(500).select(F.col("id").alias("index"), F.concat(F.lit('a "quoted", ] text é '), F.col("id").cast("string")).alias("text"))
    files.save_array(rows.repartition(7), "index", str(path))
    assert [r["index"] for r in json.loads(path.read_text())] == list(range(500))
    got = files.load_array(spark, str(path), "index long, text string").orderBy("place").collect()
    assert [(r.place, r["index"], r.text) for r in got] == [(r["index"], r["index"], r.text) for r in rows.collect()]
    files.save_array(rows.where("false"), "index", str(path))
    assert json.loads(path.read_text()) == [] and files.load_array(spark, str(path)).count() == 0
    bad = rows.withColumn("text", F.when(F.col("index") == 400, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken row"):
        files.save_array(bad, "index", str(path))
    assert json.loads(path.read_text()) == [] and [p.name for p in tmp_path.iterdir()] == ["chunks.json"]
    (tmp_path / "root.json").write_text('{"records": [1, 2]}\n')
    assert [(r.place, r.value) for r in files.load_array(spark, str(tmp_path / "root.json")).collect()] == [(None, '{"records": [1, 2]}')]
    (tmp_path / "bad.json").write_text("[1 2]")
    with pytest.raises(Exception, match="no comma"):
        files.load_array(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
def test_items_over_block_ends(size):
    value = [1, -2.5e3, "é\"],[", {"a": [1, {"b": None}]}, [], True, 123456]
    raw = json.dumps(value, ensure_ascii=False).encode()
    blocks = iter([raw[k : k + size] for k in range(0, len(raw), size)])
    assert [json.loads(t) for _, t in files.json_items(blocks, "x")] == value


def test_two_jobs_append(spark, tmp_path):
    folder = str(tmp_path / "report")
    rows = spark.range(5).select("id", F.concat(F.lit("stage, one\n"), F.col("id").cast("string")).alias("stage_note"), F.lit(None).cast("string").alias("missing"))
    files.append_runs(rows, "id", folder)
    jobs = [threading.Thread(target=files.append_runs, args=(rows, "id", folder)) for _ in range(3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").iterdir()))
    numbers = [int(x[5:]) for x in text.splitlines() if x.startswith("Run #")]
    assert numbers == list(range(1, 21))
    assert text.startswith("Run #1\nId: 0\nStage Note: stage, one\n0\nMissing: N/A\n")
    assert len(list((tmp_path / "report").iterdir())) == 4


def test_a_large_block_of_items_takes_time_in_proportion():
    import time

    def seconds(n):
        body = ("[" + ", ".join(f'{{"a": {k}}}' for k in range(n)) + "]").encode()
        start = time.process_time()
        assert sum(1 for _ in files.json_items(iter([body]), "x")) == n
        return time.process_time() - start

    seconds(1000)
    assert seconds(200_000) < 60 * max(seconds(10_000), 0.01)


def test_many_sounds_are_one_move_for_the_driver(tmp_path, monkeypatch):
    import pickle

    def rows(names, body):
        return iter([{"name": n, "channels": 1, "width": 2, "rate": 8000, "total": len(body), "offset": 0, "payload": body} for n in names])

    def tree(folder):
        return {str(p.relative_to(folder)): content(p)[1] for p in folder.rglob("*") if p.is_file()}

    out, moves = tmp_path / "new" / "out", []
    monkeypatch.setattr(files, "opened", lambda path: (CountedMoves(moves), path))

    class CountedMoves:
        def __init__(self, log):
            self.fs, self.log = files.pafs.LocalFileSystem(), log

        def __getattr__(self, what):
            return getattr(self.fs, what)

        def move(self, a, b):
            self.log.append(b)
            self.fs.move(a, b)

    job = files.WavWriter({"path": f"{out}/"})
    one = [f"{k}.wav" for k in range(40)] + [f"a/{k}.wav" for k in range(40)]
    messages = [job.write(rows(one, b"1111")), job.write(rows(["a/b/x.wav", "a/z.wav", "z.wav"], b"22")), job.write(rows([], b""))]
    messages.append(job.write(rows(["a/z.wav", "z.wav"], b"22")))  # an attempt that is run again
    with pytest.raises(ValueError, match="4 bytes of samples for 6"):
        job.write(iter([{"name": "q.wav", "channels": 1, "width": 2, "rate": 8000, "total": 6, "offset": 0, "payload": b"1111"}]))
    assert not out.exists() and len(pickle.dumps(messages)) < 500
    moves.clear()
    job.commit(messages)
    assert moves == [str(out)]
    want = {n: b"1111" for n in one} | {"a/b/x.wav": b"22", "a/z.wav": b"22", "z.wav": b"22"}
    assert tree(out) == want and [p.name for p in out.parent.iterdir()] == ["out"]
    # into a folder that is there: files are replaced, others stay, a job that breaks off changes nothing
    for name, ends in (("abort", want), ("commit", want | {"a/3.wav": b"3333", "c/3.wav": b"3333", "3.wav": b"3333"})):
        job = files.WavWriter({"path": str(out)})
        getattr(job, name)([job.write(rows(["3.wav", "a/3.wav", "c/3.wav"], b"3333"))])
        assert tree(out) == ends and [p.name for p in out.parent.iterdir()] == ["out"]
    files.WavWriter({"path": str(out)}).abort([None])
    files.WavWriter({"path": str(tmp_path / "none")}).commit([])
    assert list((tmp_path / "none").iterdir()) == []


def test_sounds_in_folders(spark, tmp_path):
    files.ready(spark)
    for folder in ("in", "in/h1", "in/h2", "in/.old", "in/_x/h3"):
        (tmp_path / folder).mkdir(parents=True)
    bodies = [sound(tmp_path / "in" / f / "c.wav", 9 + k, seed=k) for k, f in enumerate([".", "h1", "h2", ".old", "_x/h3"])]
    flat = spark.read.format("wav_parts").load(f"{tmp_path}/in").collect()
    assert [bytes(r.payload) for r in flat] == bodies[:1]
    deep = spark.read.format("wav_parts").option("recursiveFileLookup", "true").load(f"{tmp_path}/in").collect()
    assert {r.path: bytes(r.payload) for r in deep} == {f"{tmp_path}/in/{n}": b for n, b in zip(["c.wav", "h1/c.wav", "h2/c.wav"], bodies)}
    clips = spark.createDataFrame([("x.wav", 1, f"{tmp_path}/in/h2/c.wav"), ("x.wav", 2, f"{tmp_path}/in/h1/c.wav")], "name string, index int, path string")
    files.stitch(clips, f"{tmp_path}/in", f"{tmp_path}/out", deep=True)
    assert content(tmp_path / "out" / "x.wav")[1] == bodies[2] + bodies[1]
    with pytest.raises(ValueError, match="clips are missing"):
        files.stitch(clips, f"{tmp_path}/in", f"{tmp_path}/out")
