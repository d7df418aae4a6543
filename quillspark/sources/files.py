"""File formats with a header or a frame around their rows, as Python data sources: sound files, one JSON array, a report that only grows.

Files are opened through pyarrow's file systems, so a path is a local (or mounted) one or a URI that pyarrow knows. Every writer leaves the
old file in place until the job has succeeded: tasks write beside the target under the job's number, commit() moves, abort() removes.
"""

from __future__ import annotations

import codecs
import contextlib
import fnmatch
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.ranking import kept
from ..session import ship_package

PART_BYTES, COPY_BYTES = 8 << 20, 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, deep: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder (`deep`: and of the folders in it), or of those that a last part with marks (`*.wav`)
    names, in order of their names."""
    fs, p = opened(path)
    folder, _, last = p.rpartition("/")
    pattern = last if any(c in last for c in "*?[") else None
    info = fs.get_file_info(folder if pattern else p)
    if info.type == pafs.FileType.File:
        return [(p, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    top = (folder if pattern else p).rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(top, recursive=deep))
    hidden = re.compile("/[._]")
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not hidden.search(f.path, len(top)) and (not pattern or fnmatch.fnmatchcase(f.base_name, pattern)))


def merged(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Moves a folder to where none is; where one is, the files in it, one after another."""
    if fs.get_file_info(target).type == pafs.FileType.NotFound:
        fs.create_dir(os.path.dirname(target), recursive=True)
        # fails where another one made the folder meanwhile, or where a file system moves no folders
        with contextlib.suppress(OSError):
            fs.move(source, target)
    if fs.get_file_info(source).type == pafs.FileType.Directory:
        fs.create_dir(target, recursive=True)
        for f in fs.get_file_info(pafs.FileSelector(source)):
            if f.type == pafs.FileType.Directory:
                merged(fs, f.path, f"{target}/{f.base_name}")
            else:
                fs.move(f.path, f"{target}/{f.base_name}")


@dataclass
class Part(InputPartition):
    """Pieces (path, number) that a task reads one after another."""

    pieces: list[tuple[str, int]]


def dealt(pieces: Iterable[tuple[str, int, int]], most: int) -> list[Part]:
    """Pieces (path, number, bytes) put together to parts of about `most` bytes."""
    out, held, size = [], [], 0
    for path, number, n in pieces:
        if held and size + n > most:
            out.append(Part(held))
            held, size = [], 0
        held.append((path, number))
        size += n + 1024
    return [*out, Part(held)] if held else out


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str, Any]]


class _Beside(DataSourceWriter):
    """A writer whose tasks write files of a job beside their targets."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.job = uuid.uuid4().hex
        fs, folder = opened(self.path)
        self.inside = folder if self.holds_files() else os.path.dirname(folder)

    def holds_files(self) -> bool:
        return True

    def temporary(self, name: str) -> str:
        return f"{self.inside}/.{name}.{self.job}-{uuid.uuid4().hex[:8]}"

    def clean(self) -> None:
        """Removes what the job wrote, also that of tasks which ended without a message."""
        fs, _ = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(self.inside, allow_not_found=True)):
            if f".{self.job}-" in f.base_name:
                fs.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clean()


# sound


@dataclass
class Wav:
    channels: int
    width: int
    rate: int
    start: int
    size: int


def wav_header(f: Any, path: str) -> Wav:
    """Format of an open file and place of its samples; anything but plain PCM raises an error."""
    if len(head := f.read(12)) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError(f"no WAV file: {path}")
    form = None
    while len(chunk := f.read(8)) == 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            body = f.read(size + size % 2)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            if kind != 1:
                raise ValueError(f"compressed sound: {path}")
            form = (channels, bits // 8, rate)
        elif name == b"data":
            if form is None:
                raise ValueError(f"samples before their format: {path}")
            return Wav(*form, f.tell(), min(size, f.size() - f.tell()))
        else:
            f.seek(f.tell() + size + size % 2)
    raise ValueError(f"no samples: {path}")


def wav_bytes(channels: int, width: int, rate: int, size: int) -> bytes:
    if size > 2**32 - 64:
        raise ValueError("a WAV file holds less than 4 GB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * width, channels * width, width * 8, b"data", size)


SOUND = "path string, channels int, width int, rate int, bytes long, offset long, payload binary"


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("partbytes", PART_BYTES))
        self.only_header = options.get("headeronly", "false").lower() == "true"
        self.deep = options.get("recursivefilelookup", "false").lower() == "true"

    def partitions(self) -> list[Part]:
        if self.only_header:
            return dealt(((p, 0, 1024) for p, _ in listed(self.path, self.deep)), 16 << 20)
        return dealt(((p, k, min(size, self.size)) for p, size in listed(self.path, self.deep) for k in range(max(1, -(-size // self.size)))), self.size)

    def read(self, part: Part) -> Iterator[tuple]:
        for path, number in part.pieces:
            yield from self.piece(path, number)

    def piece(self, path: str, number: int) -> Iterator[tuple]:
        fs, p = opened(path)
        with fs.open_input_file(p) as f:
            h = wav_header(f, path)
            step = max(1, self.size // (h.channels * h.width)) * h.channels * h.width
            if self.only_header:
                yield (path, h.channels, h.width, h.rate, h.size, 0, None)
                return
            # the last part takes what whole frames have left over
            last = number == max(1, -(-f.size() // self.size)) - 1
            low, high = number * step, h.size if last else min(h.size, (number + 1) * step)
            for at in range(low, max(high, low + (number == 0)), step):
                f.seek(h.start + at)
                yield (path, h.channels, h.width, h.rate, h.size, at, f.read(max(0, min(step, high - at))))


class WavWriter(DataSourceWriter):
    """Rows (name, channels, width, rate, total, offset, payload), those of a file in one task in order of their offset. A name may have
    folders in it (`a/b.wav`).

    An attempt of a task writes into a folder of its own and, when all its files are whole, moves them into the job's, a folder of one task at once;
    the job's folder becomes the target by one move if there is none yet. So neither the driver's work nor what is sent to it grows with the
    number of files, and tasks do not wait for one another in one folder. Into a folder that is there, the driver moves file by file."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        _, self.target = opened(self.path)
        self.job = f"{os.path.dirname(self.target)}/.{os.path.basename(self.target)}.{uuid.uuid4().hex}"
        self.ready = f"{self.job}/ready"

    def write(self, rows: Iterator[Row]) -> Wrote:
        done, made, name, out, form, at = [], {""}, None, None, None, 0
        fs, _ = opened(self.path)
        own = f"{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)

        def close() -> None:
            if out is not None:
                out.close()
                if at != form[3]:
                    raise ValueError(f"{name}: {at} bytes of samples for {form[3]}")

        try:
            for r in rows:
                if r["name"] != name:
                    close()
                    name, at, form = r["name"], 0, (r["channels"], r["width"], r["rate"], r["total"])
                    done.append(name)
                    if (inside := os.path.dirname(name)) not in made:
                        fs.create_dir(f"{own}/{inside}", recursive=True)
                        made.add(inside)
                    out = fs.open_output_stream(f"{own}/{name}")
                    out.write(wav_bytes(*form))
                if (r["channels"], r["width"], r["rate"], r["total"]) != form:
                    raise ValueError(f"{name}: clips differ in format")
                if r["offset"] != at:
                    raise ValueError(f"{name}: samples at {r['offset']}, expected at {at}")
                out.write(r["payload"])
                at += len(r["payload"])
            close()
            fs.create_dir(self.ready, recursive=True)
            for first, within in dict.fromkeys((first, bool(mark)) for first, mark, _ in (n.partition("/") for n in done)):
                if within:
                    merged(fs, f"{own}/{first}", f"{self.ready}/{first}")
                else:
                    fs.move(f"{own}/{first}", f"{self.ready}/{first}")
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            with contextlib.suppress(OSError):
                fs.delete_dir(own)
            raise
        return Wrote([])

    def commit(self, messages: list[Wrote]) -> None:
        fs, _ = opened(self.path)
        fs.create_dir(self.ready, recursive=True)
        merged(fs, self.ready, self.target)
        fs.delete_dir(self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = opened(self.path)
        if fs.get_file_info(self.job).type == pafs.FileType.Directory:
            fs.delete_dir(self.job)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_parts"

    def schema(self) -> str:
        return SOUND

    def reader(self, schema: Any) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WavWriter:
        return WavWriter(self.options)


# one JSON array


class JsonArrayReader(DataSourceReader):
    """Items of each file's array with their place; a root that is one object comes back as it is, without a place."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        return dealt([(p, 0, size) for p, size in listed(self.path)], PART_BYTES)

    def read(self, part: Part) -> Iterator[tuple]:
        for path, _ in part.pieces:
            fs, p = opened(path)
            with fs.open_input_stream(p) as f:
                for place, text in json_items(iter(lambda f=f: f.read(COPY_BYTES), b""), path):
                    yield (path, place, text)


def json_items(blocks: Iterator[bytes], path: str) -> Iterator[tuple[int | None, str]]:
    """Items of a JSON array that comes in blocks, each as text; memory holds a block and one item. A block is cut where the next one comes,
    not behind each item, so that the time grows with the bytes."""
    decoder, text, at, ended = json.JSONDecoder(), "", 0, False
    utf8 = codecs.getincrementaldecoder("utf-8-sig")()

    def more() -> bool:
        nonlocal text, at, ended
        block = next(blocks, b"")
        ended = not block
        text, at = text[at:] + utf8.decode(block, final=ended), 0
        return not ended

    def skip() -> str:
        nonlocal at
        while True:
            at = _SPACE.match(text, at).end()
            if at < len(text) or not more():
                return text[at : at + 1]

    mark = skip()
    if mark == "{":
        rest = [text[at:], *(utf8.decode(b) for b in blocks), utf8.decode(b"", final=True)]
        whole = "".join(rest).rstrip()
        json.loads(whole)
        yield None, whole
        return
    if mark != "[":
        raise ValueError(f"neither an array of objects nor an object: {path}")
    at, place = at + 1, 0
    if skip() == "]":
        return
    while True:
        while True:
            try:
                _, end = decoder.raw_decode(text, at)
                size = end - at
                # a number at the end of a block may go on
                if text[(behind := _SPACE.match(text, end).end()) : behind + 1] in {",", "]"} or not more():
                    break
            except json.JSONDecodeError:
                if not more():
                    raise
        yield place, text[at : at + size]
        at, place = at + size, place + 1
        mark = skip()
        at += 1
        if mark == "]":
            return
        if mark != ",":
            raise ValueError(f"no comma after item {place - 1}: {path}")
        skip()


_SPACE = re.compile(r"[ \t\r\n]*")


class JsonArrayWriter(_Beside):
    """Rows (ord, value): tasks hold ranges of ord, sorted; the ranges are copied behind one another, a few MB at a time."""

    def holds_files(self) -> bool:
        return False

    def write(self, rows: Iterator[Row]) -> Wrote:
        first, n = None, 0
        fs, target = opened(self.path)
        fs.create_dir(self.inside, recursive=True)
        temporary = self.temporary(os.path.basename(target))
        with fs.open_output_stream(temporary) as out:
            for r in rows:
                out.write(((",\n " if n else "") + r["value"]).encode())
                first, n = first if n else r["ord"], n + 1
        return Wrote([(temporary, target, (n, first))])

    def commit(self, messages: list[Wrote]) -> None:
        fs, target = opened(self.path)
        parts = in_order(messages)
        whole = self.temporary(os.path.basename(target))
        with fs.open_output_stream(whole) as out:
            out.write(b"[")
            for k, path in enumerate(parts):
                out.write(b",\n " if k else b"")
                copied(fs, path, out)
            out.write(b"]\n")
        fs.move(whole, target)
        self.clean()


def in_order(messages: list[Wrote]) -> list[str]:
    """Files of the tasks that had rows, by their first value, null first."""
    found = [f for m in messages if m for f in m.files if f[2][0]]
    return [f[0] for f in sorted(found, key=lambda f: (f[2][1] is not None, f[2][1]))]


def copied(fs: pafs.FileSystem, path: str, out: Any) -> None:
    with fs.open_input_stream(path) as f:
        while block := f.read(COPY_BYTES):
            out.write(block)


class JsonArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "file string, place long, value string"

    def reader(self, schema: Any) -> JsonArrayReader:
        return JsonArrayReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(self.options)


# a report that only grows


class ReportWriter(_Beside):
    """Rows (ord, value): blocks of text, each under its run number. A folder of files `runs-<first number>.txt`; a job claims the next
    number by making that file, which only one of several jobs can do; the others count again. Tasks hold ranges of ord, sorted."""

    write = JsonArrayWriter.write

    def holds_files(self) -> bool:
        return True

    def commit(self, messages: list[Wrote]) -> None:
        fs, folder = opened(self.path)
        if not isinstance(fs, pafs.LocalFileSystem):
            raise ValueError("the report needs a file system that can make a file only where there is none")
        parts = in_order(messages)
        while parts:
            number = first = next_number(folder)
            whole = self.temporary("runs")
            with open(whole, "w", encoding="utf-8") as out:
                for path in parts:
                    with open(path, encoding="utf-8") as f:
                        for block in f.read().split(",\n "):
                            out.write(f"Run #{number}\n{json.loads(block)}\n")
                            number += 1
            with contextlib.suppress(FileExistsError):
                os.link(whole, f"{folder}/runs-{first:012d}.txt")
                break
        self.clean()


def next_number(folder: str) -> int:
    """One more than the last run number in a report."""
    names = sorted(n for n in os.listdir(folder) if re.fullmatch(r"runs-[0-9]+\.txt", n)) if os.path.isdir(folder) else []
    if not names:
        return 1
    with open(f"{folder}/{names[-1]}", encoding="utf-8") as f:
        return max(int(x[5:]) for x in f if re.fullmatch(r"Run #[0-9]+\n?", x)) + 1


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_report"

    def schema(self) -> str:
        return "ord long, value string"

    def writer(self, schema: Any, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options)


# what a user calls


def ready(spark: SparkSession) -> None:
    """Register the formats with a session."""
    ship_package(spark)
    spark.createDataFrame([], "n int")  # makes the session the active one of this thread, where the formats are looked up
    for source in (WavSource, JsonArraySource, ReportSource):
        spark.dataSource.register(source)


def stitch(clips: DataFrame, sounds: str, folder: str, part_bytes: int = PART_BYTES, deep: bool = False) -> None:
    """clips (name, index, path): one file `name` in `folder` of the samples of its clips, in order of their index, under one header. Clips lie
    in `sounds` (`deep`: and in the folders in it).

    Headers are read and held against each other before any sample is; a name without readable clips or with clips of several formats
    raises an error, and files from before stay. Samples travel in parts of `part_bytes`; a task writes the parts of a file one after another.
    """
    spark = clips.sparkSession
    ready(spark)
    read = spark.read.format("wav_parts").option("partBytes", str(part_bytes)).option("recursiveFileLookup", str(deep).lower())
    heads = read.option("headerOnly", "true").load(sounds).select("path", "channels", "width", "rate", "bytes")
    wanted = clips.select("name", "index", F.regexp_replace("path", "^file:/+", "/").alias("path"))
    met = kept(wanted.join(heads, "path", "left"))  # each header is read once
    form = F.struct("channels", "width", "rate")
    by = met.groupBy("name").agg(F.count_if(F.col("bytes").isNull()).alias("lost"), F.min(form).alias("f1"), F.max(form).alias("f2"))
    if (bad := by.where((F.col("lost") > 0) | (F.col("f1") != F.col("f2"))).orderBy("name").first()) is not None:
        raise ValueError(f"{bad['name']}: clips are missing" if bad["lost"] else f"{bad['name']}: clips differ in format")
    w = W.partitionBy("name").orderBy("index", "path")
    places = met.withColumn("before", F.coalesce(F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("bytes").over(W.partitionBy("name")))
    parts = spark.read.format("wav_parts").option("partBytes", str(part_bytes)).option("recursiveFileLookup", str(deep).lower()).load(sounds).select("path", "offset", "payload")
    rows = parts.join(places, "path").where(F.length("payload") > 0).select("name", "channels", "width", "rate", "total", (F.col("before") + F.col("offset")).alias("offset"), "payload")
    rows.repartition("name").sortWithinPartitions("name", "offset").write.format("wav_parts").mode("append").option("path", folder).save()


def save_array(rows: DataFrame, order: str, path: str) -> None:
    """Rows as one JSON array in one file, in the order of a column."""
    ready(rows.sparkSession)
    out = rows.select(F.col(order).alias("ord"), F.to_json(F.struct(*rows.columns)).alias("value"))
    out.repartitionByRange("ord").sortWithinPartitions("ord", "value").write.format("json_array").mode("append").option("path", path).save()


def load_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Items of JSON array files: file, place and, with a schema, its columns (else value); a root object has a null place."""
    ready(spark)
    rows = spark.read.format("json_array").load(path)
    return rows if schema is None else rows.select("file", "place", F.from_json("value", schema).alias("r")).select("file", "place", "r.*")


def append_runs(rows: DataFrame, order: str, folder: str) -> None:
    """Rows as text blocks with run numbers that go on from the report's; several jobs may append at once."""
    ready(rows.sparkSession)
    lines = [F.concat(F.lit(c.replace("_", " ").title() + ": "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in rows.columns]
    block = F.to_json(F.array(F.concat_ws("\n", *lines, F.lit(""))))
    out = rows.select(F.col(order).alias("ord"), F.substring(block, F.lit(2), F.length(block) - 2).alias("value"))
    out.repartitionByRange("ord").sortWithinPartitions("ord", "value").write.format("run_report").mode("append").option("path", folder).save()

