"""Readers and writers of chunk files, reports, logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import aggregates, lookup, ordered
from .files import append_runs, load_array, save_array

PARAMS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("exaggeration", "cfg_weight", "temperature", "min_p", "top_p", "repetition_penalty")])
CHUNK = T.StructType([
    T.StructField("index", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("boundary_type", T.StringType()),
    T.StructField("sentiment_compound", T.DoubleType()), T.StructField("sentiment_raw", T.DoubleType()), T.StructField("tts_params", PARAMS), T.StructField("token_len", T.IntegerType()),
    T.StructField("chapter_id", T.IntegerType()), T.StructField("chapter_title", T.StringType()), T.StructField("_metadata", T.BooleanType()), T.StructField("voice_name", T.StringType()),
])
RECORD = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("index", T.StringType()), T.StructField("chunk_index", T.StringType()), T.StructField("expected_text", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("asr_text", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()),
    T.StructField("error", T.StringType()), T.StructField("threshold", T.DoubleType()),
])
#: Failure reports, the preferred first, and what they are called.
REPORTS = (
    ("asr_failed_regenerations.json", "Failed regenerations"),
    ("asr_investigation_failures.json", "Investigation failures"),
    ("asr_conservative_fuzzy.json", "Conservative fuzzy review"),
    ("asr_false_positives.json", "ASR false positives"),
    ("asr_near_matches.json", "ASR near matches"),
    ("asr_significant_mismatches.json", "ASR significant mismatches"),
    ("asr_manual_repair_selection.json", "Manual audio review selection"),
    ("asr_confirmed_failures.json", "Stage 2 confirmed failures"),
    ("asr_remaining_failures.json", "Still failed after regen"),
    ("asr_stage2.json", "Stage 2 report (failed rows)"),
    ("asr_stage1_failures.json", "Stage 1 failures"),
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written at once: first beside its place, then renamed into it, so that no reader sees half of it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    part = fs_path(target.getParent(), f".{target.getName()}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"cannot rename {part.toString()}")


def save_queue(jobs: DataFrame, path: str, order: str) -> None:
    """A queue of jobs as one JSON array in the order of a column."""
    save_array(jobs, order, path)


def load_queue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The jobs of a queue file with their place in it, none for a missing file. A file that is no array of objects raises an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("ord", T.IntegerType()), *schema.fields]))
    bad = F.raise_error(F.lit("the queue file must hold a JSON array of objects")).cast("string")
    jobs = F.when(F.col("place").isNotNull() & F.col("value").startswith("{"), F.col("value")).otherwise(bad)
    rows = load_array(spark, path).select(F.col("place").cast("int").alias("ord"), F.from_json(jobs, schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("ord", "r.*")


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of a JSON array; header rows go."""
    return spark.read.schema(CHUNK).json(path, multiLine=True).where(~F.coalesce("_metadata", F.lit(False))).drop("_metadata", "voice_name")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The header row, if the array starts with one."""
    files = spark.read.text(path, wholetext=True)
    raw = files.select(*files.drop("value").columns, F.from_json("value", T.ArrayType(CHUNK))[0].alias("r")).select(*files.drop("value").columns, "r.*")
    return raw.where(F.coalesce("_metadata", F.lit(False)))


def load_chunks_checked(spark: SparkSession, path: str) -> DataFrame:
    """Like `load_chunks`, but a root that is no array and a row without a text raise an error."""
    files = spark.read.text(path, wholetext=True)
    checked = files.withColumn("value", F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.raise_error(F.lit("the chunk file must hold a JSON array"))))
    keep = files.drop("value").columns
    rows = checked.select(*keep, F.explode(F.from_json("value", T.ArrayType(CHUNK))).alias("r")).select(*keep, "r.*").where(~F.coalesce("_metadata", F.lit(False)))
    return rows.withColumn("text", F.coalesce("text", F.raise_error(F.lit("each chunk needs a text")).cast("string"))).drop("_metadata", "voice_name")


def load_if_there(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame | None:
    """JSON records, none for a missing file; broken records are null rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True) if _exists(spark, path) else None


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if _exists(spark, p)), None)


def save_chunks(chunks: DataFrame, path: str, binned: bool = False) -> None:
    """JSON lines with mended dialogue; binned: synthesis parameters snapped to their grid first."""
    from ..operators import audio

    out = chunks.withColumn("text", X.repair_dialogue(F.col("text")))
    if binned:
        for p in ("exaggeration", "cfg_weight", "temperature"):
            out = out.withColumn("tts_params", F.col("tts_params").withField(p, audio.binned(F.col(f"tts_params.{p}"))))
    out.write.mode("overwrite").json(path)


def as_one_array(rows: DataFrame, order: str) -> DataFrame:
    """One JSON array of all rows of a book, in order, as a value; `files.save_array` writes one of any size to a file."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))).alias("value"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file with their position."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("pos", "line"))


def load_abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    """`short -> long` lines in file order; a later line changes the value, not the place. Nothing for a missing file."""
    if not _exists(spark, path):
        return {}
    lines = _numbered(spark, path).select("pos", F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#') and contains(line, ' -> ')")
    parts = lines.select("pos", F.trim(F.split("line", " -> ", 2)[0]).alias("k"), F.trim(F.split("line", " -> ", 2)[1]).alias("v"))
    rows = parts.groupBy("k").agg(F.min("pos").alias("first"), F.max_by("v", "pos").alias("v")).orderBy("first").collect()  # a table of settings
    return {r.k: r.v for r in rows}


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """`key: value` lines of each file; the last of a key counts."""
    lines = _numbered(spark, path).where(F.col("line").contains(":"))
    parts = lines.select("file", "pos", F.trim(F.split("line", ":", 2)[0]).alias("key"), F.trim(F.split("line", ":", 2)[1]).alias("value"))
    return parts.groupBy("file", "key").agg(F.max_by("value", "pos").alias("value"))


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Fields of run logs, one row for each file and field."""
    return ordered.last_stage_fields(_numbered(spark, path), ["file"], "pos")


def next_run_number(spark: SparkSession, path: str) -> int:
    if not _exists(spark, path):
        return 1
    n = F.regexp_extract("value", r"^Run #([0-9]+)$", 1).try_cast("long")
    return (spark.read.text(path).agg(F.max(n)).first()[0] or 0) + 1


def append_report(rows: DataFrame, path: str) -> None:
    """Rows, in the order of their first column, as one text block each, with run numbers that go on from those in the report; two jobs may append at once."""
    append_runs(rows, rows.columns[0], path)


def summary_field(spark: SparkSession, path: str, field: str = "regen_still_failed") -> DataFrame:
    """One field of a summary as text; no row where it is missing or null."""
    files = spark.read.text(path, wholetext=True)
    return files.select(*files.drop("value").columns, F.get_json_object("value", f"$.{field}").alias("still_fails")).where("still_fails is not null")


def discover_reports(spark: SparkSession, folder: str, order: tuple[tuple[str, str], ...] = REPORTS) -> DataFrame:
    """Report files of more than two bytes with their labels, the preferred first."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.json").select("path", "length", F.regexp_extract("path", "[^/]+$", 0).alias("name"))
    rank = F.array_position(F.array(*(F.lit(n) for n, _ in order)), F.col("name")).cast("int")
    label = F.get(F.array(*(F.lit(x) for _, x in order)), rank - 1)
    return files.where((F.col("length") > 2) & (rank > 0)).select("path", "name", label.alias("label"), rank.alias("rank")).orderBy("rank")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a report: a bare array, or an object with records, results or failures. Anything else raises an error."""
    files = spark.read.text(path, wholetext=True)
    keep = files.drop("value").columns
    kind = T.ArrayType(RECORD)
    inner = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), kind) for k in ("records", "results", "failures")])
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(inner)
    checked = F.coalesce(rows, F.raise_error(F.lit("the report holds no list of records")).cast(kind))
    return files.select(*keep, F.posexplode(checked).alias("pos", "r")).select(*keep, "pos", "r.*").withColumn("expected_text", F.coalesce("expected_text", "text"))


def failure_rows(spark: SparkSession, path: str, drop_passed: bool) -> DataFrame:
    """Failed rows with a number as id (chunk_id, index or chunk_index), the first of each id."""
    cid = F.coalesce(*[F.col(c).try_cast("long") for c in ("chunk_id", "index", "chunk_index")])
    rows = records(spark, path).withColumn("chunk_id", cid).where("chunk_id is not null")
    if drop_passed:
        rows = rows.where(~F.coalesce("passed", F.lit(False)))
    known = {"pos", *RECORD.fieldNames()}
    return aggregates.first_wins(rows, [*(c for c in rows.columns if c not in known), "chunk_id"], ["pos"])


def overrides(spark: SparkSession, path: str, default: str = "manual no-fail review", container: str = "passes") -> DataFrame:
    """Override entries (chunk_id, text_sha256, reason, position) of an array, or of an object that holds it under `container`; none for a missing or broken file."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "text_sha256", "reason")]))
    empty = spark.createDataFrame([], "chunk_id long, text_sha256 string, reason string, position int")
    if not _exists(spark, path):
        return empty
    files = spark.read.text(path, wholetext=True)
    keep = files.drop("value").columns
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json(F.get_json_object("value", f"$.{container}"), kind))
    rows = files.select(*keep, F.posexplode(listed).alias("position", "r"))
    out = rows.select(*keep, F.col("r.chunk_id").try_cast("long").alias("chunk_id"), "r.text_sha256", F.coalesce(F.nullif("r.reason", F.lit("")), F.lit(default)).alias("reason"), "position")
    return out.where("chunk_id is not null and length(text_sha256) = 64")


def accepted_fuzzies(spark: SparkSession, path: str) -> DataFrame:
    """Entries of failures that a listener has accepted as they are; see `lookup.advancing`."""
    return overrides(spark, path, "listener-approved context-repaired fuzzy", "accepted_fuzzies")


def diagnostics(stages: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """All stages' rows, tagged and cut to one set of fields; missing fields are null."""
    out = None
    for name, rows in stages.items():
        part = rows.select(*[F.col(f).cast("string").alias(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields]).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def manual_repairs(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows (chunk_id), marked as failed by hand."""
    return rows.join(lookup.small(selected.select("chunk_id").distinct()), "chunk_id", "left_semi").withColumns({"passed": F.lit(False), "score": F.lit(0.0), "failure_type": F.lit("manual_review")})


def numbered_audio(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_NNN.wav files in the order of their numbers, without reading them."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    number = F.regexp_extract("path", r"chunk_([0-9]{3,})\.wav$", 1).try_cast("long")
    return files.withColumn("id", number).where("id is not null").orderBy("id")


def indexed_texts(spark: SparkSession, *folders: str) -> DataFrame:
    """chunk_NNN.txt files of several folders; a later folder replaces an earlier one's."""
    out = None
    for k, folder in enumerate(folders):
        files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit(k).alias("rank"))
        out = files if out is None else out.unionByName(files)
    rows = out.withColumn("id", F.regexp_extract("path", "([0-9]+)[^0-9/]*$", 1).try_cast("long")).where("id is not null")
    return rows.groupBy("id").agg(F.max_by(F.struct("path", "text"), "rank").alias("r")).select("id", "r.path", "r.text")


def voice_of(value: Column) -> Column:
    """The voice named in a chunk file's header, else in a `// voice:` comment."""
    return F.coalesce(F.get_json_object(value, "$[0].voice_name"), F.nullif(F.regexp_extract(value, r"//\s*voice:\s*([^\n]+)", 1), F.lit("")))


def bracketed_names(names: DataFrame) -> DataFrame:
    """names (pos, name): what stands in brackets before the ending, each once, in order of first appearance."""
    hit = names.withColumn("voice", F.regexp_extract("name", r"\[([^\]]+)\]\.[A-Za-z0-9]+$", 1)).where("voice <> ''")
    return hit.groupBy("voice").agg(F.min("pos").alias("first")).orderBy("first")


def concat_manifest(files: DataFrame) -> DataFrame:
    """files (index, path) as lines of a concatenation list, quotes escaped."""
    return files.orderBy("index").select(F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'")).alias("value"))


def chapter_metadata(chapters: DataFrame) -> DataFrame:
    """chapters (start_s, end_s, title) as metadata blocks: milliseconds, an end at least 1 after the start, marks escaped."""
    start = F.bround(F.col("start_s") * 1000).cast("long")
    end = F.greatest(F.bround(F.col("end_s") * 1000).cast("long"), start + 1)
    title = F.regexp_replace("title", r"([=;#\\\n])", r"\\$1")
    block = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), start.cast("string")), F.concat(F.lit("END="), end.cast("string")), F.concat(F.lit("title="), title))
    return chapters.orderBy("start_s").select(block.alias("value"))


def stitched(clips: DataFrame, keys: list[str]) -> DataFrame:
    """clips (keys, index, format, payload binary): one payload for each key, in order; clips of unequal format raise an error."""
    by = clips.groupBy(*keys).agg(F.min("format").alias("f1"), F.max("format").alias("format"), F.array_sort(F.collect_list(F.struct("index", F.hex("payload").alias("h")))).alias("m"))
    payload = F.unhex(F.array_join(F.col("m.h"), ""))
    same = F.when(F.col("f1") == F.col("format"), payload).otherwise(F.raise_error(F.lit("clips differ in format")).cast("binary"))
    return by.select(*keys, "format", same.alias("payload"))
