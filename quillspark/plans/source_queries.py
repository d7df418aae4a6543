"""Queries of the sources and sinks: the driver's tables are written in a source's format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import lookup, ordered
from ..session import shared_dir
from ..sources import reports
from .row_queries import t


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sources/{what}-{uuid.uuid4().hex}"


def files_by(rows: DataFrame, key: str, order: str, head: str | None = None, wrap: tuple[str, str] = ("[", "]")) -> DataFrame:
    """One JSON array for each value of a key, with an optional first element and text around it. A key's rows are one book and fit in a file."""
    record = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))).alias("m"))
    first = [] if head is None else [F.expr(head)]
    body = F.array_join(F.concat(F.array(*first).cast("array<string>"), F.col("m.r")), ",")
    return by.select(key, F.concat(F.lit(wrap[0]), body, F.lit(wrap[1])).alias("value"))


def put(rows: DataFrame, path: str, *keys: str) -> str:
    rows.repartition(*keys).write.partitionBy(*keys).text(path) if keys else rows.coalesce(1).write.text(path)
    return path


def turns(s, d):
    return t(s, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("long").alias("index"), F.concat(F.lit('\\"Yes", ". '), F.col("text"), F.when(F.col("turn") % 2 == 0, ' said "x" , "').otherwise("")).alias("text"))


def chunk_files(s, d):
    head = """to_json(struct(true as _metadata, concat('voice ', book) as voice_name))"""
    return put(files_by(turns(s, d), "book", "index", head), folder(s, "chunks"), "book")


def saved(s, d):
    params = F.struct(*[((F.col("index") * 0.037 + k / 7) % 1).alias(n) for k, n in enumerate(("exaggeration", "cfg_weight", "temperature"))])
    path = folder(s, "saved")
    reports.save_chunks(turns(s, d).withColumn("tts_params", params), path, binned=True)
    kind = T.StructType([T.StructField("book", T.LongType()), *reports.CHUNK.fields])
    return s.read.schema(kind).json(path).select("book", "index", "text", "tts_params.exaggeration", "tts_params.cfg_weight", "tts_params.temperature")


def first_file(s, d):
    base = folder(s, "legacy")
    put(t(s, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("value")), f"{base}/chunks_info.json")
    put(t(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")), f"{base}/old.json")
    path = reports.first_existing(s, f"{base}/none.json", f"{base}/chunks_info.json", f"{base}/old.json")
    missing = reports.load_if_there(s, f"{base}/none.json")
    return s.read.schema("r_regionkey int, r_name string").json(path).where(F.lit(missing is None))


def abbreviations(s, d):
    n = t(s, d, "nation").orderBy("n_nationkey")
    lines = n.select(F.explode(F.array(F.concat(F.lit("k"), F.col("n_nationkey") % 10, F.lit(" -> "), F.col("n_name"), F.lit(" -> x")), F.lit("# -> no"), F.lit(" "), F.lit("no arrow"))).alias("value"))
    found = reports.load_abbreviations(s, put(lines, folder(s, "abbreviations")))
    return s.createDataFrame([(k, v, p) for p, (k, v) in enumerate(found.items())], "short string, long string, place int")


def tag_files(s, d):
    c = t(s, d, "supplier").select("s_nationkey", F.concat_ws("\n", F.concat(F.lit("name: "), F.col("s_name")), F.concat(F.lit("key:"), F.col("s_suppkey"), F.lit(": a")), F.lit("no mark")).alias("v"), "s_suppkey")
    by = c.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "v"))), lambda x: x["v"]), "\n").alias("value"))
    found = reports.key_values(s, put(by, folder(s, "tags"), "s_nationkey"))
    return found.select(F.regexp_extract("file", "s_nationkey=([0-9]+)", 1).cast("int").alias("s_nationkey"), "key", "value")


QUEUE = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_file", T.StringType()), T.StructField("quality", T.DoubleType())])


def queue_file(s, d):
    jobs = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text_file"), F.col("p_retailprice").alias("quality"))
    path = f"{folder(s, 'queue')}/queue.json"
    reports.save_queue(jobs.where("id < 0"), path, "id")
    reports.save_queue(jobs, path, "id")
    return reports.load_queue(s, path, QUEUE)


def run_logs(s, d):
    k = F.col("n_nationkey")
    lines = F.concat_ws("\n", F.concat(F.lit("Run Name: "), F.col("n_name")), F.lit("Fails: 99"), F.lit("ASR Stage 1: on"), F.concat(F.lit("Fails: "), k), F.when(k % 2 == 0, "ASR Stage 2: small"), F.when(k % 2 == 0, F.concat(F.lit("Fails: "), k + 100)), F.lit("text without mark"), F.concat(F.lit("Total Time: 1:"), k))
    found = reports.run_log(s, put(t(s, d, "nation").select("n_nationkey", lines.alias("value")), folder(s, "runs"), "n_nationkey"))
    return found.select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "field", "value")


def summaries(s, d):
    js = F.to_json(F.struct(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") * 2).alias("regen_still_failed"), F.lit(1).alias("stage1_failed")))
    found = reports.summary_field(s, put(t(s, d, "nation").select("n_nationkey", js.alias("value")), folder(s, "summaries"), "n_nationkey"))
    return found.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "still_fails")


def batch_report(s, d):
    path = folder(s, "batches")
    n = t(s, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    reports.append_report(n.where("n_nationkey < 10"), path)
    reports.append_report(n.where("n_nationkey >= 10"), path)
    lines = s.read.text(path, wholetext=False).where("value <> ''")
    return lines.groupBy("value").agg(F.count("*").alias("n")).withColumn("next_run", F.lit(reports.next_run_number(s, path)))


def report_files(s, d):
    base = folder(s, "found")
    for k, r in enumerate(t(s, d, "nation").orderBy("n_nationkey").limit(14).collect()):  # fourteen names
        name = reports.REPORTS[k][0] if k < len(reports.REPORTS) else f"{r.n_name}.json"
        reports.put_text(s, f"{base}/{name}", "[]" if k % 4 == 3 else f'[{{"chunk_id": {k}}}]')
    return reports.discover_reports(s, base).select("name", "label", "rank")


def failure_report(s, d):
    docs = t(s, d, "documents")
    cid = F.when(F.col("doc_id") % 11 == 0, F.lit("no id")).otherwise((F.col("doc_id") % 400).cast("string"))
    return docs.select("source", F.when(F.col("doc_id") % 2 == 0, cid).alias("chunk_id"), F.when(F.col("doc_id") % 2 == 1, cid).alias("index"), F.md5("text").alias("text"), (F.col("doc_id") % 3 == 0).alias("passed"), ((F.col("n_chars") % 100) / 100).alias("score"), F.col("doc_id").alias("o"))


def failures(s, d):
    rows = failure_report(s, d)
    path = folder(s, "failures")
    put(files_by(rows.where("source < 'src2'"), "source", "o", wrap=('{"kind": 1, "results": [', "]}")).unionByName(files_by(rows.where("source >= 'src2'"), "source", "o")), path, "source")
    return reports.failure_rows(s, path, True).select("source", "chunk_id", F.col("expected_text").alias("digest"), "score")


FAILURES = """f AS (SELECT source, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 400 END AS chunk_id, md5(text) AS digest, doc_id % 3 = 0 AS passed, (n_chars % 100) / 100 AS score, doc_id FROM documents)"""


def override_files(s, d):
    docs = t(s, d, "documents")
    rows = docs.select("source", F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "short").otherwise(F.sha2("text", 256)).alias("text_sha256"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("heard by "), F.col("lang"))).alias("reason"), F.col("doc_id").alias("o"))
    path = folder(s, "overrides")
    put(files_by(rows.where("source < 'src2'"), "source", "o", wrap=('{"passes": [', "]}")).unionByName(files_by(rows.where("source >= 'src2'"), "source", "o")), path, "source")
    return reports.overrides(s, path).select("source", "chunk_id", "text_sha256", "reason")


def accepted_fuzzies(s, d):
    """Failed rows that go on, as no listener has accepted them; accepted entries of every third document come from a file."""
    docs = t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("text_sha256"), "n_chars")
    entries = docs.where("chunk_id % 3 = 0").select(F.floor(F.col("chunk_id") / 100).alias("book"), F.col("chunk_id").cast("string").alias("chunk_id"), F.when(F.col("chunk_id") % 2 == 0, F.sha2("text_sha256", 256)).otherwise(F.col("text_sha256")).alias("text_sha256"), F.col("chunk_id").alias("o"))
    path = put(files_by(entries, "book", "o", wrap=('{"accepted_fuzzies": [', "]}")), folder(s, "accepted"), "book")
    return lookup.advancing(docs.where("n_chars % 2 = 0"), reports.accepted_fuzzies(s, path)).select("chunk_id")


def diagnostic_rows(s, d):
    docs, labels = t(s, d, "documents"), t(s, d, "labels")
    return reports.diagnostics({"stage1": docs.select("doc_id", "lang", "n_chars"), "stage2": labels.select("doc_id", "quality")}, ["doc_id", "lang", "quality"])


def repairs(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", F.lit(True).alias("passed"), F.lit(0.5).alias("score"))
    return reports.manual_repairs(docs, t(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("passed")))


def log_lines(s, d):
    """Lines of a run of each user: sampling bars, chunk lines, other lines."""
    e = t(s, d, "events").select("user_id", F.row_number().over(ordered.W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), "event_id", "event_type", "value")
    n = F.count("*").over(ordered.W.partitionBy("user_id"))
    chunk = F.concat(F.lit("\U0001f300 Chunk "), F.floor((F.col("pos") + 1) / 2).cast("string"), F.lit("/"), n.cast("string"), F.when(F.col("pos") % 9 == 1, " Realtime: Calculating...").otherwise(""))
    bar = F.concat(F.lit("Sampling:  18%| | "), (F.col("event_id") % 1000).cast("string"), F.lit("/1000 [00:02<00:10, "), (F.col("event_id") % 97).cast("string"), F.lit(".5it/s]"))
    line = F.when(F.col("event_type") == "click", bar).when(F.col("event_type") == "error", F.concat(F.lit(" WARNING noise "), F.col("pos").cast("string"))).when(F.col("event_type") == "signup", "").otherwise(chunk)
    return e.withColumn("line", line).select("user_id", "pos", "line")


def progress(s, d):
    return ordered.progress_lines(log_lines(s, d), ["user_id"], "pos", 5, ("noise",))


LINES = """e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT user_id, pos, n, (pos + 1) // 2 AS nth, event_id, CASE event_type WHEN 'click' THEN 'bar' WHEN 'error' THEN 'other' WHEN 'signup' THEN 'none' ELSE 'chunk' END AS kind,
  CASE event_type WHEN 'click' THEN 'Sampling:  18%| | ' || (event_id % 1000) || '/1000 [00:02<00:10, ' || (event_id % 97) || '.5it/s]' WHEN 'error' THEN ' WARNING noise ' || pos WHEN 'signup' THEN ''
  ELSE '🌀 Chunk ' || ((pos + 1) // 2) || '/' || n || CASE WHEN pos % 9 = 1 THEN ' Realtime: Calculating...' ELSE '' END END AS line FROM e),
k AS (SELECT *, kind = 'chunk' AND pos % 9 <> 1 AND (nth = 1 OR nth % 5 = 0 OR nth = n) AS due FROM l WHERE kind <> 'none'),
p AS (SELECT *, last_value(CASE WHEN due THEN line END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)"""


def clips(s, d):
    e = t(s, d, "events")
    return e.select("user_id", F.col("event_id").alias("index"), F.lit("s16").alias("format"), F.encode(F.col("event_type"), "UTF-8").alias("payload"))


def concat_list(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("index"), F.concat(F.lit("/a'b/"), F.col("n_name"), F.lit(".wav")).alias("path"))
    path = put(reports.concat_manifest(n), folder(s, "concat"))
    lines = s.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.where("line <> ''")


def chapter_blocks(s, d):
    c = t(s, d, "orders").select((F.col("o_orderkey") * 1.0005).alias("start_s"), (F.col("o_orderkey") * 1.0005 + F.col("o_orderkey") % 3 / 4).alias("end_s"), F.concat(F.lit("a=b;#"), F.col("o_orderpriority")).alias("title"))
    path = folder(s, "chapters")
    reports.chapter_metadata(c).write.text(path)
    lines = s.read.option("lineSep", "[CHAPTER]").text(path).where("trim(value) <> ''")
    field = lambda k: F.regexp_extract("value", f"(?m)^{k}=(.*)$", 1)
    return lines.select(field("START").cast("long").alias("start_ms"), field("END").cast("long").alias("end_ms"), field("title").alias("title"), field("TIMEBASE").alias("timebase"))


def listings(s, d):
    """Files named after nations: numbered audio, and texts in two folders."""
    base = folder(s, "listing")
    for r in t(s, d, "nation").collect():  # 25 names
        reports.put_text(s, f"{base}/audio/chunk_{r.n_nationkey:03d}.wav" if r.n_nationkey % 5 else f"{base}/audio/chunk_{r.n_nationkey}.mp3", "x" * r.n_nationkey)
        reports.put_text(s, f"{base}/t1/chunk_{r.n_nationkey:03d}.txt", f"first {r.n_name}")
        if r.n_nationkey % 3 == 0:
            reports.put_text(s, f"{base}/t2/chunk_{r.n_nationkey:03d}.txt", f"second {r.n_name}")
    audio = reports.numbered_audio(s, f"{base}/audio").select("id", "length")
    return reports.indexed_texts(s, f"{base}/t1", f"{base}/t2").select("id", "text").join(audio, "id", "left")


def voices(s, d):
    c = t(s, d, "customer")
    value = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('[{"_metadata": true, "voice_name": "'), F.col("c_name"), F.lit('"}, {"index": 0}]'))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("[]\n// voice: "), F.col("c_mktsegment"), F.lit("\n"))).otherwise("[]")
    return c.select("c_custkey", reports.voice_of(value).alias("voice"))


def bracket_names(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("book ["), F.col("o_orderpriority"), F.lit("]"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(""), F.lit(".wav")).alias("name"))
    return reports.bracketed_names(o)


MENDED = r"""CASE WHEN contains(p, 'said') OR contains(p, 'replied') THEN regexp_replace(regexp_replace(p, '(["''])\s*,\s*["'']\s*\.', '\1.', 'g'), '(["''])\s*,\s*["'']\s*$', '\1.', 'g') ELSE p END"""
TURNS = r"""c AS (SELECT conv_id AS book, turn AS index, '\"Yes", ". ' || text || CASE WHEN turn % 2 = 0 THEN ' said "x" , "' ELSE '' END AS text FROM conversations)"""
BINNED = "round_even(round_even({} / 0.05, 0) * 0.05, 3)"

QUERIES = {
    "chunk_files_read": (lambda s, d: reports.load_chunks(s, chunk_files(s, d)).select(F.col("book").cast("long").alias("book"), "index", "text"), f"WITH {TURNS} SELECT book, index, text FROM c"),
    "chunk_file_headers": (lambda s, d: reports.load_metadata(s, chunk_files(s, d)).select(F.col("book").cast("long").alias("book"), "voice_name"), "SELECT DISTINCT conv_id AS book, 'voice ' || conv_id AS voice_name FROM conversations"),
    "chunk_files_checked": (lambda s, d: reports.load_chunks_checked(s, chunk_files(s, d)).select(F.col("book").cast("long").alias("book"), "index", F.md5("text").alias("digest")), f"WITH {TURNS} SELECT book, index, md5(text) AS digest FROM c"),
    "saved_chunks": (
        saved,
        rf"""WITH {TURNS}, m AS (SELECT book, index, replace(text, '\"', '"') AS p, (index * 0.037::DOUBLE + 0 / 7) % 1 AS e, (index * 0.037::DOUBLE + 1 / 7) % 1 AS g, (index * 0.037::DOUBLE + 2 / 7) % 1 AS t FROM c)
SELECT book, index, {MENDED} AS text, {BINNED.format('e')} AS exaggeration, {BINNED.format('g')} AS cfg_weight, {BINNED.format('t')} AS temperature FROM m""",
    ),
    "first_chunk_file": (first_file, "SELECT r_regionkey, r_name FROM region"),
    "abbreviation_file": (
        abbreviations,
        "SELECT 'k' || n_nationkey % 10 AS short, arg_max(n_name, n_nationkey) || ' -> x' AS long, n_nationkey % 10 AS place FROM nation GROUP BY n_nationkey % 10",
    ),
    "tag_files": (
        tag_files,
        """SELECT s_nationkey, 'name' AS key, arg_max(s_name, s_suppkey) AS value FROM supplier GROUP BY ALL UNION ALL SELECT s_nationkey, 'key', max(s_suppkey) || ': a' FROM supplier GROUP BY ALL""",
    ),
    "queue_file": (queue_file, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_partkey AS id, p_name AS text_file, p_retailprice AS quality FROM part"),
    "run_logs": (
        run_logs,
        """SELECT n_nationkey, unnest(['run_name', 'fails', 'asr_stage1', 'stage1_fails', 'total_time']) AS field, unnest([n_name, '99', 'on', n_nationkey::VARCHAR, '1:' || n_nationkey]) AS value FROM nation
UNION ALL SELECT n_nationkey, unnest(['asr_stage2', 'stage2_fails']), unnest(['small', (n_nationkey + 100)::VARCHAR]) FROM nation WHERE n_nationkey % 2 = 0""",
    ),
    "summary_fields": (summaries, "SELECT n_nationkey, (n_nationkey * 2)::VARCHAR AS still_fails FROM nation WHERE n_nationkey % 3 <> 0"),
    "batch_report": (
        batch_report,
        """WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS run FROM nation),
l AS (SELECT unnest(['Run #' || run, 'N Nationkey: ' || n_nationkey, 'N Name: ' || n_name, 'N Regionkey: ' || CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR ELSE 'N/A' END]) AS value FROM n)
SELECT value, count(*) AS n, (SELECT count(*) + 1 FROM nation) AS next_run FROM l GROUP BY value""",
    ),
    "report_files": (
        report_files,
        "SELECT name, label, rank FROM (VALUES " + ", ".join(f"('{n}', '{x}', {k + 1})" for k, (n, x) in enumerate(reports.REPORTS)) + ") v(name, label, rank) WHERE (rank - 1) % 4 <> 3 AND (SELECT count(*) FROM nation) >= 14",
    ),
    "failure_files": (
        failures,
        f"""WITH {FAILURES} SELECT source, chunk_id, digest, score FROM f WHERE chunk_id IS NOT NULL AND NOT passed QUALIFY row_number() OVER (PARTITION BY source, chunk_id ORDER BY doc_id) = 1""",
    ),
    "override_files": (
        override_files,
        """SELECT source, doc_id AS chunk_id, sha256(text) AS text_sha256, CASE WHEN doc_id % 2 = 0 THEN 'heard by ' || lang ELSE 'manual no-fail review' END AS reason FROM documents WHERE doc_id % 5 <> 0""",
    ),
    "accepted_fuzzies": (accepted_fuzzies, "SELECT doc_id AS chunk_id FROM documents WHERE n_chars % 2 = 0 AND NOT (doc_id % 3 = 0 AND doc_id % 2 = 1)"),
    "diagnostic_rows": (
        diagnostic_rows,
        "SELECT doc_id::VARCHAR AS doc_id, lang, NULL::VARCHAR AS quality, 'stage1' AS stage FROM documents UNION ALL SELECT doc_id::VARCHAR, NULL, quality::VARCHAR, 'stage2' FROM labels",
    ),
    "manual_repairs": (repairs, "SELECT doc_id AS chunk_id, lang, false AS passed, 0.0::DOUBLE AS score, 'manual_review' AS failure_type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "progress_lines": (
        progress,
        f"""WITH {LINES} SELECT user_id, pos, line, CASE WHEN kind = 'bar' THEN event_id % 1000 END AS tokens, CASE WHEN kind = 'bar' THEN 1000 END AS total, CASE WHEN kind = 'bar' THEN (event_id % 97) + 0.5::DOUBLE END AS rate,
  due AND coalesce(line <> before, true) AS shown FROM p""",
    ),
    "concat_list": (concat_list, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, 'file ''/a''\\''''b/' || n_name || '.wav''' AS line FROM nation"),
    "stitched_clips": (
        lambda s, d: reports.stitched(clips(s, d), ["user_id"]).select("user_id", F.md5("payload").alias("digest"), F.octet_length("payload").alias("n")),
        "SELECT user_id, md5(string_agg(event_type, '' ORDER BY event_id)) AS digest, strlen(string_agg(event_type, '' ORDER BY event_id)) AS n FROM events GROUP BY user_id",
    ),
    "chapter_blocks": (
        chapter_blocks,
        r"""WITH c AS (SELECT round_even(o_orderkey * 1.0005::DOUBLE * 1000, 0)::BIGINT AS a, round_even((o_orderkey * 1.0005::DOUBLE + o_orderkey % 3 / 4) * 1000, 0)::BIGINT AS b, o_orderpriority FROM orders)
SELECT a AS start_ms, greatest(b, a + 1) AS end_ms, 'a\=b\;\#' || o_orderpriority AS title, '1/1000' AS timebase FROM c""",
    ),
    "file_listings": (
        listings,
        """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'second ' ELSE 'first ' END || n_name AS text, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS length FROM nation""",
    ),
    "file_voices": (voices, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS voice FROM customer"),
    "bracket_names": (bracket_names, "SELECT o_orderpriority AS voice, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL"),
}
