"""Queries of live results and of the file formats: streams run over the driver's tables until all is read, and their results are read back."""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from ..sources import files
from ..streaming import events, results
from .row_queries import t
from .source_queries import folder

NTZ = "timestamp_ntz"


def as_stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; as a pattern, since a stream's path must be a folder or a pattern."""
    return s.readStream.schema(t(s, d, name).schema).parquet(f"{d}/{name}[.]parquet")


def ended(q: StreamingQuery) -> StreamingQuery:
    q.awaitTermination()
    return q


def through(df: DataFrame, what: str) -> DataFrame:
    """The rows that a stream has given when all its files are read."""
    s = df.sparkSession
    base = f"{shared_dir(s)}/streams/{what}-{uuid.uuid4().hex}"
    ended(df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    return s.read.schema(df.schema).parquet(f"{base}/out")


# An order waits 60 days for a delivery.


def awaited_results(s, d):
    tasks = t(s, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("submitted"))
    line = t(s, d, "lineitem")
    done = line.select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("done_at"), (F.col("l_returnflag") == "N").alias("passed"), F.col("l_discount").alias("score"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("line "), F.col("l_linenumber"))).alias("error"))
    out = results.awaited(tasks, done, "60 days")
    return out.select("task_id", "submitted", "done_at", "passed", "score", "error")


# The result of an event is the one seven places later, if it comes within 40 minutes.


def awaited_stream(s, d):
    e = as_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("ts").alias("submitted"))
    done = e.select((F.col("event_id") - 7).alias("task_id"), F.col("ts").alias("done_at"), (F.col("event_type") == "view").alias("passed"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    out = through(results.awaited(tasks, done, "40 minutes"), "awaited")
    return out.select("task_id", F.col("done_at").cast(NTZ).alias("done_at"), "passed", "score", "error")


def items(e: DataFrame) -> DataFrame:
    return e.select("user_id", F.col("event_id").alias("id"), F.concat("event_type", F.lit(" "), "props").alias("payload"), F.lit(False).alias("is_end"))


def length_of(pack: pd.DataFrame) -> pd.DataFrame:
    """Lengths of payloads; a pack with an error event of a certain number fails, one alone with the smallest does so again."""
    payloads = [x if isinstance(x, str) else None for x in pack["payload"].tolist()]  # packs are small: lists take less time than columns
    bad = any(x is not None and x.startswith('error {"k": 7') for x in payloads)
    if len(payloads) > 1 and bad:
        raise RuntimeError("an error event in the pack")
    if bad and len(payloads[0]) < 15:
        raise ValueError("an error event alone")
    return pd.DataFrame({"id": pack["id"].to_numpy(), "value": [math.nan if x is None else float(len(x)) for x in payloads]})


def nulls(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def pack_results(s, d):
    return nulls(results.packed(items(t(s, d, "events")), "user_id", length_of))


def pack_stream(s, d):
    with results.state_in_rocks(s):
        return nulls(through(results.packed(items(as_stream(s, d, "events")), "user_id", length_of), "packs"))


PACKS = '''
WITH p AS (SELECT user_id, event_id AS id, event_type || ' ' || props AS payload, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS pack FROM events),
b AS (SELECT *, bool_or(starts_with(payload, 'error {"k": 7')) OVER w AND count(*) OVER w > 1 AS alone, count(*) OVER w AS n, starts_with(payload, 'error {"k": 7') AND length(payload) < 15 AS bad FROM p WINDOW w AS (PARTITION BY user_id, pack))
SELECT user_id, pack, id, CASE WHEN NOT (bad AND (alone OR n = 1)) THEN length(payload)::DOUBLE END AS value, alone OR (n = 1 AND bad) AS alone,
  CASE WHEN bad AND (alone OR n = 1) THEN 'ValueError: an error event alone' END AS error
FROM b'''


def judged(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").cast("string").alias("task_id"), (F.col("value") >= 10).alias("passed"), (F.col("value") / 100).alias("score"), F.when(F.col("event_type") == "error", F.concat(F.lit("user "), F.col("user_id"))).alias("error"))


def served(s, d) -> tuple[StreamingQuery, str]:
    base = f"{shared_dir(s)}/streams/served-{uuid.uuid4().hex}"
    return ended(results.serve(as_stream(s, d, "events"), judged, f"{base}/out", f"{base}/checkpoint")), f"{base}/out"


def watched_results(s, d):
    _, out = served(s, d)
    return results.saved_results(s, out, "task_id string, passed boolean, score double, error string")


def stream_status(s, d):
    """Counts that were observed in each batch, beside the rows that its part of the sink holds."""
    q, out = served(s, d)
    seen = [(int(p["batchId"]), *(int(m[k]) for k in ("rows", "errors", "passed", "failed"))) for p in q.recentProgress if (m := dict(p["observedMetrics"]).get("results"))]  # one row a batch
    counts = s.createDataFrame(seen, "batch long, rows long, errors long, passed long, failed long").where("rows > 0")
    rows = s.read.schema("task_id string, batch long").json(out).groupBy("batch").agg(F.count("*").alias("in_sink"))
    return counts.join(rows, "batch", "full").agg(*(F.sum(c).alias(c) for c in ("rows", "errors", "passed", "failed", "in_sink")), F.count_if(F.col("rows") != F.col("in_sink")).alias("unequal"))


def step_flags(s, d):
    """Embeddings of a label as the attention of one utterance after another."""
    e = t(s, d, "embeddings").select(F.col("label").cast("long").alias("seq"), F.col("vec_id").alias("step"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("weights"))
    out = events.monitored(e)
    return out.groupBy("seq").agg(F.max("step").alias("steps"), F.count_if("discontinuity").alias("breaks"), F.count_if("false_start").alias("false_starts"), F.count_if("complete").alias("complete"))


# Sound files of a user's events of one type, in a folder for a hundred users, stitched to one for each user.


def stitched_sounds(s, d):
    base = folder(s, "sounds")
    files.ready(s)
    e = t(s, d, "events").select("user_id", "event_type", "event_id")
    name = F.concat(F.lit("h"), F.floor(F.col("user_id") / 100), F.lit("/u"), F.col("user_id"), F.lit("-"), F.col("event_type"), F.lit(".wav"))
    text = F.transform(F.sort_array(F.collect_list("event_id")), lambda x: F.lpad(x.cast("string"), 10, "0"))
    by = e.groupBy("user_id", "event_type").agg(F.array_join(text, "").cast("binary").alias("payload"))
    clips = by.select(name.alias("name"), F.lit(1).alias("channels"), F.lit(2).alias("width"), F.lit(16000).alias("rate"), F.octet_length("payload").cast("long").alias("total"), F.lit(0).cast("long").alias("offset"), "payload")
    clips.repartition(F.substring_index("name", "/", 1)).sortWithinPartitions("name", "offset").write.format("wav_parts").mode("append").option("path", f"{base}/clips").save()
    plan = e.select("user_id", "event_type").distinct().select(F.concat(F.lit("user-"), F.col("user_id"), F.lit(".wav")).alias("name"), F.when(F.col("event_type") == "view", 0).otherwise(F.ascii("event_type")).alias("index"), F.concat(F.lit(f"{base}/clips/"), name).alias("path"))
    files.stitch(plan, f"{base}/clips", f"{base}/out", deep=True)
    rows = s.read.format("wav_parts").load(f"{base}/out")
    return rows.select(F.regexp_extract("path", "user-([0-9]+)", 1).cast("long").alias("user_id"), "channels", "width", "rate", "bytes", "offset", F.md5("payload").alias("digest"))


def chunk_array(s, d):
    path = f"{folder(s, 'array')}/chunks.json"
    c = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), "role", "text")
    files.save_array(c, "index", path)
    return files.load_array(s, path, "index long, role string, text string").select("place", "index", "role", F.md5("text").alias("digest"))


QUERIES = {
    "awaited_results": (
        awaited_results,
        """WITH r AS (SELECT o_orderkey, o_orderdate, min(struct_pack(d := l_shipdate, p := l_returnflag = 'N', s := l_discount, e := CASE WHEN l_linestatus = 'F' THEN 'line ' || l_linenumber END)) AS r
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY ALL),
x AS (SELECT *, r.d IS NOT NULL AS there FROM r)
SELECT o_orderkey AS task_id, o_orderdate AS submitted, r.d AS done_at, CASE WHEN there THEN r.p ELSE false END AS passed, CASE WHEN there THEN r.s ELSE 0.0 END AS score, CASE WHEN there THEN r.e ELSE 'no result within 60 days' END AS error FROM x""",
    ),
    "awaited_stream": (
        awaited_stream,
        """WITH j AS (SELECT a.event_id, a.ts, b.ts AS done_at, b.event_type, b.value, b.event_id IS NOT NULL AS there
  FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 7 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 40 MINUTE)
SELECT event_id AS task_id, done_at, CASE WHEN there THEN event_type = 'view' ELSE false END AS passed, CASE WHEN there THEN value ELSE 0.0 END AS score,
  CASE WHEN NOT there THEN 'no result within 40 minutes' WHEN event_type = 'error' THEN 'failed' END AS error
FROM j WHERE there OR ts + INTERVAL 40 MINUTE < (SELECT max(ts) FROM events)""",
    ),
    "pack_results": (pack_results, PACKS),
    "pack_stream": (pack_stream, PACKS + " WHERE n = 8"),
    "watched_results": (watched_results, "SELECT event_id::VARCHAR AS task_id, value >= 10 AS passed, value / 100 AS score, CASE WHEN event_type = 'error' THEN 'user ' || user_id END AS error FROM events"),
    "stream_status": (
        stream_status,
        """SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error' AND value >= 10) AS passed,
  count(*) FILTER (event_type <> 'error' AND coalesce(value < 10, true)) AS failed, count(*) AS in_sink, 0 AS unequal FROM events""",
    ),
    "step_flags": (
        step_flags,
        """WITH RECURSIVE e AS (SELECT label::BIGINT AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS w, len(embedding) AS n FROM embeddings),
m AS (SELECT seq, k, n, list_transform(range(n), lambda j: CASE WHEN j <= k THEN w[j + 1] ELSE 0.0 END) AS w FROM e),
h AS MATERIALIZED (SELECT seq, k, n, list_position(w, list_max(w)) - 1 AS here, greatest(w[n - 1], w[n]) AS edge, list_max(w[1:4]) AS early FROM m),
p AS (SELECT seq, k, n, CASE WHEN here < 7 THEN here ELSE 0 END AS place, here >= 7 AS broken FROM h WHERE k = 0
 UNION ALL SELECT h.seq, h.k, h.n, CASE WHEN here - place > -4 AND here - place < 7 THEN here ELSE place END, NOT (here - place > -4 AND here - place < 7) FROM p JOIN h ON h.seq = p.seq AND h.k = p.k + 1),
c AS (SELECT seq, k, greatest(coalesce(lag(edge) OVER w, 0), edge) > 0.1 OR max(early) OVER w < 0.5 AS unsure FROM h WINDOW w AS (PARTITION BY seq ORDER BY k)),
s AS (SELECT seq, min(k) FILTER (NOT unsure) AS started FROM c GROUP BY seq), d AS (SELECT seq, min(k) FILTER (place >= n - 3) AS done FROM p GROUP BY seq)
SELECT p.seq, max(k) + 1 AS steps, count(*) FILTER (broken) AS breaks, count(*) FILTER (started IS NULL OR k < started) AS false_starts, count(*) FILTER (k >= done) AS complete
FROM p JOIN s USING (seq) JOIN d USING (seq) GROUP BY p.seq""",
    ),
    "stitched_sounds": (
        stitched_sounds,
        """SELECT user_id, 1 AS channels, 2 AS width, 16000 AS rate, 10 * count(*) AS bytes, 0 AS offset,
  md5(string_agg(lpad(event_id::VARCHAR, 10, '0'), '' ORDER BY CASE event_type WHEN 'view' THEN 0 ELSE ascii(event_type) END, event_type, event_id)) AS digest FROM events GROUP BY user_id""",
    ),
    "chunk_array": (chunk_array, "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, conv_id * 1000 + turn AS index, role, md5(text) AS digest FROM conversations"),
}
