"""Queries on ordered rows, joins, batches and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates, audio, lookup, matching, ordered, ranking, scheduling
from .text_queries import BUCKET, SENT, sentence_rows


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def report(spark, d):
    """A validation report made from documents and labels: chunk_id, passed, score, error, text."""
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    error = F.when(F.col("doc_id") % 17 == 0, "decode failed").when(F.col("doc_id") % 23 == 0, "no audio")
    return j.select(F.col("doc_id").alias("chunk_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("passed"), ((F.col("n_chars") % 100) / 100).alias("score"), error.alias("error"), "text")


REPORT = """r AS (SELECT d.doc_id AS chunk_id, coalesce(quality, 0) = 1 AS passed, (n_chars % 100) / 100 AS score,
  CASE WHEN d.doc_id % 17 = 0 THEN 'decode failed' WHEN d.doc_id % 23 = 0 THEN 'no audio' END AS error, text FROM documents d LEFT JOIN labels USING (doc_id))"""
EV = "PARTITION BY user_id ORDER BY ts, event_id"


def turns(spark, d):
    """Conversation turns as chunks; every third opens a chapter, some end a paragraph."""
    c = t(spark, d, "conversations")
    lead = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit("\n"))).when(F.col("turn") % 5 == 4, "*** ").otherwise("")
    return c.select("conv_id", "turn", F.concat(lead, "text").alias("text"), (F.col("turn") % 4 == 2).alias("is_paragraph_end"))


TURNS = """c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Chapter ' || turn || chr(10) WHEN turn % 5 = 4 THEN '*** ' ELSE '' END || text AS text, turn % 4 = 2 AS is_paragraph_end FROM conversations)"""
START = r"'^(Chapter [0-9]+|CHAPTER [0-9]+|Ch\. [0-9]+|CH\. [0-9]+|[0-9]+\.|[IVX]+\.)'"


def lines(spark, d):
    """Order lines with their place in the order (line numbers repeat in the data)."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return ranking.dealt(t(spark, d, "lineitem"), ["l_orderkey"]).withColumn("place", place)


LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem)"


def durations(spark, d):
    return lines(spark, d).select(F.col("l_orderkey").alias("orderkey"), F.col("place").alias("index"), (F.col("l_quantity") * 10).alias("duration_s"))


def line_timeline(spark, d):
    rows = lines(spark, d).select(F.col("l_orderkey").alias("orderkey"), F.col("place").alias("index"), F.col("l_returnflag").alias("flag"))
    return ordered.timeline(rows, durations(spark, d), ["orderkey"])


def chapter_runs(spark, d):
    tl = line_timeline(spark, d)
    cid = F.when(F.col("flag") == "A", 1).when(F.col("flag") == "R", 2).otherwise(0)
    mark = F.when(F.col("index") % 3 == 0, "paragraph_end").otherwise("period")
    return tl.withColumns({"chapter_id": cid, "chapter_title": F.concat(F.lit("Part "), "flag"), "boundary_type": mark})


def chapter_islands(spark, d):
    return ordered.chapters(chapter_runs(spark, d), ["orderkey"], ["index"]).select("orderkey", "island", "chapter_id", "title", "start_s", "end_s", F.size("chunk_indices").alias("n_chunks"), F.array_join("boundary_types", ",").alias("marks"))


def event_attempts(spark, d):
    """Events as attempts: each user a chunk, the n-th event the n-th attempt."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t(spark, d, "events").select(F.col("user_id").alias("chunk_id"), n.alias("attempt"), (F.floor(F.col("value")) / 10).alias("score"))


def part_chunks(spark, d):
    p = t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("index"), F.length("p_name").alias("length"), audio.binned(F.col("p_retailprice") / 1000 % 1).alias("exaggeration"), (F.col("p_size") % 2 * 0.5).alias("cfg_weight")
    )


def microbatches(spark, d):
    return aggregates.micro_batches(part_chunks(spark, d), ["exaggeration", "cfg_weight"], F.when(F.col("cfg_weight") > 0, 4).otherwise(8))


def intervals(spark, d):
    o = lines(spark, d)
    start = F.sum("l_quantity").over(W.partitionBy("l_orderkey").orderBy("place").rowsBetween(W.unboundedPreceding, 0)) * 100 + F.col("place") * 50
    return o.select(F.col("l_orderkey").alias("clip"), start.alias("start"), (start + F.col("l_tax") * 1000).alias("end"), F.lit(40000.0).alias("total"))


INTERVALS = LINES + ", i AS (SELECT clip, start, start + tax * 1000 AS \"end\" FROM (SELECT l_orderkey AS clip, l_tax AS tax, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY place) * 100 + place * 50 AS start FROM lines))"


def interval_map(spark, d):
    e = t(spark, d, "events")
    base = F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400
    segments = e.select((F.col("event_id") % 7).alias("key"), F.col("event_id").alias("seg"), base.cast("double").alias("start"), (base + F.col("value")).alias("end"))
    regions = spark.range(7 * 12).select((F.col("id") % 7).alias("key"), F.floor(F.col("id") / 7).alias("region"), (F.floor(F.col("id") / 7) * 7200.0 + 600).alias("r_start"), (F.floor(F.col("id") / 7) * 7200.0 + 6600).alias("r_end"))
    return matching.segments_to_regions(segments, regions)


def samples(spark, d):
    """Embeddings as short clips."""
    return t(spark, d, "embeddings").select("vec_id", "label", "embedding")


def embedding_pairs(spark, d):
    e = t(spark, d, "embeddings")
    a = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    return a.join(e, "vec_id").select("left_id", F.col("vec_id").alias("right_id"), F.round(audio.cosine(F.col("a"), F.col("embedding")), 6).alias("cosine"))


def schedule_batches(spark, d):
    docs = t(spark, d, "documents").select("source", F.col("doc_id").alias("item_id"), (F.col("n_chars") % 1500 + 1).cast("int").alias("token_length"))
    return scheduling.schedule(docs, "source", {2: 1400, 3: 1000}, 3)


def text_f1(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: w != ""))
    docs = t(spark, d, "documents").select("doc_id", words(F.col("text")).alias("a"))  # sets, not texts, are shuffled
    j = docs.join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    na, nb, both = F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b"))
    f1 = F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(2.0 * both / (na + nb))
    return j.select("doc_id", f1.alias("f1"))


def failed_ids(failed, most):
    """The first ids as text, and how many more there are; only `most` ids and one count meet in a task."""
    first = failed.orderBy("chunk_id").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ", ").alias("first_ids"))
    more = failed.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))
    return first.join(F.broadcast(more))  # one row each


def packed(spark, d):
    s = t(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("sentences"))
    return ordered.pack_to_min(s, ["doc_id"], 20)


def stage_cascade(spark, d):
    one = report(spark, d).drop("text")
    two = one.where("chunk_id % 3 <> 0").select("chunk_id", (F.col("score") > 0.7).alias("passed"), (1 - F.col("score")).alias("score"), F.when(F.col("chunk_id") % 29 == 0, "lost").alias("error"))
    return lookup.cascade(one, two, 0.5)


def cut_sql(which: str) -> str:
    """Greedy cuts at ten minutes of the islands for which a condition holds."""
    same = lambda a, b: f"{a}.orderkey = {b}.orderkey AND {a}.island = {b}.island"
    return f"""WITH RECURSIVE {LINES}, l AS (SELECT l_orderkey AS orderkey, place AS i, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS cid, sum(l_quantity * 10) OVER w AS e, l_quantity * 10 AS dur FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
f AS (SELECT *, CASE WHEN lag(cid) OVER (PARTITION BY orderkey ORDER BY i) <> cid THEN 1 ELSE 0 END AS opens, bool_or(cid > 0) OVER (PARTITION BY orderkey) AS headed FROM l),
g AS (SELECT orderkey, i, e, e - dur AS s, headed, CASE WHEN i % 3 = 0 THEN 'paragraph_end' ELSE 'period' END AS mark, sum(opens) OVER (PARTITION BY orderkey ORDER BY i) AS island FROM f),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY orderkey, island ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY orderkey, island) AS n,
  {which} AND max(e) OVER (PARTITION BY orderkey, island) - min(s) OVER (PARTITION BY orderkey, island) > 600.5 AS long FROM g),
o AS (SELECT a.orderkey, a.island, a.pos, a.n, coalesce(min(b.pos), a.n - 1) AS over FROM p a LEFT JOIN p b ON {same("a", "b")} AND b.pos >= a.pos AND b.e + 0.01 >= a.s + 600 WHERE a.long GROUP BY a.orderkey, a.island, a.pos, a.n),
c AS MATERIALIZED (SELECT o.orderkey, o.island, o.pos, o.n, CASE WHEN over = o.n - 1 THEN over ELSE coalesce(min(v.pos) FILTER (v.mark = 'paragraph_end'), max(v.pos) FILTER (v.mark = 'period'), over) END AS cut
  FROM o JOIN p v ON {same("v", "o")} AND v.pos BETWEEN over AND over + 39 GROUP BY o.orderkey, o.island, o.pos, o.n, over),
r AS (SELECT orderkey, island, 0 AS part, pos FROM c WHERE pos = 0 UNION ALL SELECT r.orderkey, r.island, part + 1, c.cut + 1 FROM r JOIN c ON {same("c", "r")} AND c.pos = r.pos WHERE c.cut < c.n - 1)
SELECT r.orderkey, r.island, part, a.i AS start_index, b.i AS end_index, a.s AS start_s, b.e AS end_s
FROM r JOIN c ON {same("c", "r")} AND c.pos = r.pos JOIN p a ON {same("a", "r")} AND a.pos = r.pos JOIN p b ON {same("b", "r")} AND b.pos = c.cut
UNION ALL SELECT orderkey, island, 0, min(i), max(i), min(s), max(e) FROM p WHERE NOT long GROUP BY orderkey, island"""


SCHEDULE = """WITH RECURSIVE i AS MATERIALIZED (SELECT source, doc_id AS item_id, n_chars % 1500 + 1 AS len, row_number() OVER (PARTITION BY source ORDER BY n_chars % 1500 + 1, doc_id) AS p FROM documents),
f AS (SELECT DISTINCT source, 0::BIGINT AS e, 0 AS last, {'c': 0::BIGINT, 'k': 0::BIGINT} AS a, NULL::STRUCT(c BIGINT, k BIGINT) AS b, NULL::STRUCT(c BIGINT, k BIGINT) AS d FROM i
 UNION ALL SELECT source, e + 1, -o.z, {'c': o.c, 'k': o.k}, a, b FROM (SELECT f.*, list_min([{'c': a.c + 6 * len, 'k': a.k + 1, 'z': -1}, CASE WHEN len <= 1400 AND b IS NOT NULL THEN {'c': b.c + 3 * len, 'k': b.k + 1, 'z': -2} END,
   CASE WHEN len <= 1000 AND d IS NOT NULL THEN {'c': d.c + 2 * len, 'k': d.k + 1, 'z': -3} END]) AS o FROM f JOIN i ON i.source = f.source AND i.p = f.e + 1)),
w AS (SELECT source, max(p) AS e FROM i GROUP BY source UNION ALL SELECT w.source, w.e - f.last FROM w JOIN f ON f.source = w.source AND f.e = w.e WHERE w.e > 0)
SELECT i.source, item_id, len::INTEGER AS token_length, count(w.e)::INTEGER AS batch FROM i LEFT JOIN w ON w.source = i.source AND w.e > 0 AND w.e <= i.p - 1 GROUP BY ALL"""


QUERIES = {
    "moving_average_smooth": (
        lambda s, d: ordered.smooth(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("smoothed", 6).alias("smoothed")),
        f"SELECT event_id, round(avg(value) OVER ({EV} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM events",
    ),
    "exp_decay_smooth": (
        lambda s, d: ordered.smooth(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value", "exp_decay").select("event_id", F.round("smoothed", 6).alias("smoothed")),
        f"""SELECT event_id, round((0.5 * value + 0.3 * coalesce(a, 0) + 0.2 * coalesce(b, 0)) / (0.5 + CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END), 6) AS smoothed
FROM (SELECT *, lag(value, 1) OVER ({EV}) AS a, lag(value, 2) OVER ({EV}) AS b FROM events)""",
    ),
    "content_boundaries": (
        lambda s, d: ordered.content_boundaries(turns(s, d), ["conv_id"], ["turn"]).select("conv_id", "turn", "boundary_type"),
        rf"""WITH {TURNS}, n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM c)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\*{{3,}}|#{{3,}}|—{{3,}}') THEN 'section_break' WHEN regexp_matches(trim(nxt), {START}) THEN 'chapter_end'
 WHEN regexp_matches(t, '(?m)' || {START}) THEN 'chapter_start' WHEN is_paragraph_end THEN 'paragraph_end' WHEN t = '' THEN NULL WHEN ends_with(t, '...') THEN 'ellipsis' WHEN ends_with(t, '"') OR ends_with(t, '''') THEN 'quote_end'
  WHEN ends_with(t, '!') THEN 'exclamation' WHEN ends_with(t, '?') THEN 'question_mark' WHEN ends_with(t, '.') THEN 'period' WHEN ends_with(t, ':') THEN 'colon'
  WHEN ends_with(t, ';') THEN 'semicolon' WHEN ends_with(t, ',') THEN 'comma' WHEN ends_with(t, '—') OR ends_with(t, '–') THEN 'dash' END AS boundary_type FROM n""",
    ),
    "chapter_ids": (
        lambda s, d: ordered.assign_chapters(turns(s, d), ["conv_id"], ["turn"]).select("conv_id", "turn", "chapter_id", "chapter_title"),
        f"""WITH {TURNS} SELECT conv_id, turn, count(h) OVER w AS chapter_id, coalesce(last_value(h IGNORE NULLS) OVER w, 'Front matter') AS chapter_title
FROM (SELECT *, CASE WHEN turn % 3 = 1 THEN 'Chapter ' || turn END AS h FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    ),
    "chapter_gaps_filled": (
        lambda s, d: ordered.fill_chapters(turns(s, d).withColumns({"chapter_id": F.when(F.col("turn") % 2 == 0, F.col("turn")), "chapter_number": F.when(F.col("turn") == 3, 7), "chapter_title": F.when(F.col("turn") == 2, "Two")})).select("conv_id", "turn", "chapter_id", "chapter_title"),
        """SELECT conv_id, turn, i AS chapter_id, CASE WHEN turn = 2 THEN 'Two' WHEN i = 0 THEN 'Front matter' ELSE 'Chapter ' || i END AS chapter_title
FROM (SELECT conv_id, turn, (CASE WHEN turn % 2 = 0 THEN turn WHEN turn = 3 THEN 7 ELSE 0 END)::INT AS i FROM conversations)""",
    ),
    "timeline": (
        lambda s, d: line_timeline(s, d).groupBy("orderkey", "index").agg(F.max("start_s").alias("start_s"), F.max("end_s").alias("end_s")),
        f"WITH {LINES} SELECT l_orderkey AS orderkey, place AS \"index\", sum(l_quantity * 10) OVER w - l_quantity * 10 AS start_s, sum(l_quantity * 10) OVER w AS end_s FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)",
    ),
    "chapter_islands": (
        chapter_islands,
        f"""WITH {LINES}, l AS (SELECT l_orderkey AS orderkey, place AS i, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS cid, 'Part ' || l_returnflag AS title, sum(l_quantity * 10) OVER w AS e, l_quantity * 10 AS dur FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
f AS (SELECT *, CASE WHEN lag(cid) OVER (PARTITION BY orderkey ORDER BY i) <> cid THEN 1 ELSE 0 END AS opens FROM l), g AS (SELECT *, sum(opens) OVER (PARTITION BY orderkey ORDER BY i) AS island FROM f)
SELECT orderkey, island, min(cid) AS chapter_id, CASE WHEN min(cid) = 0 THEN 'Front matter' ELSE min(title) END AS title, min(e - dur) AS start_s, max(e) AS end_s, count(*) AS n_chunks,
 string_agg(CASE WHEN i % 3 = 0 THEN 'paragraph_end' ELSE 'period' END, ',' ORDER BY i) AS marks FROM g GROUP BY orderkey, island""",
    ),
    "chapter_subdivide": (lambda s, d: scheduling.subdivide(ordered.islands(chapter_runs(s, d), ["orderkey"], ["index"], "chapter_id"), ["orderkey", "island"], 10.0), cut_sql("true")),
    "chapter_export_plan": (lambda s, d: scheduling.export_plan(ordered.islands(chapter_runs(s, d), ["orderkey"], ["index"], "chapter_id"), ["orderkey"], "headings_or_minutes", 10.0), cut_sql("NOT headed")),
    "chunk_word_totals": (
        lambda s, d: packed(s, d).groupBy("doc_id").agg(F.sum(X.word_count(F.col("text"))).alias("n_words")),
        rf"WITH {SENT} SELECT doc_id, sum(len(regexp_extract_all(text, '\S+'))) AS n_words FROM s GROUP BY doc_id",
    ),
    "missing_ids": (
        lambda s, d: lookup.missing_ids(t(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber"),
        """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), m AS (SELECT l_orderkey, max(l_linenumber) AS k FROM p GROUP BY 1)
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, unnest(range(1, k + 1)) AS l_linenumber FROM m) ANTI JOIN p USING (l_orderkey, l_linenumber)""",
    ),
    "resume_points": (
        lambda s, d: lookup.resume_point(t(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")), ["l_orderkey"], "l_linenumber"),
        """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), m AS (SELECT l_orderkey, max(l_linenumber) AS k FROM p GROUP BY 1)
SELECT l_orderkey, min(n) AS resume_at FROM (SELECT l_orderkey, unnest(range(1, k + 2)) AS n FROM m) r ANTI JOIN p ON p.l_orderkey = r.l_orderkey AND p.l_linenumber = r.n GROUP BY l_orderkey""",
    ),
    "completeness": (
        lambda s, d: lookup.completeness(t(s, d, "documents").select("doc_id"), t(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("valid")), "doc_id"),
        "SELECT doc_id, CASE WHEN max(quality) IS NULL THEN 'missing' WHEN max(quality) = 1 THEN 'ok' ELSE 'invalid' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id",
    ),
    "resume_skips_done": (
        lambda s, d: t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left_anti").select("doc_id"),
        "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    ),
    "text_offset": (
        lambda s, d: lookup.text_offset(t(s, d, "documents").select(F.col("doc_id").alias("id")), t(s, d, "labels").select((F.col("doc_id") + 1).alias("id"))),
        """SELECT k AS "offset", n FROM (SELECT k, p, count(l.doc_id) AS n FROM (SELECT doc_id, unnest([0, 1, -1]) AS k, unnest([0, 1, 2]) AS p FROM documents) d LEFT JOIN labels l ON l.doc_id + 1 = d.doc_id + k GROUP BY ALL) ORDER BY n DESC, p LIMIT 1""",
    ),
    "texts_by_offset": (
        lambda s, d: lookup.with_texts(t(s, d, "documents").select(F.col("doc_id").alias("id")), t(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 1),
        "SELECT d.doc_id AS id, coalesce(b.text, '') AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id + 1",
    ),
    "interval_map": (
        interval_map,
        """WITH s AS (SELECT event_id % 7 AS key, event_id AS seg, (floor(epoch(ts))::BIGINT % 86400)::DOUBLE AS a, (floor(epoch(ts))::BIGINT % 86400) + value AS b FROM events),
r AS (SELECT k AS key, g AS region, g * 7200.0 + 600 AS x, g * 7200.0 + 6600 AS y FROM range(7) a(k), range(12) b(g)),
m AS (SELECT s.key, seg, region, (a + b) / 2 >= x - 0.001 AND (a + b) / 2 <= y + 0.001 AS inside, least(b, y) - greatest(a, x) AS overlap FROM s JOIN r USING (key))
SELECT key, seg, region, inside FROM m QUALIFY row_number() OVER (PARTITION BY key, seg ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE overlap END DESC, region) = 1""",
    ),
    "hydrated_failures": (
        lambda s, d: lookup.unmatched_checked(lookup.confirmed_failures(report(s, d).drop("text")), t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id").select("chunk_id", "score", "lang"),
        f"WITH {REPORT} SELECT chunk_id, score, lang FROM r JOIN documents ON doc_id = chunk_id WHERE error IS NULL AND NOT passed",
    ),
    "unmatched_failures": (
        lambda s, d: lookup.split_matched(report(s, d).select("chunk_id"), t(s, d, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id")[1],
        "SELECT DISTINCT doc_id AS chunk_id FROM documents ANTI JOIN labels USING (doc_id)",
    ),
    "confirmed_failures": (
        lambda s, d: lookup.confirmed_failures(report(s, d), 0.4).select("chunk_id", "score"),
        f"WITH {REPORT} SELECT chunk_id, score FROM r WHERE error IS NULL AND (NOT passed OR score < 0.4)",
    ),
    "override_join": (
        lambda s, d: lookup.with_override(
            t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), X.text_hash(F.col("text")).alias("text_sha256")),
            t(s, d, "documents").join(t(s, d, "labels"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 1, F.lit("stale")).otherwise(X.text_hash(F.col("text"))).alias("text_sha256"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reason"), F.col("doc_id").alias("position")),
        ).select("chunk_id", "override"),
        "SELECT doc_id AS chunk_id, CASE WHEN toxic = 0 THEN 'quality ' || quality END AS override FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "first_wins_dedupe": (
        lambda s, d: aggregates.first_wins(t(s, d, "documents").where("text <> ''"), ["text"], ["doc_id"]).select("doc_id", "lang"),
        "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents WHERE text <> '' GROUP BY text",
    ),
    "last_wins_meta": (
        lambda s, d: aggregates.last_wins(t(s, d, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], "doc_id"),
        "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
    ),
    "updated_chunks": (
        lambda s, d: t(s, d, "documents").join(t(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "xx").alias("new")), "doc_id", "left").select("doc_id", F.coalesce("new", "lang").alias("lang")),
        "SELECT doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "optimization_potential": (
        lambda s, d: aggregates.optimization_potential(aggregates.bucket_distribution(sentence_rows(s, d).select(X.chunk_bucket(F.length("text")).alias("bucket"), F.length("text").alias("n")))),
        f"""WITH {SENT}, b AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM s GROUP BY 1), p AS (SELECT bucket, 100.0 * n / sum(n) OVER () AS percent FROM b)
SELECT bucket, percent, CASE WHEN percent >= 70 THEN 'high' WHEN percent >= 50 THEN 'medium' ELSE 'low' END AS potential FROM p ORDER BY percent DESC LIMIT 1""",
    ),
    "bucket_groups": (
        lambda s, d: t(s, d, "documents").groupBy("lang", X.chunk_bucket(F.col("n_chars")).alias("bucket")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("members")),
        "SELECT lang, CASE WHEN n_chars <= 200 THEN 'short' WHEN n_chars <= 500 THEN 'medium' ELSE 'long' END AS bucket, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1, 2",
    ),
    "param_microbatch": (
        microbatches,
        """WITH p AS (SELECT p_partkey AS "index", length(p_name) AS length, round(round_even((p_retailprice / 1000 % 1) / 0.05, 0) * 0.05, 3) AS exaggeration, p_size % 2 * 0.5 AS cfg_weight FROM part)
SELECT "index", length, exaggeration, cfg_weight, (row_number() OVER (PARTITION BY exaggeration, cfg_weight ORDER BY length, "index") - 1) // CASE WHEN cfg_weight > 0 THEN 4 ELSE 8 END AS batch FROM p""",
    ),
    "binning_effect": (
        lambda s, d: t(s, d, "part").agg(F.countDistinct("p_retailprice", "p_size").alias("before"), F.countDistinct(audio.binned(F.col("p_retailprice") / 1000), F.col("p_size")).alias("after")),
        "SELECT count(DISTINCT (p_retailprice, p_size)) AS before, count(DISTINCT (round(round_even(p_retailprice / 1000 / 0.05, 0) * 0.05, 3), p_size)) AS after FROM part",
    ),
    "composite_scores": (
        lambda s, d: report(s, d).select("chunk_id", F.round(aggregates.composite_score(F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id") % 10 / 10), F.when(F.col("chunk_id") % 2 == 0, F.col("score")), F.col("error")), 6).alias("composite")),
        f"""WITH {REPORT}, k AS (SELECT chunk_id, CASE WHEN chunk_id % 3 <> 0 THEN chunk_id % 10 / 10 END AS a, CASE WHEN chunk_id % 2 = 0 AND error IS NULL THEN score END AS b FROM r)
SELECT chunk_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 1.0 ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END, 6) AS composite FROM k""",
    ),
    "best_of_attempts": (
        lambda s, d: aggregates.best_attempt(event_attempts(s, d), 9.0),
        f"""WITH a AS (SELECT user_id AS chunk_id, row_number() OVER ({EV}) - 1 AS attempt, floor(value) / 10 AS score FROM events)
SELECT chunk_id, attempt, score, score < 9.0 AS still_failed, n_attempts FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n_attempts, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, attempt) AS k FROM a) WHERE k = 1""",
    ),
    "run_summary": (
        lambda s, d: t(s, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.count("*").alias("n")),
        "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS most, count(*) AS n FROM events GROUP BY 1",
    ),
    "last_n_total": (
        lambda s, d: t(s, d, "events").select("event_id", F.round(F.sum("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)), 4).alias("total")),
        f"SELECT event_id, round(sum(value) OVER ({EV} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS total FROM events",
    ),
    "book_durations": (
        lambda s, d: t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n_chunks"), F.round(F.sum("l_quantity"), 2).alias("seconds")),
        "SELECT l_returnflag, l_linestatus, count(*) AS n_chunks, round(sum(l_quantity), 2) AS seconds FROM lineitem GROUP BY ALL",
    ),
    "error_summary": (
        lambda s, d: aggregates.error_summary(report(s, d)),
        f"WITH {REPORT} SELECT min(error) || CASE WHEN count(DISTINCT error) > 1 THEN ' (+' || (count(DISTINCT error) - 1) || ' distinct)' ELSE '' END AS summary, count(*) AS n FROM r WHERE error IS NOT NULL",
    ),
    "failed_id_list": (
        lambda s, d: failed_ids(lookup.confirmed_failures(report(s, d)).select("chunk_id"), 20),
        f"WITH {REPORT}, f AS (SELECT chunk_id FROM r WHERE error IS NULL AND NOT passed) SELECT (SELECT string_agg(chunk_id::VARCHAR, ', ' ORDER BY chunk_id) FROM (SELECT chunk_id FROM f ORDER BY chunk_id LIMIT 20)) AS first_ids, greatest(count(*) - 20, 0) AS n_more FROM f",
    ),
    "term_evidence": (
        lambda s, d: aggregates.term_evidence(t(s, d, "documents").select("doc_id", "text"), 3).select("term", "occurrences", "mid_capitals", "acronyms", "lower_case", "surface"),
        """WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}|[.!?]') AS a FROM documents), x AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS token FROM l),
y AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM x), z AS (SELECT *, prev IS NULL OR prev IN ('.', '!', '?') AS start FROM y WHERE regexp_matches(token, '^[A-Za-z]'))
SELECT lower(token) AS term, count(*) AS occurrences, count(*) FILTER (regexp_matches(token, '^[A-Z][a-z]') AND NOT start) AS mid_capitals, count(*) FILTER (regexp_matches(token, '^[A-Z]{2,}$')) AS acronyms,
 count(*) FILTER (token = lower(token)) AS lower_case, arg_min(token, (doc_id, pos)) AS surface FROM z GROUP BY 1 HAVING count(*) >= 3 AND (mid_capitals >= 1 OR acronyms >= 3)""",
    ),
    "p95_index": (
        lambda s, d: aggregates.nearest_rank_95(t(s, d, "documents"), ["lang"], "n_chars"),
        "SELECT lang, n_chars AS p95 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k = floor(0.95 * (n - 1))",
    ),
    "speech_gaps": (
        lambda s, d: ordered.speech_gaps(intervals(s, d), ["clip"], 2000.0).select("clip", F.round("gap_start", 3).alias("gap_start"), F.round("gap", 3).alias("gap")),
        f"""WITH {INTERVALS} SELECT clip, round("end", 3) AS gap_start, round(nxt - "end", 3) AS gap FROM (SELECT *, lead(start) OVER (PARTITION BY clip ORDER BY start, "end") AS nxt FROM i) WHERE nxt - "end" > 2000""",
    ),
    "speech_quality": (
        lambda s, d: ordered.speech_quality(intervals(s, d), ["clip"], 100.0).select("clip", F.round("endpoint", 3).alias("endpoint"), F.round("quality", 6).alias("quality")),
        f"""WITH {INTERVALS} SELECT clip, round(arg_max("end", start), 3) AS endpoint, round(0.6 * least(sum("end" - start) / 40000, 1) + 0.4 * least(avg("end" - start) / 100, 1), 6) AS quality FROM i GROUP BY clip""",
    ),
    "progress_eta": (
        lambda s, d: ordered.progress(lines(s, d).withColumn("elapsed", F.col("place") * 2.5), ["l_orderkey"], ["place"], "elapsed").select("l_orderkey", "place", "ordinal", F.round("rate", 6).alias("rate"), F.round("eta", 6).alias("eta")),
        f"""WITH {LINES} SELECT l_orderkey, place, place AS ordinal, 0.4 AS rate, round(2.5 * (n - place), 6) AS eta
FROM (SELECT l_orderkey, place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lines)""",
    ),
    "changed_lines": (
        lambda s, d: ordered.changed_lines(t(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), "event_id", "event_type"), ["user_id"], "o", "event_type").select("event_id"),
        f"SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER ({EV}) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    ),
    "natural_order": (
        lambda s, d: t(s, d, "part").select(F.concat(F.lit("chunk_"), F.col("p_size").cast("string"), F.lit(".wav")).alias("name")).distinct().select("name", scheduling.natural_order(F.col("name")).alias("ordinal")),
        "SELECT DISTINCT 'chunk_' || p_size || '.wav' AS name, p_size AS ordinal FROM part",
    ),
    "schedule_batches": (schedule_batches, SCHEDULE),
    "schedule_totals": (
        lambda s, d: schedule_batches(s, d).groupBy("source").agg(F.count("*").alias("n_items"), F.sum(F.col("token_length").cast("long")).alias("tokens")),
        "SELECT source, count(*) AS n_items, sum(n_chars % 1500 + 1) AS tokens FROM documents GROUP BY source",
    ),
    "batches_together": (
        lambda s, d: scheduling.batchable(t(s, d, "documents").withColumn("batch", F.floor(F.col("doc_id") / 4)), ["batch"], "n_chars").select("batch", "n", "together"),
        "SELECT doc_id // 4 AS batch, count(*) AS n, count(*) >= 2 AND max(n_chars) <= greatest(min(n_chars), 1) * 1.8 AS together FROM documents GROUP BY 1",
    ),
    "renested_segments": (
        lambda s, d: audio.renest(sentence_rows(s, d), ["doc_id"], "idx", "text").select("doc_id", F.md5(F.array_join("text", "|")).alias("digest")),
        f"WITH {SENT} SELECT doc_id, md5(string_agg(text, '|' ORDER BY idx)) AS digest FROM s GROUP BY doc_id",
    ),
    "text_f1_pairs": (
        text_f1,
        r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: x <> '')) AS l FROM documents)
SELECT a.doc_id, CASE WHEN len(a.l) = 0 AND len(b.l) = 0 THEN 1.0 WHEN len(a.l) = 0 OR len(b.l) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l)) END AS f1 FROM w a JOIN w b ON b.doc_id + 1 = a.doc_id""",
    ),
    "f1_join": (
        lambda s, d: matching.f1_join(t(s, d, "documents").select(F.col("doc_id").alias("left_id"), "text"), t(s, d, "benchmark").select(F.col("item_id").alias("right_id"), "text"), 0.5),
        r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '')) AS l FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '')) AS l FROM benchmark),
f AS (SELECT doc_id AS left_id, item_id AS right_id, CASE WHEN len(w.l) = 0 AND len(b.l) = 0 THEN 1.0 WHEN len(w.l) = 0 OR len(b.l) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(w.l, b.l)) / (len(w.l) + len(b.l)) END AS f1 FROM w, b)
SELECT * FROM f WHERE f1 >= 0.5""",
    ),
    "names_found": (
        lambda s, d: matching.find_by_name(t(s, d, "part").select(F.lower(F.substring("p_name", 3, 5)).alias("wanted")).distinct(), t(s, d, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("name"))),
        "WITH w AS (SELECT DISTINCT lower(substr(p_name, 3, 5)) AS wanted FROM part) SELECT wanted, min(p_name || ' ' || p_type) AS name FROM w LEFT JOIN part ON contains(lower(p_name || ' ' || p_type), wanted) GROUP BY wanted",
    ),
    "stage_cascade": (
        stage_cascade,
        f"""WITH {REPORT}, f AS (SELECT chunk_id, score AS stage1_score FROM r WHERE error IS NULL AND (NOT passed OR score < 0.5)),
s AS (SELECT chunk_id, score > 0.7 AS p2, 1 - score AS stage2_score FROM r SEMI JOIN f USING (chunk_id) WHERE chunk_id % 3 <> 0 AND chunk_id % 29 <> 0)
SELECT chunk_id, stage1_score, stage2_score, CASE WHEN (SELECT count(*) FROM s) = 0 THEN 'confirmed' WHEN stage2_score IS NULL THEN 'unscored' WHEN NOT p2 OR stage2_score < 0.5 THEN 'confirmed' ELSE 'cleared' END AS verdict
FROM f LEFT JOIN s USING (chunk_id)""",
    ),
    "voice_candidates": (
        lambda s, d: lookup.ranked_candidates(*[t(s, d, "events").where(F.col("event_type") == e).select(F.col("user_id").alias("book"), (F.col("event_id") % 20).alias("path")) for e in ("purchase", "click", "view")]),
        "SELECT user_id AS book, event_id % 20 AS path, min(CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS priority FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY ALL",
    ),
    "voice_by_name": (
        lambda s, d: matching.find_by_name(t(s, d, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("wanted")).distinct(), t(s, d, "nation").select(F.col("n_name").alias("name"))),
        "SELECT wanted, (SELECT n_name FROM nation WHERE contains(lower(n_name), wanted) ORDER BY n_name <> wanted, n_name LIMIT 1) AS name FROM (SELECT DISTINCT lower(substr(n_name, 1, 3)) AS wanted FROM nation)",
    ),
    "cosine_pairs": (
        embedding_pairs,
        "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    ),
    "mean_vector": (
        lambda s, d: audio.mean_vector(t(s, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x")),
        """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL)
SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""",
    ),
    "clip_health": (
        lambda s, d: samples(s, d).select("vec_id", audio.health(F.col("embedding")).alias("h"), F.round(audio.rms(F.col("embedding")), 6).alias("rms"), F.round(audio.peak(F.col("embedding")), 6).alias("peak"), F.round(audio.peak_gain_db(audio.peak(F.col("embedding")).cast("double"), -3.0), 4).alias("gain_db")).select("vec_id", "h.clipping_ratio", "h.silence_ratio", "rms", "peak", "gain_db"),
        """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS pk FROM e)
SELECT vec_id, round_even(len(list_filter(x, lambda v: abs(v) > 0.98)) / len(x), 4) AS clipping_ratio, round_even(len(list_filter(x, lambda v: abs(v) < 1e-4)) / len(x), 4) AS silence_ratio,
 round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(pk, 6) AS peak, round(CASE WHEN abs(-3.0 - 20 * log10(pk)) >= 0.05 THEN greatest(-24.0, least(24.0, -3.0 - 20 * log10(pk))) END, 4) AS gain_db FROM p""",
    ),
    "energy_drops": (
        lambda s, d: samples(s, d).select("vec_id", audio.mid_energy_drop(F.col("embedding"), 8, 0.8).alias("drop")),
        """WITH l AS (SELECT vec_id, list_transform(range(0, len(embedding) - 8, 8), lambda s: sqrt(list_sum(list_transform(embedding[s + 1:s + 8], lambda v: v::DOUBLE * v)) / 8)) AS l FROM embeddings)
SELECT vec_id, coalesce(list_bool_or(list_transform(range(4, len(l)), lambda i: l[i] < 0.8 * list_avg(l) AND l[i + 1] < 0.8 * list_avg(l))), false) AS drop FROM l""",
    ),
    "clip_features": (lambda s, d: samples(s, d).select("vec_id", audio.audio_features(s, 640)(F.col("embedding")).alias("f")).select("vec_id", "f.*"), None),
    "recording_report": (
        lambda s, d: audio.recording_report(samples(s, d), ["vec_id"], "embedding", 6, True).select(
            "vec_id", *(F.round(c, 5).alias(c) for c in ("rms_db", "peak_db", "dynamic_db", "noise_floor_db", "clipped_percent", "centroid_hz", "level_spread", "overall")), *(f"{m}_mark" for m in audio.MARKS)
        ),
        """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: abs(v)) AS a, len(embedding) AS n FROM embeddings),
l AS (SELECT *, list_transform(generate_series(0, n - 31, 30), lambda s: sqrt(list_avg(list_transform(x[s + 1:s + 30], lambda v: v * v)))) AS l FROM e),
m AS (SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / n) + 1e-10) AS rms_db, 20 * log10(list_max(a) + 1e-10) AS peak_db,
 20 * log10(coalesce(list_avg(list_sort(a)[1:floor(n * 0.1)::INT]), 0) + 1e-10) AS noise_floor_db, 100 * len(list_filter(a, lambda v: v >= 0.95)) / n AS clipped_percent,
 list_transform(range(n // 2), lambda k: sqrt(pow(list_sum(list_transform(range(n), lambda j: x[j + 1] * cos(2 * pi() * k * j / n))), 2) + pow(list_sum(list_transform(range(n), lambda j: x[j + 1] * sin(2 * pi() * k * j / n))), 2))) AS mags, n,
 CASE WHEN len(l) > 1 THEN list_stddev_pop(l) / list_avg(l) END AS level_spread FROM l),
k AS (SELECT *, peak_db - noise_floor_db AS dynamic_db, 60 AS fidelity_mark, 70 AS standards_mark, CASE WHEN clipped_percent < 0.01 THEN 100 WHEN clipped_percent < 0.1 THEN 80 WHEN clipped_percent < 1 THEN 60 ELSE 30 END AS clipping_mark,
 CASE WHEN level_spread IS NULL THEN 90 WHEN level_spread < 0.1 THEN 100 WHEN level_spread < 0.2 THEN 80 WHEN level_spread < 0.3 THEN 60 ELSE 40 END AS evenness_mark FROM m),
r AS (SELECT *, CASE WHEN dynamic_db >= 60 THEN 100 WHEN dynamic_db >= 40 THEN 80 WHEN dynamic_db >= 20 THEN 60 ELSE 40 END AS range_mark FROM k)
SELECT vec_id, round(rms_db, 5) AS rms_db, round(peak_db, 5) AS peak_db, round(dynamic_db, 5) AS dynamic_db, round(noise_floor_db, 5) AS noise_floor_db, round(clipped_percent, 5) AS clipped_percent,
 round(list_sum(list_transform(range(n // 2), lambda k: k * 6.0 / n * mags[k + 1])) / list_sum(mags), 5) AS centroid_hz, round(level_spread, 5) AS level_spread, round(fidelity_mark * 0.25 + range_mark * 0.25 + clipping_mark * 0.25 + evenness_mark * 0.15 + standards_mark * 0.1, 5) AS overall,
 fidelity_mark, range_mark, clipping_mark, evenness_mark, standards_mark FROM r""",
    ),
    "window_counts": (
        lambda s, d: t(s, d, "documents").select("doc_id", audio.window_count(F.col("n_chars"), 160, 80, 0.8).alias("w")).select("doc_id", "w.n_windows", "w.target"),
        """WITH r AS (SELECT doc_id, greatest(n_chars - 80, 0) AS room FROM documents), n AS (SELECT doc_id, room // 80 + CASE WHEN room // 80 = 0 OR (room % 80 + 80) / 160 >= 0.8 THEN 1 ELSE 0 END AS n_windows FROM r)
SELECT doc_id, n_windows, 160 + (n_windows - 1) * 80 AS target FROM n""",
    ),
    "vector_partials": (
        lambda s, d: samples(s, d).select("vec_id", F.posexplode(audio.partials(F.col("embedding"), 24, 12)).alias("k", "w")).select("vec_id", "k", F.round(audio.rms(F.col("w")), 5).alias("level")),
        """WITH e AS (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(range(24), lambda i: 0.0)) AS x, len(embedding) AS n FROM embeddings),
c AS (SELECT vec_id, x, (n - 12) // 12 + CASE WHEN ((n - 12) % 12 + 12) / 24 >= 0.8 THEN 1 ELSE 0 END AS k FROM e), w AS (SELECT vec_id, x, unnest(range(k)) AS k FROM c)
SELECT vec_id, k, round(sqrt(list_sum(list_transform(x[k * 12 + 1 : k * 12 + 24], lambda v: v * v)) / 24), 5) AS level FROM w""",
    ),
    "pack_offsets": (
        lambda s, d: ranking.running_total(t(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars") + 5, "offset").drop("n_chars"),
        'SELECT source, doc_id, sum(n_chars + 5) OVER (PARTITION BY source ORDER BY doc_id) - n_chars - 5 AS "offset" FROM documents',
    ),
    "padded_rows": (
        lambda s, d: audio.padded_rows(t(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.concat("embedding", "embedding")).alias("v")), "v").select("vec_id", F.size("v").alias("n"), F.round(audio.rms(F.col("v")), 5).alias("level")),
        """WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 2 = 0 THEN embedding ELSE list_concat(embedding, embedding) END)::DOUBLE[] AS v FROM embeddings), m AS (SELECT max(len(v)) AS n FROM e)
SELECT vec_id, n, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / n), 5) AS level FROM e, m""",
    ),
    "silence_lookup": (
        lambda s, d: sentence_rows(s, d).select(X.punctuation_boundary(F.col("text")).alias("b")).select(audio.silence_after(F.col("b")).alias("ms")).groupBy("ms").agg(F.count("*").alias("n")),
        f"""WITH {SENT} SELECT CASE WHEN ends_with(text, '...') THEN 0 WHEN ends_with(text, '"') OR ends_with(text, '''') THEN 150 WHEN ends_with(text, '!') THEN 598 WHEN ends_with(text, '?') THEN 350 WHEN ends_with(text, '.') THEN 300 ELSE 0 END AS ms, count(*) AS n FROM s GROUP BY 1""",
    ),
    "sentiment_parameters": (
        lambda s, d: t(s, d, "events").select("event_id", audio.sentiment_parameters(F.floor("value") / 50 - 1, {"exaggeration": 0.4, "temperature": 0.7}, {"exaggeration": 0.5, "temperature": 0.3}).alias("p")).select("event_id", "p.*"),
        """SELECT event_id, round_even(greatest(0.1, least(0.65, 0.4 + (floor(value) / 50 - 1) * 0.5)), 2) AS exaggeration, round_even(greatest(0.1, least(2.35, 0.7 + (floor(value) / 50 - 1) * 0.3)), 2) AS temperature FROM events""",
    ),
    "retry_parameters": (
        lambda s, d: event_attempts(s, d).select("chunk_id", "attempt", audio.retry_parameters(F.struct(F.lit(0.8).alias("temperature"), F.lit(0.5).alias("exaggeration"), F.lit(0.5).alias("cfg_weight")), F.col("score") / 10, F.col("attempt"), {"temperature": 0.1, "exaggeration": 0.15, "cfg_weight": 0.1}).alias("p")).select("chunk_id", "attempt", F.round("p.temperature", 6).alias("temperature"), F.round("p.exaggeration", 6).alias("exaggeration"), F.round("p.cfg_weight", 6).alias("cfg_weight")),
        f"""WITH a AS (SELECT user_id AS chunk_id, row_number() OVER ({EV}) - 1 AS attempt, floor(value) / 100 AS q FROM events), k AS (SELECT *, CASE WHEN q < 0.3 THEN 2.0 WHEN q < 0.6 THEN 1.0 ELSE 0.5 END AS f FROM a)
SELECT chunk_id, attempt, round(CASE WHEN attempt = 1 THEN greatest(0.1, 0.8 - f * 0.1) ELSE 0.8 END, 6) AS temperature, round(CASE WHEN attempt = 2 THEN greatest(0.1, 0.5 - f * 0.15) ELSE 0.5 END, 6) AS exaggeration, round(CASE WHEN attempt = 2 THEN least(1.0, 0.5 + f * 0.1) ELSE 0.5 END, 6) AS cfg_weight FROM k""",
    ),
    "retry_plan": (
        lambda s, d: audio.retry_plan(t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 3 * 0.1 + 0.6).alias("temperature"), F.lit(0.5).alias("exaggeration"), X.sentences(F.col("text")).alias("segments")), 3, 8).select("chunk_id", "attempt", F.round("temperature", 6).alias("temperature"), "segment", "text"),
        rf"""WITH {SENT}, a AS (SELECT unnest([1, 2, 3]) AS attempt) SELECT doc_id AS chunk_id, attempt, round(greatest(0.1, doc_id % 3 * 0.1 + 0.6 - attempt * 0.1), 6) AS temperature, idx AS segment, text FROM s, a""",
    ),
    "pause_samples": (
        lambda s, d: samples(s, d).select("vec_id", F.size(audio.with_pauses(F.array("embedding", "embedding", "embedding"), F.array(F.lit(0.5), F.col("vec_id") % 4 / 4.0), 16)).alias("n")),
        "SELECT vec_id, 3 * len(embedding) + 8 + (vec_id % 4 / 4.0 * 16)::INT AS n FROM embeddings",
    ),
    "event_window_counts": (
        lambda s, d: t(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", "total"),
        "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
}
