"""Queries on text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("idx", "text"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENT = r"""s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS text FROM (SELECT doc_id,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x NOT IN ('.', '!', '?')) AS l FROM documents))"""


def fold_sql(text: str) -> str:
    """Lower case with the letters of `functions.text.FOLDED` folded."""
    out = f"lower({text})"
    for k, v in X.FOLDED.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


BUCKET = "CASE WHEN length(text) <= 200 THEN 'short' WHEN length(text) <= 500 THEN 'medium' ELSE 'long' END"
BOUNDARY = """CASE WHEN t = '' THEN NULL WHEN ends_with(t, '...') THEN 'ellipsis' WHEN ends_with(t, '"') OR ends_with(t, '''') THEN 'quote_end'
  WHEN ends_with(t, '!') THEN 'exclamation' WHEN ends_with(t, '?') THEN 'question_mark' WHEN ends_with(t, '.') THEN 'period' WHEN ends_with(t, ':') THEN 'colon'
  WHEN ends_with(t, ';') THEN 'semicolon' WHEN ends_with(t, ',') THEN 'comma' WHEN ends_with(t, '—') OR ends_with(t, '–') THEN 'dash' END"""

MODELS = ["tiny", "base", "small", "Medium", "large_v3", "large-v3-turbo", "distil-small.en", "distil-medium.en", "parakeet", "disabled", "xl", "my-large"]


def _values(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _sql_values(name: str, values: list[str]) -> str:
    quoted = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"v({name}) AS (VALUES {quoted})"


def _num(c):
    return F.coalesce(c, F.lit(0))


def chunk_bucket_distribution(spark, d):
    s = sentence_rows(spark, d).select(X.chunk_bucket(F.length("text")).alias("bucket"), F.length("text").alias("n"))
    from ..operators import aggregates

    return aggregates.bucket_distribution(s)


def abbreviations_replaced(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.replace_in_order(F.col("text"), {"the": "THE", "and": "&", "THEr": "Ther"})).alias("digest"))


def smart_punctuated(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.smart_punctuate(F.concat(F.lit("“Well”, ‘so’ "), "text", F.lit(" **bold** __ don't 'x'")))).alias("digest"), X.word_count(X.smart_punctuate(F.col("text"))).alias("n_words"))


SMART_INPUT = """'“Well”, ‘so’ ' || text || ' **bold** __ don''t ''x'''"""


def smart_sql(text: str) -> str:
    """The steps of smart punctuation; the last two, which look around, as runs of apostrophes before and behind what is no letter."""
    lines = rf"array_to_string(list_transform(string_split_regex({text}, '\r\n|\r|\n'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10))"
    out = f"translate({lines}, '“”‘’', '\"\"''''')"
    quote = "([\"''])"
    steps = (
        (r"\*\*([^*]+)\*\*", r"\1"), ("_{2,}", ""), (rf"\\{quote}", r"\1"), (rf"{quote}\s*,\s*{quote}", r"\1, \2"), (rf"{quote}\s*\.\s*{quote}", r"\1. \2"), (rf"{quote}\s*([,.])\s*{quote}\s*([,.])", r"\1\2 \3"),
        ('"', ""), (r"''+([^\p{L}\p{N}_'']|$)", r"\1"), ("''{2,}", "''"), (r"(^|[^\p{L}\p{N}_])''", r"\1"),
    )
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def term_filter(spark, d):
    return _docs(spark, d).where(F.lower("text").contains("the th")).select("doc_id", "lang")


def token_kinds(spark, d):
    tokens = _docs(spark, d).select(F.explode(X.words(F.regexp_replace("text", r"[^A-Za-z0-9 \n]", " "))).alias("token"))
    return tokens.where(F.length("token") > 0).groupBy(X.is_id_like(F.col("token")).alias("id_like")).agg(F.count("*").alias("n"), F.countDistinct(F.lower("token")).alias("n_distinct"))


def pause_tags(spark, d):
    t = F.concat_ws(" ", F.lit("[pause:200ms]"), F.when(F.col("doc_id") % 3 == 0, "[pause:x]"), F.lit("~500 ~0 ~0070"), F.col("text"))
    marked = X.inline_markers_to_pause_tags(t)
    return _docs(spark, d).select("doc_id", X.pause_tags_valid(t).alias("valid"), marked.alias("marked"), X.strip_pause_tags(marked).alias("plain"), X.strip_inline_pause_markers(F.concat(F.lit("a[1.5s]b[2s]c "), "text")).alias("bare"))


QUERIES = {
    "sentence_split": (sentence_rows, f"WITH {SENT} SELECT doc_id, idx, text FROM s"),
    "chunk_bucket_distribution": (
        chunk_bucket_distribution,
        f"""WITH {SENT}, b AS (SELECT {BUCKET} AS bucket, length(text) AS n FROM s), t AS (SELECT count(*) AS total FROM b)
SELECT bucket, count(*) AS n_chunks, 100.0 * count(*) / any_value(total) AS percent, min(n) AS min_len, max(n) AS max_len, avg(n) AS avg_len FROM b, t GROUP BY bucket""",
    ),
    "punctuation_boundary": (
        lambda s, d: sentence_rows(s, d).select("doc_id", "idx", X.punctuation_boundary(F.col("text")).alias("boundary")),
        f"WITH {SENT} SELECT doc_id, idx, {BOUNDARY} AS boundary FROM (SELECT *, {STRIP.format('text')} AS t FROM s)",
    ),
    "heading_paragraphs": (
        lambda s, d: sentence_rows(s, d).select("doc_id", "idx", X.is_heading_paragraph(F.concat_ws(" ", F.when(F.col("idx") % 7 == 0, F.lit("Chapter 1:")), "text")).alias("heading")),
        rf"""WITH {SENT}, p AS (SELECT doc_id, idx, concat_ws(' ', CASE WHEN idx % 7 = 0 THEN 'Chapter 1:' END, text) AS p FROM s)
SELECT doc_id, idx, regexp_matches(lower(p), 'chapter|section|part|prologue|epilogue') AND len(regexp_extract_all(p, '\S+')) <= 10 AS heading FROM p""",
    ),
    "speech_segments": (
        lambda s, d: sentence_rows(s, d).groupBy(X.has_speech(F.col("text")).alias("speech")).agg(F.count("*").alias("n")),
        rf"WITH {SENT} SELECT regexp_matches(text, '[\p{{L}}\p{{N}}]') AS speech, count(*) AS n FROM s GROUP BY 1",
    ),
    "pause_tags": (
        pause_tags,
        r"""WITH t AS (SELECT doc_id, text, concat_ws(' ', '[pause:200ms]', CASE WHEN doc_id % 3 = 0 THEN '[pause:x]' END, '~500 ~0 ~0070', text) AS t FROM documents),
m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '~0+([^0-9]|$)', '\1', 'g'), '~0*([0-9]+)', '[pause:\1ms]', 'g'), '$', '') AS marked FROM t)
SELECT doc_id, doc_id % 3 <> 0 AS valid, marked, regexp_replace(marked, '\[pause:[0-9]+ms\]', ' ', 'g') AS plain,
  regexp_replace('a[1.5s]b[2s]c ' || text, '\[[0-9]+(?:\.[0-9]+)?s\]', ' ', 'g') AS bare FROM m""",
    ),
    "model_ladder": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.get(F.array(*map(F.lit, MODELS)), (F.col("p_partkey") % len(MODELS)).cast("int")).alias("name")).distinct().select("name", X.model_rank(F.col("name")).alias("rank"), X.next_higher(F.col("name")).alias("next"), X.recommended_stage_two(F.col("name")).alias("stage_two")),
        f"""WITH v AS (SELECT DISTINCT [{', '.join(repr(m) for m in MODELS)}][p_partkey % {len(MODELS)} + 1] AS name FROM part), r(k, rank, nxt) AS (VALUES ('tiny', 0, 'base'), ('base', 1, 'small'), ('small', 2, 'medium'), ('distil-small.en', 2, 'distil-medium.en'), ('medium', 3, 'large-v3'),
('distil-medium.en', 3, 'medium'), ('large', 4, 'large-v3-turbo'), ('large-v2', 4, 'large-v3-turbo'), ('large-v3', 4, 'large-v3-turbo'), ('large-v3-turbo', 5, NULL), ('distil-large-v3', 5, NULL), ('parakeet-tdt-0.6b-v3', 1, NULL), ('parakeet', 1, NULL)),
j AS (SELECT name, replace(lower(name), '_', '-') AS key, a.nxt, b.rank AS nrank,
  CASE WHEN replace(lower(name), '_', '-') = 'disabled' THEN -1 ELSE coalesce(a.rank, CASE WHEN lower(name) LIKE '%medium%' OR lower(name) LIKE '%large%' THEN 3 ELSE 1 END) END AS rank
  FROM v LEFT JOIN r a ON a.k = replace(lower(name), '_', '-') LEFT JOIN r b ON b.k = a.nxt)
SELECT name, rank, nxt AS next, CASE WHEN key IN ('large-v3-turbo', 'distil-large-v3') THEN 'disabled' WHEN key = 'distil-small.en' THEN 'distil-medium.en' WHEN rank < 3 THEN 'medium'
  WHEN nxt IS NULL THEN 'disabled' WHEN nrank > rank THEN nxt ELSE 'large-v3' END AS stage_two FROM j""",
    ),
    "sanitized_names": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.sanitize_filename(F.concat(F.lit("[("), "url", F.lit(")]"))).alias("name")),
        r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace('[(' || url || ')]', '[()\[\]{}''"`<>|?*]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages""",
    ),
    "token_kinds": (
        token_kinds,
        r"""WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9 \n]', ' ', 'g'), '\S+')) AS token FROM documents), k AS (SELECT token, lower(token) AS l FROM t)
SELECT (regexp_full_match(l, '[a-z0-9]{3,}') AND regexp_matches(l, '[a-z]') AND regexp_matches(l, '[0-9]') AND NOT regexp_full_match(l, '[0-9]+(st|nd|rd|th)')) OR regexp_full_match(l, '[0-9]{4,}') AS id_like,
count(*) AS n, count(DISTINCT l) AS n_distinct FROM k GROUP BY 1""",
    ),
    "search_chunks": (term_filter, "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the th')"),
    "text_hash": (
        lambda s, d: _docs(s, d).select("doc_id", X.text_hash(F.col("text")).alias("hash")),
        rf"SELECT doc_id, sha256(regexp_replace(regexp_replace({fold_sql('text')}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS hash FROM documents",
    ),
    "abbreviations_replaced": (abbreviations_replaced, "SELECT doc_id, md5(replace(replace(replace(text, 'the', 'THE'), 'and', '&'), 'THEr', 'Ther')) AS digest FROM documents"),
    "smart_punctuated": (
        smart_punctuated,
        rf"SELECT doc_id, md5({smart_sql(SMART_INPUT)}) AS digest, len(regexp_extract_all({smart_sql('text')}, '\S+')) AS n_words FROM documents",
    ),
    "dialogue_repaired": (
        lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", X.repair_dialogue(F.concat(F.lit('\\"Yes", ". '), F.col("text"), F.when(F.col("turn") % 2 == 0, ' said "x" , "').otherwise(""))).alias("text")),
        r"""SELECT conv_id, turn, CASE WHEN contains(p, 'said') OR contains(p, 'replied') THEN regexp_replace(regexp_replace(p, '(["''])\s*,\s*["'']\s*\.', '\1.', 'g'), '(["''])\s*,\s*["'']\s*$', '\1.', 'g') ELSE p END AS text
FROM (SELECT conv_id, turn, replace('\"Yes", ". ' || text || CASE WHEN turn % 2 = 0 THEN ' said "x" , "' ELSE '' END, '\"', '"') AS p FROM conversations)""",
    ),
    "short_sentences_joined": (
        lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Yes. "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.regexp_extract("text", r"^(\S+ )", 1), F.lit("ok! Right. Sure. "), "text")).otherwise(F.regexp_replace("text", r"^(\S+).*$", "$1.")).alias("text")).select("conv_id", "turn", X.join_short_sentences(F.col("text")).alias("joined")),
        r"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Yes. ' || text WHEN 1 THEN regexp_extract(text, '^(\S+ )', 1) || 'ok! Right. Sure. ' || text ELSE regexp_replace(text, '^(\S+).*$', '\1.') END AS x FROM conversations),
t AS (SELECT *, regexp_replace(x, '^\s+|\s+$', '', 'g') AS t FROM c),
p AS (SELECT *, list_filter(list_transform(list_zip(regexp_extract_all(t, '([^.!?]*)([.!?])', 1), regexp_extract_all(t, '([^.!?]*)([.!?])', 2)), lambda z: [regexp_replace(z[1], '^\s+|\s+$', '', 'g'), z[2]]), lambda z: z[1] <> '') AS l FROM t),
n AS (SELECT *, len(list_filter(l, lambda z: len(regexp_extract_all(z[1], '\S+')) <= 3)) AS short, list_transform(l, lambda z: z[1]) AS said FROM p)
SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(t, '\S+')) = 1 AND ends_with(t, '.') THEN regexp_replace(t, '\.$', ',') WHEN short >= 2 AND len(l) >= 2 THEN array_to_string(said, ', ') || '.'
  WHEN len(l) >= 2 AND len(regexp_extract_all(said[1], '\S+')) = 1 AND l[1][2] = '.' THEN said[1] || ', ' || said[2] || CASE WHEN len(said) > 2 THEN ' ' || array_to_string(said[3:], ' ') ELSE '' END ELSE x END AS joined FROM n""",
    ),
    "min_speech_tokens": (
        lambda s, d: sentence_rows(s, d).select("doc_id", "idx", X.min_speech_tokens(F.col("text"), 200).alias("floor")),
        rf"WITH {SENT} SELECT doc_id, idx, CASE WHEN n <= 0 THEN 0 ELSE least(greatest(1, n * 5), 199) END AS floor FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM s)",
    ),
    "lang_ratio": (
        lambda s, d: _docs(s, d).select("doc_id", X.east_asian_language(F.when(F.col("doc_id") % 4 == 0, F.translate("text", "etaoinr", "漢字文書語言國")).when(F.col("doc_id") % 4 == 1, F.translate("text", "etaoinr", "かなカナひらた")).when(F.col("doc_id") % 4 == 2, F.translate("text", "etaoinr", "한글문서언어말")).otherwise(F.col("text"))).alias("lang")),
        r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN translate(text, 'etaoinr', '漢字文書語言國') WHEN 1 THEN translate(text, 'etaoinr', 'かなカナひらた') WHEN 2 THEN translate(text, 'etaoinr', '한글문서언어말') ELSE text END AS t FROM documents),
n AS (SELECT doc_id, nullif(length(regexp_replace(t, '\s+', '', 'g')), 0) AS n, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS h, len(regexp_extract_all(t, '[\x{3040}-\x{30ff}]')) AS k, len(regexp_extract_all(t, '[\x{ac00}-\x{d7af}]')) AS g FROM t)
SELECT doc_id, CASE WHEN h / n > 0.3 THEN 'zh' WHEN k / n > 0.3 THEN 'ja' WHEN g / n > 0.3 THEN 'ko' ELSE 'en' END AS lang FROM n""",
    ),
    "punc_normalized": (
        lambda s, d: sentence_rows(s, d).select("doc_id", "idx", X.punc_norm(F.col("text")).alias("text")),
        rf"""WITH {SENT}, p AS (SELECT doc_id, idx, rtrim(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
 array_to_string(regexp_extract_all(upper(substr(text, 1, 1)) || substr(text, 2), '\S+'), ' '), '...', ', '), '…', ', '), ':', ','), ' - ', ', '), ';', ', '), '—', '-'), '–', '-'), ' ,', ','), '“', '"'), '”', '"'), '‘', ''''), '’', '''')) AS t FROM s)
SELECT doc_id, idx, CASE WHEN regexp_matches(t, '[.!?,\-、，。？！]$') THEN t ELSE t || '.' END AS text FROM p""",
    ),
}
