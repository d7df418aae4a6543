"""Rows of synthesis jobs: metadata, evidence, parameter groups, quality, token batches, run summaries, whole enriched chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import segments
from ..functions import text as X
from . import aggregates, audio, lookup, ordered
from .ranking import kept, placed

#: Fields of a report row that hold text, lists, and numbers.
EVIDENCE_TEXTS = ("ref_normalized", "hyp_normalized", "backend", "failure_type", "device")
EVIDENCE_LISTS = ("missing_words", "extra_words", "accepted_equivalences")
EVIDENCE_NUMBERS = ("coverage_score", "phonetic_score")


def _column(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def chunk_meta(chunks: DataFrame, position: str) -> DataFrame:
    """chunk_id (else index; 0 is an id), pauses, boundary_type, text, segments of chunks, with plain values where they are missing;
    the last row of an id counts."""
    cid = F.coalesce(_column(chunks, "chunk_id", "long"), _column(chunks, "index", "long"))
    rows = chunks.select(
        cid.alias("chunk_id"),
        F.coalesce(_column(chunks, "pauses", "array<double>"), F.array().cast("array<double>")).alias("pauses"),
        F.coalesce(_column(chunks, "boundary_type", "string"), F.lit("none")).alias("boundary_type"),
        F.coalesce(_column(chunks, "text", "string"), F.lit("")).alias("text"),
        F.coalesce(_column(chunks, "segments", "array<string>"), F.array().cast("array<string>")).alias("segments"),
        F.col(position).alias("_position"),
    )
    return aggregates.last_wins(rows.where("chunk_id is not null"), ["chunk_id"], "_position").drop("_position")


def evidence(results: DataFrame, keep: list[str]) -> DataFrame:
    """The evidence fields of comparison results, whatever of them is there; an empty transcript, text or explanation falls back."""
    first = lambda *names: F.coalesce(*[F.nullif(_column(results, n, "string"), F.lit("")) for n in names], F.lit(""))
    out = {"asr_text": first("asr_text", "transcript"), "expected_text": first("expected_text", "text"), "explanation": first("explanation", "error"), "error": _column(results, "error", "string")}
    out |= {n: F.coalesce(_column(results, n, "string"), F.lit("")) for n in EVIDENCE_TEXTS}
    out |= {n: F.coalesce(_column(results, n, "array<string>"), F.array().cast("array<string>")) for n in EVIDENCE_LISTS}
    out |= {n: _column(results, n, "double") for n in EVIDENCE_NUMBERS}
    return results.select(*keep, *(c.alias(n) for n, c in out.items()))


def parameter_key(params: Column) -> Column:
    """A key of a map of JSON values in the order of their names, types kept: 1 and "1" differ, as do 1 and 1.0."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")


def first_seen_groups(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """`group` numbers the groups from 0 in the order of their first rows."""
    firsts = rows.groupBy(*keys).agg(F.min(index).alias("_first"))
    numbered = placed(firsts, [], ["_first"], "group").withColumn("group", F.col("group").cast("int")).drop("_first")
    same = None
    for k in keys:
        one = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = one if same is None else same & one
    return rows.alias("l").join(numbered.alias("r"), same).select("l.*", "r.group")


def quality_mean(scores: list[Column], healthy: Column | None = None, rest: float = 0.5) -> Column:
    """Mean of the scores there are, and of a mark for health: 0.2 wherever a check of it has a result, 0.5 where the check failed."""
    given = [*scores, *([] if healthy is None else [F.when(healthy.isNotNull(), 0.2).otherwise(0.5)])]
    n = sum((s.isNotNull().cast("int") for s in given), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(s, F.lit(0.0)) for s in given), F.lit(0.0)) / n).otherwise(rest)


def token_batches(chunks: DataFrame, index: str, tokens: str, size: int) -> DataFrame:
    """Chunks that have tokens (nested lists), flattened, numbered by index into batches of `size`. Ranks come from counts by range of
    the index, so no task sees all chunks."""
    rows = chunks.withColumn(tokens, F.flatten(tokens)).where(F.size(tokens) > 0).withColumn("_cell", F.floor(F.col(index) / 10_000))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    starts = sizes.select("_cell", F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_cell").orderBy(index)) - 1
    out = rows.withColumn("_place", place).join(starts, "_cell").withColumn("batch", F.floor((F.col("_place") + F.col("_start")) / size).cast("long"))
    return out.drop("_cell", "_place", "_start")


def worker_count(backend: Column, requested: Column, device: Column, model: Column, native_ready: Column) -> Column:
    """Workers to start: one for a resident model or a large one on a GPU, two at most for a native engine there, else as asked."""
    kind, gpu = X.normalize_backend(backend), F.lower(device).isin("cuda", "gpu")
    wanted = F.greatest(F.lit(1), F.coalesce(requested, F.lit(1)))
    large = X.model_rank(F.coalesce(F.nullif(model, F.lit("")), F.lit("base"))) >= X.MODEL_RANKS["medium"]
    return F.when(kind == "parakeet", 1).when((kind == "faster_whisper") & gpu & large, 1).when((kind == "whisper_cpp") & gpu & native_ready, F.least(wanted, F.lit(2))).otherwise(wanted)


def clock(seconds: Column) -> Column:
    """H:MM:SS of whole seconds; null of null."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def phase_status(phase: Column, label: Column, current: Column, total: Column, phase_seconds: Column, total_seconds: Column) -> Column:
    """Status of a phase: text, progress where it can be counted, elapsed times; phases 1 and 2 have a time of their own."""
    counted = current.isNotNull() & (F.coalesce(total, F.lit(0)) != 0)
    text = F.when(counted, F.concat(label, F.lit(" ("), current.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))).otherwise(label)
    text = F.when(phase.isNotNull(), F.concat(F.lit("Phase "), phase.cast("string"), F.lit(": "), text)).otherwise(text)
    return F.struct(
        text.alias("operation"), F.when(counted, current).alias("current"), F.when(counted, total).alias("total"), clock(total_seconds).alias("total_elapsed"),
        F.when(phase == 1, clock(phase_seconds)).alias("phase1_elapsed"), F.when(phase == 2, clock(phase_seconds)).alias("phase2_elapsed"),
    )


def tried_cascade(stage_one: DataFrame, second: Callable[[DataFrame], DataFrame], threshold: float) -> tuple[DataFrame, str | None]:
    """`lookup.cascade` with a second stage that is run here over the failures of the first; if it fails, however late, the cascade confirms nothing
    and its error is returned beside it. Its rows are kept in the shared folder, so that it runs once."""
    try:
        rows = kept(second(lookup.confirmed_failures(stage_one, threshold)))
    except Exception as e:
        return lookup.cascade(stage_one, None, threshold), f"{type(e).__name__}: {e}"
    return lookup.cascade(stage_one, rows, threshold), None


def run_counts(cascade: DataFrame, overrides: DataFrame | None, seconds: float) -> DataFrame:
    """One row for a run of `lookup.cascade` (chunk_id, stage1_score, stage2_score, verdict): failures of stage one, rows that stage two
    saw, confirmed, cleared, unscored, those that an override (chunk_id) lets pass, and rows a second (null without a duration)."""
    rows = cascade
    if overrides is None:
        rows = rows.withColumn("_let", F.lit(False))
    else:
        rows = rows.join(overrides.select("chunk_id").distinct().withColumn("_let", F.lit(True)), "chunk_id", "left").withColumn("_let", F.coalesce("_let", F.lit(False)))
    of = lambda v: F.count_if((F.col("verdict") == v) & ~F.col("_let"))
    return rows.agg(
        F.count("*").alias("stage1_failed"), F.count("stage2_score").alias("stage2_scored"), of("confirmed").alias("confirmed"), of("cleared").alias("cleared"),
        of("unscored").alias("unscored"), F.count_if("_let").alias("overridden"), (F.count("*") / F.nullif(F.lit(seconds), F.lit(0.0))).alias("rows_per_second"),
    )


def enriched_chunks(docs: DataFrame, keys: list[str], sentiment, base: dict[str, float], slope: dict[str, float], most: int = 28, least: int = 4, method: str = "rolling") -> DataFrame:
    """The whole way from texts to chunk records: clean, chunk, score (`sentiment`: column of text to column), smooth, parameters from the
    score, boundary, pause tags, chapters, words. docs: keys, text."""
    cleaned = docs.select(*keys, X.smart_punctuate(F.col("text")).alias("text"))
    chunks = segments.chunk_rows(cleaned, "text", keys, most=most, least=least).withColumnRenamed("idx", "index")
    scored = chunks.withColumn("sentiment_raw", sentiment(F.col("text")))
    smoothed = ordered.smooth(scored, keys, ["index"], "sentiment_raw", method).withColumnRenamed("smoothed", "sentiment_compound")
    bounded = ordered.content_boundaries(smoothed, keys, ["index"])
    tagged = bounded.withColumn("text", X.inline_markers_to_pause_tags(F.col("text"))).withColumn("boundary_type", F.coalesce("boundary_type", F.lit("none")))
    out = tagged.withColumn("tts_params", audio.sentiment_parameters(F.col("sentiment_compound"), base, slope)).withColumn("word_count", X.word_count(F.col("text")))
    return ordered.assign_chapters(out, keys, ["index"])
