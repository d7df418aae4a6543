"""Joins with overrides, offsets, regions and expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_BROADCAST = 64 << 20


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marked for broadcast if the plan's statistics bound it to `most` bytes; else as it is, and the planner decides as it runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def with_override(rows: DataFrame, overrides: DataFrame, name: str = "override") -> DataFrame:
    """rows (chunk_id, text_sha256) with the reason of an override (chunk_id, text_sha256, reason, position): both must match, the last entry wins."""
    dim = overrides.where(F.length("text_sha256") == 64).groupBy("chunk_id", "text_sha256").agg(F.max_by("reason", "position").alias(name))
    return rows.join(small(dim), ["chunk_id", "text_sha256"], "left")


def advancing(failures: DataFrame, accepted: DataFrame) -> DataFrame:
    """The failures (chunk_id, text_sha256) that go on to the next stage: all but those with an accepted entry for that chunk and text. An accepted
    one stays a failure."""
    return with_override(failures, accepted, "_accepted").where("_accepted is null").drop("_accepted")


def text_offset(audio: DataFrame, texts: DataFrame, offsets: tuple[int, ...] = (0, 1, -1)) -> DataFrame:
    """The offset k with most audio ids whose text id is id + k; of equals the first listed."""
    tried = audio.select("id", F.posexplode(F.array(*map(F.lit, offsets))).alias("place", "offset")).withColumn("text_id", (F.col("id") + F.col("offset")).cast("long"))
    hits = tried.join(texts.select(F.col("id").alias("text_id")).distinct(), "text_id", "left_semi").groupBy("place", "offset").agg(F.count("*").alias("n"))
    best = hits.agg(F.max(F.struct("n", (-F.col("place")).alias("p"), "offset")).alias("b"))
    return best.select(F.coalesce("b.offset", F.lit(offsets[0])).alias("offset"), F.coalesce("b.n", F.lit(0)).alias("n"))


def with_texts(audio: DataFrame, texts: DataFrame, offset: int) -> DataFrame:
    """Left join on id + offset; a missing text is empty."""
    right = texts.select((F.col("id") - offset).alias("id"), "text")
    return audio.join(right, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def missing_ids(present: DataFrame, keys: list[str], id_: str, low: int = 1) -> DataFrame:
    """Ids from `low` to the greatest of each group that have no row, found from neighbours' gaps, so no range is spelled out but the gaps."""
    ids = present.where(F.col(id_) >= low).select(*keys, id_).distinct()
    before = F.coalesce(F.lag(id_).over(W.partitionBy(*keys).orderBy(id_)), F.lit(low - 1))
    gaps = ids.withColumn("_before", before).where(F.col(id_) - F.col("_before") > 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col("_before") + 1, F.col(id_) - 1)).alias(id_))


def resume_point(present: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """The smallest missing id, else the last one plus 1."""
    first = missing_ids(present, keys, id_).groupBy(*keys).agg(F.min(id_).alias("_missing"))
    return present.groupBy(*keys).agg(F.max(id_).alias("_last")).join(first, keys, "left").select(*keys, F.coalesce("_missing", F.col("_last") + 1).alias("resume_at"))


def completeness(expected: DataFrame, present: DataFrame, id_: str) -> DataFrame:
    """expected ids with status missing, invalid (present but not valid) or ok. present (id, valid)."""
    have = present.groupBy(id_).agg(F.max("valid").alias("valid"))
    return expected.join(have, id_, "left").select(id_, F.when(F.col("valid").isNull(), "missing").when(~F.col("valid"), "invalid").otherwise("ok").alias("status"))


def unmatched_checked(rows: DataFrame, source: DataFrame, id_: str) -> DataFrame:
    """Rows joined with their source; a row without one raises an error."""
    joined = rows.join(source.withColumn("_there", F.lit(True)), id_, "left")
    ok = F.coalesce("_there", F.raise_error(F.concat(F.lit("no source row for "), F.col(id_).cast("string"))).cast("boolean"))
    return joined.where(ok).drop("_there")


def split_matched(rows: DataFrame, source: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have a source row, and the ids of those without."""
    return rows.join(source, id_), rows.join(source, id_, "left_anti").select(id_).distinct()


def ranked_candidates(*sources: DataFrame) -> DataFrame:
    """Union of sources (book, path), each path once with its best (first) source."""
    out = None
    for k, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("book", "path").agg(F.min("priority").alias("priority"))


def scored(score: Column, error: Column) -> Column:
    return score.isNotNull() & (F.coalesce(error, F.lit("")) == "")


def confirmed_failures(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """Scored rows (passed, score, error) that did not pass; with a threshold also those below it."""
    bad = ~F.coalesce("passed", F.lit(False))
    if threshold is not None:
        bad = bad | (F.col("score") < threshold)
    return rows.where(scored(F.col("score"), F.col("error")) & bad)


def cascade(stage_one: DataFrame, stage_two: DataFrame | None, threshold: float) -> DataFrame:
    """Failures of stage one that stage two, which sees only those, confirms; stage-one failures stand where it has no scored row at all. Without a
    stage two (None: it has failed, see `jobs.tried_cascade`) nothing is confirmed, and all verdicts are `stage2_failed`.

    Columns chunk_id, passed, score, error; result chunk_id, stage1_score, stage2_score, verdict."""
    first = confirmed_failures(stage_one, threshold).select("chunk_id", F.col("score").alias("stage1_score"))
    if stage_two is None:
        return first.select("chunk_id", "stage1_score", F.lit(None).cast("double").alias("stage2_score"), F.lit("stage2_failed").alias("verdict"))
    second = stage_two.join(first.select("chunk_id"), "chunk_id", "left_semi").where(scored(F.col("score"), F.col("error")))
    any_second = second.agg(F.count("*").alias("n_second"))
    joined = first.join(second.select("chunk_id", F.col("score").alias("stage2_score"), F.col("passed").alias("p2")), "chunk_id", "left").join(F.broadcast(any_second))
    fails = (~F.coalesce("p2", F.lit(False))) | (F.col("stage2_score") < threshold)
    verdict = F.when(F.col("n_second") == 0, "confirmed").when(F.col("stage2_score").isNull(), "unscored").when(fails, "confirmed").otherwise("cleared")
    return joined.select("chunk_id", "stage1_score", "stage2_score", verdict.alias("verdict"))
