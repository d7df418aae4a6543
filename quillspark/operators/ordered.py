"""Operators that follow the order of rows inside a document, user or url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Weights of the current score and the two before it.
DECAY = (0.5, 0.3, 0.2)


def smooth(rows: DataFrame, keys: list[str], order: list[str], score: str, method: str = "rolling", width: int = 3) -> DataFrame:
    """`smoothed`: trailing mean of `width` rows, or decaying weights renormalised over the rows there are; else the score."""
    w = W.partitionBy(*keys).orderBy(*order)
    if method == "rolling":
        out = F.avg(score).over(w.rowsBetween(1 - width, 0))
    elif method == "exp_decay":
        lags = [F.col(score) if k == 0 else F.lag(score, k).over(w) for k in range(min(width, len(DECAY)))]
        total = sum((F.when(x.isNotNull(), F.lit(q)).otherwise(0.0) for x, q in zip(lags, DECAY, strict=False)), F.lit(0.0))
        out = sum((F.coalesce(x, F.lit(0.0)) * q for x, q in zip(lags, DECAY, strict=False)), F.lit(0.0)) / total
    else:
        out = F.col(score)
    return rows.withColumn("smoothed", out)


def content_boundaries(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`boundary_type` of chunks (text, is_paragraph_end): section break, else end before a chapter, else chapter start,
    else paragraph end, else the closing mark unless pauses are tagged already."""
    following = F.lead("text").over(W.partitionBy(*keys).orderBy(*order))
    text = F.col("text")
    label = (
        F.when(X.section_break(text), "section_break")
        .when(X.chapter_start(following, False), "chapter_end")
        .when(X.chapter_start(text, True), "chapter_start")
        .when(F.col("is_paragraph_end"), "paragraph_end")
        .when(~text.contains("[pause:"), X.punctuation_boundary(text))
    )
    return chunks.withColumn("boundary_type", label)


def assign_chapters(chunks: DataFrame, keys: list[str], order: list[str], header: Column | None = None) -> DataFrame:
    """`chapter_id` counts the headings so far (0 is front matter), `chapter_title` carries the last heading's title on.

    header: a struct with `title`, null where there is no heading; by default that of `functions.text.chapter_header`."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    title = (X.chapter_header(F.col("text")) if header is None else header).getField("title")
    out = chunks.withColumn("_title", title)
    number = F.count("_title").over(w)
    return out.withColumns({"chapter_id": number, "chapter_title": F.coalesce(F.last("_title", ignorenulls=True).over(w), F.lit("Front matter"))}).drop("_title")


def fill_chapters(chunks: DataFrame, number: str = "chapter_number") -> DataFrame:
    """Chunks some of which have a chapter_id: the gaps get their number or 0, missing titles a plain one."""
    cid = F.coalesce(F.col("chapter_id").cast("int"), F.col(number).cast("int"), F.lit(0))
    plain = F.when(cid == 0, "Front matter").otherwise(F.concat(F.lit("Chapter "), cid.cast("string")))
    return chunks.withColumns({"chapter_id": cid, "chapter_title": F.coalesce(F.nullif(F.col("chapter_title"), F.lit("")), plain)})


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`island` numbers the runs of equal `value` from 0; a value that comes back opens a new run."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    opens = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(before)
    marked = rows.withColumn("_opens", opens.cast("int"))
    return marked.withColumn("island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def chapters(timeline: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each run of a chapter in a timeline (index, chapter_id, chapter_title, start_s, end_s, boundary_type)."""
    runs = islands(timeline.withColumn("chapter_id", F.coalesce(F.col("chapter_id"), F.lit(0))), keys, order, "chapter_id")
    member = F.struct("index", F.coalesce("boundary_type", F.lit("")).alias("boundary_type"), "chapter_title")
    out = runs.groupBy(*keys, "island").agg(F.min("chapter_id").alias("chapter_id"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_sort(F.collect_list(member)).alias("m"))
    title = F.when(F.col("chapter_id") == 0, "Front matter").otherwise(F.coalesce(F.col("m")[0]["chapter_title"], F.concat(F.lit("Chapter "), F.col("chapter_id").cast("string"))))
    return out.select(*keys, "island", "chapter_id", title.alias("title"), "start_s", "end_s", F.col("m.index").alias("chunk_indices"), F.col("m.boundary_type").alias("boundary_types"))


def timeline(chunks: DataFrame, durations: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """chunks joined with durations (keys, index, duration_s): start_s and end_s. A chunk without a duration raises an error."""
    joined = chunks.join(durations, [*keys, index], "left")
    checked = joined.withColumn("duration_s", F.coalesce("duration_s", F.raise_error(F.concat(F.lit("no duration for chunk "), F.col(index).cast("string"))).cast("double")))
    end = F.sum("duration_s").over(W.partitionBy(*keys).orderBy(index).rowsBetween(W.unboundedPreceding, 0))
    return checked.withColumn("end_s", end).withColumn("start_s", F.col("end_s") - F.col("duration_s"))


def pack_to_min(doc_sentences: DataFrame, keys: list[str], least: int) -> DataFrame:
    """doc_sentences (keys, sentences array): sentences joined until `least` words are there; the rest at the end is a pack too."""
    words = lambda s: X.word_count(s)
    zero = F.struct(F.array().cast("array<string>").alias("packs"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        now, n = F.ltrim(F.concat(acc["now"], F.lit(" "), s)), acc["n"] + words(s)
        full = n >= least
        return F.struct(F.when(full, F.concat(acc["packs"], F.array(now))).otherwise(acc["packs"]).alias("packs"), F.when(full, "").otherwise(now).alias("now"), F.when(full, 0).otherwise(n).alias("n"))

    end = lambda acc: F.when(acc["now"] != "", F.concat(acc["packs"], F.array(acc["now"]))).otherwise(acc["packs"])
    packed = doc_sentences.select(*keys, F.aggregate("sentences", zero, step, end).alias("packs"))
    return packed.select(*keys, F.posexplode("packs").alias("pack", "text")).withColumn("is_paragraph_end", F.col("pack") == F.max("pack").over(W.partitionBy(*keys)))


def combine_small(doc_chunks: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """doc_chunks (keys, chunks array<struct<text, end boolean>>): neighbours joined while they fit `most` words; one that has
    fewer than `least` takes the next in any case. The flag is that of the last part."""
    kind = "struct<text:string,end:boolean,n:int>"
    none = F.lit(None).cast(kind)
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("out"), none.alias("now"))
    sized = F.transform("chunks", lambda c: F.struct(c["text"].alias("text"), c["end"].alias("end"), X.word_count(c["text"]).alias("n")))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"]
        flush = now.isNotNull() & (now["n"] + c["n"] > most) & (now["n"] >= least)
        joined = F.struct(F.concat(now["text"], F.lit(" "), c["text"]).alias("text"), c["end"].alias("end"), (now["n"] + c["n"]).alias("n"))
        return F.struct(F.when(flush, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"), F.when(now.isNull() | flush, c).otherwise(joined).alias("now"))

    end = lambda acc: F.when(acc["now"].isNotNull(), F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
    out = doc_chunks.select(*keys, F.aggregate(sized, zero, step, end).alias("out"))
    return out.select(*keys, F.posexplode("out").alias("idx", "c")).select(*keys, "idx", F.col("c.text").alias("text"), F.col("c.end").alias("is_paragraph_end"), F.col("c.n").alias("n_words"))


def speech_gaps(intervals: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Gaps longer than `limit` between consecutive intervals (start, end)."""
    following = F.lead("start").over(W.partitionBy(*keys).orderBy("start", "end"))
    return intervals.withColumn("gap", following - F.col("end")).where(F.col("gap") > limit).select(*keys, F.col("end").alias("gap_start"), "gap")


def speech_quality(intervals: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """End of the last interval, and 0.6 of the speech share plus 0.4 of the mean length in seconds, each at most 1. `total` is the length."""
    size = F.col("end") - F.col("start")
    by = intervals.groupBy(*keys).agg(F.max_by("end", "start").alias("endpoint"), F.sum(size).alias("speech"), F.avg(size).alias("mean"), F.max("total").alias("total"))
    share = F.coalesce(F.least(F.col("speech") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0)), F.lit(0.0))
    return by.select(*keys, "endpoint", (share * 0.6 + F.least(F.col("mean") / rate, F.lit(1.0)) * 0.4).alias("quality"))


def progress(rows: DataFrame, keys: list[str], order: list[str], elapsed: str) -> DataFrame:
    """Ordinal, rows a second and seconds left, from the elapsed seconds of each row."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    total = F.count("*").over(W.partitionBy(*keys))
    seconds = F.nullif(F.col(elapsed), F.lit(0))
    return rows.withColumns({"ordinal": n, "rate": n / seconds, "eta": F.col(elapsed) / n * (total - n)})


def last_stage_fields(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`key: value` lines to one map for each key: `Fails` belongs to the last `ASR Stage n` line; last value wins."""
    parts = lines.where(F.col("line").contains(":")).withColumns({"k": F.trim(F.split("line", ":", 2)[0]), "v": F.trim(F.split("line", ":", 2)[1])})
    stage = F.when(F.col("k") == "ASR Stage 1", "stage1").when(F.col("k") == "ASR Stage 2", "stage2")
    active = F.last(stage, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    field = F.when((F.col("k") == "Fails") & active.isNotNull(), F.concat(active, F.lit("_fails"))).when(stage.isNotNull(), F.concat(F.lit("asr_"), stage)).otherwise(F.replace(F.lower("k"), F.lit(" "), F.lit("_")))
    return parts.withColumn("field", field).groupBy(*keys, "field").agg(F.max_by("v", order).alias("value"))


def changed_lines(lines: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return lines.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def progress_lines(lines: DataFrame, keys: list[str], order: str, every: int, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Log lines (line) with what is read from them and whether they are shown: sampling lines give tokens, total and rate and are hidden;
    chunk lines are shown first, last, each `every`-th, not while their rate is still computed, and not when equal to the chunk line
    shown before; lines with a hidden part are hidden. Empty lines go."""
    text = F.trim("line")
    rows = lines.where("line <> ''")
    bar = text.startswith("Sampling:")
    number = lambda p, k=1: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    chunk = ~bar & text.contains("\U0001f300 Chunk")
    at, of = number("\U0001f300 Chunk\\s+([0-9]+)/([0-9]+)").cast("long"), number("\U0001f300 Chunk\\s+([0-9]+)/([0-9]+)", 2).cast("long")
    waits = text.contains("Realtime: Calculating...")
    due = chunk & ~waits & (at.isNull() | (at == 1) | (at % every == 0) | (at == of))
    rows = rows.withColumns({"tokens": F.when(bar, number("([0-9]+)/([0-9]+)")).cast("long"), "total": F.when(bar, number("([0-9]+)/([0-9]+)", 2)).cast("long"), "rate": F.when(bar, number("([0-9]+\\.?[0-9]*)it/s")).cast("double")})
    rows = rows.withColumn("_said", F.when(due & at.isNotNull(), text))
    before = F.last("_said", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    other = F.lit(True)
    for part in hidden:
        other = other & ~text.contains(part)
    shown = F.when(bar, False).when(chunk, due & ~F.coalesce(F.col("_said") == F.col("_before"), F.lit(False))).otherwise(other)
    return rows.withColumn("_before", before).withColumn("shown", shown).drop("_said", "_before")
