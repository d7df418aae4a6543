"""Grouped statistics and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import kept, value_at


def bucket_distribution(rows: DataFrame) -> DataFrame:
    """rows (bucket, n): n_chunks, percent of all, min_len, max_len, avg_len of each bucket."""
    by = rows.groupBy("bucket").agg(F.count("*").alias("n_chunks"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.avg("n").alias("avg_len"))
    total = F.sum("n_chunks").over(W.partitionBy(F.lit(1)))  # over three rows
    return by.select("bucket", "n_chunks", (F.lit(100.0) * F.col("n_chunks") / total).alias("percent"), "min_len", "max_len", "avg_len")


def optimization_potential(distribution: DataFrame) -> DataFrame:
    """The largest bucket (of equals the first of short, medium, long) and what grouping by it would bring."""
    order = F.when(F.col("bucket") == "short", 0).when(F.col("bucket") == "medium", 1).otherwise(2)
    best = distribution.agg(F.max(F.struct(F.col("percent"), (-order).alias("o"), F.col("bucket"))).alias("b"))
    grade = F.when(F.col("b.percent") >= 70, "high").when(F.col("b.percent") >= 50, "medium").otherwise("low")
    return best.select(F.col("b.bucket").alias("bucket"), F.col("b.percent").alias("percent"), grade.alias("potential"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, as one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(*keys, "_r.*")


def composite_score(local: Column, asr_score: Column, asr_error: Column) -> Column:
    """Mean of the scores there are; 1.0 without any. An answer with an error has none."""
    heard = F.when(F.coalesce(asr_error, F.lit("")) == "", asr_score)
    n = local.isNotNull().cast("int") + heard.isNotNull().cast("int")
    return F.coalesce((F.coalesce(local, F.lit(0.0)) + F.coalesce(heard, F.lit(0.0))) / F.nullif(n, F.lit(0)), F.lit(1.0))


def best_attempt(attempts: DataFrame, threshold: float) -> DataFrame:
    """attempts (chunk_id, attempt, score; attempt 0 is the original): the best, the earliest of equals; a null score counts 0."""
    best = F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), (-F.col("attempt")).alias("o"))).alias("b")
    out = attempts.groupBy("chunk_id").agg(best, F.count("*").alias("n_attempts"))
    return out.select("chunk_id", (-F.col("b.o")).alias("attempt"), F.col("b.score").alias("score"), (F.col("b.score") < threshold).alias("still_failed"), "n_attempts")


def micro_batches(chunks: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Batch number inside each parameter group, rows sorted by length, then index."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("length", "index"))
    return chunks.withColumn("batch", F.floor((rank - 1) / size).cast("long"))


def error_summary(rows: DataFrame) -> DataFrame:
    """The smallest error and how many others there are."""
    n = F.countDistinct("error")
    more = F.when(n > 1, F.concat(F.lit(" (+"), (n - 1).cast("string"), F.lit(" distinct)"))).otherwise("")
    return rows.where("error is not null").agg(F.concat(F.min("error"), more).alias("summary"), F.count("*").alias("n"))


def _terms(docs: DataFrame) -> DataFrame:
    """Words of documents: doc_id, pos, token, prev (the word or end mark before), term."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}|[.!?]"), F.lit(0))
    listed = docs.select("doc_id", tokens.alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(i.alias("pos"), x.alias("token"), F.get("t", i - 1).alias("prev")))
    words = F.filter(pairs, lambda p: ~p["token"].isin(".", "!", "?"))
    return listed.select("doc_id", F.inline(words)).withColumn("term", F.lower("token"))


def term_evidence(docs: DataFrame, least: int) -> DataFrame:
    """Terms that the corpus treats as names: how often, in mid-sentence capitals, as acronyms, in lower case; first surface (in the first document
    by id; rows without an id count, but give no surface).

    Counters are numbers only, so that they are added up by hash before anything is shuffled; the surface is then taken from the documents in
    which a kept term is first, by a second pass over these alone."""
    rows = _terms(docs)
    start = F.col("prev").isNull() | F.col("prev").isin(".", "!", "?")
    capital, acronym = F.col("token").rlike("^[A-Z][a-z]"), F.col("token").rlike("^[A-Z]{2,}$")
    by = rows.groupBy("term").agg(
        F.count("*").alias("occurrences"),
        F.count_if(capital & ~start).alias("mid_capitals"),
        F.count_if(acronym).alias("acronyms"),
        F.count_if(F.col("token") == F.col("term")).alias("lower_case"),
        F.min("doc_id").alias("doc_id"),
    )
    by = kept(by.where((F.col("occurrences") >= least) & ((F.col("mid_capitals") >= 1) | (F.col("acronyms") >= least))))
    firsts = by.select("doc_id", "term")
    seen = _terms(docs.join(firsts.select("doc_id").distinct(), "doc_id", "left_semi")).join(firsts, ["doc_id", "term"], "left_semi")
    surfaces = seen.groupBy("term").agg(F.min_by("token", F.struct("pos", "token")).alias("surface"))
    return by.drop("doc_id").join(surfaces, "term", "left")


def nearest_rank_95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at index int(0.95 (n - 1)) of each group's sorted values, nulls left out."""
    return value_at(rows, keys, value, F.floor(F.lit(0.95) * (F.col("n") - 1)), "p95")
