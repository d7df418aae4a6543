"""Places and order statistics of groups that no task holds as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(rows: DataFrame, keys: list[str], most: int = 200_000) -> DataFrame:
    """rows by the hash of their keys in so many parts that one has about `most` rows, as windows and joins by these keys sort a part several
    times in one task; a set number of parts would grow with the input."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // most)), *keys)


def placed(rows: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """rows with their place in the group, from 0 and without gaps, in `order` (null first; rows that are equal in it stand in any order).

    Rows are dealt by ranges of (keys, order), so a large group lies in many tasks; a row's place is that in its task plus the rows of the
    group in the tasks before, which are counted by (group, task)."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = kept(dealt.withColumns({"_r_part": F.spark_partition_id(), "_r_at": F.monotonically_increasing_id()}))
    parts = dealt.groupBy(*keys, "_r_part").agg(F.min("_r_at").alias("_r_first"), F.count("*").alias("_r_n"))
    before = F.coalesce(F.sum("_r_n").over(W.partitionBy(*keys).orderBy("_r_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_r_part"]]
    joined = dealt.alias("l").join(parts.withColumn("_r_before", before).alias("r"), same)
    place = F.col("_r_at") - F.col("_r_first") + F.col("_r_before")
    return joined.select(*(f"l.{c}" for c in rows.columns), place.alias(out))


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """rows with the sum of a value over the rows before in the group, in `order` (0 for the first; nulls add nothing), dealt as in `placed`."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = kept(dealt.withColumns({"_r_part": F.spark_partition_id(), "_r_at": F.monotonically_increasing_id(), "_r_value": F.coalesce(value, F.lit(0))}))
    ahead = lambda w: F.coalesce(F.sum("_r_value").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy(*keys, "_r_part").agg(F.sum("_r_value").alias("_r_value")).withColumn("_r_before", ahead(W.partitionBy(*keys).orderBy("_r_part")))
    inside = dealt.withColumn("_r_inside", ahead(W.partitionBy(*keys, "_r_part").orderBy("_r_at")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_r_part"]]
    return inside.alias("l").join(parts.alias("r"), same).select(*(f"l.{c}" for c in rows.columns), (F.col("_r_inside") + F.col("_r_before")).alias(out))


def value_at(rows: DataFrame, keys: list[str], value: str, index: Column, out: str, buckets: int = 1024, few: int = 4096) -> DataFrame:
    """The value at an index (an expression of the group's number of rows, `n`) of each group's sorted values, from 0; nulls count for nothing.

    Exact: a round counts a group's values in `buckets` equal ranges and goes on with the range that holds the index, until it holds one value
    or `few` rows at most, which are then ranked. No round sorts a group, and counts are taken before rows are shuffled."""
    x = F.col(value).cast("double")
    plain = kept(rows.where(F.col(value).isNotNull() & ~F.isnan(x)).select(*keys, F.col(value).alias("_v"), x.alias("_x")))
    facts = [F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]
    state = plain.groupBy(*keys).agg(*facts).withColumn("n", F.col("_n")).withColumn("_index", index.cast("long")).drop("n")
    state = kept(state)
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    inside = (F.col("l._x") >= F.col("s._low")) & (F.col("l._x") <= F.col("s._high"))
    while not state.where((F.col("_low") < F.col("_high")) & (F.col("_n") > few)).isEmpty():
        met = plain.alias("l").join(state.alias("s"), on("l", "s")).where(inside)
        # halves, as the whole range may not be finite; the least and the greatest value never share a bucket, so that each round gets further
        span, above = F.col("s._high") / 2 - F.col("s._low") / 2, F.col("l._x") / 2 - F.col("s._low") / 2
        bucket = F.when(span > 0, F.least(F.floor(above / span * buckets), F.lit(buckets - 1))).otherwise((F.col("l._x") > F.col("s._low")).cast("int"))
        counts = met.withColumn("_b", bucket).groupBy(*(F.col(f"l.{k}").alias(k) for k in keys), "_b").agg(F.max("s._index").alias("_index"), F.count("*").alias("_n"), F.min("l._x").alias("_low"), F.max("l._x").alias("_high"))
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_index")) & (F.col("_upto") - F.col("_n") <= F.col("_index")))
        state = kept(hit.select(*keys, "_n", "_low", "_high", (F.col("_index") - F.col("_upto") + F.col("_n")).alias("_index")))
    met = plain.alias("l").join(state.alias("s"), on("l", "s")).where(inside)
    one = met.where("s._low = s._high").groupBy(*(F.col(f"l.{k}").alias(k) for k in keys)).agg(F.min("l._v").alias(out))
    rest = met.where("s._low < s._high").select(*(F.col(f"l.{k}").alias(k) for k in keys), "l._v", "s._index")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_v")) - 1
    return one.unionByName(rest.withColumn("_place", place).where("_place = _index").select(*keys, F.col("_v").alias(out)))
