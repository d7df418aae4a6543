"""Helpers that several operators share: table paths, shared storage, ranks and components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Ship this package to the executors. Batches that carry texts to Python are bounded by spark.sql.execution.arrow.maxBytesPerBatch
    and cut into slices there; no setting of the session is changed."""
    ship_package(spark)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not use (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, comp), comp the smallest id.

    Alternating large-star and small-star steps until nothing changes; every step is a grouped minimum and an equi-join on narrow
    rows, and a checkpoint ends each round. Only the row count and a checksum of a round come to the driver.
    """
    cur = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, now = None, ()
    while now != last:
        last = now
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node hands its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e"))
        cur = checkpointed(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct())
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return cur.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(cur.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


CELL_ROWS = 50_000


def dealt_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row for each of `keys`, `size` of its rows among `total`): large groups meet in pieces.

    Groups of over CELL_ROWS rows (more if `total` is over a million times that) are listed with their number of pieces, which is
    at most a million short rows and is broadcast; their rows are dealt to the pieces, to each of which the group's row is copied.
    groups should be stored or checkpointed, as it is read twice.
    """
    cell = max(CELL_ROWS, total // 1_000_000)
    large = groups.where(F.col(size) > cell).select(*keys, F.ceil(F.col(size) / cell).cast("int").alias("_pieces"))
    copies = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > cell, F.ceil(F.col(size) / cell).cast("int") - 1).otherwise(0))))
    number = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    dealt = rows.withColumn("_n", number).join(F.broadcast(large), keys, "left")
    dealt = dealt.withColumn("_piece", F.pmod("_n", F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_n", "_pieces")
    return dealt.join(copies, [*keys, "_piece"], "left").drop("_piece")


def ranked(df: DataFrame, group: list[str], order: list[str], cell: str, out: str) -> DataFrame:
    """Rank rows from 0 without gaps in each group, in order of (cell, *order), with no task that holds a whole group.

    `cell` names a bigint column that cuts each group into pieces. Rows are counted by (group, cell), the counts
    are summed up over that small table, and a window ranks only inside (group, cell).
    """
    from pyspark.sql import Window as W

    sizes = df.groupBy(*group, cell).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*group, cell, F.coalesce(before, F.lit(0)).alias("_start"))
    inside = df.withColumn("_rn", F.row_number().over(W.partitionBy(*group, cell).orderBy(*order)) - 1)
    return inside.join(starts, [*group, cell]).withColumn(out, F.col("_rn") + F.col("_start")).drop("_rn", "_start")
