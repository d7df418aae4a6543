"""Operator 13: exact k highest inner products by distributed histogram selection.

Vectors become integers, and lie in a table of blocks of at most BLOCK rows. Every pass scores all blocks of candidates against all
blocks of queries in numpy; scores are never kept. A pass counts, for each query, the scores in BINS bins of equal width; the counts are
summed over all tasks, and the bin that holds the kth score is cut into BINS bins in the next pass, until it is one value wide: two passes
for vectors of usual length, seven at most. A block sends no bins under its own kth score, as the kth of all cannot lie there.
A last pass filters: all scores above the kth value (fewer than k), and of each block the first k by vec_id among those equal to it; these
few rows are ranked. Blocks of queries are sent to all tasks if they have at most LOCAL_BYTES; else pieces of both sides meet by an
equi-join on (part of the queries, group of blocks of candidates), each in one task.

Defined results: a query is a row whose vec_id is divisible by `every`; repeated rows with such an id are queries of their own, with
equal results each, and candidates for each other, since a query leaves out only its own row. Ties go to the smaller vec_id,
a candidate without vec_id after all others. Vectors that are null or hold null or non-finite components take no part; of vectors
of unequal length the shorter one counts as padded with zeros. Components of 2**22 or more raise an error, as scores would not fit in 64 bits.
Fewer than k candidates: all are returned. An empty table, or one without queries, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import checkpointed, python_ready, stored
from ._vectors import integers, packed, pieces, unpacked, whole, width

BLOCK, BINS, LOCAL_BYTES = 4096, 1024, 64 << 20
#: Scores held at a time: rows of queries times a block of candidates.
AT_ONCE = 256


def blocks(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """vectors (vec_id, embedding) packed: ids (int64), missing (bytes of 0 or 1), data, norm (largest sum of squares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows):
            if batch.num_rows:
                ids, a = batch.column("vec_id"), integers(batch.column("embedding"), dim)
                x = (ids.fill_null(0).to_numpy().tobytes(), np.asarray(ids.is_null()).astype(np.int8).tobytes(), packed(a), float((a.astype(np.float64) ** 2).sum(1).max()))
                yield pa.RecordBatch.from_pylist([dict(zip(("ids", "missing", "data", "norm"), x, strict=True))])

    made = whole(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "ids binary, missing binary, data binary, norm double")
    return stored(stored(made, "blocks").withColumn("block", F.monotonically_increasing_id()), "numbered-blocks")


def _by_part(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of one part in a batch, at most `rows` rows of each at a time."""
    part = batch.column("part").to_numpy()
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield from pieces(iter([batch.slice(a, b - a)]), rows)


def query_blocks(candidates: DataFrame, dim: int, every: int, rows: int) -> tuple[DataFrame, int, int]:
    """The queries among the candidates, dealt to parts of about `rows`: blocks (q, part, ids, data, uids: block and place of each), numbers of queries and parts."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids, missing, data in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "missing", "data")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero((ids % every == 0) & (np.frombuffer(missing, np.int8) == 0))
                if len(at):
                    a = unpacked(data, dim)[at]
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(at), b)), "place": pa.array(at.astype(np.int64)), "id": pa.array(ids[at]), "vector": pa.array([x.tobytes() for x in a], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole_batch in batches for b in _by_part(whole_batch, rows)):
            if batch.num_rows:
                a = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int64).reshape(batch.num_rows, dim)
                uids = np.stack([batch.column("block").to_numpy(), batch.column("place").to_numpy()], 1)
                yield pa.RecordBatch.from_pylist([{"ids": batch.column("id").to_numpy().tobytes(), "uids": uids.tobytes(), "data": packed(a), "part": int(batch.column("part")[0].as_py())}])

    found = stored(candidates.select("block", "ids", "missing", "data").mapInArrow(pick, "block long, place long, id long, vector binary"), "queries")
    n = found.count()
    parts = max(1, -(-n // rows))
    part = F.pmod(F.xxhash64("block", "place"), F.lit(parts)).cast("long")
    dealt = found.withColumn("part", part).repartition("part").sortWithinPartitions("part", "block", "place")
    made = stored(dealt.mapInArrow(pack, "ids binary, uids binary, data binary, part long"), "query-blocks")
    return stored(made.withColumn("q", F.monotonically_increasing_id()), "numbered-queries"), n, parts


def _scores(query: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Integer inner products: by floats where all partial sums are exact there."""
    bound = float(np.abs(query).max(initial=0)) * float(np.abs(cand).max(initial=0)) * max(1, query.shape[1])
    if bound < 2**53:
        return (query.astype(np.float64) @ cand.astype(np.float64).T).astype(np.int64)
    if bound >= 2**63:
        raise ValueError("scores do not fit in 64 bits")
    return query @ cand.T


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """For slices of queries in each pair of blocks: q, first place, states, (own, scores), ids and missing marks of the candidates."""
    for batch in batches:
        for row in batch.to_pylist():
            cand, ids, missing = unpacked(row["data"], dim), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["missing"], np.int8)
            query, uids = unpacked(row["q_data"], dim), np.frombuffer(row["uids"], np.int64).reshape(-1, 2)
            state = np.array([[s["low"], s["wide"], s["top"]] for s in sorted(row["states"], key=lambda s: s["place"])], np.int64).reshape(-1, 3)
            for k in range(0, len(query), AT_ONCE):
                scores, u = _scores(query[k : k + AT_ONCE], cand), uids[k : k + AT_ONCE]
                there = np.ones(scores.shape, bool)
                own = np.flatnonzero(u[:, 0] == row["block"])
                there[own, u[own, 1]] = False
                yield row["q"], k, state[k : k + AT_ONCE], scores, there, ids, missing


def _histogram(dim: int, k: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, first, state, scores, there, _, _ in _tiles(batches, dim):
            low, wide, top = state[:, :1], state[:, 1:2], state[:, 2:]
            if not wide.any():
                continue
            wide = np.maximum(wide, 1)
            ranked = np.where(there, scores, np.iinfo(np.int64).min)
            kth = np.partition(ranked, -k, axis=1)[:, -k][:, None] if ranked.shape[1] > k else low
            bin_of = (scores - low) // wide
            at, col = np.nonzero(there & (scores >= np.maximum(low, kth)) & (scores < top) & (state[:, 1:2] > 0))
            if len(at):
                keys, n = np.unique(np.stack([at, bin_of[at, col]], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(n), q)), "place": pa.array((keys[:, 0] + first).astype(np.int32)), "bin": pa.array(keys[:, 1].astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return run


def _filter(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, first, state, scores, there, ids, missing in _tiles(batches, dim):
            low = state[:, :1]
            order = np.lexsort((ids, missing))  # by id, those without one last
            above = there & (scores > low)
            level = (there & (scores == low))[:, order]
            level &= np.cumsum(level, axis=1) <= k
            chosen = above[:, order] | level
            at, col = np.nonzero(chosen)
            col = order[col]
            if len(at):
                vec = pa.array(ids[col], mask=missing[col].astype(bool))
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(at), q)), "place": pa.array((at + first).astype(np.int32)), "vec_id": vec, "score": pa.array(scores[at, col])})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, bins: int = BINS, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """vectors (vec_id long, embedding array): query_id, rank (from 1), vec_id, score."""
    python_ready(vectors.sparkSession)
    dim, _ = width(whole(vectors))
    candidates = blocks(vectors, dim, block)
    queries, n, parts = query_blocks(candidates, dim, every, block)
    facts = candidates.agg(F.max("norm").alias("norm"), F.count("*").alias("blocks")).first()

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By Cauchy-Schwarz no score of a query lies outside of these."""
        for batch in batches:
            for q, ids, data in zip(*(batch.column(c).to_pylist() for c in ("q", "ids", "data")), strict=True):
                most = np.ceil(np.sqrt((unpacked(data, dim).astype(np.float64) ** 2).sum(1)) * np.sqrt(facts.norm or 0.0) * (1 + 1e-9)).astype(np.int64) + 2
                wide = (2 * most) // bins + 1
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(most), q)), "place": pa.array(np.arange(len(most), dtype=np.int32)), "query_id": pa.array(np.frombuffer(ids, np.int64)), "low": pa.array(-most), "wide": pa.array(wide), "top": pa.array(most + 1), "over": pa.array(np.zeros(len(most), np.int64))})

    state = stored(queries.select("q", "ids", "data").mapInArrow(limits, "q long, place int, query_id long, low long, wide long, top long, over long"), "states")
    small = n * dim * 8 <= local_bytes
    groups = 1 if small else max(1, min(facts.blocks, 16))

    def met(state: DataFrame) -> DataFrame:
        """Each block of candidates beside each block of queries, with the states of its queries."""
        states = state.groupBy("q").agg(F.collect_list(F.struct("place", "low", "wide", "top")).alias("states"))
        side = queries.select("q", "part", F.col("data").alias("q_data"), "uids").join(states, "q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        left = candidates.drop("norm").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return left.join(F.broadcast(side) if small else side, ["part", "g"]).drop("part", "g")

    while state.where("wide > 0").limit(1).count():
        counts = met(state).mapInArrow(_histogram(dim, k, bins), "q long, place int, bin int, n long").groupBy("q", "place", "bin").agg(F.sum("n").alias("n"))
        top = F.sum("n").over(W.partitionBy("q", "place").orderBy(F.desc("bin")))
        counts = counts.withColumn("upto", top)
        cur = counts.join(state.select("q", "place", "over"), ["q", "place"])
        hit = cur.where((F.col("over") + F.col("upto") >= k) & (F.col("over") + F.col("upto") - F.col("n") < k))
        hit = hit.select("q", "place", "bin", (F.col("over") + F.col("upto") - F.col("n")).alias("more"))
        nxt = state.join(hit, ["q", "place"], "left")
        # a query with fewer than k candidates keeps its lower limit: all of them lie above it
        none = F.col("bin").isNull()
        done = none | (F.col("wide") == 1)
        low = F.when(none, F.col("low")).otherwise(F.col("low") + F.col("bin") * F.col("wide"))
        wide = F.when(done, F.lit(0)).otherwise(F.floor((F.col("wide") - 1) / bins) + 1)
        over = F.when(none, F.col("over")).otherwise(F.col("more"))
        state = stored(nxt.select("q", "place", "query_id", low.alias("low"), wide.cast("long").alias("wide"), (low + F.col("wide")).alias("top"), over.alias("over")), "states")
    found = met(state).mapInArrow(_filter(dim, k), "q long, place int, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("q", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(state.select("q", "place", "query_id"), ["q", "place"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS r, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
