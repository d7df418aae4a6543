"""Batches: optimal partitions by length, chapter cuts, ratios."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package
from .ranking import kept, placed

#: Items in a block of the scheduler, blocks (or groups of blocks) that are put together at a time.
BLOCK, FAN = 4096, 64
#: No path; sums of two stay in 64 bits.
NONE = 2**61


def accepts(size: Column, longest: Column, capacity: dict[int, int]) -> Column:
    """Whether a batch of `size` items, the longest of that length, is legal; one item always is."""
    out = F.when(size == 1, True)
    for n, most in capacity.items():
        if n > 1:
            out = out.when((size == n) & (longest <= most), True)
    return out.otherwise(False)


def partition_lengths(lengths: list[int], capacity: dict[int, int], most: int) -> list[int]:
    """Sizes of the cheapest run of neighbouring batches of sorted lengths, by the plain recurrence. A batch costs its longest length over its
    size, in whole multiples of the least common fraction; of equal costs fewer batches win, then the larger last batch."""
    unit = math.lcm(*range(1, most + 1))
    plan: list[tuple[int, int, int]] = [(0, 0, 0)]  # cost, batches, size of the last batch
    for end, longest in enumerate(lengths, 1):
        options = ((plan[end - n][0] + longest * unit // n, plan[end - n][1] + 1, -n) for n in range(1, min(most, end) + 1) if n == 1 or longest <= capacity.get(n, -1))
        cost, count, last = min(options)
        plan.append((cost, count, -last))
    sizes, at = [], len(lengths)
    while at:
        sizes.append(plan[at][2])
        at -= plan[at][2]
    return sizes[::-1]


class _Recurrence:
    """The recurrence over a block of sorted lengths. The plan before a block is a vector over the last `most` places (0 is the block's start):
    costs and numbers of batches; a block turns it into the vector at its end."""

    def __init__(self, capacity: dict[int, int], most: int):
        self.most, self.unit = most, math.lcm(*range(1, most + 1))
        self.limit = np.array([2**62, *(capacity.get(n, -1) for n in range(2, most + 1))])

    def run(self, lengths: np.ndarray, cost: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cost and count: (most, columns), several starts side by side. Plans at all places (the last `most` before the block first, oldest
        first) and, for each place in the block, the size of its last batch in the first column."""
        n, most = len(lengths), self.most
        costs, counts = np.full((most + n, cost.shape[1]), NONE), np.zeros((most + n, cost.shape[1]), np.int64)
        costs[:most], counts[:most] = cost[::-1], count[::-1]
        last = np.zeros(n, np.int64)
        sizes = np.arange(1, most + 1)
        for i, length in enumerate(lengths.tolist()):
            here = most + i
            option = costs[here - sizes] + (length * self.unit // sizes)[:, None]
            option[length > self.limit] = NONE
            option[costs[here - sizes] >= NONE] = NONE
            best = option.min(0)
            number = np.where(option == best, counts[here - sizes], NONE)
            fewest = number.min(0)
            costs[here], counts[here] = best, fewest + 1
            last[i] = sizes[(option[:, 0] == best[0]) & (number[:, 0] == fewest[0])][-1]
        return costs, counts, last

    def matrix(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs and counts from each place before the block to each place before its end."""
        unit = np.where(np.eye(self.most, dtype=bool), 0, NONE)
        costs, counts, _ = self.run(lengths, unit, np.zeros_like(unit))
        return costs[-self.most :][::-1].T, counts[-self.most :][::-1].T

    def last(self, lengths: np.ndarray, cost: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.run(lengths, cost[:, None], count[:, None])[2]


def _after(cost: np.ndarray, count: np.ndarray, mc: np.ndarray, mn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(min, +) product of plans (rows over places) with a block's matrix; of equal costs the fewer batches."""
    total = np.minimum(cost[:, :, None] + mc[None], NONE)
    best = total.min(1)
    number = np.where(total == best[:, None], count[:, :, None] + mn[None], NONE)
    return best, np.where(best < NONE, number.min(1), 0)


def walked(last: np.ndarray, entry: int) -> tuple[list[int], int]:
    """Ends of batches in a block (places from 1), walking back from `entry` places before its end; how far before its start the walk leaves it."""
    at, ends = len(last) - entry, []
    while at > 0:
        ends.append(at)
        at -= int(last[at - 1])
    return ends[::-1], -at


def _scan(level: DataFrame, key: str, columns: list[str], combine: Callable, schema: str) -> list[DataFrame]:
    """Levels of a tree over blocks: each puts FAN rows of the one below together, until every key has one."""
    levels = [level]
    while levels[-1].agg(F.max("block")).first()[0]:
        grouped = levels[-1].withColumn("up", F.floor(F.col("block") / FAN)).groupBy(key, "up")
        levels.append(kept(grouped.applyInPandas(combine, schema)))
    return levels


def schedule(items: DataFrame, key: str, capacity: dict[int, int], most: int, block: int = BLOCK) -> DataFrame:
    """items (key, item_id long, token_length int) with `batch`, for each key alone: the plan of `partition_lengths`, for keys of any size.

    Items are placed in order of (token_length, item_id) and cut into blocks. The recurrence looks `most` places back, so a block is a
    small (min, +) matrix; matrices are put together in a tree, FAN at a time, which gives the plan at each block's start. Blocks then choose
    their last batches, each a map from where the walk back enters a block to where it leaves; maps are put together in the same way from
    the end, and every block walks through its own places. No task holds more than FAN matrices or one block. A null length counts as 0; costs are whole
    numbers, and a table whose costs could pass 2**60 raises an error."""
    ship_package(items.sparkSession)
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(key, F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("token_length"), F.lit(0)).cast("int").alias("token_length"))
    facts = rows.agg(F.count("*").alias("n"), F.max("token_length").alias("m")).first()
    how = _Recurrence(capacity, most)
    if facts.n * (facts.m or 0) * how.unit >= 2**60:
        raise ValueError("costs do not fit in 64 bits")
    member = F.struct("place", "item_id", "token_length")
    placed_rows = placed(rows, [key], ["token_length", "item_id"]).withColumn("block", F.floor(F.col("place") / block))
    blocks = kept(placed_rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(member)).alias("m")).select(key, "block", F.col("m.item_id").alias("ids"), F.col("m.token_length").alias("lengths")))
    plan = f"{key} {kind}, block long, cost array<long>, number array<long>"

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [how.matrix(np.asarray(x, np.int64)) for x in pdf["lengths"]]
            yield pdf[[key, "block"]].assign(cost=[c.ravel().tolist() for c, _ in made], number=[n.ravel().tolist() for _, n in made])

    def product(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [(np.array(c, np.int64).reshape(most, most), np.array(n, np.int64).reshape(most, most)) for c, n in zip(pdf["cost"], pdf["number"], strict=True)]
        cost, number = parts[0]
        for c, n in parts[1:]:
            cost, number = _after(cost, number, c, n)
        return pd.DataFrame([(k[0], k[1], cost.ravel().tolist(), number.ravel().tolist())], columns=[key, "block", "cost", "number"])

    levels = _scan(kept(blocks.select(key, "block", "lengths").mapInPandas(matrices, plan)), key, ["cost", "number"], product, plan)
    first = [0, *[NONE] * (most - 1)]
    starts = levels[-1].select(key, "block", F.array(*(F.lit(x).cast("long") for x in first)).alias("start_cost"), F.array(*[F.lit(0).cast("long")] * most).alias("start_number"))

    def spread(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("block"), []
        cost, number = (np.array(pdf[c].iloc[0], np.int64)[None] for c in ("start_cost", "start_number"))
        for b, c, n in zip(pdf["block"], pdf["cost"], pdf["number"], strict=True):
            out.append((k[0], b, cost[0].tolist(), number[0].tolist()))
            cost, number = _after(cost, number, np.array(c, np.int64).reshape(most, most), np.array(n, np.int64).reshape(most, most))
        return pd.DataFrame(out, columns=[key, "block", "start_cost", "start_number"])

    same = lambda a, b: F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    begin = f"{key} {kind}, block long, start_cost array<long>, start_number array<long>"
    for level in levels[-2::-1]:
        below = level.withColumn("up", F.floor(F.col("block") / FAN)).alias("l").join(starts.alias("s"), same("l", "s") & (F.col("l.up") == F.col("s.block")))
        starts = kept(below.select("l.*", "start_cost", "start_number").groupBy(key, "up").applyInPandas(spread, begin))
    met = blocks.alias("l").join(starts.alias("s"), same("l", "s") & (F.col("l.block") == F.col("s.block"))).select("l.*", "start_cost", "start_number")

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last = [how.last(np.asarray(x, np.int64), np.array(c, np.int64), np.array(n, np.int64)) for x, c, n in zip(pdf["lengths"], pdf["start_cost"], pdf["start_number"], strict=True)]
            yield pdf[[key, "block", "ids", "lengths"]].assign(last=[x.tolist() for x in last], leaves=[[walked(x, e)[1] for e in range(most)] for x in last])

    done = kept(met.mapInPandas(decided, f"{key} {kind}, block long, ids array<long>, lengths array<int>, last array<long>, leaves array<long>"))
    way = f"{key} {kind}, block long, leaves array<long>"

    def followed(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.arange(most)
        for leaves in pdf.sort_values("block", ascending=False)["leaves"]:
            at = np.asarray(leaves)[at]
        return pd.DataFrame([(k[0], k[1], at.tolist())], columns=[key, "block", "leaves"])

    levels = _scan(done.select(key, "block", "leaves"), key, ["leaves"], followed, way)
    entries = levels[-1].select(key, "block", F.lit(0).cast("long").alias("entry"))

    def entered(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, at = pdf.sort_values("block", ascending=False), [], int(pdf["entry"].iloc[0])
        for b, leaves in zip(pdf["block"], pdf["leaves"], strict=True):
            out.append((k[0], b, at))
            at = int(leaves[at])
        return pd.DataFrame(out, columns=[key, "block", "entry"])

    for level in levels[-2::-1]:
        below = level.withColumn("up", F.floor(F.col("block") / FAN)).alias("l").join(entries.alias("s"), same("l", "s") & (F.col("l.up") == F.col("s.block")))
        entries = kept(below.select("l.*", "entry").groupBy(key, "up").applyInPandas(entered, f"{key} {kind}, block long, entry long"))
    met = done.alias("l").join(entries.alias("s"), same("l", "s") & (F.col("l.block") == F.col("s.block"))).select("l.*", "entry")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [walked(np.asarray(x), int(e))[0] for x, e in zip(pdf["last"], pdf["entry"], strict=True)]
            local = [np.searchsorted(e, np.arange(len(ids)), side="right").tolist() for e, ids in zip(ends, pdf["ids"], strict=True)]
            yield pdf[[key, "block", "ids", "lengths"]].assign(local=local, ends=[len(e) for e in ends])

    cut = kept(met.mapInPandas(numbered, f"{key} {kind}, block long, ids array<long>, lengths array<int>, local array<int>, ends long"))
    before = F.coalesce(F.sum("ends").over(W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    counts = cut.select(key, "block", before.alias("before"))
    out = cut.alias("l").join(counts.alias("s"), same("l", "s") & (F.col("l.block") == F.col("s.block"))).select(f"l.{key}", "before", F.inline(F.arrays_zip("ids", "lengths", "local")))
    return out.select(key, F.col("ids").alias("item_id"), F.col("lengths").alias("token_length"), (F.col("before") + F.col("local")).cast("int").alias("batch"))


def batchable(rows: DataFrame, keys: list[str], length: str, ratio: float = 1.8) -> DataFrame:
    """Whether the rows of each batch may run together: two or more, lengths within the ratio."""
    by = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(length).alias("most"), F.min(length).alias("least"))
    return by.withColumn("together", (F.col("n") >= 2) & (F.col("most") <= F.greatest("least", F.lit(1)) * ratio))


def cut_points(rows: DataFrame, keys: list[str], limit: float, ahead: int) -> DataFrame:
    """rows (keys, index, start_s, end_s, boundary_type) with pos (from 0), cut (where a part that starts here ends) and nxt (where the one after it
    starts, null at the end). The first row past the limit is found for all rows at once in one sorted pass over ends and starts."""
    w = W.partitionBy(*keys).orderBy("index")
    n = F.count("*").over(W.partitionBy(*keys))
    view = w.rowsBetween(0, ahead - 1)
    pos = F.row_number().over(w) - 1
    mark = F.coalesce("boundary_type", F.lit(""))
    rows = rows.withColumn("pos", pos).withColumn("n", n)
    paragraph = F.min(F.when(mark.isin("paragraph_end", "paragraph_break", "chapter_start"), F.col("pos"))).over(view)
    stop = F.max(F.when(mark.isin("period", "sentence_end"), F.col("pos"))).over(view)
    rows = rows.withColumn("here", F.when(F.col("pos") == F.col("n") - 1, F.col("pos")).otherwise(F.coalesce(paragraph, stop, F.col("pos"))))
    rows = kept(rows)
    ends = rows.select(*keys, (F.col("end_s") + 0.01).alias("v"), F.lit(0).alias("asks"), "pos", F.lit(None).cast("int").alias("first"))
    asks = rows.select(*keys, (F.col("start_s") + F.lit(limit)).alias("v"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("pos"), F.col("pos").alias("first"))
    # from late to early: the last end seen before a question is the first that reaches it
    falling = W.partitionBy(*keys).orderBy(F.desc("v"), "asks", F.desc("pos"))
    over = ends.unionByName(asks).withColumn("over", F.last("pos", ignorenulls=True).over(falling.rowsBetween(W.unboundedPreceding, 0))).where("asks = 1").select(*keys, F.col("first").alias("pos"), "over")
    found = rows.join(over, [*keys, "pos"]).withColumn("over", F.greatest(F.coalesce("over", F.col("n") - 1), "pos"))
    cuts = rows.select(*keys, F.col("pos").alias("over"), F.col("here").alias("cut"))
    out = found.join(cuts, [*keys, "over"])
    return kept(out.select(*keys, "index", "start_s", "end_s", "pos", "cut", F.when(F.col("cut") < F.col("n") - 1, F.col("cut") + 1).alias("nxt")))


def reached(points: DataFrame, keys: list[str]) -> DataFrame:
    """The starts (keys, pos) that are met from pos 0 on by following nxt: the set doubles each round, and so does the length of a jump."""
    jumps = points.select(*keys, "pos", "nxt").where("nxt is not null")
    seen = points.where("pos = 0").select(*keys, "pos")
    while True:
        new = seen.join(jumps, [*keys, "pos"]).select(*keys, F.col("nxt").alias("pos"))
        new = kept(new)
        if new.isEmpty():
            return seen
        seen = kept(seen.unionByName(new))
        again = jumps.select(*keys, F.col("pos").alias("nxt"), F.col("nxt").alias("then"))
        jumps = kept(jumps.join(again, [*keys, "nxt"]).select(*keys, "pos", F.col("then").alias("nxt")))


def subdivide(timeline: DataFrame, keys: list[str], minutes: float, ahead: int = 40) -> DataFrame:
    """timeline (keys, index, start_s, end_s, boundary_type) of chapters; chapters longer than `minutes` (and half a second) are
    cut at the first paragraph end within `ahead` rows after the limit, else at the last full stop there, else at the limit.
    Result: keys, part, start_index, end_index, start_s, end_s. minutes <= 0: one part. Ends must not fall from one row to the next. Where each row's part
    would end is looked up for all rows; which rows do start a part is found by doubling jumps, in rounds of equi-joins."""
    limit = minutes * 60
    rows = timeline.select(*keys, "index", "start_s", "end_s", "boundary_type")
    spans = rows.groupBy(*keys).agg((F.max("end_s") - F.min("start_s")).alias("_span"), F.min("index").cast("long").alias("start_index"), F.max("index").cast("long").alias("end_index"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    long = (F.lit(limit) > 0) & (F.col("_span") > limit + 0.5)
    whole = spans.where(~F.coalesce(long, F.lit(False))).select(*keys, F.lit(0).alias("part"), "start_index", "end_index", "start_s", "end_s")
    if limit <= 0:
        return whole
    points = cut_points(rows.join(spans.where(long).select(*keys), keys, "left_semi"), keys, limit, ahead)
    heads = points.join(reached(points, keys), [*keys, "pos"])
    tails = points.select(*keys, F.col("pos").alias("cut"), F.col("index").cast("long").alias("end_index"), F.col("end_s").alias("_end"))
    part = F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1
    cut = heads.withColumn("part", part).join(tails, [*keys, "cut"])
    return whole.unionByName(cut.select(*keys, "part", F.col("index").cast("long").alias("start_index"), "end_index", "start_s", F.col("_end").alias("end_s")))


def export_plan(timeline: DataFrame, keys: list[str], mode: str, minutes: float) -> DataFrame:
    """Parts of chapters by mode: headings_only; headings_or_minutes (cut only where no chapter has an id above 0); headings_with_max."""
    headed = F.max(F.coalesce("chapter_id", F.lit(0)) > 0).over(W.partitionBy(*keys))
    rows = timeline.withColumn("_headed", headed)
    by = [*keys, "island"]
    if mode == "headings_with_max":
        return subdivide(rows, by, minutes)
    if mode == "headings_or_minutes":
        return subdivide(rows.where("_headed"), by, 0).unionByName(subdivide(rows.where("not _headed"), by, minutes))
    return subdivide(rows, by, 0)


def swapped(queue: DataFrame, position: int, step: int) -> DataFrame:
    """A queue (ord) with the job at `position` and its neighbour exchanged; unchanged at the ends."""
    other = position + step
    both = queue.agg((F.count_if(F.col("ord").isin(position, other)) == 2).alias("_both"))
    move = F.when(F.col("_both") & (F.col("ord") == position), other).when(F.col("_both") & (F.col("ord") == other), position).otherwise(F.col("ord"))
    return queue.join(F.broadcast(both)).withColumn("ord", move.cast(queue.schema["ord"].dataType)).drop("_both")  # one row


def natural_order(name: Column) -> Column:
    """The number in a name, 0 without one."""
    return F.coalesce(F.regexp_extract(name, "chunk_([0-9]+)", 1).try_cast("long"), F.lit(0))
