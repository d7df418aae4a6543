"""Operator 4: sharding by balanced label propagation. DataFrame operations only.

Documents with equal texts are linked; a link between shards is cut. Linked documents start spread evenly. In each round
a document wants the open shard that holds most of its group (a histogram of the group by shard, joined back; ties go
to the order of a hash of group and shard) if that is more than where it is. Of the wishes from shard i to shard j as
many are granted as there are from j to i, and a share of the room that is left in j, so no shard outgrows its quota.
Rounds end when nothing moves: every move brings a document to at least as many of its group, so the sum of the squares of the
groups' counts by shard grows with each. Where wishes are left but none can be granted, ties are drawn anew, TRIES times at most, as two
groups may wait for each other's places. Documents without links fill the room that is left: that keeps row counts at most one
apart (law `rows`).

No group meets in one task: histograms are pre-aggregated, the join back to large groups is salted, and ranks come from
counts by cell (see `_common.ranked`). The driver sees one count for each shard and pair of shards.

Defined results: a null text has no bytes (size 1), no checksum and no links; empty texts are equal. Repeated rows are
separate rows with equal texts. A null doc_id is an ordinary value. Ties between rows go by a hash of doc_id and checksum. Texts of
any length are read once, for their size and hashes. An empty table gives an empty result. Other columns are ignored by `shard` and
kept by `shard_documents`, where those named like a result give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, free_name, ranked, stored

CELL_ROWS, TRIES = 50_000, 6


def _salts(group_size):
    """Pieces in which the rows of a group are dealt."""
    return F.greatest(F.lit(1), F.ceil(group_size / CELL_ROWS)).cast("int")


def quotas(wants: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """Moves granted from shard i to shard j: exchanges, and shares of the room left in j."""
    asked = [sum(n for (_, t), n in wants.items() if t == j) for j in range(len(free))]
    out = {}
    for (i, j), n in wants.items():
        out[i, j] = min(n, min(n, wants.get((j, i), 0)) + (free[j] * n // asked[j] if asked[j] else 0))
    for j, room in enumerate(free):  # what rounding down has left
        net = sum(out.get((i, j), 0) - min(wants.get((i, j), 0), wants.get((j, i), 0)) for i in range(len(free)))
        for i in range(len(free)):
            if (i, j) in wants and net < room and (more := min(room - net, wants[i, j] - out[i, j])) > 0:
                out[i, j] += more
                net += more
    return out


def shard(docs: DataFrame, n_shards: int = 8, rounds: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, size, text_crc32, law, shard, slot, grown_shard. rounds: at most
    so many; by default until nothing moves."""
    return _shard(docs, n_shards, rounds, [])


def _shard(docs: DataFrame, n_shards: int, rounds: int | None, carried: list[str]) -> DataFrame:
    sha = F.sha2("text", 256)
    # rows without a doc_id are told apart by their place
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("place")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"), sha.alias("grp"), place, *carried)
    rows = checkpointed(rows)
    total = rows.count()
    cap = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = max(16, total // CELL_ROWS)
    spread = 8
    linked_groups = rows.where("grp is not null").groupBy("grp").agg(F.count("*").alias("gsize")).where("gsize > 1")
    linked_groups = linked_groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    row_hash = F.xxhash64("doc_id", "text_crc32", "place")
    marked = checkpointed(rows.withColumn("salt", F.pmod(row_hash, F.lit(spread)).cast("int")).join(linked_groups, ["grp", "salt"], "left").drop("salt"))
    linked = marked.where("gsize is not null").withColumn("salt", F.pmod(row_hash, _salts(F.col("gsize"))).cast("int"))
    linked = linked.withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)) * 1_000_000 + F.col("salt")).withColumn("one", F.lit(1))
    linked = ranked(linked, ["one"], ["grp", "doc_id", "place"], "cell", "r").withColumn("shard", F.pmod("r", F.lit(n_shards)).cast("int")).drop("r", "one")
    linked = checkpointed(linked)

    def loads() -> list[int]:
        found = {r.shard: r.n for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        return [found.get(s, 0) for s in range(n_shards)]

    load = loads()
    done = stuck = 0
    while sum(load) and (rounds is None or done < rounds):
        done += 1
        free = [c - n for c, n in zip(cap, load, strict=True)]
        open_shards = [s for s, n in enumerate(free) if n > 0] or list(range(n_shards))
        held = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"), F.first("gsize").alias("gsize"))
        held = held.groupBy("grp").agg(F.collect_list(F.struct("n", F.xxhash64("grp", "shard", F.lit(stuck)).alias("tie"), "shard")).alias("held"), F.first("gsize").alias("gsize"))
        held = held.select("grp", "held", F.array_max(F.filter("held", lambda x: x["shard"].isin(open_shards))).alias("best"), F.explode(F.sequence(F.lit(0), _salts(F.col("gsize")) - 1)).alias("salt"))
        here = F.filter("held", lambda x: x["shard"] == F.col("shard"))[0]
        asks = linked.join(held, ["grp", "salt"]).withColumn("target", F.when(F.col("best") > here, F.col("best.shard")).otherwise(F.col("shard"))).drop("held", "best")
        asks = checkpointed(asks)
        wants = {(r.shard, r.target): r.n for r in asks.where("shard <> target").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        granted = quotas(wants, free)
        if not any(granted.values()):
            stuck += 1
            if not wants or stuck > TRIES:
                break
            continue
        stuck = 0
        limit = F.coalesce(*[F.when((F.col("shard") == i) & (F.col("target") == j), F.lit(n)) for (i, j), n in granted.items()], F.lit(0))
        moving = ranked(asks.where("shard <> target"), ["shard", "target"], ["grp", "doc_id", "place"], "cell", "r")
        moving = moving.withColumn("shard", F.when(F.col("r") < limit, F.col("target")).otherwise(F.col("shard"))).drop("r")
        linked = checkpointed(asks.where("shard = target").unionByName(moving).drop("target"))
        load = loads()
    ends, room = [], 0
    for c, n in zip(cap, load, strict=True):
        room += c - n
        ends.append(room)
    alone = marked.where("gsize is null").withColumn("cell", F.pmod(row_hash, F.lit(cells))).withColumn("one", F.lit(1))
    alone = ranked(alone, ["one"], ["doc_id", "grp", "place"], "cell", "r")
    alone = alone.withColumn("shard", F.coalesce(*[F.when(F.col("r") < end, F.lit(s)) for s, end in enumerate(ends)]))
    keep = ["doc_id", "size", "text_crc32", "place", "shard", *carried]
    placed = checkpointed(linked.select(*keep).unionByName(alone.select(*keep)).withColumn("cell", F.pmod(row_hash, F.lit(cells))))
    out = ranked(placed, ["shard"], ["doc_id", "text_crc32", "place"], "cell", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carried)


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; columns of docs with such names give way.

    Rows are numbered in a stored copy, so that each finds its own place again, whatever ids and texts repeat."""
    number = free_name(docs, "_number")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    plan = _shard(numbered, n_shards, rounds, [number]).drop("doc_id")
    left = numbered.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in plan.columns if n != number}])
    return left.join(plan, number).drop(number)


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
