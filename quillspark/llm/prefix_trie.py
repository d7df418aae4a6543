"""Operator 12: the trie of the prefixes of conversations, with what a store of shared prefixes would save.

Turns are brought to an identifier first (MD5 of role and text, or SHA-256 cut to 128 bits should two turns share one; a dictionary of
all distinct turns proves that none stands for two), so that texts move once. A numpy scan over each conversation then takes polynomial rolling
fingerprints of all its prefixes, modulo two primes; conversations of over CELL turns are scanned in cells, whose sums are added up
afterwards. Rows of equal depth and fingerprint are candidates for one node. A group is verified turn by turn against its
representative, the smallest conv_id: its last turn and the group of the prefix before it must be those of the representative, which
by induction over depths means equal prefixes. Rows that differ are split off and verified anew until all groups hold; that
costs no join as long as nothing collides. Only nodes of several conversations are rolled up: sums over subtrees are taken by
doubling the distance to the ancestor, log2(depth) rounds of a grouped sum and an equi-join over narrow rows. The numbers of the
conversations that end at a node are sorted by range over all tasks, joined to pieces there and hashed in order, so no task holds
the ids of a node at once.

Defined results: turns are ordered by number, null first, then by the identifier (of repeated rows each counts). A null role or
text is empty; texts of any length are read whole. Rows without a conv_id take no part. A conversation that is left without
turns belongs to the root only. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import checkpointed, dealt_join, ranked, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Turns scanned at a time, identifiers in a piece of a list.
CELL, PIECE = 4096, 4096
#: (prime under 2**31, base) of the two fingerprints.
MODULI = ((2147483647, 1103515245), (2147483629, 362436069))
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (lambda c: F.unhex(F.md5(c)), lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 16))
NODE = ["depth", "fp", "split"]


def clashes(keys: DataFrame, ident: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for several distinct turns (column key)."""
    each = keys.groupBy("key").agg(F.lit(1).alias("one"))
    return each.groupBy(ident(F.col("key")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def numbered(conversations: DataFrame, identifiers: tuple[Callable[[Column], Column], ...] = IDENTIFIERS) -> DataFrame:
    """One row per turn, without its text: conv_id, pos (from 0), ident, words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ident = next((f for f in identifiers if clashes(turns.select("key"), f).isEmpty()), None)
    if ident is None:
        raise ValueError("each of the identifiers stands for two turns")
    rows = stored(turns.select("conv_id", "turn", ident(F.col("key")).alias("ident"), "words"), "turns")
    cell = F.coalesce(F.floor(F.col("turn") / CELL), F.lit(-(2**62)))
    return stored(ranked(rows.withColumn("_cell", cell), ["conv_id"], ["turn", "ident"], "_cell", "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "ident", "words"), "numbered")


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of its family's first one: rows (conv_id, pos, ident, words, ends), and
    conversations (conv_id, length). own must be stored."""
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("donor", F.col("conv_id") - F.col("conv_id") % family)
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("pos", "ident", "words"))).alias("head"))
    none = F.array().cast("array<struct<pos:bigint,ident:binary,words:bigint>>")
    plan = convs.join(heads, "donor", "left").withColumn("h", taken).withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
    length = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    plan = stored(plan.select("conv_id", "n", "head", (F.size("head") - F.col("h")).alias("shift"), length.cast("long").alias("length")), "rebuilt")
    first = plan.select("conv_id", "length", F.inline("head")).select("conv_id", "pos", "ident", "words", "length")
    kept = own.where(F.col("pos") >= taken)
    rest = dealt_join(kept, plan.select("conv_id", "n", "shift", "length"), ["conv_id"], "n", own.count())
    rows = first.union(rest.select("conv_id", F.col("pos") + F.col("shift"), "ident", "words", "length"))
    return rows.select("conv_id", "pos", "ident", "words", (F.col("pos") == F.col("length") - 1).alias("ends")), plan.select("conv_id", "length")


def _scan(moduli: tuple[tuple[int, int], ...], cell: int):
    """Arrow batches of turns in order of (conv_id, cell, pos), a cell never in two tasks: fingerprints from the start of the cell."""
    tables = []
    for m, base in moduli:
        powers = np.ones(cell, np.uint64)
        for k in range(1, cell):
            powers[k] = int(powers[k - 1]) * base % m
        tables.append(powers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "pos"))
            digest = np.frombuffer(b"".join(batch.column("ident").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
            part = pos // cell
            new = np.r_[True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])]
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            goes_on = (start == 0) & (held == (conv[0], part[0]))
            cells, which = np.unique(part, return_inverse=True)
            after, before = [], []
            for k, (m, base) in enumerate(moduli):
                lift = np.array([pow(base, int(c) * cell, m) for c in cells], np.uint64)[which]
                term = (digest[:, k] % m + 1) % m * tables[k][pos % cell] % m * lift % m
                total = np.cumsum(term)
                own = total - term
                carried = np.where(goes_on, np.uint64(sums[k]), np.uint64(0))
                after.append((total - own[start] + carried) % m)
                before.append((own - own[start] + carried) % m)
            held, sums = (conv[-1], part[-1]), [int(x[-1]) for x in after]
            joined = [(x[0].astype(np.int64) << 31) | x[1].astype(np.int64) for x in (before, after)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(pos + 1), *map(pa.array, joined), *(pa.array(digest[:, k].view(np.int64)) for k in (0, 1)), batch.column("words"), batch.column("ends")],
                ["conv_id", "depth", "prev", "fp", "hi", "lo", "words", "ends"],
            )

    return run


def prefixes(rows: DataFrame, moduli: tuple[tuple[int, int], ...] = MODULI, cell: int = CELL) -> DataFrame:
    """One row per turn: conv_id, depth, fp (fingerprint of the prefix that ends here), prev (of the one before), hi, lo (identifier), words, ends."""
    dealt = rows.withColumn("cell", F.floor(F.col("pos") / cell)).repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "pos")
    out = stored(dealt.mapInArrow(_scan(moduli, cell), "conv_id long, depth long, prev long, fp long, hi long, lo long, words long, ends boolean"), "prefixes")
    far = out.where(F.col("depth") > cell)
    if far.isEmpty():
        return out
    low = 2**31 - 1
    parts = lambda c: (F.shiftright(c, 31), F.col(c).bitwiseAND(low))
    own = F.floor((F.col("depth") - 1) / cell)
    sums = out.groupBy("conv_id", own.alias("cell")).agg(F.max_by("fp", "depth").alias("fp"))
    before = W.partitionBy("conv_id").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "cell", *(F.sum(x).over(before).alias(f"add{k}") for k, x in enumerate(parts("fp")))).where("cell > 0")
    moved = far.withColumn("cell", own).join(sums, ["conv_id", "cell"])

    def shifted(c: str) -> Column:
        a, b = ((x + F.col(f"add{k}")) % m for (k, x), (m, _) in zip(enumerate(parts(c)), moduli, strict=True))
        return F.shiftleft(a, 31).bitwiseOR(b).alias(c)

    rest = [c for c in out.columns if c not in ("prev", "fp")]
    return out.where(F.col("depth") <= cell).unionByName(moved.select(*rest, shifted("prev"), shifted("fp")))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their split among prefixes of one fingerprint, and their groups, which hold equal prefixes only."""
    rows = rows.withColumns({"split": F.lit(0), "before": F.lit(0)})
    same = ["hi", "lo", "prev", "before"]
    while True:
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in same for f in (F.min, F.max)]
        groups = checkpointed(rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.count_if("ends").alias("n_ends"), *ends))
        odd = groups.where(" or ".join(f"min_{c} <> max_{c}" for c in same))
        if odd.isEmpty():
            return rows, groups.select(*NODE, "n_convs", "conv_id", "words", "n_ends", *(F.col(f"min_{c}").alias(c) for c in same))
        heads = rows.join(odd.select(*NODE, "conv_id"), [*NODE, "conv_id"]).select(*NODE, *(F.col(c).alias(f"head_{c}") for c in same))
        differs = F.coalesce(F.expr(" or ".join(f"{c} <> head_{c}" for c in same)), F.lit(False))
        moved = rows.join(heads, NODE, "left").select(*[c for c in rows.columns if c not in ("split", "before")], (F.col("split") + differs.cast("int")).alias("split"))
        moved = checkpointed(moved)
        last = moved.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("before"))
        rows = checkpointed(moved.join(last, ["conv_id", "depth"], "left").withColumn("before", F.coalesce("before", F.lit(0))))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes (depth, fp, split, prev, before, leaves, saved), closed under parents: leaves and saved summed over subtrees."""
    cur = checkpointed(nodes.select(*NODE, F.col("prev").alias("up"), F.col("before").alias("up_split"), "leaves", "saved"))
    deepest, step = cur.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        # cur: sums over descendants nearer than step; up: the ancestor at that distance
        gifts = cur.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("fp"), F.col("up_split").alias("split")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        own = cur.join(gifts, NODE, "left")
        summed = own.select(*NODE, "up", "up_split", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        # the root is everyone's last ancestor and is known without a join
        far = F.col("depth") > 2 * step
        higher = cur.select((F.col("depth") + step).alias("depth"), F.col("fp").alias("up"), F.col("split").alias("up_split"), F.col("up").alias("next"), F.col("up_split").alias("next_split")).where(far)
        jumped = summed.where(far).join(higher, ["depth", "up", "up_split"]).select(*NODE, F.col("next").alias("up"), F.col("next_split").alias("up_split"), "leaves", "saved")
        near = summed.where(~far).withColumns({"up": F.lit(0).cast("long"), "up_split": F.lit(0)})
        cur, step = checkpointed(jumped.unionByName(near)), 2 * step
    return cur.drop("up", "up_split")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (node, conv_id): the numbers of a node joined, PIECE at a time."""
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*NODE, "conv_id")]
        if not batch.num_rows:
            continue
        new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)])
        starts = np.unique(np.concatenate([np.arange(a, b, PIECE) for a, b in zip(new, [*new[1:], batch.num_rows], strict=True)]))
        texts = [",".join(map(str, cols[3][a:b].tolist())) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in cols), pa.array(texts)], [*NODE, "conv_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (node, conv_id), a node never in two tasks: the SHA-256 of a node's joined pieces."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([node[2]], pa.int32()), pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append(row())
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield from done
    if node is not None:
        yield row()


def ends_hashed(ends: DataFrame) -> DataFrame:
    """ends (depth, fp, split, conv_id): one row per node, with the hash of its numbers in ascending order."""
    sorted_ends = stored(ends.select(*NODE, "conv_id"), "ends").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = sorted_ends.mapInArrow(_pieces, "depth long, fp long, split int, conv_id long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_digests, "depth long, fp long, split int, ends_sha256 string")


def prefix_trie(conversations: DataFrame, moduli: tuple[tuple[int, int], ...] = MODULI, cell: int = CELL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    from ._common import python_ready

    python_ready(conversations.sparkSession)
    turns, convs = rebuilt(numbered(conversations))
    rows, groups = verified(prefixes(turns, moduli, cell))
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.count_if(F.col("length") == 0).alias("ends")).first()
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    root = convs.sparkSession.range(1 if top.n else 0).select(zero.alias("depth"), zero.alias("fp"), F.lit(0).alias("split"), F.lit(top.n).cast("long").alias("n_convs"), F.lit(top.first).cast("long").alias("conv_id"), zero.alias("words"), F.lit(top.ends).cast("long").alias("n_ends"), zero.alias("prev"), F.lit(0).alias("before"))
    shared = checkpointed(groups.where("n_convs > 1").select(*root.columns).union(root))
    up = [(F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("before").alias("split")]
    children = groups.groupBy(*up).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    count = lambda c: F.coalesce(c, F.lit(0))
    # the subtree of a node of one conversation is a chain: one leaf, nothing saved
    shared = shared.join(children, NODE, "left").withColumn("n_children", count("n_children"))
    shared = shared.withColumns({"leaves": count("alone") + (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    shared = checkpointed(shared)
    sums = rolled_up(shared)
    ending = rows.where("ends").select(*NODE, "conv_id").join(shared.where("n_ends > 0 and depth > 0").select(*NODE), NODE)
    ending = ending.union(convs.where("length = 0").select(zero, zero, F.lit(0), "conv_id"))
    parents = shared.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("before"), F.col("conv_id").alias("parent"))

    def with_parent(nodes: DataFrame) -> DataFrame:
        below = nodes.where("depth > 1").join(parents, ["depth", "prev", "before"], "left")
        at_top = nodes.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top.first).cast("long")))
        return below.unionByName(at_top)

    many = with_parent(shared).join(sums.select(*NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), NODE).join(ends_hashed(ending), NODE, "left")
    many = many.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    own = F.when(F.col("n_ends") == 0, F.lit(none)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256))
    one = with_parent(groups.where("n_convs = 1")).select("conv_id", "depth", F.coalesce("parent", "conv_id"), "n_convs", 1 - F.col("n_ends"), F.lit(1).cast("long"), zero, own)
    return many.union(one)


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH own AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(t ORDER BY pos) AS turns,
         (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
            lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1)))) % 4 AS h
  FROM own GROUP BY conv_id),
r AS (
  SELECT c.conv_id, coalesce(d.turns[1:c.h], []) || coalesce(c.turns[c.h + 1:], []) AS turns
  FROM c LEFT JOIN c AS d ON d.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, n, depth, turns[1:depth] AS path, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS up FROM p),
g AS (
  SELECT path, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM k GROUP BY path, depth),
n AS (SELECT g.*, coalesce(x.n, 0) AS n_children FROM g LEFT JOIN (SELECT up, count(*) AS n FROM g WHERE depth > 0 GROUP BY up) AS x ON g.path = x.up),
a AS (SELECT path[1:unnest(range(0, depth + 1))] AS top, (n_children = 0)::BIGINT AS leaf,
             CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n),
s AS (SELECT top, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON n.path = s.top LEFT JOIN g AS u ON n.up = u.path
"""
