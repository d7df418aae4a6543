"""Operator 1: n-gram Jaccard self-join with Bayesian pruning of candidates.

Documents are sets of five-word shingles. Equal sets form one class, so copies are never expanded. Classes that
share a band of their MinHash signature are candidates; the bands miss a pair at the threshold with probability
(1 - 0.8**6)**40 < 6e-6. Candidates are gathered as star edges (class, first class of the bucket), their connected
components are split into blocks, and each pair of blocks meets in one group of at most two blocks. There, pairs are
compared 16 MinHash values at a time and dropped when the posterior probability of reaching the threshold falls below
the tolerance; all others get their exact Jaccard similarity. Only one row a class leaves a group, so no step emits
pairs, and the rows grow in proportion to the input except for components of many blocks.

Defined results: a null or wordless text has no shingles, is in a class of its own and links to nothing. A text of one
to four words is one shingle of all its words. Texts of any length are read whole; one must fit in a task. Repeated rows are copies:
each has its own output row and counts. Rows with a null doc_id and rows of other texts with one doc_id take part like any other;
the class id is the smallest doc_id of the rows linked, null only if none of them has one. Similarity of exactly the threshold links;
there are no other ties. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import checkpointed, components, dealt_join, python_ready, stored

BANDS, ROWS, STEP, BLOCK = 40, 6, 16, 192


def fewest_matches(threshold: float, tolerance: float, step: int, n: int) -> list[tuple[int, int]]:
    """(values compared, matches needed): below this the posterior of J >= threshold, from a uniform prior, is under
    the tolerance. With m matches of n it is P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for k in range(step, n + 1, step):
        total, m = 0.0, 0
        while m <= k:
            total += math.exp(math.lgamma(k + 2) - math.lgamma(m + 1) - math.lgamma(k + 2 - m) + m * math.log(threshold) + (k + 1 - m) * math.log1p(-threshold))
            if total >= tolerance:
                break
            m += 1
        out.append((k, m))
    return out


def _sketch(hashes: _words.MinHash, with_bands: bool):
    salt = _words.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    step = _words.mix(np.arange(ROWS, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _words.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                h, rows, *_ = _words.words(part.column("text"))
                sets = [np.unique(s) for s in _words.shingles(h, rows)]
                keys = np.array([[(s * _words.mix(s + np.uint64(k))).sum(dtype=np.uint64) for k in (1, 2)] for s in sets], np.uint64).reshape(-1, 2)
                one = {"k1": pa.array(keys[:, 0].view(np.int64)), "k2": pa.array(keys[:, 1].view(np.int64))}
                if with_bands:
                    one |= {"doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64())}
                    bands = []
                    for s in sets:
                        if len(s):
                            sig = hashes.signature(s).reshape(BANDS, ROWS).astype(np.uint64)
                            bands.append(_words.mix((sig * step).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                        else:
                            bands.append(None)
                    one["bands"] = pa.array(bands, pa.list_(pa.int64()))
                else:
                    one |= {"grams": pa.array([s.tobytes() for s in sets], pa.binary()), "sig": pa.array([hashes.signature(s).tobytes() for s in sets], pa.binary())}
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in one.values()], list(one))

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys in batches that are sorted by them."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *change], [*change, batch.num_rows], strict=True):
            key = tuple(int(c[i]) for c in cols)
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            at = key
    if held:
        yield at, pa.Table.from_batches(held)


def _common(left: list[np.ndarray], right: list[np.ndarray], ask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) with ask[i, j]; products of 0/1 matrices over slices of the shingles that both sides have."""
    out = np.zeros(ask.shape, np.int64)
    if ask.sum() <= 64:
        for i, j in zip(*np.nonzero(ask), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    rows = []
    for side in (left, right):
        owner, flat = np.repeat(np.arange(len(side)), [len(s) for s in side]), np.concatenate(side)
        at = np.searchsorted(both, flat)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == flat[hit]
        rows.append((owner[hit], at[hit]))
    for k in range(0, len(both), 4096):
        dense = []
        for (owner, at), side in zip(rows, (left, right), strict=True):
            m = np.zeros((len(side), min(4096, len(both) - k)), np.float32)
            inside = (at >= k) & (at < k + 4096)
            m[owner[inside], at[inside] - k] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _verify(threshold: float, least: list[tuple[int, int]], n_hashes: int):
    def sides(t: pa.Table):
        return np.asarray(t["cid"]), np.asarray(t["size"]), [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()], np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b1, b2), t in groups(batches, ["comp", "b1", "b2"]):
            if b1 == b2:
                left = right = sides(t)
            else:
                own = np.asarray(t["block"])
                left, right = sides(t.filter(pa.array(own == b1))), sides(t.filter(pa.array(own == b2)))
            if not len(left[0]) or not len(right[0]):
                continue
            nl, nr = (np.array([len(s) for s in x[2]]) for x in (left, right))
            live = np.minimum.outer(nl, nr) >= threshold * np.maximum.outer(nl, nr)
            if b1 == b2:
                live &= np.arange(len(nl))[:, None] < np.arange(len(nr))
            i, j = np.nonzero(live)
            same, done = np.zeros(len(i), np.int64), 0
            for k, m in least:
                for a in range(0, len(i), 1 << 16):
                    same[a : a + (1 << 16)] += (left[3][i[a : a + (1 << 16)], done:k] == right[3][j[a : a + (1 << 16)], done:k]).sum(axis=1)
                stay, done = same >= m, k
                i, j, same = i[stay], j[stay], same[stay]
            ask = np.zeros(live.shape, bool)
            ask[i, j] = True
            if not len(i):
                continue
            inter = _common(left[2], right[2], ask)
            link = ask & (inter >= threshold * (nl[:, None] + nr - inter) - 1e-9)
            i, j = np.nonzero(link)
            if not len(i):
                continue
            ids, where = np.unique(np.concatenate([left[0][i], right[0][j]]), return_inverse=True)
            x, y = where[: len(i)], where[len(i) :]
            rows, texts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(rows, x, right[1][j])
            np.add.at(rows, y, left[1][i])
            np.add.at(texts, x, 1)
            np.add.at(texts, y, 1)
            root = np.arange(len(ids))
            while True:
                low = root.copy()
                np.minimum.at(low, x, root[y])
                np.minimum.at(low, y, root[x])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(texts), pa.array(ids[root])], ["cid", "rows", "texts", "root"])

    return run


def ngram_jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, class_id (smallest doc_id of its connected component
    of links), copy_id (smallest doc_id with the same shingle set), n_copies (rows of that set), n_links (other rows at
    the threshold or above, copies included), n_text_links (other shingle sets so linked)."""
    spark = docs.sparkSession
    python_ready(spark)
    hashes, least = _words.MinHash(BANDS * ROWS), fewest_matches(threshold, tolerance, STEP, BANDS * ROWS)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(src.mapInArrow(_sketch(hashes, True), "k1 long, k2 long, doc_id long, n long, bands array<long>"), "sketch")
    # Classes of equal shingle sets, numbered; a text without words is alone.
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rid"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    keyed = classes.select("cid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("cid").alias("low"), F.count("*").alias("c")).where("c > 1").select("key", "low")
    stars = keyed.join(shared, "key").where("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b"))
    comp = components(stars)
    sizes = comp.groupBy("comp").agg(F.count("*").alias("c"))
    nb = F.ceil(F.col("c") / BLOCK).cast("int")
    placed = comp.join(sizes, "comp").select(F.col("id").alias("cid"), "comp", nb.alias("nb"), F.pmod(F.xxhash64("id"), nb).cast("int").alias("block"))
    placed = checkpointed(placed.join(classes.select("cid", "k1", "k2", "rid", "size"), "cid"))
    # The texts of the classes that are placed: by the doc_id of one of their rows, or among all rows without one.
    wanted = placed.where("rid is not null").select(F.col("rid").alias("doc_id")).distinct()
    if placed.count() <= 2_000_000:  # at most 16 MB
        wanted = F.broadcast(wanted)
    texts = src.join(wanted, "doc_id", "left_semi").select("text")
    if not placed.where("rid is null").isEmpty():
        texts = texts.unionByName(src.where("doc_id is null").select("text"))
    grams = texts.mapInArrow(_sketch(hashes, False), "k1 long, k2 long, grams binary, sig binary")
    grams = grams.groupBy("k1", "k2").agg(F.first("grams").alias("grams"), F.first("sig").alias("sig"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least("block", k).alias("b1"), F.greatest("block", k).alias("b2")))).alias("p")
    met = placed.join(grams, ["k1", "k2"]).select("comp", "cid", "size", "block", "grams", "sig", pairs)
    met = met.select("comp", "p.b1", "p.b2", "cid", "size", "block", "grams", "sig")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(n, "comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "cid")
    found = checkpointed(met.mapInArrow(_verify(threshold, least, BANDS * ROWS), "cid long, rows long, texts long, root long"))
    links = found.groupBy("cid").agg(F.sum("rows").alias("rows"), F.sum("texts").alias("texts"))
    final = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    final = final.join(classes.select("cid", "rid"), "cid")
    final = final.select("cid", "comp").join(final.groupBy("comp").agg(F.min("rid").alias("class_id")), "comp").select("cid", "class_id")
    by_class = classes.drop("bands").join(links, "cid", "left").join(final, "cid", "left")
    by_class = checkpointed(by_class.select("k1", "k2", F.coalesce("class_id", "rid").alias("class_id"), F.col("rid").alias("copy_id"), F.col("size").alias("n_copies"), (F.coalesce("rows", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links")))
    linked = dealt_join(rows.where("n > 0").select("doc_id", "k1", "k2"), by_class, ["k1", "k2"], "n_copies", rows.count()).drop("k1", "k2")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Rows of docs that stay when one document of each class of `ngram_jaccard_join` stays: the smallest doc_id.

    Rows without a doc_id or without a word stay. All columns of docs are returned; of repeated rows with one doc_id
    one stays."""
    found = ngram_jaccard_join(docs, threshold, tolerance)
    gone = checkpointed(found.where("doc_id is not null and class_id <> doc_id").select("doc_id").distinct())
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if gone.count() <= 2_000_000:  # at most 16 MB
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        left = left.where(F.col("doc_id").isNull()).unionByName(left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
