"""Operator 11: vector codes by product quantisation, its codebooks fitted by Yinyang Lloyd.

Vectors become integers, lie in blocks of at most BLOCK rows and are cut into parts. The entries of each part's codebook are clustered into
groups of about ten. The first assignment measures all entries and keeps, for each part of each vector, its entry and one lower bound per group: the
distance to the group's nearest other entry. After an update a bound falls by the largest drift in its group; only groups whose bound does not
exceed the distance to the vector's own entry are scanned, with integer distances, where ties go to the lower index. Bounds are
rounded down and distances up, and a group is skipped only if it lies strictly beyond, so that no tie is lost. Each block writes its sums beside its
state; these are added up over all blocks, and only the codebooks (entries x length of the vectors) come to the driver.
The errors of equal labels are summed and joined back: by broadcast up to MOST_LABELS labels, else labels with many rows meet in pieces.

Defined results: vectors that are null or hold null or non-finite components are dropped. Shorter vectors are padded with zeros, to a
length that `parts` divides. Components of 2**22 or more raise an error. Rows are ordered by vec_id, null last, then by vector, to
start the codebooks; with fewer rows than `entries` there are as many entries as rows. Repeated rows each count. Labels are compared by
their text form, nulls together. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, dealt_join, python_ready, stored
from ._vectors import integers, packed, pieces, unpacked, whole, width

BLOCK, MOST_LABELS = 4096, 100_000
#: Relative slack of distances in floating point.
SLACK = 1e-12


def grouped_entries(books: np.ndarray, size: int = 10, rounds: int = 5) -> np.ndarray:
    """Group of each entry (part, entry): a few rounds of Lloyd over the entries of a part, from far-apart seeds."""
    parts, entries, _ = books.shape
    out = np.zeros((parts, entries), np.int64)
    for p in range(parts if entries else 0):
        x = books[p].astype(np.float64)
        seeds, near = [0], ((x - x[0]) ** 2).sum(1)
        while len(seeds) < -(-entries // size):
            seeds.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
        centre = x[seeds]
        for _ in range(rounds):
            out[p] = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            centre = np.array([x[out[p] == g].mean(0) if (out[p] == g).any() else centre[g] for g in range(len(centre))])
    return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers: rows of x by rows of c."""
    if (float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))) ** 2 * max(1, x.shape[1]) < 2**52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None]).astype(np.int64)
    return ((x[:, None] - c[None]) ** 2).sum(2)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(squares.astype(np.float64)) * (1 - SLACK)).astype(np.float32), np.float32(0))


def _two_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value of each row, its first place, and the least of the others (infinite if there is none)."""
    first = d.argmin(1)
    least = d[np.arange(len(d)), first]
    rest = d.astype(np.float64)
    rest[np.arange(len(d)), first] = np.inf
    return least, first, rest.min(1)


def assign_all(x: np.ndarray, book: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One part: nearest entry, its squared distance, and lower bounds by group."""
    d = _distances(x, book)
    best = d.argmin(1)
    bounds = np.full((len(x), groups), np.inf, np.float32)
    for g in range(groups):
        members = np.flatnonzero(group == g)
        if len(members):
            least, first, second = _two_least(d[:, members])
            bounds[:, g] = _down(np.where(members[first] == best, second, least))
    return best, d[np.arange(len(x)), best], bounds


def assign_near(x: np.ndarray, book: np.ndarray, group: np.ndarray, own: np.ndarray, bounds: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part after an update: as assign_all, but only groups whose bound, less the drift, does not exceed the own distance are scanned;
    the last value is the number of distances to other entries that were measured."""
    was = ((x - book[own]) ** 2).sum(1)
    low = np.nextafter((bounds.astype(np.float64) - drift[None]).astype(np.float32), np.float32(-np.inf))
    scan = low <= (np.sqrt(was.astype(np.float64)) * (1 + SLACK))[:, None]
    best, dist, measured, found = own.copy(), was.copy(), 0, []
    for g in range(bounds.shape[1]):
        members, rows = np.flatnonzero(group == g), np.flatnonzero(scan[:, g])
        if not len(members) or not len(rows):
            continue
        least, first, second = _two_least(_distances(x[rows], book[members]))
        measured += len(rows) * len(members)
        at = members[first]
        found.append((g, rows, least, at, second))
        wins = (least < dist[rows]) | ((least == dist[rows]) & (at < best[rows]))
        best[rows[wins]], dist[rows[wins]] = at[wins], least[wins]
    for g, rows, least, at, second in found:
        low[rows, g] = _down(np.where(at == best[rows], second, least))
    left = np.flatnonzero((best != own) & ~scan[np.arange(len(x)), group[own]])
    low[left, group[own[left]]] = np.minimum(low[left, group[own[left]]], _down(was[left]))
    return best, dist, low, measured


def _sums(x: np.ndarray, best: np.ndarray, entries: int) -> np.ndarray:
    """Counts and sums of the rows of each entry: entry by (1 + length)."""
    member = np.zeros((len(x), entries))
    member[np.arange(len(x)), best] = 1
    return (member.T @ np.concatenate([np.ones((len(x), 1)), x.astype(np.float64)], 1)).astype(np.int64)


def _packed_blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BLOCK):
            if batch.num_rows:
                n = pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(n, batch.column(0)), pa.ListArray.from_arrays(n, batch.column(1)), pa.array([packed(integers(batch.column(2), dim))], pa.binary())], ["ids", "labels", "data"])

    return run


def _assigned(books: np.ndarray, group: np.ndarray, drift: np.ndarray | None):
    parts, entries, length = books.shape
    groups = int(group.max(initial=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = unpacked(row.column("data")[0].as_py(), parts * length).reshape(-1, parts, length)
                if drift is not None:
                    own = np.frombuffer(row.column("entry")[0].as_py(), np.uint8).reshape(-1, parts).astype(np.int64)
                    held = np.frombuffer(row.column("bounds")[0].as_py(), np.float32).reshape(-1, parts, groups)
                best, error, bounds, sums, measured = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64), [], [], 0
                for p in range(parts):
                    if drift is None:
                        best[:, p], d, low = assign_all(x[:, p], books[p], group[p], groups)
                        measured += len(x) * entries
                    else:
                        best[:, p], d, low, n = assign_near(x[:, p], books[p], group[p], own[:, p], held[:, p], drift[p])
                        measured += n
                    error += d
                    bounds.append(low)
                    sums.append(_sums(x[:, p], best[:, p], entries))
                made = [best.astype(np.uint8).tobytes(), np.stack(bounds, 1).astype(np.float32).tobytes(), np.stack(sums).tobytes()]
                made = [pa.array([b], pa.binary()) for b in made]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("ids", "labels", "data")), *made, pa.array([error.tolist()], pa.list_(pa.int64())), pa.array([measured])], ["ids", "labels", "data", "entry", "bounds", "sums", "errors", "measured"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for b in batch.column("sums").to_pylist():
            x = np.frombuffer(b, np.int64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])


def _rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [b[k : k + parts].hex() for b in batch.column("entry").to_pylist() for k in range(0, len(b), parts)]
            yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), batch.column("labels").flatten(), pa.array(codes, pa.string()), batch.column("errors").flatten()], ["vec_id", "label", "code", "error"])

    return run


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Blocks after the last assignment (ids, labels, entry, errors, measured), and the codebooks (part, entry, component). Two hex digits
    hold an entry, so `entries` is 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("entries from 1 to 256")
    python_ready(vectors.sparkSession)
    kept = whole(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    dim, _ = width(kept)
    dim = -(-dim // parts) * parts
    first = kept.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = integers(pa.array([r.embedding for r in first], pa.list_(pa.float64())), dim)
    books = start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    label = vectors.schema["label"].dataType.simpleString()
    base = f"ids array<long>, labels array<{label}>, data binary"
    full = f"{base}, entry binary, bounds binary, sums binary, errors array<long>, measured long"
    state = stored(kept.mapInArrow(_packed_blocks(dim), base), "vectors")
    group, drift = grouped_entries(books), None
    for turn in range(rounds + 1):
        columns = ["ids", "labels", "data"] + (["entry", "bounds"] if turn else [])
        state = stored(state.select(*columns).mapInArrow(_assigned(books, group, drift), full), "assigned")
        if turn == rounds or not len(first):
            break
        sums = state.select("sums").mapInArrow(_added, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # codebooks only
        total = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), object)
        for r in sums:
            total[r.place] = int(r.value)
        total = total.reshape(books.shape[0], books.shape[1], -1)
        new = books.copy()
        for p, e in zip(*np.nonzero(total[:, :, 0]), strict=True):
            new[p, e] = [int(v) // int(total[p, e, 0]) for v in total[p, e, 1:]]
        moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        drift = np.array([[moved[p][group[p] == g].max(initial=0) for g in range(int(group.max()) + 1)] for p in range(parts)])
        books = new
    return state, books


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, most_labels: int = MOST_LABELS) -> DataFrame:
    """One row per kept row of vectors (vec_id long, label, embedding array): vec_id, code, error, label_error, codebooks_sha256."""
    state, books = fit(vectors, parts, entries, rounds)
    label = vectors.schema["label"].dataType.simpleString()
    rows = state.select("ids", "labels", "entry", "errors").mapInArrow(_rows(parts), f"vec_id long, label {label}, code string, error long")
    keyed = rows.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    keyed = stored(keyed, "codes")
    labels = checkpointed(keyed.groupBy("none", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    if labels.limit(most_labels + 1).count() <= most_labels:
        joined = keyed.join(F.broadcast(labels.drop("n")), ["none", "label"])
    else:
        joined = dealt_join(keyed, labels, ["none", "label"], "n", keyed.count())
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    near = """
a{k} AS (
  SELECT p.r, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS best
  FROM p JOIN c{k} AS c USING (part) GROUP BY p.r, p.part)"""
    moved = """
s{k} AS (
  SELECT part, e, list(v ORDER BY i) AS x FROM (
    SELECT p.part, a.best.e AS e, i, ((sum(p.x[i]) - ((sum(p.x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
    FROM p JOIN a{k} AS a USING (r, part), range(1, 5) AS t(i) GROUP BY p.part, a.best.e, i) GROUP BY part, e),
c{n} AS (SELECT c.part, c.e, coalesce(s.x, c.x) AS x FROM c{k} AS c LEFT JOIN s{k} AS s USING (part, e))"""
    steps = [near.format(k=0), moved.format(k=0, n=1), near.format(k=1), moved.format(k=1, n=2), near.format(k=2)]
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, x[part * 4 + 1:part * 4 + 4] AS x FROM v, range(0, 16) AS t(part)),
c0 AS (SELECT part, r - 1 AS e, x FROM p WHERE r <= 64),{",".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS h FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN v USING (r), h
"""


ORACLE_SQL = _sql()
