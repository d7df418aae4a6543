"""Groups larger than a task: places, order statistics, schedules and chapter cuts against plain functions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import aggregates, ranking, scheduling


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), k) for k in range(3000)]
    got = ranking.placed(spark.createDataFrame(rows, "g string, v int, id int").repartition(5), ["g"], ["v", "id"]).collect()
    by = defaultdict(list)
    for g, v, i in rows:
        by[g].append((v, i))
    assert sorted((str(r.g), r.place, r.v, r.id) for r in got) == sorted((str(g), k, *x) for g, xs in by.items() for k, x in enumerate(sorted(xs)))
    assert ranking.placed(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0
    df = spark.createDataFrame([(g, i, None if v == 7 else v) for g, v, i in rows], "g string, id int, v int")
    sums = {(g, i): sum(0 if w == 7 else w for h, w, j in rows if h == g and j < i) for g, _, i in rows}
    assert {(r.g, r.id): r.t for r in ranking.running_total(df, ["g"], ["id"], F.col("v"), "t").collect()} == sums
    assert [r.p for r in ranking.placed(df, [], ["id"], "p").orderBy("id").collect()] == list(range(3000))


@pytest.mark.parametrize("few", [0, 40])
def test_values_at_an_index(spark, few):
    rng = random.Random(2)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(900)] + [("ties", float(rng.randint(0, 3))) for _ in range(700)] + [("one", 4.5), ("same", 1e300), ("same", 1e300), ("wide", -1e308), ("wide", 1e308), ("wide", 0.0), (None, 7.0), (None, 8.0), ("none", None), ("one", float("nan"))]
    rows += [("near", 1.0 + k * 2**-52) for k in range(60)]
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            by[g].append(v)
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranking.value_at(df, ["g"], "v", F.floor(F.lit(0.95) * (F.col("n") - 1)), "p", buckets=8, few=few).collect()
    assert {r.g: r.p for r in got} == {g: sorted(v)[int(0.95 * (len(v) - 1))] for g, v in by.items()} and len(got) == len(by)
    ints = spark.createDataFrame([(1, k % 9) for k in range(400)], "g int, v long")
    assert [r.p95 for r in aggregates.nearest_rank_95(ints, ["g"], "v").collect()] == [sorted(k % 9 for k in range(400))[379]]


def plain_batches(rows, capacity, most):
    by = defaultdict(list)
    for g, i, n in rows:
        by[g].append((n or 0, i))
    out = {}
    for g, xs in by.items():
        sizes = scheduling.partition_lengths([n for n, _ in sorted(xs)], capacity, most)
        out |= {(g, i): b for (_, i), b in zip(sorted(xs), [b for b, n in enumerate(sizes) for _ in range(n)], strict=True)}
    return out


@pytest.mark.parametrize(("block", "most", "longest"), [(4, 3, 30), (1, 4, 12), (7, 8, 400), (4096, 5, 60)])
def test_schedule_equals_the_plain_recurrence(spark, monkeypatch, block, most, longest):
    monkeypatch.setattr(scheduling, "FAN", 3)
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "b", None]), k, rng.choice([None, *[rng.randint(1, longest)] * 9])) for k in range(260)] + [("one", 999, 5), ("same", 1000, 7), ("same", 1001, 7), ("same", 1002, 7)]
    capacity = {n: longest * 2 // n for n in range(2, most + 1)}
    df = spark.createDataFrame(rows, "g string, item_id long, token_length int")
    got = scheduling.schedule(df, "g", capacity, most, block).collect()
    assert {(r.g, r.item_id): r.batch for r in got} == plain_batches(rows, capacity, most) and len(got) == len(rows)


def test_schedule_of_one_large_key(spark):
    n = 120_000
    df = spark.range(n).select(F.lit("k").alias("g"), F.col("id").alias("item_id"), (F.xxhash64("id") % 700 + 701).cast("int").alias("token_length"))
    got = scheduling.schedule(df, "g", {2: 1200, 3: 900, 4: 500}, 4, block=1000)
    rows = [(r.g, r.item_id, r.token_length) for r in df.collect()]
    want = plain_batches(rows, {2: 1200, 3: 900, 4: 500}, 4)
    assert all(want[r.g, r.item_id] == r.batch for r in got.collect())
    assert scheduling.schedule(df.limit(0), "g", {2: 5}, 2).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        scheduling.schedule(df.withColumn("token_length", F.lit(2**31 - 1)), "g", {}, 40)


def plain_cuts(rows, limit, ahead):
    """Greedy cuts of one chapter: rows (index, start, end, mark) in order."""
    n = len(rows)
    if rows[-1][2] - rows[0][1] <= limit + 0.5:
        return [(rows[0][0], rows[-1][0])]
    out, first = [], 0
    while first < n:
        over = next((i for i in range(first, n) if rows[i][2] + 0.01 >= rows[first][1] + limit), n - 1)
        view = range(over, min(n, over + ahead))
        paragraph = next((i for i in view if rows[i][3] in ("paragraph_end", "paragraph_break", "chapter_start")), None)
        stops = [i for i in view if rows[i][3] in ("period", "sentence_end")]
        cut = n - 1 if over == n - 1 else paragraph if paragraph is not None else stops[-1] if stops else over
        out.append((rows[first][0], rows[cut][0]))
        first = cut + 1
    return out


@pytest.mark.parametrize("ahead", [1, 3, 40])
def test_cuts_equal_the_greedy_walk(spark, ahead):
    rng = random.Random(ahead)
    rows, want = [], {}
    for chapter in range(12):
        at, mine = 0.0, []
        for k in range(rng.choice([1, 5, 40, 150])):
            length = rng.choice([0.0, 1.0, 7.3, 20.0, 65.0])
            mine.append((k * 2 + chapter, at, at + length, rng.choice(["period", "comma", "comma", None, "sentence_end", *(["paragraph_end"] if chapter % 3 else [])])))
            at += length
        rows += [(chapter, *r) for r in mine]
        want[chapter] = plain_cuts(mine, 60.0, ahead)
    df = spark.createDataFrame(rows, "chapter int, index int, start_s double, end_s double, boundary_type string")
    got = defaultdict(list)
    for r in sorted(scheduling.subdivide(df, ["chapter"], 1.0, ahead).collect(), key=lambda r: (r.chapter, r.part)):
        assert r.part == len(got[r.chapter])
        got[r.chapter].append((r.start_index, r.end_index))
    assert got == want
