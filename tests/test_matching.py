"""Joins over an index against all pairs."""

import random
import re

import pytest

from quillspark.operators import matching


def brute_regions(segments, regions, slack=0.001):
    out = set()
    for key, seg, a, b in segments:
        mine = sorted((r for r in regions if r[0] == key and r[2] is not None), key=lambda r: r[1])
        if a is None or not mine:
            continue
        m = (a + b) / 2
        hit = next((r for r in mine if r[2] - slack <= m <= r[3] + slack), None)
        best = hit or max(mine, key=lambda r: (min(b, r[3]) - max(a, r[2]), -r[1]))
        out.add((key, seg, best[1], hit is not None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments_to_regions(spark, seed):
    rng = random.Random(seed)
    regions, at = [], 0.0
    for k in range(40):
        at += rng.choice([0.0, 0.0, 3.0, 40.0])
        long = rng.choice([0.5, 2.0, 5.0, 200.0])
        regions.append((k % 3, k, at, at + long))
        at += long * rng.choice([1.0, 0.5])
    regions += [(3, 5, 10.0, 20.0), (3, 4, 30.0, 40.0), (4, 1, None, 5.0)]
    segments = [(rng.randint(0, 5), k, a, a + rng.choice([0.0, 0.1, 4.0, 90.0])) for k in range(300) for a in [round(rng.uniform(-50, at + 50), 2)]]
    segments += [(3, 900, 25.0, 25.0), (3, 901, 20.001, 20.001), (3, 902, None, 1.0), (3, 903, 22.0, 28.0), (3, 904, 0.0, 100.0), (9, 905, 1.0, 2.0)]
    got = matching.segments_to_regions(spark.createDataFrame(segments, "key int, seg int, start double, end double"), spark.createDataFrame(regions, "key int, region int, r_start double, r_end double")).collect()
    assert {tuple(r) for r in got} == brute_regions(segments, regions) and len(got) == len(brute_regions(segments, regions))


def test_names_by_runs_of_letters(spark):
    rng = random.Random(4)
    files = ["".join(rng.choice("abAB.é") for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["Voice One.wav", "voice one.WAV", None, "x"]
    wanted = ["".join(rng.choice("abAé") for _ in range(rng.randint(0, 5))) for _ in range(80)] + ["VOICE", "voice one.WAV", "zzz", "zz", "x", None, "ab", "ab"]
    df = matching.find_by_name(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([(f,) for f in files], "name string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan

    def brute(w):
        hits = [f for f in files if w is not None and f is not None and w.lower() in f.lower()]
        return w if w in hits else min(hits, default=None)

    assert sorted(((r.wanted, r.name) for r in df.collect()), key=repr) == sorted(((w, brute(w)) for w in wanted), key=repr)
    nothing = matching.find_by_name(spark.createDataFrame([("a",), ("",)], "wanted string"), spark.createDataFrame([], "name string"))
    assert sorted(map(tuple, nothing.collect())) == [("", None), ("a", None)]


@pytest.mark.parametrize("least", [0.2, 0.5, 2 / 3, 1.0])
def test_pairs_by_words(spark, least):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(words, weights=[30 - k for k in range(30)], k=rng.randint(0, 9)))
    left, right = [(k, text()) for k in range(120)] + [(500, None), (501, " ., ")], [(k, text().upper() + "!") for k in range(60)] + [(700, "")]
    got = matching.f1_join(spark.createDataFrame(left, "left_id int, text string"), spark.createDataFrame(right, "right_id int, text string"), least).collect()
    sets = lambda rows: {k: set(re.sub(r"[^\w\s]", "", (t or "").lower()).split()) for k, t in rows}
    want = {}
    for a, x in sets(left).items():
        for b, y in sets(right).items():
            f1 = 1.0 if not x and not y else 2.0 * len(x & y) / (len(x) + len(y))
            if f1 >= least:
                want[a, b] = f1
    assert {(r.left_id, r.right_id): r.f1 for r in got} == want and len(got) == len(want) > 0


def test_sets_of_no_fitting_size_are_not_kept(spark, monkeypatch):
    stored, kept = [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda df: stored.append(kept(df)) or stored[-1])
    long = " ".join(f"w{k}" for k in range(400))
    left = [(1, "w1 w2 w3 only here"), (2, long), (3, "w1"), (4, ""), (5, "w1 w2 other third"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    right = [(1, "w1 w2 w3 w4"), (2, "w1 w2 w9 v1 v2 v3"), (3, None)]
    frames = [spark.createDataFrame(left, "left_id int, text string"), spark.createDataFrame(right, "right_id int, text string")]
    got = {(r.left_id, r.right_id): r.f1 for r in matching.f1_join(*frames, 0.5).collect()}
    assert got == {(1, 1): 6 / 9, (5, 1): 0.5, (6, 1): 0.5, (4, 3): 1.0}
    sizes = [len(r.words) for df in stored if "words" in df.columns for r in df.collect()]
    # left sets of 2 to 18 words may meet right ones of 4 and 6; words of one side alone are not counted
    assert max(sizes) == 12 and sorted(r.word for df in stored if "freq" in df.columns for r in df.collect()) == ["w1", "w2", "w3", "w4", "w9"]
    none = matching.f1_join(frames[0], frames[1].where("right_id = 3"), 0.5).collect()
    assert [tuple(r) for r in none] == [(4, 3, 1.0)]
    assert matching.f1_join(frames[0], frames[1].where("false"), 0.5).count() == 0
