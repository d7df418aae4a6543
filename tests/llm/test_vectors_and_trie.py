"""Vector codes, prefix trie and exact top-k against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import codebooks, prefix_trie, top_k

VECTORS = "vec_id long, embedding array<double>, label int, code string, error int, q int, rank string, score string, part int, low int"
TURNS = "conv_id long, turn long, role string, text string, depth int, fp string, words string, pos string, n int, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "r", "s", 3, 4) for r in rows], VECTORS)


def whole(rows):
    return [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def odd_rows(rng, n, dim, distinct=None):
    pool = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(distinct or n)]
    rows = [(i, pool[i % len(pool)], rng.choice([None, 0, 1])) for i in range(n)]
    return rows + [(n, None, 0), (n + 1, [None] * dim, 0), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] * dim, 1)]


# 11


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(whole(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    x = [(v + [0] * (dim - len(v))) for _, v, _ in kept]
    size = dim // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def nearest():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    got = nearest()
    errors, by = [sum(d for d, _ in g) for g in got], defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in g), e, by[r[2]], sha) for r, g, e in zip(kept, got, errors, strict=True))


def codes(df, **more):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in codebooks.vector_codes(df, **more).collect())


@pytest.mark.parametrize(("n", "dim", "distinct"), [(300, 32, None), (200, 16, 20), (10, 64, None), (90, 20, 30)])
def test_codes_equal_plain_lloyd(spark, n, dim, distinct):
    rows = odd_rows(random.Random(n), n, dim, distinct)
    rows += [(None, rows[0][1], 0), (3, rows[3][1], 0), (3, rows[5][1], 1)]
    assert codes(vectors(spark, rows)) == brute_codes(rows)
    assert codes(vectors(spark, rows), most_labels=1) == brute_codes(rows)


def test_bounds_spare_scans(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(32)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 40]], 0) for i in range(800)]
    state, books = codebooks.fit(vectors(spark, rows))
    measured = state.agg({"measured": "sum"}).first()[0]
    assert books.shape == (16, 64, 2) and measured < 0.6 * 800 * 16 * 64


def test_bounds_keep_ties():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, book = rng.integers(-3, 4, (200, 2)), rng.integers(-3, 4, (20, 2))
        group = codebooks.grouped_entries(book[None], 4)[0]
        t = group.max() + 1
        own, _, low = codebooks.assign_all(x, book, group, t)
        for _ in range(3):
            new = book + rng.integers(-1, 2, book.shape)
            moved = np.sqrt(((new - book) ** 2).sum(1)) * (1 + codebooks.SLACK)
            own, dist, low, _ = codebooks.assign_near(x, new, group, own, low, np.array([moved[group == g].max(initial=0) for g in range(t)]))
            d = ((x[:, None] - new[None]) ** 2).sum(2)
            assert (own == d.argmin(1)).all() and (dist == d.min(1)).all()
            book = new


def test_codes_of_nothing(spark):
    assert codes(vectors(spark, [])) == [] and codes(vectors(spark, [(1, None, 1)])) == []
    with pytest.raises(Exception, match="64 bits"):
        codes(vectors(spark, [(1, [1e30] * 16, 0)]))


# 12


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")) - p[-1][1].translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ").count("") if p else 0
        leaves = sum(out[k][0] for k in kids[p]) if kids[p] else 1
        out[p] = (leaves, (len(members[p]) - 1) * words + sum(out[k][1] for k in kids[p]))
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), *out[p], sha(p)) for p, m in members.items())


def trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "f", "w", "p", 2, 3) for r in rows], TURNS)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.prefix_trie(df, **more).collect()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in got)


def talk(rng, convs, longest=6, vocabulary=3):
    rows = []
    for c in convs:
        for k in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, k, k, k]), rng.choice([None, "user"]), rng.choice([None, "", " a\tb ", *("w " * n for n in range(vocabulary))])))
    return rows + [(None, 1, "user", "no conversation")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = talk(rng, [*range(0, 70), *range(101, 140), 1000003])
    same = [(c, k, "user", f"same {k}") for c in range(200, 240) for k in range(9)]
    assert trie(spark, rows + same, cell=4) == brute_trie(rows + same)


def test_colliding_fingerprints_are_split(spark):
    rng = random.Random(9)
    rows = [(c, k, "user", rng.choice(["a", "b", "c d"])) for c in range(40) for k in range(rng.randint(1, 4))]
    assert trie(spark, rows, moduli=((3, 2), (1, 1))) == brute_trie(rows)


def test_trie_of_long_and_missing_turns(spark):
    long = [(7, k, "user", f"turn {k}") for k in range(600)] + [(8, k, "user", f"turn {k}") for k in range(601)]
    gone = [(61, 0, None, None), (62, 0, "user", "x" * 200_000), (63, 0, "user", "x" * 200_000), (63, 0, "user", "x" * 200_000)]
    assert trie(spark, long + gone, cell=64) == brute_trie(long + gone)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "a", "b")]) == []


# 13


def brute_top(rows, k=5, every=50):
    kept = whole(rows)
    out = []
    for a, (q, x, _) in enumerate(kept):
        if q is None or q % every:
            continue
        scores = [(-sum(s * t for s, t in zip(x, y)), i is None, i or 0) for b, (i, y, _) in enumerate(kept) if a != b]  # noqa: B905
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def top(df, **more):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"local_bytes": 0, "block": 16}, {"bins": 2, "block": 50}])
def test_top_k_equals_all_scores(spark, more):
    rows = odd_rows(random.Random(3), 320, 16, 150)
    rows += [(None, rows[0][1], 0), (100, rows[100][1], 0), (100, rows[7][1], 1), (50, [0.5], 0), (0, [], 0)]
    assert top(vectors(spark, rows), **more) == brute_top(rows)


def test_top_k_of_equal_and_few_rows(spark):
    same = [(i, [0.25, -0.5], 0) for i in range(130)]
    assert top(vectors(spark, same), block=20) == brute_top(same)
    few = [(0, [1.0, 2.0], 0), (50, [-1.0, 2.0], 0), (7, [3.0, 1.0], 0)]
    assert top(vectors(spark, few)) == brute_top(few)
    assert top(vectors(spark, [])) == [] and top(vectors(spark, [(1, [1.0], 0)])) == [] and top(vectors(spark, [(50, [1.0], 0)])) == []


def test_top_k_of_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(8)], 0) for i in range(60)] + [(70, [4e5] * 8, 0), (50, [4e5] * 8, 0)]
    assert top(vectors(spark, rows)) == brute_top(rows)
