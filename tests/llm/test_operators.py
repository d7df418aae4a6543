"""Small cases and brute-force versions of the training-data operators."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _viterbi, _words, decontamination, exact_dedup, language_id, license_scan, mixing, ngram_join, sharding, token_counts, url_filter, warc_revisit
from quillspark.llm._common import components, ranked

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "ion", "ou", "er", "ist")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_words(text):
    keep = lambda c: c.isascii() and c.isalnum() or not (c.isascii() or 0x80 <= ord(c) <= 0xBF and c not in "ªµº" or 0x2000 <= ord(c) <= 0x2FFF or 0x3000 <= ord(c) <= 0x303F)
    return "".join(c if keep(c) else " " for c in text.lower()).split()


def shingle_set(text, n=5):
    w = brute_words(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "no id here at all now"), (7, "¿Qué? «sí» — no… ok"), (8, "x" * 50_000), (9, "word " * 20_000)]


# words


def test_words_and_shingles_match_brute_force():
    texts = [None, "", "Hello, World-wide 3.5% naïve", "¿Qué? «sí» — no… ok", "漢字。かな カナ", "a", "É é " * 50, "ab" * 100_000]
    h, rows, starts, ends, data = _words.words(pa.array(texts, pa.string()))
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(rows[:-1], rows[1:], strict=True)]
    assert got == [brute_words(t or "") for t in texts]
    by = {}
    for w, x in zip(itertools.chain(*got), h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    sh = _words.shingles(h, rows)
    assert [len(set(s.tolist())) for s in sh] == [len(shingle_set(t)) for t in texts]


def test_components_and_ranks(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5)]
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
    df = spark.range(100).selectExpr("id % 3 as g", "id % 7 as cell", "id")
    rows = ranked(df, ["g"], ["id"], "cell", "r").collect()
    for g in range(3):
        assert [r.r for r in sorted((r for r in rows if r.g == g), key=lambda r: (r.cell, r.id))] == list(range(sum(r.g == g for r in rows)))


# 1


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    out = {}
    for k, (i, s) in enumerate(sets):
        out[k] = sum(1 for m, (_, u) in enumerate(sets) if m != k and s and u and len(s & u) >= 0.8 * len(s | u))
    return out


def test_join_finds_every_link(spark, make):
    rng = random.Random(1)
    rows, n = [], 0
    for base in range(12):
        words = prose(rng, rng.choice([6, 30, 200])).split()
        for _ in range(rng.choice([1, 3, 30])):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, " ".join(w)))
            n += 1
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(make(rows)).collect()}
    want = brute_links(rows)
    assert {i: r.n_links for i, r in got.items()} == want
    for i, r in got.items():
        assert r.class_id <= i and (r.class_id == i or want[i])


def test_join_splits_large_groups_into_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(2)
    words = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(words)
        w[i] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_jaccard_join(make(rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert {r.doc_id: r.n_text_links for r in got} == brute_links(rows)


def test_join_edges(spark, make):
    got = sorted(ngram_join.ngram_jaccard_join(make(EDGE)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(EDGE)
    assert [(r.doc_id, r.n_copies, r.n_links) for r in got if r.doc_id == 4] == [(4, 2, 1)] * 2
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id != 4)
    assert ngram_join.ngram_jaccard_join(make([(0, "x")]).limit(0)).count() == 0


def test_keep_one(spark, make):
    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 80)
    docs = make([(1, a), (2, a), (3, b), (4, b + " tail"), (5, None), (6, ""), (None, a), (3, b)])
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([1, 3, 5, 6, None], key=str)


def test_pruning_table_is_safe():
    for k, m in ngram_join.fewest_matches(0.8, 1e-6, 16, 240):
        assert 0 <= m <= 0.8 * k


# 2


def test_rake_meets_targets(spark):
    rng = random.Random(5)
    cells = [(f"s{a}", b, c, rng.randrange(100, 1000)) for a in range(4) for b in ("en", "de") for c in ("prose", "code")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    target = {"source": {f"s{k}": 1.0 for k in range(4)}, "lang": {"en": 3.0, "de": 1.0}, "topic": {"prose": 1.0, "code": 1.0}}
    out = mixing.rake(df.coalesce(1), target, rate=0.1).toPandas()
    out["kept"] = out.tokens * out.probability
    total = out.kept.sum()
    assert total == pytest.approx(0.1 * out.tokens.sum(), rel=1e-6)
    assert out.groupby("lang").kept.sum()["en"] / total == pytest.approx(0.75, rel=1e-3)
    assert (out.groupby("source").kept.sum() / total).tolist() == pytest.approx([0.25] * 4, rel=1e-3)


def test_mix_edges(spark, make):
    docs = make([(1, None, None, None), (2, ""), (3, "a b c", None, "s"), (3, "a b c", None, "s"), (None, "a | b"), (5, "f(x){y;}")])
    got = mixing.mix(docs).select("doc_id", "_mix").collect()
    assert len(got) == 6
    by = {(r.doc_id, r._mix.topic): r._mix for r in got}
    assert by[1, "short"].source == "unknown" and by[1, "short"].tokens == 0
    assert by[None, "table"].tokens == 3 and by[5, "code"].topic == "code"
    assert len({r._mix.kept for r in got if r.doc_id == 3}) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


# 3


def test_token_counts_match_the_library():
    import tokenizers
    from tokenizers.models import Unigram

    pieces = token_counts.read_vocabulary(token_counts.VOCABULARY)
    special = [(f"<0x{k:02X}>", 0.0) for k in range(256)]
    theirs = tokenizers.Tokenizer(Unigram([("<unk>", 0.0), *special, *pieces], 0, True))
    ours = _viterbi.Segmenter(pieces)
    rng = random.Random(6)
    texts = ["", " ", "  a  b", "Hello wonderful world\n\tx", "你好 🙂 m².x ².", "x_y (_z) \r\n ();", "ab" * 400, *(prose(rng, 40) for _ in range(30))]
    for t in texts:
        want = len(theirs.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert ours.tokens(t) == want, t
        if t:
            assert ours.count("▁" + t.replace(" ", "▁")) == want


def test_viterbi_ties_go_to_the_first_start():
    s = _viterbi.Segmenter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0)])
    assert s.count("ab") == 1  # ab and a+b score alike
    assert s.count("abz") == 2 and s.count("zz") == 2


def test_token_counts_edges(spark, make):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(make(EDGE)).collect()}
    assert got[1] is None and got[2] == 0 and got[8] > 0 and len(got) == len(EDGE) - 1
    assert token_counts.count_tokens(make(EDGE).limit(0)).count() == 0


# 4


def check_shards(rows, got, n):
    assert len(got) == len(rows)
    counts = [sum(r.shard == s for r in got) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    return counts


def test_shards_are_even_and_keep_groups_together(spark, make):
    rng = random.Random(7)
    rows = [(i, prose(rng, 9)) for i in range(150)]
    rows += [(1000 + 10 * g + k, f"group {g}") for g in range(20) for k in range(rng.randrange(2, 6))]
    got = sharding.shard(make(rows)).collect()
    check_shards(rows, got, 8)
    text = dict(rows)
    homes = {}
    for r in got:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert max(map(len, homes.values())) == 1


def test_shards_with_a_group_of_a_third(spark, make, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = [(i, "same") for i in range(80)] + [(100 + i, f"text {i}") for i in range(160)]
    got = sharding.shard(make(rows)).collect()
    check_shards(rows, got, 8)
    homes = [sum(r.shard == s and r.doc_id < 80 for r in got) for s in range(8)]
    assert sum(h > 0 for h in homes) == 3 and sorted(homes)[-2:] == [30, 30]


def test_shards_when_everything_is_linked(spark, make):
    rows = [(i, f"pair {i // 2}") for i in range(64)]
    got = sharding.shard(make(rows)).collect()
    check_shards(rows, got, 8)


def test_shards_edges(spark, make):
    got = sharding.shard(make(EDGE)).collect()
    check_shards(EDGE, got, 8)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(1, None)}
    assert sharding.shard(make(EDGE).limit(0)).count() == 0
    out = sharding.shard_documents(make(EDGE))
    assert out.count() == len(EDGE) and {"text", "lang", "shard", "slot"} <= set(out.columns)
    assert sorted(r.slot for r in out.where("shard = 0").collect()) == list(range(out.where("shard = 0").count()))


# 5


def test_revisits_match_a_linear_scan(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        url = f"http://Site{rng.randrange(4)}.org/p#x"
        kind = rng.choice(["response", "revisit", "revisit"])
        tag = rng.choice([None, "a", 'W/a', "b"])
        rows.append((k, url, rng.randrange(100), kind, {"etag": tag, "content-length": "5", "x": str(k)} if tag else {"x": str(k)}, k, str(k)))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, record_type string, headers map<string,string>, body_length long, body_digest string")
    got = {r.record_id: r for r in warc_revisit.resolve(df, buckets=7).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for rid, url, ts, kind, head, *_ in rows:
        if kind == "revisit":
            earlier = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
            best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            r = got[rid]
            assert r.refers_to == (best[0] if best else None)
            if best is None:
                assert r.status == "no_response"
            else:
                a, b = head.get("etag"), best[4].get("etag")
                ok = a is None or b is None or a.removeprefix("W/") == b.removeprefix("W/")
                assert r.status == ("resolved" if ok else "validator_mismatch")
                if ok:
                    assert r.headers["x"] == str(rid) and r.body_digest == str(best[0])
                    assert r.headers.get("content-length") == best[4].get("content-length")


def test_revisit_edges(spark):
    kind = "record_id long, url string, ts long, record_type string, headers map<string,string>, body_length long, body_digest string"
    rows = [(1, None, 1, "revisit", None, None, None), (2, "a", None, "revisit", None, None, None), (3, "a", 5, None, None, None, None), (4, "http://www.A:80/x/?utm_a=1", 1, "response", None, 3, "d"), (5, "https://a/x", 2, "revisit", None, None, None)]
    got = {r.record_id: r for r in warc_revisit.resolve(spark.createDataFrame(rows, kind)).collect()}
    assert {k: v.status for k, v in got.items()} == {1: "no_response", 2: "no_response", 5: "resolved"}
    assert got[5].refers_to == 4 and got[5].canonical_url == "a/x"
    assert warc_revisit.resolve(spark.createDataFrame([], kind)).count() == 0


# 6


def brute_dedup(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_matches_brute_force(spark, make):
    rng = random.Random(9)
    long = ". ".join(prose(rng, 40) for _ in range(200))
    rows = [*EDGE, (20, long), (21, long.replace(" ", "  ")), (22, long[:-1]), (23, "a b"), (24, "ab"), (25, "a\x0bb "), (26, "一二三。" * 3000), (27, "一二三。" * 3000 + " ")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(make(rows)).collect()]
    assert sorted(got, key=str) == brute_dedup(rows)
    assert exact_dedup.exact_dedup(make(rows).limit(0)).count() == 0


def test_colliding_identifiers_are_found_and_replaced(spark, make):
    rows = [(1, "aaa"), (2, "bbb"), (3, "a aa")]
    weak = (lambda c: F.length(c).cast("long"), lambda c: F.sha2(c, 256))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(make(rows), weak).collect()}
    assert got == {1: 3, 2: 2, 3: 3}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(make(rows), weak[:1])


# 7


def test_license_guarantee():
    for text in license_scan.TEMPLATES.values():
        assert license_scan.guarantee(len(brute_words(text)), 0.8) > 0.9999


def test_licenses_match_exact_containment(spark, make):
    rng = random.Random(10)
    names = list(license_scan.TEMPLATES)
    rows = []
    for i in range(120):
        w = prose(rng, rng.randrange(0, 200)).split()
        for name in rng.sample(names, rng.choice([0, 1, 2])):
            x = license_scan.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                x[rng.randrange(len(x))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        rows.append((i, " ".join(w)))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(make(rows)).collect()}
    want = {}
    for i, t in rows:
        w = brute_words(t)
        for name, x in license_scan.TEMPLATES.items():
            s, size = shingle_set(x), license_scan.window_class(len(brute_words(x)))
            best = max((len(s & shingle_set(" ".join(w[a : a + 2 * size]))) / len(s) for a in range(0, max(1, len(w)), size)), default=0)
            if best >= 0.8 and len(w) >= 5:
                want[i, name] = best
    assert got == pytest.approx(want)


def test_license_edges(spark, make):
    line = license_scan.TEMPLATES["MIT-line"]
    got = license_scan.scan_licenses(make([*EDGE, (None, line), (30, line), (30, line)])).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("30", "MIT-line")] * 2 + [("None", "MIT-line")]


# 8

ALPHABETS = {"xx": "abcdefg", "yy": "hijklmn", "zz": "opqrstu"}


def language_rows(rng, n):
    vocabulary = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(2, 7))) for _ in range(300)] for k, v in ALPHABETS.items()}
    return [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([8, 40, 300]))), lang) for i in range(n) for lang in [rng.choice(list(ALPHABETS))]]


def test_language_held_out_accuracy(spark, make):
    rows = language_rows(random.Random(11), 300)
    got = language_id.identify(make(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert held and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, make):
    rng = random.Random(12)
    long = " ".join("".join(rng.choice(ALPHABETS["xx"]) for _ in range(4)) for _ in range(20_000))
    rows = [*language_rows(rng, 60), (100, None, None), (101, "12 34 !?", "xx"), (102, "", "yy"), (None, "abc", "xx"), (103, long, None)]
    got = {r.doc_id: r for r in language_id.identify(make(rows)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred == "xx"
    assert not got[None].held_out
    docs = make(rows)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {100, 101, 102}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(make([(1, "abc", None)])).collect()} == {"und"}


# 9


def test_urls_against_all_rules(spark):
    urls = [None, "", "example.org/es/", "https://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://b.org", "http://b.org/", "x://shop.com/de/", "x://shop.com/fr/a#b", "https://notexample.org/es/", "http://big.cheap-pills.example.net/", "http://a.com/ads/x", "http://casino.example.net/en/1?u#f", "http://com/de/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.host_path(u)
        fits = [r for r in url_filter.HOST_RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        blocked = any(re.search(r.pattern, (u or "").lower()) for r in url_filter.PATTERN_RULES)
        assert got[i] == (host, path, best.name if best else None, best.verdict if best else "block" if blocked else "allow"), u
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# 10


def test_lcs():
    rng = random.Random(13)
    for _ in range(50):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(decontamination.places(a), len(a), b) == t[-1][-1]


def test_planted_benchmark_passages_are_found(spark, make):
    rng = random.Random(14)
    tail = [f"rare{k}x" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(tail if rng.random() < 0.5 else WORDS) for _ in range(n))
    items = [(k, text(rng.choice([15, 30, 55]))) for k in range(20)] + [(90, None), (91, ""), (92, "only five words stand here")]
    rows, planted = [], set()
    for i in range(150):
        w = text(rng.choice([40, 200, 600])).split()
        if i % 5 == 0:
            k = rng.randrange(20)
            x = items[k][1].split()
            for _ in range(len(x) // 10 if i % 2 else 0):
                x[rng.randrange(len(x) - 6)] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = x
            planted.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(500, "See only five words stand here."), (501, None), (502, ""), (None, items[0][1]), (503, "only five words"), (500, "See only five words stand here.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make(rows), bench).collect()}
    assert got == planted | {(500, 92), (None, 0)}
    docs = make(rows)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in planted} - {500}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_short_and_thinned_copies_are_found_as_by_brute_force(spark, make):
    rng = random.Random(15)
    tail = [f"rare{k}x" for k in range(4000)]
    text = lambda n: [rng.choice(tail if rng.random() < 0.4 else WORDS) for _ in range(n)]
    sizes = [8, 9, 10, 12, 15, 24, 40, 60]
    items = [text(n) for n in sizes for _ in range(3)]
    rows, planted = [], set()
    for i in range(240):
        k = i % len(items)
        x, n = list(items[k]), len(items[k])
        if i % 3:  # three fifths or more of the words, the answer among them, with others between
            gone = set(rng.sample(range(n - 5), min(n - 5, int(n * 0.4))))
            x = [w for p, w in enumerate(x) if p not in gone]
            for _ in range(n // 2):
                x.insert(rng.randrange(len(x)), rng.choice(tail))
        w = text(rng.choice([60, 300]))
        at = rng.randrange(len(w))
        rows.append((i, w[:at] + x + w[at:]))
        planted.add((i, k))

    def common(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            s = [0]
            for j, y in enumerate(b):
                s.append(t[j] + 1 if x == y else max(t[j + 1], s[j]))
            t = s
        return t[-1]

    def copy(x, w):
        span, can = 2 * len(x) + 24, set(x)
        for a in range(max(1, len(w) - span + 1)):
            part = [y for y in w[a : a + span] if y in can]
            if len(part) >= 0.6 * len(x):
                n = common(x, part)
                if n >= 0.8 * len(x) or (n >= 0.6 * len(x) and common(x[-5:], part) == 5):
                    return True
        return False

    want = {(i, k) for i, w in rows for k, x in enumerate(items) if len(set(x) & set(w)) >= 0.3 * len(x) and copy(x, w)}
    assert planted <= want
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make([(i, " ".join(w)) for i, w in rows]), bench).collect()}
    assert got == want


@pytest.mark.parametrize("n", [8, 16, 33, 80])
def test_every_word_of_an_item_is_in_a_latent_query(n):
    words = [f"word{k}" for k in range(n)]
    h, *_ = _words.words(pa.array([" ".join(words)]))
    terms = decontamination._terms(h)
    latent = np.zeros((decontamination.TERMS + 1, n), np.float32)
    latent[terms, np.arange(n)] = 1
    s = decontamination.Searcher([(1, " ".join(words), None)], latent, np.ones(decontamination.TERMS, np.float32), 0.8, 0.6, 0.46)
    assert len(set(terms.tolist())) == n
    assert (s.queries > 0).any(axis=1).all()


def test_gram_has_the_passages_of_every_document():
    sent = type("Sent", (), {"value": np.ones((decontamination.TERMS + 1, decontamination.RANK), np.float32)})
    lens = [5, 8, 9, 16, 24, 25, 60, 3, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{k}" for k in range(n)) for n in lens])], ["text"])
    (out,) = decontamination._gram(sent)(decontamination._coded(iter([batch])))
    assert np.frombuffer(out.column("part")[decontamination.RANK].as_py(), np.float32)[0] == sum(-(-n // 24) for n in lens)
