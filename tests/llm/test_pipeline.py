"""The pipeline against brute-force versions of what its stages decide."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import decontamination, language_id, mixing
from quillspark.llm.registry import oracle_sql, queries

from .test_operators import brute_words, language_rows, shingle_set


@pytest.fixture()
def folder(spark, make, tmp_path):
    rng = random.Random(20)
    rows = language_rows(rng, 160)
    rows += [(1000 + i, rows[i][1] + " extra", rows[i][2]) for i in range(0, 160, 8)]
    item = " ".join(f"leak{k}" for k in range(30))
    rows += [(2000 + i, rows[i][1] + " " + item, rows[i][2]) for i in range(1, 160, 20)]
    rows += [(3000, None, None), (3001, "123", "xx"), (3002, "", "yy")]
    make([(i, t, lang, f"s{i % 3}") for i, t, lang in rows], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), {r[0]: r[1] for r in rows}


def test_pipeline_stages(spark, folder):
    path, text = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        seen.append({r.doc_id for r in rows})
        assert seen[-1] <= seen[-2]
        docs = out
    rejected = {r.doc_id for r in language_id.identify(spark.read.parquet(f"{path}/documents.parquet")).collect() if r.rejected}
    assert seen[0] - seen[1] == rejected >= {3000, 3001, 3002}
    left = sorted(seen[1])
    sets = {i: shingle_set(text[i]) for i in left}
    root = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert seen[2] == {i for i in left if root[i] == i}
    item = brute_words(" ".join(f"leak{k}" for k in range(30)))
    assert seen[2] - seen[3] == {i for i in seen[2] if set(item) <= set(brute_words(text[i]))}
    assert len(seen[5]) == len(seen[4])
    shards = [r.shard for r in rows]
    counts = [shards.count(s) for s in range(8)]
    assert max(counts) - min(counts) <= 1


def test_run_and_registry(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns) and out.count() > 0
    ops = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert ops == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
    assert mixing.ORACLE_SQL and decontamination.TERMS


def test_pipeline_with_rare_rows(spark, make, tmp_path):
    rng = random.Random(21)
    rows = [(i, t, lang, f"s{i % 3}") for i, t, lang in language_rows(rng, 60)]
    rows += [(None, rows[0][1], None, None), (None, None), (5, rows[5][1], rows[5][2], "s2"), (900, ""), (901, "word " * 5000, "en", "s1")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    make(rows).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for d in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([(1, " ".join(f"leak{k}" for k in range(30)))], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all(r.text for r in out) and all(r.score == "y" and r.kept == "k" and isinstance(r.shard, int) for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
