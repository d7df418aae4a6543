"""Operator 3: token counts by a Viterbi pass that keeps only best score and piece count.

The vocabulary (pieces and scores) comes from a public tokenizer's model file on the driver and is broadcast; its size
is checked. An Aho-Corasick automaton enumerates all vocabulary matches of a text; at each position the best score and
its piece count are kept. Ties go to the match that starts first, the rule of the unigram tokenizer. Texts are cut at
places where every best path has a boundary (see `_viterbi.Segmenter`), and a worker remembers counts of such segments.

Defined results: a null text has null tokens, an empty one none. Every character counts: unknown ones as their UTF-8
bytes. Texts of any length are read whole, one at a time. Repeated rows are counted alike, null ids pass, an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import _viterbi
from ._common import python_ready

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES = 1_000_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]


def _count(vocabulary, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _viterbi.segmenter(digest, lambda: vocabulary.value)
        for batch in batches:
            n = [None if t is None else seg.tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens."""
    spark = docs.sparkSession
    python_ready(spark)
    pieces = read_vocabulary(vocabulary)
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    digest = hashlib.sha256(repr(pieces).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(sent, digest), f"doc_id {kind}, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
