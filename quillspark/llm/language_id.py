"""Operator 8: language identification by compression.

Each language has a raw-content zstandard dictionary of three-word pieces from a bounded sample of labelled documents
(distinct texts, in the order of a hash; pieces in the order of a hash, so that no passage is kept whole). A text, its
letters in lower case and all else as single spaces, is cut into blocks of 4 KB, every block is compressed with every
dictionary and the language with the smallest sum is chosen. A close result (margin under 1 %) is decided by a stronger
compression behind a run of zeros, without which zstandard stores a few words as they are; a margin that then is under
the least margin is rejected. Whole texts are read.

Learned from: text and lang of documents whose crc32(doc_id as text) mod 3 is not 1. Bounds of the sample: `per_language`
documents, `excerpt` characters of each, 112 KB a dictionary. More than MOST_LANGUAGES labels raise an error, as every dictionary is
sent to every executor. The sample takes two passes: one counts rows and distinct texts (about) by language, one draws the texts whose
hash is under a limit that lets about four times as many through as are wanted, and the first of these by hash are taken.

Defined results: a null text and one without a letter are `und` with score 0, rejected. Ties go to the language with
more labelled rows, then the first by name. Without any labelled row all is `und`. A null doc_id is not learned from
and not held out. Every learned language has a dictionary: where its texts have fewer than three words, of the words there are; an excerpt
of fewer gives way to the text from its first letter on. Texts of any length are read whole. Repeated rows are judged alike; an empty table gives an empty result. lang,
source and other columns play no part in a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import free_name, python_ready

BLOCK, PIECE, DICT_BYTES, MOST_LANGUAGES = 4096, 3, 112 * 1024, 1000
LEAD = b"0" * 64 + b" "
_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-cased letters, with one space for each run of anything else; empty if there is no letter."""
    out = _LETTERS.sub(" ", (text or "").lower()).strip()
    return out if any(c.isalpha() for c in out) else ""


def dictionary(excerpts: list[str]) -> bytes:
    """Pieces of PIECE words; where no excerpt has so many, what words there are. Repeated up to the 8 bytes that a dictionary needs."""
    texts = [letters(x).split() for x in excerpts]
    pieces = {" ".join(w[k : k + PIECE]): None for w in texts for k in range(0, len(w) - PIECE + 1, PIECE)} or {" ".join(w): None for w in texts if w}
    out = " ".join(sorted(pieces, key=lambda p: (zlib.crc32(p.encode("utf-8", "surrogatepass")), p))).encode("utf-8", "surrogatepass")[:DICT_BYTES]
    while 0 < len(out) < 8:
        out += b" " + out
    return out


def train(docs: DataFrame, per_language: int = 400, excerpt: int = 800) -> dict[str, bytes]:
    """Dictionaries by language, the most frequent first."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    usable = docs.where((rest != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    counts.sort(key=lambda r: (-r.n, r.lang))
    if not counts:
        return {}
    order = F.xxhash64("h")
    share = {r.lang: min(1.0, 4 * max(per_language, 25) / r.texts) for r in counts}
    limit = F.try_element_at(F.create_map(*[F.lit(x) for lang, q in share.items() for x in (lang, min(2**63 - 1, int((2 * q - 1) * 2**63)))]).cast("map<string,long>"), F.col("lang"))
    cut = F.substring(F.col("text"), (F.length("text") / 3).cast("int") + 1, F.lit(excerpt))
    cut = F.when(F.regexp_count(cut, F.lit(r"\p{L}+")) >= PIECE, cut).otherwise(F.substring(F.regexp_extract("text", r"(?s)\p{L}.*", 0), F.lit(1), F.lit(excerpt)))
    drawn = usable.where(order <= limit).groupBy("lang", order.alias("o"), "h").agg(F.min(cut).alias("x"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("o", "h"))
    rows = drawn.withColumn("r", place).where(F.col("r") <= per_language).select("lang", "x").collect()  # per_language rows a language at most
    by: dict[str, list[str]] = {r.lang: [] for r in counts}
    for r in sorted(rows, key=lambda r: r.x):
        by[r.lang].append(r.x)
    made = {lang: dictionary(x) for lang, x in by.items()}
    return {lang: d for lang, d in made.items() if d}


class Classifier:
    """Sums of compressed sizes over blocks, for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.fast, self.strong = ([self._made(d, level) for d in dictionaries.values()] for level in (6, 19))

    @staticmethod
    def _made(data: bytes, level: int):
        import zstandard

        plain = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=plain)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=plain)

    @staticmethod
    def _sizes(data: bytes, made: list, lead: bytes) -> list[int]:
        return [sum(len(c.compress(lead + data[a : a + BLOCK])) for a in range(0, len(data), BLOCK)) for c in made]

    def predict(self, text: str | None, least_margin: float) -> tuple[str, float, bool]:
        """Language, margin, rejected."""
        data = letters(text).encode("utf-8", "surrogatepass")
        if not data or not self.names:
            return "und", 0.0, True
        for made, lead in ((self.fast, b""), (self.strong, LEAD)):
            sizes = self._sizes(data, made, lead)
            best = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the first, so the most frequent
            second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
            margin = 1 - sizes[best] / second
            if margin >= 0.01:
                break
        return self.names[best], margin, margin < least_margin



def _predict(sent, least_margin: float, keep: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(sent.value)
        for batch in batches:
            found = [c.predict(t, least_margin) for t in batch.column("text").to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], names)

    return run


def _labelled(docs: DataFrame, keep: list[str], least_margin: float) -> DataFrame:
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(train(docs))
    fields = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(keep, fields, strict=True)), "lang_pred string, score double, rejected boolean"])
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"]))).mapInArrow(_predict(sent, least_margin, keep, [*keep, "lang_pred", "score", "rejected"]), schema)


def identify(docs: DataFrame, least_margin: float = 0.002) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected."""
    out = _labelled(docs, ["doc_id"], least_margin)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, least_margin: float = 0.002) -> DataFrame:
    """The rows of docs whose language is not rejected, with the columns of docs; those named like a column of the
    prediction (lang_pred, score, rejected) are set aside meanwhile."""
    aside = {c: free_name(docs, f"_own_{i}") for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score", "rejected")}
    plain = docs.withColumnsRenamed(aside)
    out = _labelled(plain, plain.columns, least_margin).where(~F.col("rejected")).drop("lang_pred", "score", "rejected")
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
