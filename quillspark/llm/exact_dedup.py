"""Operator 6: exact deduplication by content-defined chunk recipes. DataFrame operations only.

The text without white space is cut, as UTF-8 bytes, where its content says so: after the first sentence mark that follows 512
bytes; where there is none within 4096, after the first two bytes, 512 or more behind the start and at most three apart, that both
leave 3 divided by 8, as bytes of letters of every script may; after 8192 bytes at the latest. A dictionary of all distinct
chunks proves that no identifier (MD5, or SHA-256 should one collide) stands for two chunks; each chunk text moves once for that,
and no document moves. A document is then its recipe, the ordered list of its chunks' identifiers, which is stored; equal recipes are
equal texts. The groups are joined back to the stored rows, large ones in pieces.

Defined results: null counts as the empty text. Of equal texts the row with the most code points in the original text
stays, then the smallest doc_id; a row without a doc_id stays only if no row of its group has one. Repeated rows (one
doc_id) have equal rows in the result, all kept or none, and count in group_size. An empty table gives an empty result.
Texts of any length are read whole, one in a task.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, dealt_join, stored

SPACE = r"[\x20\x09-\x0D]+"
#: Sentence marks as UTF-8 bytes: . ! ? and those of Chinese, Devanagari, Arabic and Urdu.
MARK = r"(?:[.!?]|\xE3\x80\x82|\xEF\xBC[\x81\x9F]|\xE0\xA5\xA4|\xD8\x9F|\xDB\x94)"
#: Bytes that leave 3 divided by 8, which letters of every script have.
RARE = "[" + "".join(f"\\x{c:02x}" for c in range(3, 256, 8)) + "]"
CHUNK = rf"(?s).{{512,4096}}?(?:{MARK}|\z)|.{{512,8192}}?(?:{RARE}.{{0,2}}{RARE}|\z)|.{{1,8192}}"
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (lambda c: F.unhex(F.md5(c)), lambda c: F.unhex(F.sha2(c, 256)))


def chunks(text: Column) -> Column:
    """Pieces of the text's UTF-8 bytes, each byte as one character."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def clashes(norm: DataFrame, ident: Callable[[Column], Column]) -> DataFrame:
    """Identifiers that stand for more than one distinct chunk of norm.norm."""
    each = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(ident(F.col("chunk")).alias("id"), "chunk")
    return each.groupBy("id", "chunk").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def exact_dedup(docs: DataFrame, identifiers: tuple[Callable[[Column], Column], ...] = IDENTIFIERS) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce("text", F.lit(""))
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("points"), F.regexp_replace(text, SPACE, "").alias("norm"))
    ident = next((f for f in identifiers if clashes(norm, f).isEmpty()), None)
    if ident is None:
        raise ValueError("each of the identifiers stands for two chunks")
    rows = stored(norm.select("doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), ident).alias("recipe")), "recipes")
    # A row with a doc_id comes before one without.
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "points", F.bitwise_not(F.col("doc_id")).alias("first")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    stays = checkpointed(groups.select("recipe", F.bitwise_not(F.col("best.first")).alias("keep_id"), "group_size"))
    joined = dealt_join(rows, stays, ["recipe"], "group_size", rows.count())
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
