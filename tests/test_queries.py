"""Every query against its SQL on the small tables."""

import os
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, int) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([names[i] for i in order]), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name])
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chunk_letters_has_a_row_for_each_document(spark, tmp_path):
    texts = [(1, "One. Two!\nChapter 3"), (2, None), (3, ""), (4, " \n "), (5, "."), (6, "?! ...\n!"), (7, "a b."), (7, "c"), (None, "d é 4"), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "web", len(x or "")) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, want = catalog.queries()["document_chunk_letters"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["document_chunk_letters"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(("name", "fields"), [("failed_comparisons", {"doc_id", "idx", "passed", "score", "failure_type"}), ("rescored_report", {"unheard", "passed"})])
def test_comparisons_make_only_the_fields_they_use(spark, name, fields):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().analyzed().toString()
    made = re.search(r"MapInArrow run\(.*\)#\d+, \[(.*?)\]", plan)[1]
    assert {f.split("#")[0].strip() for f in made.split(",")} == fields
