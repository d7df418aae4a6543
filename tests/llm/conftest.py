import pytest

from quillspark.session import get_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """Documents from (id, text) or (id, text, lang, source) tuples, with a column whose name clashes with results."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            df = df.selectExpr("*", "1 as size", "'x' as shard", "'y' as score", "0 as rows", "'k' as kept", "'t' as topic", "'c' as comp")
        return df

    return build
