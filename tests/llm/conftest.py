import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flowlens.session import get_spark
    return get_spark("local[*]", shuffle_partitions=4, extra={"spark.driver.memory": "8g"})


@pytest.fixture(scope="session")
def documents():
    import duckdb
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


ODD = [(None, None), (9000, ""), (9001, "a"), (9001, "a"), (9002, "Ä  ß\tx\n"), (9003, " lead and trail "), (9004, "▁mark  two\n\nlines"),
       (9005, "word " * 3000), (9006, "x" * 20000)]


@pytest.fixture(scope="session")
def corpus(spark, documents):
    """The small table with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    rows = documents + ODD
    df = spark.createDataFrame([(i, t, "en", "s", i, i) for i, t in rows], "doc_id long, text string, lang string, source string, digest long, rows long")
    return rows, df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
