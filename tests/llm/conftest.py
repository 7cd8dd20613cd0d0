import duckdb
import pytest


@pytest.fixture(scope="session")
def texts(sf_dir):
    """(doc_id, text) of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must bear: nulls, empty and white texts, repeats, clashing columns."""
    data = [
        (1, "one two three four five six seven eight nine ten eleven", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven", "a", 1),
        (2, None, "a", 2),
        (3, "", "b", 3),
        (4, " \n\t ", "b", 4),
        (None, "word", None, None),
        (5, "x" * 3000 + " " + "y z " * 4000, "c", 5),
        (6, "ünï🙂 中文 don't", "c", 6),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, shard string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
