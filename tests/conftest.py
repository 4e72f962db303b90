import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse")).config("spark.checkpoint.dir", str(folder / "checkpoints")).config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every edge case: nulls, empty, repeated rows and ids, ties, a long text and a column that clashes."""
    base = "The quick brown fox jumps over the lazy dog while nine gentle birds watch from the old garden wall today"
    near = base.replace("today", "now")
    rows = [
        (1, base, "en", "a", 1, 7), (2, base, "en", "a", 1, 7), (3, near, "en", "b", 1, 7), (3, near, "en", "b", 1, 7), (4, "Completely other words stand in this one and nothing of it is shared with any text", "en", None, None, None),
        (5, "", "en", "a", 0, 1), (6, None, None, "a", None, 1), (None, base, "en", "a", 1, 1), (7, "   \n\t ", "xx", "a", 1, 1), (8, "two words", "en", "a", 1, 1), (9, "two words", "de", "a", 1, 1),
        (10, "Der schnelle braune Fuchs springt über den faulen Hund und neun Vögel schauen von der alten Mauer zu", "de", "a", 1, 1), (11, "Licensed under the MIT License. " + "word " * 30_000, "en", "a", 1, 1), (12, "1234 5678 !!!", None, "a", 1, 1),
        (13, "日本語のテキスト🎉 émoji and  double  spaces", "ja", "a", 1, 1), (14, "same id first text entirely of its own kind here", "en", "a", 1, 1), (14, base + " and more", "en", "a", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
