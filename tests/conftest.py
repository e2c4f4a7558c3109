import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int, n_words int"
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of every kind that operators must take: null texts, ids and labels, empty and very long texts, repeated rows."""
    a = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, a, "en"), (2, a, "en"), (3, a + " again", "en"), (3, a + " again", "en"), (4, None, "en"), (5, "", None), (6, " \n\t ", "de"), (7, "Ein kurzer Text über Füchse", "de"),
        (8, LONG, "la"), (9, "x", None), (None, a, "en"), (10, "shared line of words\nOwn line ten here\n  SHARED line of words ", "en"), (11, "shared LINE of words\nshort\nshort", "en"), (12, "12 34 !!", None),
    ]
    return spark.createDataFrame([(i, t, g, None, None if t is None else len(t), "x", 1, 2) for i, t, g in rows], DOC)
