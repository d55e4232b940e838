import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, repeated and very long texts, repeated ids, and clashing extra columns."""
    prose = " ".join(f"word{i % 97} and{i % 31} more{i}" for i in range(60))
    other = " ".join(f"thing{i % 89} or{i % 29} less{i}" for i in range(60))
    rows = [
        (1, prose, "en", "a", 10), (2, prose, "en", "a", 10), (3, prose + " tail", "en", "b", 10), (4, other, None, None, None),
        (4, other, None, None, None), (4, prose + " same id", "en", "a", 1), (None, prose, "en", "a", 1), (None, None, None, None, None),
        (5, None, "en", "a", None), (6, "", "en", "a", 0), (7, " \n\t ", "en", "b", 4), (8, "short", "en", "b", 5),
        (9, "é" * 500 + "\n" + "é" * 500, "fr", "b", 1001), (10, " ".join(f"w{i % 4001}" for i in range(60_000)), "en", "a", 1),
        (11, "again " * 700, "en", "a", 1), (12, "x" * 5000, "en", "a", 1),
    ]
    extra = ["id", "hash", "bucket", "kind", "kept", "comp", "n", "slot", "_text2", "tokens", "first", "score", "sentences"]
    extra += ["_hash", "_id", "_text", "_zip", "starts", "sizes", "row", "zip", "_i", "_slot", "_place", "place", "c0", "a.b", "x`y"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit("clash") for name in extra})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
