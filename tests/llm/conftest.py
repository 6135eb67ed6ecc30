import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty, short, long and repeated texts, and extra columns that clash with inner names."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"id": F.lit("x"), "n": F.lit(1), "toxic": F.lit(None).cast("int"), "score2": F.lit(0.5), "set": F.array(F.lit(1))})

    return make
