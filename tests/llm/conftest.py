import pytest
from pyspark.sql import functions as F

from filespoor.session import Workspace


@pytest.fixture
def space(spark):
    return Workspace(spark, "llm-test")


@pytest.fixture
def frame(spark):
    """Documents with an extra column whose name the operators use themselves."""

    def make(rows, schema="doc_id long, text string, lang string, source string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("text_sha256", "h", "fp", "length", "n", "id", "row", "host", "content", "kept"):
            df = df.withColumn(name, F.lit("extra"))
        return df

    return make
