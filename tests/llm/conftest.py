import pytest


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(k, v) for k, v in rows], "doc_id bigint, text string")
        if extra:
            from pyspark.sql import functions as F

            for c in ("id", "fp", "h1", "words", "bucket", "u", "__n", "path", "block", "part"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
