import pytest
from pyspark.sql import functions as F

CLASHING = ("fp", "w", "uid", "_id", "length", "score", "held", "label", "shard", "n_words", "m", "cell")


@pytest.fixture()
def frame(spark):
    """Documents with further columns whose names clash with internal ones."""
    def make(rows, partitions=3):
        df = spark.createDataFrame(list(rows), "doc_id long, text string").repartition(partitions)
        return df.withColumns({c: F.lit("x") for c in CLASHING})
    return make
