from pyspark.sql import functions as F

from occugrid.llm import ordinal


def test_about_8000_rows_are_drawn(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    texts, _ = ordinal.labelled_sample(rows, rows.select("doc_id", F.lit(0).alias("toxic")))
    assert 7_700 < len(texts) < 8_300
