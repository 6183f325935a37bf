"""The terms that one task holds do not grow with the text."""

from pyspark.sql import functions as F

from tabtext.operators import features as FE


def test_partitions_follow_the_text(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = lambda n, size: spark.range(n).select(F.col("id").alias("key"), F.repeat(F.lit("word "), size).alias("sentence"))
    small, large = docs(10, 5), docs(200, 200_000)
    assert FE.term_tasks(small, "sentence") == cores
    assert FE.term_tasks(small.limit(0), "sentence") == cores
    assert FE.term_tasks(large, "sentence") == max(cores, -(-200_000_000 // FE.TASK_TEXT))
    assert FE.doc_terms(large, by_key=True).rdd.getNumPartitions() == max(cores, -(-200_000_000 // FE.TASK_TEXT))
