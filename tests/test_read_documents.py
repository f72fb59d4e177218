"""Many small documents are sent on together."""

from pyspark.sql import functions as F

from sedgeline.operators import trees

ONE = '{"version":1,"blocks":[{"type":"divider"},{"type":"list","items":[[{"type":"divider"}]]}]}'


def test_documents_share_batches(spark):
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("article_id"), F.when(F.col("id") % 4 == 0, None).otherwise(ONE).alias("document"))
    batches = trees.read_documents(docs).mapInArrow(lambda bs: (b.slice(0, 1).select(["article_id"]) for b in bs), "article_id long")
    assert trees.read_documents(docs).count() == 3000 * 4
    assert batches.count() < 100
