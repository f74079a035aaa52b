"""The small given tables, as the tests use them."""

SMALL = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
