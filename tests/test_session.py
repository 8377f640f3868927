"""Rows of few row groups reach all cores, tables of many splits are left alone."""

from pyspark.sql import functions as F

from veridoc.session import Tables, spread


def filled(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_one_row_group_reaches_all_cores(spark):
    docs = Tables(spark, "/root/testdata/sf0.1").documents
    assert filled(docs) == 1
    assert filled(spread(docs)) == spark.sparkContext.defaultParallelism
    assert spread(docs).count() == docs.count()


def test_many_splits_stay(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "many")
    spark.range(1000).repartition(cores).write.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a split per file
    try:
        many = spark.read.parquet(path)
        assert "Exchange" not in spread(many)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.range(0).write.parquet(path)
    assert spread(spark.read.parquet(path)).count() == 0
