"""The driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks, before work that takes long for each row: a file of few bytes is read by few tasks, however many rows it has."""
    return df.repartition(tasks(df.sparkSession))


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle has; a number that is given is not made smaller by the bytes there are."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
