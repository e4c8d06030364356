"""Reading the engine's parquet tables by name."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, by Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
