"""Where rows come from: tables under a snapshot log, plain files of any format that Spark reads, and rows in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, kind: str, schema: StructType | str, *paths: str, **options: str) -> DataFrame:
    """parquet, orc, csv, json, text: always with a schema, never inferred."""
    return spark.read.format(kind).schema(schema).options(**options).load(list(paths))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_iceberg(spark: SparkSession, name: str, snapshot: int | None = None) -> DataFrame:
    """A table of a configured Iceberg catalog, at a snapshot if one is given; needs Iceberg's runtime on the class path."""
    reader = spark.read.format("iceberg")
    return (reader.option("snapshot-id", str(snapshot)) if snapshot is not None else reader).load(name)


def rows(spark: SparkSession, data: list, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(data, schema)
