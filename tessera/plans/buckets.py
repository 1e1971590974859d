"""Bucketed files without a catalog entry: written as a table that is dropped again, and read as a relation that knows its buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessera.plans.planio import java
from tessera.plans.splice import scala_seq


def write_buckets(df: DataFrame, path: str, n: int, keys: tuple[str, ...]) -> None:
    """One file a bucket, sorted by the keys."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    try:
        df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_buckets(files: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """files, a plain scan of what write_buckets() wrote, as a scan that is partitioned by keys already."""
    spark, jvm = files.sparkSession, files.sparkSession._jvm
    relation = files._jdf.queryExecution().analyzed().relation()
    columns = scala_seq(spark, list(keys))
    spec = java(jvm, "org.apache.spark.sql.catalyst.catalog.BucketSpec")(n, columns, columns)
    bucketed = java(jvm, "org.apache.spark.sql.execution.datasources.HadoopFsRelation")(relation.location(), relation.partitionSchema(), relation.dataSchema(), java(jvm, "scala.Option").apply(spec), relation.fileFormat(), relation.options(), relation.sparkSession())
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(bucketed), spark)
