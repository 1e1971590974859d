"""Puts another DataFrame in the place of a node of an analyzed plan, under the node's own expression ids."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.plans.planio import Path, java, seq, simple


def scala_seq(spark: SparkSession, items: list):
    jvm = spark._jvm
    buffer = java(jvm, "java.util.ArrayList")()
    for x in items:
        buffer.add(x)
    return java(jvm, "scala.jdk.javaapi.CollectionConverters").asScala(buffer).toSeq()


@lru_cache(maxsize=4)
def _nothing(jvm):
    return java(jvm, "scala.jdk.javaapi.CollectionConverters").asScala(java(jvm, "java.util.ArrayList")()).toSeq()


def _named(spark: SparkSession, df: DataFrame, output: list) -> object:
    """df's plan under a projection that gives its columns, by place, the names and expression ids of output."""
    jvm = spark._jvm
    plan = df._jdf.queryExecution().analyzed()
    alias, option = java(jvm, "org.apache.spark.sql.catalyst.expressions.Alias"), java(jvm, "scala.Option")
    aliases = []
    for mine, theirs in zip(seq(plan.output()), output):
        aliases.append(alias(mine, theirs.name(), theirs.exprId(), theirs.qualifier(), option.apply(theirs.metadata()), _nothing(jvm)))
    return java(jvm, "org.apache.spark.sql.catalyst.plans.logical.Project")(scala_seq(spark, aliases), plan)


def _rebuilt(spark: SparkSession, node, path: Path, put):
    if not path:
        return put
    children = seq(node.children())
    children[path[0]] = _rebuilt(spark, children[path[0]], path[1:], put)
    return node.withNewChildren(scala_seq(spark, children))


def spliced(df: DataFrame, swaps: list[tuple[Path, DataFrame]]) -> DataFrame:
    """df with the nodes at some paths of its analyzed plan replaced. Each replacement has the node's columns in the node's order."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    for path, other in swaps:
        node = plan
        for i in path:
            node = node.children().apply(i)
        plan = _rebuilt(spark, plan, path, _named(spark, other, seq(node.output())))
    return frame(spark, plan)


def frame(spark: SparkSession, plan) -> DataFrame:
    """A DataFrame of a logical plan; a command runs now, as with spark.sql."""
    return DataFrame(java(spark._jvm, "org.apache.spark.sql.classic.Dataset").ofRows(spark._jsparkSession, plan), spark)


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns of a schema, in that order and of those types; columns that df lacks are null (nothing above reads them)."""
    have = {c.lower(): c for c in df.columns}
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return df.selectExpr(*(f"CAST({quoted(have[f.name.lower()]) if f.name.lower() in have else 'NULL'} AS {f.dataType.simpleString()}) AS {quoted(f.name)}" for f in schema))


__all__ = ["frame", "scala_seq", "shaped", "simple", "spliced"]
