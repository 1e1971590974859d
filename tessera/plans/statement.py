"""SQL text by what its parsed plan is: a query, a command that writes a query's rows, EXPLAIN of a query, or any other command."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.planio import seq, simple, walk
from tessera.plans.splice import frame, scala_seq

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Commands whose last child is the query that they write.
WRITES = ("InsertIntoStatement", "CreateTableAsSelect", "ReplaceTableAsSelect", "InsertIntoDir")
#: Commands that name tables without reading rows of them.
_NAMES_ONLY = re.compile(r"(Create|Alter|Drop|Describe|Show|Set|Reset|Explain|Use|Uncache|Refresh|Comment)(?!.*AsSelect)")
#: Common nodes that are no commands, to save asking.
_PLAIN = frozenset("Aggregate Distinct Filter GlobalLimit Join LocalLimit LocalRelation OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedRelation UnresolvedWith".split())
_NAMED = re.compile(r"UnresolvedRelation \[([^\]]*)\]")


def _is_command(spark: SparkSession, node) -> bool:
    gateway, kind = spark.sparkContext._gateway, simple(node)
    if kind in _PLAIN:
        return False
    return kind in (*WRITES, "UnresolvedExecuteImmediate") or is_instance_of(gateway, node, _LOGICAL + "Command") or is_instance_of(gateway, node, _LOGICAL + "ParsedStatement")


@dataclass
class Statement:
    """A parsed text. kind: query, write, explain or other. query: the parsed query in it, none in other commands."""

    spark: SparkSession
    plan: object
    kind: str
    query: object | None = None

    def named(self) -> set[str]:
        """Relations that the text names, in lower case; those within subqueries too."""
        return {x.replace("`", "").lower() for x in _NAMED.findall(self.plan.treeString())}

    @property
    def reads(self) -> bool:
        return not _NAMES_ONLY.match(simple(self.plan))

    def frame(self) -> DataFrame:
        """The query, analyzed; nothing runs."""
        return frame(self.spark, self.query)

    def around(self, df: DataFrame) -> DataFrame:
        """What the statement does with its query, done once with df in the query's place."""
        if self.kind == "write":
            children = seq(self.plan.children())
            return frame(self.spark, self.plan.withNewChildren(scala_seq(self.spark, [*children[:-1], df._jdf.queryExecution().analyzed()])))
        if self.kind == "explain":
            text = df._jdf.queryExecution().explainString(self.plan.mode())
            return self.spark.createDataFrame([(text,)], "plan string")
        return df


def parsed(spark: SparkSession, text: str) -> Statement:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    commands = [n for _, n in walk(plan) if _is_command(spark, n)]
    if not commands:
        return Statement(spark, plan, "query", plan)
    if simple(plan) == "UnresolvedWith" and len(commands) == 1 and simple(plan.child()) in WRITES:
        # WITH ... INSERT is INSERT of WITH ...
        write = plan.child()
        children = seq(write.children())
        inner = plan.withNewChildren(scala_seq(spark, [children[-1]]))
        return Statement(spark, write.withNewChildren(scala_seq(spark, [*children[:-1], inner])), "write", inner)
    if len(commands) == 1 and simple(plan) in WRITES:
        return Statement(spark, plan, "write", seq(plan.children())[-1])
    if simple(plan) == "ExplainCommand":
        inner = plan.logicalPlan()
        if not any(_is_command(spark, n) for _, n in walk(inner)):
            return Statement(spark, plan, "explain", inner)
    return Statement(spark, plan, "other")
