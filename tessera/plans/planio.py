"""Reads Catalyst's plans: what a query asks of each of our tables. All access to Spark's internals is in here and in splice.py."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache
from decimal import Decimal
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame

from tessera.functions import Called
from tessera.model import AggFunc, Aggregate, Eq, Filter, JoinAsk, Matches, Measure, Metric, Nearest, Opaque, Predicate
from tessera.sources.tablelog import SHAPE_OPTION, TABLE_OPTION, Table

Path = tuple[int, ...]


@lru_cache(maxsize=256)
def java(jvm, name: str):
    """A class of the JVM; without this, each part of its name is a trip there."""
    for part in name.split("."):
        jvm = getattr(jvm, part)
    return jvm


def seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def simple(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def walk(node, path: Path = ()):
    yield path, node
    for i, c in enumerate(seq(node.children())):
        yield from walk(c, (*path, i))


def at(node, path: Path):
    for i in path:
        node = node.children().apply(i)
    return node


@dataclass
class Leaf:
    """A scan of one of our tables in a plan."""

    table: Table
    path: Path
    ids: dict[int, str]  # expression id to column
    predicates: list[Predicate] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    needed: frozenset[str] = frozenset()
    deterministic: bool = True


def _option(node, name: str) -> str | None:
    """An option that a file scan was made with; None for other nodes."""
    if simple(node) != "LogicalRelation" or simple(node.relation()) != "HadoopFsRelation":
        return None
    found = node.relation().options().get(name)
    return found.get() if found.isDefined() else None


def _leaf(node, path: Path, tables: list[Table]) -> Leaf | None:
    handle = _option(node, TABLE_OPTION)
    table = next((t for t in tables if t.handle == handle), None) if handle else None
    return Leaf(table, path, {a.exprId().id(): a.name() for a in seq(node.output())}) if table else None


def holds_shapes(plan) -> bool:
    """Whether some scan of the plan still is a shape. Scans within subquery expressions are not looked at."""
    return any(_option(n, SHAPE_OPTION) for _, n in walk(plan))


def out_of_reach(plan) -> bool:
    """Whether scans lie where walk() doesn't come: within subquery expressions."""
    return plan.treeString().count("Relation [") != sum(simple(n) == "LogicalRelation" for _, n in walk(plan))


def leaves(plan, tables: list[Table]) -> list[Leaf]:
    return [x for path, node in walk(plan) if (x := _leaf(node, path, tables))]


def conjuncts(e) -> list:
    return [*conjuncts(e.left()), *conjuncts(e.right())] if simple(e) == "And" else [e]


def literal(e) -> Any:
    """A literal's value in a comparable type; raises ValueError for anything else."""
    while simple(e) == "Cast" and simple(e.child()) == "Literal":
        raise ValueError("a cast that isn't folded")
    if simple(e) != "Literal" or e.value() is None:
        raise ValueError("no literal")
    kind, v = e.dataType().typeName(), e.value()
    if kind.startswith("decimal"):
        return Decimal(v.toString())
    if kind == "date":
        return date.fromordinal(date(1970, 1, 1).toordinal() + v)
    if kind.startswith("timestamp"):
        return ("timestamp", v)
    if kind in ("string",) or kind.startswith("varchar"):
        return v.toString() if hasattr(v, "toString") else str(v)
    if isinstance(v, (bool, int, float)):
        return v
    raise ValueError(kind)


_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_OPS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}


def references(e, ids: dict[int, str]) -> frozenset[str]:
    it, out = e.references().toSeq(), set()
    for a in seq(it):
        out.add(ids.get(a.exprId().id(), "?" + a.name()))
    return frozenset(out)


_PLAIN_NAME = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_of(e, ids: dict[int, str]) -> str:
    """The expression's text with bare column names."""
    text = e.sql()
    for a in seq(e.references().toSeq()):
        name = ids.get(a.exprId().id(), a.name())
        text = text.replace(a.sql(), name if _PLAIN_NAME.fullmatch(name) else quoted(name))
    return text


def _attribute(e, ids: dict[int, str]) -> str | None:
    return ids.get(e.exprId().id()) if simple(e) == "AttributeReference" else None


def filter_of(e, ids: dict[int, str]) -> Filter:
    """The exact form of a conjunct."""
    kind = simple(e)
    if kind == "Not" and simple(e.child()) == "EqualTo":
        inner = filter_of(e.child(), ids)
        if inner.op == "=":
            return Filter(inner.text.replace(" = ", " <> ", 1), inner.columns, "<>", inner.value)
    if kind in _OPS:
        for a, b, flip in ((e.left(), e.right(), False), (e.right(), e.left(), True)):
            column = _attribute(a, ids)
            if column is not None and simple(b) == "Literal" and b.value() is not None:
                op = _FLIP[_OPS[kind]] if flip else _OPS[kind]
                text = f"{column} {op} {b.dataType().simpleString()}:{b.sql()}"
                try:
                    return Filter(text, frozenset((column,)), op, literal(b))
                except ValueError:
                    return Filter(text, frozenset((column,)))
    return Filter(sql_of(e, ids), references(e, ids))


def _sought(e) -> frozenset[str] | None:
    """The terms that a folded text_matches looks for: the literal of an array_except against the terms of a column."""
    if simple(e) == "ArrayExcept" and simple(e.left()) == "Literal" and simple(e.right()) == "ArrayRemove" and e.left().value() is not None:
        found = e.left().value().array()
        return frozenset(found[i].toString() for i in range(len(found)))
    return next((t for c in seq(e.children()) if (t := _sought(c)) is not None), None)


def lasting(e) -> bool:
    """Whether a condition means the same rows whenever it is asked: it is deterministic and holds no subquery."""
    return e.deterministic() and not any(simple(x) in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "DynamicPruningSubquery") for _, x in walk(e))


def predicate_of(e, ids: dict[int, str]) -> Predicate | None:
    """The probeable form: equalities (also IN, and OR of equalities on one column), text matches, or nothing that an index can be asked."""
    kind = simple(e)
    try:
        if kind in ("EqualTo", "EqualNullSafe"):
            for a, b in ((e.left(), e.right()), (e.right(), e.left())):
                if (c := _attribute(a, ids)) and simple(b) == "Literal" and b.value() is not None:
                    literal(b)
                    return Eq(c, frozenset((b.sql(),)))
        if kind == "In" and (c := _attribute(e.value(), ids)):
            values = seq(e.list())
            for v in values:
                literal(v)
            return Eq(c, frozenset(v.sql() for v in values))
        if kind == "Or":
            a, b = predicate_of(e.left(), ids), predicate_of(e.right(), ids)
            if isinstance(a, Eq) and isinstance(b, Eq) and a.column == b.column:
                return Eq(a.column, a.values | b.values)
    except ValueError:
        pass
    columns = references(e, ids)
    if len(columns) == 1 and (terms := _sought(e)):
        return Matches(next(iter(columns)), terms)
    return Opaque(columns) if columns else None


def asks(df: DataFrame, tables: list[Table]) -> list[Leaf]:
    """The scans of the analyzed plan, with predicates and needed columns from the optimized one, where filters have come down to their scans."""
    execution = df._jdf.queryExecution()
    found = leaves(execution.analyzed(), tables)
    optimized = execution.optimizedPlan()
    for path, node in walk(optimized):
        low = _leaf(node, path, tables)
        if low is None:
            continue
        leaf = next((x for x in found if x.ids.keys() & low.ids.keys()), None)
        if leaf is None:
            continue
        needed: frozenset[str] | None = None
        tested: set[str] = set()  # columns that only have to be there
        up = path
        while up:
            up = up[:-1]
            parent = at(optimized, up)
            if simple(parent) == "Filter":
                leaf.deterministic &= lasting(parent.condition())
                for c in conjuncts(parent.condition()):
                    if simple(c) == "IsNotNull" and simple(c.child()) == "AttributeReference":
                        tested |= references(c, leaf.ids)
                        continue
                    leaf.filters.append(filter_of(c, leaf.ids))
                    if p := predicate_of(c, leaf.ids):
                        leaf.predicates.append(p)
                continue
            if simple(parent) == "Project":
                needed = frozenset(n for e in seq(parent.projectList()) for n in references(e, leaf.ids) if n[0] != "?")
            break
        if not needed:
            needed = frozenset(leaf.ids.values()) if path == () or simple(at(optimized, up)) not in ("Project", "Aggregate") else frozenset(n for n in references(at(optimized, up), leaf.ids) if n[0] != "?")
        leaf.needed = needed | frozenset(c for c in tested if c[0] != "?" and not any(c in f.columns for f in leaf.filters))
    return found


# --- shapes -----------------------------------------------------------------------------------------------------------

_THROUGH = ("SubqueryAlias", "View", "Filter", "Project")


def _passes(node) -> bool:
    """Whether a node leaves rows and expression ids of its child as they are, filters aside."""
    kind = simple(node)
    if kind == "Project":
        return all(simple(e) == "AttributeReference" for e in seq(node.projectList()))
    return kind in ("SubqueryAlias", "View", "Filter")


def _folded(node):
    """A filter with its constants folded, as the optimizer would have it."""
    rule = lambda name: java(SparkContext._active_spark_context._jvm, f"org.apache.spark.sql.catalyst.optimizer.{name}")
    return rule("UnwrapCastInBinaryComparison").apply(rule("ConstantFolding").apply(node))


def _below(plan, path: Path) -> tuple[Path, list]:
    """The node under pass-through nodes below path, and the conjuncts met on the way."""
    met = []
    path = (*path, 0)
    node = at(plan, path)
    while _passes(node):
        if simple(node) == "Filter":
            folded = _folded(node)
            met += conjuncts((folded if simple(folded) == "Filter" else node).condition())
        path = (*path, 0)
        node = at(plan, path)
    return path, met


_MEASURES = {"Sum": AggFunc.SUM, "Min": AggFunc.MIN, "Max": AggFunc.MAX, "Average": AggFunc.AVG, "HyperLogLogPlusPlus": AggFunc.APPROX_DISTINCT}


def _measure(e, ids: dict[int, str]) -> Measure | None:
    if simple(e) != "AggregateExpression" or e.filter().isDefined():
        return None
    f = e.aggregateFunction()
    kind = simple(f)
    args = seq(f.children())
    if kind == "Count":
        if len(args) == 1 and simple(args[0]) == "Literal" and args[0].value() is not None and not e.isDistinct():
            return Measure(AggFunc.COUNT)
        c = _attribute(args[0], ids) if len(args) == 1 else None
        return Measure(AggFunc.COUNT_DISTINCT if e.isDistinct() else AggFunc.COUNT, c) if c else None
    if kind in _MEASURES and not e.isDistinct():
        c = _attribute(args[0], ids)
        return Measure(_MEASURES[kind], c) if c else None
    return None


@dataclass
class AggregateAsk:
    path: Path
    leaf: Leaf
    aggregate: Aggregate
    filters: list[Filter]
    output: list[tuple[str, int, str | Measure]]  # name, expression id, key or measure


def aggregate_asks(plan, found: list[Leaf]) -> list[AggregateAsk]:
    """Aggregates over nothing but filters and a scan, by bare columns, of plain measures."""
    out = []
    for path, node in walk(plan):
        if simple(node) != "Aggregate":
            continue
        under, met = _below(plan, path)
        leaf = next((x for x in found if x.path == under), None)
        if leaf is None:
            continue
        keys = [_attribute(e, leaf.ids) for e in seq(node.groupingExpressions())]
        output: list[tuple[str, int, str | Measure]] = []
        for e in seq(node.aggregateExpressions()):
            inner = e.child() if simple(e) == "Alias" else e
            what = _attribute(inner, leaf.ids) or _measure(inner, leaf.ids)
            output.append((e.name(), e.exprId().id(), what))
        if None in keys or any(w is None or isinstance(w, str) and w not in keys for _, _, w in output):
            continue
        measures = tuple(dict.fromkeys(w for _, _, w in output if isinstance(w, Measure)))
        if not measures:
            continue
        filters = [filter_of(c, leaf.ids) for c in met]
        if all(lasting(c) for c in met):
            out.append(AggregateAsk(path, leaf, Aggregate(tuple(keys), measures), filters, output))
    return out


def nearest_ask(plan, found: list[Leaf], calls: list[Called]) -> tuple[Leaf, Nearest] | None:
    """Limit over Sort by a distance first, ascending, over projections, filters and a scan. No OFFSET."""
    for path, node in walk(plan):
        if simple(node) != "GlobalLimit" or simple(node.limitExpr()) != "Literal":
            continue
        under = (*path, 0)
        while simple(at(plan, under)) in ("LocalLimit", "Project", "SubqueryAlias"):
            under = (*under, 0)
        sort = at(plan, under)
        if simple(sort) != "Sort":
            continue
        first = sort.order().apply(0)
        scan, _ = under, None
        scan = (*under, 0)
        aliases: dict[int, Any] = {}
        while simple(at(plan, scan)) in _THROUGH:
            n = at(plan, scan)
            if simple(n) == "Project":
                aliases |= {e.exprId().id(): e.child() for e in seq(n.projectList()) if simple(e) == "Alias"}
            scan = (*scan, 0)
        leaf = next((x for x in found if x.path == scan), None)
        if leaf is None or first.direction().sql() != "ASC":
            continue
        e = first.child()
        if simple(e) == "AttributeReference":
            e = aliases.get(e.exprId().id(), e)
        columns, text = references(e, leaf.ids), e.sql()
        metric = Metric.COSINE if "sqrt(" in text.lower() else Metric.L2
        name = "cosine_distance" if metric is Metric.COSINE else "l2_distance"
        if "vectors of different dimensions" not in text or len(columns) != 1:
            continue
        column = next(iter(columns))
        size = next((c.size for c in calls if c.name == name and c.column == column and c.size), None)
        if size:
            return leaf, Nearest(column, metric, size, int(literal(node.limitExpr())))
    return None


def join_ask(plan, found: list[Leaf], needed: dict[Path, frozenset[str]]) -> tuple[Leaf, JoinAsk] | None:
    """The first inner or left equi-join, if a scan is its left input and its keys there are bare columns."""
    for path, node in walk(plan):
        if simple(node) != "Join":
            continue
        if node.joinType().sql() not in ("INNER", "LEFT OUTER") or node.condition().isEmpty():
            return None
        under, _ = _below(plan, path) if _passes(at(plan, (*path, 0))) else ((*path, 0), [])
        leaf = next((x for x in found if x.path == under), None)
        if leaf is None:
            return None
        keys = []
        for c in conjuncts(node.condition().get()):
            if simple(c) == "EqualTo":
                sides = [_attribute(x, leaf.ids) for x in (c.left(), c.right())]
                if sum(s is not None for s in sides) == 1:
                    keys.append(next(s for s in sides if s is not None))
        return (leaf, JoinAsk(tuple(sorted(keys)), needed.get(leaf.path, leaf.needed))) if keys else None
    return None


# --- what was read ----------------------------------------------------------------------------------------------------


@dataclass
class Scanned:
    """Files, their bytes, and rows out of the file scans of a query that has run."""

    files: int = 0
    bytes: int = 0
    rows: int = 0


def scanned(df: DataFrame) -> Scanned:
    """Of the metrics of the plan that df has run; scans that are used twice count once."""
    out, seen = Scanned(), set()

    def visit(node) -> None:
        kind = simple(node)
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return visit(node.plan())
        if kind in ("FileSourceScanExec", "BatchScanExec"):
            if node.id() not in seen:
                seen.add(node.id())
                for name in ("numFiles", "filesSize", "numOutputRows"):
                    metric = node.metrics().get(name)
                    if metric.isDefined():
                        place = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows"}[name]
                        setattr(out, place, getattr(out, place) + metric.get().value())
            return None
        for c in [*seq(node.children()), *seq(node.subqueries())]:
            visit(c)

    visit(df._jdf.queryExecution().executedPlan())
    return out
