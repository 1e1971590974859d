"""Builds pieces of derived state: one Spark job each over the columns needed, into a Parquet side table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampType

from tessera.functions import hll_state, terms_sql
from tessera.kinds import Bitmap, Cube, FilterSet, Index, JoinHash, MaterializedResult, Projection, TextIndex, VectorIndex
from tessera.model import WHOLE, AggFunc, Aggregate, Filter, Matches, Measure, Metric, Plan, Scope
from tessera.plans.buckets import write_buckets
from tessera.rule import Derived
from tessera.sources.tablelog import Table, bare

#: At most so many distinct values for a bitmap; rows up to which a probe admits rows and not files.
BITMAP_VALUES, ADMITTED_ROWS = 64, 10_000
SHARD_BYTES = 128 << 20
#: What a row adds to an index at most, about: paths are a dictionary.
ENTRY_BYTES = 16
#: Up to so many paths are broadcast while an index is built.
NAMED_FILES = 50_000


def _digest(*parts: object) -> str:
    return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()[:16]


def piece_id(kind: str, table: Table, *what: object) -> str:
    """Deterministic, and different for different kinds on one column."""
    return f"{kind}:{table.id}:" + ":".join(map(str, what))


def _side_path(table: Table, id: str, policy: str) -> str:
    return f"{table.root}/_derived/{_digest(id, policy)}/{table.current}-{_digest(id, policy, table.current)}"


def _side(table: Table, df: DataFrame, id: str, policy: str) -> tuple[str, int]:
    path = _side_path(table, id, policy)
    df.write.mode("overwrite").parquet(path)
    return path, _size(table, path, df.schema)


def _size(table: Table, path: str, schema: StructType) -> int:
    table.know_side(path, schema)
    return sum(n for p, n in table.store.list(path) if p.endswith(".parquet"))


def equality_probe(table: Table, path: str, column: str, rows: bool) -> Callable[[frozenset], dict[str, Scope]]:
    """Looks values up in a side table (value, file[, row]); the side table is sorted by value, so most of it is skipped.

    The values come as SQL literals and are compared in the column's type.
    """
    kind = table.schema[column].dataType.simpleString()
    known: dict[frozenset, dict[str, Scope]] = {}

    def probe(values: frozenset) -> dict[str, Scope]:
        if values not in known:
            wanted = F.expr(f"value IN ({', '.join(f'CAST({v} AS {kind})' for v in sorted(map(str, values)))})")
            hit = table.side(path).where(wanted)
            found: dict[str, Scope] = {}
            if rows:
                per_file = hit.groupBy("file").agg(F.sum(F.size("rows")).alias("n")).collect()
                if sum(r["n"] for r in per_file) <= ADMITTED_ROWS:
                    for r in hit.groupBy("file").agg(F.flatten(F.collect_list("rows")).alias("rows")).collect():
                        found[r["file"]] = Scope({0: frozenset(r["rows"])})
                else:
                    found = {r["file"]: WHOLE for r in per_file}
            else:
                hit = hit.select("file")  # a row for each file and value: of one value there is nothing to bring together
                found = {r[0]: WHOLE for r in (hit.distinct() if len(values) > 1 else hit).collect()}
            known[values] = found
        return known[values]

    return probe


def term_probe(table: Table, path: str) -> Callable[[str], frozenset[str]]:
    known: dict[str, frozenset[str]] = {}

    def many(terms: frozenset[str]) -> None:
        """All terms that aren't known yet, in one job."""
        if new := sorted(terms - known.keys()):
            found: dict[str, set[str]] = {x: set() for x in new}
            for r in table.side(path).where(F.col("term").isin(new)).select("term", "file").collect():
                found[r["term"]].add(r["file"])
            known.update({x: frozenset(files) for x, files in found.items()})

    def probe(term: str) -> frozenset[str]:
        many(frozenset((term,)))
        return known[term]

    probe.many = many
    return probe


def _dealt(table: Table, df: DataFrame, key: str, bytes: float) -> DataFrame:
    n = int(bytes / SHARD_BYTES) + 1
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def build_index(table: Table, column: str, policy: str = "") -> Derived:
    """Which files hold each value: one column is read, nulls are skipped, each value stands once for a file.

    Paths are shuffled as hashes and put back at the end; of two files with one hash both are named, which costs a read and no row."""
    id = piece_id("idx", table, column)
    df = table.located().where(F.col(column).isNotNull())
    short = len(table.live()) <= NAMED_FILES
    df = df.select(F.col(column).alias("value"), (F.xxhash64("_file") if short else F.col("_file")).alias("file")).distinct()
    df = _dealt(table, df, "value", sum(f.rows for f in table.live()) * ENTRY_BYTES)
    if short:
        names = table.spark.createDataFrame([(bare(f.path),) for f in table.live()], "name string")
        df = df.join(F.broadcast(names.withColumn("file", F.xxhash64("name"))), "file").select("value", F.col("name").alias("file"))
    path, size = _side(table, df, id, policy)
    return Derived(id, table.name, table.current, Index(column, equality_probe(table, path, column, False), size, path), policy)


def build_bitmap(table: Table, column: str, policy: str = "") -> Derived:
    """Which rows of each file hold each value, in runs of at most 65536 rows so that no row list grows without bound."""
    id = piece_id("bmp", table, column)
    df = table.located().where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    df = df.groupBy("value", "file", F.shiftright("row", 16).alias("run")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    path, size = _side(table, _dealt(table, df, "value", sum(f.rows for f in table.live()) * ENTRY_BYTES), id, policy)
    return Derived(id, table.name, table.current, Bitmap(column, equality_probe(table, path, column, True), size, path), policy)


def build_equality(table: Table, column: str, policy: str = "") -> Derived:
    """A bitmap for few values in files of several row groups, else an index."""
    several = any(f.groups > 1 for f in table.live())
    few = several and table.read().select(column).distinct().limit(BITMAP_VALUES + 1).count() <= BITMAP_VALUES
    return (build_bitmap if few else build_index)(table, column, policy)


class NoAdvantage(ValueError):
    """The piece would leave nothing out."""


def build_filter_set(table: Table, filter: Filter, condition: str, deterministic: bool = True, policy: str = "") -> Derived:
    """The rows that a conjunct leaves of each file; refused for volatile conditions and if all rows pass."""
    if not deterministic:
        raise NoAdvantage("the condition is volatile")
    id = piece_id("fset", table, _digest(filter.text))
    hit = table.located().where(condition).select(F.col("_file").alias("file"), F.col("_row").alias("row"))
    rows = hit.groupBy("file", F.shiftright("row", 16).alias("run")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    path, size = _side(table, rows, id, policy)
    files = filter_files(table, path)
    passed = table.spark.read.parquet(path).agg(F.sum(F.size("rows"))).first()[0] or 0
    if passed == sum(f.rows for f in table.live()):
        table.store.delete(path)
        raise NoAdvantage("all rows pass")
    return Derived(id, table.name, table.current, FilterSet(filter, files, size, path), policy)


def filter_files(table: Table, path: str) -> dict[str, Scope]:
    stored = table.side(path)
    per_file = stored.groupBy("file").agg(F.sum(F.size("rows")).alias("n")).collect()
    if sum(r["n"] for r in per_file) > ADMITTED_ROWS:
        return {r["file"]: WHOLE for r in per_file}
    return {r["file"]: Scope({0: frozenset(r["rows"])}) for r in stored.groupBy("file").agg(F.flatten(F.collect_list("rows")).alias("rows")).collect()}


def build_text_index(table: Table, column: str, policy: str = "", ask: Matches | None = None) -> Derived:
    """Which files hold each term of a string column; refused if each term of the ask is in every file."""
    if table.schema[column].dataType.simpleString() != "string":
        raise ValueError("a text index is for string columns")
    id = piece_id("txt", table, column)
    df = table.located().select(F.explode(F.array_distinct(F.expr(terms_sql(f"`{column}`")))).alias("term"), F.col("_file").alias("file")).distinct()
    path, size = _side(table, _dealt(table, df, "term", table.bytes), id, policy)
    probe = term_probe(table, path)
    if ask and ask.terms and min(len(probe(t)) for t in ask.terms) >= len(table.live()):
        table.store.delete(path)
        raise NoAdvantage("every term is in every file")
    return Derived(id, table.name, table.current, TextIndex(column, probe, size, path), policy)


def build_materialized(table: Table, plan: Plan, condition: str | None, policy: str = "") -> Derived:
    """The rows of an exact scan, with the columns that its filters need."""
    id = piece_id("mat", table, _digest(sorted(plan.projected), sorted(f.text for f in plan.filters)))
    # of a scan without columns the rows count all the same
    columns = sorted(plan.projected | {c for f in plan.filters for c in f.columns}) or [min(table.schema.names, key=lambda c: table.totals().columns.get(c, 0))]
    df = table.read()
    path, size = _side(table, (df.where(condition) if condition else df).select(*columns), id, policy)
    return Derived(id, table.name, table.current, MaterializedResult(path, size, plan), policy)


def build_projection(table: Table, columns: frozenset[str], policy: str = "") -> Derived:
    id = piece_id("proj", table, _digest(*sorted(columns)))
    path, size = _side(table, table.read().select(*sorted(columns)), id, policy)
    return Derived(id, table.name, table.current, Projection(path, size, frozenset(columns)), policy)


def partial(m: Measure) -> Column:
    c = F.col(m.column) if m.column else F.lit(1)
    made = {AggFunc.COUNT: F.count, AggFunc.SUM: F.sum, AggFunc.MIN: F.min, AggFunc.MAX: F.max}
    return (hll_state(m.column) if m.func is AggFunc.APPROX_DISTINCT else made[m.func](c)).alias(m.name)


def rolled_up(m: Measure) -> Column:
    """A measure from stored partials. Counts of nothing are 0, not null."""
    p = lambda func: F.col(f"`{Measure(func, m.column).name}`")
    match m.func:
        case AggFunc.COUNT:
            return F.coalesce(F.sum(p(AggFunc.COUNT)), F.lit(0))
        case AggFunc.SUM:
            return F.sum(p(AggFunc.SUM))
        case AggFunc.MIN:
            return F.min(p(AggFunc.MIN))
        case AggFunc.MAX:
            return F.max(p(AggFunc.MAX))
        case AggFunc.AVG:
            return F.sum(p(AggFunc.SUM)) / F.sum(p(AggFunc.COUNT))
        case _:
            return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(p(AggFunc.APPROX_DISTINCT))), F.lit(0))


def build_cube(table: Table, aggregate: Aggregate, filters: list[tuple[Filter, str]] = (), policy: str = "", keys: frozenset[str] | None = None) -> Derived:
    """Partials by keys (the ask's, unless more are given), of the rows that filters leave; exact distinct counts become sketches."""
    keys = frozenset(aggregate.keys) if keys is None else keys
    stored = frozenset(p for m in aggregate.measures for p in m.partials())
    id = piece_id("cube", table, _digest(sorted(keys), sorted(m.name for m in stored), sorted(f.text for f, _ in filters)))
    df = reduce(lambda d, f: d.where(f[1]), filters, table.read())
    parts = [partial(m) for m in sorted(stored, key=lambda m: m.name)]
    df = df.groupBy(*sorted(keys)).agg(*parts) if keys else df.agg(*parts)
    path, size = _side(table, df, id, policy)
    return Derived(id, table.name, table.current, Cube(path, size, keys, stored, frozenset(f for f, _ in filters)), policy)


def build_vector_index(table: Table, column: str, metric: Metric, dimension: int, policy: str = "", columns: frozenset[str] | None = None) -> Derived:
    """A flat copy of a vector column beside the columns named (all of fixed width, if none are): a search reads neither texts nor other
    vectors and needs no check of dimensions. Vectors of another dimension are refused, as searching them would be."""
    bad = table.read().where(F.col(column).isNotNull() & (F.size(column) != dimension)).limit(1).count()
    if bad:
        raise ValueError(f"{column} has vectors of other dimensions than {dimension}")
    narrow = frozenset(f.name for f in table.schema if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType)))
    columns = (narrow if columns is None else columns) | {column}
    id = piece_id("vec", table, column, metric.value, dimension)
    path, size = _side(table, table.read().select(*[c for c in table.schema.names if c in columns]), id, policy)
    return Derived(id, table.name, table.current, VectorIndex(path, size, column, metric, dimension, frozenset(columns)), policy)


def build_join_hash(table: Table, keys: tuple[str, ...], columns: frozenset[str], policy: str = "") -> Derived:
    """The build side of a join in buckets of its keys of about SHARD_BYTES, sorted within: a join shuffles the other side alone."""
    keys = tuple(sorted(keys))
    id = piece_id("jh", table, _digest(keys, sorted(columns)))
    n = int(table.bytes // SHARD_BYTES) + 1
    path = _side_path(table, id, policy)
    df = table.read().select(*sorted(columns | set(keys)))
    write_buckets(df, path, n, keys)
    return Derived(id, table.name, table.current, JoinHash(path, _size(table, path, df.schema), keys, frozenset(columns | set(keys)), n), policy)


def estimate_overlap(table: Table, column: str) -> float | None:
    """How much of one file's values another file shares: files at three places and each one's neighbour, every pair of them both ways."""
    files = table.live()
    if len(files) < 2:
        return None
    chosen = sorted({i for p in (0, len(files) // 2, len(files) - 2) for i in (p, min(p + 1, len(files) - 1))})
    names = [bare(files[i].path) for i in chosen]
    values = table.located(names).where(F.col(column).isNotNull()).select(F.col("_file").alias("file"), F.col(column).alias("v")).distinct()
    # a value is one row with the files (six at most) that hold it, so no file is joined to another
    held = values.groupBy("v").agg(F.collect_set("file").alias("files")).groupBy("files").count().collect()
    own = {f: sum(r["count"] for r in held if f in r["files"]) for f in names}
    shares = [sum(r["count"] for r in held if a in r["files"] and b in r["files"]) / own[a] for a in names for b in names if a != b and own[a]]
    return sum(shares) / len(shares) if shares else None
