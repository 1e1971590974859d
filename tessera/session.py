"""SQL over tables that gets faster with use: the rule decides for each scan, and a report says what was used, refused and read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cost import CLOUD, Budget, BudgetExceeded, Cost, Meter, PriceTable, StorageFacts
from tessera.functions import expand
from tessera.model import Aggregate, AggFunc, JoinAsk, Matches, Nearest, Plan, Query, Reject, Scope, Substitute, Use
from tessera.operators import rolled_up
from tessera.plans import planio
from tessera.plans.buckets import read_buckets
from tessera.plans.splice import shaped, spliced
from tessera.plans.statement import Statement, parsed
from tessera.rule import Composition, Derived, Registry
from tessera.sources.cache import ScanCache
from tessera.sources.tablelog import Table

APPROXIMATE, STALE = "tessera.approximate", "tessera.stale"


#: Sessions on one Spark session share its views, so one plans at a time.
_PLANNING = threading.RLock()


@dataclass
class ScanReport:
    """What became of one scan."""

    table: str
    snapshot: int
    files_total: int
    files_read: int
    bytes_total: int
    bytes_planned: int
    used: list[str] = field(default_factory=list)
    refused: dict[str, str] = field(default_factory=dict)
    also_scanned: int = 0
    missed: frozenset[str] = frozenset()
    approximate: bool = False
    substituted: bool = False
    row_scoped: bool = False
    projected: frozenset[str] = frozenset()
    columns: frozenset[str] = frozenset()
    plan: Plan | None = None
    conditions: dict[str, str] = field(default_factory=dict)
    deterministic: bool = True
    texts: tuple[Matches, ...] = ()
    equalities: frozenset[str] = frozenset()
    aggregate: Aggregate | None = None
    nearest: Nearest | None = None
    join: JoinAsk | None = None
    wait_s: float = 0.0
    usd: float = 0.0
    assumed: bool = False
    cached: bool = False


class Session:
    """Tables under names, one registry of derived state, and the settings of one reader."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, policy: str = "", budget: Budget | None = None, prices: PriceTable = CLOUD, facts: StorageFacts | None = None, observe=None, cache: ScanCache | None = None):
        self.spark, self.registry, self.policy, self.prices = spark, registry or Registry(), policy, prices
        self.tables: dict[str, Table] = {}
        # the outer meter sees what queries ask for, cached or not, and holds the budget; the inner one what goes to the store
        self.meter = Meter(budget, prices, spark.sparkContext.defaultParallelism)
        self.origin = Meter(None, prices, spark.sparkContext.defaultParallelism)
        self.facts, self.observe, self.cache = facts or StorageFacts(), observe, cache
        self.last_scan: list[ScanReport] = []
        self.last_read = planio.Scanned()
        self._lock = _PLANNING

    def attach(self, table: Table) -> Table:
        self.tables[table.name] = table
        return table

    def refresh(self, name: str) -> None:
        """Binds the name to all files that live now."""
        self.tables[name].read().createOrReplaceTempView(name)

    def _flag(self, name: str) -> bool:
        return str(self.spark.conf.get(name, "false")).lower() == "true"

    def unaided(self, text: str) -> DataFrame:
        """The plain answer, without any derived state."""
        with self._lock:
            for name in self.tables:
                self.refresh(name)
            return self.spark.sql(expand(text)[0])

    def query_of(self, leaf: planio.Leaf, **asks) -> Query:
        known = leaf.needed <= set(leaf.ids.values())
        plan = Plan(leaf.needed, frozenset(leaf.filters)) if known and leaf.deterministic else None
        return Query(leaf.table.name, leaf.table.current, leaf.needed | {c for f in leaf.filters for c in f.columns}, tuple(leaf.predicates), plan, self.policy, approximate=self._flag(APPROXIMATE), stale=self._flag(STALE), **asks)

    # one scan

    def _scoped(self, table: Table, scopes: dict[str, Scope]) -> tuple[DataFrame, bool]:
        """Files in their scopes: rows are picked by a semi-join on file and row, and only while the row list is short."""
        whole = [f for f, s in scopes.items() if s.whole]
        rows = [(f, r) for f, s in scopes.items() if not s.whole for g in s.groups.values() if g is not None for r in g]
        part = [f for f, s in scopes.items() if not s.whole]
        if not part or any(g is None for f in part for g in scopes[f].groups.values()):
            return table.read(scopes), False
        picked = table.spark.createDataFrame(rows, "file string, row bigint")
        some = table.located(part).join(F.broadcast(picked), (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row")), "left_semi").drop("_file", "_row")
        return (some.unionByName(table.read(whole)) if whole else some), True

    def _composed(self, leaf: planio.Leaf, c: Composition, report: ScanReport) -> DataFrame | None:
        table = leaf.table
        if c.substitute is not None:
            df = table.side(c.substitute.kind.path)
            report.substituted, report.used = True, c.used
            report.files_read, report.bytes_planned = len(c.also_scan), sum(table.files[f].bytes for f in c.also_scan) + c.substitute.kind.bytes
            report.also_scanned, report.missed = len(c.also_scan), c.missed
            if c.also_scan:
                added = table.read(c.also_scan)
                condition = report.conditions
                added = reduce(lambda d, s: d.where(s), condition.values(), added)
                df = df.unionByName(added.select(*df.columns))
            return df
        if c.files is None or not c.used:
            return None
        if self.cache is not None and all(x.whole for x in c.files.values()):
            df = self._cached(table, c.files, report)
        else:
            df, report.row_scoped = self._scoped(table, c.files)
        report.used, report.files_read = c.used, len(c.files)
        report.bytes_planned = sum(self._bytes(table, f, report.columns) for f in c.files)
        return df

    def _cached(self, table: Table, files, report: ScanReport) -> DataFrame:
        hits = self.cache.hits
        df = self.cache.read(table, files, report.columns) if files else table.read(())
        report.cached = self.cache.hits > hits
        return df

    def _bytes(self, table: Table, file: str, columns: frozenset[str]) -> int:
        f = table.files[file]
        return sum(f.columns.get(c, 0) for c in columns) if columns and f.columns else f.bytes

    def _report(self, leaf: planio.Leaf, query: Query) -> ScanReport:
        table, sums = leaf.table, leaf.table.totals()
        columns = query.projected
        r = ScanReport(table.name, table.current, sums.files, sums.files, sums.bytes, sums.of(columns), projected=leaf.needed, columns=columns, plan=query.plan, deterministic=leaf.deterministic)
        r.conditions = {f.text: self._condition(f) for f in leaf.filters}
        r.texts = tuple(p for p in leaf.predicates if isinstance(p, Matches))
        r.equalities = frozenset(p.column for p in leaf.predicates if type(p).__name__ == "Eq")
        r.refused = self._refusals(query, leaf)
        r.assumed = any(self.facts.resolve(f).assumed for f in sums.folders)
        return r

    @staticmethod
    def _condition(f) -> str:
        """A conjunct as SQL over bare columns."""
        if f.op and f.column:
            _, lit = f.text[len(f.column) + len(f.op) + 2 :].split(":", 1)
            return f"{f.column if f.column.isidentifier() else planio.quoted(f.column)} {f.op} {lit}"
        return f.text

    # whole queries

    @contextmanager
    def _bound(self, whole: bool) -> Iterator[None]:
        """The tables' names stand for their shapes, or for all files that live, while something is analyzed."""
        for name, t in self.tables.items():
            (t.read() if whole else t.shape()).createOrReplaceTempView(name)
        try:
            yield
        finally:
            for name in self.tables:
                self.spark.catalog.dropTempView(name)

    def _planned(self, s: Statement) -> tuple[DataFrame, bool]:
        """The query over the tables' shapes, whose scans are all swapped for files later. Where a scan lies within a subquery expression, out of
        the swap's reach, the query is planned over all live files instead."""
        with self._bound(whole=False):
            df = s.frame()
        if not planio.out_of_reach(df._jdf.queryExecution().analyzed()):
            return df, True
        with self._bound(whole=True):
            return s.frame(), False

    def sql(self, text: str) -> DataFrame:
        """The answer, by whatever derived state the rule allows. At most one plan-level rewrite: a cube, else a vector copy, else a join side;
        every other scan is composed by itself. A query over the budget raises BudgetExceeded before it runs.

        What the text is follows from its parsed plan. INSERT, CREATE TABLE AS and EXPLAIN get their query planned in the same way; every other
        command runs once, as in Spark, with the names bound to all live files, and is charged for the tables that it reads.
        """
        expanded, calls = expand(text)
        with self._lock:
            s = parsed(self.spark, expanded)
            if s.kind == "other":
                return self._command(s, expanded)
            df, bare_shapes = self._planned(s)
            swaps = self._swaps(df, bare_shapes, calls)
            if s.kind != "explain":
                self._charge()
            answer = spliced(df, swaps) if swaps else df
            if bare_shapes and planio.holds_shapes(answer._jdf.queryExecution().analyzed()):
                raise AssertionError("a scan was left without files")
            return s.around(answer)

    def _command(self, s: Statement, expanded: str) -> DataFrame:
        self.last_scan = []
        if s.reads:
            named = s.named()
            self.last_scan = [ScanReport(t.name, t.current, t.totals().files, t.totals().files, t.bytes, t.bytes) for t in self.tables.values() if t.name.lower() in named]
        self._charge()
        with self._bound(whole=True):
            return self.spark.sql(expanded)

    def _swaps(self, df: DataFrame, bare_shapes: bool, calls) -> list[tuple[planio.Path, DataFrame]]:
        """What stands for which nodes of the analyzed plan; reports go to last_scan."""
        plan = df._jdf.queryExecution().analyzed()
        found = planio.asks(df, list(self.tables.values()))
        reports: dict[planio.Path, ScanReport] = {}
        swaps: list[tuple[planio.Path, DataFrame]] = []
        for leaf in found:
            reports[leaf.path] = self._report(leaf, self.query_of(leaf))
        taken = self._cube(plan, found, reports, swaps) or self._nearest(plan, found, calls, reports, swaps) or self._join(plan, found, reports, swaps)
        for leaf in found:
            if leaf.path == taken:
                continue
            r = reports[leaf.path]
            composed = self.registry.compose(self.query_of(leaf), leaf.table.graph) if len(self.registry) else Composition()
            other = self._composed(leaf, composed, r)
            if other is None and bare_shapes:
                other = leaf.table.read() if self.cache is None else self._cached(leaf.table, leaf.table.graph.get(leaf.table.current).files, r)
            if other is not None:
                # scans of the table's own files have the shape's columns as they are
                own = self.cache is None and not r.substituted
                swaps.append((leaf.path, other if own else shaped(other, leaf.table.schema)))
        self.last_scan = list(reports.values())
        return swaps

    def _charge(self) -> None:
        for r in self.last_scan:
            table = self.tables[r.table]
            fact = self.facts.resolve(table.root)
            before = self.meter.spent
            try:
                if r.bytes_planned or r.files_read:
                    self.meter.charge(r.bytes_planned, fact.tier, fact.distance, max(1, r.files_read))
                    if not r.cached:
                        self.origin.charge(r.bytes_planned, fact.tier, fact.distance, max(1, r.files_read))
            except BudgetExceeded:
                self.spark.sparkContext.setJobGroup("tessera-refused", "over budget", True)
                raise
            finally:
                r.usd, r.wait_s = self.meter.spent.usd - before.usd, self.meter.spent.wait_s - before.wait_s
            saved = table.bytes - r.bytes_planned
            for id in r.used:
                self.registry.record_use(id, max(0, saved))
            if self.observe:
                self.observe(r, self.prices.price(r.bytes_planned))

    def _serving(self, query: Query, leaf: planio.Leaf, wanted) -> tuple[Derived, object] | None:
        found = self.registry.candidates(query, leaf.table.graph, wanted)
        return found[0] if found else None

    def _cube(self, plan, found, reports, swaps):
        taken = None
        for ask in planio.aggregate_asks(plan, found):
            leaf, r = ask.leaf, reports[ask.leaf.path]
            r.aggregate = ask.aggregate
            r.conditions |= {f.text: self._condition(f) for f in ask.filters}
            if taken is not None:
                continue
            query = self.query_of(leaf, aggregate=ask.aggregate)
            query = Query(**(query.__dict__ | {"plan": Plan(leaf.needed, frozenset(ask.filters)), "stale": False}))
            r.refused = self._refusals(query, leaf)
            if not (hit := self._serving(query, leaf, lambda p, d: isinstance(d, Use) and isinstance(d.rewrite, Substitute) and d.rewrite.rollup is not None)):
                continue
            piece, decision = hit
            rows = leaf.table.side(piece.kind.path)
            for f in decision.rewrite.rollup.again:
                rows = rows.where(self._condition(f))
            columns = [rolled_up(m).alias(f"m{i}") for i, m in enumerate(ask.aggregate.measures)]
            rows = rows.groupBy(*ask.aggregate.keys).agg(*columns) if ask.aggregate.keys else rows.agg(*columns)
            place = {m: f"m{i}" for i, m in enumerate(ask.aggregate.measures)}
            node = planio.at(plan, ask.path)
            kinds = [a.dataType().catalogString() for a in planio.seq(node.output())]
            rows = rows.select(*(F.col(w if isinstance(w, str) else place[w]).cast(k).alias(n) for (n, _, w), k in zip(ask.output, kinds)))
            swaps.append((ask.path, rows))
            r.used, r.substituted, r.files_read, r.bytes_planned = [piece.id], True, 0, piece.kind.bytes
            r.approximate = any(m.func in (AggFunc.COUNT_DISTINCT, AggFunc.APPROX_DISTINCT) for m in ask.aggregate.measures)
            taken = leaf.path
        return taken

    def _refusals(self, query: Query, leaf: planio.Leaf) -> dict[str, str]:
        return {id: d.reason.value for id, d in self.registry.assess(query, leaf.table.graph) if isinstance(d, Reject)}

    def _whole_leaf(self, plan, leaf, query, wanted, reports, swaps):
        reports[leaf.path].refused = self._refusals(query, leaf)
        if not (hit := self._serving(query, leaf, wanted)):
            return None
        piece, decision = hit
        r = reports[leaf.path]
        r.used, r.substituted, r.files_read, r.bytes_planned, r.missed = [piece.id], True, 0, piece.kind.bytes, getattr(decision, "missed", frozenset())
        rows = leaf.table.side(piece.kind.path)
        if buckets := getattr(piece.kind, "buckets", 0):
            rows = read_buckets(rows, buckets, piece.kind.keys)
        swaps.append((leaf.path, shaped(rows, leaf.table.schema)))
        return leaf.path

    def _nearest(self, plan, found, calls, reports, swaps):
        if not (ask := planio.nearest_ask(plan, found, calls)):
            return None
        leaf, nearest = ask
        reports[leaf.path].nearest = nearest
        return self._whole_leaf(plan, leaf, self.query_of(leaf, nearest=nearest), lambda p, d: p.kind.name == "vector", reports, swaps)

    def _join(self, plan, found, reports, swaps):
        needed = {x.path: x.needed | {c for f in x.filters for c in f.columns} for x in found}
        if not (ask := planio.join_ask(plan, found, needed)):
            return None
        leaf, join = ask
        reports[leaf.path].join = join
        return self._whole_leaf(plan, leaf, self.query_of(leaf, join=join), lambda p, d: p.kind.name == "join_hash", reports, swaps)

    # explanations and budgets

    def explain(self, text: str) -> str:
        """What would be used and what is refused, piece by piece, without reading any data."""
        expanded, calls = expand(text)
        with self._lock:
            s = parsed(self.spark, expanded)
            if s.query is None:
                return "a command: runs over all live files"
            df, _ = self._planned(s)
            lines = []
            plan = df._jdf.queryExecution().analyzed()
            found = planio.asks(df, list(self.tables.values()))
            cubes = {a.leaf.path: a for a in planio.aggregate_asks(plan, found)}
            near = planio.nearest_ask(plan, found, calls)
            for leaf in found:
                asks = {}
                if leaf.path in cubes:
                    asks["aggregate"] = cubes[leaf.path].aggregate
                if near and near[0].path == leaf.path:
                    asks["nearest"] = near[1]
                query = self.query_of(leaf, **asks)
                lines.append(f"scan {leaf.table.name} at snapshot {leaf.table.current}: {leaf.table.totals().files} files, {leaf.table.bytes} bytes")
                lines += [f"  asks {p}" for p in query.predicates]
                for id, d in self.registry.assess(query, leaf.table.graph):
                    if isinstance(d, Reject):
                        lines.append(f"  refuse {id}: {d.reason.value}")
                    else:
                        extra = getattr(d, "also_scan", None) or getattr(d, "missed", None)
                        lines.append(f"  {type(d).__name__.lower()} {id}: {type(d.rewrite).__name__.lower()}" + (f", with {len(extra)} files" if extra else ""))
            return "\n".join(lines)

    def measured(self, text: str) -> tuple[list, Cost]:
        """Runs a query and gives its rows and what was planned for it; last_read says what its scans did read."""
        group = f"tessera-{uuid.uuid4().hex}"
        before = self.meter.spent
        self.spark.sparkContext.setJobGroup(group, text[:80], True)
        df = self.sql(text)
        rows = df.collect()
        self.last_read = planio.scanned(df)
        after = self.meter.spent
        return rows, Cost(after.bytes - before.bytes, after.cpu_s - before.cpu_s, after.wait_s - before.wait_s, after.usd - before.usd)
