"""The kinds of derived state: each says what it can do for a query; its data is a Parquet side table that Spark reads.

Nothing here holds postings in the driver's memory. A probe asks the side table for the values of one query, and gets back at most one row a
file, or the rows admitted while they are few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.model import WHOLE, Aggregate, Eq, Filter, Matches, Measure, Metric, Prune, Query, Rewrite, Rollup, Scope, Substitute
from tessera.rule import Kind

#: A probe gives the admitted scope of each file.
EqProbe = Callable[[frozenset], dict[str, Scope]]
TermProbe = Callable[[str], frozenset[str]]


@dataclass
class Index(Kind):
    """Equality index: which files hold a value. Several conjuncts on the column intersect; a value of none is in no file."""

    column: str
    probe: EqProbe
    size: int = 0
    path: str | None = None
    name = "index"

    @property
    def bytes(self) -> int:
        return self.size

    def matches(self, query: Query) -> Rewrite | None:
        out: dict[str, Scope] | None = None
        for p in query.predicates:
            if isinstance(p, Eq) and p.column == self.column:
                found = self.probe(p.values)
                if out is None:
                    out = found
                else:
                    both = {f: out[f].intersect(found[f]) for f in out.keys() & found.keys()}
                    out = {f: s for f, s in both.items() if s is not None}
        return None if out is None else Prune(out)


@dataclass
class Bitmap(Index):
    """Row-level equality index: which rows of which files hold a value."""

    name = "bitmap"


@dataclass
class FilterSet(Kind):
    """The rows that one conjunct left of each file. Only that very conjunct matches."""

    filter: Filter
    files: dict[str, Scope]
    size: int = 0
    path: str | None = None
    name = "filter-set"

    @property
    def bytes(self) -> int:
        return self.size

    def matches(self, query: Query) -> Rewrite | None:
        return Prune(self.files) if query.plan and any(f.text == self.filter.text for f in query.plan.filters) else None


@dataclass
class TextIndex(Kind):
    """Inverted index: which files hold a term. All terms must be there."""

    column: str
    probe: TermProbe
    size: int = 0
    path: str | None = None
    name = "text"

    @property
    def bytes(self) -> int:
        return self.size

    def matches(self, query: Query) -> Rewrite | None:
        asked = [p for p in query.predicates if isinstance(p, Matches) and p.column == self.column and p.terms]
        if not asked:
            return None
        if many := getattr(self.probe, "many", None):
            many(frozenset().union(*(p.terms for p in asked)))
        files = frozenset.intersection(*(self.probe(t) for p in asked for t in sorted(p.terms)))
        return Prune({f: WHOLE for f in files})


@dataclass
class ResultCache(Kind):
    """Knows that a result was had, without its rows: planned and explained, never executed."""

    plan: object
    aggregate: Aggregate | None = None
    name = "result"
    executable = False

    def matches(self, query: Query) -> Rewrite | None:
        if query.plan != self.plan or query.aggregate != self.aggregate:
            return None
        return Substitute(unionable=self.aggregate is None)


@dataclass
class Stored(Kind):
    """A kind with rows in a Parquet side table."""

    path: str
    size: int = 0

    @property
    def bytes(self) -> int:
        return self.size


@dataclass
class MaterializedResult(Stored):
    """The rows of one exact scan."""

    plan: object = None
    name = "materialized"

    def matches(self, query: Query) -> Rewrite | None:
        return Substitute(unionable=True) if query.plan is not None and query.plan == self.plan and query.aggregate is None else None


@dataclass
class Cube(Stored):
    """Partial aggregates by some keys, of the rows that some conjuncts left."""

    keys: frozenset[str] = frozenset()
    measures: frozenset[Measure] = frozenset()
    filters: frozenset[Filter] = frozenset()
    name = "cube"

    def matches(self, query: Query) -> Rewrite | None:
        a = query.aggregate
        if a is None or query.plan is None or not a.covered_by(self.keys, self.measures, query.approximate):
            return None
        asked = query.plan.filters
        # what the cube left out must be left out by the query as well
        if not all(any(q.implies(mine) for q in asked) for mine in self.filters):
            return None
        again = [q for q in asked if not any(q.text == mine.text for mine in self.filters)]
        if not all(q.columns <= self.keys for q in again):
            return None
        return Substitute(unionable=False, rollup=Rollup(self.keys, self.measures, tuple(again)))


@dataclass
class Projection(Stored):
    """All rows, some columns."""

    columns: frozenset[str] = frozenset()
    name = "projection"

    def matches(self, query: Query) -> Rewrite | None:
        needed = set(query.projected)
        if query.plan:
            needed |= {c for f in query.plan.filters for c in f.columns}
        if query.aggregate:
            needed |= set(query.aggregate.keys) | {m.column for m in query.aggregate.measures if m.column}
        return Substitute(unionable=True) if needed <= self.columns else None


@dataclass
class VectorIndex(Stored):
    """A flat copy for one vector column, metric and dimension, with some columns beside it (all, if none are named). The number of rows
    asked for and the vector don't matter."""

    column: str = ""
    metric: Metric = Metric.L2
    dimension: int = 0
    columns: frozenset[str] = frozenset()
    name = "vector"

    def matches(self, query: Query) -> Rewrite | None:
        n = query.nearest
        if not n or (n.column, n.metric, n.dimension) != (self.column, self.metric, self.dimension):
            return None
        return Substitute(unionable=False) if not self.columns or query.projected <= self.columns else None


@dataclass
class JoinHash(Stored):
    """The build side of an equi-join, in buckets of its keys (0: in none)."""

    keys: tuple[str, ...] = ()
    columns: frozenset[str] = frozenset()
    buckets: int = 0
    name = "join_hash"

    def matches(self, query: Query) -> Rewrite | None:
        j = query.join
        return Substitute(unionable=False) if j and set(j.keys) == set(self.keys) and j.needed <= self.columns else None


ALL = (Index, Bitmap, FilterSet, TextIndex, ResultCache, MaterializedResult, Cube, Projection, VectorIndex, JoinHash)


@dataclass
class InMemory:
    """Postings held in memory, for tests and small tables: an EqProbe and a TermProbe."""

    held: dict = field(default_factory=dict)

    def values(self, wanted: frozenset) -> dict[str, Scope]:
        out: dict[str, Scope] = {}
        for v in wanted:
            for f, scope in self.held.get(v, {}).items():
                out[f] = out[f].union(scope) if f in out else scope
        return out

    def term(self, wanted: str) -> frozenset[str]:
        return frozenset(self.held.get(wanted, ()))
