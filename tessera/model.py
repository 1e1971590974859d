"""What a question asks of a table, what a piece of derived state is, and how tables change. No Spark in here."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from enum import Enum
from typing import Any

# --- snapshots --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """A commit: the live files, each with a fingerprint of its deletes (0: none)."""

    id: int
    parent: int | None
    files: Mapping[str, int]


@dataclass(frozen=True)
class Diff:
    added: frozenset[str] = frozenset()
    removed: frozenset[str] = frozenset()
    redeleted: frozenset[str] = frozenset()

    @property
    def additive(self) -> bool:
        return not self.removed and not self.redeleted

    @property
    def empty(self) -> bool:
        return self.additive and not self.added


class SnapshotGraph:
    """The lineage of one table."""

    def __init__(self, snapshots: Iterable[Snapshot] = ()):
        self._by_id = {s.id: s for s in snapshots}

    def add(self, snapshot: Snapshot) -> None:
        self._by_id[snapshot.id] = snapshot

    def get(self, id: int) -> Snapshot | None:
        return self._by_id.get(id)

    def __contains__(self, id: int) -> bool:
        return id in self._by_id

    def __len__(self) -> int:
        return len(self._by_id)

    def __iter__(self):
        return iter(sorted(self._by_id.values(), key=lambda s: s.id))

    def descends(self, id: int, ancestor: int) -> bool:
        """Whether id is ancestor or comes after it on its own line; a cycle in the lineage ends the walk."""
        seen: set[int] = set()
        at: int | None = id
        while at is not None and at not in seen and at in self._by_id:
            if at == ancestor:
                return True
            seen.add(at)
            at = self._by_id[at].parent
        return False

    def diff(self, old: int, new: int) -> Diff | None:
        a, b = self.get(old), self.get(new)
        if a is None or b is None:
            return None
        both = a.files.keys() & b.files.keys()
        return Diff(frozenset(b.files.keys() - a.files.keys()), frozenset(a.files.keys() - b.files.keys()), frozenset(f for f in both if a.files[f] != b.files[f]))


class Commits:
    """Notes of new snapshots; taken out as the latest one of each table, so no table's notes are lost for another's."""

    def __init__(self) -> None:
        self._notes: deque[tuple[str, int]] = deque()
        self._lock = threading.Lock()

    def note(self, table: str, snapshot: int) -> None:
        with self._lock:
            self._notes.append((table, snapshot))

    def drain(self) -> dict[str, int]:
        with self._lock:
            out: dict[str, int] = {}
            while self._notes:
                table, snapshot = self._notes.popleft()
                out[table] = max(snapshot, out.get(table, snapshot))
            return out


# --- predicates and filters -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Eq:
    """column = one of values (typed literals); IN and OR of equalities are one of these."""

    column: str
    values: frozenset[Any]


@dataclass(frozen=True)
class Matches:
    """All terms occur in the text column."""

    column: str
    terms: frozenset[str]


@dataclass(frozen=True)
class Opaque:
    """Something about these columns that no index can be asked."""

    columns: frozenset[str]


Predicate = Eq | Matches | Opaque


def _comparable(a: Any, b: Any) -> bool:
    numbers = (int, float, Decimal)
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool)
    return isinstance(a, numbers) and isinstance(b, numbers) or type(a) is type(b)


def _exact(x: Any) -> Any:
    return Decimal(x) if isinstance(x, float) else x


@dataclass(frozen=True)
class Filter:
    """One conjunct. Simple ones have column, op and a typed value; the text tells all others apart, types included."""

    text: str
    columns: frozenset[str]
    op: str | None = None
    value: Any = None

    @property
    def column(self) -> str | None:
        return next(iter(self.columns)) if self.op and len(self.columns) == 1 else None

    def implies(self, other: Filter) -> bool:
        """Whether every row that passes this passes other. No claim unless both are simple and about the same column."""
        if self.text == other.text:
            return True
        if self.column is None or self.column != other.column or not _comparable(self.value, other.value):
            return False
        a, b = _exact(self.value), _exact(other.value)
        if isinstance(a, Decimal) and a.is_nan() or isinstance(b, Decimal) and b.is_nan():
            return False
        if self.op == "=":
            return {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "<>": a != b}.get(other.op, False)
        if self.op in (">", ">="):
            if other.op in (">", "<>"):
                return a > b or a == b and self.op == ">"
            return other.op == ">=" and a >= b
        if self.op in ("<", "<="):
            if other.op in ("<", "<>"):
                return a < b or a == b and self.op == "<"
            return other.op == "<=" and a <= b
        return False


@dataclass(frozen=True)
class Plan:
    """A scan's exact identity: columns and conjuncts, in no order."""

    projected: frozenset[str]
    filters: frozenset[Filter] = frozenset()


# --- aggregates, nearest rows, joins ----------------------------------------------------------------------------------


class AggFunc(str, Enum):
    COUNT = "count"
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    AVG = "avg"
    COUNT_DISTINCT = "count_distinct"
    APPROX_DISTINCT = "approx_distinct"


@dataclass(frozen=True)
class Measure:
    func: AggFunc
    column: str | None = None

    @property
    def name(self) -> str:
        return f"{self.func.value}({self.column or '*'})"

    def partials(self) -> tuple[Measure, ...]:
        """What a cube stores to answer this."""
        if self.func is AggFunc.AVG:
            return (Measure(AggFunc.SUM, self.column), Measure(AggFunc.COUNT, self.column))
        if self.func is AggFunc.COUNT_DISTINCT:
            return (Measure(AggFunc.APPROX_DISTINCT, self.column),)
        return (self,)

    def computable_from(self, stored: frozenset[Measure], approximate: bool) -> bool:
        if self.func is AggFunc.COUNT_DISTINCT and not approximate:
            return False
        return set(self.partials()) <= stored


@dataclass(frozen=True)
class Aggregate:
    keys: tuple[str, ...]
    measures: tuple[Measure, ...]

    def covered_by(self, keys: frozenset[str], stored: frozenset[Measure], approximate: bool) -> bool:
        return set(self.keys) <= keys and all(m.computable_from(stored, approximate) for m in self.measures)


class Metric(str, Enum):
    L2 = "l2"
    COSINE = "cosine"


@dataclass(frozen=True)
class Nearest:
    """A top-k ask. The vector is no part of it."""

    column: str
    metric: Metric
    dimension: int
    k: int


@dataclass(frozen=True)
class JoinAsk:
    """An equi-join that has this table on its left."""

    keys: tuple[str, ...]
    needed: frozenset[str]


@dataclass(frozen=True)
class Query:
    """Everything that the rule sees of one scan."""

    table: str
    snapshot: int
    projected: frozenset[str]
    predicates: tuple[Predicate, ...] = ()
    plan: Plan | None = None
    policy: str = ""
    aggregate: Aggregate | None = None
    nearest: Nearest | None = None
    join: JoinAsk | None = None
    approximate: bool = False
    stale: bool = False


# --- scopes, rewrites, verdicts ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scope:
    """How much of a file is admitted: all of it, some row groups, or some rows of row groups (None: all rows of the group)."""

    groups: Mapping[int, frozenset[int] | None] | None = None

    @property
    def whole(self) -> bool:
        return self.groups is None

    def intersect(self, other: Scope) -> Scope | None:
        """None if nothing is left."""
        if self.groups is None:
            return other
        if other.groups is None:
            return self
        out: dict[int, frozenset[int] | None] = {}
        for g in self.groups.keys() & other.groups.keys():
            a, b = self.groups[g], other.groups[g]
            rows = b if a is None else a if b is None else a & b
            if rows is None or rows:
                out[g] = rows
        return Scope(out) if out else None

    def union(self, other: Scope) -> Scope:
        if self.groups is None or other.groups is None:
            return WHOLE
        out = dict(self.groups)
        for g, rows in other.groups.items():
            mine = out.get(g, frozenset())
            out[g] = None if mine is None or rows is None else mine | rows
        return Scope(out)


WHOLE = Scope()


@dataclass(frozen=True)
class Prune:
    """Only these files (in these scopes) can hold rows of the answer."""

    files: Mapping[str, Scope]


@dataclass(frozen=True)
class Rollup:
    """How a cube answers: the stored measures, and conjuncts to apply again on its keys."""

    keys: frozenset[str]
    stored: frozenset[Measure]
    again: tuple[Filter, ...]


@dataclass(frozen=True)
class Substitute:
    """Stored rows stand for the scan. unionable: rows of files added since may simply be appended."""

    unionable: bool
    rollup: Rollup | None = None


Rewrite = Prune | Substitute


class Reason(str, Enum):
    WRONG_TABLE = "wrong table"
    NO_MATCH = "no match"
    NOT_DESCENDANT = "not a descendant"
    UNKNOWN_SNAPSHOT = "unknown snapshot"
    POLICY_MISMATCH = "policy mismatch"
    SUBTRACTIVE_CHANGE = "subtractive change"
    RESIDUAL_NOT_UNIONABLE = "residual not unionable"


@dataclass(frozen=True)
class Use:
    rewrite: Rewrite


@dataclass(frozen=True)
class UseWith:
    rewrite: Rewrite
    also_scan: frozenset[str]


@dataclass(frozen=True)
class UseStale:
    rewrite: Rewrite
    missed: frozenset[str]


@dataclass(frozen=True)
class Reject:
    reason: Reason


Decision = Use | UseWith | UseStale | Reject

