"""The one rule for using derived state, the registry, and how several pieces serve one scan together."""

from __future__ import annotations

import threading
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.cost import CLOUD, Cost
from tessera.model import WHOLE, Decision, Prune, Query, Reason, Reject, Rewrite, Scope, SnapshotGraph, Substitute, Use, UseStale, UseWith


class Kind(ABC):
    """What a piece of derived state is. A new kind needs no change elsewhere."""

    name: str

    @abstractmethod
    def matches(self, query: Query) -> Rewrite | None:
        """What the piece can do for the query, lineage aside."""

    @property
    def bytes(self) -> int:
        return 0

    def cost(self) -> Cost:
        return CLOUD.price(self.bytes)

    executable = True


@dataclass
class Derived:
    """A piece: computed from a table at a snapshot, for readers under a policy."""

    id: str
    table: str
    snapshot: int
    kind: Kind
    policy: str = ""
    uses: int = 0
    saved: float = 0.0
    built: Cost = field(default_factory=Cost)

    def may_serve(self, query: Query, graph: SnapshotGraph) -> Decision:
        """Table, match, snapshots, lineage, policy, then what has changed since: the first that fails is the reason.

        Pruning tolerates any change: files that are gone drop out, files added since are read whole. Rows that stand for a scan
        tolerate additions only; if added rows can't be appended they serve just those who accept stale answers.
        """
        if query.table != self.table:
            return Reject(Reason.WRONG_TABLE)
        rewrite = self.kind.matches(query)
        if rewrite is None:
            return Reject(Reason.NO_MATCH)
        if query.snapshot not in graph or self.snapshot not in graph:
            return Reject(Reason.UNKNOWN_SNAPSHOT)
        if not graph.descends(query.snapshot, self.snapshot):
            return Reject(Reason.NOT_DESCENDANT)
        if query.policy != self.policy:
            return Reject(Reason.POLICY_MISMATCH)
        diff = graph.diff(self.snapshot, query.snapshot)
        if isinstance(rewrite, Prune):
            live = graph.get(query.snapshot).files
            kept = Prune({f: s for f, s in rewrite.files.items() if f in live})
            return UseWith(kept, diff.added) if diff.added else Use(kept)
        if not diff.additive:
            return Reject(Reason.SUBTRACTIVE_CHANGE)
        if not diff.added:
            return Use(rewrite)
        if rewrite.unionable:
            return UseWith(rewrite, diff.added)
        return UseStale(rewrite, diff.added) if query.stale else Reject(Reason.RESIDUAL_NOT_UNIONABLE)


@dataclass
class Composition:
    """What serves a scan: pieces by id, and either stored rows with files to read besides, or the files that remain."""

    used: list[str] = field(default_factory=list)
    substitute: Derived | None = None
    rollup: object = None
    also_scan: frozenset[str] = frozenset()
    missed: frozenset[str] = frozenset()
    files: dict[str, Scope] | None = None


class Registry:
    """Pieces by id. Shared between threads; held only while planning."""

    def __init__(self) -> None:
        self._pieces: dict[str, Derived] = {}
        self.lock = threading.RLock()

    def register(self, piece: Derived) -> None:
        with self.lock:
            self._pieces[piece.id] = piece

    def remove(self, id: str) -> Derived | None:
        with self.lock:
            return self._pieces.pop(id, None)

    def get(self, id: str) -> Derived | None:
        return self._pieces.get(id)

    def ids(self) -> list[str]:
        with self.lock:
            return sorted(self._pieces)

    def __len__(self) -> int:
        return len(self._pieces)

    def __iter__(self):
        with self.lock:
            return iter([self._pieces[i] for i in sorted(self._pieces)])

    @property
    def bytes(self) -> int:
        return sum(p.kind.bytes for p in self)

    def record_use(self, id: str, saved: float = 0.0) -> None:
        with self.lock:
            if piece := self._pieces.get(id):
                piece.uses += 1
                piece.saved += saved

    def assess(self, query: Query, graph: SnapshotGraph) -> list[tuple[str, Decision]]:
        """Every piece and its verdict, in order of ids."""
        return [(p.id, p.may_serve(query, graph)) for p in self]

    def candidates(self, query: Query, graph: SnapshotGraph, fit: Callable[[Derived, Decision], bool] = lambda p, d: True) -> list[tuple[Derived, Decision]]:
        """Admitted pieces that fit, cheapest first, then those with fewer files to read besides, then by id. fit is asked before the order
        matters, so that a cheap piece of one ability never hides a usable piece of another."""
        found = []
        for p in self:
            d = p.may_serve(query, graph)
            if not isinstance(d, Reject) and p.kind.executable and fit(p, d):
                found.append((p, d))
        return sorted(found, key=lambda x: (x[0].kind.cost().usd, len(getattr(x[1], "also_scan", ())), x[0].id))

    def compose(self, query: Query, graph: SnapshotGraph) -> Composition:
        """The cheapest piece leads. If it is stored rows they answer alone; otherwise all prunes are intersected, each with the
        files that it doesn't know added whole, and a piece is named only if it left something out."""
        found = self.candidates(query, graph, lambda p, d: not (isinstance(d.rewrite, Substitute) and (d.rewrite.rollup or query.nearest or query.join and not d.rewrite.unionable)))
        if not found:
            return Composition()
        lead, decision = found[0]
        if isinstance(decision.rewrite, Substitute):
            return Composition([lead.id], lead, decision.rewrite.rollup, getattr(decision, "also_scan", frozenset()), getattr(decision, "missed", frozenset()))
        live = graph.get(query.snapshot).files
        files: dict[str, Scope] = {f: WHOLE for f in live}
        used = []
        for piece, d in found:
            if not isinstance(d.rewrite, Prune):
                continue
            admitted = dict(d.rewrite.files) | {f: WHOLE for f in getattr(d, "also_scan", ())}
            left = {}
            for f, scope in files.items():
                if f in admitted and (both := scope.intersect(admitted[f])) is not None:
                    left[f] = both
            if left != files:
                used.append(piece.id)
            files = left
        return Composition(used, files=files)

    def evict_to(self, most: int) -> list[str]:
        """Drops pieces of fewest uses a byte until at most so many bytes are held; pieces without bytes stay."""
        out = []
        with self.lock:
            for p in sorted((p for p in self if p.kind.bytes), key=lambda p: (p.uses / p.kind.bytes, p.id)):
                if self.bytes <= most:
                    break
                out.append(p.id)
                del self._pieces[p.id]
        return out
