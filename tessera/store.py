"""Derived state that outlives a session: a description beside each side table, written last, found again by listing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql.types import StructType

from tessera import operators as ops
from tessera.kinds import Bitmap, Cube, FilterSet, Index, JoinHash, MaterializedResult, Projection, TextIndex, VectorIndex
from tessera.model import AggFunc, Filter, Measure, Metric, Plan, Scope
from tessera.rule import Derived, Registry
from tessera.sources.tablelog import Table
from tessera.workload import Workload

#: Changes whenever descriptions or side tables change their meaning; others are not read.
VERSION = 2


def _filter(f: Filter) -> list:
    """Text, columns, op, and the value with its type, so that implications hold after recovery as before."""
    v = f.value
    if isinstance(v, Decimal):
        value = ["decimal", str(v)]
    elif isinstance(v, date):
        value = ["date", v.isoformat()]
    elif isinstance(v, tuple):
        value = ["tuple", list(v)]
    else:
        value = ["plain", v]
    return [f.text, sorted(f.columns), f.op, value]


def _filter_from(doc: list) -> Filter:
    text, columns, op, (kind, v) = doc
    value = {"decimal": Decimal, "date": date.fromisoformat, "tuple": tuple}.get(kind, lambda x: x)(v)
    return Filter(text, frozenset(columns), op, value)


def _scopes(files: dict[str, Scope]) -> dict:
    return {f: None if s.whole else {str(g): None if r is None else sorted(r) for g, r in s.groups.items()} for f, s in files.items()}


def describe(piece: Derived, schema: StructType | None = None) -> dict:
    """schema: of the side table, so that a reader needs no footers."""
    k = piece.kind
    what: dict = {}
    match k:
        case Index() | TextIndex():
            what = {"column": k.column}
        case FilterSet():
            what = {"filter": _filter(k.filter)}
        case MaterializedResult():
            what = {"projected": sorted(k.plan.projected), "filters": [_filter(f) for f in sorted(k.plan.filters, key=lambda f: f.text)]}
        case Cube():
            what = {"keys": sorted(k.keys), "measures": [[m.func.value, m.column] for m in sorted(k.measures, key=lambda m: m.name)], "filters": [_filter(f) for f in k.filters]}
        case Projection():
            what = {"columns": sorted(k.columns)}
        case VectorIndex():
            what = {"column": k.column, "metric": k.metric.value, "dimension": k.dimension, "columns": sorted(k.columns)}
        case JoinHash():
            what = {"keys": list(k.keys), "columns": sorted(k.columns), "buckets": k.buckets}
    return {"version": VERSION, "id": piece.id, "table": piece.table, "snapshot": piece.snapshot, "policy": piece.policy, "kind": k.name, "path": k.path, "bytes": k.bytes, "uses": piece.uses, "what": what} | ({"schema": schema.jsonValue()} if schema is not None else {})


def _kind(table: Table, d: dict):
    what, path, size = d["what"], d["path"], d["bytes"]
    if "schema" in d:
        table.know_side(path, StructType.fromJson(d["schema"]))
    filters = lambda: frozenset(map(_filter_from, what["filters"]))
    match d["kind"]:
        case "index":
            return Index(what["column"], ops.equality_probe(table, path, what["column"], False), size, path)
        case "bitmap":
            return Bitmap(what["column"], ops.equality_probe(table, path, what["column"], True), size, path)
        case "text":
            return TextIndex(what["column"], ops.term_probe(table, path), size, path)
        case "filter-set":
            return FilterSet(_filter_from(what["filter"]), ops.filter_files(table, path), size, path)
        case "materialized":
            return MaterializedResult(path, size, Plan(frozenset(what["projected"]), filters()))
        case "cube":
            return Cube(path, size, frozenset(what["keys"]), frozenset(Measure(AggFunc(f), c) for f, c in what["measures"]), filters())
        case "projection":
            return Projection(path, size, frozenset(what["columns"]))
        case "vector":
            return VectorIndex(path, size, what["column"], Metric(what["metric"]), what["dimension"], frozenset(what["columns"]))
        case "join_hash":
            return JoinHash(path, size, tuple(what["keys"]), frozenset(what["columns"]), what["buckets"])
    raise ValueError(d["kind"])


@dataclass
class Recovered:
    registry: Registry
    discarded: dict[str, str] = field(default_factory=dict)
    orphans: list[str] = field(default_factory=list)


def _place(table: Table, piece: Derived) -> str:
    name = hashlib.sha256(f"{piece.id}\x00{piece.policy}".encode()).hexdigest()[:24]
    return f"{table.root}/_derived/_meta/{name}.json"


def persist(table: Table, piece: Derived) -> str:
    """Writes the description. The side table is there already, so what can be found is whole."""
    path = _place(table, piece)
    body = json.dumps(describe(piece, table.side(piece.kind.path).schema if getattr(piece.kind, "path", None) else None), sort_keys=True)
    table.store.write(path, json.dumps({"sum": hashlib.sha256(body.encode()).hexdigest(), "body": body}))
    return path


def _read(table: Table, path: str) -> dict:
    doc = json.loads(table.store.read(path))
    if hashlib.sha256(doc["body"].encode()).hexdigest() != doc["sum"]:
        raise ValueError("damaged description")
    return json.loads(doc["body"])


def recover(table: Table, registry: Registry | None = None, policy: str | None = None) -> Recovered:
    """All pieces that can be used again. A piece of an unknown snapshot, another version, or with a damaged description or missing rows is
    discarded and named; side tables that no description names are listed as orphans. The table itself is never at stake."""
    out = Recovered(registry or Registry())
    known: set[str] = set()
    for path, _ in table.store.list(f"{table.root}/_derived/_meta", deep=False):
        if not path.endswith(".json"):
            continue
        try:
            d = _read(table, path)
            if d["version"] != VERSION:
                raise ValueError("another version")
            if d["snapshot"] not in table.graph:
                raise ValueError("unknown snapshot")
            sizes = sum(n for p, n in table.store.list(d["path"]) if p.endswith(".parquet"))
            if sizes != d["bytes"] or not table.store.exists(f"{d['path']}/_SUCCESS"):
                raise ValueError("missing rows")
            known.add(d["path"])
            if policy is None or d["policy"] == policy:
                out.registry.register(Derived(d["id"], d["table"], d["snapshot"], _kind(table, d), d["policy"], d["uses"]))
        except Exception as e:
            out.discarded[path] = str(e)[:200]
    for path, _ in table.store.list(f"{table.root}/_derived"):
        folder = path.rsplit("/", 1)[0]
        if "/_meta" not in folder and not any(folder.endswith(k.split(":", 1)[-1].lstrip("/")) or k.endswith(folder.split(":", 1)[-1].lstrip("/")) for k in known) and folder not in out.orphans:
            out.orphans.append(folder)
    return out


def discard(table: Table, piece: Derived) -> int:
    """Deletes a piece's files; counts those that were there."""
    return table.store.delete(_place(table, piece)) + (table.store.delete(piece.kind.path) if getattr(piece.kind, "path", None) else 0)


reclaim = discard


def publish(table: Table, pieces: list[Derived]) -> str:
    """Names pieces in the table's manifest of the current snapshot, beside those that are named there already."""
    path = f"{table.root}/_derived/_manifest/{table.current:012d}.json"
    named = json.loads(table.store.read(path)) if table.store.exists(path) else {}
    named |= {p.id: _place(table, p) for p in pieces}
    table.store.write(path, json.dumps(named, sort_keys=True))
    return path


def recover_published(table: Table, snapshot: int | None = None) -> Recovered:
    """Pieces that the manifest of a snapshot (the current one) names."""
    path = f"{table.root}/_derived/_manifest/{snapshot or table.current:012d}.json"
    out = Recovered(Registry())
    if table.store.exists(path):
        for id, place in json.loads(table.store.read(path)).items():
            try:
                d = _read(table, place)
                out.registry.register(Derived(d["id"], d["table"], d["snapshot"], _kind(table, d), d["policy"], d["uses"]))
            except Exception as e:
                out.discarded[id] = str(e)[:200]
    return out


def save_workload(table: Table, workload: Workload) -> None:
    table.store.write(f"{table.root}/_derived/_workload.json", workload.to_json())


def load_workload(table: Table) -> Workload:
    path = f"{table.root}/_derived/_workload.json"
    return Workload.from_json(table.store.read(path)) if table.store.exists(path) else Workload()
