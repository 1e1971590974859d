"""Iceberg tables as the engine's tables: metadata documents and Avro manifests are read directly, data by Spark.

Field ids, lineage, live files of every snapshot and their numeric bounds come from the metadata alone. A snapshot with delete files gives all its data files one
fingerprint of them, so stored rows from before are refused. Position deletes are applied to what is read; equality deletes are refused.
"""

from __future__ import annotations

import hashlib
import json
import struct
import urllib.request
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.model import Commits, Snapshot, SnapshotGraph
from tessera.sources.tablelog import BARE, DataFile, Store, Table, bare

# --- Avro containers --------------------------------------------------------------------------------------------------


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("a manifest is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def text(self) -> bytes:
        return self.take(self.long())


def _value(b: _Bytes, kind, named: dict):
    if isinstance(kind, list):
        return _value(b, kind[b.long()], named)
    if isinstance(kind, str):
        match kind:
            case "null":
                return None
            case "boolean":
                return b.take(1) == b"\x01"
            case "int" | "long":
                return b.long()
            case "float":
                return struct.unpack("<f", b.take(4))[0]
            case "double":
                return struct.unpack("<d", b.take(8))[0]
            case "bytes":
                return b.text()
            case "string":
                return b.text().decode()
        return _value(b, named[kind], named)
    match kind["type"]:
        case "record":
            named[kind["name"]] = kind
            return {f["name"]: _value(b, f["type"], named) for f in kind["fields"]}
        case "array" | "map":
            out: list = []
            while n := b.long():
                if n < 0:
                    n, _ = -n, b.long()
                out += [(b.text().decode(), _value(b, kind["values"], named)) if kind["type"] == "map" else _value(b, kind["items"], named) for _ in range(n)]
            return dict(out) if kind["type"] == "map" else out
        case "fixed":
            named[kind["name"]] = kind
            return b.take(kind["size"])
        case "enum":
            named[kind["name"]] = kind
            return kind["symbols"][b.long()]
    return _value(b, kind["type"], named)


def avro_records(data: bytes) -> list[dict]:
    """The records of an Avro container file, with or without deflate."""
    b = _Bytes(data)
    if b.take(4) != b"Obj\x01":
        raise ValueError("no Avro container")
    meta = _value(b, {"type": "map", "values": "bytes"}, {})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec {codec}")
    sync, out = b.take(16), []
    while b.at < len(data):
        count, block = b.long(), b.text()
        part, named = _Bytes(zlib.decompress(block, -15) if codec == "deflate" else block), {}
        out += [_value(part, schema, named) for _ in range(count)]
        if b.take(16) != sync:
            raise ValueError("a manifest is damaged")
    return out


# --- tables -----------------------------------------------------------------------------------------------------------

_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType()}
_BOUNDS = {"int": "<i", "long": "<q", "float": "<f", "double": "<d", "date": "<i", "timestamp": "<q", "timestamptz": "<q"}


def _spark_type(kind) -> T.DataType:
    if isinstance(kind, str):
        if kind.startswith("decimal"):
            p, s = kind[8:-1].split(",")
            return T.DecimalType(int(p), int(s))
        return T.BinaryType() if kind.startswith("fixed") else _TYPES[kind]
    match kind["type"]:
        case "struct":
            return T.StructType([_field(f) for f in kind["fields"]])
        case "list":
            return T.ArrayType(_spark_type(kind["element"]), not kind["element-required"])
        case "map":
            return T.MapType(_spark_type(kind["key"]), _spark_type(kind["value"]), not kind["value-required"])
    raise ValueError(kind)


def _field(f: dict) -> T.StructField:
    return T.StructField(f["name"], _spark_type(f["type"]), True, {"field_id": f["id"]})


def _fingerprint(paths: Iterable[str]) -> int:
    """Never 0: that stands for no deletes."""
    return int.from_bytes(hashlib.sha256("\x00".join(sorted(paths)).encode()).digest()[:7], "big") | 1


class IcebergTable(Table):
    """Read-only."""

    def __init__(self, spark: SparkSession, name: str, metadata: dict, side_root: str, commits: Commits | None = None, at: int | None = None):
        super().__init__(spark, name, metadata["location"], commits)
        self.id, self.data_root, self.root = metadata["table-uuid"], self.root, side_root.rstrip("/")
        schema = next(s for s in metadata.get("schemas", [metadata.get("schema")]) if s.get("schema-id", 0) == metadata.get("current-schema-id", 0))
        self.schema = T.StructType([_field(f) for f in schema["fields"]])
        self.fields = {f["name"]: f["id"] for f in schema["fields"]}
        kinds = {f["id"]: (f["name"], f["type"]) for f in schema["fields"] if isinstance(f["type"], str)}
        self.deletes: dict[int, list[tuple[int, str]]] = {}
        self.graph = SnapshotGraph()
        for s in metadata.get("snapshots", []):
            live, gone = [], []
            for m in self._manifests(s):
                for e in avro_records(self.store.read_bytes(m)):
                    d = e["data_file"]
                    if e["status"] != 2:
                        (gone if d.get("content", 0) else live).append(d)
            mark = _fingerprint(d["file_path"] for d in gone) if gone else 0
            self.deletes[s["snapshot-id"]] = [(d["content"], d["file_path"]) for d in gone]
            for d in live:
                self.files.setdefault(bare(d["file_path"]), DataFile(d["file_path"], d["file_size_in_bytes"], d["record_count"], 1, _bounds(d, kinds), {}, mark))
            self.graph.add(Snapshot(s["snapshot-id"], s.get("parent-snapshot-id"), {bare(d["file_path"]): mark for d in live}))
        self.current = metadata.get("current-snapshot-id") if at is None else at
        if self.current not in self.graph:
            raise KeyError(f"no snapshot {self.current}")

    def _manifests(self, snapshot: dict) -> list[str]:
        if "manifests" in snapshot:
            return snapshot["manifests"]
        return [m["manifest_path"] for m in avro_records(self.store.read_bytes(snapshot["manifest-list"]))]

    def read(self, files: Iterable[str] | None = None, snapshot: int | None = None) -> DataFrame:
        deletes = self.deletes.get(self.current if snapshot is None else snapshot, [])
        df = super().read(files, snapshot)
        return self._kept(self._placed(df), deletes).drop("_file", "_row") if deletes else df

    def located(self, files: Iterable[str] | None = None) -> DataFrame:
        return self._kept(self._placed(super().read(files)), self.deletes.get(self.current, []))

    @staticmethod
    def _placed(df: DataFrame) -> DataFrame:
        return df.select("*", F.expr(BARE.format("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _kept(self, df: DataFrame, deletes: list[tuple[int, str]]) -> DataFrame:
        if not deletes:
            return df
        if any(content != 1 for content, _ in deletes):
            raise NotImplementedError("equality deletes")
        gone = self.spark.read.schema("file_path string, pos bigint").parquet(*(p for _, p in deletes)).select(F.expr(BARE.format("file_path")).alias("_gone"), "pos")
        return df.join(gone, (F.col("_file") == F.col("_gone")) & (F.col("_row") == F.col("pos")), "left_anti")

    def _change(self, *args, **kwargs):
        raise PermissionError("Iceberg tables are read-only here")

    _added = commit = _change


def _bounds(d: dict, kinds: dict[int, tuple[str, str]]) -> dict[str, tuple[float, float]]:
    """Numeric bounds by column; strings and the like have no distance and are left out."""

    def of(entries) -> dict[int, bytes]:
        if not entries:
            return {}
        return {int(k): v for k, v in entries.items()} if isinstance(entries, dict) else {e["key"]: e["value"] for e in entries}

    low, high = of(d.get("lower_bounds")), of(d.get("upper_bounds"))
    return {kinds[i][0]: tuple(float(struct.unpack(_BOUNDS[kinds[i][1]], x)[0]) for x in (low[i], high[i])) for i in low.keys() & high.keys() & kinds.keys() if kinds[i][1] in _BOUNDS}


def table_from_metadata(spark: SparkSession, name: str, path: str, side_root: str, at: int | None = None) -> IcebergTable:
    """From a metadata document; side_root is where derived state goes."""
    return IcebergTable(spark, name, json.loads(Store(spark).read(path)), side_root, at=at)


def table_from_rest(spark: SparkSession, name: str, url: str, namespace: str, table: str, side_root: str, at: int | None = None, token: str | None = None) -> IcebergTable:
    """From a REST catalog: its configuration may name a prefix; loading a table gives its metadata."""

    def get(path: str) -> dict:
        request = urllib.request.Request(f"{url.rstrip('/')}/v1/{path}", headers={"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)

    config = get("config")
    prefix = (config.get("overrides", {}) | config.get("defaults", {})).get("prefix", "")
    doc = get(f"{prefix + '/' if prefix else ''}namespaces/{namespace}/tables/{table}")
    return IcebergTable(spark, name, doc["metadata"], side_root, at=at)
