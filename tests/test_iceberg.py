"""Iceberg metadata: a small Avro writer makes the manifests; data are Spark's own files."""

from __future__ import annotations

import http.server
import json
import struct
import threading
import zlib

import pytest

from tessera import operators as ops
from tessera.session import Session
from tessera.sources import iceberg
from tessera.sources.tablelog import bare


def z(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def text(s: str | bytes) -> bytes:
    s = s.encode() if isinstance(s, str) else s
    return z(len(s)) + s


def container(schema: dict, records: list[bytes], deflate: bool) -> bytes:
    block = b"".join(records)
    if deflate:
        c = zlib.compressobj(wbits=-15)
        block = c.compress(block) + c.flush()
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"deflate" if deflate else b"null"}
    sync = b"0123456789abcdef"
    return b"Obj\x01" + z(len(meta)) + b"".join(text(k) + text(v) for k, v in meta.items()) + z(0) + sync + z(len(records)) + text(block) + sync


BOUND = {"type": "array", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}
FILE = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}, {"name": "lower_bounds", "type": ["null", BOUND]}, {"name": "upper_bounds", "type": ["null", {"type": "array", "items": "kv"}]}]}
ENTRY = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": FILE}]}
LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}


def entry(status: int, content: int, path: str, rows: int, size: int, low: int | None, high: int | None) -> bytes:
    bounds = lambda v: z(0) if v is None else z(1) + z(1) + z(4) + text(struct.pack("<q", v)) + z(0)
    return z(status) + z(content) + text(path) + z(rows) + z(size) + bounds(low) + bounds(high)


@pytest.fixture
def lake(spark, tmp_path):
    """Four files of one tenant each; then one more; then a position delete in file 0."""
    data = f"file://{tmp_path}/data"
    rows = spark.range(0, 50, 1, 1).selectExpr("id % 5 AS tenant_id", "concat('m', id) AS message")
    files = []
    for i in range(5):
        rows.where(f"tenant_id = {i}").coalesce(1).write.parquet(f"{data}/{i}")
        path = next((tmp_path / "data" / str(i)).glob("*.parquet"))
        files.append((f"file://{path}", path.stat().st_size))
    spark.createDataFrame([(files[0][0], 2)], "file_path string, pos bigint").coalesce(1).write.parquet(f"{data}/d")
    gone = f"file://{next((tmp_path / 'data' / 'd').glob('*.parquet'))}"

    def manifest(name: str, entries: list[bytes], deflate: bool = True) -> str:
        (tmp_path / name).write_bytes(container(ENTRY, entries, deflate))
        return f"file://{tmp_path}/{name}"

    def listed(name: str, manifests: list[str]) -> str:
        (tmp_path / name).write_bytes(container(LIST, [text(m) + z(0) for m in manifests], False))
        return f"file://{tmp_path}/{name}"

    first = manifest("m1.avro", [entry(1, 0, p, 10, n, i, i) for i, (p, n) in enumerate(files[:4])])
    more = manifest("m2.avro", [entry(1, 0, files[4][0], 10, files[4][1], 4, 4), entry(2, 0, "file:///gone.parquet", 1, 1, None, None)], False)
    deleted = manifest("m3.avro", [entry(1, 1, gone, 1, 1, None, None)])
    doc = {
        "format-version": 2, "table-uuid": "u-1", "location": data, "current-schema-id": 0, "current-snapshot-id": 812,
        "schemas": [{"schema-id": 0, "type": "struct", "fields": [{"id": 4, "name": "tenant_id", "required": True, "type": "long"}, {"id": 7, "name": "message", "required": True, "type": "string"}]}],
        "snapshots": [{"snapshot-id": 810, "manifest-list": listed("l1.avro", [first])}, {"snapshot-id": 811, "parent-snapshot-id": 810, "manifest-list": listed("l2.avro", [first, more])}, {"snapshot-id": 812, "parent-snapshot-id": 811, "manifest-list": listed("l3.avro", [first, more, deleted])}],
    }
    (tmp_path / "v3.metadata.json").write_text(json.dumps(doc))
    return tmp_path, doc


def test_metadata(spark, lake):
    root, _ = lake
    t = iceberg.table_from_metadata(spark, "ice", f"file://{root}/v3.metadata.json", f"file://{root}/side", at=811)
    assert t.id == "u-1" and t.fields == {"tenant_id": 4, "message": 7} and len(t.live()) == 5
    assert t.schema["tenant_id"].metadata == {"field_id": 4}
    assert sorted(f.bounds["tenant_id"] for f in t.live()) == [(float(i), float(i)) for i in range(5)] and all("message" not in f.bounds for f in t.live())
    assert t.graph.diff(810, 811).additive and t.graph.diff(811, 812).redeleted == frozenset(bare(f.path) for f in t.live())
    with pytest.raises(KeyError):
        iceberg.table_from_metadata(spark, "ice", f"file://{root}/v3.metadata.json", f"file://{root}/side", at=1)
    with pytest.raises(PermissionError):
        t.append(t.read())


def test_sql_over_iceberg(spark, lake):
    root, _ = lake
    t = iceberg.table_from_metadata(spark, "ice", f"file://{root}/v3.metadata.json", f"file://{root}/side", at=810)
    s = Session(spark)
    s.attach(t)
    s.registry.register(ops.build_index(t, "tenant_id"))
    s.registry.register(ops.build_projection(t, frozenset(("tenant_id",))))
    assert len(s.sql("SELECT message FROM ice WHERE tenant_id = 3").collect()) == 10 and s.last_scan[0].files_read == 1
    now = Session(spark, registry=s.registry)
    now.attach(iceberg.table_from_metadata(spark, "ice", f"file://{root}/v3.metadata.json", f"file://{root}/side"))
    # a position delete takes a row away, and stored rows from before are refused
    assert len(now.sql("SELECT message FROM ice WHERE tenant_id = 0").collect()) == 9
    assert now.sql("SELECT count(tenant_id) AS n FROM ice").first()[0] == 49
    assert "subtractive change" in now.last_scan[0].refused.values()
    assert len(now.unaided("SELECT * FROM ice").collect()) == 49
    # pieces built on rows with deletes know their places
    t = now.tables["ice"]
    now.registry.register(ops.build_bitmap(t, "tenant_id"))
    assert len(now.sql("SELECT message FROM ice WHERE tenant_id = 0").collect()) == 9 and now.last_scan[0].row_scoped


def test_rest_catalog(spark, lake):
    root, doc = lake

    class Catalog(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            answer = {"/v1/config": {"defaults": {"prefix": "p"}}, "/v1/p/namespaces/db/tables/ice": {"metadata": doc}}[self.path]
            body = json.dumps(answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Catalog)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        t = iceberg.table_from_rest(spark, "ice", f"http://127.0.0.1:{server.server_port}", "db", "ice", f"file://{root}/side")
        assert t.current == 812 and t.read().count() == 49
    finally:
        server.shutdown()


def test_damaged_manifests_are_refused():
    good = container(LIST, [text("m") + z(0)], False)
    assert iceberg.avro_records(good) == [{"manifest_path": "m", "content": 0}]
    for bad in (b"", b"nope" + good, good[:-3], good[:-16] + b"x" * 16):
        with pytest.raises(ValueError):
            iceberg.avro_records(bad)
