"""Tables as immutable Parquet files under a log of snapshots: one JSON document a commit, listed and read through Spark's file systems.

A document says what a commit adds and removes. Every CHECKPOINT_EVERY commits a checkpoint holds the lineage and all live files, so
opening a table reads one checkpoint and the documents behind it; the files of older snapshots are put together when somebody asks for them.

Documents are created exclusively: of two writers one gets the number, the other catches up and commits behind it, or fails with
CommitConflict if what it replaces has changed in the meantime. On local disks a hard link decides, on HDFS a rename that never overwrites; object
stores must have conditional writes switched on. Data files of a lost attempt are named by no document and never read.

Writes are copy-on-write: deleting rows replaces files, so no reader has to apply delete files; delete fingerprints of tables that come from
elsewhere are still kept and compared.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.model import Commits, Diff, Snapshot, SnapshotGraph

#: Of a column with a file's path, what bare() leaves; without regular expressions, which would cost more than the scan itself.
BARE = "CASE WHEN locate('://', {0}) > 0 THEN substr({0}, locate('/', {0}, locate('://', {0}) + 3)) WHEN locate(':/', {0}) > 0 THEN substr({0}, locate(':/', {0}) + 1) ELSE {0} END"
CHECKPOINT_EVERY = 50
#: Footers of more files than this are read by Spark tasks.
FOOTERS_HERE = 64
#: Options by which scans in a plan are known again: the handle of the table, and whether it is an empty shape.
TABLE_OPTION, SHAPE_OPTION = "tessera.table", "tessera.shape"


def bare(path: str) -> str:
    """A path without scheme and authority: what identifies a file."""
    u = urlparse(path)
    return unquote(u.path) if u.scheme else path


class CommitConflict(RuntimeError):
    """Another writer has changed what this commit would replace."""


class Store:
    """Small files through Hadoop's file systems, whatever the store."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, p, fs, text: str, overwrite: bool = True) -> None:
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _staged(self, path: str, fs, text: str):
        """Beside path, where a listing of its folder doesn't come."""
        folder, name = path.rsplit("/", 1)
        tmp, _ = self._fs(f"{folder}/_staged/{name}.{uuid.uuid4().hex}")
        self._put(tmp, fs, text)
        return tmp

    def write(self, path: str, text: str) -> None:
        """Puts a document in place, over an older one."""
        p, fs = self._fs(path)
        tmp = self._staged(path, fs, text)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)

    def create(self, path: str, text: str) -> bool:
        """Puts a document in place unless there is one; whether it did. Of any number of writers at once one succeeds."""
        p, fs = self._fs(path)
        kind = fs.getUri().getScheme()
        jvm = self.spark._jvm
        if fs.exists(p):
            return False
        if kind not in ("file", "hdfs", "viewfs"):
            try:
                self._put(p, fs, text, overwrite=False)
            except Exception as e:
                if fs.exists(p):
                    return False
                raise OSError(f"cannot create {path}") from e
            return True
        tmp = self._staged(path, fs, text)
        try:
            if kind == "file":
                local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
                try:
                    jvm.java.nio.file.Files.createLink(local(p), local(tmp))
                except Exception:
                    if fs.exists(p):
                        return False
                    raise
                return True
            if fs.rename(tmp, p):
                return True
            if fs.exists(p):
                return False
            raise OSError(f"cannot create {path}")
        finally:
            fs.delete(tmp, False)

    def read_bytes(self, path: str) -> bytes:
        p, fs = self._fs(path)
        f = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def read(self, path: str) -> str:
        return self.read_bytes(path).decode()

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def list(self, path: str, deep: bool = True) -> list[tuple[str, int]]:
        """Files below path, or just in it, and their sizes."""
        p, fs = self._fs(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, deep)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def delete(self, path: str) -> int:
        """Files deleted; counts only what was there."""
        n = len(self.list(path))
        p, fs = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)
        return n


@dataclass
class DataFile:
    path: str
    bytes: int
    rows: int
    groups: int = 1
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    columns: dict[str, int] = field(default_factory=dict)
    deletes: int = 0


def _footers_here(store: Store, paths: Iterable[tuple[str, int]]) -> list[DataFile]:
    out = []
    jvm, conf = store.spark._jvm, store.spark._jsc.hadoopConfiguration()
    for path, size in paths:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
        try:
            blocks = reader.getFooter().getBlocks()
            bounds: dict[str, tuple[float, float] | None] = {}
            columns: dict[str, int] = {}
            for b in range(blocks.size()):
                chunks = blocks.get(b).getColumns()
                for c in range(chunks.size()):
                    chunk = chunks.get(c)
                    name = chunk.getPath().toDotString()
                    columns[name.split(".")[0]] = columns.get(name.split(".")[0], 0) + chunk.getTotalSize()
                    stats, kind = chunk.getStatistics(), str(chunk.getPrimitiveType().getPrimitiveTypeName())
                    known = kind in _BOUNDED and stats is not None and stats.hasNonNullValue()
                    _widen(bounds, name, (float(stats.genericGetMin()), float(stats.genericGetMax())) if known else None)
            out.append(DataFile(path, size, sum(blocks.get(i).getRowCount() for i in range(blocks.size())), blocks.size(), {k: v for k, v in bounds.items() if v}, columns))
        finally:
            reader.close()
    return out


#: Parquet's physical types that have numeric bounds.
_BOUNDED = ("INT32", "INT64", "FLOAT", "DOUBLE")


def _widen(bounds: dict[str, tuple[float, float] | None], name: str, new: tuple[float, float] | None) -> None:
    old = bounds.get(name, new)
    bounds[name] = None if old is None or new is None else (min(new[0], old[0]), max(new[1], old[1]))


def _footer(path: str, size: int) -> DataFile:
    """As a Spark task reads it."""
    from pyarrow import fs, parquet

    store, name = fs.FileSystem.from_uri(path)
    meta = parquet.read_metadata(name, filesystem=store)
    bounds: dict[str, tuple[float, float] | None] = {}
    columns: dict[str, int] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            name, stats = chunk.path_in_schema, chunk.statistics
            columns[name.split(".")[0]] = columns.get(name.split(".")[0], 0) + chunk.total_compressed_size
            known = chunk.physical_type in _BOUNDED and stats is not None and stats.has_min_max
            _widen(bounds, name, (float(stats.min_raw), float(stats.max_raw)) if known else None)
    return DataFile(path, size, meta.num_rows, meta.num_row_groups, {k: v for k, v in bounds.items() if v}, columns)


def footers(store: Store, paths: Iterable[tuple[str, int]], here: int = FOOTERS_HERE) -> list[DataFile]:
    """Rows, row groups, numeric bounds and bytes by column from Parquet footers: of a few files here, of many by Spark tasks.

    No data pages are read. A column without statistics in some group has no bounds.
    """
    paths = list(paths)
    if len(paths) <= here:
        return _footers_here(store, paths)

    def tasks(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc": [json.dumps(asdict(_footer(p, n))) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]})

    rows = store.spark.createDataFrame(paths, "path string, size long").repartition(min(len(paths) // 16 + 1, 10_000)).mapInArrow(tasks, "doc string")
    return sorted((_file(json.loads(r[0])) for r in rows.collect()), key=lambda f: f.path)


def _file(doc: dict) -> DataFile:
    return DataFile(**(doc | {"bounds": {k: tuple(v) for k, v in doc["bounds"].items()}}))


class LazyFiles(Mapping):
    """The live files of a snapshot, put together on first use."""

    __slots__ = ("_held", "_load")

    def __init__(self, load: Callable[[], dict[str, int]], held: dict[str, int] | None = None):
        self._load, self._held = load, held

    @property
    def held(self) -> dict[str, int]:
        if self._held is None:
            self._held = self._load()
        return self._held

    @property
    def known(self) -> bool:
        return self._held is not None

    def __getitem__(self, file: str) -> int:
        return self.held[file]

    def __contains__(self, file: object) -> bool:
        return file in self.held

    def __iter__(self) -> Iterator[str]:
        return iter(self.held)

    def __len__(self) -> int:
        return len(self.held)

    def keys(self):
        return self.held.keys()


@dataclass(frozen=True)
class Totals:
    """Sums over the live files of a snapshot, made once."""

    files: int
    bytes: int
    columns: dict[str, int]
    folders: frozenset[str]

    def of(self, columns: Iterable[str]) -> int:
        """Bytes of some columns; of whole files where footers don't tell columns apart."""
        columns = list(columns)
        return sum(self.columns.get(c, 0) for c in columns) if columns and self.columns else self.bytes


class Table:
    """One table: its log, its files, and DataFrames over them."""

    def __init__(self, spark: SparkSession, name: str, root: str, commits: Commits | None = None):
        self.spark, self.name, self.root = spark, name, root.rstrip("/")
        self.handle = uuid.uuid4().hex
        self.store, self.commits = Store(spark), commits or Commits()
        self.graph = SnapshotGraph()
        self.files: dict[str, DataFile] = {}
        self.id, self.schema, self.current = uuid.uuid4().hex, StructType(), None
        self.fields: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.pinned = False
        self._docs: dict[int, dict] = {}
        self._checkpoints: list[int] = []
        self._totals: dict[int, tuple[list[DataFile], Totals]] = {}
        self._sides: dict[str, DataFrame] = {}
        self._side_schemas: dict[str, StructType] = {}
        self._shape: DataFrame | None = None

    # reading the log

    @classmethod
    def open(cls, spark: SparkSession, name: str, root: str, at: int | None = None, commits: Commits | None = None) -> Table:
        """The table as its log has it; at a snapshot if one is given, and then the first commit starts a branch there."""
        t = cls(spark, name, root, commits)
        t.catch_up()
        if at is not None and at not in t.graph:
            raise KeyError(f"no snapshot {at}")
        t.current, t.pinned = (max((s.id for s in t.graph), default=None), False) if at is None else (at, True)
        return t

    def _document(self, id: int, suffix: str = "") -> str:
        return f"{self.root}/_log/{id:012d}{suffix}.json"

    def catch_up(self) -> list[int]:
        """Reads what others have committed; current stays. The snapshots that were new."""
        found = [p.rsplit("/", 1)[-1] for p, _ in self.store.list(f"{self.root}/_log", deep=False) if p.endswith(".json")]
        self._checkpoints = sorted(int(n.split(".")[0]) for n in found if n.endswith(".checkpoint.json"))
        ids = sorted(int(n.split(".")[0]) for n in found if not n.endswith(".checkpoint.json"))
        if not len(self.graph) and self._checkpoints:
            doc = self._checkpoint(self._checkpoints[-1])
            for id, parent in doc["lineage"]:
                self._known(id, parent)
        new = [i for i in ids if i not in self.graph]
        for id in new:
            doc = self._doc(id)
            self.id, self.schema, self.fields = doc["table"], StructType.fromJson(doc["schema"]), doc["fields"]
            self._known(id, doc["parent"])
            if doc.get("batch"):
                self._note_batch(*doc["batch"])
        return new

    def _note_batch(self, stream: str, number: int) -> None:
        self.batches[stream] = max(number, self.batches.get(stream, number))

    def _known(self, id: int, parent: int | None) -> None:
        if id not in self.graph:
            self.graph.add(Snapshot(id, parent, LazyFiles(lambda: self._put_together(id))))

    def _doc(self, id: int) -> dict:
        """What a commit adds and removes."""
        if id not in self._docs:
            doc = self._docs[id] = json.loads(self.store.read(self._document(id)))
            for f in doc["add"]:
                self.files[bare(f["path"])] = _file(f)
        return self._docs[id]

    def _checkpoint(self, id: int) -> dict:
        doc = json.loads(self.store.read(self._document(id, ".checkpoint")))
        self.id, self.schema, self.fields = doc["table"], StructType.fromJson(doc["schema"]), doc["fields"]
        for stream, number in doc["batches"].items():
            self._note_batch(stream, number)
        for f in doc["files"]:
            self.files.setdefault(bare(f["path"]), _file(f))
        parent = next(p for i, p in doc["lineage"] if i == id)
        self.graph.add(Snapshot(id, parent, LazyFiles(dict, {bare(f["path"]): f["deletes"] for f in doc["files"]})))
        return doc

    def _put_together(self, id: int) -> dict[str, int]:
        """From the nearest snapshot before id whose files are known, or the checkpoint there, on."""
        chain, at = [], id
        while at is not None:
            if at != id and self.graph.get(at).files.known:
                break
            if at in self._checkpoints:
                self._checkpoint(at)
                break
            chain.append(at)
            at = self.graph.get(at).parent
        files = dict(self.graph.get(at).files) if at is not None else {}
        for i in reversed(chain):
            doc = self._doc(i)
            for f in doc["remove"]:
                files.pop(f, None)
            files |= {bare(f["path"]): f["deletes"] for f in doc["add"]}
        return files

    def _summed(self, snapshot: int | None) -> tuple[list[DataFile], Totals]:
        snapshot = self.current if snapshot is None else snapshot
        if snapshot not in self._totals:
            live = [self.files[f] for f in sorted(self.graph.get(snapshot).files)]
            columns: dict[str, int] = {}
            for f in live:
                for c, n in f.columns.items():
                    columns[c] = columns.get(c, 0) + n
            self._totals[snapshot] = (live, Totals(len(live), sum(f.bytes for f in live), columns, frozenset(f.path.rsplit("/", 1)[0] for f in live)))
        return self._totals[snapshot]

    def live(self, snapshot: int | None = None) -> list[DataFile]:
        return self._summed(snapshot)[0]

    def totals(self, snapshot: int | None = None) -> Totals:
        return self._summed(snapshot)[1]

    @property
    def bytes(self) -> int:
        return self.totals().bytes

    def read(self, files: Iterable[str] | None = None, snapshot: int | None = None) -> DataFrame:
        """A scan of some files, or of all that live; of none, an empty relation of the same columns."""
        paths = [f.path for f in self.live(snapshot)] if files is None else [self.files[f].path for f in sorted(files)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option(TABLE_OPTION, self.handle).parquet(*paths)

    def located(self, files: Iterable[str] | None = None) -> DataFrame:
        """A scan with each row's file and place in it, as _file and _row."""
        df = self.read(files)
        if not self.live() if files is None else not list(files):
            return df.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_row"))
        return df.select("*", F.expr(BARE.format("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def side(self, path: str) -> DataFrame:
        """A side table; its files are listed once, since it never changes, and its schema is read if nobody has told it."""
        if path not in self._sides:
            reader = self.spark.read.schema(self._side_schemas[path]) if path in self._side_schemas else self.spark.read
            self._sides[path] = reader.parquet(path)
        return self._sides[path]

    def know_side(self, path: str, schema: StructType) -> None:
        """To be called when path has been written, or written again."""
        self._sides.pop(path, None)
        self._side_schemas[path] = schema

    def shape(self) -> DataFrame:
        """No rows: what a name is bound to while a query is planned, so that planning looks at no data file."""
        if self._shape is None:
            path = f"{self.root}/shape"
            if not self.store.exists(f"{path}/_SUCCESS"):
                self.spark.createDataFrame([], self.schema).coalesce(1).write.mode("overwrite").parquet(path)
            self._shape = self.spark.read.schema(self.schema).option(TABLE_OPTION, self.handle).option(SHAPE_OPTION, "true").parquet(path)
        return self._shape

    # writing

    def _added(self, df: DataFrame) -> list[DataFile]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return footers(self.store, [(p, n) for p, n in self.store.list(folder) if p.endswith(".parquet")])

    def _change(self, add: Iterable[DataFile] = (), remove: Iterable[str] = (), parent: int | None = None, batch: tuple[str, int] | None = None, fits: Callable[[Diff], bool] = lambda diff: True) -> int:
        """Commits behind parent, or behind current and what others have put there since, if that fits."""
        add, remove = list(add), sorted(remove)
        onto = self.current if parent is None else parent
        while True:
            if parent is None and onto is not None and not self.pinned and (line := [s.id for s in self.graph if s.id > onto and self.graph.descends(s.id, onto)]):
                if not fits(self.graph.diff(onto, line[-1])):
                    raise CommitConflict(f"{self.name}: up to snapshot {line[-1]}, others have changed what this commit replaces")
                onto = line[-1]
            id = max((s.id for s in self.graph), default=0) + 1
            doc = {"table": self.id, "snapshot": id, "parent": onto, "schema": self.schema.jsonValue(), "fields": self.fields, "add": [asdict(f) for f in add], "remove": remove, "batch": batch}
            if self.store.create(self._document(id), json.dumps(doc)):
                break
            if onto is None:
                raise CommitConflict(f"{self.root} holds a table by now")
            self.catch_up()
            if batch and self.batches.get(batch[0], -1) >= batch[1]:
                self.current = max(s.id for s in self.graph)
                return self.current
        self._docs[id] = doc
        for f in add:
            self.files[bare(f.path)] = f
        self._known(id, onto)
        if batch:
            self._note_batch(*batch)
        self.current, self.pinned = id, False
        self.commits.note(self.name, id)
        if id % CHECKPOINT_EVERY == 0:
            marks = self.graph.get(id).files
            files = [asdict(replace(self.files[f], deletes=marks[f])) for f in sorted(marks)]
            body = {"table": self.id, "schema": self.schema.jsonValue(), "fields": self.fields, "lineage": [[s.id, s.parent] for s in self.graph], "batches": self.batches, "files": files}
            self.store.write(self._document(id, ".checkpoint"), json.dumps(body))
            self._checkpoints.append(id)
        return id

    def commit(self, files: Iterable[DataFile], parent: int | None = None) -> int:
        """A snapshot of just these files."""
        onto = self.current if parent is None else parent
        before = dict(self.graph.get(onto).files) if onto is not None else {}
        after = {bare(f.path): f for f in files}
        gone = before.keys() - after.keys()
        return self._change((f for p, f in after.items() if before.get(p, -1) != f.deletes), gone, parent, fits=lambda diff: diff.empty)

    @classmethod
    def create(cls, df: DataFrame, name: str, root: str, commits: Commits | None = None) -> Table:
        """A new table; each of df's partitions becomes a file. Columns get field ids unless they have some in their metadata."""
        t = cls(df.sparkSession, name, root, commits)
        if t.store.list(f"{t.root}/_log", deep=False):
            raise FileExistsError(f"{root} holds a table")
        t.schema = df.schema
        t.fields = {f.name: f.metadata.get("field_id", i) for i, f in enumerate(df.schema, 1)}
        t._change(t._added(df))
        return t

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """batch: a stream and the number of its batch, committed with the rows; a number that is there already isn't committed again."""
        if batch and self.batches.get(batch[0], -1) >= batch[1]:
            return self.current
        return self._change(self._added(df.select(*self.schema.names)), batch=batch)

    def compact(self, files: Iterable[str], into: int = 1) -> int:
        """Replaces files by fewer with the same rows."""
        gone = frozenset(files)
        return self._change(self._added(self.read(gone).coalesce(into)), gone, fits=lambda diff: not gone & (diff.removed | diff.redeleted))

    def delete_where(self, condition: str) -> int:
        """Copy-on-write: files that hold such rows are replaced."""
        hit = frozenset(bare(r[0]) for r in self.read().where(condition).select("_metadata.file_path").distinct().collect()) if self.live() else frozenset()
        if not hit:
            return self._change(fits=lambda diff: not diff.added)
        kept = self.read(hit).where(~F.coalesce(F.expr(condition), F.lit(False)))
        return self._change(self._added(kept), hit, fits=lambda diff: not diff.added and not hit & (diff.removed | diff.redeleted))

    def mark_deletes(self, fingerprints: dict[str, int]) -> int:
        """A commit in which another writer's deletes on files have changed."""
        marked = [replace(f, deletes=fingerprints[bare(f.path)]) for f in self.live() if bare(f.path) in fingerprints]
        return self._change(marked, fits=lambda diff: not fingerprints.keys() & diff.removed)

    def branch(self, parent: int, df: DataFrame) -> int:
        """A commit on another line: parent's files and df's."""
        return self._change(self._added(df), parent=parent)

    def diff(self, since: int) -> Diff | None:
        return self.graph.diff(since, self.current)

    def orphans(self, older_than_s: float = 7 * 86_400) -> list[str]:
        """Data folders that no snapshot names, left by attempts that were lost or refused. Young ones may belong to a commit that is under way."""
        self.catch_up()
        for s in self.graph:
            len(s.files)  # puts the snapshot's files together, so that all are known
        named = {f.rsplit("/", 1)[0] for f in self.files}
        p, fs = self.store._fs(f"{self.root}/data")
        if not fs.exists(p):
            return []
        now = time.time()
        return sorted(x.getPath().toString() for x in fs.listStatus(p) if bare(x.getPath().toString()) not in named and now - x.getModificationTime() / 1000 >= older_than_s)

    def reclaim(self, older_than_s: float = 7 * 86_400) -> int:
        """Deletes the orphans; counts their files."""
        return sum(self.store.delete(x) for x in self.orphans(older_than_s))
