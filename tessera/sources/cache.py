"""Scans that were read are kept, up to a number of bytes: a repeated scan reads nothing from its files."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tessera.sources.tablelog import Table


class ScanCache:
    """Columns of a set of immutable files, persisted on the executors, first in, first out. A file set never changes what it holds, so nothing
    goes stale; forget() drops what a table's vanished files still occupy."""

    def __init__(self, most_bytes: int = 1 << 30):
        self.most, self.held = most_bytes, OrderedDict()
        self.hits = self.misses = self.origin_bytes = 0

    def _size(self, table: Table, files: frozenset[str], columns: frozenset[str]) -> int:
        return sum(sum(table.files[f].columns.get(c, 0) for c in columns) or table.files[f].bytes for f in files)

    def read(self, table: Table, files: Iterable[str], columns: Iterable[str]) -> DataFrame:
        files, columns = frozenset(files), frozenset(columns) or frozenset(table.schema.names[:1])
        for (t, f, c), (df, _) in self.held.items():
            if t == table.id and f == files and columns <= c:
                self.hits += 1
                return df
        self.misses += 1
        size = self._size(table, files, columns)
        self.origin_bytes += size
        df = table.read(files).select(*[c for c in table.schema.names if c in columns])
        if size > self.most:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held[table.id, files, columns] = (df, size)
        while self.bytes > self.most:
            _, (old, _) = self.held.popitem(last=False)
            old.unpersist()
        return df

    @property
    def bytes(self) -> int:
        return sum(size for _, size in self.held.values())

    def forget(self, table: Table) -> None:
        live = frozenset(table.graph.get(table.current).files)
        for key in [k for k in self.held if k[0] == table.id and not k[1] <= live]:
            self.held.pop(key)[0].unpersist()
