"""Files that operators write and read themselves, in any store: named once, written whole, then put in place."""

from __future__ import annotations

import os
import uuid
from typing import IO
from urllib.parse import unquote, urlparse


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("file", "") else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class WholeFile:
    """A file under a name of its own. Only a caller that gets to done() learns the name, so what a lost attempt has left is never read."""

    def __init__(self, folder: str, suffix: str):
        self.name = uuid.uuid4().hex
        self.path = f"{folder}/{self.name}{suffix}"
        local = _local(self.path)
        if local is not None:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            self._out: IO[bytes] = open(local, "wb")  # noqa: SIM115
        else:
            store, name = _store(self.path)
            self._out = store.open_output_stream(name)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def done(self) -> str:
        self._out.close()
        return self.path


def open_read(path: str) -> IO[bytes]:
    """A seekable file."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")  # noqa: SIM115
    store, name = _store(path)
    return store.open_input_file(name)


def read_table(folder: str, filters: list[tuple]):
    """The rows of a small Parquet folder that pass, as an Arrow table; None if there is no such folder."""
    from pyarrow import fs, parquet

    store, name = (fs.LocalFileSystem(), _local(folder)) if _local(folder) is not None else _store(folder)
    if store.get_file_info(name).type is not fs.FileType.Directory:
        return None
    return parquet.read_table(name, filesystem=store, filters=filters, partitioning=None)
