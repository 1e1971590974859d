"""What the operators of this subpackage share: working storage, Arrow batches, hashing of word sequences."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes to Python; long texts make a batch of thousands too large.
BATCH_ROWS = 512

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). A temporary one of our own only where that is unset and all is
    one machine, as in tests."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dir


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """As written(); the job's shuffle files go when it ends, not when the driver next collects its garbage. Jobs that other threads run on this
    session meanwhile may lose theirs as well, which costs them time only."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return written(df, label)
    finally:
        conf.set(name, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() wrote, once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: From so many rows on, a join key is hot. There are at most all rows / HOT_ROWS of such keys.
HOT_ROWS = 200_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """rows joined to counted, which has a row for each key and in n the number of rows of that key: rows of hot keys stay where they are and
    meet a broadcast table of those keys, the others are shuffled. how: inner or left."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    hot = F.broadcast(counted.where(F.col(n) > hot_rows))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counted.where(F.col(n) <= hot_rows), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def use_small_batches(spark: SparkSession) -> None:
    """Spark takes the batch size from the session when a plan runs, so the session's setting is lowered; a lower one is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_rows(df: DataFrame, schema: StructType, rows_of: Callable[[Iterator[list[list]]], Iterator[list[tuple]]]) -> DataFrame:
    """rows_of gets the columns of each batch as lists and yields lists of result rows."""
    use_small_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of([c.to_pylist() for c in b.columns] for b in batches):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def no_null_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


# Sequences of words are hashed with numpy over the whole text at once: each byte has a random 64-bit value, a word's hash
# is the polynomial of its bytes modulo 2^64, and a finaliser mixes it.
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes, is_word: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of raw in order; is_word says of each of the 256 bytes whether it belongs to a word."""
    if not raw:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; of a shorter text, of all its words as one."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(mixed(h))


def byte_class(separators: bytes) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


#: Words [^\x20\x09-\x0D]+.
NOT_SPACE = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
