"""Token sequences in training order: fixed-stride shards that are read from first to last, or from any place on.

1. Every partition of the documents becomes a stream of token ids (an end-of-text id after each document), cut into sequences of
   SEQUENCE ids; the last of a partition is filled with end-of-text ids. Sequences are written with their place in the partition.
2. Counts by partition give each sequence a dense index. A keyed Feistel network over the next even power of two permutes the
   indices; a value beyond the last index walks the cycle until it lies within. So every sequence gets one global slot, no two the same, with
   no sort and no table of slots, and the order of training is a key. On their way sequences are compressed with a dictionary that the
   driver trains on DICTIONARY_ROWS rows at most; it changes no result, and a poor one costs only space.
3. Slot ranges of SHARD_ROWS (128 MB at two bytes an id) are shards, and a task writes a run of shards, one as long as there are no more
   than WRITE_TASKS, in order and with a fixed stride: slot s is at byte (s mod SHARD_ROWS) * stride of shard s div SHARD_ROWS. A reader
   that stopped after slot s goes on by one seek.

Cases. Null or empty text: its end-of-text id alone. Texts are tokenised whole and may span sequences. Equal rows are each written. Null
doc_id: listed as null among a sequence's documents. Empty tables: no shards, no rows. Other columns are not read. Ids take two bytes if the vocabulary
fits, else four.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, fresh_dir, no_null_text, written
from tessera.llm.files import WholeFile, open_read

SEQUENCE, SHARD_ROWS = 1024, 65536
WRITE_TASKS = 50_000
ROUNDS = 6
DICTIONARY_ROWS, DICTIONARY_BYTES = 1000, 1 << 17
KEY = 0x5DEECE66D

_SEQUENCES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
_PLACED = T.StructType([*_SEQUENCES.fields[2:], T.StructField("slot", T.LongType())])
_ROWS = T.StructType([
    T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("ids_sha256", T.StringType()), T.StructField("path", T.StringType()),
])


class Vocabulary:
    """A file of ranks: base64 of the bytes, and the id. The id after the last ends a text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.lines = f.read()
        self.pattern = pattern
        self.end = self.lines.count(b"\n") + (not self.lines.endswith(b"\n"))
        self.kind = "<u2" if self.end < 1 << 16 else "<u4"

    def encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}
        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def dictionary(docs: DataFrame, vocabulary: Vocabulary) -> bytes:
    """For compressing single sequences; empty if there are too few to learn from."""
    encode, ids = vocabulary.encoding().encode_ordinary, []
    for (text,) in docs.select(F.substring(no_null_text("text"), 1, 1 << 14)).take(DICTIONARY_ROWS):
        ids += encode(text)
    stream = np.array(ids, vocabulary.kind)
    samples = [stream[i : i + SEQUENCE].tobytes() for i in range(0, len(stream) - SEQUENCE, SEQUENCE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 100 else b""
    except zstandard.ZstdError:
        return b""


def _known(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def sequences(docs: DataFrame, vocabulary: Vocabulary, known: bytes = b"") -> DataFrame:
    """part, at (place in the partition), n_tokens, doc_ids (documents that begin or go on in it), packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        v = shared.value
        encode = v.encoding().encode_ordinary
        pack = zstandard.ZstdCompressor(level=9, dict_data=_known(known)).compress
        part, at = TaskContext.get().partitionId(), 0
        held, have, docs_held = [], 0, []

        def row(ids: np.ndarray, n: int, names: list) -> tuple:
            nonlocal at
            at += 1
            return (part, at - 1, n, names, pack(ids.tobytes()))

        for doc_ids, texts in batches:
            out = []
            for i, text in zip(doc_ids, texts):
                ids = np.array([*encode(text), v.end], v.kind)
                held.append(ids)
                have += len(ids)
                docs_held.append(i)
                if have >= SEQUENCE:
                    stream = np.concatenate(held)
                    for k in range(have // SEQUENCE):
                        out.append(row(stream[k * SEQUENCE : (k + 1) * SEQUENCE], SEQUENCE, docs_held if k == 0 else [i]))
                    rest = stream[have // SEQUENCE * SEQUENCE :]
                    held, have, docs_held = ([rest], len(rest), [i]) if len(rest) else ([], 0, [])
            yield out
        if have:
            ids = np.full(SEQUENCE, v.end, v.kind)
            ids[:have] = np.concatenate(held)
            yield [row(ids, have, docs_held)]

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null_text("text")), _SEQUENCES, rows)


def _round_keys(key: int) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little")) for i in range(ROUNDS)]


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of indices below n: a permutation of 0..n-1 chosen by key."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return left << half | right

    x = network(index.astype(np.uint64))
    while True:
        beyond = np.flatnonzero(x >= np.uint64(n))
        if not len(beyond):
            return x.astype(np.int64)
        x[beyond] = network(x[beyond])


def materialised(docs: DataFrame, vocabulary: Vocabulary, key: int = KEY) -> DataFrame:
    """Writes the shards; slot, shard, byte_offset, n_tokens, doc_ids, ids_sha256, path for each sequence."""
    spark = docs.sparkSession
    known = dictionary(docs, vocabulary)
    held = written(sequences(docs, vocabulary, known), "sequences")
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    starts = written(sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("start"), "n"), "starts")
    total = starts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _ROWS)
    indexed = held.join(starts.select("part", F.coalesce("start", F.lit(0)).alias("start")), "part").select("n_tokens", "doc_ids", "packed", (F.col("start") + F.col("at")).alias("index"))

    def slots(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for n_tokens, doc_ids, packed, index in batches:
            yield list(zip(n_tokens, doc_ids, packed, permuted(np.array(index), total, key).tolist()))

    placed = arrow_rows(indexed, _PLACED, slots)
    shards = (total + SHARD_ROWS - 1) // SHARD_ROWS
    tasks = min(shards, WRITE_TASKS)
    task = F.floor(F.floor(F.col("slot") / SHARD_ROWS) * tasks / shards).cast("int")
    dealt = placed.repartitionById(tasks, task).sortWithinPartitions("slot")
    folder, kind = fresh_dir(spark, "shards"), vocabulary.kind
    stride = SEQUENCE * np.dtype(kind).itemsize

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        unpack = zstandard.ZstdDecompressor(dict_data=_known(known)).decompress
        shard, out_file, waiting = -1, None, []

        def closed() -> list[tuple]:
            if out_file is None:
                return []
            path = out_file.done()
            return [(*x, path) for x in waiting]

        for n_tokens, doc_ids, packed, slot in batches:
            for n, ids, data, s in zip(n_tokens, doc_ids, packed, slot):
                if s // SHARD_ROWS != shard:
                    yield closed()
                    shard, out_file, waiting = s // SHARD_ROWS, WholeFile(folder, f"-{s // SHARD_ROWS:08d}.bin"), []
                plain = unpack(data)
                waiting.append((s, shard, out_file.size, n, ids, hashlib.sha256(plain).hexdigest()))
                out_file.write(plain)
                assert len(plain) == stride
        yield closed()

    return written(arrow_rows(dealt, _ROWS, rows), "shard-rows")


def read_from(manifest: dict[int, str], slot: int, total: int, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences of slots slot, slot + 1, ... in training order; manifest: paths by shard."""
    stride = SEQUENCE * np.dtype(kind).itemsize
    while slot < total:
        with open_read(manifest[slot // SHARD_ROWS]) as f:
            f.seek(slot % SHARD_ROWS * stride)
            for _ in range(min(total, (slot // SHARD_ROWS + 1) * SHARD_ROWS) - slot):
                yield np.frombuffer(f.read(stride), kind)
                slot += 1


def report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return materialised(docs, vocabulary).drop("path")
