"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with the seek table of the public seekable format (a
skippable frame with the sizes of all frames), so that any Zstandard reader can read it through and a reader that knows the table can
fetch one frame. The index, a written table, maps a record's identifier to bundle, frame and place within the frame. Identifiers hold the
page_id, the bundle's name and the record's number in it, so no two are equal.

Payloads are told apart by their digests. Digests of payloads that occur once never meet another row again; those that repeat carry their
latest page. Responses are written first, by one pass over the pages that never shuffles a payload: the table of repeats goes to all tasks if it is
smaller than BROADCAST_BYTES, and otherwise the narrow rows (digests, no payloads) are joined by shuffle and each task looks up which rows of its own
input file are revisits. Revisits are written then, from narrow rows alone, and name the response that they refer to by its identifier in the
index. Digests of more than HOT_ROWS rows are split off such joins and broadcast: there are at most all rows / HOT_ROWS of them.

Cases. Null html: an empty payload, always a response. Null url: an empty target. Rows of one page_id and payload are all responses if that
page_id is the largest; a null page_id is below all others, and among nulls alone all are responses. Of equal originals, a revisit names the one whose
identifier sorts first. Line breaks in a url become %0D and %0A. Empty tables give no bundles and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import HOT_ROWS, arrow_rows, fresh_dir, join_counted, written
from tessera.llm.files import WholeFile, open_read, read_table

LEAST_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 27
BROADCAST_BYTES = 8 << 20
#: Revisits looked up by input file, about so many in a bucket; at most so many bundles are dealt to tasks of their own.
BUCKET_ROWS, READ_TASKS = 1_000_000, 100_000
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

_INDEX = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("bundle", T.StringType()),
    T.StructField("frame", T.LongType()), T.StructField("frame_offset", T.LongType()), T.StructField("frame_bytes", T.LongType()), T.StructField("offset_in_frame", T.LongType()), T.StructField("record_bytes", T.LongType()),
])
_READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def record_id(page_id: int | None, bundle: str, place: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{bundle}:{place}>"


def _page_of(identifier: str) -> int | None:
    digits = identifier.split(":")[2]
    return int(digits) if digits else None


def record(id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response record, or with refers_to, the identifier of a response, a revisit record, which holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    kind = "WARC-Type: response\r\n" if refers_to is None else f"WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {refers_to}\r\n"
    head = f"WARC/1.1\r\n{kind}WARC-Record-ID: {id}\r\nWARC-Target-URI: {target}\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at a place: headers, HTTP header, payload, and where the next record starts."""
    stop = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    http = data.index(b"\r\n\r\n", begin, end) + 4
    return headers, data[begin:http], data[http:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Compressed and plain sizes of all frames, as a skippable frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(f) -> list[tuple[int, int]]:
    """Offset and size of each frame, from the footer."""
    f.seek(0, 2)
    end = f.tell()
    f.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(end - 9 - entry * count)
    table, out, at = f.read(entry * count), [], 0
    for i in range(count):
        size = struct.unpack_from("<I", table, i * entry)[0]
        out.append((at, size))
        at += size
    return out


def read_frame(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return zstandard.ZstdDecompressor().decompress(f.read(size))


def fetch(bundle: str, frame_offset: int, frame_bytes: int, offset_in_frame: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """One record by its index entry."""
    with open_read(bundle) as f:
        return parse(read_frame(f, frame_offset, frame_bytes), offset_in_frame)


def _narrow(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, digest, n (bytes) and columns of more; payloads stay where they are."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *more, F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))


def _repeats(pages: DataFrame) -> DataFrame:
    """digest, original (the largest page_id), rows of payloads that several rows have."""
    found = _narrow(pages).where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("rows"))
    return written(found.where("rows > 1 and original is not null"), "repeats")


def _is_revisit() -> F.Column:
    return F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("original")))


def _with_repeats(rows: DataFrame, repeats: DataFrame, how: str, few: bool) -> DataFrame:
    """rows joined to repeats (or a table like it) by digest; rows of hot digests don't move."""
    if few:
        return rows.join(F.broadcast(repeats), "digest", how)
    return join_counted(rows, repeats, ["digest"], "rows", how, HOT_ROWS)


def _looked_up(pages: DataFrame, repeats: DataFrame) -> DataFrame:
    """page_id, url, payload, digest of the responses, where repeats are too many to go to all tasks: the revisits' places are written by
    input file, and each task reads those of its own file."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    rows = pages.select("page_id", *place, "html")
    revisits = _with_repeats(_narrow(rows, "file", "place").where(F.col("n") >= LEAST_REVISIT), repeats, "inner", False).where(_is_revisit()).select("file", "place")
    buckets = repeats.agg(F.sum("rows")).first()[0] // BUCKET_ROWS + 1
    bucket = F.pmod(F.crc32(F.encode("file", "utf-8")), F.lit(buckets))
    path = fresh_dir(pages.sparkSession, "revisits")
    revisits.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("file").write.partitionBy("bucket").parquet(path)

    def kept(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        held: dict[str, frozenset[int]] = {}
        for columns in batches:
            out = []
            for page_id, url, payload, digest, file, at in zip(*columns):
                if file not in held:
                    held.clear()  # a task reads its files one after another
                    own = read_table(f"{path}/bucket={zlib.crc32(file.encode()) % buckets}", [("file", "=", file)])
                    held[file] = frozenset(own.column("place").to_pylist()) if own is not None else frozenset()
                if at not in held[file]:
                    out.append((page_id, url, payload, digest))
            yield out

    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), *place)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("digest", T.StringType())])
    return arrow_rows(whole, schema, kept)


def _responses(pages: DataFrame, repeats: DataFrame, few: bool) -> DataFrame:
    """page_id, url, payload, n, digest, refers_to (null) of all rows that are no revisits."""
    if few:
        payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
        rows = _with_repeats(rows, repeats, "left", True).where(~_is_revisit())
    else:
        rows = _looked_up(pages, repeats)
    return rows.select("page_id", "url", "payload", F.octet_length("payload").alias("n"), "digest", F.lit(None).cast("string").alias("refers_to"))


def _revisits(pages: DataFrame, repeats: DataFrame, index: DataFrame, few: bool) -> DataFrame:
    """page_id, url, payload (null), n, digest, refers_to of all revisits; index: of the responses."""
    of = index.select(F.col("payload_digest").alias("digest"), F.col("page_id").alias("original"), "record_id")
    originals = of.join(F.broadcast(repeats) if few else repeats, ["digest", "original"]).groupBy("digest", "original", "rows").agg(F.min("record_id").alias("refers_to"))
    rows = _narrow(pages.withColumn("url", F.col("url").cast("string")), "url").where(F.col("n") >= LEAST_REVISIT)
    return _with_repeats(rows, written(originals, "originals"), "inner", few).where(_is_revisit()).select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "n", "digest", "refers_to")


def _bundled(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records as bundles; the index entries."""

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        zstd = zstandard.ZstdCompressor(level=3)
        bundle: WholeFile | None = None
        frames: list[tuple[int, int]] = []
        entries: list[tuple] = []
        held: list[bytes] = []
        waiting: list[tuple] = []
        size = records_in = 0

        def frame() -> None:
            nonlocal size
            if not held:
                return
            plain = b"".join(held)
            packed = zstd.compress(plain)
            entries.extend((*who, len(frames), bundle.size, len(packed), at, n) for who, at, n in waiting)
            bundle.write(packed)
            frames.append((len(packed), len(plain)))
            held.clear()
            waiting.clear()
            size = 0

        def closed() -> list[tuple]:
            nonlocal bundle, records_in
            frame()
            if bundle is None:
                return []
            bundle.write(seek_table(frames))
            path = bundle.done()
            out = [(*who, path, *more) for *who, no, offset, packed, at, n in entries for more in [(no, offset, packed, at, n)]]
            bundle, records_in = None, 0
            frames.clear()
            entries.clear()
            return out

        for columns in batches:
            for page_id, url, payload, n, digest, refers_to in zip(*columns):
                bundle = bundle or WholeFile(folder, ".warc.zst")
                id = record_id(page_id, bundle.name, records_in)
                data = record(id, url, payload, n, digest, refers_to)
                waiting.append(((page_id, id, "response" if refers_to is None else "revisit", digest), size, len(data)))
                held.append(data)
                size += len(data)
                records_in += 1
                if size >= FRAME_BYTES:
                    frame()
                    if bundle.size >= BUNDLE_BYTES:
                        yield closed()
        yield closed()

    return written(arrow_rows(records.select("page_id", "url", "payload", "n", "digest", "refers_to"), _INDEX, rows), "warc-index")


def write(pages: DataFrame) -> DataFrame:
    """Writes the bundles and returns the index."""
    folder = fresh_dir(pages.sparkSession, "warc")
    repeats = _repeats(pages)
    n = repeats.count()
    few = n * 100 <= BROADCAST_BYTES
    if not few:
        try:
            pages.select("_metadata.row_index")
        except AnalysisException:  # no scan of files: rows have no lasting places
            pages = written(pages.select("page_id", "url", "html"), "pages")
    responses = _bundled(_responses(pages, repeats, few), folder)
    return responses.unionByName(_bundled(_revisits(pages, repeats, responses, few), folder)) if n else responses


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, read frame by frame by their seek tables, a bundle a task; digests are made anew from payloads."""

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for (bundles,) in batches:
            for path in bundles:
                with open_read(path) as f:
                    for offset, size in frames_of(f):
                        data, at, out = read_frame(f, offset, size), 0, []
                        while at < len(data):
                            headers, http, payload, at = parse(data, at)
                            page = _page_of(headers["WARC-Record-ID"])
                            if headers["WARC-Type"] == "response":
                                out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                            else:
                                n = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                                out.append((page, n, headers["WARC-Payload-Digest"][len("sha1:") :], "revisit", _page_of(headers["WARC-Refers-To"])))
                        yield out

    bundles = written(index.select("bundle").distinct(), "bundles")
    # a number of partitions that is given is not coalesced
    return arrow_rows(bundles.repartition(max(1, min(bundles.count(), READ_TASKS))), _READ, rows)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    return read(write(pages))


#: The same rows by SQL.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p),
m as (select payload_digest, max(page_id) as original from d group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id < original then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < original then original end as refers_to
from d join m using (payload_digest)
"""
