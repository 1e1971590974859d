"""Benchmark decontamination with suffix arrays over the training words.

Each partition of the documents is cut into shards of whole documents. A shard's words are numbered by the benchmark's
vocabulary; runs of known words that are long enough to hold a window are laid end to end and sorted into a suffix
array (a suffix that starts with an unknown word matches nothing, so it needs no place). Every suffix of every benchmark
item is then searched by bisection in every shard: the search over the whole suffix gives its longest verbatim match and
the place, the search over its window gives all places where the window occurs.

The benchmark is the query set. Tasks cut it into blocks of about ``block_bytes`` of text, number their words, and write them to the shared
folder; neither the driver nor a broadcast ever holds it. A task that searches reads one block at a time for each of its shards, and keeps the
last one: with one block it reads it once. The documents are passed over once and never shuffled.

Cases. Null or blank text: no words, no hits. Null or wordless items match nothing; a null item_id counts as an item and is
written as an empty string. Equal rows are returned each. Items with equal texts are found each. Empty tables give no
rows or no hits. Other columns are not read. Each document's longest match is exact; of equally long ones any may be named.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, fresh_dir, no_null_text, written
from tessera.llm.files import WholeFile, open_read

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Words of documents in a shard (a longer document is a shard of its own).
SHARD_WORDS = 2_000_000

#: Bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lowering A-Z.
_SPACES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


class Block:
    """Benchmark items as numbered words: what a search needs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.full = window
        self.names = [name for name, _ in items]
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        codes, self.item, self.offset, self.window = [], [], [], []
        windows: dict[tuple[int, ...], int] = {}
        self.holders: list[list[int]] = []
        seen: list[set[int]] = []
        self.window_id = []
        for i, (_, words) in enumerate(items):
            ids = [number(w) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids)):
                whole = at + size <= len(ids)
                key = windows.setdefault(tuple(ids[at : at + size]), len(windows)) if whole else -1
                if whole:
                    if key == len(self.holders):
                        self.holders.append([])
                        seen.append(set())
                    if i not in seen[key]:
                        seen[key].add(i)
                        self.holders[key].append(i)
                self.item.append(i)
                self.offset.append(len(codes) + at)
                self.window.append(size)
                self.window_id.append(key)
            codes += [*ids, 0]
        self.codes = np.array([*codes, 0], np.int64)
        self.item, self.offset, self.window, self.window_id = (np.array(x, np.int64) for x in (self.item, self.offset, self.window, self.window_id))
        ends = np.flatnonzero(self.codes == 0)
        self.length = ends[np.searchsorted(ends, self.offset)] - self.offset if len(self.offset) else self.offset
        self.start = np.array([], np.int64) if not len(self.offset) else self.offset - np.concatenate([[0], ends + 1])[np.searchsorted(ends, self.offset)]
        self.least = int(self.window.min()) if len(self.window) else 0
        self.longest = int(self.length.max()) if len(self.length) else 0
        # the items' own suffixes in order, to ask how far a match in a document goes
        self.order = suffix_array(self.codes, self.longest + 1) if len(self.offset) else self.offset
        self.order = self.order[self.codes[self.order] > 0] if len(self.offset) else self.order
        # each window once, for the search of all its places
        self.unique, first = np.unique(self.window_id, return_index=True)
        keep = self.unique >= 0
        self.unique, self.first = self.unique[keep], first[keep]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places in codes sorted by the words that follow, up to depth words, by doubling."""
    rank = codes.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    have = 1
    while have < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-have] = rank[have:] if have < len(rank) else 0
        key = rank * (int(max(rank.max(), after.max())) + 1) + after
        order = np.argsort(key, kind="stable")
        by = key[order]
        rank_new = np.empty(len(rank), np.int64)
        rank_new[order] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
        rank = rank_new
        have *= 2
        if have >= len(rank) or rank.max() == len(rank) - 1:
            break
    return order


def _common(text: np.ndarray, at: np.ndarray, query: np.ndarray, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Words that text from at and query from q share, limit at most; text ends in zeros, which match nothing."""
    n = np.zeros(len(at), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        d = n[live]
        same = text[np.minimum(at[live] + d, len(text) - 1)] == query[q[live] + d]
        live = live[same]
        n[live] += 1
        live = live[n[live] < limit[live]]
    return n


def _bisect(text: np.ndarray, order: np.ndarray, query: np.ndarray, q: np.ndarray, limit: np.ndarray, right: bool) -> np.ndarray:
    """For each query (limit words from q), the first place in order that isn't below it, or with right, that is above it."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        at = order[mid]
        n = _common(text, at, query, q[live], limit[live])
        done = n >= limit[live]
        below = text[np.minimum(at + n, len(text) - 1)] < np.where(done, 0, query[np.minimum(q[live] + n, len(query) - 1)])
        go = np.where(done, right, below)
        lo[live[go]] = mid[go] + 1
        hi[live[~go]] = mid[~go]


def search(shard: list[np.ndarray], block: Block) -> list[tuple[int, list[int], list[int], tuple[int, int, int, int]]]:
    """Per document with words: hit words, item numbers, longest match (words, item, place in item, place in document)."""
    out = []
    sizes = np.array([len(x) for x in shard], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.concatenate(shard) if shard else np.empty(0, np.int64)
    # runs of known words within a document; runs too short for any window need no place
    known = np.zeros(len(codes) + 1, bool)
    known[:-1] = codes > 0
    cut = np.zeros(len(codes) + 1, bool)
    cut[base[:-1][base[:-1] < len(codes)]] = True
    begins = np.flatnonzero(known & (cut | ~np.concatenate([[False], known[:-1]])))
    stops = np.flatnonzero(~known | cut)
    ends = stops[np.searchsorted(stops, begins, "right")] if len(begins) else begins
    long = (ends - begins) >= max(1, block.least)
    begins, ends = begins[long], ends[long]
    empty = [(np.empty(0, np.int64), [], (0, -1, -1, -1))] * len(shard)
    if not len(begins) or not len(block.offset):
        return empty
    lengths = ends - begins
    spot = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int((lengths + 1).sum()))
    text = codes[np.minimum(spot, len(codes) - 1)].copy()
    text[np.cumsum(lengths + 1) - 1] = 0
    text = np.append(text, 0)
    spot = np.append(spot, len(codes))
    order = suffix_array(text, block.longest + 1)
    order = order[text[order] > 0]
    # the longest match of every suffix, at a neighbour of where it would stand
    q, limit = block.offset, block.length
    stand = _bisect(text, order, block.codes, q, limit, False)
    best: dict[int, tuple[int, int, int, int]] = {}
    doc_of = lambda places: np.searchsorted(base, places, "right") - 1
    # all places of every window
    w = block.first
    lo = _bisect(text, order, block.codes, q[w], block.window[w], False)
    hi = _bisect(text, order, block.codes, q[w], block.window[w], True)
    count = hi - lo
    who = np.repeat(np.arange(len(w)), count)
    places = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))] if count.sum() else np.empty(0, np.int64)
    spread = np.zeros(len(codes) + 1, np.int64)
    real = spot[places]
    np.add.at(spread, real, 1)
    np.add.at(spread, real + block.window[w][who], -1)
    hit = np.cumsum(spread)[:-1] > 0
    for stand_at in (np.maximum(stand - 1, 0), np.minimum(stand, len(order) - 1)):
        at = order[stand_at]
        n = _common(text, at, block.codes, q, limit)
        for j in np.flatnonzero(n >= block.window):
            d = int(doc_of(spot[at[j]]))
            mine = (int(n[j]), int(block.item[j]), int(block.start[j]), int(spot[at[j]] - base[d]))
            if d not in best or (-mine[0], *mine[1:]) < (-best[d][0], *best[d][1:]):
                best[d] = mine
    docs = doc_of(real)
    # of a document whose matches others surpass: how far each of its places goes, at a neighbour among the items' suffixes
    short = block.window[block.first[who]] < block.full  # of items that are shorter than a window a neighbour may be another's end
    for j, d, place in zip(*(x[short].tolist() for x in (block.first[who], docs, real))):
        mine = (int(block.window[j]), int(block.item[j]), int(block.start[j]), place - int(base[d]))
        if d not in best or (-mine[0], *mine[1:]) < (-best[d][0], *best[d][1:]):
            best[d] = mine
    here = np.unique(places)
    if len(here):
        zeros = np.flatnonzero(text == 0)
        room = zeros[np.searchsorted(zeros, here)] - here
        stand = _bisect(block.codes, block.order, text, here, room, False)
        for stand_at in (np.maximum(stand - 1, 0), np.minimum(stand, len(block.order) - 1)):
            at = block.order[stand_at]
            n = _common(block.codes, at, text, here, room)
            j = np.searchsorted(block.offset, at)
            for k in np.flatnonzero(n >= block.window[j]):
                d = int(doc_of(spot[here[k]]))
                mine = (int(n[k]), int(block.item[j[k]]), int(block.start[j[k]]), int(spot[here[k]] - base[d]))
                if d not in best or (-mine[0], *mine[1:]) < (-best[d][0], *best[d][1:]):
                    best[d] = mine
    pairs = np.unique(np.stack([docs, block.unique[who]]), axis=1) if len(docs) else np.empty((2, 0), np.int64)
    items: dict[int, set[int]] = {}
    for d, key in pairs.T.tolist():
        items.setdefault(d, set()).update(block.holders[key])
    for d in range(len(shard)):
        mine = np.flatnonzero(hit[base[d] : base[d + 1]])
        out.append((mine, sorted(items.get(d, ())), best.get(d, (0, -1, -1, -1))))
    return out


_FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()), T.StructField("longest_item", T.StringType()), T.StructField("longest_at", T.LongType()), T.StructField("item_at", T.LongType()),
]


def _runs(places: np.ndarray) -> list[int]:
    """Sorted places as begin, end, begin, end, ..."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], gap + 1])], places[np.concatenate([gap, [len(places) - 1]])] + 1], 1).ravel().tolist()


def write_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Numbered blocks of the benchmark, each a file; their names. Blocks differ in size by chance alone, and none holds twice block_bytes."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), no_null_text("text"))
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    folder = fresh_dir(spark, "benchmark")

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        held: list[tuple[str, str]] = []
        size = 0

        def put() -> tuple:
            f = WholeFile(folder, ".block")
            f.write(pickle.dumps(Block([(name, words_of(text)) for name, text in sorted(held)], window), protocol=5))
            return (f.done(),)

        for ids, texts in batches:
            out = []
            for i, text in zip(ids, texts):
                if held and size + len(text) > 2 * block_bytes:
                    out.append(put())
                    held, size = [], 0
                held.append((i or "", text))
                size += len(text)
            yield out
        if held:
            yield [put()]

    paths = written(arrow_rows(items.repartition(n), T.StructType([T.StructField("path", T.StringType())]), rows), "blocks")
    return sorted(r[0] for r in paths.collect())


_last: tuple[str, Block] | None = None


def _block(path: str) -> Block:
    """The block, kept until another is asked for."""
    global _last
    if _last is None or _last[0] != path:
        _last = None
        with open_read(path) as f:
            _last = (path, pickle.loads(f.read()))
    return _last[1]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, hits (runs of word places), items, longest, longest_item, longest_at, item_at; with
    carry also text and a struct row of the other columns of docs."""
    paths = write_blocks(benchmark, window, block_bytes)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(c for c in docs.columns if c != "text")).alias("row")] if carry else []))
    more = [source.schema["text"], source.schema["row"]] if carry else []

    def coded(b: Block, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(b.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        # of one block, the shard is held as numbers; of several, as text that is numbered for each
        held, shard, n = [], [], 0

        def emptied() -> list[tuple]:
            found = [(np.empty(0, np.int64), [], (0, "", -1, -1)) for _ in held]
            # from block to block the order turns, so that the block that is there is used first
            order = paths if _last is None or _last[0] != (paths or [""])[-1] else paths[::-1]
            for path in order:
                b = _block(path)
                for k, (mine, items, (m, item, item_at, at)) in enumerate(search(shard if len(paths) == 1 else [coded(b, words_of(x)) for x in shard], b)):
                    hits, names, best = found[k]
                    if m:
                        best = min(best, (-m, b.names[item], item_at, at))
                    found[k] = (np.union1d(hits, mine) if len(hits) else mine, names + [b.names[x] for x in items], best)
            out = []
            for (i, n_words, *rest), (hits, names, (m, item, item_at, at)) in zip(held, found):
                out.append((i, n_words, _runs(hits), sorted(names), -m, item if m else None, at, item_at, *rest))
            return out

        for columns in batches:
            for i, text, *rest in zip(*columns):
                words = words_of(text)
                held.append((i, len(words), text, *rest) if carry else (i, len(words)))
                shard.append(coded(_block(paths[0]), words) if len(paths) == 1 else text)
                n += len(words)
                if n >= SHARD_WORDS:
                    yield emptied()
                    held, shard, n = [], [], 0
        yield emptied()

    return arrow_rows(source, T.StructType([source.schema["doc_id"], *_FOUND, *more]), rows)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match."""
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"), F.col("longest_item").alias("longest_match_item"), F.col("longest_at").alias("longest_match_at"), F.col("item_at").alias("longest_match_item_at"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark window."""
    found = contamination(docs, benchmark, carry=True).where(F.size("hits") == 0)
    return found.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
