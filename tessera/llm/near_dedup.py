"""Near-duplicate groups by MinHash bands, verified with odd sketches and then on the full shingle sets.

1. Python, once over the texts: shingle set, MinHash samples, band keys, odd sketch (parity bitmap of the samples).
2. Texts with equal sets become one node, so copies cost nothing further.
3. Nodes that share a band key are candidates. Within a key, every node is compared with a few pivots, never with every
   other; the links found join components, and only pairs that still lie in different components come up again: after
   some rounds of fresh pivots, as a join that tests the odd sketches before it emits a pair. All pairs that share a key
   are thus either compared or known to be connected.
4. A candidate must pass the size bound and, unless both sets are small, the odd sketch, and is confirmed on both full sets.

Cases. Null or blank text: no shingles, linked with nothing, its own component. Fewer than k words: one shingle. Equal rows: one node,
each row is returned; kept is true for each row that has the smallest doc_id. Null doc_id: such a row takes the group's
smallest doc_id, or null if all are null. Empty table: no rows. Other columns are not read. Links are decided by integers, so ties at
the threshold count as links. A pair at the threshold misses all bands with a probability of 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import NOT_SPACE, arrow_rows, dropped, no_null_text, settled, shingle_hashes, word_hashes

BANDS, ROWS_PER_BAND = 32, 5
SAMPLES = BANDS * ROWS_PER_BAND
#: Bins of the one-permutation MinHash samples that an odd sketch folds, and the sketch's length.
BINS, SKETCH_LONGS = 1024, 32
#: Standard deviations that a pair at the threshold may lie off before its sketches rule it out.
SLACK = 4.5
#: Simulated pairs of 20 to 10,000 shingles at the threshold vary by at most this share of what most_bits() reckons, about a mean no
#: larger than its own: the bound is 5 to 7 standard deviations away from them.
SPREAD = 0.68
#: Two sets of fewer shingles together than FEW_SHINGLES go straight to the full sets, as the bound is too tight for them; from
#: MANY_SHINGLES on, which were not simulated, SLACK is WIDE.
FEW_SHINGLES, MANY_SHINGLES, WIDE = 128, 18_000, 6.0
#: Pivots of a key in a round; rounds at most, of which the last compares all that is left within its keys. Earlier rounds do so
#: too once that is at most MOST_PER_POSTING pairs for each node of a key, or pivots have ceased to find links for one node in FEW.
PIVOTS, MOST_ROUNDS, MOST_PER_POSTING, FEW = 3, 6, 8, 100

_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
])
_SETS = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

_rng = np.random.Generator(np.random.PCG64(71))
_A = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def shingle_set(text: str, k: int) -> np.ndarray:
    # bytes.lower() changes A-Z only
    return shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower(), NOT_SPACE), k)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    return x


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least hash under each of SAMPLES permutations of 32-bit values."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, _scrambled(low[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return best


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bit j tells whether an odd number of samples hash to j. The samples are the least (sorted) hashes of BINS ranges of values."""
    bins = shingles >> np.uint64(64 - BINS.bit_length() + 1)
    samples = shingles[np.concatenate([[True], bins[1:] != bins[:-1]])]
    at = (_mix64(samples * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) % np.uint64(64 * SKETCH_LONGS)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for col in samples.reshape(BANDS, ROWS_PER_BAND).T:
        h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + col)
    return h.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for ids, texts in batches:
            out = []
            for i, text in zip(ids, texts):
                s = shingle_set(text, k)
                if len(s):
                    m = minhash(s)
                    out.append((i, len(s), _digest(s), band_keys(m).tolist(), odd_sketch(s).tolist()))
                else:
                    out.append((i, 0, None, None, None))
            yield out

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), no_null_text("text")), _FEATURES, rows)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for (texts,) in batches:
            yield [(_digest(s), s.view(np.int64).tolist()) for s in (shingle_set(x, k) for x in texts) if len(s)]

    return arrow_rows(docs.select(no_null_text("text")), _SETS, rows)


def most_bits(n: Column, percent: int) -> Column:
    """Set bits that the XOR of two sketches may have if sets of n shingles together are similar.

    At similarity p the union has u = n / (1 + p) shingles, which fill some of the bins. A filled bin's samples differ with probability
    1 - p; they are two if the other set fills the bin as well. Only shingles that share a bin make the number of differing
    samples vary. A sketch of M bits in which d bits were flipped has M/2 (1 - exp(-2d/M)) set.
    """
    p, m = percent / 100, 64.0 * SKETCH_LONGS
    u = n / (1 + p)
    empty = F.exp(-u / BINS)
    filled = BINS * (1 - empty)
    mean = filled * (1 - p) * (2 - F.pow(empty, F.lit(0.9)))
    spread = F.sqrt(p * (1 - p) * F.least(2 * u * (1 - empty), 4 * filled))
    return m / 2 * (1 - F.exp(-2 * mean / m)) + F.when(n < MANY_SHINGLES, SLACK).otherwise(WIDE) * SPREAD * F.sqrt(spread * spread + 2 * mean * mean / m) + 1


def may_be_similar(n_a: Column, n_b: Column, a: list[Column], b: list[Column], percent: int) -> Column:
    differing = reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & ((n_a + n_b < FEW_SHINGLES) | (differing <= most_bits((n_a + n_b).cast("double"), percent)))


def _longs(sketch: str) -> list[Column]:
    return [F.col(sketch)[i] for i in range(SKETCH_LONGS)]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's least node) for all nodes of edges (a, b): least neighbour, then pointer jumping, until nothing changes."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        jump = step.join(label.select(F.col("node").alias("c"), F.col("comp").alias("cc")), "c", "left").select("node", F.col("comp").alias("was"), F.least("c", F.coalesce("cc", "c")).alias("comp"))
        nxt = settled(jump, "labels")
        dropped(label)
        if nxt.where("comp <> was").isEmpty():
            dropped(both)
            return nxt.select("node", "comp")
        label = nxt.select("node", "comp")


def _relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label (node, comp) after links between nodes: components of components are found, then named in label."""
    if label is None:
        return components(links)
    of = lambda side: links.join(label.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}")), side, "left")
    between = of("a").select("b", F.coalesce("ca", "a").alias("ca")).join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left").select(F.col("ca").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(between)
    old = label.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    out = settled(old.unionByName(joined.join(label.select("node"), "node", "left_anti")).groupBy("node").agg(F.min("comp").alias("comp")), "labels")
    dropped(joined, label)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """As near_duplicates(), with node (equal sets) and comp (the component, null for a node without links). Reads none but tables of its own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = settled(features(docs, k), "features")
    nodes = settled(told.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "nodes")
    rows = settled(told.select("doc_id", "n_shingles", "node"), "rows")
    dropped(told)
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = keys.groupBy("key").count().where("count > 1").select("key")
    postings = settled(keys.join(crowded, "key", "left_semi").join(nodes.select("node", "rep", "n", "sketch"), "node"), "postings")
    label: DataFrame | None = None
    sets: DataFrame | None = None
    tested: list[DataFrame] = []
    n_links = 0
    if not postings.isEmpty():
        # the full sets of all nodes that share a key with another, made once
        wanted = postings.select("node", "rep").distinct()
        ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
        known = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
        sets = settled(_sets(known, k).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    for turn in range(MOST_ROUNDS):
        if turn == 0 and postings.isEmpty():
            break
        here = postings.withColumn("comp", F.col("node")) if label is None else postings.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        last = turn == MOST_ROUNDS - 1
        if turn and not last:
            sizes = here.groupBy("key", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
            total, left = sizes.where("m * m > own").agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).first()
            if not total:
                break
            last = left <= MOST_PER_POSTING * total or n_links * FEW < total
        if last:
            open_keys = here.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
            # as columns of their own the sketches' parts are read without unpacking an array for each pair
            here = opened = settled(here.join(open_keys, "key", "left_semi").join(nodes.select("node", "bands"), "node").select("key", "band", "node", "n", "comp", *(F.col("bands")[i].alias(f"k{i}") for i in range(BANDS)), *(x.alias(f"s{i}") for i, x in enumerate(_longs("sketch")))), "open")
            side = lambda p: [F.col(f"{p}.s{i}") for i in range(SKETCH_LONGS)]
            a, b = here.alias("x"), here.alias("y")
            cond = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.node") < F.col("y.node"))
            # a pair that shares several keys comes up under the first of them only
            earlier = reduce(lambda c, d: c | d, ((F.col("x.band") > i) & (F.col(f"x.k{i}") == F.col(f"y.k{i}")) for i in range(BANDS - 1)))
            found = a.join(b, cond & may_be_similar(F.col("x.n"), F.col("y.n"), side("x"), side("y"), percent) & ~earlier).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        else:
            # a group's earliest document is often the text that the others were made from; the other pivots are chance
            me = F.struct(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ska"), F.col("comp").alias("ca"))
            orders = [F.xxhash64("node", F.lit(PIVOTS * turn + i)) if turn or i else F.col("rep") for i in range(PIVOTS)]
            pivots = here.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), *(F.min_by(me, F.struct(o.alias("o"), F.col("node"))).alias(f"p{i}") for i, o in enumerate(orders))).where("c0 <> c1")
            pivots = pivots.select("key", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("p")).select("key", "p.*")
            met = here.join(pivots, "key").where((F.col("comp") != F.col("ca")) & may_be_similar(F.col("n"), F.col("na"), _longs("sketch"), _longs("ska"), percent))
            found = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        found = found.distinct()
        for old in tested:
            found = found.join(old, ["a", "b"], "left_anti")
        found = settled(found, "pairs")
        links = settled(_confirmed(found, sets, percent), "links")
        tested.append(found)
        n_links = links.count()
        if n_links:
            label = _relabelled(label, links)
        dropped(links)
        if last:
            dropped(opened)
            break
    dropped(postings, *([sets] if sets is not None else []), *tested)
    of_node = nodes.select("node", "rep", "copies")
    if label is None:
        named = of_node.where("copies > 1").select("node", F.col("rep").alias("least"), F.lit(None).cast("binary").alias("comp"))
    else:
        groups = label.join(of_node, "node").groupBy("comp").agg(F.min("rep").alias("least"))
        joined = label.join(groups, "comp").select("node", "least", "comp")
        # only nodes with company need a look-up: all other rows are their own component
        named = joined.unionByName(of_node.where("copies > 1").join(joined, "node", "left_anti").select("node", F.col("rep").alias("least"), F.lit(None).cast("binary").alias("comp")))
    named = settled(named, "named")
    dropped(nodes, *([label] if label is not None else []))
    out = rows.join(named, "node", "left")
    least = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"), "node", "comp")


def clean(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one row of each group: that of the smallest doc_id, and of rows that share it the first by text."""
    of_row = grouped(docs, k, percent)
    found = settled(of_row, "groups")
    dropped(of_row)
    own = "_" + max(docs.columns, key=len)  # no column of docs has this name
    by_id = settled(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")).where("rows > 1 or not kept"), "leave")
    plain = docs.where("doc_id is not null").join(by_id.select(F.col("doc_id").alias(own)), F.col("doc_id") == F.col(own), "left_anti")
    repeated = by_id.where("rows > 1").select(F.col("doc_id").alias(own))
    if repeated.isEmpty() and found.where("doc_id is null").isEmpty():
        dropped(found)
        return plain
    # ids that are null or not unique don't tell a row's group: the group is looked up by id and shingle set
    odd = docs.where("doc_id is not null").join(repeated, F.col("doc_id") == F.col(own), "left_semi").unionByName(docs.where("doc_id is null"))
    inner = odd.select(F.struct(*odd.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), no_null_text("text"))
    schema = T.StructType([T.StructField("row", inner.schema["row"].dataType), T.StructField("id", T.LongType()), T.StructField("node", T.BinaryType())])

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for of_row, ids, texts in batches:
            sets = [shingle_set(t, k) for t in texts]
            yield [(r, i, _digest(s) if len(s) else None) for r, i, s in zip(of_row, ids, sets)]

    verdicts = found.where("kept").select(F.col("doc_id").alias("vid"), F.col("node").alias("vnode"), "comp").distinct()
    told = arrow_rows(inner, schema, rows).join(verdicts, F.col("id").eqNullSafe(F.col("vid")) & F.col("node").eqNullSafe(F.col("vnode")))
    first = told.withColumn("nth", F.row_number().over(Window.partitionBy(F.coalesce("comp", "node")).orderBy(F.col("row.text"), F.to_json("row"))))
    chosen = first.where("node is null or nth = 1").select("row.*")
    return plain.unionByName(chosen.select(*plain.columns))
