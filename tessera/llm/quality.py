"""Quality rules: counts of each text, and a decision list learned from labels, in DataFrame functions only.

The counts of every text are computed once and written (numbers only; clean() writes those of labelled texts and tells the others' as it
passes). Labelled documents are joined to them and reduced to bins of fixed grids. Sequential covering then grows a conjunction of
thresholds at a time: one aggregation over all labelled rows that no earlier rule covers gives the good and bad documents of every bin of
every feature, the literal with the best information gain is added, and so on; a held-out third of the labelled rows prunes the conjunction
and decides whether it is exact enough to keep. The list becomes an ordered CASE expression. All labels are used; no sample is taken.

Cases. Null or empty text: no words, so base_failed. Labels that are null are ignored; several labels of one document count by their mean;
without labels, or without a rule that is exact enough, the list is empty and keeps everything that the base keeps. Equal rows are each
judged alike. Null doc_id: never labelled, judged all the same. Empty tables give no rows; other columns are not read. Of equally good literals the
first in the order of FEATURES wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written
from tessera.llm.native import let, words

_SHARES = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Features and the grids of their thresholds.
FEATURES = {
    "symbol_share": _SHARES, "repeat_share": _SHARES, "dup_line_share": _SHARES, "distinct_share": _SHARES, "upper_share": _SHARES,
    "digit_share": _SHARES, "mark_share": _SHARES, "mean_word": [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 12.0, 16.0, 24.0],
    "n_words": [float(10 * 2**i) for i in range(14)], "words_a_line": [float(2**i) for i in range(12)],
}
#: Bounds of the list: rules, and literals in one. They keep it readable; a rule must earn its place on held-out rows anyway.
MOST_RULES, MOST_LITERALS = 6, 3
#: A rule must be right this often on the held-out rows (with one wrong case added), and cover this many bad documents there.
LEAST_PRECISION, LEAST_COVER = 0.95, 5
KEPT_GAIN = 0.97
#: Up to so many labelled documents clean() broadcasts their ids and learns from counts of their texts alone; of more, all texts are counted first.
FEW_LABELLED = 2_000_000
WINDOW = 5


def _counts(text: Column) -> Column:
    def repeated(h: Column) -> Column:
        """Words in windows of WINDOW words that occur twice or more."""
        n = F.size(h)

        def covered(grams: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | (F.get(s, i + 1)["g"] == x["g"]))
                places = F.array_sort(F.transform(twice, lambda x: x["i"]))
                start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
                return F.aggregate(places, start, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

            ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, of_sorted))

        grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))
        return F.when(n >= WINDOW, let(grams, covered)).otherwise(F.lit(0))

    def lines(t: Column) -> Column:
        full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def counted(t: Column) -> Column:
        gone = lambda chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))

        def of_words(w: Column) -> Column:
            hashes = F.transform(w, lambda x: F.xxhash64(x))
            return F.struct(
                F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), gone("[#*$%&|<>]+").alias("n_symbols"), lines(t).alias("lines"),
                let(hashes, lambda h: F.struct(repeated(h).alias("repeat"), F.size(F.array_distinct(h)).alias("distinct"))).alias("w"),
                gone("[A-Z]+").alias("upper"), gone("[0-9]+").alias("digit"), gone("[!?]+").alias("mark"),
            )

        return let(words(t), of_words)

    return let(text, counted)


def counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the base counts and the features; with the columns of more."""
    m = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), _counts(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m"))
    share = lambda a, b: (F.when(b > 0, a / b).otherwise(F.lit(0.0))).cast("double")
    c = lambda name: F.col(f"m.{name}")
    n, chars = c("n_words"), c("word_chars")
    return m.select(
        *more, "doc_id", n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), c("n_symbols").cast("long").alias("n_symbols"), c("lines.dup").cast("long").alias("n_dup_lines"), c("w.repeat").cast("long").alias("n_repeat_words"),
        ((n < 10) | (100 * c("w.repeat").cast("long") > 20 * n.cast("long"))).alias("base_failed"),
        share(c("n_symbols"), chars).alias("symbol_share"), share(c("w.repeat"), n).alias("repeat_share"), share(c("lines.dup"), c("lines.n")).alias("dup_line_share"), share(c("w.distinct"), n).alias("distinct_share"), share(c("upper"), chars).alias("upper_share"),
        share(c("digit"), chars).alias("digit_share"), share(c("mark"), n).alias("mark_share"), share(chars, n).alias("mean_word"), share(n, c("lines.n")).alias("words_a_line"),
    )


@dataclass(frozen=True)
class Literal:
    """feature > grid value, or feature <= it."""

    feature: str
    bin: int
    above: bool

    @property
    def value(self) -> float:
        return FEATURES[self.feature][self.bin]

    def on(self, column: Column, limit: float) -> Column:
        return column > limit if self.above else column <= limit

    def binned(self) -> Column:
        return self.on(F.col(self.feature), self.bin)

    def raw(self) -> Column:
        return self.on(F.col(self.feature).cast("double"), self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


Rule = tuple[Literal, ...]


def _all(literals: Rule, how: str = "binned") -> Column:
    return reduce(lambda a, b: a & b, (getattr(x, how)() for x in literals), F.lit(True))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and bad (0 or 1) of each labelled document."""
    return labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") < 0.5).cast("int").alias("bad"))


def labelled_bins(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that the base keeps: bad, held (a third, kept for pruning), and the bin of each feature. A value's bin is
    the number of grid values below it, so that a bin up to b means a value up to the grid's b-th."""
    binned = (sum((F.col(f).cast("double") > v).cast("int") for v in grid).cast("int").alias(f) for f, grid in FEATURES.items())
    return stats.where(~F.col("base_failed")).join(labelled(labels), "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *binned)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return 0.0 if p <= 0 else p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _strictest(gains: dict[Literal, float]) -> Literal | None:
    """The literal of most gain, moved to the strictest grid value that keeps nearly all of it: a rule shouldn't reach further than its evidence."""
    best = max(gains, key=gains.get)
    if gains[best] <= 1e-6:
        return None
    near = [x for x, g in gains.items() if (x.feature, x.above) == (best.feature, best.above) and g >= KEPT_GAIN * gains[best]]
    return max(near, key=lambda x: x.bin if x.above else -x.bin)


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list from labelled_bins()."""
    rules: list[Rule] = []
    per_bin = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(FEATURES)))).alias("x")
    while len(rules) < MOST_RULES:
        left = reduce(lambda d, r: d.where(~_all(r)), rules, rows)
        rule: Rule = ()
        while len(rule) < MOST_LITERALS:
            seen = left.where(~F.col("held") & _all(rule)).select("bad", per_bin).groupBy("x.f", "x.b").agg(F.sum("bad"), F.count("*")).collect()
            table = {(f, b): (p, n - p) for f, b, p, n in seen}
            p0, n0 = (sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1))
            if not p0 or not n0:
                break
            gains: dict[Literal, float] = {}
            for i, (f, grid) in enumerate(FEATURES.items()):
                p = n = 0
                for b in range(len(grid)):
                    p, n = p + table.get((i, b), (0, 0))[0], n + table.get((i, b), (0, 0))[1]
                    gains[Literal(f, b, False)] = _gain(p, n, p0, n0)
                    gains[Literal(f, b, True)] = _gain(p0 - p, n0 - n, p0, n0)
            best = _strictest(gains)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        # drop literals from the end while that does better on the held-out rows
        fits = left.where("held").agg(*(x for i in range(1, len(rule) + 1) for x in (F.sum(F.when(_all(rule[:i]), F.col("bad"))), F.sum(F.when(_all(rule[:i]), 1 - F.col("bad")))))).first()
        scores = [((p or 0) / ((p or 0) + (n or 0) + 1), (p or 0), i) for i, (p, n) in enumerate(zip(fits[::2], fits[1::2]), 1)]
        precision, cover, size = max(scores, key=lambda s: (round(s[0], 3), s[1], -s[2]))
        if cover < LEAST_COVER or precision < LEAST_PRECISION * cover / (cover + 1):
            break
        rules.append(rule[:size])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered CASE: the number of the first rule that rejects, 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule, "raw"), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, rule (0: none) for each row, with the columns of more."""
    stats = written(counts(docs, *more), "quality")
    rules = learn(written(labelled_bins(stats, labels), "labelled"))
    out = stats.withColumn("rule", verdict(rules))
    return out.select(*more, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. No text is written: rules need the counts of labelled texts only, and the verdict
    on each row is told from the row itself."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = labelled(labels).select("doc_id")
    known = plain.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= FEW_LABELLED else plain
    stats = written(counts(known), "quality")
    bins = written(labelled_bins(stats, labels), "labelled")
    rules = learn(bins)
    dropped(stats, bins)
    bare = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)), "doc_id", "text")
    more = [f"_{i}" for i in range(len(docs.columns))]
    return counts(bare, *more).where(~F.col("base_failed") & (verdict(rules) == 0)).select(*(F.col(m).alias(c) for m, c in zip(more, docs.columns)))
