"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

1. Once over the texts: spans of the base kinds, and of long mixed tokens that no base kind covers (kind token).
2. The hash of each candidate's value is counted over the whole corpus: distinct repositories, owners and documents. Rows are
   reduced to distinct (hash, owner, repository) before anything meets in one place, so an example that a third of
   all documents copy is one row a partition.
3. A value that EXAMPLE_OWNERS hold, or that several owners hold in EXAMPLE_REPOSITORIES, is a copied example. A value of fewer that looks
   random is live: one owner may use it in any number of repositories. Tokens that are live join the document's spans; base spans always
   stay. The texts themselves are never shuffled, and spans of hashes that very many rows have (see join_counted) meet a broadcast table.

Cases. Null or empty text: no spans. Null owner or repository counts as one owner or repository of its own. Equal rows: each is returned,
with equal results. Null doc_id is returned as null. Empty tables give no rows; other columns are not read. Spans of one start are ordered by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, written
from tessera.llm.native import let, marked_spans, unmarked

_LONG = "[A-Za-z0-9_+/-]{24,}"
#: Kinds in order; head and value patterns. The last is the method's own: a token may follow '=' and '.', and '/' where this only parts the
#: segments of a path, after a host's or file's ending, say; such a segment ends at the next '/'.
KINDS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+"),
    "access": ("", "AKIA[A-Z0-9]{12,}"),
    "hex": ("", "(?<![0-9a-f])[0-9a-f]{32,}"),
    "token": ("", rf"(?:(?<![A-Za-z0-9_+/.-]){_LONG}|(?<=\.)(?![a-z]{{2,12}}/){_LONG}|(?<=/)[A-Za-z0-9_+-]{{24,}})={{0,2}}"),
}
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Repositories from which on a value of several owners counts as one, too.
EXAMPLE_REPOSITORIES = 6
#: Distinct characters, and share of the length, that make a value look random.
RANDOM_CHARS, RANDOM_SHARE = 10, 0.25


def _candidates(text: Column) -> Column:
    """All spans in order of start and kind: start, kind, end, hash, random."""

    def of(kind: str) -> Column:
        no = list(KINDS).index(kind)
        spans = marked_spans(text, *KINDS[kind])
        if kind == "access":
            spans = F.when(F.instr(text, "AKIA") > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(s["value"]) >= 8)
        if kind == "token":
            spans = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))

        def described(s: Column) -> Column:
            kinds = F.size(F.array_distinct(F.split(s["value"], "")))
            random = (kinds >= RANDOM_CHARS) & (kinds >= F.least(F.length(s["value"]) * RANDOM_SHARE, F.lit(16.0)))
            return F.struct(s["start"].alias("start"), F.lit(no).alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), random.alias("random"))

        return F.transform(spans, described)

    base = F.array_sort(F.concat(*(of(k) for k in BASE)))
    alone = lambda b: F.filter(of("token"), lambda t: ~F.exists(b, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return let(base, lambda b: F.array_sort(F.concat(b, alone(b))))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per document: doc_id, owner, repository and candidates (start, kind, end, hash, random)."""
    text = let(F.coalesce(F.col("text").cast("string"), F.lit("")), lambda t: _candidates(unmarked(t)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), text.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, n_rows over the whole corpus."""
    each = found.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows"))


def judged(found: DataFrame) -> DataFrame:
    """found with verdicts: each span gets verdict example, live or weak. Equal rows are judged once and returned each."""
    some = found.where(F.size("spans") > 0).groupBy("doc_id", "owner", "repository", "spans").agg(F.count("*").cast("int").alias("copies"))
    some = some.withColumn("row", F.sha2(F.to_json(F.struct("doc_id", "owner", "repository", "spans"), {"ignoreNullFields": "false"}), 256))
    each = some.select("row", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash"))
    each = join_counted(each, written(ownership(found), "ownership"), ["hash"], "n_rows")
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))
    verdict = F.when(copied, "example").when(F.col("s.random"), "live").otherwise("weak")
    per_row = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", verdict.alias("verdict"), "n_owners", "n_repositories"))).alias("judged"))
    out = some.drop("spans").join(per_row, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    none = found.where(F.size("spans") == 0).select("doc_id", "owner", "repository", F.array().cast(per_row.schema["judged"].dataType).alias("judged"))
    return out.select("doc_id", "owner", "repository", "judged").unionByName(none)


def report(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """The digest columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how many spans are live or examples."""
    found = judged(written(scan(docs, owner, repository), "secrets"))
    count = lambda cond: F.size(F.filter("judged", cond)).cast("long")
    of_kind = lambda i: count(lambda s: s["kind"] == i)
    is_base = lambda s: s["kind"] < len(BASE)
    return found.select(
        "doc_id", *(of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(_written(F.filter("judged", is_base)), 256).alias("base_sha256"),
        _written(F.filter("judged", lambda s: is_base(s) | (s["verdict"] == "live"))).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
