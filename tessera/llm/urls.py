"""URL filters by temporal lists, in DataFrame functions only.

A list is a log of dated entries: from a day on, a key (a host, a parent domain, or host/first path segment) is blocked, allowed, or off the list.
Consecutive entries of a key become validity intervals. A capture is judged by the entries that were active when it was fetched. The most
specific key with an active entry decides.

Captures are first reduced to distinct (host, segment, day), and these to distinct (key, day) with their number: what is active depends on
key and day alone. Those are merged with the list's entries by key and day, and the last entry before each is carried on: an as-of join in one
pass, in which a key has no more rows than there are days and entries, however many captures lie below it. The verdicts go back by key and day;
keys and days of many captures are broadcast, the others shuffled (see join_counted).

Cases. A url that is null or has no host: no key, verdict none, kept. Several entries of one key and day: the greatest (day, seq, action)
stands. Null keys or days in the list are ignored; a null day of a capture is before all entries. Equal rows are returned each. Ports, user names and
dots at the end are not part of the host; hosts are compared in lower case; addresses have no parent domains. Empty tables: no rows, or no
verdicts. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_counted, written

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
#: Hosts that are numbers, which no domain is above.
_ADDRESS = r"^(\[.*|[0-9.]+)$"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"\.+$", "")


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SEGMENT, 1)


def log_of(entries: DataFrame) -> DataFrame:
    """key, day, action: one entry for each key and day."""
    return entries.where("key is not null and day is not null").groupBy("key", F.col("day").cast("long").alias("day")).agg(F.max(F.struct("seq", "action")).alias("e")).select("key", "day", F.col("e.action").alias("action"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until (exclusive; null: still valid) from entries (key, day, seq, action); action off ends an entry."""
    w = Window.partitionBy("key").orderBy("day")
    return log_of(entries).select("key", "action", F.col("day").alias("since"), F.lead("day").over(w).alias("until")).where("action <> 'off'")


def active(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (key, at, n) with the action of the interval that at lies in; without those that lie in none."""
    log = log_of(entries).select("key", F.col("day").alias("at"), F.lit(None).cast("long").alias("n"), "action")
    both = log.unionByName(asked.select("key", F.col("at").cast("long").alias("at"), "n", F.lit(None).cast("string").alias("action")))
    # of one day, the entry stands before the question
    w = Window.partitionBy("key").orderBy("at", F.col("n").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("key", "at", "n", F.last("action", ignorenulls=True).over(w).alias("action")).where("n is not null and action <> 'off'")


def _keys(host: Column, segment: Column) -> Column:
    """(key, rank) of a capture: host/segment, the host, its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), i.alias("rank")))
    parents = F.filter(parents, lambda p: (p["rank"] == 1) | ((p["rank"] < F.size(labels)) & ~host.rlike(_ADDRESS)))
    path = F.when(segment != "", F.array(F.struct(F.concat_ws("/", host, segment).alias("key"), F.lit(0).alias("rank")))).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))
    return F.when(host == "", F.array().cast("array<struct<key:string,rank:int>>")).otherwise(F.concat(path, parents))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, matched_key, action (block, allow or none) and kept."""
    rows = captures.select("page_id", "url", "day", host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment"))
    seen = rows.where("host <> ''").select("host", "segment", "day").distinct()
    keyed = seen.select("host", "segment", "day", F.explode(_keys(F.col("host"), F.col("segment"))).alias("k")).select("host", "segment", F.col("day").cast("long").alias("at"), "k.key", "k.rank")
    keyed = written(keyed, "url-keys")
    asked = keyed.where("at is not null").groupBy("key", "at").agg(F.count("*").alias("n"))
    found = join_counted(keyed, written(active(asked, entries), "url-active"), ["key", "at"], "n")
    best = found.groupBy("host", "segment", "at").agg(F.min(F.struct("rank", "key", "action")).alias("b")).select("host", "segment", "at", F.col("b.key").alias("matched_key"), F.col("b.action").alias("action"))
    out = rows.withColumn("at", F.col("day").cast("long")).join(best, ["host", "segment", "at"], "left")
    action = F.coalesce("action", F.lit("none"))
    return out.select("page_id", "url", "host", "day", "matched_key", action.alias("action"), (action != "block").alias("kept"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages table names no fetch time; a page counts as fetched on day page_id mod 365."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.pmod(F.col("page_id").cast("long"), F.lit(365)).alias("day"))


def stand_in_list(pages: DataFrame) -> DataFrame:
    """No list comes with the tables: entries for each host of the pages and its parent domain, dated by the lengths of their names.

    A host is blocked from day 7n mod 200 (n its length), or allowed if n is a multiple of 3, and comes off the list 60 + n days
    later. Its parent domain is blocked from day 3n mod 300 (n its own length) for good.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    n = F.length("key").cast("long")
    parents = hosts.where(F.size(F.split("key", r"\.")) > 2).select(F.regexp_replace("key", r"^[^.]*\.", "").alias("key")).distinct()
    on = hosts.select("key", ((n * 7) % 200).alias("day"), F.lit(1).alias("seq"), F.when(n % 3 == 0, "allow").otherwise("block").alias("action"))
    off = hosts.select("key", ((n * 7) % 200 + 60 + n).alias("day"), F.lit(2).alias("seq"), F.lit("off").alias("action"))
    above = parents.select("key", ((n * 3) % 300).alias("day"), F.lit(0).alias("seq"), F.lit("block").alias("action"))
    return on.unionByName(off).unionByName(above)


#: The same rows by SQL.
ORACLE = """
with c as (
  select page_id, url, page_id % 365 as day,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '.') as host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) as segment
  from pages),
h as (select distinct host as key from c where host <> ''),
up as (select distinct regexp_replace(key, '^[^.]*\\.', '') as key from h where len(string_split(key, '.')) > 2),
log as (
  select key, (length(key) * 7) % 200 as day, 1 as seq, case when length(key) % 3 = 0 then 'allow' else 'block' end as action from h
  union all select key, (length(key) * 7) % 200 + 60 + length(key), 2, 'off' from h
  union all select key, (length(key) * 3) % 300, 0, 'block' from up),
one as (select key, day, arg_max(action, seq) as action from log group by key, day),
v as (select key, action, day as since, lead(day) over (partition by key order by day) as until from one),
k as (
  select page_id, url, day, host, segment, unnest(
    list_concat(case when segment <> '' then [{'key': host || '/' || segment, 'rank': 0}] else [] end,
      list_filter(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: {'key': array_to_string(string_split(host, '.')[i:], '.'), 'rank': i::int}), lambda p: p.rank = 1 or p.rank < len(string_split(host, '.')) and not regexp_matches(host, '^(\\[.*|[0-9.]+)$')))) as k
  from (select distinct * from c) where host <> ''),
best as (
  select distinct host, segment, k.day, first_value(v.key) over w as matched_key, first_value(v.action) over w as action
  from k join v on k.k.key = v.key and v.action <> 'off' and v.since <= k.day and (v.until is null or k.day < v.until)
  window w as (partition by host, segment, k.day order by k.k.rank))
select c.page_id, c.url, c.host, c.day, b.matched_key, coalesce(b.action, 'none') as action, coalesce(b.action, 'none') <> 'block' as kept
from c left join best b on b.host = c.host and b.segment = c.segment and b.day = c.day
"""
