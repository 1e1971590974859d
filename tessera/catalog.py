"""Registered queries of the engine itself, with the SQL that answers the same question.

Aided queries run over many-file copies of the tables, so that there is something to prune, and are answered through derived state that is
built first; the oracle is the plain question.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera.functions import cosine_distance, hll_merge, hll_state, l2_distance, text_matches
from tessera.model import AggFunc, Aggregate, Filter, Measure, Metric, Plan
from tessera.session import APPROXIMATE, Session
from tessera.sources import read_files
from tessera.sources.tablelog import Table, bare
from tessera.streaming import commit_stream

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_tables: dict[tuple, Table] = {}


def root(spark: SparkSession) -> str:
    """A folder of our own in the shared one; in local mode, where all is one machine, a temporary one if none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tessera-')}/tables-{uuid.uuid4().hex}"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Layouts: how a copy's rows are dealt to 16 files.
LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "events_clustered": lambda d: d.repartitionByRange(16, "user_id"),
    "events_scattered": lambda d: d.repartition(16, "event_id"),
    "orders_selective": lambda d: d.repartition(16, "o_orderkey"),
    # each supplier's rows lie in 3 of 16 files
    "lineitem_partial": lambda d: d.repartitionByRange(16, (F.pmod(F.xxhash64("l_suppkey") + F.pmod("l_orderkey", F.lit(3)) * 5, F.lit(16)))),
    "documents_files": lambda d: d.repartitionByRange(8, "source"),
    "embeddings_files": lambda d: d.repartition(8, "vec_id"),
    "customer_files": lambda d: d.repartition(8, "c_custkey"),
}


def table_of(spark: SparkSession, sf_dir: str, layout: str, fresh: bool = False) -> Table:
    """A copy under a layout, made once a session; a fresh one for queries that commit to it."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if fresh or key not in _tables:
        name = layout.split("_")[0]
        made = Table.create(LAYOUTS[layout](base(spark, sf_dir, name)), name, f"{root(spark)}/{layout}")
        if fresh:
            return made
        _tables[key] = made
    return _tables[key]


#: The session of the last aided query, for who wants to see what it asked and what was used.
latest: list[Session] = []


class Noted(Session):
    """A session that knows its last question."""

    asked = ""

    def sql(self, text: str) -> DataFrame:
        self.asked = text
        return super().sql(text)


def session_of(spark: SparkSession, *tables: Table, **settings) -> Session:
    s = Noted(spark, **settings)
    latest[:] = [s]
    for t in tables:
        s.attach(t)
    return s


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The texts of those that Spark answers natively.
NATIVE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def plain(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that Spark answers natively: the same text for both unless the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in NAMES:
            if t in sql:
                base(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name], NATIVE[name] = run, oracle or sql, sql


# --- scans and pruning ------------------------------------------------------------------------------------------------

Q_USER = "SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events WHERE user_id = 7"


@query(Q_USER)
def index_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: an equality index prunes files."""
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    return s.sql(Q_USER)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_eq(spark, sf_dir)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (3, 9) OR user_id = 12")
def index_in_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN and OR of equalities are probed as one."""
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    return s.sql(ORACLES["index_in_or"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE 5 = l_suppkey AND l_partkey = 17")
def two_index_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(spark, sf_dir, "lineitem_partial")
    s = session_of(spark, t)
    for c in ("l_suppkey", "l_partkey"):
        s.registry.register(ops.build_index(t, c))
    return s.sql(ORACLES["two_index_intersect"])


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def bitmap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: rows of files, intersected with an index's files; row scopes by a semi-join."""
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t)
    s.registry.register(ops.build_bitmap(t, "event_type"))
    s.registry.register(ops.build_index(t, "user_id"))
    return s.sql(ORACLES["bitmap_rows"])


@query("SELECT event_id, event_type FROM events WHERE value > 300")
def filter_set_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a remembered conjunct admits the rows that passed it."""
    t = table_of(spark, sf_dir, "events_scattered")
    s = session_of(spark, t)
    s.sql(ORACLES["filter_set_reuse"])
    (text, condition), *_ = s.last_scan[0].conditions.items()
    s.registry.register(ops.build_filter_set(t, Filter(text, frozenset(("value",))), condition))
    return s.sql(ORACLES["filter_set_reuse"])


def _appended(spark: SparkSession, sf_dir: str, layout: str, column: str) -> tuple[Table, Session]:
    """All rows, but with a third appended after the pieces were built."""
    name = layout.split("_")[0]
    rows = base(spark, sf_dir, name)
    late = F.pmod(F.col(column), F.lit(3)) == 0
    t = Table.create(LAYOUTS[layout](rows.where(~late)), name, f"{root(spark)}/{layout}")
    return t, session_of(spark, t)


@query(Q_USER)
def stale_index_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added since the index was built are read whole beside it."""
    t, s = _appended(spark, sf_dir, "events_clustered", "event_id")
    s.registry.register(ops.build_index(t, "user_id"))
    t.append(base(spark, sf_dir, "events").where("event_id % 3 = 0").coalesce(2))
    return s.sql(Q_USER)


@query(Q_USER)
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that compaction has replaced drop out of the index."""
    t = table_of(spark, sf_dir, "events_clustered", fresh=True)
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    t.compact([bare(f.path) for f in t.live()[:3]])
    return s.sql(Q_USER)


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id <> 7 GROUP BY event_type")
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes are copy-on-write; stored rows from before are refused, an index still prunes."""
    t = table_of(spark, sf_dir, "events_clustered", fresh=True)
    s = session_of(spark, t)
    s.registry.register(ops.build_projection(t, frozenset(("event_type", "user_id"))))
    s.registry.register(ops.build_index(t, "user_id"))
    t.delete_where("user_id = 7")
    return s.sql("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")


@query(Q_USER)
def branch_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of an abandoned line isn't used."""
    t = table_of(spark, sf_dir, "events_clustered", fresh=True)
    first = t.current
    t.append(t.read().limit(5))
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    t.branch(first, t.read().limit(0))
    return s.sql(Q_USER)


@query(Q_USER)
def policy_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t, policy="reader")
    s.registry.register(ops.build_index(t, "user_id", policy="owner"))
    return s.sql(Q_USER)


@query("SELECT event_id, user_id FROM events WHERE user_id = 7")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot is read from the log, without what came later."""
    t = table_of(spark, sf_dir, "events_clustered", fresh=True)
    first = t.current
    t.append(t.read().where("user_id = 7").limit(50))
    return session_of(spark, Table.open(spark, "events", t.root, at=first)).sql("SELECT event_id, user_id FROM events WHERE user_id = 7")


@query("SELECT event_type, max(event_id) AS top FROM events WHERE user_id = 7 GROUP BY event_type")
def index_many_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: the text is told by its parsed plan: comments, tabs and line breaks don't matter."""
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    return s.sql("/* the same */\n-- question\nWITH\n\tmine AS (\n  SELECT event_type, event_id\n  FROM\tevents\n  WHERE user_id\n    = 7\n)\nSELECT\n  event_type,\n  max(event_id) AS top\nFROM mine\nGROUP BY event_type")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7")
def create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands run once: CREATE TABLE AS and INSERT get their query planned like any other."""
    t = table_of(spark, sf_dir, "events_clustered")
    s = session_of(spark, t)
    s.registry.register(ops.build_index(t, "user_id"))
    where = f"{root(spark)}/out"
    s.sql(f"INSERT OVERWRITE DIRECTORY '{where}' USING parquet\nSELECT event_id, event_type\nFROM events\nWHERE user_id = 7")
    return spark.read.schema("event_id bigint, event_type string").parquet(where)


# --- substitutes ------------------------------------------------------------------------------------------------------

Q_ORDERS = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"


def _materialized(s: Session, t: Table, sql: str) -> None:
    s.sql(sql)
    r = s.last_scan[0]
    s.registry.register(ops.build_materialized(t, Plan(r.plan.projected, r.plan.filters), " AND ".join(r.conditions.values())))


@query(Q_ORDERS)
def materialized_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the exact scan again, from its stored rows."""
    t = table_of(spark, sf_dir, "orders_selective")
    s = session_of(spark, t)
    _materialized(s, t, Q_ORDERS)
    return s.sql(Q_ORDERS)


@query(Q_ORDERS)
def materialized_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with the files added since."""
    t, s = _appended(spark, sf_dir, "orders_selective", "o_orderkey")
    _materialized(s, t, Q_ORDERS)
    t.append(base(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").coalesce(2))
    return s.sql(Q_ORDERS)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY o_orderstatus")
def projection_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a narrow copy covers the columns."""
    t = table_of(spark, sf_dir, "orders_selective")
    s = session_of(spark, t)
    s.registry.register(ops.build_projection(t, frozenset(("o_orderkey", "o_orderstatus"))))
    return s.sql(ORACLES["projection_substitute"])


_M = Measure
CUBE = Aggregate(("l_returnflag", "l_linestatus", "l_suppkey"), (_M(AggFunc.COUNT), _M(AggFunc.SUM, "l_linenumber"), _M(AggFunc.MIN, "l_quantity"), _M(AggFunc.MAX, "l_quantity"), _M(AggFunc.AVG, "l_linenumber"), _M(AggFunc.COUNT_DISTINCT, "l_partkey")))


def _cube(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    t = table_of(spark, sf_dir, "lineitem_partial")
    s = session_of(spark, t)
    s.registry.register(ops.build_cube(t, CUBE))
    return s.sql(sql)


def _cube_query(name: str, sql: str, oracle: str | None = None) -> None:
    """K7: answered from partial aggregates."""
    QUERIES[name], ORACLES[name] = (lambda spark, sf_dir: _cube(spark, sf_dir, sql)), oracle or sql


_cube_query("cube_same_grain", "SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey",
            "SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n, cast(sum(l_linenumber) AS bigint) AS s FROM lineitem GROUP BY ALL")
_cube_query("cube_rollup", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag")
_cube_query("cube_key_filter", "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus")
_cube_query("cube_global_count", "SELECT count(*) AS n FROM lineitem")
_cube_query("cube_empty_global", "SELECT count(*) AS n, max(l_quantity) AS hi FROM lineitem WHERE l_suppkey < 0")
_cube_query("cube_having_order", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10 ORDER BY n DESC, l_suppkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id >= 20 AND user_id < 40 GROUP BY event_type")
def cube_range_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of user_id >= 10 serves a narrower range."""
    t = table_of(spark, sf_dir, "events_scattered")
    s = session_of(spark, t)
    ask = Aggregate(("event_type", "user_id"), (_M(AggFunc.COUNT),))
    s.registry.register(ops.build_cube(t, ask, [(Filter("user_id >= bigint:10L", frozenset(("user_id",)), ">=", 10), "user_id >= 10")]))
    return s.sql(ORACLES["cube_range_implied"])


def _close(estimate: str, exact: str) -> F.Column:
    """Whether an estimate is within 2 % (three standard errors of the sketches) of the truth."""
    return (F.abs(F.col(estimate) - F.col(exact)) <= F.col(exact) * 0.02).alias("close")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag")
def count_distinct_optin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8: an exact distinct count answered by merged sketches of a cube, under the session's flag, beside the truth."""
    sql = "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag"
    spark.conf.set(APPROXIMATE, "true")
    try:
        about = _cube(spark, sf_dir, sql)
    finally:
        spark.conf.unset(APPROXIMATE)
    exact = base(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return about.join(exact, "l_returnflag").select("l_returnflag", "exact", _close("n", "exact"))


@query("SELECT count(DISTINCT user_id) AS exact, true AS close FROM events")
def approx_distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, A7: sketches by type, merged, beside the truth."""
    per_type = base(spark, sf_dir, "events").groupBy("event_type").agg(hll_state("user_id").alias("sketch"))
    about = per_type.agg(hll_merge("sketch").alias("n"))
    return about.crossJoin(base(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("exact"))).select("exact", _close("n", "exact"))


# --- vectors and text -------------------------------------------------------------------------------------------------

PROBE = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
_V = "[" + ", ".join(map(str, PROBE)) + "]::double[]"
_ARRAY = "array(" + ", ".join(map(str, PROBE)) + ")"


def _nearest(spark: SparkSession, sf_dir: str, name: str, metric: Metric, where: str = "") -> DataFrame:
    t = table_of(spark, sf_dir, "embeddings_files")
    s = session_of(spark, t)
    s.registry.register(ops.build_vector_index(t, "embedding", metric, 64))
    return s.sql(f"SELECT vec_id, round(d, 6) AS d FROM (SELECT vec_id, {name}(embedding, {_ARRAY}) AS d FROM embeddings {where} ORDER BY d, vec_id LIMIT 10)")


@query(f"SELECT vec_id, round(pow(list_distance(embedding::double[], {_V}), 2), 6) AS d FROM embeddings ORDER BY list_distance(embedding::double[], {_V}), vec_id LIMIT 10")
def topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: the ten nearest rows, from a flat vector copy."""
    return _nearest(spark, sf_dir, "l2_distance", Metric.L2)


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::double[], {_V}), 6) AS d FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::double[], {_V}), vec_id LIMIT 10")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "cosine_distance", Metric.COSINE)


@query(f"SELECT vec_id, round(pow(list_distance(embedding::double[], {_V}), 2), 6) AS d FROM embeddings WHERE label = 1 ORDER BY list_distance(embedding::double[], {_V}), vec_id LIMIT 10")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "l2_distance", Metric.L2, "WHERE label = 1")


@query(f"SELECT vec_id, round(pow(list_distance(embedding::double[], {_V}), 2), 5) AS l2, round(1 - list_cosine_similarity(embedding::double[], {_V}), 5) AS cosine FROM embeddings")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "embeddings").select("vec_id", F.round(l2_distance("embedding", PROBE), 5).alias("l2"), F.round(cosine_distance("embedding", PROBE), 5).alias("cosine"))


def _text_oracle(*words: str) -> str:
    return f"SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), {list(words)!r})"


def _text(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    t = table_of(spark, sf_dir, "documents_files")
    s = session_of(spark, t)
    s.registry.register(ops.build_text_index(t, "text"))
    return s.sql(f"SELECT doc_id FROM documents WHERE text_matches(text, '{q}')")


@query(_text_oracle("license"))
def text_match_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: an inverted index leaves the files that hold the term."""
    return _text(spark, sf_dir, "license")


@query(_text_oracle("apache", "license", "version"))
def text_match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, "Apache License version")


@query(_text_oracle("licensed", "2", "0"))
def text_match_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, "LICENSED... 2.0!")


@query(_text_oracle("licens"))
def text_prefix_is_no_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "documents").where(text_matches("text", "licens")).select("doc_id")


SCRIPTS = ["हिन्दी में लिखा", "กรุงเทพ महान", "İstanbul DİYARBAKIR", "cafe\u0301 naïve", "Ελλάδα ΣΟΦΟΣ", "日本語 テキスト", "x² ½ Ⅳ", "under_score"]


@query(" UNION ALL ".join(f"SELECT {i} AS id, '{w}' AS word" for i, text in enumerate(SCRIPTS) for w in text.split()))
def text_match_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, K4: one definition of a term for columns, indexes and asked words, in any script. Each word is found in its own text alone."""
    t = Table.create(spark.createDataFrame(list(enumerate(SCRIPTS)), "id int, body string").repartitionByRange(len(SCRIPTS), "id"), "scripts", f"{root(spark)}/scripts")
    s = session_of(spark, t)
    s.registry.register(ops.build_text_index(t, "body"))
    asked = [s.sql(f"SELECT id, '{w}' AS word FROM scripts WHERE text_matches(body, '{w}')") for text in SCRIPTS for w in text.split()]
    return reduce(DataFrame.unionAll, asked)


# --- joins ------------------------------------------------------------------------------------------------------------


def _join(kind: str) -> tuple[str, str]:
    return f"SELECT c.c_custkey, n.n_name FROM customer c {kind} JOIN nation n ON c.c_nationkey = n.n_nationkey", f"join_{kind.lower()}"


def _join_query(kind: str) -> None:
    sql, name = _join(kind)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """K10: the stored build side stands for the left input of inner and left joins; right joins run as they are."""
        t = table_of(spark, sf_dir, "customer_files")
        s = session_of(spark, t)
        base(spark, sf_dir, "nation").createOrReplaceTempView("nation")
        s.registry.register(ops.build_join_hash(t, ("c_nationkey",), frozenset(("c_custkey",))))
        return s.sql(sql)

    QUERIES[name], ORACLES[name] = run, sql


for _kind in ("INNER", "LEFT", "RIGHT"):
    _join_query(_kind)

# --- streams, rows in memory, other formats ---------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def stream_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches as commits, exactly once; then the plain question over the table."""
    source, folder = base(spark, sf_dir, "events"), root(spark)
    source.repartition(3).write.parquet(f"{folder}/in")
    t = Table.create(source.limit(0), "events", f"{folder}/events")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    commit_stream(stream, t, f"{folder}/checkpoint").awaitTermination()
    return session_of(spark, t).sql("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")


def _through(kind: str, **options: str) -> None:
    """Written in a format and read back with its schema."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{root(spark)}/{kind}"
        rows = base(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
        rows.write.format(kind).options(**options).save(path)
        return read_files(spark, kind, rows.schema, path, **options)

    QUERIES[f"format_{kind}"], ORACLES[f"format_{kind}"] = run, "SELECT c_custkey, c_name, c_nationkey FROM customer"


for _kind in ("csv", "json", "orc"):
    _through(_kind, **({"header": "true"} if _kind == "csv" else {}))

# --- what Spark answers natively --------------------------------------------------------------------------------------

plain("full_scan", "SELECT r_regionkey, r_name FROM region")
plain("projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
plain("range_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
plain("between_like", "SELECT p_partkey, p_brand FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name LIKE '%a%'")
plain("null_predicates", "SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents WHERE lang IS NOT NULL AND source IS DISTINCT FROM 'src0'")
plain("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 1) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus")
plain("join_aggregate", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
plain("join_full", "SELECT n.n_nationkey AS nk, r.r_name AS rn FROM nation n FULL OUTER JOIN region r ON n.n_nationkey = r.r_regionkey")
plain("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
plain("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
plain("join_range", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
plain("window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
plain("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)")
plain("window_analytic", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
plain("window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events")
plain("window_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
plain("top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")
plain("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
plain("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
plain("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
plain("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
plain("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
plain("except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
plain("distinct_rows", "SELECT DISTINCT lang, source FROM documents")
plain("subquery_scalar", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
plain("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
plain("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
plain("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
plain("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n = m")
plain("generators", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM documents) t GROUP BY doc_id", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) t GROUP BY doc_id")
plain("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
plain("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
plain("aggregates_exact", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS vp, bool_and(value >= 0) AS all_up, bool_or(value > 400) AS some_up FROM events GROUP BY event_type")
plain("aggregates_filter", "SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, count(*) FILTER (WHERE user_id < 50) AS low FROM events GROUP BY event_type")
plain("aggregates_bits", "SELECT l_returnflag, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx FROM lineitem GROUP BY l_returnflag")
plain("aggregates_regression", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag")
plain("aggregates_median", "SELECT event_type, round(median(value), 6) AS med, round(percentile(value, 0.9), 6) AS p90 FROM events GROUP BY event_type", "SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
plain("string_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
plain("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
plain("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
plain("cube_groups", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
plain("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
plain("string_functions", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, length(n_name) AS len, trim(concat('  ', n_name, ' ')) AS tr, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, substring(n_name, 2, 3) AS sub, replace(n_name, 'A', 'x') AS rep, reverse(n_name) AS rev, left(n_name, 2) AS l2, right(n_name, 2) AS r2, split_part(n_name, 'I', 1) AS sp, translate(n_name, 'AE', 'ae') AS tl, levenshtein(n_name, 'CHINA') AS lev, ascii(n_name) AS asc1, repeat('ab', 2) AS rp2, concat_ws('-', n_name, 'x') AS cw FROM nation")
plain("string_predicates", "SELECT n_nationkey, contains(n_name, 'AN') AS has, n_name ILIKE '%an%' AS il FROM nation WHERE startswith(n_name, 'I') OR endswith(n_name, 'A')", "SELECT n_nationkey, contains(n_name, 'AN') AS has, n_name ILIKE '%an%' AS il FROM nation WHERE starts_with(n_name, 'I') OR ends_with(n_name, 'A')")
plain("regex_functions", "SELECT page_id, regexp_extract(url, '([a-z]+)://', 1) AS scheme, regexp_replace(url, '[0-9]+', 'N') AS shape, url RLIKE '[0-9]{3}' AS digits FROM pages", "SELECT page_id, regexp_extract(url, '([a-z]+)://', 1) AS scheme, regexp_replace(url, '[0-9]+', 'N', 'g') AS shape, regexp_matches(url, '[0-9]{3}') AS digits FROM pages")
plain("math_functions", "SELECT p_partkey, abs(-p_size) AS ab, sign(p_size - 20) AS sg, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(sqrt(p_size), 6) AS sq, round(ln(p_size), 6) AS l, round(power(p_size, 2), 2) AS pw, round(exp(p_size / 50.0), 6) AS ex, p_size % 7 AS md, greatest(p_size, 10) AS gr, least(p_size, 10) AS le, round(degrees(0.5), 6) AS dg, round(atan2(p_size, 3), 6) AS at FROM part", "SELECT p_partkey, abs(-p_size) AS ab, sign(p_size - 20)::double AS sg, ceil(p_retailprice)::bigint AS ce, floor(p_retailprice)::bigint AS fl, round(sqrt(p_size), 6) AS sq, round(ln(p_size), 6) AS l, round(power(p_size, 2), 2) AS pw, round(exp(p_size / 50.0), 6) AS ex, p_size % 7 AS md, greatest(p_size, 10) AS gr, least(p_size, 10) AS le, round(degrees(0.5), 6) AS dg, round(atan2(p_size, 3), 6) AS at FROM part")
plain("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, hour(o_orderdate) AS h, cast(date_trunc('month', o_orderdate) AS date) AS mo, cast(last_day(o_orderdate) AS date) AS ld, dayofyear(o_orderdate) AS dy FROM orders")
plain("date_arithmetic", "SELECT o_orderkey, datediff(date '2000-01-01', cast(o_orderdate AS date)) AS days, cast(add_months(o_orderdate, 2) AS date) AS later, date_add(cast(o_orderdate AS date), 10) AS ten FROM orders", "SELECT o_orderkey, date_diff('day', o_orderdate::date, date '2000-01-01') AS days, (o_orderdate::date + interval 2 month)::date AS later, o_orderdate::date + 10 AS ten FROM orders")
plain("time_buckets", "SELECT date_format(window(ts, '1 day').start, 'yyyy-MM-dd') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", "SELECT strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
plain("conditional", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS size, nullif(p_size, 7) AS nu, coalesce(nullif(p_size, 7), -1) AS co, if(p_size > 25, 1, 0) AS big FROM part")
plain("casts", "SELECT p_partkey, cast(p_size AS string) AS s, cast(p_retailprice AS int) AS i, try_cast(p_brand AS int) AS t FROM part", "SELECT p_partkey, p_size::varchar AS s, trunc(p_retailprice)::int AS i, try_cast(p_brand AS int) AS t FROM part")
plain("hashes", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s2 FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
plain("array_functions", "SELECT vec_id, size(embedding) AS n, round(embedding[0], 5) AS first, array_contains(array(1, 2, label), 3) AS has, array_join(array_distinct(array(label, 1, label)), '-') AS uniq, array_position(sequence(1, 5), 3) AS pos, element_at(array(label, 9), -1) AS last, array_join(slice(array(1, 2, 3, label), 2, 2), ',') AS sl, array_join(array_union(array(1), array(2, 1)), ',') AS un FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(embedding[1], 5) AS first, list_contains([1, 2, label], 3) AS has, CASE WHEN label = 1 THEN '1' ELSE label || '-1' END AS uniq, 3 AS pos, 9 AS last, '2,3' AS sl, '1,2' AS un FROM embeddings")
plain("higher_order", "SELECT vec_id, round(aggregate(transform(embedding, x -> cast(x AS double) * x), 0D, (s, x) -> s + x), 4) AS norm2, size(filter(embedding, x -> x > 0)) AS pos, exists(embedding, x -> x > 2) AS far FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x)), 4) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS pos, len(list_filter(embedding, lambda x: x > 2)) > 0 AS far FROM embeddings")
plain("map_struct", "SELECT n_nationkey, map('k', n_name)['k'] AS v, cardinality(map_keys(map('a', 1, 'b', 2))) AS n, named_struct('a', n_regionkey, 'b', n_name).b AS b FROM nation", "SELECT n_nationkey, n_name AS v, 2 AS n, {'a': n_regionkey, 'b': n_name}.b AS b FROM nation")
plain("json_functions", "SELECT event_id, get_json_object(props, '$.page') AS page, props IS NOT NULL AS has FROM events", "SELECT event_id, json_extract_string(props, '$.page') AS page, props IS NOT NULL AS has FROM events")
plain("pivoted", "SELECT * FROM (SELECT event_type, user_id % 3 AS g FROM events) PIVOT (count(*) FOR g IN (0 AS g0, 1 AS g1, 2 AS g2))", "SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS g0, count(*) FILTER (WHERE user_id % 3 = 1) AS g1, count(*) FILTER (WHERE user_id % 3 = 2) AS g2 FROM events GROUP BY event_type")


plain("generators_more", "SELECT vec_id, pos, e FROM (SELECT vec_id, posexplode(slice(embedding, 1, 3)) AS (pos, x), label AS e FROM embeddings) t", "SELECT vec_id, pos::int AS pos, label AS e FROM embeddings, (VALUES (0), (1), (2)) v(pos)")
plain("lateral_view", "SELECT n_nationkey, k, v FROM nation LATERAL VIEW explode(map('a', n_regionkey, 'b', n_nationkey)) t AS k, v", "SELECT n_nationkey, 'a' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey FROM nation")
plain("lateral_join", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t")
plain("stack_inline", "SELECT n_nationkey, a, b FROM nation LATERAL VIEW inline(array(struct(1 AS a, n_name AS b), struct(2 AS a, 'x' AS b))) t UNION ALL SELECT n_nationkey, a, b FROM nation LATERAL VIEW stack(2, 3, 'y', 4, 'z') t AS a, b", "SELECT n_nationkey, v.a AS a, CASE WHEN v.a = 1 THEN n_name ELSE v.b END AS b FROM nation, (VALUES (1, ''), (2, 'x'), (3, 'y'), (4, 'z')) v(a, b)")
plain("unpivoted", "SELECT * FROM (SELECT n_nationkey, n_nationkey * 2 AS twice, n_nationkey * 3 AS thrice FROM nation) UNPIVOT (v FOR k IN (twice, thrice))", "SELECT n_nationkey, 'twice' AS k, n_nationkey * 2 AS v FROM nation UNION ALL SELECT n_nationkey, 'thrice', n_nationkey * 3 FROM nation")
plain("aggregates_more", "SELECT l_returnflag, count_if(l_quantity > 25) AS many, max_by(l_orderkey, struct(l_extendedprice, l_orderkey, l_linenumber)) AS dearest, round(skewness(l_quantity), 4) + 0.0 AS sk, round(stddev_pop(l_tax), 6) AS sp, round(var_samp(l_tax), 6) AS vs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, regr_count(l_extendedprice, l_quantity) AS rc, round(covar_samp(l_quantity, l_tax), 4) AS cs, any_value(l_returnflag) AS av FROM lineitem GROUP BY l_returnflag",
      "SELECT l_returnflag, count_if(l_quantity > 25)::bigint AS many, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS dearest, round((avg(l_quantity * l_quantity * l_quantity) - 3 * avg(l_quantity) * var_pop(l_quantity) - avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 4) + 0.0 AS sk, round(stddev_pop(l_tax), 6) AS sp, round(var_samp(l_tax), 6) AS vs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, regr_count(l_extendedprice, l_quantity)::bigint AS rc, round(covar_samp(l_quantity, l_tax), 4) AS cs, any_value(l_returnflag) AS av FROM lineitem GROUP BY l_returnflag")
plain("aggregates_first", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last, mode(o_orderstatus, true) AS usual FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last, (SELECT i.o_orderstatus FROM orders i WHERE i.o_custkey = orders.o_custkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS usual FROM orders GROUP BY o_custkey")
plain("aggregates_approximate", "SELECT event_type, count(DISTINCT user_id) AS users, abs(approx_count_distinct(user_id, 0.01) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) + 1 AS about, abs(percentile_approx(value, 0.5, 10000) - percentile(value, 0.5)) <= 0.02 * abs(percentile(value, 0.5)) + 1 AS middle, abs(kll_sketch_get_quantile_double(kll_sketch_agg_double(value), 0.5D) - percentile(value, 0.5)) <= 0.1 * abs(percentile(value, 0.5)) + 1 AS kll, abs(theta_sketch_estimate(theta_sketch_agg(user_id)) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) + 1 AS theta, abs(hll_sketch_estimate(hll_sketch_agg(user_id, 14)) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) + 1 AS hll FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users, true AS about, true AS middle, true AS kll, true AS theta, true AS hll FROM events GROUP BY event_type")
plain("top_values", "SELECT t.item AS priority, t.count AS n FROM (SELECT explode(approx_top_k(o_orderpriority, 10)) AS t FROM orders)", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
plain("regex_more", "SELECT page_id, regexp_count(url, '[0-9]') AS digits, regexp_instr(url, '[.]') AS dot, regexp_substr(url, '[0-9]+') AS num, array_join(regexp_extract_all(url, '([a-z]+)', 1), ' ') AS words, size(regexp_extract_all(url, '/', 0)) AS depth FROM pages", "SELECT page_id, len(regexp_extract_all(url, '[0-9]'))::int AS digits, instr(url, '.')::int AS dot, CASE WHEN regexp_matches(url, '[0-9]') THEN regexp_extract(url, '[0-9]+') END AS num, array_to_string(regexp_extract_all(url, '[a-z]+'), ' ') AS words, len(regexp_extract_all(url, '/'))::int AS depth FROM pages")
plain("map_more", "SELECT n_nationkey, map_filter(m, (k, v) -> v > 5)['a'] AS big, transform_values(m, (k, v) -> v + 1)['b'] AS up, element_at(map_concat(m, map('c', 9)), 'c') AS c, size(map_entries(m)) AS n, map_from_arrays(array('x', 'y'), array(1, n_regionkey))['y'] AS y, map_contains_key(m, 'a') AS has, map_zip_with(m, map('a', 10, 'b', 20), (k, x, z) -> x + z)['b'] AS zip FROM (SELECT n_nationkey, n_regionkey, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation)", "SELECT n_nationkey, CASE WHEN n_nationkey > 5 THEN n_nationkey END AS big, n_regionkey + 1 AS up, 9 AS c, 2 AS n, n_regionkey AS y, true AS has, n_regionkey + 20 AS zip FROM nation")
plain("json_more", "SELECT n_nationkey, from_json(to_json(named_struct('k', n_nationkey, 'n', n_name)), 'k INT, n STRING').n AS n, json_tuple(to_json(named_struct('a', n_name, 'b', 1)), 'a') AS a FROM nation", "SELECT n_nationkey, n_name AS n, n_name AS a FROM nation")
plain("json_shape", "SELECT n_nationkey, json_array_length(to_json(array(n_nationkey, 2, 3))) AS len, size(json_object_keys(to_json(named_struct('a', 1, 'b', 2)))) AS keys, variant_get(parse_json(to_json(named_struct('x', n_nationkey))), '$.x', 'int') AS x, is_variant_null(parse_json('null')) AS nil FROM nation", "SELECT n_nationkey, 3 AS len, 2 AS keys, n_nationkey AS x, true AS nil FROM nation")
plain("array_more", "SELECT n_nationkey, array_join(array_sort(array(3, n_regionkey, 1)), ',') AS so, array_join(flatten(array(array(1), array(2, 3))), ',') AS fl, array_join(array_except(array(1, 2, 3), array(2)), ',') AS ex, array_join(array_intersect(array(1, 2), array(2, 3)), ',') AS it, array_max(array(1, n_nationkey)) AS mx, array_join(array_repeat('z', 2), '') AS rp, arrays_overlap(array(1, n_regionkey), array(4)) AS ov, forall(array(1, 2), x -> x > 0) AS fa, array_join(array_append(array_prepend(array(2), 1), 3), '') AS ap, size(arrays_zip(array(1, 2), array(3, 4))) AS zp, array_join(array_compact(array(1, NULL, 2)), ',') AS cp, array_join(reverse(sequence(1, 7, 3)), ',') AS sq FROM nation", "SELECT n_nationkey, array_to_string(list_sort([3, n_regionkey, 1]), ',') AS so, '1,2,3' AS fl, '1,3' AS ex, '2' AS it, greatest(1, n_nationkey) AS mx, 'zz' AS rp, n_regionkey = 4 AS ov, true AS fa, '123' AS ap, 2 AS zp, '1,2' AS cp, '7,4,1' AS sq FROM nation")
plain("string_more", "SELECT n_nationkey, initcap(lower(n_name)) AS ic, instr(n_name, 'A') AS ia, locate('N', n_name, 2) AS lo, substring_index(n_name, 'A', 1) AS si, overlay(n_name PLACING '__' FROM 2) AS ov, soundex('Robert') AS sx, hex(n_name) AS hx, base64(encode(n_name, 'utf-8')) AS b6, bit_length(n_name) AS bl, char_length(n_name) AS cl, format_number(n_nationkey * 1234.5, 2) AS fn, find_in_set('b', 'a,b') AS fi, elt(2, 'x', 'y') AS el, url_encode('a b') AS ue, parse_url('https://h.org/p?q=1', 'HOST') AS pu FROM nation", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ic, instr(n_name, 'A')::int AS ia, CASE WHEN instr(n_name[2:], 'N') > 0 THEN instr(n_name[2:], 'N') + 1 ELSE 0 END::int AS lo, string_split(n_name, 'A')[1] AS si, n_name[1:1] || '__' || n_name[4:] AS ov, 'R163' AS sx, hex(n_name) AS hx, base64(encode(n_name)) AS b6, (strlen(n_name) * 8)::int AS bl, length(n_name)::int AS cl, format('{:,.2f}', n_nationkey * 1234.5::double) AS fn, 2 AS fi, 'y' AS el, 'a+b' AS ue, 'h.org' AS pu FROM nation")
plain("hashes_spark", "SELECT n_nationkey, hash(cast(1 AS int)) AS h, xxhash64(cast(1 AS bigint)) AS x, crc32('ABC') AS c FROM nation", "SELECT n_nationkey, -559580957 AS h, -7001672635703045582 AS x, 2743272264 AS c FROM nation")
plain("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 12) SELECT n FROM t")
plain("time_more", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS f, unix_timestamp(o_orderdate) AS u, weekofyear(o_orderdate) AS w, date_part('month', o_orderdate) AS m, cast(date_sub(cast(o_orderdate AS date), 3) AS string) AS b, cast(make_date(2020, 2, 29) AS string) AS md, timestampdiff(DAY, timestamp '1990-01-01', o_orderdate) AS td FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, epoch(o_orderdate)::bigint AS u, weekofyear(o_orderdate)::int AS w, month(o_orderdate)::int AS m, (o_orderdate::date - 3)::varchar AS b, '2020-02-29' AS md, date_diff('day', timestamp '1990-01-01', o_orderdate) AS td FROM orders")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) t WHERE p IS NULL OR ts - p > interval '6 hours' GROUP BY user_id")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps, one window over each user."""
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = base(spark, sf_dir, "events").select("user_id", "ts", F.lag("ts").over(w).alias("p"))
    return rows.where("p IS NULL OR ts - p > interval '6' hour").groupBy("user_id").agg(F.count("*").alias("sessions"))
