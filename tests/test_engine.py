"""Aided and unaided answers are the same, fewer files are read, and losing derived state or asking an old question never changes rows."""

from __future__ import annotations

import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera.cost import Budget, BudgetExceeded
from tessera.functions import expand, terms
from tessera.model import AggFunc, Aggregate, Filter, Measure, Metric, Plan
from tessera.rule import Registry
from tessera.session import APPROXIMATE, STALE, Session
from tessera.sources import read_jdbc
from tessera.sources.cache import ScanCache
from tessera.sources.tablelog import CommitConflict, DataFile, Store, Table, bare, footers
from tessera.store import persist, recover
from tessera.streaming import commit_stream
from tessera.workload import Workload, foreign_scans


@pytest.fixture
def made(spark, tmp_path):
    """Eight files: user 0..7 by range, every type in every file."""
    rows = spark.range(0, 800, 1, 1).select((F.col("id") % 8).alias("user"), F.col("id").alias("n"), F.concat(F.lit("t"), F.col("id") % 3).alias("kind"), F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("word"), F.col("id") % 8, F.lit(" Common, text"))).alias("body"))
    t = Table.create(rows.repartitionByRange(8, "user"), "ev", f"file://{tmp_path}/{uuid.uuid4().hex}")
    s = Session(spark)
    s.attach(t)
    return s, t


def same(s: Session, sql: str):
    got = sorted(map(tuple, s.sql(sql).collect()), key=str)
    report = s.last_scan[0]
    assert got == sorted(map(tuple, s.unaided(sql).collect()), key=str), sql
    return report


def test_footers_and_log(made):
    s, t = made
    assert sum(f.rows for f in t.live()) == 800 and len(t.live()) == 8
    assert all(f.bounds["user"][0] <= f.bounds["user"][1] and "body" not in f.bounds and f.columns["n"] > 0 for f in t.live())
    again = Table.open(s.spark, "ev", t.root)
    assert again.id == t.id and again.schema == t.schema and again.current == t.current and [f.path for f in again.live()] == [f.path for f in t.live()]


def test_index_prunes_and_the_pruned_files_may_be_gone(made):
    s, t = made
    assert same(s, "SELECT n FROM ev WHERE user = 3").files_read == 8
    s.registry.register(ops.build_index(t, "user"))
    for sql, files in (("SELECT n FROM ev WHERE user = 3", 1), ("SELECT n FROM ev WHERE 3 = user AND n > 100", 1), ("SELECT n FROM ev WHERE user IN (1, 2)", 2), ("SELECT n FROM ev WHERE user = 1 OR user = 2", 2), ("SELECT n FROM ev WHERE user = 99", 0), ("SELECT n FROM ev WHERE user > 3", 8)):
        r = same(s, sql)
        assert r.files_read == files, sql
    for f in t.live():
        if not f.bounds["user"][0] <= 3 <= f.bounds["user"][1]:
            os.remove(bare(f.path))
    assert s.sql("SELECT count(*) FROM ev WHERE user = 3").first()[0] == 100
    with pytest.raises(Exception, match="exist|FILE_NOT_EXIST|FileNotFound"):
        s.sql("SELECT sum(n) FROM ev WHERE user > 3").collect()


def test_each_leaf_of_a_self_join_is_pruned_by_its_own_predicate(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    sql = "SELECT a.n FROM ev a JOIN ev b ON a.n = b.n + 1 WHERE a.user = 3 AND b.user = 2"
    assert sorted(s.sql(sql).collect()) == sorted(s.unaided(sql).collect())
    assert [r.files_read for r in s.last_scan] == [1, 1]


def test_bitmap_and_filter_set_scope_rows(made):
    s, t = made
    s.registry.register(ops.build_bitmap(t, "kind"))
    r = same(s, "SELECT n FROM ev WHERE kind = 't1'")
    assert r.row_scoped and r.used
    s.registry.remove(r.used[0])
    s.sql("SELECT n FROM ev WHERE n > 790")
    (text, condition), *_ = s.last_scan[0].conditions.items()
    s.registry.register(ops.build_filter_set(t, Filter(text, frozenset("n")), condition))
    assert same(s, "SELECT n, user FROM ev WHERE n > 790").used
    assert not same(s, "SELECT n, user FROM ev WHERE n > 789").used
    with pytest.raises(ops.NoAdvantage):
        ops.build_filter_set(t, Filter("n >= 0", frozenset("n")), "n >= 0")
    with pytest.raises(ops.NoAdvantage):
        ops.build_filter_set(t, Filter("r", frozenset()), "rand() > 0.5", deterministic=False)


def test_text(made):
    s, t = made
    s.registry.register(ops.build_text_index(t, "body"))
    assert same(s, "SELECT n FROM ev WHERE text_matches(body, 'WORD3 text')").files_read == 1
    assert same(s, "SELECT n FROM ev WHERE text_matches(body, 'word3 word4')").files_read == 0
    assert same(s, "SELECT n FROM ev WHERE text_matches(body, 'wor')").files_read == 0
    assert not same(s, "SELECT n FROM ev WHERE text_matches(body, '...')").used
    assert s.spark.sql(expand("SELECT text_matches(cast(null AS string), 'a')")[0]).first()[0] is None
    with pytest.raises(ValueError):
        s.sql("SELECT n FROM ev WHERE text_matches(body, body)")
    assert terms("Don't stop, 3.5!") == ["don", "t", "stop", "3", "5"]
    with pytest.raises(ValueError):
        ops.build_text_index(t, "n")


def test_stored_rows_and_residual(made):
    s, t = made
    sql = "SELECT n, user FROM ev WHERE kind = 't2'"
    s.sql(sql)
    r = s.last_scan[0]
    s.registry.register(ops.build_materialized(t, Plan(r.plan.projected, r.plan.filters), " AND ".join(r.conditions.values())))
    assert same(s, sql).substituted and not same(s, "SELECT n, user FROM ev WHERE kind = 't1'").substituted
    t.append(s.spark.sql("SELECT 1L AS user, 5000L AS n, 't2' AS kind, 'new' AS body UNION ALL SELECT 1L, 5001L, 't1', 'x'").coalesce(1))
    r = same(s, sql)
    assert r.substituted and r.also_scanned == 1 and 5000 in [x["n"] for x in s.sql(sql).collect()]
    t.delete_where("n = 2")
    r = same(s, sql)
    assert not r.substituted and "subtractive change" in r.refused.values()


def test_projection(made):
    s, t = made
    s.registry.register(ops.build_projection(t, frozenset(("n", "kind"))))
    assert same(s, "SELECT kind, sum(n) AS s FROM ev GROUP BY kind").substituted
    assert not same(s, "SELECT kind FROM ev WHERE user = 1").substituted


CUBE = Aggregate(("kind", "user"), (Measure(AggFunc.COUNT), Measure(AggFunc.SUM, "n"), Measure(AggFunc.MIN, "n"), Measure(AggFunc.MAX, "n"), Measure(AggFunc.AVG, "n"), Measure(AggFunc.COUNT_DISTINCT, "n")))


def test_cubes(made):
    s, t = made
    s.registry.register(ops.build_cube(t, CUBE))
    served = ["SELECT kind, count(*) AS c FROM ev GROUP BY kind", "SELECT count(*) AS c FROM ev", "SELECT user, min(n) AS a, max(n) AS b, avg(n) AS m, sum(n) AS s FROM ev WHERE kind = 't1' GROUP BY user ORDER BY user", "SELECT count(*) AS c, sum(n) AS s FROM ev WHERE user < 0", "SELECT kind AS k, count(1) AS c FROM ev WHERE user IN (1, 2) GROUP BY kind HAVING count(1) > 1"]
    for sql in served:
        assert same(s, sql).used[0].startswith("cube"), sql
    assert s.sql(served[3]).collect() == [(0, None)]
    for sql in ("SELECT kind, count(*) AS c FROM ev WHERE n > 5 GROUP BY kind", "SELECT kind, count(body) AS c FROM ev GROUP BY kind", "SELECT kind, count(DISTINCT n) AS c FROM ev GROUP BY kind", "SELECT kind, count(*) FILTER (WHERE user = 1) AS c FROM ev GROUP BY kind", "SELECT user + 1 AS u, count(*) AS c FROM ev GROUP BY user + 1"):
        assert not same(s, sql).used, sql
    s.spark.conf.set(APPROXIMATE, "true")
    try:
        rows = s.sql("SELECT kind, count(DISTINCT n) AS c FROM ev GROUP BY kind").collect()
        assert s.last_scan[0].approximate and all(abs(r["c"] - 267) < 10 for r in rows)
    finally:
        s.spark.conf.unset(APPROXIMATE)
    empty = ops.build_cube(t, Aggregate((), (Measure(AggFunc.COUNT),)), [(Filter("user >= bigint:2L", frozenset(("user",)), ">=", 2), "user >= 2"), (Filter("kind = string:'t1'", frozenset(("kind",)), "=", "t1"), "kind = 't1'")])
    assert s.spark.read.parquet(empty.kind.path).count() == 1
    t.append(s.spark.sql("SELECT 1L AS user, 1L AS n, 't2' AS kind, 'x' AS body"))
    assert not same(s, served[0]).used


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 1), (2, [0.0, 2.0, 0.0], 1), (3, [0.0, 0.0, 3.0], 2), (4, [4.0, 0.0, 0.0], 2), (5, [0.0, 5.0, 0.0], 1), (6, None, 1)], "id int, v array<float>, g int")
    t = Table.create(rows.repartition(2), "docs", f"file://{tmp_path}/docs")
    s = Session(spark)
    s.attach(t)
    s.registry.register(ops.build_vector_index(t, "v", Metric.L2, 3))
    for sql, used in (("SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)) LIMIT 3", True), ("SELECT id, l2_distance(v, array(0,0,0)) AS d FROM docs WHERE g = 1 ORDER BY d, id LIMIT 2", True), ("SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)) DESC LIMIT 3", False), ("SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)) LIMIT 2 OFFSET 1", False), ("SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D))", False), ("SELECT id FROM docs ORDER BY cosine_distance(v, array(1D,0D,0D)), id LIMIT 2", False)):
        assert bool(same(s, sql).used) is used, sql
    assert [r["d"] for r in s.sql("SELECT id, l2_distance(v, array(0D,0D,0D)) AS d FROM docs ORDER BY id").collect()] == [1, 4, 9, 16, 25, float("inf")]
    assert s.sql("SELECT cosine_distance(v, array(0D,0D,0D)) AS d FROM docs WHERE id = 1").first()[0] == float("inf")
    with pytest.raises(Exception, match="dimensions"):
        s.sql("SELECT l2_distance(v, array(0D,0D)) FROM docs").collect()
    with pytest.raises(ValueError):
        ops.build_vector_index(t, "v", Metric.L2, 4)
    s.registry = Registry()
    s.registry.register(ops.build_vector_index(t, "v", Metric.L2, 3, columns=frozenset(("id",))))
    assert same(s, "SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)) LIMIT 3").used and not same(s, "SELECT id FROM docs WHERE g = 1 ORDER BY l2_distance(v, array(0D,0D,0D)) LIMIT 1").used
    s.registry.register(ops.build_vector_index(t, "v", Metric.L2, 3))
    t.append(rows.limit(1))
    assert same(s, "SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)), id LIMIT 3").used == []
    spark.conf.set(STALE, "true")
    try:
        s.sql("SELECT id FROM docs ORDER BY l2_distance(v, array(0D,0D,0D)), id LIMIT 3").collect()
        assert s.last_scan[0].used and len(s.last_scan[0].missed) == 1
    finally:
        spark.conf.unset(STALE)


def test_joins(made):
    s, t = made
    s.spark.range(0, 5).select(F.col("id").alias("user"), F.concat(F.lit("name"), "id").alias("name")).createOrReplaceTempView("people")
    s.registry.register(ops.build_join_hash(t, ("user",), frozenset(("n",))))
    for kind, used in (("JOIN", True), ("LEFT JOIN", True), ("RIGHT JOIN", False), ("FULL JOIN", False)):
        assert bool(same(s, f"SELECT e.n, p.name FROM ev e {kind} people p ON e.user = p.user").used) is used, kind
    assert not same(s, "SELECT e.n, e.kind, p.name FROM ev e JOIN people p ON e.user = p.user").used
    assert not same(s, "SELECT e.n FROM ev e JOIN people p ON e.user < p.user").used


def test_a_stored_join_side_is_not_shuffled(made):
    s, t = made
    s.spark.range(0, 5).select(F.col("id").alias("user"), F.concat(F.lit("name"), "id").alias("name")).createOrReplaceTempView("people")
    piece = ops.build_join_hash(t, ("user",), frozenset(("n",)))
    persist(t, piece)
    s.registry = recover(t).registry
    before = s.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    s.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = s.sql("SELECT e.n, p.name FROM ev e JOIN people p ON e.user = p.user")
        assert df.count() == 500 and s.last_scan[0].used == [piece.id]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
    finally:
        s.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_what_scans_have_read(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    rows, _ = s.measured("SELECT n FROM ev WHERE user = 3")
    assert len(rows) == 100 and s.last_read.files == 1 and s.last_read.rows >= 100 and 0 < s.last_read.bytes < t.bytes / 4
    s.measured("SELECT a.n, (SELECT max(n) FROM ev) AS m FROM ev a JOIN ev b ON a.n = b.n")
    assert s.last_read.files >= 16


def test_scans_of_another_application(made, tmp_path):
    """Its event log says what it scanned, by which equalities, and how many bytes."""
    s, t = made
    log = tmp_path / "events"
    log.mkdir()
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", "file://{log}").getOrCreate()
d = s.read.parquet({t.live()[0].path.rsplit('/', 1)[0]!r})
d.where("user = 3 and n > 5").select("n", "kind").collect()
d.groupBy("kind").count().collect()
s.range(3).collect()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    scans = foreign_scans(s.spark, f"file://{log}", {"ev": t.root})
    assert [(x.table, x.equalities, x.projected) for x in scans] == [("ev", frozenset(("user",)), frozenset(("user", "n", "kind"))), ("ev", frozenset(), frozenset(("kind",)))]
    assert all(0 < x.bytes <= t.bytes for x in scans)
    w = Workload()
    for x in scans:
        w.observe_foreign(x)
    assert w.scans["ev"] == 2 and not w.credits


def test_policy_branch_compaction_time_travel(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user", policy="other"))
    r = same(s, "SELECT n FROM ev WHERE user = 3")
    assert r.files_read == 8 and "policy mismatch" in r.refused.values()
    s.registry.register(ops.build_index(t, "user"))
    first = t.current
    t.compact([bare(f.path) for f in t.live()[:4]])
    assert same(s, "SELECT n FROM ev WHERE user = 7").files_read <= 2
    t.branch(first, s.spark.sql("SELECT 3L AS user, 9L AS n, 't1' AS kind, 'b' AS body"))
    s.registry.register(ops.build_index(t, "user"))
    t.branch(first, s.spark.sql("SELECT 3L AS user, 10L AS n, 't1' AS kind, 'b' AS body"))
    assert "not a descendant" in same(s, "SELECT n FROM ev WHERE user = 3").refused.values()
    old = Session(s.spark)
    old.attach(Table.open(s.spark, "ev", t.root, at=first))
    assert old.sql("SELECT count(*) FROM ev").first()[0] == 800
    with pytest.raises(KeyError):
        Table.open(s.spark, "ev", t.root, at=99)


def test_marked_deletes_refuse_stored_rows_but_not_prunes(made):
    s, t = made
    s.registry.register(ops.build_projection(t, frozenset(("n", "user"))))
    s.registry.register(ops.build_index(t, "user"))
    t.mark_deletes({bare(t.live()[0].path): 77})
    r = same(s, "SELECT n FROM ev WHERE user = 3")
    assert r.used and r.used[0].startswith("idx") and "subtractive change" in r.refused.values()


def test_budget_refuses_before_anything_runs(made):
    s, t = made
    small = Session(s.spark, registry=s.registry, budget=Budget(bytes=10))
    small.attach(t)
    with pytest.raises(BudgetExceeded):
        small.sql("SELECT * FROM ev")


def test_explain_reads_nothing(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    for f in t.live():
        os.remove(bare(f.path))
    text = s.explain("SELECT n FROM ev WHERE user = 3")
    assert "use idx" in text and "8 files" in text


def test_subqueries_and_unions_still_answer(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    for sql in ("SELECT n FROM ev WHERE n = (SELECT max(n) FROM ev WHERE user = 3)", "SELECT n FROM ev WHERE user = 1 UNION ALL SELECT n FROM ev WHERE user = 2", "WITH x AS (SELECT * FROM ev WHERE user = 2) SELECT count(*) AS c FROM x WHERE n % 2 = 0", "SELECT user, rank() OVER (PARTITION BY kind ORDER BY n) AS r FROM ev WHERE user = 4"):
        same(s, sql)


def test_a_repeated_scan_reads_nothing(made):
    s, t = made
    c = Session(s.spark, registry=s.registry, cache=ScanCache(1 << 20))
    c.attach(t)
    s.registry.register(ops.build_index(t, "user"))
    for sql in ("SELECT n FROM ev WHERE user = 3", "SELECT sum(n) AS s FROM ev"):
        first = sorted(map(tuple, c.sql(sql).collect()))
        origin = c.cache.origin_bytes
        for f in t.live():
            os.rename(bare(f.path), bare(f.path) + ".away")
        assert sorted(map(tuple, c.sql(sql).collect())) == first
        assert c.last_scan[0].cached and c.cache.origin_bytes == origin
        assert c.origin.spent.bytes < c.meter.spent.bytes  # a hit is asked for, but doesn't go to the store
        for f in t.live():
            os.rename(bare(f.path) + ".away", bare(f.path))
    held = len(c.cache.held)
    t.compact([bare(f.path) for f in t.live()[:2]])
    c.cache.forget(t)
    assert len(c.cache.held) < held
    tiny = ScanCache(1)
    tiny.read(t, [bare(t.live()[0].path)], ["n"])
    assert tiny.bytes == 0


SHAPES_OF_TEXT = ("SELECT\n  n FROM ev", "SELECT\tn FROM ev", "/* why */ SELECT n FROM ev", "-- why\nSELECT n FROM ev", "WITH\nx AS (SELECT n FROM ev) SELECT n FROM x", "TABLE ev", "( SELECT n FROM ev )", "FROM ev SELECT n", "FROM ev |> SELECT n", "select n from EV", "SELECT n, 'Relation [' AS r, \"text_matches(x)\" AS t FROM ev")


@pytest.mark.parametrize("sql", SHAPES_OF_TEXT)
def test_text_as_people_write_it(made, sql):
    s, t = made
    assert s.sql(sql).count() == 800
    small = Session(s.spark, budget=Budget(bytes=1))
    small.attach(t)
    with pytest.raises(BudgetExceeded):
        small.sql(sql)


def test_commands_run_once_over_live_files(made):
    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    name = f"made_{uuid.uuid4().hex}"
    small = Session(s.spark, budget=Budget(bytes=1))
    small.attach(t)
    for refused in (f"CREATE TABLE {name} USING parquet AS SELECT * FROM ev", f"INSERT OVERWRITE DIRECTORY '{t.root}/out' USING parquet SELECT * FROM ev", "CACHE TABLE kept AS SELECT * FROM ev"):
        with pytest.raises(BudgetExceeded):
            Session(s.spark, budget=Budget(bytes=1)).attach(t) and small.sql(refused)
    try:
        s.sql(f"CREATE TABLE {name} USING parquet AS\nSELECT * FROM ev WHERE user = 3")
        assert s.last_scan[0].files_read == 1 and s.spark.table(name).count() == 100
        s.sql(f"INSERT INTO {name} SELECT * FROM ev")
        assert s.spark.table(name).count() == 900
        s.sql(f"WITH x AS (SELECT * FROM ev WHERE user = 2) INSERT INTO {name} SELECT * FROM x")
        assert s.spark.table(name).count() == 1000 and s.last_scan[0].files_read == 1
        s.sql(f"FROM ev INSERT INTO {name} SELECT * WHERE user = 1 INSERT INTO {name} SELECT * WHERE user > 9")
        assert s.spark.table(name).count() == 1100
        s.sql(f"INSERT OVERWRITE DIRECTORY '{t.root}/out' USING parquet SELECT n FROM ev")
        assert s.spark.read.parquet(f"{t.root}/out").count() == 800
        assert any(r[1] == name for r in s.sql("SHOW TABLES").collect())
        assert s.sql("DESCRIBE ev").count() == 4
        assert "Scan parquet" in s.sql("EXPLAIN FORMATTED SELECT n FROM ev WHERE user = 3").first()[0]
        s.sql("CREATE OR REPLACE TEMP VIEW evens AS SELECT * FROM ev WHERE n % 2 = 0")
        assert s.sql("SELECT * FROM evens WHERE user = 4").count() == 100 and s.last_scan[0].files_read == 1
        s.sql("SET tessera.some = 1")
        assert s.spark.conf.get("tessera.some") == "1"
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            s.sql(f"CREATE TABLE {name} USING parquet AS SELECT * FROM ev")
    finally:
        s.spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_two_snapshots_of_one_table_under_two_names(made):
    s, t = made
    first = t.current
    t.append(t.read().limit(5))
    old = Table.open(s.spark, "old", t.root, at=first)
    s.attach(old)
    assert s.sql("SELECT (SELECT count(*) FROM old) AS a, (SELECT count(*) FROM ev) AS b").collect() == [(800, 805)]
    assert s.sql("SELECT 1 AS x, count(*) AS c FROM old UNION ALL SELECT 2, count(*) FROM ev ORDER BY x").collect() == [(1, 800), (2, 805)]


SCRIPTS = ["हिन्दी में लिखा", "กรุงเทพ มหานคร", "İstanbul DİYARBAKIR", "cafe\u0301 na\u00efve", "Ελλάδα ΣΟΦΟΣ", "日本語 テキスト", "x² ½ Ⅳ", "under_score", None]


def test_terms_of_all_scripts(spark, tmp_path):
    t = Table.create(spark.createDataFrame(list(enumerate(SCRIPTS)), "id int, body string").repartitionByRange(len(SCRIPTS), "id"), "scripts", f"file://{tmp_path}/scripts")
    s = Session(spark)
    s.attach(t)
    for indexed in (False, True):
        for i, body in enumerate(SCRIPTS[:-1]):
            for word in (body, *body.split()):
                rows = s.sql(f"SELECT id FROM scripts WHERE text_matches(body, '{word}')").collect()
                assert [r[0] for r in rows] == [i], (word, indexed)
                assert s.last_scan[0].files_read == (1 if indexed else len(t.live()))
        s.registry.register(ops.build_text_index(t, "body"))
    assert s.sql("SELECT id FROM scripts WHERE text_matches(body, 'underscore')").count() == 0
    assert s.sql("SELECT id FROM scripts WHERE /* text_matches(a) */ text_matches(body, 'score') -- text_matches(").count() == 1


def test_two_writers(made):
    s, t = made
    a, b = Table.open(s.spark, "ev", t.root), Table.open(s.spark, "ev", t.root)
    a.append(t.read().limit(5))
    b.append(t.read().limit(7))
    assert Table.open(s.spark, "ev", t.root).read().count() == 812 and b.read().count() == 812
    with pytest.raises(CommitConflict):
        a.delete_where("n = 3")  # rows that were added meanwhile haven't been looked at
    a = Table.open(s.spark, "ev", t.root)
    c = Table.open(s.spark, "ev", t.root)
    some = [bare(f.path) for f in t.live()[:2]]
    a.compact(some)
    with pytest.raises(CommitConflict):
        c.compact(some)
    with pytest.raises(CommitConflict):
        c.delete_where("n >= 0")
    c.append(t.read().limit(1))
    assert Table.open(s.spark, "ev", t.root).read().count() == 813
    with pytest.raises(FileExistsError):
        Table.create(t.read(), "ev", t.root)
    store = a.store
    assert store.create(f"{t.root}/once", "1") and not store.create(f"{t.root}/once", "2") and store.read(f"{t.root}/once") == "1"
    store.write(f"{t.root}/once", "3")
    assert store.read(f"{t.root}/once") == "3"


def test_writers_at_once_lose_nothing(made):
    from concurrent.futures import ThreadPoolExecutor

    s, t = made
    rows = t.read().limit(1)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: [Table.open(s.spark, "ev", t.root).append(rows) for _ in range(3)], range(4)))
    again = Table.open(s.spark, "ev", t.root)
    assert again.current == 13 and again.read().count() == 812


def test_opening_reads_a_checkpoint_and_what_follows(made, monkeypatch):
    s, t = made
    for i in range(119):
        t._change([DataFile(f"file:///nowhere/{i}", 10, 1)], batch=("stream", i))
    read = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, path: read.append(path) or real(self, path))
    again = Table.open(s.spark, "ev", t.root)
    assert again.current == 120 and again.totals().files == 8 + 119 and len(read) == 21 and again.batches == {"stream": 118}
    assert Table.open(s.spark, "ev", t.root, at=30).totals().files == 8 + 29 and Table.open(s.spark, "ev", t.root, at=60).totals().files == 8 + 59
    assert again.graph.diff(1, 120).additive and len(again.graph.diff(10, 70).added) == 60 and again.graph.descends(120, 1)


def test_footers_by_tasks_are_the_same(made):
    s, t = made
    s.spark.sql("SELECT 1 AS a, cast(null AS int) AS b, 1.5D AS c, timestamp '2020-01-01' AS ts, array(1, 2) AS xs, 'x' AS z, named_struct('u', 7L) AS st").coalesce(1).write.parquet(f"{t.root}/kinds")
    paths = [(f.path, f.bytes) for f in t.live()] + [x for x in t.store.list(f"{t.root}/kinds") if x[0].endswith(".parquet")]
    here, there = footers(t.store, paths), footers(t.store, paths, here=0)
    assert sorted(here, key=lambda f: f.path) == there


def test_a_batch_is_committed_once(spark, tmp_path):
    t = Table.create(spark.range(3), "st", f"file://{tmp_path}/st")
    late = Table.open(spark, "st", t.root)
    assert t.append(spark.range(2), ("here", 0)) == 2
    # the same batch again, by a writer that has seen the commit, and by one that hasn't
    for again in (t, late):
        assert again.append(spark.range(2), ("here", 0)) == 2
    assert late.read().count() == 5 and Table.open(spark, "st", t.root).read().count() == 5
    spark.range(4).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    fresh = Table.open(spark, "st", t.root)
    append = Table.append
    try:
        def crash(self, df, batch=None):
            append(self, df, batch)
            raise RuntimeError("between the commit and the stream's own log")

        Table.append = crash
        with pytest.raises(Exception, match="between"):
            commit_stream(stream(), fresh, f"{tmp_path}/ck").awaitTermination()
    finally:
        Table.append = append
    commit_stream(stream(), Table.open(spark, "st", t.root), f"{tmp_path}/ck").awaitTermination()
    assert Table.open(spark, "st", t.root).read().count() == 9


def test_recovered_cube_serves_implied_ranges(made):
    s, t = made
    ask = Aggregate(("kind", "user"), (Measure(AggFunc.COUNT),))
    persist(t, ops.build_cube(t, ask, [(Filter("user >= bigint:2L", frozenset(("user",)), ">=", 2), "user >= 2")]))
    found = recover(t)
    assert not found.discarded
    s.registry = found.registry
    assert same(s, "SELECT kind, count(*) AS c FROM ev WHERE user >= 3 GROUP BY kind").used


def test_user_functions_in_aided_queries(made):
    """Scalar and aggregate functions that the user has registered; the filter beside them still prunes."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    s, t = made
    s.registry.register(ops.build_index(t, "user"))
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    twice.__annotations__ = {"x": pd.Series, "return": pd.Series}
    s.spark.udf.register("twice", pandas_udf(twice, "long"))

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    spread.__annotations__ = {"x": pd.Series, "return": float}
    s.spark.udf.register("spread", pandas_udf(spread, "double"))
    s.spark.udf.register("plain_half", lambda x: x // 2, "long")
    for sql in ("SELECT twice(n) AS d, plain_half(n) AS h FROM ev WHERE user = 3", "SELECT kind, spread(n) AS s FROM ev WHERE user = 3 GROUP BY kind"):
        assert same(s, sql).files_read == 1, sql
    assert same(s, "SELECT n FROM ev WHERE user = 3 AND twice(n) > 100").files_read == 1
    s.sql("SELECT n FROM ev WHERE plain_half(n) = 3 AND user = 3").collect()
    assert not any("cube" in u for u in s.last_scan[0].used)


def test_jdbc(spark):
    """Through Derby, which Spark brings along."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").write.jdbc(url, "things", properties=options)
    df = read_jdbc(spark, url, "things", **options)
    assert sorted(map(tuple, df.where("ID > 0").collect()), key=str) == [(1, "a"), (2, None)]


def test_explaining_commands_and_reading_footers_of_nothing(made):
    s, t = made
    assert "command" in s.explain("SHOW TABLES")
    assert "8 files" in s.explain(f"INSERT OVERWRITE DIRECTORY '{t.root}/x' USING parquet SELECT * FROM ev")
    assert footers(t.store, []) == [] and not t.store.exists(f"{t.root}/x")
    t.delete_where("n >= 0")
    assert s.sql("SELECT * FROM ev").count() == 0 and s.sql("SELECT count(*) AS c FROM ev WHERE user = 1").first()[0] == 0
    s.registry.register(ops.build_index(t, "user"))
    t.append(s.spark.sql("SELECT 1L AS user, 5L AS n, 't' AS kind, 'b' AS body"))
    assert same(s, "SELECT n FROM ev WHERE user = 1").files_read == 1


def test_files_of_lost_attempts_are_reclaimed(made):
    s, t = made
    late = Table.open(s.spark, "ev", t.root)
    t.delete_where("n = 3")
    with pytest.raises(CommitConflict):
        late.delete_where("n = 11")
    again = Table.open(s.spark, "ev", t.root)
    assert again.orphans() == [] and len(again.orphans(0)) == 1
    assert again.reclaim(0) > 0 and again.orphans(0) == []
    assert again.read().count() == 799 and Table.open(s.spark, "ev", t.root, at=1).read().count() == 800
