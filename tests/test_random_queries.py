"""Random questions over a table of many types, with every kind of derived state there and the table changing: aided and plain answers agree."""

from __future__ import annotations

import random

import pytest

from tessera import operators as ops
from tessera.model import AggFunc, Aggregate, Measure, Plan
from tessera.session import Session
from tessera.sources.tablelog import Table

#: Columns, and literals to compare them with: of their own type, and of others that Spark casts.
LITERALS = {
    "k": ["3", "3L", "2.0", "'3'"], "u": ["4", "4L", "cast(4 as int)", "1+3"], "name": ["'n1'", "'n2'", "'zz'"], "dec": ["3", "3.00", "cast(2 as decimal(10,2))"], "ts": ["timestamp'2024-01-03 00:00:00'", "'2024-01-04'"],
    "day": ["date'2024-01-03'", "'2024-01-02'"], "v": ["30.0", "45D", "60"], "`odd col`": ["1", "2S"], "flag": ["true"], "f": ["2.0", "3"],
}
AGGREGATES = ["count(*)", "sum(k)", "min(ts)", "max(dec)", "avg(k)", "count(name)", "count(1)", "sum(dec)", "avg(dec)", "count(DISTINCT k)", "sum(f)", "max(v)"]


class Questions:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def predicate(self) -> str:
        r, c = self.r, self.r.choice(list(LITERALS))
        x = r.choice(LITERALS[c])
        return r.choice([
            f"{c} = {x}", f"{c} = {x}", f"{c} = {x}", f"{c} {r.choice(['<', '<=', '>', '>=', '<>'])} {x}", f"{c} {r.choice(['<', '<=', '>', '>=', '<>'])} {x}", f"{c} IN ({', '.join(r.sample(LITERALS[c], min(2, len(LITERALS[c]))))})", f"{x} = {c}",
            f"({c} = {x} OR {c} = {r.choice(LITERALS[c])})", f"{c} IS NOT NULL", f"{c} IS NULL", f"{c} <=> {x}", f"NOT ({c} = {x})", f"({c} = {x} OR {r.choice(list(LITERALS))} IS NULL)",
        ])

    def where(self) -> str:
        n = self.r.choice([0, 1, 1, 2, 3])
        return " WHERE " + " AND ".join(self.predicate() for _ in range(n)) if n else ""

    def next(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.35:
            return f"SELECT id, {', '.join(r.sample(list(LITERALS), 2))} FROM ev{self.where()}"
        if kind < 0.7:
            keys = r.sample(list(LITERALS), r.choice([0, 1, 1, 2]))
            what = ", ".join([*keys, *(f"{x} AS a{i}" for i, x in enumerate(r.sample(AGGREGATES, r.choice([1, 2, 3]))))])
            return f"SELECT {what} FROM ev{self.where()}" + (f" GROUP BY {', '.join(keys)}" if keys else "") + (" HAVING count(*) > 5" if keys and r.random() < 0.2 else "")
        return r.choice([
            "SELECT a.id FROM ev a JOIN ev b ON a.id = b.id AND a.k = b.k WHERE a.k = 3 AND b.u = 4", f"WITH x AS (SELECT * FROM ev{self.where()}) SELECT k, count(*) AS c FROM x GROUP BY k", f"SELECT id FROM ev{self.where()} UNION ALL SELECT u FROM ev{self.where()}",
            f"SELECT e.id, e.k, p.pname FROM ev e {r.choice(['JOIN', 'LEFT JOIN', 'RIGHT JOIN'])} people p ON e.u = p.u", f"SELECT id FROM ev WHERE text_matches(name, '{r.choice(['n1', 'N2', 'n1 n2', 'zz', '...'])}')", f"SELECT id FROM ev WHERE k = (SELECT max(k) FROM ev{self.where()})",
        ])


def rows_of(df) -> list:
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_queries(spark, tmp_path, seed):
    rows = spark.range(0, 400, 1, 1).selectExpr(
        "id", "cast(id % 7 as int) as k", "id % 11 as u", "case when id % 13 = 0 then null else concat('n', id % 5) end as name", "cast(id % 9 as decimal(10,2)) as dec", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id % 10 as int),0,0,0) as ts",
        "date_add(date'2024-01-01', cast(id % 6 as int)) as day", "id * 1.5D as v", "cast(id % 3 as smallint) as `odd col`", "id % 2 = 0 as flag", "cast(id % 5 as float) as f",
    )
    t = Table.create(rows.repartitionByRange(6, "u"), "ev", f"file://{tmp_path}/ev")
    spark.range(0, 9).selectExpr("id as u", "concat('p', id) as pname").createOrReplaceTempView("people")
    s = Session(spark)
    s.attach(t)
    m = Measure
    measures = (m(AggFunc.COUNT), m(AggFunc.SUM, "k"), m(AggFunc.MIN, "ts"), m(AggFunc.MAX, "dec"), m(AggFunc.AVG, "k"), m(AggFunc.COUNT, "name"), m(AggFunc.SUM, "dec"), m(AggFunc.AVG, "dec"), m(AggFunc.SUM, "f"))
    pieces = [ops.build_index(t, c) for c in ("k", "u", "name", "odd col", "dec", "day", "ts")] + [ops.build_bitmap(t, c) for c in ("flag", "f")]
    pieces += [ops.build_cube(t, Aggregate(keys, measures)) for keys in (("k", "u", "name"), ("day", "flag"), ("ts", "dec"), ("odd col", "f"))]
    pieces += [ops.build_projection(t, frozenset(c)) for c in (("k", "u", "v"), ("name", "dec", "ts", "day"))] + [ops.build_join_hash(t, ("u",), frozenset(("id", "k", "name"))), ops.build_text_index(t, "name")]
    for piece in pieces:
        s.registry.register(piece)
    q, used = Questions(seed), 0
    for turn in range(90):
        sql = q.next()
        try:
            want = rows_of(s.unaided(sql))
        except Exception:
            with pytest.raises(Exception):  # noqa: B017, PT011
                s.sql(sql).collect()
            continue
        assert rows_of(s.sql(sql)) == want, (sql, [x.used for x in s.last_scan])
        used += any(x.used for x in s.last_scan)
        if turn % 6 == 0 and (scan := next((x for x in s.last_scan if x.plan and x.deterministic), None)):
            conditions = {f.text: Session._condition(f) for f in scan.plan.filters}
            s.registry.register(ops.build_materialized(t, Plan(scan.plan.projected, scan.plan.filters), " AND ".join(f"({c})" for c in conditions.values()) or None))
            if turn % 12 == 0 and scan.plan.filters:
                f = sorted(scan.plan.filters, key=lambda f: f.text)[0]
                try:
                    s.registry.register(ops.build_filter_set(t, f, conditions[f.text]))
                except ops.NoAdvantage:
                    pass
        if turn in (40, 60):
            t.append(rows.where(f"id % 50 = {turn}").coalesce(1))
        if turn == 70:
            t.compact(list(t.graph.get(t.current).files)[:2])
        if turn == 80:
            t.delete_where("id = 17")
    assert used > 20


def test_columns_that_are_only_tested_for_null(spark, tmp_path):
    """They are needed by what stands for a scan, though no other filter names them."""
    t = Table.create(spark.sql("SELECT id AS a, id % 3 AS b, IF(id % 4 = 0, NULL, id) AS c FROM range(60)").repartition(2), "ev", f"file://{tmp_path}/nulls")
    s = Session(spark)
    s.attach(t)
    s.registry.register(ops.build_projection(t, frozenset(("a", "b"))))
    assert s.sql("SELECT count(*) AS n FROM ev WHERE c IS NOT NULL").collect() == [(45,)] and not s.last_scan[0].used
    assert s.sql("SELECT sum(a) AS n FROM ev WHERE b IS NOT NULL").collect() == [(1770,)] and s.last_scan[0].used
