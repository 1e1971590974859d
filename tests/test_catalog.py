"""Every registered query of the engine against the SQL that answers the same question."""

from __future__ import annotations

import re

import duckdb
import pytest

from tessera import catalog
from tessera.sources.tablelog import Table


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in catalog.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    con = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, con.fetchall())


#: Queries that must be answered with derived state, and by what; the others of a session must use none.
USED = {
    "index_eq": "idx", "index_in_or": "idx", "index_many_lines": "idx", "two_index_intersect": "idx", "bitmap_rows": "bmp", "filter_set_reuse": "fset", "stale_index_residual": "idx", "compacted": "idx", "materialized_reuse": "mat", "materialized_residual": "mat",
    "projection_substitute": "proj", "cube_same_grain": "cube", "cube_rollup": "cube", "cube_key_filter": "cube", "cube_global_count": "cube", "cube_empty_global": "cube", "cube_having_order": "cube", "cube_range_implied": "cube", "count_distinct_optin": "cube",
    "topk_l2": "vec", "topk_cosine": "vec", "topk_filtered": "vec", "text_match_many": "txt", "text_match_punctuation": "txt", "text_match_scripts": "txt", "join_inner": "jh", "join_left": "jh", "create_table_as": "idx",
    "branch_refused": None, "policy_refused": None, "time_travel": None, "join_right": None,
}


@pytest.mark.parametrize("name", sorted(USED))
def test_what_was_used(spark, data, name):
    catalog.QUERIES[name](spark, data)
    used = [u.split(":")[0] for r in catalog.latest[0].last_scan for u in r.used]
    assert (USED[name] in used) if USED[name] else not used


def _many_lines(sql: str) -> str:
    """The same text over several lines, behind comments."""
    parts = re.split(r"('[^']*')", sql)
    return "-- a question\n/* over\nlines */\n" + "".join(p if i % 2 else p.replace(" ", "\n\t") for i, p in enumerate(parts))


def test_every_query_over_many_lines(spark, data):
    """Through a session, whatever the text looks like: equal rows, and none is answered from a shape."""
    tables = [Table.create(spark.read.parquet(f"{data}/{n}.parquet"), n, f"{catalog.root(spark)}/{n}") for n in catalog.NAMES]
    s = catalog.session_of(spark, *tables)
    for name, sql in catalog.NATIVE.items():
        got, want = s.sql(_many_lines(sql)), catalog.QUERIES[name](spark, data)
        assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect()), name


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
