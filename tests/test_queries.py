"""Every query with SQL against DuckDB on the smallest tables, and what holds for the others."""

import os

import duckdb
import pytest

from quadrille.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in order) for r in df.collect())
    at = [list(want.columns).index(c) for c in order]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())


def test_blocks_and_tables(spark):
    found = QUERIES["blocks"](spark, SF).collect()
    assert found and all((r.ex - r.sx + 1) * (r.ey - r.sy + 1) >= 2 for r in found)
    assert any(r.type == "float" for r in QUERIES["tables"](spark, SF).collect())


def test_colours_differ_between_neighbours(spark):
    from quadrille.operators import rect
    from quadrille.plans.registry import Tables, part_rects

    colour = {r.id: r.colour for r in QUERIES["coloring"](spark, SF).collect()}
    rects = part_rects(Tables(spark, SF))
    pairs = [(r.a_id, r.b_id) for r in rect.adjacent(rects).collect()] + [(r.a_id, r.b_id) for r in rect.intersecting(rects).collect()]
    assert pairs and all(colour[a] != colour[b] for a, b in pairs)
    assert {r.cluster for r in QUERIES["kmeans_rects"](spark, SF).collect()} == set(range(8))
