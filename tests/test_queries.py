"""Every registered query of the mobility engine against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from roadloom.plans import ORACLES, QUERIES, catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


#: Columns that identify a row of the queries without SQL; their operators are held against brute force elsewhere.
KEYS = {"congested_equilibrium": ["scenario", "grid_o", "grid_d"], "counterfactual_suite": ["scenario"], "voronoi_assign": ["vec_id"], "voronoi_polygons": ["cline_id"], "skeleton_pixels": ["px", "py"], "skeleton_chains": ["chain"]}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows_of_its_own_key(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and len({tuple(r[k] for k in KEYS[name]) for r in rows}) == len(rows)
