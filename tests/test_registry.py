"""Registered queries against their SQL equivalents on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import extras as registry

DATA = "/root/testdata/sf0.001"
#: Queries of the whole post-processing, of which two stand for all; the driver's comparison has them all.
LONG = {
    "a10_table_sizes", "a35_post_processed", "j3_page_matches", "j7_response_boxes", "o1_sorted_cells", "pf11_delete_columns", "pf11_deleted_columns",
    "pf14_pages", "postprocess_canonical_cells", "postprocess_canonical_matches", "postprocess_simplified_matches", "sk1_response_documents",
    "w10_j11_place_orphans", "w6_duplicate_columns", "w8_reindex", "w9_j10_nearest_bands",
}


def plain(v):
    """Numbers without the sign of zero and the last places."""
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(registry.SQL.keys() - LONG))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(registry.SQL[name])
    cols = sorted(want.columns)
    found = registry.QUERIES[name](spark, DATA)
    got = sorted(map(repr, (tuple(map(plain, (r[c] for c in cols))) for r in found.collect())))
    order = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float"}
    types = dict(found.dtypes)
    assert all(types[c] == kinds[str(t)] for c, t in zip(want.columns, want.types))


def test_entry_names():
    assert set(registry.SQL) <= set(__spark_entry__.queries())


def test_post_processing_stays_within_tables(spark):
    """Cells and tokens are dealt by table once; the steps after that add no exchange but for a table's own figures."""
    from gridloom.operators import lineage, match, postprocess
    from gridloom.sources import fixtures as fx

    cells, tokens = lineage.by_table(fx.table_cells(spark, DATA)), lineage.by_table(fx.pdf_cells(spark, DATA))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = match.intersection_over_token(cells, tokens)
        assert "Exchange hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
        best = match.best_match(pairs)
        assert "Exchange hashpartitioning" not in best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_nested_loops(spark):
    plan = registry.QUERIES["flagship_best_match"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
