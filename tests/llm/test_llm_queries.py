"""Every training-data query over the smallest tables, against its SQL twin where there is one."""

import glob
import os

import duckdb
import pytest

from sievelark.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["name_a", "name_b"], "p2_found": ["item_ord_a", "item_ord_b"], "p4_found": ["tbl", "row_id"], "p5_found": ["tbl", "row_id", "first_id"],
    "p6_found": ["tbl", "row_key", "element", "content"], "p7_found": ["item_ord"], "p10_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    if name in COLUMNS:
        assert got.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        assert sorted(rows) == sorted(con.execute(queries.ORACLES[name]).fetchall())
