"""Queries of the subpackage over whole tables: oracles where SQL has one, held-out accuracy and recall where not."""

from __future__ import annotations

import duckdb
import numpy as np

from tenorlake.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"


def test_oracles(spark):
    con = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert differences(queries.queries()[name](spark, SF), con, sql) == "", name


def test_recall_of_neighbours(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T
    np.fill_diagonal(near, -2)
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 50 == 0) for j in np.argsort(-near[i], kind="stable")[:5]}
    got = {(r.query_id, r.vec_id) for r in queries.op6_neighbours(spark, SF).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = scored.selectExpr("avg(cast(predicted = toxic as double))", "sum(toxic)", "sum(predicted * toxic)").head()
    assert right[0] >= 0.98 and right[2] >= 0.9 * right[1]


def test_licenses_of_planted_lines(spark):
    found = queries.op10_licenses(spark, SF)
    con = duckdb.connect()
    planted = con.execute(f"SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM '{SF}/documents.parquet') WHERE line LIKE 'Licensed under%' OR line LIKE 'Released under%License.' OR line LIKE 'This work is licensed%'").fetchall()[0][0]
    assert found.selectExpr("sum(n_licenses)").head()[0] >= planted > 0
