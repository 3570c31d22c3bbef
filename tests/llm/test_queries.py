"""Registration of the thirteen queries and the pipeline; the DuckDB oracle of those that SQL can express."""

import os
import sys

import __spark_entry__ as E
import corpus_pipeline
from beaconflow.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from oracle_check import duck, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 14)) and len(QUERIES) == 13
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert all((f.__doc__ or "").strip() for f in QUERIES.values())
    assert set(ORACLE) <= set(E.oracle_sql())


def test_oracles(spark):
    con = duck(SF)
    for name, sql in ORACLE.items():
        df, rel = QUERIES[name](spark, SF), con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
