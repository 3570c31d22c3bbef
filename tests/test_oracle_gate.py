"""The driver's correctness gate inside pytest: a representative set of registered
queries against their DuckDB oracle at sf0.001 (names, types, normalised values)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

GATE = ["engineer_features", "profile_describe", "histogram_30", "distinct_counts", "class_distribution_by_split",
        "group_holdout", "stratified_split", "group_kfold", "standardize", "classification_report",
        "prediction_export", "parse_records", "lineitem_stratified_split", "preparation_run"]
TMAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", GATE)
def test_query_matches_duckdb(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    stypes = {f.name: TMAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    srows = [tuple(r) for r in sdf.collect()]
    drows = rel.fetchall()
    assert rows_of(sdf.columns, srows) == rows_of(rel.columns, drows)
