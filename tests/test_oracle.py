"""Every query with SQL meaning agrees with DuckDB on the smallest tables."""

import numpy as np
import pandas as pd
import pytest
from tables import SF_TINY

import __spark_entry__ as contract

ORACLE = contract.oracle_sql()
QUERIES = contract.queries()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
            return None
        if isinstance(value, (bool, np.bool_)):
            return bool(value)
        if isinstance(value, (int, float, np.number)):
            return round(float(value), 6) + 0.0
        return value

    frame = frame[sorted(frame.columns)].map(cell).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == [
        "region_name", "n", "weighted_sba_prevalence", "unweighted_sba_prevalence"
    ]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    ours = canonical(QUERIES[name](spark, SF_TINY).toPandas())
    theirs = canonical(duck.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
    assert len(ours) > 0
