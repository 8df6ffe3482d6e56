"""Every core query with SQL gives the same rows in both engines (smallest scale)."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomcanvas.oracle import oracle_sql
from loomcanvas.queries import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float, bool, np.integer, np.floating, np.bool_)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = queries()[name](spark, FOLDER).toPandas(), duck.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["viewer_states", "restoration_trajectories", "decode_with_policy", "label_legality", "canvas_rows", "greedy_packing", "canvas_replay_long", "action_percentages"])
def test_others_run(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0
