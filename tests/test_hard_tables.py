"""Every core query on empty tables, and on tables with rows of nulls, repeated rows, empty and very long texts."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomcanvas.queries import queries

SOURCE = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for p in SOURCE.glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(f"{folder}/{p.name}")
    return str(folder)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hard")
    for p in SOURCE.glob("*.parquet"):
        df = spark.read.parquet(str(p)).limit(60)
        nulls = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name in ("text", "prompt", "response", "response_a", "response_b", "final_canvas")]
        odd = df.limit(2).select(*[(F.when(F.monotonically_increasing_id() == 0, F.lit("")).otherwise(F.repeat(F.lit("Dr. Übung no. 5 “x” é "), 4000)) if c in texts else F.col(c)).alias(c) for c in df.columns])
        df.unionByName(nulls).unionByName(df.limit(20)).unionByName(odd).coalesce(1).write.parquet(f"{folder}/{p.name}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_nothing_fails_on_empty_tables(spark, empty, name):
    queries()[name](spark, empty).count()


@pytest.mark.parametrize("name", sorted(queries()))
def test_nothing_fails_on_hard_tables(spark, hard, name):
    queries()[name](spark, hard).count()
