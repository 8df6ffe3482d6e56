"""Sinks: summaries as JSON, metric rows, rollout records, checksums of files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcanvas.sources.readers import METRICS


def write_summary(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one indented JSON file, folders made; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError("not a summary: use write_records")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False), encoding="utf-8")


def append_metrics(spark: SparkSession, rows: list[dict[str, Any]], path: str) -> None:
    """Append metric rows as CSV: unknown keys dropped, missing, NaN and infinite values blank; commits are atomic."""
    fine = [{f.name: None if isinstance(v := r.get(f.name), float) and (v != v or v in (float("inf"), float("-inf"))) else v for f in METRICS} for r in rows]
    spark.createDataFrame(fine, METRICS).write.mode("append").csv(path, header=True)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256, size`` of the files under a folder, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
