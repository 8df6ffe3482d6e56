"""Reading tables, spreading work and cutting lineage in a way that suits both one machine and a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[tuple[str, str]] = set()
#: Bytes of input for which a shuffle gets one more partition.
PARTITION_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that it need not be installed on them."""
    context = spark.sparkContext
    if (context.applicationId, "") not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="loomcanvas-")
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "loomcanvas-package"), "zip", package.parent, package.name))
        _shipped.add((context.applicationId, ""))


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver's to the workers once per application; its name, for ``SparkFiles.get`` there."""
    context = spark.sparkContext
    if (context.applicationId, path) not in _shipped:
        context.addFile(path)
        _shipped.add((context.applicationId, path))
    return os.path.basename(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table ``table`` under ``folder`` as a lazy Parquet scan (columns and filters are pushed down by Catalyst)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give a CPU-heavy step at least one partition per core.

    A scan of many files already has them and is left alone; only a scan with fewer partitions than cores (one small
    file, one row group) is redistributed round robin. What comes from a shuffle is left alone too: to ask for its
    partitions would run the shuffle.
    """
    if _shuffles(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _shuffles(plan) -> bool:  # noqa: ANN001
    """Whether a node of the logical plan needs a shuffle."""
    children = plan.children()
    if plan.nodeName() in ("Aggregate", "Join", "Window", "Repartition", "RepartitionByExpression", "Sort", "Distinct", "Deduplicate", "Intersect", "Except"):
        return True
    return any(_shuffles(children.apply(i)) for i in range(children.size()))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else (local mode only) a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="loomcanvas-checkpoint-")
        atexit.register(shutil.rmtree, made, True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, computed once, marked for broadcast if it has at most ``max_rows`` rows, else for a shuffled join."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_size(df: DataFrame) -> int:
    """A partition for every PARTITION_BYTES that the plan's sources hold, as far as that is known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(1, -(-sum(n for n in sizes if n < 1 << 60) // PARTITION_BYTES))  # a source without statistics answers with a huge number


def partitions_for(df: DataFrame) -> int:
    """Partitions of a shuffle of ``df``: what the session wants, one per core, or what its size asks for, whichever is most."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, by_size(df))


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the values of the row that is last in ``order`` (nulls first); one shuffle.

    Few keys occur twice, so rows are partitioned by key without a combine first. A row whose key is null in part names
    no record, so it replaces none: such rows all stay, but for equal ones. Ties must be settled by ``order``.
    """
    by, loose = list(keys), [F.col(k).isNull() for k in keys if df.schema[k].nullable]
    if loose:
        plain = [v for v in values if not dict(df.dtypes)[v].startswith("map")]
        df, by = df.withColumn("_unnamed", F.when(F.greatest(*loose) if len(loose) > 1 else loose[0], F.xxhash64(*plain))), [*keys, "_unnamed"]
    df = df.repartition(partitions_for(df), *by)
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_best")
    return df.groupBy(*by).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def tokenizer_dir() -> str:
    """Where the public tokenizers' files lie: ``LOOMCANVAS_TOKENIZERS`` or the box's default."""
    return os.environ.get("LOOMCANVAS_TOKENIZERS", "/opt/tokenizers")
