"""Length buckets and shards: names, overlap, index join, complete shards, seeded scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcanvas.functions import prng
from loomcanvas.functions import vocab as V
from loomcanvas.operators.collate import positions
from loomcanvas.plans.frames import small

#: Complete shards up to this number are joined by broadcast.
MOST_SHARDS = 500_000
BUCKET_NAME = r"^len_(\d+)_(\d+)$"


def parse_bucket(name: Column) -> Column:
    """``struct<len_start, len_end>`` of ``len_A_B``; null for any other name."""
    low, high = F.regexp_extract(name, BUCKET_NAME, 1).try_cast("int"), F.regexp_extract(name, BUCKET_NAME, 2).try_cast("int")
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("len_start"), high.alias("len_end")))


def overlapping(df: DataFrame, least: int, most: int, start: str = "len_start", end: str = "len_end") -> DataFrame:
    """Buckets that overlap [least, most]: two comparisons, pushed down to the scan."""
    return df.where((F.col(end) >= least) & (F.col(start) <= most))


def bucket_for(length: Column, least: int, most: int, size: int) -> Column:
    """Bucket number of a length, -1 outside of [least, most]."""
    return F.when(length.between(least, most), F.floor((length - least) / max(1, size)).cast("int")).otherwise(F.lit(-1))


def bucket_name(length: Column, size: int = 5) -> Column:
    low = (F.floor(length / size) * size).cast("int")
    return F.format_string("len_%04d_%04d", low, low + size - 1)


def indexed(index: DataFrame, samples: DataFrame) -> DataFrame:
    """The index rows that name an existing sample, with it; repeated index rows count once. Both sides share the key,
    so the join is one co-partitioned shuffle (or a broadcast if runtime statistics allow it)."""
    keys = ["shard_idx", "sample_idx"]
    return index.select("bucket", "len_start", "len_end", *keys).distinct().join(samples.drop("bucket", "len_start", "len_end"), keys)


def missing(index: DataFrame, samples: DataFrame) -> DataFrame:
    """Index rows without a sample."""
    keys = ["shard_idx", "sample_idx"]
    return index.select("bucket", *keys).distinct().join(samples.select(*keys), keys, "left_anti")


def complete_shards(listing: DataFrame) -> DataFrame:
    """Shards with tokens and offsets, and with a done mark, if there is any mark at all. Null marks are no marks."""
    marks = listing.agg(F.max(F.coalesce("done", F.lit(False))).alias("any_done"))
    usable = listing.where("has_tokens AND has_offsets").join(F.broadcast(marks), how="inner")  # one row
    return usable.where("NOT any_done OR done").select("shard_idx").distinct()


def from_complete(samples: DataFrame, listing: DataFrame) -> DataFrame:
    """Samples of complete shards. One shard may hold much of all rows, so the listing travels, not the samples, if it is small."""
    return samples.join(small(complete_shards(listing), MOST_SHARDS), "shard_idx", "left_semi")


def seeded(df: DataFrame, keys: list[str], seed: int, epoch: int = 0) -> DataFrame:
    """``df`` in seeded order: a range sort by hash, not a single task."""
    return df.orderBy(prng.draw(seed, epoch, F.concat_ws(":", *keys)), *keys)


def random_sample(pools: list[DataFrame], keys: list[str], ids: str, least: int, most: int, seed: int, n: int = 1) -> DataFrame:
    """``n`` samples of a length in [least, most], drawn by hash from the first pool, from the next ones only if those before have too
    few; without a stop id at their end."""
    out = None
    for rank, pool in enumerate(pools):
        one = pool.where(F.size(ids).between(least, most)).select(*keys, ids, F.lit(rank).alias("_rank"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(*keys).agg(F.min_by(ids, "_rank").alias(ids), F.min("_rank").alias("_rank"))
    drawn = best.orderBy("_rank", prng.draw(seed, F.concat_ws(":", *keys)), *keys).limit(n)
    bare = F.when(F.element_at(ids, -1) == V.STOP, F.slice(ids, 1, F.size(ids) - 1)).otherwise(F.col(ids))
    return drawn.select(*keys, bare.alias(ids))


def seeded_positions(df: DataFrame, keys: list[str], seed: int, epoch: int = 0, slices: int | None = None) -> DataFrame:
    """Every row with its ``position`` in seeded order, from 0."""
    return positions(df.withColumn("_h", prng.draw(seed, epoch, F.concat_ws(":", *keys))), ["_h", *keys], slices).drop("_h")


def seeded_scan(df: DataFrame, bucket: str, keys: list[str], seed: int, epoch: int = 0) -> DataFrame:
    """Every row of an indexed scan with its ``position``: buckets in seeded order, within each its rows in seeded order; another
    epoch gives another order."""
    drawn = df.withColumn("_b", prng.draw(seed, epoch, F.col(bucket))).withColumn("_h", prng.draw(seed, epoch, F.concat_ws(":", bucket, *keys)))
    return positions(drawn, ["_b", bucket, "_h", *keys]).drop("_b", "_h")


def decimate(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each group in order, from the first one. A group may hold most of all rows: places come
    from the counts of a range sort's slices."""
    placed = positions(df, [group, order])
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("_first"))
    joined = placed.join(sizes, placed[group].eqNullSafe(sizes[group])).drop(sizes[group])
    return joined.where((F.col("position") - F.col("_first")) % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n", "_first", "position")
