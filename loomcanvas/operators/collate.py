"""From samples to batches: truncation, prefixes, shifts, legality masks, padding and packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.functions import prng
from loomcanvas.functions import vocab as V
from loomcanvas.operators.replay import replay_table, trace
from loomcanvas.plans.frames import by_size, cut


def in_length(ids: Column, least: int, most: int) -> Column:
    return F.size(ids).between(least, most)


def legal_labels(labels: Column, cursors: Column, sizes: Column) -> Column:
    """Labels with targets that the state before them forbids ignored: end-of-text, structural and reserved ids always,
    a delete at 0, a move off the canvas. A missing cursor counts as 0, a missing size as 0."""

    def one(t: Column, i: Column) -> Column:
        cursor, size = F.coalesce(F.get(cursors, i), F.lit(0)), F.coalesce(F.get(sizes, i), F.lit(0))
        amount = V.move_amount(t)
        bad = t.isin(V.EOT, V.CURSOR, V.END_OF_INPUT) | ((t >= V.RESERVED_START) & (t < V.RESERVED_END)) | ((t == V.DELETE) & (cursor == 0))
        off = V.is_move(t) & ((cursor + amount > size) | (cursor + amount < 0))
        return F.when(bad | off, F.lit(V.IGNORE)).otherwise(t)

    return F.transform(labels, one)


def collate(df: DataFrame, keep: list[str], ids: str, given_prefix: str, max_length: int, fixed: int | None = None, infer: bool = False, most: int | None = None) -> DataFrame:
    """``keep``, input_ids, labels, prefix_len: sequences cut to ``max_length``, empty ones dropped, shifted and masked."""
    part = df.withColumn("_ids", F.slice(ids, 1, max_length)).where(F.size("_ids") > 0)
    prefix = V.prefix_length(F.col("_ids"), F.col(given_prefix), fixed, infer, most)
    return part.withColumn("_p", prefix).select(*keep, V.shift_inputs(F.col("_ids")).alias("input_ids"), V.mask_labels(F.col("_ids"), F.col("_p")).alias("labels"), F.col("_p").alias("prefix_len"))


def canvas_rows(ids: Column, max_canvas: int) -> Column:
    """One canvas row per input: the cursor mark alone first, then the canvas with its cursor mark after each action but the last;
    rows keep their last ``max_canvas`` entries' head cut off. Moves are clamped, the stop id does nothing."""
    rows = F.transform(trace(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), "clamp_through"), lambda r: F.concat(F.slice(r["canvas"], 1, r["cursor"]), F.array(F.lit(V.CURSOR)), F.slice(r["canvas"], r["cursor"] + 1, F.greatest(F.size(r["canvas"]) - r["cursor"], F.lit(0)))))
    all_rows = F.concat(F.array(F.array(F.lit(V.CURSOR))), rows)
    return F.when(F.size(ids) > 0, F.transform(all_rows, lambda r: F.slice(r, F.greatest(F.size(r) - max_canvas + 1, F.lit(1)), max_canvas)))


def last_canvas_row(df: DataFrame, keep: list[str], ids: str, max_canvas: int) -> DataFrame:
    """``keep, n_rows, last_row`` of ``canvas_rows`` for sequences of any length: only the last canvas is built."""
    part = df.where(F.size(ids) > 0).select(*keep, F.size(ids).alias("n_rows"), F.slice(ids, 1, F.size(ids) - 1).alias("_done"))
    last = replay_table(part, [*keep, "n_rows"], "_done", "clamp_through")
    row = F.concat(F.slice("canvas", 1, F.col("cursor")), F.array(F.lit(V.CURSOR)), F.slice("canvas", F.col("cursor") + 1, F.size("canvas")))
    return last.withColumn("_row", row).select(*keep, "n_rows", F.slice("_row", F.greatest(F.size("_row") - max_canvas + 1, F.lit(1)), max_canvas).alias("last_row"))


def padded(df: DataFrame, keep: list[str], batch: str) -> DataFrame:
    """Inputs, labels and mask padded to the longest sequence of their batch (a window over the batch, not a join)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    return df.withColumn("_n", longest).select(
        *keep, batch, V.pad(F.col("input_ids"), F.col("_n"), V.EOT).alias("input_ids"), V.pad(F.col("labels"), F.col("_n"), V.IGNORE).alias("labels"),
        V.pad(F.transform("input_ids", lambda _: F.lit(1)), F.col("_n"), 0).alias("attention_mask"),
    )


#: A salt of a bucket holds about this many rows; LEAST_SALTS even for few.
SALT_ROWS, LEAST_SALTS = 250_000, 16


def batches(df: DataFrame, bucket: str, order_key: list[str], size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``batch_no`` and ``in_batch`` within each bucket, in seeded order; the last batch of a salt may be short.

    A bucket is split by the seeded hash into salts, as many as the number of rows asks for, so that one hot bucket is never one
    sorting task; batches never mix buckets, and every row is in exactly one batch.
    """
    salts = max(LEAST_SALTS, -(-df.select(bucket).count() // SALT_ROWS))
    h = prng.draw(seed, epoch, F.concat_ws(":", *order_key))
    salted = df.withColumn("_h", h).withColumn("_s", (F.col("_h") % salts).cast("int"))
    n = F.row_number().over(Window.partitionBy(bucket, "_s").orderBy("_h", *order_key)) - 1
    numbered = salted.withColumn("_n", n)
    return numbered.withColumn("batch_no", (F.floor(F.col("_n") / size) * salts + F.col("_s")).cast("bigint")).withColumn("in_batch", (F.col("_n") % size).cast("int")).drop("_h", "_s", "_n")


def batch_order(df: DataFrame, bucket: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``bucket, batch_no, position``: the batches of all buckets in one seeded order, so that buckets come up at random."""
    each = df.select(bucket, "batch_no").distinct()
    return positions(each.withColumn("_h", prng.draw(seed, epoch, F.concat_ws(":", bucket, "batch_no"))), ["_h", bucket, "batch_no"]).drop("_h")


def greedy_packing(df: DataFrame, group: str, order: str, length: str, budget: int) -> DataFrame:
    """``group, order, length, batch_no``: sequential packing of each group by padded cost, items by length, then ``order``.

    A batch takes the next item while longest * (count + 1) <= budget, and at least one. In this order the longest is the
    current length, so where batches begin follows from the counts of the lengths alone: the plan has a row per group and
    length, and an item's batch follows from its rank within its length. Items without a length are left out.
    """
    items = positions(df.select(group, order, F.col(length).cast("int").alias(length)).where(F.col(length).isNotNull()), [group, length, order])
    counts = items.groupBy(group, length).agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("_first"))
    kind = dict(df.dtypes)[group]

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        batch, held, out = 0, 0, []
        for name, size, n, first in rows.sort_values(length)[[group, length, "_n", "_first"]].itertuples(index=False):
            fit = budget // size if size > 0 else n + held
            most = max(1, fit)
            room = max(fit - held, 0) if held else most
            out.append((name, size, first, batch, room, most))
            if n <= room:
                held += n
            else:
                batch, held = batch + -(-(n - room) // most), (n - room - 1) % most + 1
        return pd.DataFrame(out, columns=[group, length, "_first", "_batch", "_room", "_most"])

    steps = counts.groupBy(group).applyInPandas(plan, f"`{group}` {kind}, `{length}` int, _first bigint, _batch bigint, _room bigint, _most bigint")
    rank = F.col("position") - F.col("_first")
    number = F.when(rank < F.col("_room"), F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor((rank - F.col("_room")) / F.col("_most")))
    return items.join(steps, [group, length]).select(group, order, length, number.cast("int").alias("batch_no"))


def positions(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """``position`` of each row in stable order, from counts per slice of a range sort; as many slices as the input's size asks for."""
    slices = slices or max(df.sparkSession.sparkContext.defaultParallelism, by_size(df))
    ranged = df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    part = F.shiftright("_i", 33)
    inner = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    kept = cut(ranged)
    sizes = kept.groupBy(part.alias("_p")).count()  # a row per slice
    base = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return kept.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn("position", F.col("_base") + inner).drop("_i", "_p", "_base")


def round_robin(df: DataFrame, order: list[str], workers: int, slices: int | None = None) -> DataFrame:
    """``worker``: position in stable order modulo ``workers``."""
    return positions(df, order, slices).withColumn("worker", (F.col("position") % workers).cast("int")).drop("position")


def buffered_shuffle(df: DataFrame, order: list[str], size: int, seed: int = 42) -> DataFrame:
    """``buffer_no`` and ``in_buffer``: rows in ``order`` are taken ``size`` at a time, and shuffled within each buffer."""
    placed = positions(df, order).withColumn("buffer_no", F.floor(F.col("position") / size).cast("bigint")).withColumn("_h", prng.draw(seed, F.concat_ws(":", *order)))
    n = F.row_number().over(Window.partitionBy("buffer_no").orderBy("_h", *order)) - 1  # a buffer is small by definition
    return placed.withColumn("in_buffer", n.cast("int")).drop("position", "_h")


def causal_mask(n: Column) -> Column:
    """Lower triangle of ones, n by n."""
    return cross_mask(n, n)


def cross_mask(queries: Column, sources: Column) -> Column:
    """A row per query position: one for the source positions up to it."""
    at = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at(queries), lambda i: F.transform(at(sources), lambda j: (j <= i).cast("int")))


def padding_mask(lengths: Column, most: Column) -> Column:
    """Ones for the first ``lengths`` of ``most`` positions."""
    return F.transform(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda i: (i <= lengths).cast("int"))
