"""Streams: new shards, editor sessions step by step, length-homogeneous batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from loomcanvas.functions import prng
from loomcanvas.operators.replay import fold


def shard_stream(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int = 64) -> DataFrame:
    """Parquet shards as they appear: each file is read once (the source's log), half-written ``*.tmp.*`` files never.

    Rows of a file whose name has ``.tmp.`` in it are left out by name; a writer renames it when it is whole, and the new name
    is a new file to the source.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.where(~F.contains(F.col("_metadata.file_name"), F.lit(".tmp.")))


SESSION_OUT = "session string, step bigint, canvas array<int>, cursor int"
SESSION_STATE = "canvas array<int>, cursor int, next bigint, waiting_steps array<bigint>, waiting_actions array<int>, stopped boolean"


def _advance(drop_after_ms: int | None):  # noqa: ANN202
    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # steps that never came: what waited for them is dropped
            return
        canvas, cursor, following, late, acts, stopped = state.get if state.exists else ([], 0, 0, [], [], False)
        waiting = dict(zip(late, acts))
        for batch in batches:
            waiting.update((int(s), int(a)) for s, a in zip(batch["step"], batch["action"]) if int(s) >= following)
        canvas, rows = list(canvas), []
        while following in waiting and not stopped:
            _, cursor, stopped, _ = fold([waiting.pop(following)], canvas=canvas, cursor=cursor)
            rows.append((key[0], following, list(canvas), cursor))
            following += 1
        state.update((canvas, cursor, following, list(waiting), list(waiting.values()), stopped))
        if drop_after_ms and waiting:
            state.setTimeoutDuration(drop_after_ms)
        yield pd.DataFrame(rows, columns=["session", "step", "canvas", "cursor"])

    return run


def session_replay(stream: DataFrame, drop_after_ms: int | None = None) -> DataFrame:
    """Canvas and cursor after each action of each session (columns session, step, action).

    Steps that come out of order wait for those before them, for ever or ``drop_after_ms`` (an own rule: then they are
    dropped; a query with such a timeout never ends by itself); repeated steps count once; nothing follows a stop.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if drop_after_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("session").applyInPandasWithState(_advance(drop_after_ms), SESSION_OUT, SESSION_STATE, "append", timeout)


def bucket_batches(size: int, flush_after_ms: int | None = None):  # noqa: ANN201
    """A state function: rows of a bucket (bucket, sample) are kept until ``size`` of them make a batch, or until no row came
    for ``flush_after_ms``: then what is kept is a batch of its own."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, number = state.get if state.exists else ([], 0)
        kept, rows = list(kept), []
        if state.hasTimedOut:
            state.update(([], number + bool(kept)))
            yield pd.DataFrame([(key[0], number, x) for x in kept], columns=["bucket", "batch_no", "sample"])
            return
        for frame in frames:
            kept += [int(x) for x in frame["sample"]]
        while len(kept) >= size:
            rows += [(key[0], number, x) for x in kept[:size]]
            kept, number = kept[size:], number + 1
        state.update((kept, number))
        if flush_after_ms and kept:
            state.setTimeoutDuration(flush_after_ms)
        yield pd.DataFrame(rows, columns=["bucket", "batch_no", "sample"])

    return run


def batch_stream(stream: DataFrame, size: int, flush_after_ms: int | None = None) -> DataFrame:
    """Full batches of ``size`` samples per bucket (columns bucket, sample); the rest waits for more, for ever or for
    ``flush_after_ms`` (a query with such a timeout never ends by itself)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("bucket").applyInPandasWithState(bucket_batches(size, flush_after_ms), "bucket string, batch_no bigint, sample bigint", "kept array<bigint>, number bigint", "append", timeout)


def token_counter(every: int):  # noqa: ANN201
    """A state function: adds up ``tokens`` of a run and reports each multiple of ``every`` that the sum passes, once."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0,)
        before = total // every
        total += sum(int(frame["tokens"].sum()) for frame in frames)
        state.update((total,))
        yield pd.DataFrame([(key[0], n * every, total) for n in range(before + 1, total // every + 1)], columns=["run", "passed", "tokens"])

    return run


def token_triggers(stream: DataFrame, every: int) -> DataFrame:
    """A row for each multiple of ``every`` tokens that a run passes (columns run, tokens): what starts evaluations and checkpoints.
    Triggers by time are the sink's (``trigger(processingTime=...)``)."""
    return stream.groupBy("run").applyInPandasWithState(token_counter(every), "run string, passed bigint, tokens bigint", "total bigint", "append", GroupStateTimeout.NoTimeout)


def shuffled_sink(seed: int, keys: list[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch goes to ``write`` in an order drawn anew (the buffer of a streaming shuffle)."""
    return lambda batch, number: write(batch.orderBy(prng.draw(seed, number, F.concat_ws(":", *keys)), *keys), number)


def event_windows(stream: DataFrame, at: str, by: str, value: str, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per tumbling event-time window with a watermark (an extension)."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")
