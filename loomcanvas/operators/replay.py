"""Replaying actions on a canvas. Each dialect is a fold over the action array inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.functions import vocab as V

STATE = "struct<canvas:array<int>,cursor:int,stopped:boolean,n_invalid:int,history:array<int>>"


def _insert(canvas: Column, cursor: Column, token: Column) -> Column:
    return F.concat(F.slice(canvas, 1, cursor), F.array(token), F.slice(canvas, cursor + 1, F.greatest(F.size(canvas) - cursor, F.lit(0))))


def _delete(canvas: Column, cursor: Column) -> Column:
    return F.concat(F.slice(canvas, 1, cursor - 1), F.slice(canvas, cursor + 1, F.greatest(F.size(canvas) - cursor, F.lit(0))))


def step(dialect: str, history: bool = True) -> Callable[[Column, Column], Column]:
    """State and action to state. ``strict``: illegal moves and deletes are rejected and left out of the history, nothing
    stops but the caller's stop id; ``clamp``: moves are clamped, deletes at 0 do nothing, the stop id stops;
    ``clamp_through``: the same, but the stop id does nothing; ``viewer``: every id that is no control inserts."""
    if dialect not in ("strict", "clamp", "clamp_through", "viewer"):
        raise ValueError(f"unknown dialect {dialect!r}")

    def run(s: Column, t: Column) -> Column:
        canvas, cursor, size = s["canvas"], s["cursor"], F.size(s["canvas"])
        target = cursor + V.move_amount(t)
        legal_move = (target >= 0) & (target <= size)
        inserts = V.is_insert(t) if dialect != "viewer" else ~(V.is_control(t) | t.isin(V.STOP, V.END_OF_INPUT))
        stops = (t == V.STOP) if dialect != "clamp_through" else F.lit(False)

        def out(canvas_: Column = canvas, cursor_: Column = cursor, stopped: Column | bool = False, bad: int = 0, keep: bool = True) -> Column:
            flag = F.lit(stopped) if isinstance(stopped, bool) else stopped
            return F.struct(
                canvas_.alias("canvas"), cursor_.cast("int").alias("cursor"), flag.alias("stopped"), (s["n_invalid"] + bad).alias("n_invalid"),
                (F.concat(s["history"], F.array(t)) if keep and history else s["history"]).alias("history"),
            )

        rejected = out(bad=1, keep=dialect != "strict")
        clamped = out(cursor_=F.greatest(F.lit(0), F.least(size, target)), bad=1) if dialect != "strict" else rejected
        return (
            F.when(s["stopped"], s)
            .when(stops, out(stopped=True))
            .when((t == V.DELETE) & (cursor > 0), out(_delete(canvas, cursor), cursor - 1))
            .when(t == V.DELETE, rejected)
            .when(V.is_move(t), F.when(legal_move, out(cursor_=target)).otherwise(clamped))
            .when(inserts, out(_insert(canvas, cursor, t), cursor + 1))
            .otherwise(out())
        )

    return run


def start() -> Column:
    none = F.array().cast("array<int>")
    return F.struct(none.alias("canvas"), F.lit(0).alias("cursor"), F.lit(False).alias("stopped"), F.lit(0).alias("n_invalid"), none.alias("history"))


def replay(actions: Column, dialect: str = "clamp", history: bool = True) -> Column:
    """Final state (canvas, cursor, stopped, n_invalid, history) of an action array; null for a null array.

    Each step copies the canvas, so this is for short arrays inside other expressions; ``replay_table`` is linear. The history
    (the actions that were not rejected) is empty if not asked for.
    """
    return F.when(actions.isNotNull(), F.aggregate(actions, start(), step(dialect, history)))


def trace(actions: Column, dialect: str = "clamp") -> Column:
    """The canvas with cursor after every action (opt in: the output is quadratic in the length)."""
    empty = F.array(F.struct(F.array().cast("array<int>").alias("canvas"), F.lit(0).alias("cursor")))
    first = F.struct(start().alias("s"), F.slice(empty, 1, 0).alias("rows"))

    def go(acc: Column, t: Column) -> Column:
        s = step(dialect, False)(acc["s"], t)
        row = F.struct(s["canvas"].alias("canvas"), s["cursor"].alias("cursor"))
        return F.struct(s.alias("s"), F.when(acc["s"]["stopped"], acc["rows"]).otherwise(F.concat(acc["rows"], F.array(row))).alias("rows"))

    return F.when(actions.isNotNull(), F.aggregate(actions, first, go)["rows"])


def fold(actions: list[int], dialect: str = "clamp", canvas: list[int] | None = None, cursor: int = 0) -> tuple[list[int], int, bool, int]:
    """The same fold on a list: canvas, cursor, stopped, number of illegal actions. It goes on from ``canvas`` (changed in
    place) and ``cursor``, if given."""
    canvas = [] if canvas is None else canvas
    bad = 0
    for t in actions:
        if t == V.STOP and dialect != "clamp_through":
            return canvas, cursor, True, bad
        if t == V.DELETE:
            if cursor:
                cursor -= 1
                del canvas[cursor]
            else:
                bad += 1
        elif V.MOVE_START <= t < V.MOVE_END:
            exponent, negative = divmod(t - V.MOVE_START, 2)
            to = cursor + (-(1 << exponent) if negative else 1 << exponent)
            legal = 0 <= to <= len(canvas)
            bad += not legal
            if legal or dialect != "strict":
                cursor = min(max(to, 0), len(canvas))
        elif 0 <= t < V.EOT or dialect == "viewer" and t != V.END_OF_INPUT:
            canvas.insert(cursor, t)
            cursor += 1
    return canvas, cursor, False, bad


def replay_table(df: DataFrame, keep: list[str], actions: str, dialect: str = "clamp") -> DataFrame:
    """``keep, canvas, cursor, stopped, n_invalid`` by the Arrow twin: linear memory, for sequences of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None, None, None) if a is None else fold(a, dialect) for a in batch.column(len(keep)).to_pylist()]
            types = (pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.int32())
            more = [pa.array([d[i] for d in done], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], names=[*keep, "canvas", "cursor", "stopped", "n_invalid"])

    picked = df.select(*keep, actions)
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, canvas array<int>, cursor int, stopped boolean, n_invalid int")


def states_before(actions: list[int], dialect: str = "clamp_through") -> tuple[list[int], list[int]]:
    """Cursor and canvas size before each action, without the canvas."""
    cursors, sizes = [], []
    cursor = size = 0
    for t in actions:
        cursors.append(cursor)
        sizes.append(size)
        if t == V.STOP and dialect != "clamp_through":
            break
        if t == V.DELETE:
            if cursor:
                cursor, size = cursor - 1, size - 1
        elif V.MOVE_START <= t < V.MOVE_END:
            exponent, negative = divmod(t - V.MOVE_START, 2)
            to = cursor + (-(1 << exponent) if negative else 1 << exponent)
            if 0 <= to <= size or dialect != "strict":
                cursor = min(max(to, 0), size)
        elif 0 <= t < V.EOT or dialect == "viewer" and t != V.END_OF_INPUT:
            cursor, size = cursor + 1, size + 1
    return cursors, sizes


def states_table(df: DataFrame, keep: list[str], actions: str, dialect: str = "clamp_through") -> DataFrame:
    """``keep, actions, cursors, sizes``: the states before each action by the Arrow twin, in place of a quadratic trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None) if a is None else states_before(a, dialect) for a in batch.column(len(keep)).to_pylist()]
            more = [pa.array([d[i] for d in done], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*keep, actions, "cursors", "sizes"])

    picked = df.select(*keep, actions)
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes)
    return picked.mapInArrow(run, f"{kinds}, cursors array<int>, sizes array<int>")


def cursor_path(df: DataFrame, keys: list[str], actions: str) -> DataFrame:
    """Per step: cursor and canvas length after it, by prefix sums; exact up to a sequence's first illegal action.

    ``legal`` says whether the whole sequence (up to the stop id) is legal.
    """
    t = F.col("token")
    exploded = df.select(*keys, F.posexplode(actions).alias("pos", "token"))
    per = Window.partitionBy(*keys)
    upto = per.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    move = F.coalesce(V.move_amount(t), F.lit(0))
    grow = F.when(V.is_insert(t), 1).when(t == V.DELETE, -1).otherwise(0)
    live = exploded.withColumn("_stop", F.max((t == V.STOP).cast("int")).over(per.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))).where("coalesce(_stop, 0) = 0")
    paths = live.withColumn("cursor", F.sum(grow + move).over(upto).cast("int")).withColumn("size", F.sum(grow).over(upto).cast("int"))
    ok = (F.col("cursor") >= 0) & (F.col("cursor") <= F.col("size"))
    return paths.withColumn("legal", F.min(ok).over(per)).select(*keys, "pos", "token", "cursor", "size", "legal")
