"""Edit actions beyond insert, delete and move, and an oracle that says what to do next to reach a target.

Published descriptions give what each action does, when it may be done and where the cursor stands after it; illegal actions are
rejected here and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomcanvas.functions import vocab as V

#: Actions as structs: what is done, with which token, over how many tokens, to which boundary.
ACTIONS = "array<struct<op:string,token:int,k:int,j:int>>"


def edited(canvas: list[int], cursor: int, op: str, token: int | None = None, k: int | None = None, j: int | None = None) -> tuple[list[int], int] | None:
    """Canvas and cursor after one action, null if it may not be done. Spans end at the cursor.

    ``INSERT`` token, ``DELETE``, ``MOVE`` by k, ``REPLACE`` the token before the cursor, ``SPAN_DELETE`` k tokens, ``SWAP`` the two
    tokens before the cursor, ``SPAN_MOVE`` k tokens to boundary j of the canvas as it is (1 to cursor - k, or cursor and beyond),
    ``SPAN_COPY`` k tokens to boundary j.
    """
    n = len(canvas)
    if op == "INSERT" and token is not None:
        return [*canvas[:cursor], token, *canvas[cursor:]], cursor + 1
    if op == "DELETE" and cursor > 0:
        return canvas[: cursor - 1] + canvas[cursor:], cursor - 1
    if op == "MOVE" and k is not None and 0 <= cursor + k <= n:
        return canvas, cursor + k
    if op == "REPLACE" and token is not None and cursor > 0:
        return [*canvas[: cursor - 1], token, *canvas[cursor:]], cursor
    if op == "SWAP" and cursor > 1:
        return [*canvas[: cursor - 2], canvas[cursor - 1], canvas[cursor - 2], *canvas[cursor:]], cursor
    if k is None or not 1 <= k <= cursor:
        return None
    span, before, after = canvas[cursor - k : cursor], canvas[: cursor - k], canvas[cursor:]
    if op == "SPAN_DELETE":
        return before + after, cursor - k
    if op == "SPAN_COPY" and j is not None and 0 <= j <= n:
        return canvas[:j] + span + canvas[j:], j + k
    if op == "SPAN_MOVE" and j is not None:
        if 1 <= j <= cursor - k:
            return before[:j] + span + before[j:] + after, cursor
        if cursor <= j <= n:
            return before + canvas[cursor:j] + span + canvas[j:], j
    return None


def edit_table(df: DataFrame, keep: list[str], actions: str) -> DataFrame:
    """``keep, canvas, cursor, n_invalid`` of action arrays (as in ACTIONS) from an empty canvas; null arrays give nulls."""

    def one(steps: list[dict]) -> tuple[list[int], int, int]:
        canvas: list[int] = []
        cursor = bad = 0
        for s in steps:
            done = edited(canvas, cursor, s["op"], s["token"], s["k"], s["j"]) if s else None
            bad += done is None
            canvas, cursor = done or (canvas, cursor)
        return canvas, cursor, bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None, None) if a is None else one(a) for a in batch.column(len(keep)).to_pylist()]
            more = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.list_(pa.int32()), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], names=[*keep, "canvas", "cursor", "n_invalid"])

    picked = df.select(*keep, actions)
    kinds = "".join(f"`{n}` {t}, " for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}canvas array<int>, cursor int, n_invalid int")


def matched(canvas: list[int], target: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in order. Bits of one integer hold a row of the table."""
    places: dict[int, int] = {}
    for i, t in enumerate(canvas):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(canvas)) - 1
    rows = [full]
    for t in target:
        row, here = rows[-1], places.get(t, 0)
        rows.append(((row + (row & here)) | (row & ~here)) & full)
    out, i, j = [], len(canvas), len(target)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def repairs(canvas: list[int], target: list[int]) -> list[tuple[int, int]]:
    """(boundary, action id) of the edits that make the canvas the target, each for the canvas as it is: a delete at the boundary
    after the token, an insert at the boundary where the token belongs."""
    out, i, j = [], 0, 0
    for a, b in [*matched(canvas, target), (len(canvas), len(target))]:
        out += [(x + 1, V.DELETE) for x in range(i, a)] + [(a, target[y]) for y in range(j, b)]
        i, j = a + 1, b + 1
    return out


def oracle_action(canvas: list[int], target: list[int], cursor: int) -> int:
    """What the oracle does next: the stop id if the canvas is the target; at a mismatch its first repair; elsewhere the largest move
    towards the nearest one (the earlier on a tie) that does not pass it."""
    left = repairs(canvas, target)
    if not left:
        return V.STOP
    place, action = min(left, key=lambda x: (abs(x[0] - cursor), x[0]))
    if place == cursor:
        return action
    far = abs(place - cursor)
    exponent = min(far.bit_length() - 1, len(V.AMOUNTS) - 1)
    return V.MOVE_START + 2 * exponent + (place < cursor)


def oracle_table(df: DataFrame, keep: list[str], canvas: str, target: str, cursor: str) -> DataFrame:
    """``keep, action, n_repairs``: the oracle's action in each state and how many edits are left. Null arrays give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = zip(*(batch.column(len(keep) + i).to_pylist() for i in range(3)))
            done = [(None, None) if c is None or t is None or at is None else (oracle_action(c, t, at), len(repairs(c, t))) for c, t, at in states]
            more = [pa.array([d[i] for d in done], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], names=[*keep, "action", "n_repairs"])

    picked = df.select(*keep, canvas, target, cursor)
    kinds = "".join(f"`{n}` {t}, " for n, t in picked.dtypes[:-3])
    return picked.mapInArrow(run, f"{kinds}action int, n_repairs int")
