"""Restoration trajectories: obfuscate a text by random cursor edits, then invert and reverse them.

Every random choice is a hash of (seed, key, attempt, step, channel), so a row's trajectory does not depend on
partitioning or on other rows and can be recomputed in SQL. The walk is a fold over step numbers; a finished walk does
nothing more. A step's share of the fold is constant in the canvas size but for the copies of its array; ``restore_table``
walks the same steps in linear time, for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcanvas.functions import prng
from loomcanvas.functions import vocab as V
from loomcanvas.functions.arrays import bind
from loomcanvas.operators.replay import _delete, _insert

STEPS = "array<struct<action:string,value:int,cursor_pos:int>>"


@dataclass(frozen=True)
class Mix:
    """Probabilities of delete, move and insert, and those after an insert if they differ."""

    delete: float = 0.7
    move: float = 0.18
    insert: float = 0.12
    after_insert: tuple[float, float, float] | None = None

    def __post_init__(self) -> None:
        for d, m, i in filter(None, [(self.delete, self.move, self.insert), self.after_insert]):
            if abs(d + m + i - 1) > 1e-6 or min(d, m, i) < 0:
                raise ValueError("probabilities must not be negative and must add up to 1")


#: Published settings: of the class, of the data sets, of the paper (without inserts).
CLASS_MIX, DATASET_MIX, PAPER_MIX = Mix(), Mix(0.6, 0.25, 0.15), Mix(0.8, 0.2, 0.0)


def _choose(mix: Mix, previous: Column, can_delete: Column, r: Column) -> Column:
    def ladder(d: float, m: float, i: float) -> Column:
        masked = m / (m + i) if m + i > 0 else 1.0  # without a delete, moves and inserts share its part
        return F.when(can_delete, F.when(r < d, "delete").when(r < d + m, "move").otherwise("insert")).otherwise(F.when(r < masked, "move").otherwise("insert"))

    base = ladder(mix.delete, mix.move, mix.insert)
    return base if mix.after_insert is None else F.when(previous == "insert", ladder(*mix.after_insert)).otherwise(base)


def valid_moves(cursor: Column, size: Column) -> Column:
    """Signed amounts that stay on the canvas, +p before -p, small before large."""
    return F.filter(F.array(*[F.lit(s * a) for a in V.AMOUNTS for s in (1, -1)]), lambda m: (cursor + m >= 0) & (cursor + m <= size))


def obfuscate(ids: Column, key: Column, seed: int = 123, mix: Mix = CLASS_MIX, start: Column | None = None, most_steps: int = 1000, fixed_steps: int | None = None, attempt: int = 0) -> Column:
    """``struct<canvas, cursor, steps>`` after random edits until the canvas is empty (or for ``fixed_steps``).

    ``steps`` holds each edit with the cursor before it. A walk that is not done after ``most_steps`` gives null, as
    does a null array; an empty canvas is done at once.
    """
    limit = fixed_steps if fixed_steps is not None else most_steps
    first = F.struct(ids.alias("canvas"), (start if start is not None else F.lit(0)).cast("int").alias("cursor"), F.slice(F.array(F.struct(F.lit("").alias("action"), F.lit(0).alias("value"), F.lit(0).alias("cursor_pos"))), 1, 0).alias("steps"), F.lit("").alias("previous"))

    def step(s: Column, k: Column) -> Column:
        canvas, cursor, size = s["canvas"], s["cursor"], F.size(s["canvas"])

        def act(x: Column) -> Column:
            """What is done, from the draw and the legal moves (each evaluated once)."""
            chosen, moves = _choose(mix, s["previous"], cursor > 0, x["r"]), x["moves"]
            return F.when((chosen == "move") & (F.size(moves) == 0), F.lit("skip")).otherwise(chosen)

        def value(action: Column, moves: Column) -> Column:
            move = F.get(moves, (prng.draw(seed, key, attempt, k, "move") % F.size(moves)).cast("int"))
            token = (prng.draw(seed, key, attempt, k, "token") % V.EOT).cast("int")
            return F.when(action == "delete", F.get(canvas, cursor - 1)).when(action == "move", move).when(action == "insert", token)

        def apply(e: Column) -> Column:
            def result(c: Column, at: Column) -> Column:
                entry = F.struct(e["action"].alias("action"), e["value"].alias("value"), cursor.alias("cursor_pos"))
                return F.struct(c.alias("canvas"), at.cast("int").alias("cursor"), F.concat(s["steps"], F.array(entry)).alias("steps"), e["action"].alias("previous"))

            return (
                F.when(e["action"] == "skip", s).when(e["action"] == "delete", result(_delete(canvas, cursor), cursor - 1))
                .when(e["action"] == "move", result(canvas, cursor + e["value"])).otherwise(result(_insert(canvas, cursor, e["value"]), cursor + 1))
            )

        draws = F.struct(prng.uniform(seed, key, attempt, k, "action").alias("r"), valid_moves(cursor, size).alias("moves"))
        event = bind(draws, lambda x: bind(act(x), lambda a: F.struct(a.alias("action"), value(a, x["moves"]).alias("value"))))
        done = F.lit(False) if fixed_steps is not None else size == 0
        return F.when(done, s).otherwise(bind(event, apply))

    def finish(out: Column) -> Column:
        fine = F.lit(True) if fixed_steps is not None else F.size(out["canvas"]) == 0
        return F.when(ids.isNotNull() & fine, F.struct(out["canvas"].alias("canvas"), out["cursor"].alias("cursor"), out["steps"].alias("steps")))

    return bind(F.aggregate(F.sequence(F.lit(0), F.lit(limit - 1)), first, step), finish)


def restoration(steps: Column) -> Column:
    """The inverse edits in reverse order as action ids, then the stop id: it rebuilds the text the steps took apart."""
    inverse = F.transform(F.reverse(steps), lambda s: F.when(s["action"] == "insert", F.lit(V.DELETE)).when(s["action"] == "delete", s["value"]).otherwise(V.move_id(-s["value"])))
    return F.concat(inverse, F.array(F.lit(V.STOP)))


def restore_with_retry(df: DataFrame, key: str, ids: str, keep: list[str], attempts: int = 3, **options: object) -> DataFrame:
    """``keep``, ``actions`` and ``n_steps`` for every row of which one of ``attempts`` walks ends; the others are left out."""
    tries = F.coalesce(*[obfuscate(F.col(ids), F.col(key), attempt=a, **options) for a in range(attempts)])  # type: ignore[arg-type]
    # The walk stands in an exploded array, so that it is evaluated once and not again in each use of its fields.
    walked = df.select(*keep, F.explode(F.array(tries)).alias("_walk")).where("_walk IS NOT NULL")
    return walked.select(*keep, restoration(F.col("_walk.steps")).alias("actions"), F.size("_walk.steps").alias("n_steps"))


def walk(ids: list[int], key: str | None, attempt: int = 0, seed: int = 123, mix: Mix = CLASS_MIX, most_steps: int = 1000) -> list[int] | None:
    """The same walk on a list: the inverse edits as action ids, in the order of the edits; null if it does not end.

    The canvas is two stacks that meet at the cursor, so that an edit costs the same wherever it is.
    """
    left, right = [], ids[::-1]
    head = "|".join([str(seed), *([] if key is None else [key]), str(attempt)]).encode() + b"|"
    ladders = {False: (mix.delete, mix.move, mix.insert), True: mix.after_insert or (mix.delete, mix.move, mix.insert)}
    inverse: list[int] = []
    inserted = False
    for k in range(most_steps):
        if not left and not right:
            break
        r = int.from_bytes(md5(head + b"%d|action" % k).digest()[:4]) / 4294967296.0
        d, m, i = ladders[inserted]
        if left and r < d:
            inverse.append(left.pop())
            inserted = False
        elif r < ((d + m) if left else (m / (m + i) if m + i > 0 else 1.0)):
            # As in valid_moves: +p before -p while both fit, then those of the longer side.
            ahead, back = min(len(right).bit_length(), len(V.AMOUNTS)), min(len(left).bit_length(), len(V.AMOUNTS))
            at, both = int.from_bytes(md5(head + b"%d|move" % k).digest()[:4]) % (ahead + back), 2 * min(ahead, back)
            exponent, negative = divmod(at, 2) if at < both else (both // 2 + at - both, ahead < back)
            source, target = (left, right) if negative else (right, left)
            n = 1 << exponent
            target += source[: -n - 1 : -1]
            del source[-n:]
            inverse.append(V.MOVE_START + 2 * exponent + (not negative))
            inserted = False
        else:
            left.append(int.from_bytes(md5(head + b"%d|token" % k).digest()[:4]) % V.EOT)
            inverse.append(V.DELETE)
            inserted = True
    return None if left or right else inverse


def final_move(n: int, key: str | None, seed: int = 123) -> list[int]:
    """The move that may end a restoration: the amount nearest to a place drawn from 0 to ``n``; none for place 0."""
    head = "|".join([str(seed), *([] if key is None else [key]), "final"]).encode()
    place = int.from_bytes(md5(head).digest()[:4]) % (n + 1)
    return [V.MOVE_START + 2 * V.AMOUNTS.index(min(V.AMOUNTS, key=lambda a: abs(a - place)))] if place else []


def restore_table(df: DataFrame, key: str, ids: str, keep: list[str], attempts: int = 3, steps_per_token: int = 16, most_steps: int = 1000, with_final_move: bool = False, **options: object) -> DataFrame:
    """``restore_with_retry`` by the Arrow twin of the walk: linear, for texts of any length. A walk may take ``most_steps``
    or ``steps_per_token`` for each id, whichever is more. ``with_final_move`` puts the cursor elsewhere before the stop."""

    def one(a: list[int] | None, name: str | None) -> list[int] | None:
        if a is None:
            return None
        limit = max(most_steps, steps_per_token * len(a))
        inverse = next((w for t in range(attempts) if (w := walk(a, name, t, most_steps=limit, **options)) is not None), None)  # type: ignore[arg-type]
        return None if inverse is None else [*reversed(inverse), *(final_move(len(a), name) if with_final_move and a else ()), V.STOP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                done = [one(a, name) for name, a in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(done, pa.list_(pa.int32()))], names=[*keep, "actions"])

    picked = df.select(*keep, F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-2])
    return picked.mapInArrow(run, f"{kinds}, actions array<int>").where("actions IS NOT NULL").withColumn("n_steps", F.size("actions") - 1)


def nearest_amount(target: Column) -> Column:
    """The move amount nearest to ``target``, the smaller one on a tie (always positive)."""
    out = F.lit(V.AMOUNTS[0])
    for low, high in zip(V.AMOUNTS, V.AMOUNTS[1:]):
        out = F.when(target * 2 > low + high, F.lit(high)).otherwise(out)
    return out


def training_sample(prompt: Column, actions: Column) -> Column:
    """``input_ids, labels, prompt_length``: the prompt and end-of-input are ignored in the labels."""
    head = F.concat(prompt, F.array(F.lit(V.END_OF_INPUT)))
    return F.struct(
        F.concat(head, actions).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(V.IGNORE), F.size(head)), actions).alias("labels"),
        F.size(head).alias("prompt_length"),
    )


def synthetic_samples(df: DataFrame, key: str, prompt: str, response: str, keep: list[str], with_final_move: bool = False, max_canvas: int | None = None, **options: object) -> DataFrame:
    """Whole training samples from prompt and response ids: ``keep, input_ids, labels, prompt_length, n_canvas`` and, with
    ``max_canvas``, ``last_canvas``.

    The response is taken apart and restored (``restore_table``); the restoration follows the prompt and the end of input. There
    is one canvas per id of the restoration, the cursor alone first; ``last_canvas`` is the last of them.
    """
    from loomcanvas.operators.collate import last_canvas_row

    names = [*keep, prompt]
    actions = restore_table(df, key, response, names, with_final_move=with_final_move, **options)  # type: ignore[arg-type]
    if max_canvas is not None:
        actions = last_canvas_row(actions, [*names, "actions"], "actions", max_canvas)
    sample = training_sample(F.coalesce(prompt, F.array().cast("array<int>")), F.col("actions"))
    out = actions.select("*", sample.alias("_s")).select(*keep, F.col("_s.input_ids").alias("input_ids"), F.col("_s.labels").alias("labels"), F.col("_s.prompt_length").alias("prompt_length"), F.size("actions").alias("n_canvas"), *([F.col("last_row").alias("last_canvas")] if max_canvas is not None else []))
    return out
