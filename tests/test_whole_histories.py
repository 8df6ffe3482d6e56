"""canvas_rows and label_legality take histories of any length and give what the traced canvases give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomcanvas.functions import vocab as V
from loomcanvas.operators import collate as C
from loomcanvas.operators import replay as R
from loomcanvas.queries import queries


def history(n: int, seed: int) -> list[int]:
    rnd = random.Random(seed)
    return [rnd.choice([7, 8, 9, -1, 50256, 50258, 50259, 50260, 50261, 50262, 50264, 50270, 50285, rnd.randrange(50256), rnd.randrange(50256)]) for _ in range(n)]


ROWS = {f"h{n}": history(n, n) for n in (1, 2, 33, 64, 65, 128, 129, 600)} | {"empty": [], "none": None}


def test_states_equal_the_trace(spark):
    rows = [(str(i), history(i, 100 + i)) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id string, a array<int>")
    trace = {r.id: r.t for r in df.select("id", R.trace(F.col("a"), "clamp_through").alias("t")).collect()}
    for r in R.states_table(df, ["id"], "a").collect():
        assert r.cursors == [0, *(x.cursor for x in trace[r.id][:-1])] and r.sizes == [0, *(len(x.canvas) for x in trace[r.id][:-1])]
    for dialect in ("strict", "clamp", "clamp_through", "viewer"):
        for _, a in rows:
            for k, state in enumerate(zip(*R.states_before(a, dialect))):
                canvas, cursor, _, _ = R.fold(a[:k], dialect)
                assert state == (cursor, len(canvas))
    want = df.select("id", C.canvas_rows(F.col("a"), 32).alias("r")).collect()
    got = {r.id: (r.n_rows, r.last_row) for r in C.last_canvas_row(df, ["id"], "a", 32).collect()}
    assert got == {r.id: (len(r.r), r.r[-1]) for r in want}


def test_queries_take_every_history(spark, tmp_path):
    spark.createDataFrame([(k, a, 1) for k, a in ROWS.items()], "id string, action_history array<int>, ingested_at int").write.parquet(str(tmp_path / "rollouts.parquet"))
    last, ignored = {}, {}
    for k, a in ROWS.items():
        if a:
            canvas, cursor, _, _ = R.fold(a[:-1], "clamp_through")
            last[k] = (len(a), " ".join(map(str, [*canvas[:cursor], V.CURSOR, *canvas[cursor:]][-32:])))
            n = 0
            for i, t in enumerate(a):
                canvas, cursor, _, _ = R.fold(a[:i], "clamp_through")
                exponent, negative = divmod(t - V.MOVE_START, 2)
                to = cursor + (1 << exponent) * (-1 if negative else 1) if V.MOVE_START <= t < V.MOVE_END else cursor
                n += t in (V.EOT, V.CURSOR, V.END_OF_INPUT) or V.RESERVED_START <= t < V.RESERVED_END or t == V.DELETE and cursor == 0 or not 0 <= to <= len(canvas)
            ignored[k] = (len(a), n)
    assert {r.id: (r.n_rows, r.last_row) for r in queries()["canvas_rows"](spark, str(tmp_path)).collect()} == last
    assert {r.id: (r.n, r.ignored) for r in queries()["label_legality"](spark, str(tmp_path)).collect()} == ignored
