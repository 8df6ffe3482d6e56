"""The session stream takes histories of any length and goes on from its state."""

from __future__ import annotations

import random

from loomcanvas.operators.replay import fold
from loomcanvas.queries import queries
from loomcanvas.streaming import sessions


def history(n: int, seed: int) -> list[int]:
    rnd = random.Random(seed)
    return [rnd.choice([7, 8, 9, 50259, 50261, 50262, 50264, rnd.randrange(50256)]) for _ in range(n)]


def test_query_replays_histories_of_any_length(spark, tmp_path):
    rows = {"empty": [], "none": None, "one": [5], "short": history(48, 1), "longer": history(49, 2), "long": history(700, 3), "stopped": [*history(60, 4), 50260, 7]}
    spark.createDataFrame([(k, a, 1) for k, a in rows.items()], "id string, action_history array<int>, ingested_at int").write.parquet(str(tmp_path / "rollouts.parquet"))
    got = {(r.session, r.step): (r.canvas, r.cursor) for r in queries()["stream_session_replay"](spark, str(tmp_path)).collect()}
    want = {}
    for k, a in rows.items():
        for i in range(len(a or [])):
            if 50260 not in a[:i]:
                canvas, cursor, _, _ = fold(a[: i + 1])
                want[k, i] = (" ".join(map(str, canvas)), cursor)
    assert got == want


def test_state_carries_over_batches(spark, tmp_path):
    a = history(90, 5)
    order = [(i, t) for i, t in enumerate(a)]
    parts = [order[40:60], order[:30], order[60:], order[25:40]]  # late and repeated steps
    for part in parts:
        spark.createDataFrame([("s", i, t) for i, t in part], "session string, step long, action int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, step long, action int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sessions.session_replay(stream).writeStream.format("memory").queryName("carried").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = sorted((r.step, r.canvas, r.cursor) for r in spark.sql("SELECT * FROM carried").collect())
    assert got == [(i, *fold(a[: i + 1])[:2]) for i in range(90)]
