from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcanvas.operators import buckets as B
from loomcanvas.operators import decode as D
from loomcanvas.operators.replay import fold
from loomcanvas.sources import readers, writers
from loomcanvas.streaming import sessions


def test_json_variants(spark, tmp_path):
    want = [("a", 1), ("b", 2)]
    rows = [{"k": k, "n": n} for k, n in want]
    texts = {"list.json": json.dumps([*rows, 5]), "both.json": "﻿" + json.dumps({"records": rows, "rows": []}), "lines.jsonl": "\n".join(json.dumps(r) for r in rows) + "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        got = readers.json_records(spark, str(tmp_path / name), "k string, n int") if name != "lines.jsonl" else readers.json_records(spark, str(tmp_path / name), "k string, n int")
        assert sorted(map(tuple, got.collect())) == want, name


def test_metric_log_round_trip(spark, tmp_path):
    writers.append_metrics(spark, [{"event": "train_loss", "step": 1, "train_loss": float("nan"), "unknown": 1}, {"event": "dev_eval", "dev_loss": 0.5}], str(tmp_path / "log"))
    got = {r.event: r for r in readers.metrics_log(spark, str(tmp_path / "log")).collect()}
    assert got["train_loss"].step == 1 and got["train_loss"].train_loss is None and got["dev_eval"].dev_loss == 0.5


def test_raw_shards(spark, tmp_path):
    np.save(tmp_path / "rest_tokens_shard000003.npy", np.array([1, 2, 3, 4, 5]))
    np.save(tmp_path / "rest_offsets_shard000003.npy", np.array([[0, 2], [2, 3]]))
    np.save(tmp_path / "rest_tokens_shard000004.npy", np.array([1]))
    got = sorted(map(tuple, readers.read_trajectories(spark, "arrays", str(tmp_path)).collect()))
    assert got == [(3, 0, [1, 2]), (3, 1, [3, 4, 5])]
    seen = {r.shard_idx: (r.has_tokens, r.has_offsets) for r in readers.listing(spark, str(tmp_path)).collect()}
    assert seen == {3: (True, True), 4: (True, False)}
    with pytest.raises(ValueError):
        readers.read_trajectories(spark, "nothing", str(tmp_path))


def test_report_blocks(spark, tmp_path):
    text = "PROMPT:\nHello\nRESPONSE_TEXT:\nHi you\nSTEPS: 2\nACTIONS (token_id -> token_string)\n60 -> ]\n50262 -> [MOVE_-1]\n\nprompt: 'Say it'\nresponse_text: 'it'\n\nedit_history_tokens_decoded:\n'it'\n[END_OF_RESPONSE]\n\nprompt: 'none'\nresponse_text: 'x'\n"
    (tmp_path / "r.txt").write_text(text)
    got = [(r.prompt, r.response, r.actions) for r in readers.reports(spark, str(tmp_path / "r.txt")).orderBy("example_no").collect()]
    assert got == [("Hello", "Hi you", ["]", "[MOVE -1]"]), ("Say it", "it", ["'it'", "[END_OF_RESPONSE]"])]


def test_buckets_and_shards(spark):
    names = spark.createDataFrame([("len_0010_0014",), ("len_3_9",), ("x",), (None,)], "b string").select(B.parse_bucket(F.col("b"))).collect()
    assert [r[0] and tuple(r[0]) for r in names] == [(10, 14), (3, 9), None, None]
    assert [r[0] for r in spark.createDataFrame([(9,), (10,), (25,), (26,), (None,)], "n int").select(B.bucket_for(F.col("n"), 10, 25, 5)).collect()] == [-1, 0, 3, -1, -1]
    shards = spark.createDataFrame([(1, True, True, True), (2, True, True, None), (3, True, False, True)], "shard_idx long, has_tokens boolean, has_offsets boolean, done boolean")
    assert [r[0] for r in B.complete_shards(shards).collect()] == [1]
    assert sorted(r[0] for r in B.complete_shards(shards.withColumn("done", F.lit(None).cast("boolean"))).collect()) == [1, 2]


def test_top_k_keeps_ties_and_nucleus_keeps_one(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate((3.0, 2.0, 2.0, 1.0))], "r int, t int, x double")
    assert sorted(r.t for r in D.top_k(df, "r", "x", 2).collect()) == [0, 1, 2]
    assert [r.t for r in D.nucleus(df, "r", "t", "x", 0.0).collect()] == [0]
    assert D.greedy(df.where("t > 0"), "r", "t", "x").first().t == 1


def test_stream_of_sessions_equals_batch(spark, tmp_path):
    actions = {"a": [5, 6, 50262, 7, 50260, 8], "b": [50259, 9]}
    rows = [(s, i, t) for s, a in actions.items() for i, t in enumerate(a)]
    spark.createDataFrame(rows[::-1], "session string, step long, action int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, step long, action int").parquet(str(tmp_path / "in"))
    run = sessions.session_replay(stream).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = {(r.session, r.step): (r.canvas, r.cursor) for r in spark.sql("SELECT * FROM replayed").collect()}
    assert got == {(s, i): fold(a[: i + 1])[:2] for s, a in actions.items() for i in range(len(a)) if 50260 not in a[:i]}
