"""Operators beside the queries: arguments that are functions, sidecars, summaries, viewer branches, stream states, packing."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomcanvas.functions import vocab as V
from loomcanvas.operators import buckets as B
from loomcanvas.operators import collate as C
from loomcanvas.operators import decode as D
from loomcanvas.operators import metrics as M
from loomcanvas.operators import report as P
from loomcanvas.operators import synthesis as S
from loomcanvas.operators.replay import fold
from loomcanvas.plans.frames import latest
from loomcanvas.queries import queries
from loomcanvas.sources import readers
from loomcanvas.streaming import sessions


def test_rows_without_a_key_are_kept(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), (None, 1, "p"), (None, 2, "q"), (None, 2, "q")]
    got = sorted(map(tuple, latest(spark.createDataFrame(rows, "k string, at int, v string"), ["k"], ["v"], ["at"]).collect()), key=str)
    assert got == [("a", "y"), (None, "p"), (None, "q")]
    both = spark.createDataFrame([(1, None, 1, "x"), (1, None, 2, "y"), (1, 2, 1, "z"), (1, 2, 3, "w")], "k long, j long, at int, v string")
    assert sorted(r.v for r in latest(both, ["k", "j"], ["v"], ["at"]).collect()) == ["w", "x", "y"]
    assert latest(both.limit(0), ["k", "j"], ["v"], ["at"]).count() == 0


def sequential(lengths, budget):
    batch = count = 0
    out = []
    for n in sorted(lengths):
        if count and n * (count + 1) > budget:
            batch, count = batch + 1, 0
        count += 1
        out.append((n, batch))
    return sorted(out)


@pytest.mark.parametrize("budget", [1, 7, 20, 64])
def test_packing_by_counts_equals_packing_one_by_one(spark, budget):
    rnd = random.Random(budget)
    groups = {g: [rnd.choice([1, 1, 2, 3, 5, 8, 13, 40]) for _ in range(rnd.randrange(1, 120))] for g in "abc"}
    df = spark.createDataFrame([(g, i, n) for g, ns in groups.items() for i, n in enumerate(ns)], "g string, i int, n int").withColumn("first", F.lit("clash"))
    got = C.greedy_packing(df, "g", "i", "n", budget).collect()
    for g, ns in groups.items():
        assert sorted((r.n, r.batch_no) for r in got if r.g == g) == sequential(ns, budget)


def test_top_share_equals_sorting(spark):
    rows = [(i, " ".join(f"w{j % (i % 17 + 1)}" for j in range(i % 90))) for i in range(230)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = [tuple(r) for r in P.top_share(df, [], "text", "id").select("id", "score").collect()]
    score = {i: round(0.7 * len(set(t.split())) / max(1, len(t.split())) + 0.3 * min(1, len(t.split()) / 180), 6) for i, t in rows if t}
    want = sorted(score, key=lambda i: (-score[i], i))[: -(-len(score) * 10 // 100)]
    assert sorted(i for i, _ in got) == sorted(want)
    assert P.top_share(df.limit(0), [], "text", "id").count() == 0


def test_decimation_of_a_hot_group(spark):
    rows = [("hot", i, float(i)) for i in range(1000)] + [("few", i, 1.0) for i in range(3)] + [(None, 5, 2.0)]
    df = spark.createDataFrame(rows, "g string, at int, value double")
    got = B.decimate(df, "g", "at", 100).collect()
    assert sorted(r["at"] for r in got if r.g == "hot") == list(range(0, 1000, 10)) and sum(r.g == "few" for r in got) == 3 and sum(r.g is None for r in got) == 1


def test_policy_and_judge_are_arguments(spark):
    def appends_then_stops(s, k, moves):
        return F.when(k < 3, (k + 100).cast("int")).otherwise(F.lit(V.STOP))

    df = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [(r.canvas, r.actions) for r in D.decode_loop(df, "key", 9, policy=appends_then_stops).collect()] == [([100, 101, 102], [100, 101, 102, V.STOP])] * 2
    pairs = spark.createDataFrame([("m", "abc", "zz"), ("m", "a", "zz"), ("m", "", "zz"), ("m", None, None)], "m string, a string, b string")
    assert tuple(M.arena(pairs, ["m"], "a", "b").first())[:4] == ("m", 4, 2, 1)
    assert tuple(M.arena(pairs, ["m"], "a", "b", judge=lambda a, b: a < b).first())[:4] == ("m", 4, 2, 2)
    scored = M.continuation_nll(spark.createDataFrame([(1, "x y", "z z"), (2, "x", ""), (3, None, None)], "id int, p string, r string"), "id", F.filter(F.split("p", " "), lambda t: t != ""), F.filter(F.split("r", " "), lambda t: t != ""), lambda steps: steps.withColumn("nll", F.col("pos") * 1.0))
    assert {r.id: r.nll for r in scored.collect()} == {1: 2.5, 2: float("inf"), 3: float("inf")}


def test_an_inference_test_gives_the_prefix_away(spark):
    df = spark.createDataFrame([("k", list(range(10, 22))), ("few", [1, 2]), ("none", []), ("null", None)], "key string, ids array<int>")
    stop_at_once = lambda s, k, moves: F.lit(V.STOP)
    got = {r.key: r for r in D.inference_test(df, "key", "ids", 4, policy=stop_at_once).collect()}
    assert "null" not in got and got["none"].exact and got["few"].prefix_len == 0 and got["few"].canvas == []
    assert 1 <= got["k"].prefix_len <= 7 and got["k"].canvas == list(range(10, 10 + got["k"].prefix_len))


def test_synthetic_samples_replay_to_their_response(spark):
    rows = [(str(i), [5, 6], list(range(100, 100 + n))) for i, n in enumerate((0, 1, 2, 7, 40, 300))] + [("null", None, [1, 2, 3])]
    df = spark.createDataFrame(rows, "key string, p array<int>, r array<int>")
    got = {r.key: r for r in S.synthetic_samples(df, "key", "p", "r", ["key"], with_final_move=True, max_canvas=1000, mix=S.PAPER_MIX).collect()}
    moved = 0
    for key, prompt, response in rows:
        r, n = got[key], len(prompt or []) + 1
        actions = r.input_ids[n:]
        canvas, cursor, stopped, bad = fold(actions, "clamp")
        assert canvas == response and stopped and r.prompt_length == n and r.labels == [V.IGNORE] * n + actions and r.n_canvas == len(actions)
        assert [t for t in r.last_canvas if t != V.CURSOR] == response
        plain = S.walk(response, key, mix=S.PAPER_MIX)
        moved += len(actions) != len(plain) + 1
    assert moved >= 4


def test_summaries_in_one_shape(tmp_path):
    arena = {"comparisons": {"a": [{"elo": 1500, "rate": 0.6, "deep": {"elo": 1, "x": [{"elo": 2}]}}]}, "elo": 3}
    out = P.normalise_summary("arena", arena, seed=123)
    assert out["status"] == "normalized_summary" and out["n_comparisons"] == 1 and out["seed"] == 123 and "elo" not in json.dumps(out)
    assert P.normalise_summary("arena", {"comparisons": [{"elo": 1}]})["comparisons"] == [{}]
    assert P.normalise_summary("arena", {"x": 1, "elo": 2}) == {"task": "arena", "status": "passthrough_summary", "payload": {"x": 1}}
    assert P.normalise_summary("evalppl", {"ranked": [1]}) == {"task": "evalppl", "status": "normalized_summary", "ranked": [1], "by_source": {}, "eval_model": None, "scorer": None}
    assert P.normalise_summary("flops", {"a": 1})["payload"] == {"a": 1}
    text = P.latex_table([("a\\_b", "61.30%", "38.70%")], "Rates.", ("Comparison", "First", "Second"))
    assert "a\\_b & 61.30\\% & 38.70\\% \\\\" in text and text.count("\\begin") == text.count("\\end") == 2


def test_json_keys_are_dropped_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"elo":1,"a":[{"elo":2,"b":3}]}'), (2, None), (3, "no json")], "id int, t string")
    assert {r.id: r.t for r in P.drop_json_key(df, "t", "elo").collect()} == {1: '{"a":[{"b":3}]}', 2: None, 3: None}


def test_viewer_branches(spark):
    state = "struct<tokens:array<int>,token_strings:array<string>,cursor:int,action:string,action_detail:string,text:string>"
    df = spark.createDataFrame([(1, [([7], None, None, None, None, None), None], ["t"], [1, V.STOP, 2], "f"), (2, [], ["one", None], [1], "f"), (3, None, [], [5, 6, V.DELETE, V.STOP, 9], "f"), (4, None, None, None, "f"), (5, None, None, [], None)], f"id int, s array<{state}>, j array<string>, a array<int>, f string")
    got = {r.id: json.loads(r.v) for r in df.select("id", P.viewer_states(F.col("a"), F.col("f"), F.col("s"), F.col("j")).alias("v")).collect()}
    assert [(x["tokens"], x["cursor"], x["action"], x["action_detail"], x["text"]) for x in got[1]] == [([7], 0, "STEP", "Step 1", "7")]
    assert [(x["text"], x["action_detail"]) for x in got[2]] == [("one", "Step 1"), ("", "Step 2")]
    assert [(x["tokens"], x["cursor"], x["action"]) for x in got[3]] == [([], 0, "START"), ([5], 1, "INSERT"), ([5, 6], 2, "INSERT"), ([5], 1, "DELETE"), ([5], 1, "END_OF_RESPONSE")]
    assert [x["text"] for x in got[4]] == ["", "f"] and [x["text"] for x in got[5]] == ["", ""]


def test_sidecars_and_their_left_join(spark, tmp_path):
    np.save(tmp_path / "rest_tokens_shard000003.npy", np.array([1, 2, 3, 4, 5]))
    np.save(tmp_path / "rest_offsets_shard000003.npy", np.array([[0, 2], [2, 3]]))
    np.save(tmp_path / "rest_tokens_shard000004.npy", np.array([9]))
    np.save(tmp_path / "rest_offsets_shard000004.npy", np.array([[0, 1]]))
    np.save(tmp_path / "prefix_len_shard000003.npy", np.array([1]))
    np.save(tmp_path / "rest_prefix_len_shard000003.npy", np.array([8, 8]))
    np.save(tmp_path / "rest_tokens_shard000005.tmp.npy", np.array([1]))
    got = sorted(map(tuple, readers.read_trajectories(spark, "arrays", str(tmp_path), prefixes=True).select("shard_idx", "sample_idx", "tokens", "prefix_len").collect()))
    assert got == [(3, 0, [1, 2], 1), (3, 1, [3, 4, 5], None), (4, 0, [9], None)]


def test_npz_shards_and_oracle_columns(spark, tmp_path):
    np.savez(tmp_path / "a.npz", input_ids=np.array([[1, 2], [3, 4]]), labels=np.array([[1, 2], [3, 4]]))
    (tmp_path / "bad.npz").write_bytes(b"nothing")
    np.savez(tmp_path / "c.tmp.npz", input_ids=np.array([[9, 9]]), labels=np.array([[9, 9]]))
    got = readers.read_trajectories(spark, "npz", str(tmp_path), need=["input_ids", "labels"]).collect()
    assert sorted((r.sample_no, r.input_ids) for r in got) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    spark.range(3).write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(KeyError, match="oracle_action_ids"):
        readers.read_trajectories(spark, "oracle", str(tmp_path / "s.parquet"), need=["id"])
    assert readers.read_trajectories(spark, "samples", str(tmp_path / "s.parquet"), need=["id"], most=2).count() == 2


def test_buckets_are_discovered(spark, tmp_path):
    for name, files in {"len_0010_0014": ("shard_idx", "sample_idx"), "len_0021_0025": ("shard_idx", "sample_idx"), "len_0015_0019": ("shard_idx",), "other": ("shard_idx", "sample_idx")}.items():
        (tmp_path / name).mkdir()
        for f in files:
            np.save(tmp_path / name / f"{f}.npy", np.array([1]))
    assert [r.bucket for r in readers.discover_buckets(spark, str(tmp_path), 12, 20).collect()] == ["len_0010_0014"]
    with pytest.raises(FileNotFoundError):
        readers.discover_buckets(spark, str(tmp_path), 300, 400)


class State:
    def __init__(self, timed_out=False, value=None):
        self.hasTimedOut, self.value, self.waits = timed_out, value, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.waits = ms


def test_partial_batches_are_flushed_after_a_while():
    run, state = sessions.bucket_batches(2, flush_after_ms=50), State()
    frames = lambda *xs: iter([pd.DataFrame({"sample": list(xs)})])
    assert [tuple(r) for f in run(("b",), frames(1, 2, 3), state) for r in f.to_numpy().tolist()] == [("b", 0, 1), ("b", 0, 2)] and state.waits == 50
    late = State(True, state.value)
    assert [tuple(r) for f in run(("b",), iter([]), late) for r in f.to_numpy().tolist()] == [("b", 1, 3)] and late.value == ([], 2)


def test_tokens_trigger_at_each_multiple():
    run, state = sessions.token_counter(10), State()
    frames = lambda *xs: iter([pd.DataFrame({"tokens": list(xs)})])
    out = [r for part in ((4,), (3, 5), (25,), (1,)) for f in run(("r",), frames(*part), state) for r in f.to_numpy().tolist()]
    assert out == [["r", 10, 12], ["r", 20, 37], ["r", 30, 37]] and state.value == (38,)


def test_half_written_files_only_are_left_out_of_a_stream(spark, tmp_path):
    for name, n in (("step", 1), ("map", 2), ("x.tmp.1", 4)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "w" / name))
        next((tmp_path / "w" / name).glob("*.parquet")).rename((tmp_path / f"{name}.parquet"))
    out = sessions.shard_stream(spark, str(tmp_path / "*.parquet"), "id long").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_micro_batch_is_shuffled_anew(spark):
    seen = []
    sink = sessions.shuffled_sink(3, ["id"], lambda df, n: seen.append([r.id for r in df.collect()]))
    for n in range(2):
        sink(spark.range(50), n)
    assert sorted(seen[0]) == sorted(seen[1]) == list(range(50)) and seen[0] != seen[1] != list(range(50))


def test_masks_of_nothing(spark):
    r = spark.createDataFrame([(0, 3), (2, 0)], "n int, m int").select(C.causal_mask(F.col("n")).alias("c"), C.cross_mask(F.col("n"), F.col("m")).alias("x"), C.padding_mask(F.col("n"), F.col("m")).alias("p")).collect()
    assert [tuple(x) for x in r] == [([], [], [0, 0, 0]), ([[1, 0], [1, 1]], [[], []], [])]


def test_reports_with_blocks_of_all_kinds():
    text = "RUN 1\nprompt: 'a'\nresponse_text: 'it\\'s'\n\nedit_history_tokens_decoded:\n'x'\nMOVE\n\nprompt:\ntwo\nlines\nRESPONSE_TEXT:\nr1\nr2\n\nsteps: 3\nedit_history_tokens_decoded:\n[END_OF_RESPONSE]\nPROMPT:\np\nRESPONSE_TEXT:\nr\nSTEPS: 1\nACTIONS (token_id -> token_string)\n1 -> a -> b\nno row\n2 -> [MOVE_+4]\n\nprompt: 'far'\nresponse_text: 'r'\n" + "\n" * 600 + "edit_history_tokens_decoded:\n'x'\n"
    assert readers.parse_report(text) == [("a", "it's", ["'x'", "MOVE"]), ("two\nlines", "r1\nr2", ["[END_OF_RESPONSE]"]), ("p", "r", ["a -> b", "[MOVE +4]"])]
    assert readers.parse_report("") == readers.parse_report("prompt: 'x'") == []


def test_whole_tables_come_through(spark):
    assert queries()["synthetic_samples"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").count()


def test_further_edits_and_their_limits():
    from loomcanvas.operators.edits import edited

    c = [1, 2, 3, 4, 5]
    assert edited(c, 3, "REPLACE", 9) == ([1, 2, 9, 4, 5], 3) and edited(c, 0, "REPLACE", 9) is None
    assert edited(c, 3, "SPAN_DELETE", k=2) == ([1, 4, 5], 1) and edited(c, 3, "SPAN_DELETE", k=4) is None
    assert edited(c, 3, "SWAP") == ([1, 3, 2, 4, 5], 3) and edited(c, 1, "SWAP") is None
    assert edited(c, 4, "SPAN_MOVE", k=2, j=1) == ([1, 3, 4, 2, 5], 4) and edited(c, 3, "SPAN_MOVE", k=2, j=4) == ([1, 4, 2, 3, 5], 4)
    assert edited(c, 4, "SPAN_MOVE", k=2, j=3) is None and edited(c, 4, "SPAN_MOVE", k=2, j=6) is None
    assert edited(c, 3, "SPAN_COPY", k=2, j=0) == ([2, 3, 1, 2, 3, 4, 5], 2) and edited(c, 2, "SPAN_COPY", k=3, j=0) is None
    assert edited(c, 3, "NOTHING") is None and edited(c, 5, "MOVE", k=1) is None and edited([], 0, "DELETE") is None


def test_the_oracle_reaches_every_target():
    from loomcanvas.operators.edits import matched, oracle_action

    rnd = random.Random(6)
    for _ in range(200):
        canvas = [rnd.randrange(6) for _ in range(rnd.randrange(0, 14))]
        target = [rnd.randrange(6) for _ in range(rnd.randrange(0, 14))]
        cursor, steps = rnd.randrange(len(canvas) + 1), 0
        table = np.zeros((len(canvas) + 1, len(target) + 1), int)
        for i, a in enumerate(canvas, 1):
            for j, b in enumerate(target, 1):
                table[i, j] = table[i - 1, j - 1] + 1 if a == b else max(table[i - 1, j], table[i, j - 1])
        pairs = matched(canvas, target)
        assert len(pairs) == table[-1, -1] and all(canvas[i] == target[j] for i, j in pairs) and pairs == sorted(pairs)
        while (action := oracle_action(canvas, target, cursor)) != V.STOP:
            canvas, cursor, _, bad = fold([action], "strict", canvas=list(canvas), cursor=cursor)
            steps += 1
            assert not bad and steps < 400
        assert canvas == target


def test_a_random_sample_falls_back(spark):
    rows = [(i, 0, [1] * i + [V.STOP]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "shard_idx long, sample_idx long, ids array<int>")
    keys = ["shard_idx", "sample_idx"]
    assert B.random_sample([df.where("shard_idx = 8"), df], keys, "ids", 1, 9, 1).first().ids == [1] * 8
    assert B.random_sample([df.limit(0), df], keys, "ids", 4, 4, 1).first().ids == [1] * 3
    assert B.random_sample([df.limit(0), df.limit(0)], keys, "ids", 4, 4, 1).count() == 0
