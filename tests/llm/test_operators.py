from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcanvas.llm import mixing, packing, pairs, ranking, runs, sentences, tokenizing, truncation
from loomcanvas.llm.queries import queries
from loomcanvas.plans.frames import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def brute_runs(a):
    out, i = [], 0
    while i < len(a):
        j = i
        while j < len(a) and a[j] == a[i] and a[i] is not None or j == i:
            j += 1
        out.append((i, j - i))
        i = j
    return out


def test_runs_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = [(str(i), [rnd.choice([1, 2, None]) for _ in range(rnd.randrange(0, 12))], i) for i in range(150)] + [("n", None, 0), ("e", [], 0)]
    df = spark.createDataFrame([(k, a, [10 * j for j in range(len(a or []))], n) for k, a, n in rows], "key string, a array<int>, ms array<int>, at int")
    for least in (1, 2):
        got = {}
        for r in runs.run_table(df, ["key"], F.col("a"), F.col("ms"), "at", least).collect():
            got.setdefault(r.key, []).append((r.run_start, r.run_len))
        for k, a, _ in rows:
            assert sorted(got.get(k, [])) == [x for x in brute_runs(a or []) if x[1] >= least]


def test_run_durations_and_last_delivery(spark):
    df = spark.createDataFrame([("x", [1, 1, 2], [5, 9, 20], 1), ("x", [3, 3, 3, 4], None, 2), ("y", [7, 7, 8], [5, 9, 20], 1)], "key string, a array<int>, ms array<int>, at int")
    got = sorted(map(tuple, runs.run_table(df, ["key"], F.col("a"), F.col("ms"), "at").collect()))
    assert got == [("x", 0, 3, 3), ("x", 3, 1, 1), ("y", 0, 2, 9), ("y", 2, 1, 11)]


def test_spelling_of_text_actions(spark):
    same = [["MOVE +8", "MOVE+8", "move +8", "MOVE(+8)", "MOVE[+8]", "MOVE  + 8"], ["INSERT can’t", "INSERT(can’t)", 'INSERT "can’t"', "insert can’t", "Insert[can’t]", "INSERT (can’t"], ["DELETE", "delete ", "DELETE()"], ["STOP", "[STOP]", "[END_OF_RESPONSE]"], ["INSERT Can’t"], ["MOVE -8"], ["MOVE +"], ["other"]]
    rows = [(i, a) for i, group in enumerate(same) for a in group]
    got = {}
    for r in spark.createDataFrame(rows, "g int, a string").select("g", runs.canonical_action(F.col("a")).alias("c")).collect():
        got.setdefault(r.g, set()).add(r.c)
    assert all(len(v) == 1 for v in got.values()) and len(set.union(*got.values())) == len(same)


def test_packing_places_every_piece_once(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 5, 5, 5, 7, 12, 31, 70])) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, n int").withColumn("piece_len_", F.lit(1))
    got = packing.pack(df, ["id"], "n", [("a", 20), ("b", 64)]).collect()
    for kind, cap in (("a", 20), ("b", 64)):
        mine = [r for r in got if r.container_kind == kind]
        load, held = {}, {}
        for r in mine:
            load[r.container_no] = load.get(r.container_no, 0) + r.piece_len
            held[r.id] = held.get(r.id, 0) + r.piece_len
            assert r.piece_no == 0 or dict(rows)[r.id] > cap
        assert held == {i: n or 0 for i, n in rows} and max(load.values()) <= cap
        assert len(load) <= 1.1 * -(-sum(n or 0 for _, n in rows) // cap) + 1
    assert packing.pack(df.limit(0), ["id"], "n", [("a", 20)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, ["id"], "n", [("a", 0)])


def test_ranking_recovers_strengths(spark):
    rnd = np.random.default_rng(0)
    names, rows = [f"m{i}" for i in range(8)], []
    strength = {n: 2.0**-i for i, n in enumerate(names)}
    for k in range(3000):
        i = int(rnd.integers(0, 7))
        a, b = names[i], names[min(7, i + int(rnd.integers(1, 3)))]
        w = int(rnd.binomial(9, strength[a] / (strength[a] + strength[b])))
        rows.append((k, {f"{a} >{b}": w, f"{b} >{a}": 9 - w, "m3>m3": 50}, 1))
    rows += [(1, {"m7>m0": 900}, 0), (9000, None, 1), (9001, {"nonsense": 3, "m1>": 2}, 1)]
    df = spark.createDataFrame(rows, "k long, w map<string,long>, at int")
    items = spark.createDataFrame([(n,) for n in [*names, "never"]], "model_name string")
    totals = ranking.vote_totals(df, "k", "w", "at")
    got = {r.model_name: (r.rank_no, r.strength) for r in ranking.rank(totals, items, "model_name").collect()}
    assert sorted((n for n in names), key=lambda n: got[n][0]) == names and len(got) == 9
    far = {r.model_name: r.strength for r in ranking.stationary_by_joins(totals, items, rounds=40).collect()}
    assert abs(sum(far.values()) - 1) < 1e-6 and max(far, key=far.get) == "m0"
    empty = ranking.rank(totals.limit(0), items, "model_name").orderBy("rank_no").collect()
    assert [r.model_name for r in empty] == sorted([*names, "never"])


def test_ids_and_units_of_tables(spark):
    df = spark.createDataFrame([(1, "Hello world. Bye."), (2, ""), (3, None), (4, "Hello world. Bye.")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("unit_end", F.lit(0))
    ids = {r.doc_id: r.ids for r in tokenizing.encode_column(df, ["doc_id"], "text").collect()}
    assert ids[2] == ids[3] == [] and ids[1] == ids[4] and ids[1][:3] == [15496, 995, 13]
    back = {r.doc_id: r.text for r in tokenizing.decode_column(tokenizing.encode_column(df, ["doc_id"], "text"), ["doc_id"], "ids").collect()}
    assert back == {1: "Hello world. Bye.", 2: "", 3: "", 4: "Hello world. Bye."}
    assert sorted((r.doc_id, r.unit_end) for r in sentences.split_units(df, "doc_id", "text").collect()) == [(1, 12), (1, 17), (4, 12), (4, 17)]
    assert tokenizing.encode_column(df.limit(0), ["doc_id"], "text").count() == 0


def test_mix_keeps_quotas_and_caps(spark):
    rows = [(i, f"word{i} and some more text number {i}", "big" if i % 3 else "mid") for i in range(300)] + [(900 + i, f"tiny {i}", "small") for i in range(3)] + [(990, "tiny 0", "big"), (991, None, "big"), (992, "", "small"), (993, "no source", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 2, 0.5), ("m", "mid", 0.4, 2, 0.5), ("m", "small", 0.1, 3, 0.5), ("m", "ghost", 0.05, 1, 0.5), ("none", None, None, None, None)], "mix_name string, source string, target_share double, max_repeats int, corpus_fraction double")
    got = mixing.mix(docs, targets).collect()
    caps = {"big": 2, "mid": 2, "small": 3}
    of = {i: s for i, _, s in rows}
    assert all(r.repeats <= caps[r.source] and of[r.doc_id] == r.source for r in got) and len({(r.source, r.doc_id) for r in got}) == len(got)
    total = sum(len(tokenizing.codec(tokenizing.default_path()).encode(t)) for _, t, _ in rows)
    held = {s: sum(r.repeats * r.n_tokens for r in got if r.source == s) for s in caps}
    assert abs(held["big"] - 0.25 * total) < 25 and abs(held["mid"] - 0.2 * total) < 25 and held["small"] > 0
    report = {r.source: r for r in mixing.shares(mixing.mix(docs, targets), targets.dropna()).collect()}
    assert report["ghost"].tokens == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_histories_without_an_end(spark):
    rows = [("a", "s", [5, 50260], None, 1), ("b", "s", [5, 6], None, 1), ("c", "never", [5], 1, 1), ("d", "never", [5], 4, 1), ("e", "s", [5, 50260, 50256, 50256], None, 1), ("f", None, None, None, 1), ("g", "s", [], None, 1), ("b", "s", [5, 6, 50260], None, 0)]
    df = spark.createDataFrame(rows, "id string, source string, h array<int>, total long, at int")
    got = {r.record_key: r.is_cut for r in truncation.cut_histories(df, "id", F.col("h"), "at", False, F.col("total")).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": False, "g": False}
    texts = spark.createDataFrame([("a", "s", ["INSERT x", "[STOP]"], 1), ("b", "s", ["INSERT x"], 1)], "id string, source string, h array<string>, at int")
    assert {r.record_key: r.is_cut for r in truncation.cut_histories(texts, "id", F.col("h"), "at", True).collect()} == {"a": False, "b": True}


def test_cut_texts_and_defects(spark):
    whole = [f"The {a} {b} fills the gap near the {c}. She rewrites the middle of the {c} before the run ends." for a in ("warm", "cold", "grey", "tidy") for b in ("lantern", "harbour", "surveyor") for c in ("market", "mirror", "window", "orchard")]
    answers = [(f"w{i}", "s", "Why did the ledger stop?", t) for i, t in enumerate(whole)]
    answers += [("c1", "s", "Why?", whole[0][:-31]), ("c2", "s", "Why?", "The warm lantern fills the gap near the mark"), ("c3", "s", "Why?", "The cold harbour fills the"), ("ok", "s", "Why?", "She rewrites the middle of the mirror before the run ends"), ("em", None, "Why?", None), ("re", "s", "Why?", "I’m sorry, but I can’t help with that request."), ("co", "s", "Why did it stop today?", "WHY DID IT STOP TODAY?")]
    df = spark.createDataFrame(answers, "k string, source string, prompt string, answer string")
    got = {r.k: r.defect_type for r in pairs.defects(df, df.select(F.col("answer").alias("text")), ["k"], {}).collect()}
    assert got == {"c1": "truncated", "c2": "truncated", "c3": "truncated", "em": "empty", "re": "refusal", "co": "copy"}


def test_shortened_versions_across_ranges(spark):
    texts = sorted({f"{a} common beginning of a text that is long enough {b}" for a in "abcdefgh" for b in range(20)})
    rows = [(t, "open") for t in texts] + [(t + " and goes on", "ended") for t in texts[::3]] + [("short", "open"), ("short of it", "ended")]
    found = spark.createDataFrame(rows, "core string, kind string")
    got = {r.core for r in pairs.shortened(found).collect()}
    want = {t for t in texts if any(u != t and u.startswith(t) and len(t) >= pairs.LEAST_SHARED for u, _ in rows)}
    assert got == want


def test_every_query_runs(spark):
    for name, f in queries().items():
        if name.endswith("_found") or name in ("p2_rates", "p7_ids", "p8_shares", "p3_fill"):
            assert f(spark, "/root/testdata/sf0.001").count() > 0, name


def test_empty_tables(spark, tmp_path):
    for path in ("documents", "rollouts", "rollouts_text_actions", "run_arena", "trajectories", "arena_models", "pack_limits", "mix_targets"):
        spark.read.parquet(f"/root/testdata/sf0.001/{path}.parquet").limit(0).write.parquet(f"{tmp_path}/{path}.parquet")
    for name in ("p1_found", "p2_found", "p3_packing", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_mix", "p9_found"):
        assert queries()[name](spark, str(tmp_path)).count() == 0, name
