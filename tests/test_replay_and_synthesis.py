from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomcanvas.functions import vocab as V
from loomcanvas.operators import collate as C
from loomcanvas.operators import metrics as M
from loomcanvas.operators import replay as R
from loomcanvas.operators import synthesis as S


def frame(spark, rows):
    return spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "id int, a array<int>")


def random_actions(n: int, seed: int) -> list[list[int]]:
    rnd = random.Random(seed)
    return [[rnd.choice([7, 8, 50259, 50259, 50261, 50262, 50263, 50264, 50256, 50290, 50258, rnd.randrange(50256), *([50260] if rnd.random() < 0.2 else [])]) for _ in range(rnd.randrange(0, 40))] for _ in range(n)]


def test_known_cases(spark):
    rows = [[10, 11, 50262, 50259, 13, 50263, 50260], [10, 11, 50262, 12, 50259, 13, 50263, 50260], [50259, 50261, 7], [], None]
    got = frame(spark, rows).select("id", R.replay(F.col("a"), "clamp").alias("c"), R.replay(F.col("a"), "strict").alias("s")).orderBy("id").collect()
    assert (got[0].c.canvas, got[0].c.cursor) == ([13, 11], 2)
    assert (got[1].c.canvas, got[1].c.cursor) == ([10, 13, 11], 3)
    assert got[2].c.canvas == [7] and got[2].s.canvas == [7] and got[2].s.history == [7] and got[2].s.n_invalid == 2
    assert got[3].c.canvas == [] and got[4].c is None


def test_fold_equals_list_fold(spark):
    rows = random_actions(200, 1)
    df = frame(spark, rows)
    for dialect in ("strict", "clamp", "clamp_through", "viewer"):
        for r in df.select("a", R.replay(F.col("a"), dialect).alias("s")).collect():
            assert (r.s.canvas, r.s.cursor, r.s.n_invalid) == (lambda x: (x[0], x[1], x[3]))(R.fold(r.a, dialect))
    twin = R.replay_table(df, ["id"], "a").collect()
    assert all((r.canvas, r.cursor) == R.fold(rows[r.id])[:2] for r in twin)


def test_cursor_path_is_exact_for_legal_sequences(spark):
    rows = random_actions(150, 2)
    path = R.cursor_path(frame(spark, rows), ["id"], "a").collect()
    ends = {}
    for r in path:
        ends[r.id] = max(ends.get(r.id, (-1, 0, 0, True)), (r.pos, r.cursor, r.size, r.legal))
    for i, (_, cursor, size, legal) in ends.items():
        canvas, at, _, bad = R.fold(rows[i])
        assert legal == (bad == 0)
        if legal:
            assert (cursor, size) == (at, len(canvas))


def test_restoration_rebuilds_the_text(spark):
    texts = [list(range(100, 100 + n)) for n in (0, 1, 2, 5, 12, 20)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, ids array<int>")
    for mix in (S.PAPER_MIX, S.CLASS_MIX, S.Mix(0.6, 0.25, 0.15, after_insert=(0.9, 0.1, 0.0))):
        out = S.restore_with_retry(df, "key", "ids", ["key", "ids"], mix=mix, most_steps=120)
        rows = out.select("ids", "n_steps", "actions", R.replay(F.col("actions"), "strict").alias("s")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.s.canvas == r.ids and r.s.n_invalid == 0 and len(r.actions) == r.n_steps + 1


def test_published_example_of_an_inverse(spark):
    steps = spark.range(1).select(F.expr("array(named_struct('action','delete','value',1,'cursor_pos',2), named_struct('action','move','value',4,'cursor_pos',1), named_struct('action','insert','value',9,'cursor_pos',5))").alias("s"))
    assert steps.select(S.restoration(F.col("s"))).first()[0] == [50259, 50266, 1, 50260]
    assert [r[0] for r in spark.createDataFrame([(0,), (3,), (6,), (700,)], "t int").select(S.nearest_amount(F.col("t"))).collect()] == [1, 2, 4, 512]


def test_labels_that_the_state_forbids(spark):
    a = [50259, 5, 50262, 50263, 50259, 50256, 50285, 50260]
    row = spark.createDataFrame([(a, [0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 1, 1, 1, 1, 1, 1])], "l array<int>, c array<int>, s array<int>").select(C.legal_labels(F.col("l"), F.col("c"), F.col("s"))).first()[0]
    assert row == [-100, 5, 50262, -100, -100, -100, -100, 50260]


def test_packing_and_batches_hold_every_row(spark):
    df = spark.createDataFrame([("g", k, n) for k, n in (("a", 3), ("b", 4), ("c", 5), ("d", 9))], "g string, k string, n int")
    got = {r.k: r.batch_no for r in C.greedy_packing(df, "g", "k", "n", 10).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2}
    rows = spark.range(1000).select(F.lit("x").alias("bucket"), F.col("id"))
    batches = C.batches(rows, "bucket", ["id"], 32).groupBy("batch_no").count().collect()
    assert sum(r["count"] for r in batches) == 1000 and max(r["count"] for r in batches) <= 32
    workers = C.round_robin(spark.range(17), ["id"], 4, slices=3).orderBy("id").collect()
    assert [r.worker for r in workers] == [i % 4 for i in range(17)]


def test_divergence_and_interval(spark):
    df = spark.createDataFrame([("a", "a a b"), ("b", "a b c")], "source string, t string")
    row = M.divergence(M.unigrams(df, "source", F.split("t", " ")), "source").collect()
    assert [(r.source, r.jsd, r.proxy) for r in row] == [("b", 0.143841, 0.866025)]
    assert M.divergence(M.unigrams(df.where("source = 'a'"), "source", F.split("t", " ")), "source").count() == 0
    _, low, high = M.win_rate(F.lit(1839), F.lit(3000))
    assert tuple(spark.range(1).select(low, high).first()) == (0.5956, 0.6304)


def test_compute_figures(spark):
    costs = spark.range(1).select(M.flops(F.lit(128).cast("long"), F.lit(768).cast("long"), F.lit(12), F.lit(3072), F.lit(V.VOCAB_SIZE), F.lit(1))).first()[0]
    assert costs == 12 * (12 * 128 * 768**2 + 2 * 128**2 * 768 + 4 * 128 * 768 * 3072) + 128 * 768 * V.VOCAB_SIZE
