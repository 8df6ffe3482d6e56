"""Restorations of whole texts: no query keeps a prefix or leaves out a text whose walk is long."""

from __future__ import annotations

from loomcanvas.functions import vocab as V
from loomcanvas.operators import synthesis as S
from loomcanvas.operators.replay import fold
from loomcanvas.queries import queries

SIZES = (0, 1, 24, 25, 300, 4000)


def test_twin_takes_the_same_steps(spark):
    texts = [list(range(100, 100 + n)) for n in (0, 1, 2, 5, 12, 20)] + [None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [(None, [4, 5, 6])], "key string, ids array<int>")
    for mix in (S.PAPER_MIX, S.CLASS_MIX, S.Mix(0.6, 0.25, 0.15, after_insert=(0.9, 0.1, 0.0))):
        want = S.restore_with_retry(df, "key", "ids", ["key"], mix=mix, most_steps=120).collect()
        got = S.restore_table(df, "key", "ids", ["key"], mix=mix, most_steps=120, steps_per_token=1).collect()
        assert sorted((r.key or "", r.actions, r.n_steps) for r in got) == sorted((r.key or "", r.actions, r.n_steps) for r in want)
        assert len(got) == 7


def test_walk_that_does_not_end():
    assert S.walk([1, 2, 3], "a", mix=S.PAPER_MIX, most_steps=3) is None


def test_queries_restore_every_token_of_every_text(spark, tmp_path):
    texts = {i: " ".join(f"w{j}" for j in range(n)) for i, n in enumerate(SIZES)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries()["restoration_trajectories"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(texts)
    for i, n in enumerate(SIZES):
        actions = [int(x) for x in rows[i].actions.split()]
        canvas, _, stopped, bad = fold(actions, "strict")
        assert (len(canvas), stopped, bad) == (n, True, 0) and rows[i].n_steps == len(actions) - 1
        assert sum(0 <= a < V.EOT for a in actions) == n
    assert {(r.doc_id, r.n_tokens, r.same, r.legal) for r in queries()["restoration_roundtrip"](spark, str(tmp_path)).collect()} == {(i, n, True, True) for i, n in enumerate(SIZES)}
