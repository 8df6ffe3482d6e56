"""training_samples and stand_in_tokens keep every id and every list."""

from __future__ import annotations

from hashlib import md5

from loomcanvas.functions import vocab as V
from loomcanvas.queries import queries


def text(ids: list[int]) -> str:
    return " ".join(map(str, ids))


def test_samples_hold_all_ids_of_all_lists(spark, tmp_path):
    lists = {n: list(range(1000, 1000 + n)) for n in (0, 1, 4, 5, 8, 9, 36, 37, 1700)} | {9999: None}
    spark.createDataFrame([(0, k, a, 1) for k, a in lists.items()], "shard_idx long, sample_idx long, action_ids array<int>, ingested_at int").write.parquet(str(tmp_path / "trajectories.parquet"))
    got = {r.sample_idx: (r.input_ids, r.labels, r.prompt_length) for r in queries()["training_samples"](spark, str(tmp_path)).collect()}
    want = {}
    for k, a in lists.items():
        if a is not None:
            n = len(a[:4]) + 1
            want[k] = (text([*a[:4], V.END_OF_INPUT, *a[4:]]), text([V.IGNORE] * n + a[4:]), n)
    assert got == want


def test_every_word_of_a_prompt_has_its_id(spark, tmp_path):
    prompts = {str(n): " ".join(f"w{i}" for i in range(n)) for n in (0, 1, 16, 17, 200)}
    spark.createDataFrame([(k, p, 1) for k, p in prompts.items()], "id string, prompt string, ingested_at int").write.parquet(str(tmp_path / "rollouts.parquet"))
    got = {r.id: r.ids for r in queries()["stand_in_tokens"](spark, str(tmp_path)).collect()}
    assert got == {k: text([int(md5(w.encode()).hexdigest()[:8], 16) % 50256 for w in p.split()]) for k, p in prompts.items()}
