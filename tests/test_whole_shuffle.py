"""The seeded shuffle places every sample."""

from __future__ import annotations

from hashlib import md5

from loomcanvas.queries import queries


def test_every_sample_has_its_position(spark, tmp_path):
    keys = [(i // 40, i % 40) for i in range(1000)]
    rows = [(*k, 1, 1) for k in keys] + [(0, 0, 2, 2)]  # the last delivered again
    spark.createDataFrame(rows, "shard_idx long, sample_idx long, written_at int, ingested_at int").write.parquet(str(tmp_path / "trajectories.parquet"))
    order = sorted(keys, key=lambda k: (int(md5(f"42|1|{k[0]}:{k[1]}".encode()).hexdigest()[:8], 16), k))
    got = queries()["seeded_shuffle"](spark, str(tmp_path)).collect()
    assert sorted((r.position, (r.shard_idx, r.sample_idx)) for r in got) == list(enumerate(order))
