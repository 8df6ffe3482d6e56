"""The queries p1_... to p9_...: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcanvas.llm import encoding, mixing, packing, pairs, ranking, runs, sentences, tokenizing, truncation
from loomcanvas.llm.answers import LATIN, OWN_MARKS, Languages
from loomcanvas.plans.frames import cut, latest, read

Query = Callable[[SparkSession, str], DataFrame]


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each rollout: id, source, prompt, response."""
    values = ["source", "prompt", "response"]
    return latest(read(spark, d, "rollouts"), ["id"], values, ["ingested_at", F.xxhash64(*values)])


def _arena(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The last delivery of each pair: pair_id, prompt and ``more``."""
    values = ["prompt", *more]
    return latest(read(spark, d, "run_arena"), ["pair_id"], values, ["ingested_at", F.xxhash64(*values)])


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled records with the original text (null where part of it is lost for good) and the chain that was undone."""
    models, _ = encoding.fitted(read(spark, d, "documents"))
    rows = (
        _rollouts(spark, d).select(F.lit("rollouts").alias("table_name"), F.col("id").alias("record_key"), F.lit("response").alias("field_name"), F.col("response").alias("text"))
        .unionByName(_arena(spark, d).select(F.lit("run_arena").alias("table_name"), F.col("pair_id").cast("string").alias("record_key"), F.lit("prompt").alias("field_name"), F.col("prompt").alias("text")))
    )
    return encoding.restore(rows, ["table_name", "record_key", "field_name"], "text", models).where("affected").drop("affected")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_restored(spark, d).select("table_name", "record_key", "field_name")


def _judged(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame]]:
    """(table, field, record_key, source, has_list or has_text, is_cut) of everything that problem 2 looks at."""
    documents = read(spark, d, "documents")
    models, _ = encoding.fitted(documents)
    answers = _rollouts(spark, d).withColumn("source", F.coalesce("source", F.lit("unknown")))
    found = cut(truncation.endings(answers, ["id", "source"], "response", "prompt", models=models))
    opened = truncation.judge(found, documents, "source")
    whole = found.where("kind <> 'open'").withColumn("is_cut", F.lit(False))
    texts = opened.unionByName(whole).select(F.col("id").alias("record_key"), "source", (~F.col("kind").isin("empty", "refusal")).alias("counts"), "is_cut")
    counted = F.try_element_at("action_counts", F.lit("total"))
    ids = truncation.cut_histories(read(spark, d, "rollouts"), "id", F.col("action_history"), "ingested_at", False, counted)
    acts = truncation.cut_histories(read(spark, d, "rollouts_text_actions"), "id", F.col("action_history"), "ingested_at", True)
    return [
        ("rollouts", "response", texts),
        ("rollouts", "action_history", ids.withColumnRenamed("has_list", "counts")),
        ("rollouts_text_actions", "action_history", acts.withColumnRenamed("has_list", "counts")),
    ]


def _named(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    out = None
    for table, field, df in parts:
        one = df.select(F.lit(table).alias("table_name"), "record_key", F.lit(field).alias("field_name"), "source", "counts", "is_cut")
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(_judged(spark, d)).where("is_cut").select("table_name", "record_key", "field_name")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut records per table, field and source, among those that could be cut (no empty answers, no refusals, no empty lists)."""
    per = _named(_judged(spark, d)).where("counts").groupBy("table_name", "field_name", "source")
    return per.agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("is_cut").cast("bigint")).alias("cut"), F.round(F.avg(F.col("is_cut").cast("int")), 6).alias("share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    models, counts = encoding.fitted(documents, LATIN, OWN_MARKS)
    words = Languages.of_counts(counts) if counts is not None else {}
    keys = ["table_name", "record_key", "field_name"]
    arena = _arena(spark, d, "response_a", "response_b", "model_a", "model_b")
    sides = F.inline(F.array(*[F.struct(F.lit(f"response_{x}").alias("field_name"), F.concat(F.lit("arena "), F.coalesce(f"model_{x}", F.lit("unknown"))).alias("source"), F.col(f"response_{x}").alias("answer")) for x in "ab"]))
    answers = (
        _rollouts(spark, d).select(F.lit("rollouts").alias("table_name"), F.col("id").alias("record_key"), F.lit("response").alias("field_name"), F.coalesce("source", F.lit("unknown")).alias("source"), F.col("response").alias("answer"), "prompt")
        .unionByName(arena.select(F.lit("run_arena").alias("table_name"), F.col("pair_id").cast("string").alias("record_key"), "prompt", sides))
    )
    return pairs.defects(answers, documents, keys, words, models).select(*keys, "defect_type")


def _limits(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of container once (the smallest capacity counts); rows without a kind or a positive capacity ask for nothing."""
    rows = read(spark, d, "pack_limits").where("container_kind IS NOT NULL AND capacity > 0")
    return rows.groupBy("container_kind").agg(F.min("capacity").alias("capacity"))


def p3_packing(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every pack_limits kind for the last delivery of each trajectory (container_kind, container_no, ...)."""
    named = _limits(spark, d).orderBy("container_kind", "capacity")
    limits = [(r[0], r[1]) for r in named.limit(packing.MOST_KINDS + 1).collect()]
    sized = read(spark, d, "trajectories").select("shard_idx", "sample_idx", "ingested_at", F.coalesce(F.size(F.col("action_ids")), F.lit(0)).alias("n"))
    items = latest(sized, ["shard_idx", "sample_idx"], ["n"], ["ingested_at", "n"])
    return packing.pack(items, ["shard_idx", "sample_idx"], "n", limits)


def p3_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: containers, ids placed and the share of their room that is filled."""
    caps = _limits(spark, d)
    per = p3_packing(spark, d).where("piece_len > 0").groupBy("container_kind").agg(F.countDistinct("container_no").alias("containers"), F.sum("piece_len").cast("bigint").alias("ids"))
    return per.join(caps, "container_kind").select("container_kind", "containers", "ids", F.round(F.col("ids") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All arena models with strength (to nine places) and place."""
    return _ranked(spark, d).withColumn("strength", F.round("strength", 9))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    totals = ranking.vote_totals(read(spark, d, "run_arena"), "pair_id", "pairwise_wins", "ingested_at")
    return ranking.rank(totals, read(spark, d, "arena_models"), "model_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("model_name", "rank_no")


def _run_parts(spark: SparkSession, d: str, least: int) -> list[tuple[str, DataFrame]]:
    no_times = F.lit(None).cast("array<int>")
    key = F.concat_ws(":", "shard_idx", "sample_idx")
    ids = read(spark, d, "rollouts").withColumn("record_key", F.col("id"))
    texts = read(spark, d, "rollouts_text_actions").withColumn("record_key", F.col("id"))
    whole = read(spark, d, "trajectories").withColumn("record_key", key)
    return [
        ("rollouts", runs.run_table(ids, ["record_key"], F.col("action_history"), F.col("action_ms"), "ingested_at", least)),
        ("rollouts_text_actions", runs.run_table(texts, ["record_key"], F.transform("action_history", runs.canonical_action), F.col("action_ms"), "ingested_at", least)),
        ("trajectories", runs.run_table(whole, ["record_key"], F.col("action_ids"), no_times, "ingested_at", least)),
    ]


def _stack(parts: list[tuple[str, DataFrame]], field: dict[str, str]) -> DataFrame:
    out = None
    for name, part in parts:
        one = part.withColumn("table_name", F.lit(name)).withColumn("field_name", F.lit(field[name]))
        out = one if out is None else out.unionByName(one)
    return out


RUN_FIELDS = {"rollouts": "action_history", "rollouts_text_actions": "action_history", "trajectories": "action_ids"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _stack(_run_parts(spark, d, 2), RUN_FIELDS).select("table_name", "record_key", "run_start", "run_len")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with each run as one event: start, count and duration (ms, or steps where there are no times)."""
    return _stack(_run_parts(spark, d, 1), RUN_FIELDS).select("table_name", "record_key", "field_name", "run_start", "run_len", "duration")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode_column(read(spark, d, "documents"), ["doc_id"], "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids; null texts come back empty."""
    return tokenizing.decode_column(p7_ids(spark, d), ["doc_id"], "ids")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents").select("doc_id", "text", "source"), read(spark, d, "mix_targets"), rebalance=True)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_units(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "unit_end")


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of every document in order, with their text."""
    return sentences.split_units(read(spark, d, "documents"), "doc_id", "text", with_text=True)


def queries() -> dict[str, Query]:
    return {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from loomcanvas.llm import sql

    return sql.oracle_sql()
