"""Queries of the core operators over the project's tables. Rows that were delivered again count once (the last arrival)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcanvas.functions import prng
from loomcanvas.functions import text as X
from loomcanvas.functions import vocab as V
from loomcanvas.functions.arrays import joined
from loomcanvas.operators import buckets as B
from loomcanvas.operators import collate as C
from loomcanvas.operators import decode as D
from loomcanvas.operators import edits as E
from loomcanvas.operators import metrics as M
from loomcanvas.operators import replay as R
from loomcanvas.operators import report as P
from loomcanvas.operators import synthesis as S
from loomcanvas.sources.readers import at_index, with_prefix_lengths
from loomcanvas.plans.frames import cut, latest, read, remove, shared_dir, spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def last(spark: SparkSession, d: str, table: str, keys: list[str], values: list[str]) -> DataFrame:
    """The last delivery of each key. Arrival times of a key are distinct; equal rows are equal whichever is taken."""
    return latest(read(spark, d, table), keys, values, ["ingested_at"])


def reduced(spark: SparkSession, d: str, table: str, keys: list[str], **made: Column) -> DataFrame:
    """The last delivery of each key with what is ``made`` of its row; made before the shuffle, so that long arrays do not travel."""
    rows = read(spark, d, table).select(*keys, "ingested_at", *[c.alias(n) for n, c in made.items()])
    return latest(rows, keys, list(made), ["ingested_at"])


def rollouts(spark: SparkSession, d: str, *values: str) -> DataFrame:
    return last(spark, d, "rollouts", ["id"], list(values))


def trajectories(spark: SparkSession, d: str, *values: str) -> DataFrame:
    return last(spark, d, "trajectories", ["shard_idx", "sample_idx"], list(values))


# Actions and their metrics


@query
def trajectory_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.trajectory_means(reduced(spark, d, "rollouts", ["id"], c=M.trajectory_counts(F.col("action_history"))), "c")


@query
def text_trajectory_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.text_trajectory_means(reduced(spark, d, "rollouts_text_actions", ["id"], c=M.text_trajectory_counts(F.col("action_history"))), "c")


@query
def action_distribution(spark: SparkSession, d: str) -> DataFrame:
    return reduced(spark, d, "rollouts", ["id"], a=M.action_distribution(F.col("action_history"))).where("a IS NOT NULL").select("id", "a.*")


@query
def action_percentages(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.size("action_history") > 0, M.percentages(F.col("action_history")))
    return reduced(spark, d, "rollouts", ["id"], text=text).where("text IS NOT NULL")


def _mixes(spark: SparkSession, d: str) -> DataFrame:
    return reduced(spark, d, "rollouts", ["id"], source=F.coalesce("source", F.lit("unknown")), c=M.mix_counts(F.col("action_history"))).where("c IS NOT NULL")


@query
def action_counts_json(spark: SparkSession, d: str) -> DataFrame:
    """The counts of each sequence as a JSON object."""
    counts = F.when(F.col("action_history").isNotNull(), F.to_json(M.distribution_map(F.col("action_history"))))
    return reduced(spark, d, "rollouts", ["id"], counts=counts).where("counts IS NOT NULL")


@query
def action_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every id seen and what a viewer shows of it."""
    ids = read(spark, d, "trajectories").select(F.explode("action_ids").alias("t")).distinct().where("t IS NOT NULL")
    return ids.select("t", P.action_text(F.col("t")).alias("text"))


@query
def vocabulary_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per shard: ids outside of the vocabulary, and the largest id after clamping."""
    bad, top = V.violations(F.col("action_ids")), F.array_max(V.clamp_ids(F.col("action_ids")))
    per = reduced(spark, d, "trajectories", ["shard_idx", "sample_idx"], bad=F.when(F.col("action_ids").isNotNull(), bad), top=top)
    return per.groupBy("shard_idx").agg(F.sum("bad").alias("outside"), F.max("top").alias("largest"))


@query
def action_mix_by_source(spark: SparkSession, d: str) -> DataFrame:
    return M.mix_totals(_mixes(spark, d), "source", "c")


@query
def action_mix_macro_by_source(spark: SparkSession, d: str) -> DataFrame:
    return M.mix_macro(_mixes(spark, d), "source", "c")


@query
def id_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many trajectory ids are of each kind, for each rule of what inserts."""
    t = trajectories(spark, d, "action_ids").select(F.explode("action_ids").alias("t")).groupBy("t").count()
    each = [t.select(F.lit(x).alias("rule"), V.kind(F.col("t"), x).alias("kind"), "count") for x in ("module", "tokenizer", "stats")]
    return each[0].union(each[1]).union(each[2]).groupBy("rule", "kind").agg(F.sum("count").alias("n"))


@query
def revision_stats(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "action_history").where("size(action_history) > 0")
    return M.revision_stats(df, ["id"], "action_history")


@query
def cursor_path(spark: SparkSession, d: str) -> DataFrame:
    return R.cursor_path(rollouts(spark, d, "action_history"), ["id"], "action_history")


@query
def move_decomposition(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("l_partkey") % 2501 - 1250).cast("int")
    df = read(spark, d, "lineitem").select(n.alias("n")).distinct()
    return df.select("n", joined(V.decompose(F.col("n"))).alias("moves"), joined(F.transform(V.decompose(F.col("n")), lambda x: V.move_id(x))).alias("ids"))


@query
def move_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every id seen as a move, its amount, and the id of that amount again."""
    t = trajectories(spark, d, "action_ids").select(F.explode("action_ids").alias("t")).distinct().where(V.is_move(F.col("t")))
    return t.select("t", V.move_amount(F.col("t")).alias("amount"), V.move_id(V.move_amount(F.col("t"))).alias("again"))


# Replay


def _replayed(spark: SparkSession, d: str, dialect: str) -> DataFrame:
    df = rollouts(spark, d, "action_history").where("action_history IS NOT NULL")
    out = R.replay_table(df, ["id"], "action_history", dialect)
    return out.select("id", joined(F.col("canvas")).alias("canvas"), "cursor", "stopped", "n_invalid")


@query
def canvas_replay_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, "clamp")


@query
def canvas_replay_strict(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, "strict")


@query
def canvas_replay_viewer(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, "viewer")


@query
def canvas_replay_long(spark: SparkSession, d: str) -> DataFrame:
    df = trajectories(spark, d, "action_ids").where("action_ids IS NOT NULL")
    out = R.replay_table(df, ["shard_idx", "sample_idx"], "action_ids")
    return out.select("shard_idx", "sample_idx", F.md5(joined(F.col("canvas"))).alias("canvas_md5"), F.size("canvas").alias("size"), "cursor", "stopped", "n_invalid")


@query
def viewer_states(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "action_history", "final_canvas", "response")
    return df.select("id", P.viewer_states(F.col("action_history"), F.coalesce("final_canvas", "response")).alias("states"))


@query
def viewer_prefix_targets(spark: SparkSession, d: str) -> DataFrame:
    """The state at which a viewer of each rollout starts, and how many states it has."""
    a = F.col("action_history")
    live = F.when(F.array_position(a, F.lit(V.STOP)) > 0, F.array_position(a, F.lit(V.STOP)).cast("int")).otherwise(F.size(a))
    states = F.when(F.size(a) > 0, live + 1).otherwise(F.lit(2))
    df = reduced(spark, d, "rollouts", ["id"], states=states, target=P.prefix_target(F.col("prefix_len"), states, 5))
    return df.select("id", "states", "target")


@query
def cursor_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each rollout's last canvas with the cursor marked in it."""
    df = R.replay_table(rollouts(spark, d, "action_history").where("action_history IS NOT NULL"), ["id"], "action_history")
    return df.select("id", P.cursor_text(F.transform("canvas", lambda t: t.cast("string")), F.col("cursor")).alias("line"))


@query
def replay_agreement_by_source(spark: SparkSession, d: str) -> DataFrame:
    """How many rollouts of each source give the same canvas whether illegal actions are clamped or rejected."""
    df = rollouts(spark, d, "source", "action_history").where("action_history IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("unknown")))
    strict = R.replay_table(df, ["id", "source", "action_history"], "action_history", "strict").select("id", "source", "action_history", F.col("canvas").alias("true"))
    both = R.replay_table(strict, ["source", "true"], "action_history").select("source", "true", "canvas")
    return M.exact_match(both, ["source"], "canvas", "true")


# Synthesis


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    ids = X.stand_in_ids(X.words(F.col("text")))
    return spread(read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.col("doc_id").cast("string").alias("key"), ids.alias("ids"))


@query
def restoration_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Of whole texts, whatever their length."""
    out = S.restore_table(_tokens(spark, d), "key", "ids", ["doc_id"], mix=S.PAPER_MIX)
    return out.select("doc_id", joined(F.col("actions")).alias("actions"), "n_steps")


@query
def restoration_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether replaying a row's restoration gives its tokens back; steps are one less than actions."""
    out = R.replay_table(S.restore_table(_tokens(spark, d), "key", "ids", ["doc_id", "ids"], mix=S.PAPER_MIX), ["doc_id", "ids"], "actions", "strict")
    return out.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("canvas") == F.col("ids")).alias("same"), (F.col("n_invalid") == 0).alias("legal"))


@query
def training_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first four ids are the prompt; all others, however many, are the actions."""
    df = trajectories(spark, d, "action_ids").where("action_ids IS NOT NULL")
    s = S.training_sample(F.slice("action_ids", 1, 4), F.slice("action_ids", 5, F.size("action_ids")))
    return df.select("shard_idx", "sample_idx", s.alias("s")).select("shard_idx", "sample_idx", joined(F.col("s.input_ids")).alias("input_ids"), joined(F.col("s.labels")).alias("labels"), "s.prompt_length")


@query
def extended_edits(spark: SparkSession, d: str) -> DataFrame:
    """The words of part names inserted, then eight drawn edits of the further kinds."""
    key = F.col("p_partkey").cast("string")
    ids = X.stand_in_ids(X.words(F.col("p_name")))
    number = lambda k, what, n: (prng.draw(5, key, k, what) % n).cast("int")
    inserts = F.transform(ids, lambda t: F.struct(F.lit("INSERT").alias("op"), t.alias("token"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("j")))
    names = F.array(*[F.lit(x) for x in ("REPLACE", "SPAN_DELETE", "SWAP", "SPAN_MOVE", "SPAN_COPY", "MOVE")])
    drawn = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(F.get(names, number(k, "op", 6)).alias("op"), number(k, "token", 50256).alias("token"), (number(k, "k", 4) - 1).alias("k"), number(k, "j", 8).alias("j")))
    df = read(spark, d, "part").select("p_partkey", F.concat(inserts, drawn).alias("actions"))
    out = E.edit_table(df, ["p_partkey"], "actions")
    return out.select("p_partkey", joined(F.col("canvas")).alias("canvas"), "cursor", "n_invalid")


@query
def oracle_actions(spark: SparkSession, d: str) -> DataFrame:
    """What an oracle would do half-way through each rollout to reach its last canvas."""
    a = F.col("action_history")
    df = rollouts(spark, d, "action_history").where("size(action_history) > 0").withColumn("half", F.slice(a, 1, F.greatest(F.lit(1), F.floor(F.size(a) / 2).cast("int"))))
    last = R.replay_table(df, ["id", "half"], "action_history").select("id", "half", F.col("canvas").alias("target"))
    now = R.replay_table(last, ["id", "target"], "half")
    return E.oracle_table(now, ["id"], "canvas", "target", "cursor")


@query
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    one = spark.range(1)
    lists = (("reserved", V.reserved_ids()), ("move", V.move_ids()), ("control", V.control_ids()))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), joined(c).alias("ids")) for n, c in lists])))


@query
def integers_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """How many of a document's words are whole numbers of up to nine digits, and their sum; others are left out."""
    digits = F.filter(X.words(F.col("text")), lambda w: w.rlike(r"\A[+-]?[0-9]{1,9}\z") | ~w.rlike("[0-9]"))
    found = V.int_list(digits)
    df = read(spark, d, "documents").where("text IS NOT NULL")
    return df.select("doc_id", F.size(found).alias("n"), F.aggregate(found, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query
def synthetic_samples(spark: SparkSession, d: str) -> DataFrame:
    """Training samples from documents: the first eight words are the prompt, the others are taken apart and restored."""
    df = _tokens(spark, d).select("doc_id", "key", F.slice("ids", 1, 8).alias("prompt"), F.slice("ids", 9, F.greatest(F.size("ids"), F.lit(1))).alias("response"))
    out = S.synthetic_samples(df, "key", "prompt", "response", ["doc_id"], with_final_move=True, max_canvas=32, mix=S.PAPER_MIX)
    return out.select("doc_id", F.md5(joined(F.col("input_ids"))).alias("input_md5"), F.md5(joined(F.col("labels"))).alias("labels_md5"), "prompt_length", "n_canvas", joined(F.col("last_canvas")).alias("last_canvas"))


@query
def user_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document a test would give away."""
    n = F.size(X.words(F.col("text")))
    df = read(spark, d, "documents").where("text IS NOT NULL")
    return df.select("doc_id", n.alias("n"), D.user_prefix(n, prng.draw(7, F.col("doc_id").cast("string"), "prefix")).alias("given"))


@query
def inference_test(spark: SparkSession, d: str) -> DataFrame:
    """A test run over the titles of all parts: prefix, loop, what came out."""
    ids = X.stand_in_ids(X.words(F.col("p_name")))
    df = spread(read(spark, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").cast("string").alias("key"), ids.alias("ids"))
    return D.inference_test(df, "key", "ids", 24).select("key", "prefix_len", joined(F.col("canvas")).alias("canvas"), "cursor", joined(F.col("actions")).alias("actions"), "exact")


@query
def decode_with_policy(spark: SparkSession, d: str) -> DataFrame:
    out = D.decode_loop(read(spark, d, "arena_models").select("model_name"), "model_name", 64, least_before_stop=8)
    return out.select("model_name", joined(F.col("canvas")).alias("canvas"), "cursor", joined(F.col("actions")).alias("actions"))


# Collation


@query
def prefix_lengths(spark: SparkSession, d: str) -> DataFrame:
    df = trajectories(spark, d, "action_ids", "prefix_len").where("action_ids IS NOT NULL")
    a, g = F.col("action_ids"), F.col("prefix_len")
    return df.select("shard_idx", "sample_idx", V.initial_inserts(a).alias("initial"), V.prefix_length(a, g, infer=True, most=35).alias("inferred"), V.prefix_length(a, g, fixed=16).alias("fixed"))


@query
def collate_shift_mask(spark: SparkSession, d: str) -> DataFrame:
    df = trajectories(spark, d, "action_ids", "prefix_len")
    out = C.collate(df, ["shard_idx", "sample_idx"], "action_ids", "prefix_len", 64, infer=True, most=35)
    return out.select("shard_idx", "sample_idx", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"), "prefix_len")


@query
def label_legality(spark: SparkSession, d: str) -> DataFrame:
    """Labels that the state before them allows, counted per sequence."""
    df = R.states_table(rollouts(spark, d, "action_history").where("size(action_history) > 0"), ["id"], "action_history")
    masked = C.legal_labels(F.col("action_history"), F.col("cursors"), F.col("sizes"))
    return df.select("id", F.size("action_history").alias("n"), F.size(F.filter(masked, lambda t: t == V.IGNORE)).alias("ignored"))


@query
def canvas_rows(spark: SparkSession, d: str) -> DataFrame:
    out = C.last_canvas_row(rollouts(spark, d, "action_history"), ["id"], "action_history", 32)
    return out.select("id", "n_rows", joined(F.col("last_row")).alias("last_row"))


@query
def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    df = trajectories(spark, d, "action_ids", "prefix_len", "bucket").where("bucket IS NOT NULL")
    rows = C.collate(df, ["shard_idx", "sample_idx", "bucket"], "action_ids", "prefix_len", 64, infer=True, most=35)
    numbered = C.batches(rows, "bucket", ["shard_idx", "sample_idx"], 16).withColumn("batch", F.concat_ws("/", "bucket", "batch_no"))
    out = C.padded(numbered, ["shard_idx", "sample_idx"], "batch")
    return out.select("shard_idx", "sample_idx", "batch", F.size("input_ids").alias("width"), F.size(F.filter("attention_mask", lambda m: m == 1)).alias("used"), F.md5(joined(F.col("labels"))).alias("labels_md5"))


@query
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    df = trajectories(spark, d, "bucket").where("bucket IS NOT NULL")
    return C.batches(df, "bucket", ["shard_idx", "sample_idx"], 32).select("shard_idx", "sample_idx", "bucket", "batch_no", "in_batch")


@query
def batch_order(spark: SparkSession, d: str) -> DataFrame:
    return C.batch_order(batch_ids(spark, d), "bucket")


@query
def greedy_packing(spark: SparkSession, d: str) -> DataFrame:
    df = reduced(spark, d, "trajectories", ["shard_idx", "sample_idx"], len=F.size("action_ids")).where("len > 0").select(F.lit("all").alias("slice"), F.concat_ws(":", "shard_idx", "sample_idx").alias("key"), "len")
    return C.greedy_packing(df, "slice", "key", "len", 4096)


@query
def attention_masks(spark: SparkSession, d: str) -> DataFrame:
    """The masks of small sizes, rows joined by blanks."""
    sizes = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("n"), (F.col("l_quantity") % 8).cast("int").alias("most")).distinct()
    flat = lambda m: F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), "")), " ")
    return sizes.select("n", "most", flat(C.causal_mask(F.col("n"))).alias("causal"), flat(C.cross_mask(F.col("n"), F.col("most"))).alias("crossed"), F.array_join(F.transform(C.padding_mask(F.col("n"), F.col("most")), lambda x: x.cast("string")), "").alias("padding"))


@query
def buffered_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return C.buffered_shuffle(read(spark, d, "events").select("event_id"), ["event_id"], 1000).select("event_id", "buffer_no", "in_buffer")


@query
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return trajectories(spark, d, "action_ids", "seq_len").where(C.in_length(F.col("action_ids"), 32, 128)).select("shard_idx", "sample_idx", F.size("action_ids").alias("n"), "seq_len")


@query
def round_robin_workers(spark: SparkSession, d: str) -> DataFrame:
    return C.round_robin(read(spark, d, "shard_listing").select("shard_idx").distinct(), ["shard_idx"], 4, slices=4)


# Buckets and shards


@query
def bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(F.col("action_ids")), F.lit(0))
    df = trajectories(spark, d, "action_ids")
    return df.select("shard_idx", "sample_idx", B.bucket_for(n, 10, 256, 16).alias("bucket_no"), B.bucket_name(n).alias("name"))


@query
def bucket_names(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "trajectories").select("bucket").distinct()
    return df.select("bucket", B.parse_bucket(F.col("bucket")).alias("b")).select("bucket", "b.*")


@query
def bucket_overlap(spark: SparkSession, d: str) -> DataFrame:
    return B.overlapping(read(spark, d, "bucket_index").select("bucket", "len_start", "len_end"), 64, 80).distinct()


@query
def bucket_index_join(spark: SparkSession, d: str) -> DataFrame:
    samples = trajectories(spark, d, "action_ids").select("shard_idx", "sample_idx", F.size("action_ids").alias("n"))
    return B.indexed(read(spark, d, "bucket_index"), samples)


@query
def bucket_index_missing(spark: SparkSession, d: str) -> DataFrame:
    return B.missing(read(spark, d, "bucket_index"), read(spark, d, "trajectories").select("shard_idx", "sample_idx").distinct())


@query
def seeded_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """The indexed samples of buckets that overlap [32, 128], in the seeded order of epoch 1."""
    index = B.overlapping(read(spark, d, "bucket_index"), 32, 128)
    samples = reduced(spark, d, "trajectories", ["shard_idx", "sample_idx"], n=F.size("action_ids"))
    return B.seeded_scan(B.indexed(index, samples).select("bucket", "shard_idx", "sample_idx").distinct(), "bucket", ["shard_idx", "sample_idx"], 42, 1)


@query
def sample_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Samples of even shards with the prefix lengths of a sidecar, if it has any."""
    sizes = reduced(spark, d, "trajectories", ["shard_idx", "sample_idx"], prefix_len=F.col("prefix_len")).where("prefix_len IS NOT NULL")
    samples = read(spark, d, "bucket_index").select("shard_idx", "sample_idx").distinct()
    return with_prefix_lengths(samples, sizes)


@query
def random_access(spark: SparkSession, d: str) -> DataFrame:
    """The document at position 123 of files of 50, with its place."""
    return at_index(read(spark, d, "documents").select("doc_id", F.md5("text").alias("text_md5")), "doc_id", 123, 50)


@query
def eval_batch_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = shard_counts(spark, d)
    return n.select("shard_idx", M.eval_batches(F.col("samples"), 32).alias("batches"), M.eval_batches(F.col("samples"), 32, 20).alias("at_most_20"))


@query
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """One sample of 64 to 80 ids, drawn from the index, from all samples if the index has none; without a stop at its end."""
    samples = trajectories(spark, d, "action_ids")
    index = B.overlapping(read(spark, d, "bucket_index"), 64, 80).select("shard_idx", "sample_idx").distinct()
    first = samples.join(index, ["shard_idx", "sample_idx"], "left_semi")
    out = B.random_sample([first, samples], ["shard_idx", "sample_idx"], "action_ids", 64, 80, 42)
    return out.select("shard_idx", "sample_idx", joined(F.col("action_ids")).alias("ids"))


@query
def shard_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return B.from_complete(trajectories(spark, d, "prefix_len"), read(spark, d, "shard_listing")).groupBy("shard_idx").agg(F.count(F.lit(1)).alias("samples"))


@query
def paired_shards(spark: SparkSession, d: str) -> DataFrame:
    listing = read(spark, d, "shard_listing")
    return listing.where("has_tokens").select("shard_idx").intersect(listing.where("has_offsets").select("shard_idx"))


@query
def new_shards(spark: SparkSession, d: str) -> DataFrame:
    """Listed shards that were not seen as done yet."""
    listing = read(spark, d, "shard_listing")
    return listing.select("shard_idx").distinct().exceptAll(listing.where("done").select("shard_idx").distinct())


@query
def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Samples per shard; only keys travel."""
    keys = read(spark, d, "trajectories").select("shard_idx", "sample_idx").distinct()
    return keys.groupBy("shard_idx").agg(F.count(F.lit(1)).alias("samples"))


@query
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of epoch 1 with its position in seeded order."""
    return B.seeded_positions(trajectories(spark, d, "written_at").select("shard_idx", "sample_idx"), ["shard_idx", "sample_idx"], 42, 1)


# Texts and evaluation


@query
def unigram_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "documents").where("text IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("unknown")))
    return M.unigrams(df, "source", X.words(F.col("text")))


@query
def unigram_divergence_by_source(spark: SparkSession, d: str) -> DataFrame:
    return M.divergence(cut(unigram_counts_by_source(spark, d)), "source")


@query
def perplexity_by_source(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "source", "response").withColumn("source", F.coalesce("source", F.lit("unknown"))).where("response IS NOT NULL")
    w = X.words(F.col("response"))
    counts = cut(df.select(F.explode(w).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return M.perplexity(df, "id", "source", w, counts)


@query
def continuation_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Per source the mean negative log likelihood of the answers after their prompts under bigrams of all rollouts; answers
    without words are counted apart."""
    df = rollouts(spark, d, "source", "prompt", "response").withColumn("source", F.coalesce("source", F.lit("unknown")))
    prompt, response = X.words(F.col("prompt")), X.words(F.col("response"))
    scorer = M.bigram_scorer(M.token_steps(df, "id", prompt, response))
    each = M.continuation_nll(df, "id", prompt, response, scorer).join(df.select("id", "source"), "id")
    fine = F.col("nll") < float("inf")
    return each.groupBy("source").agg(F.round(F.avg(F.when(fine, F.col("nll"))), 5).alias("mean_nll"), F.count_if(fine).alias("n"), F.count_if(~fine).alias("empty"))


@query
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "documents").where("text IS NOT NULL AND text <> ''")
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query
def arena_win_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per ordered pair of models: examples, valid ones (both answers there), the first one's win rate and interval."""
    df = last(spark, d, "run_arena", ["pair_id"], ["model_a", "model_b", "response_a", "response_b"])
    return M.arena(df, ["model_a", "model_b"], "response_a", "response_b")


@query
def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many answers of each source there are to prompts that another source answered: source pairs per prompt,
    counted from per-prompt counts, so that a popular prompt is not expanded into pairs of rows."""
    per = rollouts(spark, d, "source", "prompt").where("prompt IS NOT NULL AND source IS NOT NULL").groupBy("prompt", "source").agg(F.count(F.lit(1)).alias("n"))
    a, b = per.alias("a"), per.alias("b")
    both = a.join(b, (F.col("a.prompt") == F.col("b.prompt")) & (F.col("a.source") < F.col("b.source")))
    return both.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(F.count(F.lit(1)).alias("prompts"), F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


@query
def answer_pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """The pairs themselves: for each prompt, the answers of every two sources, one answer each."""
    out = M.response_pairs(rollouts(spark, d, "source", "prompt"), "prompt", "source", "id")
    return out.select(F.md5("prompt").alias("prompt_md5"), "source_a", "source_b", "key_a", "key_b")


@query
def paper_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the arena, perplexity and divergence tables as one."""
    arena = arena_table_rows(spark, d).select(F.lit("arena").alias("section"), "name", F.col("rate_pct").alias("first"), F.col("other_pct").alias("second"))
    ppl = P.number_rows(perplexity_by_source(spark, d), "evalppl", F.col("source"), F.col("mean_ppl"), F.lit(None).cast("double"))
    near = P.number_rows(unigram_divergence_by_source(spark, d), "mauve", F.col("source"), F.col("proxy"), F.col("jsd"))
    return P.table_rows(arena, ppl, near)


@query
def json_without_key(spark: SparkSession, d: str) -> DataFrame:
    """Small JSON documents of the models, nested, from which one key is dropped wherever it stands."""
    inner = F.struct("family", F.lit(1500).alias("elo"), "size_m")
    df = read(spark, d, "arena_models").select("model_name", F.to_json(F.struct(F.lit(1).alias("elo"), F.array(inner, inner).alias("rows"), inner.alias("one"))).alias("payload"))
    return P.drop_json_key(df, "payload", "elo")


@query
def timing_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean time of a step by source and window of 16 steps."""
    df = rollouts(spark, d, "source", "action_ms").where("action_ms IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("unknown")))
    return M.timing_means(df, ["source"], "action_ms", 16)


@query
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "created_at").where("created_at IS NOT NULL")
    return df.select("id", X.utc_stamp(F.col("created_at")).alias("stamp"), F.unix_timestamp("created_at").alias("unix"))


@query
def arena_table_rows(spark: SparkSession, d: str) -> DataFrame:
    r = arena_win_rates(spark, d)
    return P.rate_rows(r.where("n_valid > 0"), F.concat_ws(" ", "model_a", "model_b"), F.col("win_rate"), 1 - F.col("win_rate"))


@query
def top_samples_10pct(spark: SparkSession, d: str) -> DataFrame:
    return P.top_share(rollouts(spark, d, "response"), [], "response", "id")


@query
def prompt_response_pairs(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "source", "prompt", "response", "final_canvas")
    return df.select("id", F.md5(X.first_filled("prompt")).alias("prompt_md5"), F.md5(X.first_filled("response", "final_canvas")).alias("response_md5"), F.md5(X.with_system(F.col("source"), F.coalesce("prompt", F.lit("")))).alias("chat_md5"))


@query
def quote_repair(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "response").where("response IS NOT NULL")
    return df.select("id", F.md5(X.repair_quotes(F.col("response"))).alias("text_md5"), (X.repair_quotes(F.col("response")) != F.col("response")).alias("changed"))


@query
def prompt_clean(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "prompt")
    return df.select("id", F.md5(X.clean_prompt(F.concat(F.lit("Prompt: \n"), F.coalesce("prompt", F.lit(""))))).alias("prompt_md5"))


@query
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "documents").where("text IS NOT NULL")
    return df.select("doc_id", F.md5(X.cut_middle(X.one_line(F.col("text")), 80)).alias("middle_md5"), F.md5(X.cut_head(F.col("text"), 100)).alias("head_md5"), F.size(X.split_words(F.col("text"))).alias("n_words"))


@query
def stand_in_tokens(spark: SparkSession, d: str) -> DataFrame:
    df = rollouts(spark, d, "prompt").where("prompt IS NOT NULL")
    return df.select("id", joined(X.stand_in_ids(X.words(F.col("prompt")))).alias("ids"))


@query
def text_manifest(spark: SparkSession, d: str) -> DataFrame:
    return P.manifest(read(spark, d, "documents"), "doc_id", "text")


# Logits


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token_id", "x")).select("vec_id", "token_id", F.round(F.col("x").cast("double") * 8, 2).alias("logit"))


@query
def top_k_logits(spark: SparkSession, d: str) -> DataFrame:
    return D.top_k(_logits(spark, d), "vec_id", "logit", 8)


@query
def nucleus_logits(spark: SparkSession, d: str) -> DataFrame:
    return D.nucleus(_logits(spark, d), "vec_id", "token_id", "logit", 0.5).select("vec_id", "token_id", "logit")


@query
def greedy_logits(spark: SparkSession, d: str) -> DataFrame:
    return D.greedy(_logits(spark, d), "vec_id", "token_id", "logit")


@query
def legal_actions(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("cursor"), F.col("l_quantity").cast("int").alias("size")).where("cursor <= size").distinct()
    return df.select("cursor", "size", joined(D.legal_moves(F.col("cursor"), F.col("size"))).alias("moves"), D.legal(F.lit(V.DELETE), F.col("cursor"), F.col("size")).alias("can_delete"))


@query
def canvas_pooling(spark: SparkSession, d: str) -> DataFrame:
    """The four quarters of a vector pooled with its first quarter as the query; the last quarter is masked out."""
    e = read(spark, d, "embeddings")
    n = F.floor(F.size("embedding") / 4).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * n + 1, n))
    mask = F.array(F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    pooled = D.pool(parts, F.slice("embedding", 1, n), mask)
    return e.select("vec_id", F.posexplode(pooled).alias("pos", "x")).select("vec_id", "pos", (F.round("x", 5) + 0.0).alias("x"))


# Series


@query
def metric_series(spark: SparkSession, d: str) -> DataFrame:
    return P.metric_series(read(spark, d, "events"), "event_type", "event_id", "value", 500)


@query
def windowed_loss(spark: SparkSession, d: str) -> DataFrame:
    return M.windowed_mean(read(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_quantity", 200)


@query
def dev_eval(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select((F.col("l_discount") * F.col("l_quantity")).alias("loss"), F.col("l_quantity").alias("n"), (F.col("l_tax") * F.col("l_quantity")).alias("ok"))
    return M.dev_eval(df, "loss", "n", "ok")


@query
def learning_rate_curve(spark: SparkSession, d: str) -> DataFrame:
    steps = read(spark, d, "events").select((F.col("event_id") % 1200).alias("step")).distinct()
    return steps.select("step", F.round(M.learning_rate(F.col("step"), 100, 1000, 0.1), 8).alias("share"))


@query
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    return P.tokens_per_second(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "per_second")


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from loomcanvas.streaming.sessions import event_windows as windows

    return windows(read(spark, d, "events"), "ts", "event_type", "value")


@query
def compute_costs(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "arena_models")
    size = F.col("size_m").cast("bigint")
    ff = size * 4
    return m.select("model_name", M.flops(F.lit(128), size, F.lit(12), ff, F.lit(V.VOCAB_SIZE), F.lit(256)).alias("decode_macs"), M.parameters(size, F.lit(12), ff, F.lit(V.VOCAB_SIZE), F.lit(0), F.lit(True)).alias("parameters"))


# Streams


@query
def stream_session_replay(spark: SparkSession, d: str) -> DataFrame:
    """Editor sessions replayed as a stream of single actions (written as files first); its rows equal the batch replay's."""
    from loomcanvas.streaming.sessions import session_replay

    folder = f"{shared_dir(spark)}/session-{uuid.uuid4().hex}"  # each run has its own files and log
    source = rollouts(spark, d, "action_history").select(F.col("id").alias("session"), F.posexplode("action_history").alias("step", "action"))
    source.select("session", F.col("step").cast("bigint"), "action").write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema("session string, step bigint, action int").parquet(f"{folder}/in")
    out = session_replay(stream).select("session", "step", joined(F.col("canvas")).alias("canvas"), "cursor")
    return _drained(spark, out, folder)


def _drained(spark: SparkSession, out: DataFrame, folder: str) -> DataFrame:
    """All rows of a stream over the files in ``folder``, materialised; the folder is removed."""
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = cut(spark.read.schema(out.schema).parquet(f"{folder}/out"))
    remove(spark, folder)
    return rows


@query
def stream_new_shards(spark: SparkSession, d: str) -> DataFrame:
    """Samples per shard of a growing folder read as a stream; half-written files (here a second copy of all) do not count."""
    from loomcanvas.streaming.sessions import shard_stream

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = read(spark, d, "trajectories").select("shard_idx", "sample_idx").distinct()
    rows.write.parquet(f"{folder}/in")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in list(system.listStatus(path)):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, status.getPath(), system, spark._jvm.org.apache.hadoop.fs.Path(path, name.replace("part-", "part.tmp.")), False, spark._jsc.hadoopConfiguration())
    stream = shard_stream(spark, f"{folder}/in", "shard_idx bigint, sample_idx bigint")
    return _drained(spark, stream, folder).groupBy("shard_idx").agg(F.count(F.lit(1)).alias("samples"))


@query
def stream_bucket_batches(spark: SparkSession, d: str) -> DataFrame:
    """How many full batches of 16 each bucket's stream gives."""
    from loomcanvas.streaming.sessions import batch_stream

    folder = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    rows = read(spark, d, "bucket_index").where("bucket IS NOT NULL").select("bucket", "shard_idx", "sample_idx").distinct()
    rows.select("bucket", F.xxhash64("shard_idx", "sample_idx").alias("sample")).write.parquet(f"{folder}/in")
    stream = batch_stream(spark.readStream.schema("bucket string, sample bigint").parquet(f"{folder}/in"), 16)
    return _drained(spark, stream, folder).groupBy("bucket").agg(F.countDistinct("batch_no").alias("batches"), F.count(F.lit(1)).alias("samples"))


@query
def stream_token_triggers(spark: SparkSession, d: str) -> DataFrame:
    """How often each source's stream of answers passes a multiple of 5,000 actions, and the last one passed."""
    from loomcanvas.streaming.sessions import token_triggers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = reduced(spark, d, "rollouts", ["id"], run=F.coalesce("source", F.lit("unknown")), tokens=F.greatest(F.size("action_history"), F.lit(0)).cast("bigint"))
    rows.select("run", F.coalesce("tokens", F.lit(0)).alias("tokens")).write.parquet(f"{folder}/in")
    stream = token_triggers(spark.readStream.schema("run string, tokens bigint").parquet(f"{folder}/in"), 5000)
    return _drained(spark, stream, folder).groupBy("run").agg(F.count(F.lit(1)).alias("triggers"), F.max("passed").alias("last"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
