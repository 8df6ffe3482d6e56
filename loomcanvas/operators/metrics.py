"""Evaluation metrics: action mixes, trajectory statistics, divergences, win rates, perplexities, compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcanvas.functions import vocab as V
from loomcanvas.functions.arrays import bind
from loomcanvas.operators.replay import cursor_path

KINDS = ("insert", "move", "delete", "end_of_response", "other")


def _count(ids: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(ids, lambda t: test(t))).cast("bigint")


def _of_kind(ids: Column, kind: str) -> Column:
    return _count(ids, lambda t: V.kind(t) == kind)


def _starting(actions: Column, prefix: str) -> Column:
    return _count(actions, lambda t: F.startswith(t, F.lit(prefix)))


def action_distribution(ids: Column) -> Column:
    """Counts of a sequence by kind, and the total of all. Null gives null; no shuffle."""
    parts = [_of_kind(ids, k).alias(k) for k in KINDS]
    return F.when(ids.isNotNull(), F.struct(*parts, F.size(ids).cast("bigint").alias("total")))


def distribution_map(ids: Column) -> Column:
    d = action_distribution(ids)
    names = [*KINDS, "total"]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[d[n] for n in names]))


def percentages(ids: Column) -> Column:
    """``insert=66.7% move=...`` of a sequence; an empty one has zeros."""
    d = action_distribution(ids)
    of = F.greatest(d["total"], F.lit(1))
    return F.format_string(" ".join(f"{k}=%.1f%%" for k in KINDS), *[d[k] * 100.0 / of for k in KINDS])


def mix_counts(ids: Column) -> Column:
    """``struct<n, insert, move, delete>`` of a sequence without stop and end-of-input ids; unknown ids stay in ``n``. Null gives null."""
    live = F.filter(ids, lambda t: ~t.isin(V.STOP, V.END_OF_INPUT))
    return F.when(ids.isNotNull(), F.struct(F.size(live).cast("bigint").alias("n"), *[_of_kind(live, k).alias(k) for k in KINDS[:3]]))


def mix_totals(df: DataFrame, by: str, counts: str) -> DataFrame:
    """Insert, move and delete counts and shares per group, from a column of ``mix_counts``."""
    sums = df.groupBy(by).agg(F.sum(f"{counts}.n").alias("n_actions"), *[F.sum(f"{counts}.{k}").alias(f"n_{k}") for k in KINDS[:3]])
    return sums.select("*", *[F.round(F.col(f"n_{k}") / F.nullif(F.col("n_actions"), F.lit(0)), 6).alias(f"{k}_share") for k in KINDS[:3]])


def mix_macro(df: DataFrame, by: str, counts: str) -> DataFrame:
    """Mean of the sequences' own percentages (sequences without actions left out), from a column of ``mix_counts``."""
    n = F.col(f"{counts}.n")
    each = df.where(n > 0).select(by, *[(F.col(f"{counts}.{k}") * 100.0 / n).alias(k) for k in KINDS[:3]])
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("n_examples"), *[F.round(F.avg(k), 6).alias(f"{k}_pct") for k in KINDS[:3]])


def trajectory_counts(a: Column) -> Column:
    """``struct<n, i, m, d, dist>``: actions, inserts, moves, deletes and the sum of absolute moves of a sequence. Null gives null."""
    dist = F.aggregate(F.filter(a, V.is_move), F.lit(0).cast("bigint"), lambda s, t: s + F.abs(V.move_amount(t)))
    parts = {"n": F.size(a).cast("bigint"), "i": _count(a, lambda t: V.is_insert(t, "stats")), "m": _count(a, V.is_move), "d": _count(a, lambda t: t == V.DELETE), "dist": dist}
    return F.when(a.isNotNull(), F.struct(*[c.alias(k) for k, c in parts.items()]))


def trajectory_means(df: DataFrame, counts: str) -> DataFrame:
    """One row over all sequences (null ones left out): examples, mean actions, kind shares, mean absolute move."""
    g = df.where(F.col(counts).isNotNull()).agg(F.count(F.lit(1)).alias("n_examples"), *[F.coalesce(F.sum(f"{counts}.{c}"), F.lit(0)).alias(c) for c in "n i m d dist".split()])
    of = F.greatest(F.col("n"), F.lit(1))
    return g.select(
        "n_examples", F.round(F.col("n") / F.greatest(F.col("n_examples"), F.lit(1)), 4).alias("mean_total_actions"), F.round(F.col("i") / of, 6).alias("insert_fraction"),
        F.round(F.col("m") / of, 6).alias("move_fraction"), F.round(F.col("d") / of, 6).alias("delete_fraction"), F.round(F.col("dist") / F.greatest(F.col("m"), F.lit(1)), 4).alias("mean_abs_move_distance"),
    )


def text_trajectory_counts(a: Column) -> Column:
    """``struct<n, insert, move, delete>`` of text actions: kinds by prefix, every string counts. Null gives null."""
    return F.when(a.isNotNull(), F.struct(F.size(a).cast("bigint").alias("n"), *[_starting(a, p).alias(p.lower()) for p in ("INSERT", "MOVE", "DELETE")]))


def text_trajectory_means(df: DataFrame, counts: str) -> DataFrame:
    """The same for text actions; text moves have no distance."""
    g = df.where(F.col(counts).isNotNull()).agg(F.count(F.lit(1)).alias("n_examples"), *[F.coalesce(F.sum(f"{counts}.{c}"), F.lit(0)).alias(c) for c in ("n", "insert", "move", "delete")])
    of = F.greatest(F.col("n"), F.lit(1))
    return g.select("n_examples", F.round(F.col("n") / F.greatest(F.col("n_examples"), F.lit(1)), 4).alias("mean_total_actions"), *[F.round(F.col(k) / of, 6).alias(f"{k}_fraction") for k in ("insert", "move", "delete")])


def revision_stats(df: DataFrame, keys: list[str], actions: str) -> DataFrame:
    """Over legal sequences: actions per output token, move-distance masses, backward share, insert position, end appends."""
    t, before = F.col("token"), F.col("cursor")
    path = cursor_path(df, keys, actions).where("legal")
    insert, move = V.is_insert(t), V.is_move(t)
    amount = V.move_amount(t)
    size_before, at = F.col("size") - 1, before - 1
    per = path.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("size", "pos").alias("out"), F.count_if(move).alias("moves"), F.count_if(amount < 0).alias("back"), F.count_if(insert).alias("inserts"),
        F.count_if(insert & (at == size_before)).alias("appends"), F.sum(F.when(insert & (size_before > 0), at / size_before)).alias("place"), F.count_if(insert & (size_before > 0)).alias("placed"),
        *[F.count_if(F.abs(amount) == d).alias(f"d{d}") for d in (1, 2, 4, 8)],
    )
    s = lambda c: F.sum(c)
    share = lambda a, b: F.round(s(a) / F.nullif(s(b), F.lit(0)), 6)
    return per.agg(
        F.count(F.lit(1)).alias("n_examples"), share("n", "out").alias("actions_per_token"), *[share(f"d{d}", "moves").alias(f"moves_of_{d}") for d in (1, 2, 4, 8)], share("back", "moves").alias("backward_fraction"),
        share("place", "placed").alias("mean_insert_position"), share("appends", "inserts").alias("end_append_fraction"), F.round(F.avg((F.col("back") > 0).cast("int")), 6).alias("with_backward_move"),
    )


def unigrams(df: DataFrame, by: str, tokens: Column) -> DataFrame:
    """``by, token, n``; map-side combined."""
    return df.select(by, F.explode(tokens).alias("token")).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n"))


def divergence(counts: DataFrame, by: str) -> DataFrame:
    """Jensen-Shannon divergence of each group's unigrams to the alphabetically first group's, and ``exp(-divergence)``.

    The reference group's counts are joined by token (full outer: a token of either side counts). One group alone gives
    no rows (``insufficient_sources``).
    """
    first = counts.agg(F.min(by)).first()[0]
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    n_ref = totals.where(F.col(by) == first).select("total").first()
    if n_ref is None:
        return counts.sparkSession.createDataFrame([], f"{by} string, jsd double, proxy double")
    ref = counts.where(F.col(by) == first).select("token", (F.col("n") / n_ref[0]).alias("p"))
    mine = counts.join(totals, by).select(by, "token", (F.col("n") / F.col("total")).alias("q"))
    joined = mine.join(ref, "token", "left").fillna(0.0, ["p"])
    # Tokens of the reference that a group lacks add p/2 * ln 2 each, that is (1 - their matched mass) / 2 * ln 2.
    half = (F.col("p") + F.col("q")) / 2
    eps = 1e-12
    term = lambda x: F.when(x > 0, 0.5 * x * F.log((x + eps) / (half + eps))).otherwise(0.0)
    got = joined.groupBy(by).agg(F.sum(term(F.col("p")) + term(F.col("q"))).alias("s"), F.sum("p").alias("matched"))
    jsd = F.col("s") + 0.5 * (1 - F.col("matched")) * F.log(F.lit(2.0))
    return got.where(F.col(by) != first).select(by, F.round(jsd, 6).alias("jsd"), F.round(F.exp(-jsd), 6).alias("proxy"))


def perplexity(df: DataFrame, key: str, by: str, tokens: Column, counts: DataFrame) -> DataFrame:
    """Mean ``exp`` of the unigram negative log likelihood per group, ranked ascending; texts without tokens left out.

    ``counts``: token, n of the corpus. Rows are told by ``key``. ``continuation_nll`` takes any scorer.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    nll = counts.select("token", (-F.log(F.col("n") / total)).alias("nll"))
    rows = df.select(key, by, F.explode(tokens).alias("token"))
    each = rows.groupBy(key, by, "token").count().join(nll, "token").groupBy(key, by).agg((F.sum(F.col("nll") * F.col("count")) / F.sum("count")).alias("nll"))
    return each.groupBy(by).agg(F.round(F.avg(F.exp("nll")), 4).alias("mean_ppl"), F.count(F.lit(1)).alias("n")).orderBy("mean_ppl", by)


#: Gives ``steps`` (key, pos, before, token, scored) a column ``nll``; steps before the response are there as context.
Scorer = Callable[[DataFrame], DataFrame]


def token_steps(df: DataFrame, key: str, prompt: Column, response: Column) -> DataFrame:
    """``key, pos, before, token, scored``: the tokens of prompt and response in order, each with the one before it (null for the
    first); ``scored`` are those of the response."""
    none = F.array().cast("array<string>")
    p, r = F.coalesce(prompt, none), F.coalesce(response, none)
    both = F.struct(F.concat(p, r).alias("all"), F.size(p).alias("n"))  # evaluated once, not for each token
    step = bind(both, lambda x: F.transform(x["all"], lambda t, i: F.struct(i.alias("pos"), F.when(i > 0, F.get(x["all"], i - 1)).alias("before"), t.alias("token"), (i >= x["n"]).alias("scored"))))
    return df.select(key, F.inline(step))


def bigram_scorer(steps: DataFrame) -> Scorer:
    """A scorer fitted on ``steps``: bigrams smoothed by one over the vocabulary; the first token counts as after nothing."""
    pairs = steps.groupBy("before", "token").agg(F.count(F.lit(1)).alias("n"))
    firsts = pairs.groupBy("before").agg(F.sum("n").alias("of"))
    size = steps.select("token").distinct().count()

    def score(rows: DataFrame) -> DataFrame:
        # Frequent pairs are counted before they are joined, so that a hot word is one row here.
        told = pairs.alias("p").join(firsts.alias("f"), F.col("p.before").eqNullSafe(F.col("f.before"))).select(F.col("p.before").alias("_b"), F.col("p.token").alias("_t"), (-F.log((F.col("n") + 1) / (F.col("of") + size))).alias("nll"))
        return rows.join(told, F.col("before").eqNullSafe(F.col("_b")) & (F.col("token") == F.col("_t")), "left").drop("_b", "_t")

    return score


def continuation_nll(df: DataFrame, key: str, prompt: Column, response: Column, scorer: Scorer) -> DataFrame:
    """``key, nll``: mean negative log likelihood of the response's tokens after the prompt; no such token gives infinity."""
    scored = scorer(token_steps(df, key, prompt, response)).where("scored").groupBy(key).agg(F.avg("nll").alias("nll"))
    return df.select(key).join(scored, key, "left").select(key, F.coalesce("nll", F.lit(float("inf"))).alias("nll"))


#: From the two answers' columns, whether the first one wins.
Judge = Callable[[Column, Column], Column]


def longer(first: Column, second: Column) -> Column:
    """The default judge: the longer answer wins, the second one on a tie."""
    return F.length(first) > F.length(second)


def arena(df: DataFrame, by: list[str], first: str, second: str, judge: Judge = longer) -> DataFrame:
    """``by, n_examples, n_valid, wins, win_rate, low, high`` of the first answers; valid are examples with both answers."""
    valid = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(second, F.lit("")) != "")
    won = F.coalesce(judge(F.col(first), F.col(second)), F.lit(False))
    g = df.select(*by, valid.alias("_v"), (valid & won).alias("_w")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"), F.count_if("_v").alias("n_valid"), F.count_if("_w").alias("wins"))
    rate, low, high = win_rate(F.col("wins"), F.col("n_valid"))
    return g.select(*by, "n_examples", "n_valid", "wins", rate.alias("win_rate"), low.alias("low"), high.alias("high"))


def response_pairs(df: DataFrame, prompt: str, source: str, key: str) -> DataFrame:
    """``prompt, source_a, source_b, key_a, key_b``: for each prompt the answers of two sources, a before b by name.

    A source answers a prompt once here (its smallest key stands for it), so a prompt has pairs of sources, not of rows.
    """
    per = df.where(F.col(prompt).isNotNull() & F.col(source).isNotNull()).groupBy(prompt, source).agg(F.min(key).alias("_k"))
    return per.alias("a").join(per.alias("b"), (F.col(f"a.{prompt}") == F.col(f"b.{prompt}")) & (F.col(f"a.{source}") < F.col(f"b.{source}"))).select(
        F.col(f"a.{prompt}").alias(prompt), F.col(f"a.{source}").alias("source_a"), F.col(f"b.{source}").alias("source_b"), F.col("a._k").alias("key_a"), F.col("b._k").alias("key_b")
    )


def eval_batches(accepted: Column, batch: int, most: int = 0) -> Column:
    """Batches of an evaluation: ``most`` if it is given, else as many as hold the accepted samples, one at least."""
    if most > 0:
        return F.lit(most)
    return F.when(accepted > 0, F.greatest(F.lit(1), F.ceil(accepted / max(1, batch)))).otherwise(F.lit(1)).cast("bigint")


def exact_match(df: DataFrame, by: list[str], told: str, true: str) -> DataFrame:
    """``by, n, exact``: the share of rows whose arrays are equal, rows without a true one left out."""
    return df.where(F.col(true).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col(told) == F.col(true), F.lit(False)).cast("int")), 6).alias("exact"))


def timing_means(df: DataFrame, by: list[str], times: str, every: int) -> DataFrame:
    """``by, window, steps, mean_ms``: the mean time of a step in each window of ``every`` steps, from times since the start."""
    took = F.transform(times, lambda t, i: F.struct(F.floor(i / every).cast("int").alias("window"), (t - F.when(i > 0, F.get(times, i - 1)).otherwise(0)).alias("ms")))
    return df.select(*by, F.inline(took)).groupBy(*by, "window").agg(F.count("ms").alias("steps"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def win_rate(wins: Column, n: Column) -> tuple[Column, Column, Column]:
    """Rate and its 95 % Wald interval, clamped to [0, 1], to four places."""
    w = wins / F.greatest(n, F.lit(1))
    half = 1.96 * F.sqrt(F.greatest(F.lit(1e-12), w * (1 - w) / F.greatest(n, F.lit(1))))
    return F.round(w, 4), F.round(F.greatest(F.lit(0.0), w - half), 4), F.round(F.least(F.lit(1.0), w + half), 4)


def windowed_mean(df: DataFrame, step: str, value: str, weight: str, every: int) -> DataFrame:
    """Weighted mean per window of ``every`` steps."""
    w = F.floor(F.col(step) / every).cast("bigint").alias("window")
    return df.groupBy(w).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), 6).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("window")


def dev_eval(df: DataFrame, loss: str, tokens: str, right: str) -> DataFrame:
    """Micro-averaged loss, ``exp(min(20, loss))`` and accuracy."""
    g = df.agg(F.sum(loss).alias("l"), F.sum(tokens).alias("t"), F.sum(right).alias("r"))
    mean = F.col("l") / F.greatest(F.col("t"), F.lit(1))
    return g.select(F.round(mean, 6).alias("loss"), F.round(F.exp(F.least(F.lit(20.0), mean)), 6).alias("ppl"), F.round(F.col("r") / F.greatest(F.col("t"), F.lit(1)), 6).alias("accuracy"))


def distinct_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1))


def flops(n: Column, d: Column, layers: Column, d_ff: Column, vocab: Column, steps: Column) -> Column:
    """Multiply-adds of decoding: ``(L (12 n d^2 + 2 n^2 d + 4 n d d_ff) + n d V) * steps``."""
    return (layers * (12 * n * d * d + 2 * n * n * d + 4 * n * d * d_ff) + n * d * vocab) * steps


def parameters(d: Column, layers: Column, d_ff: Column, vocab: Column, positions: Column, tied: Column) -> Column:
    """Parameter estimate: embeddings, attention and feed-forward blocks with norms, pooling query, final norm, head."""
    block = 4 * d * d + 2 * d + 2 * d * d_ff + d_ff + d
    return vocab * d + layers * block + d + positions * d + 2 * d + F.when(tied, 0).otherwise(vocab * d)


def learning_rate(step: Column, warm: int, total: int, floor: float) -> Column:
    """Share of the full rate: linear warm-up, then a cosine down to ``floor``."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warm) / max(1, total - warm)))
    return F.when(step < warm, step / max(1, warm)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
