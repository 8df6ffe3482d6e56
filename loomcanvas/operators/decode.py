"""Decoding on logits in long form (row, token, logit): legality, top-k, nucleus, argmax, and the loop with a policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.functions import prng
from loomcanvas.functions import vocab as V
from loomcanvas.functions.arrays import bind
from loomcanvas.operators.replay import start, step
from loomcanvas.operators.synthesis import valid_moves


def legal(token: Column, cursor: Column, size: Column, ban_structural: bool = True) -> Column:
    """Whether an action may follow a state; the model path also bans end-of-text, structural and reserved ids."""
    amount = V.move_amount(token)
    ok = ~((token == V.DELETE) & (cursor <= 0)) & ~(V.is_move(token) & ((cursor + amount < 0) | (cursor + amount > size)))
    banned = token.isin(V.EOT, V.CURSOR, V.END_OF_INPUT) | ((token >= V.RESERVED_START) & (token < V.RESERVED_END))
    return F.coalesce(ok, F.lit(True)) & ~banned if ban_structural else F.coalesce(ok, F.lit(True))


def legal_moves(cursor: Column, size: Column) -> Column:
    """The move ids that stay on the canvas."""
    return F.transform(valid_moves(cursor, size), lambda m: V.move_id(m))


def top_k(logits: DataFrame, row: str, logit: str, k: int) -> DataFrame:
    """The k best of each row and all ties with the last of them."""
    return logits.withColumn("_r", F.rank().over(Window.partitionBy(row).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def nucleus(logits: DataFrame, row: str, token: str, logit: str, p: float) -> DataFrame:
    """The best tokens whose predecessors hold at most ``p`` of the probability; the first always stays."""
    peak = F.max(logit).over(Window.partitionBy(row))
    weight = logits.withColumn("_w", F.exp(F.col(logit) - peak))
    prob = F.col("_w") / F.sum("_w").over(Window.partitionBy(row))
    before = Window.partitionBy(row).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, -1)
    return weight.withColumn("_p", prob).withColumn("_c", F.coalesce(F.sum("_p").over(before), F.lit(0.0))).where(F.col("_c") <= p).drop("_w", "_p", "_c")


def greedy(logits: DataFrame, row: str, token: str, logit: str) -> DataFrame:
    """The best token of each row, the smallest id on ties; one shuffle, map-side combined."""
    best = F.max(F.struct(F.col(logit), (-F.col(token)).alias("t")))
    return logits.groupBy(row).agg(best.alias("_b")).select(row, (-F.col("_b.t")).alias(token), F.col(f"_b.{logit}").alias(logit))


def pool(vectors: Column, query: Column, mask: Column) -> Column:
    """Attention pooling of an array of vectors: softmax of their products with ``query`` where ``mask``; all masked gives zeros."""
    dot = lambda v: F.aggregate(F.zip_with(v, query, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), dot(v).alias("s"), m.alias("m"))), lambda x: x["m"])
    peak = F.array_max(F.transform(scored, lambda x: x["s"]))
    weighted = F.transform(scored, lambda x: F.struct(x["v"].alias("v"), F.exp(x["s"] - peak).alias("w")))
    total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x["w"])
    zero = F.transform(query, lambda _: F.lit(0.0))
    return F.aggregate(weighted, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double") * x["w"] / total))


#: From the state (canvas, cursor), the step number and the legal move ids: the proposed action.
Policy = Callable[[Column, Column, Column], Column]


def hash_policy(key: Column, seed: int = 7, least_before_stop: int = 0) -> Policy:
    """A policy that proposes by hash: 4 % stops (not before ``least_before_stop`` actions), 8 % deletes, 23 % moves, else inserts."""

    def propose(s: Column, k: Column, moves: Column) -> Column:
        def chosen(r: Column) -> Column:
            insert = (prng.draw(seed, key, k, "token") % V.EOT).cast("int")
            move = F.get(moves, (prng.draw(seed, key, k, "move") % F.greatest(F.size(moves), F.lit(1))).cast("int"))
            return F.when((r < 0.04) & (k >= least_before_stop), F.lit(V.STOP)).when((r < 0.12) & (s["cursor"] > 0), F.lit(V.DELETE)).when((r < 0.35) & (F.size(moves) > 0), move).otherwise(insert)

        return bind(prng.uniform(seed, key, k, "kind"), chosen)

    return propose


def decode_loop(df: DataFrame, key: str, budget: int, seed: int = 7, least_before_stop: int = 0, policy: Policy | None = None) -> DataFrame:
    """``key, canvas, cursor, actions``: the decoding loop with ``policy``, by default the hash policy.

    An action that is illegal in its state does what the clamping replay makes of it. The loop ends at a stop or after ``budget``
    actions.
    """
    propose = policy or hash_policy(F.col(key), seed, least_before_stop)

    def go(s: Column, k: Column) -> Column:
        action = bind(legal_moves(s["cursor"], F.size(s["canvas"])), lambda moves: propose(s, k, moves))
        return F.when(s["stopped"], s).otherwise(bind(action, lambda a: step("clamp")(s, a)))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(budget - 1)), start(), go)
    return df.withColumn("_s", out).select(key, F.col("_s.canvas").alias("canvas"), F.col("_s.cursor").alias("cursor"), F.col("_s.history").alias("actions"))


def user_prefix(n: Column, draw: Column, most: int = 7) -> Column:
    """How many tokens of a target of ``n`` a test gives away: none of fewer than 5, of 5 to 9 one to three, else one to ``most``."""
    high = F.when(n < 10, F.least(F.lit(3), n)).otherwise(F.least(F.lit(max(1, most)), n))
    return F.when(n < 5, F.lit(0)).otherwise(1 + (draw % high)).cast("int")


def inference_test(targets: DataFrame, key: str, ids: str, budget: int, seed: int = 7, most_prefix: int = 7, policy: Policy | None = None) -> DataFrame:
    """A test run over targets: ``key, prefix_len, canvas, cursor, actions, exact``.

    The first ids of each target (``user_prefix`` of them) are inserted, then the loop goes on with ``policy`` until it stops or has
    done ``budget`` actions; ``exact`` says whether the target came out.
    """
    k = user_prefix(F.size(ids), prng.draw(seed, F.col(key), "prefix"), most_prefix)
    given = targets.where(F.col(ids).isNotNull()).select(key, ids, k.alias("prefix_len"))
    propose = policy or hash_policy(F.col(key), seed)

    def go(s: Column, at: Column) -> Column:
        own = bind(legal_moves(s["cursor"], F.size(s["canvas"])), lambda moves: propose(s, at, moves))
        action = F.when(at < F.col("prefix_len"), F.get(ids, at)).otherwise(own)
        return F.when(s["stopped"] | (at >= F.col("prefix_len") + budget), s).otherwise(bind(action, lambda a: step("clamp")(s, a)))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(most_prefix + budget - 1)), start(), go)
    done = given.select("*", F.explode(F.array(out)).alias("_s"))  # evaluated once
    return done.select(key, "prefix_len", F.col("_s.canvas").alias("canvas"), F.col("_s.cursor").alias("cursor"), F.col("_s.history").alias("actions"), (F.col("_s.canvas") == F.col(ids)).alias("exact"))
