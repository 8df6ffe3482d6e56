"""Problem 4: one ranking from pairwise votes, by the stationary distribution of a comparison Markov chain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcanvas.operators.collate import positions
from loomcanvas.plans.frames import cut, latest

#: Half a vote for either side of every compared pair keeps rates off 0 and 1.
SMOOTHING = 0.5
#: The iteration goes on until a round moves less than this (of a total of 1); by joins, where a round costs more, a little more.
TOLERANCE, JOIN_TOLERANCE = 1e-13, 1e-11
#: Up to this many items and pairs are iterated on the driver, more by joins; items up to the third number by squaring the matrix.
DRIVER_ITEMS, DRIVER_PAIRS, DENSE_ITEMS = 100_000, 500_000, 1_000


def vote_totals(df: DataFrame, key: str, votes: str, arrived: str) -> DataFrame:
    """``winner, loser, votes``: totals over the last delivery of each key.

    ``votes`` is a map ``x>y -> n``. Blanks around names do not count; votes of an item against itself, null or
    non-positive counts, null maps and keys that are no ``x>y`` say nothing. A map is turned into a sorted array before
    the deduplicating shuffle, and votes are summed before the second one.
    """
    pairs = F.array_sort(F.map_entries(votes))
    narrow = df.select(key, F.col(arrived).alias("_at"), pairs.alias("_p"))
    last = latest(narrow, [key], ["_p"], ["_at", F.xxhash64("_p")])
    names = F.split(F.col("_v.key"), ">")
    one = (
        last.select(F.explode("_p").alias("_v"))
        .where(F.size(names) == 2)
        .select(F.trim(names[0]).alias("winner"), F.trim(names[1]).alias("loser"), F.col("_v.value").alias("votes"))
        .where("winner <> loser AND winner <> '' AND loser <> '' AND votes > 0")
    )
    return one.groupBy("winner", "loser").agg(F.sum("votes").cast("bigint").alias("votes"))


def _stationary(totals: list[tuple[str, str, int]], items: list[str], smoothing: float, dense: int = DENSE_ITEMS) -> np.ndarray:
    """The stationary distribution of the chain from a uniform start, to TOLERANCE."""
    n = len(items)
    if not n:
        return np.zeros(0)
    at = {x: i for i, x in enumerate(items)}
    winner = np.array([at[a] for a, _, _ in totals], np.int64)
    loser = np.array([at[b] for _, b, _ in totals], np.int64)
    votes = np.array([v for _, _, v in totals], np.float64)
    # Each compared pair moves both ways: from the loser to the winner with its votes, smoothed.
    pair, where = np.unique(np.concatenate([loser * n + winner, winner * n + loser]), return_inverse=True)
    weight = np.bincount(where, weights=np.concatenate([votes, np.zeros(len(votes))]), minlength=len(pair)) + smoothing
    source, target = pair // n, pair % n
    out = np.bincount(source, weights=weight, minlength=n)
    weight = weight / max(out.max(initial=0.0), 1e-300)
    stay = 1 - np.bincount(source, weights=weight, minlength=n)
    rest = np.full(n, 1 / n)
    if n <= dense:
        move = np.zeros((n, n))
        move[source, target] = weight
        move[np.diag_indices(n)] = stay
        while True:  # 1, 2, 4, ... rounds at once
            following = rest @ move
            following /= following.sum()
            if np.abs(following - rest).sum() < TOLERANCE:
                return following
            rest, move = following, move @ move
            move /= move.sum(axis=1, keepdims=True)
    while True:
        following = rest * stay + np.bincount(target, weights=rest[source] * weight, minlength=n)
        following /= following.sum()
        if np.abs(following - rest).sum() < TOLERANCE:
            return following
        rest = following


def rank(totals: DataFrame, items: DataFrame, name: str, smoothing: float = SMOOTHING, driver_items: int = DRIVER_ITEMS, driver_pairs: int = DRIVER_PAIRS) -> DataFrame:
    """``model_name, strength, rank_no`` for every item of ``items`` (column ``name``), 1 the strongest.

    From each item the chain moves to a rival in proportion to the smoothed win rate of the rival over it, weighted by
    the votes of the pair (for votes that follow strengths any symmetric weight keeps the stationary distribution; this
    one lets rare meetings say little). Votes on items that are not in ``items`` are left out. Items that were never
    compared keep the average strength. Equal strengths are ordered by name. No votes: all equal.
    """
    spark = totals.sparkSession
    known = items.select(F.col(name).alias("model_name")).where("model_name IS NOT NULL").distinct()
    mine = cut(
        totals.join(known.select(F.col("model_name").alias("winner")), "winner", "left_semi")
        .join(known.select(F.col("model_name").alias("loser")), "loser", "left_semi")
        .select("winner", "loser", "votes")
    )
    few = [r[0] for r in known.limit(driver_items + 1).collect()]
    pairs = mine.limit(driver_pairs + 1).collect() if len(few) <= driver_items else []
    if len(few) <= driver_items and len(pairs) <= driver_pairs:
        few.sort()
        strength = _stationary([tuple(r) for r in pairs], few, smoothing)
        order = sorted(range(len(few)), key=lambda i: (-strength[i], few[i]))
        rows = [(few[i], float(strength[i]), no) for no, i in enumerate(order, 1)]
        return spark.createDataFrame(rows, "model_name string, strength double, rank_no int")
    ranked = stationary_by_joins(mine, known, smoothing).withColumn("_weak", -F.col("strength"))
    # A global rank of many items from the counts of a range sort's slices, never one window.
    return positions(ranked, ["_weak", "model_name"]).select("model_name", "strength", (F.col("position") + 1).cast("int").alias("rank_no"))


def stationary_by_joins(totals: DataFrame, known: DataFrame, smoothing: float = SMOOTHING, rounds: int | None = None, every: int = 5, tolerance: float = JOIN_TOLERANCE) -> DataFrame:
    """The same chain for item sets too large for the driver: power iteration as joins until it rests (or for ``rounds``), cut every few rounds."""
    both = totals.select("winner", "loser", "votes").union(totals.select(F.col("loser"), F.col("winner"), F.lit(0).cast("bigint")))
    rates = both.groupBy("winner", "loser").agg((F.sum("votes") + F.lit(smoothing)).alias("w"))
    moves = cut(rates.select(F.col("loser").alias("src"), F.col("winner").alias("dst"), "w"))
    out = moves.groupBy("src").agg(F.sum("w").alias("out"))
    busiest = out.agg(F.max("out")).first()[0] or 1.0
    n = known.count()
    state = cut(known.join(out.withColumnRenamed("src", "model_name"), "model_name", "left").select("model_name", F.coalesce("out", F.lit(0.0)).alias("out"), F.lit(1.0 / max(n, 1)).alias("strength")))
    moved, done = 1.0 if n else 0.0, 0
    while moved >= tolerance and (rounds is None or done < rounds):
        done += every
        for _ in range(every):
            came = moves.join(state.select(F.col("model_name").alias("src"), "strength"), "src").groupBy(F.col("dst").alias("model_name")).agg(F.sum(F.col("strength") * F.col("w")).alias("came"))
            state = state.join(came, "model_name", "left").select("model_name", "out", (F.col("strength") * (1 - F.col("out") / busiest) + F.coalesce("came", F.lit(0.0)) / busiest).alias("strength"), F.col("strength").alias("before"))
        state = cut(state)
        moved = state.agg(F.sum(F.abs(F.col("strength") - F.col("before")))).first()[0]
        state = state.drop("before")
    return state.select("model_name", "strength")
