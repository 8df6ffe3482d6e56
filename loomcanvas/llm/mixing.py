"""Problem 8: mixing sources to target shares of tokens by a min-cost flow over membership patterns.

Equal texts are one unit that belongs to every source holding a copy. Units are aggregated by membership pattern (the
sources they belong to); for each mix a flow routes pattern tokens to source quotas, where the k-th use of a pattern's
tokens costs k (convex: no text is repeated while an unused one would do). Units are laid on a line in seeded order, so
the flow of a pattern turns into whole documents without a global sort; the room that is left where a document would
stand over the end of its share is filled with unused documents that fit.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.llm.tokenizing import count_column
from loomcanvas.plans.frames import cut

#: Rows of the flow (one per pattern and source) that are broadcast; more are joined by a shuffle.
MOST_FLOWS = 100_000
#: Units of one pattern are laid out in groups of about this many rows.
GROUP_ROWS = 250_000
#: Rows of the targets table that are read to the driver.
MOST_TARGETS = 10_000


def route(supply: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each pattern to each source: a maximum flow of least cost.

    Only the arcs into the patterns have costs (k for the k-th use), so opening them use by use and augmenting to a maximum each
    time is successive shortest paths: a residual path never leaves through the start again.
    """
    flow = {(p, s): 0 for p in supply for s in p if s in quota}
    limit = {(p, s): supply[p] * repeats[s] for p, s in flow}
    need, members = dict(quota), {s: [p for p in supply if s in p] for s in quota}
    for use in range(1, max(repeats.values(), default=0) + 1):
        spare = {p: n for p, n in supply.items() if any(repeats.get(s, 0) >= use for s in p)}
        while True:  # breadth first from patterns with tokens to sources with need, back over flow that can be moved
            came: dict[object, object] = {p: None for p, n in spare.items() if n > 0}
            queue, end = deque(came), None
            while queue and end is None:
                at = queue.popleft()
                if isinstance(at, tuple):
                    for s in (x for x in at if x in quota):
                        if s not in came and flow[at, s] < limit[at, s]:
                            came[s] = at
                            if need[s] > 0:
                                end = s
                                break
                            queue.append(s)
                else:
                    for p in members[at]:
                        if p not in came and flow[p, at] > 0:
                            came[p] = at
                            queue.append(p)
            if end is None:
                break
            path, at = [], end
            while came[at] is not None:
                path.append((came[at], at))
                at = came[at]
            much = min(need[end], spare[at], *(limit[a, b] - flow[a, b] if isinstance(a, tuple) else flow[b, a] for a, b in path))
            for a, b in path:
                flow[(a, b) if isinstance(a, tuple) else (b, a)] += much if isinstance(a, tuple) else -much
            need[end] -= much
            spare[at] -= much
    return {k: v for k, v in flow.items() if v}


def share_out(supply: dict[tuple[str, ...], int], size: int, targets: dict[str, tuple[float, int]], rebalance: bool) -> tuple[dict[tuple[tuple[str, ...], str], int], dict[str, int]]:
    """The flow of one mix and what each source is to hold. ``targets``: source -> (share, most uses).

    With ``rebalance`` what short sources cannot give is asked of the others, in proportion to their shares, until the size is
    reached or nothing is left.
    """
    repeats = {s: r for s, (_, r) in targets.items()}
    fixed: dict[str, int] = {}
    while True:
        free = {s: share for s, (share, _) in targets.items() if s not in fixed}
        rest, whole = size - sum(fixed.values()), sum(free.values()) if rebalance else 1.0
        quota = fixed | {s: int(rest * share / whole) if rebalance else int(size * share) for s, share in free.items()}
        flow = route(supply, quota, repeats)
        got = {s: sum(n for (_, x), n in flow.items() if x == s) for s in targets}
        short = {s: got[s] for s in free if got[s] < quota[s]}
        if not rebalance or not short or len(short) == len(free):
            return flow, {s: min(quota[s], got[s]) for s in targets}
        fixed |= short


def fitting(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many items of each size to put into ``room``: the largest that fits, again and again."""
    out = {}
    for size in sorted(counts, reverse=True):
        if 0 < size <= room:
            out[size] = min(counts[size], room // size)
            room -= out[size] * size
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None, rebalance: bool = False) -> DataFrame:
    """The chosen documents: ``mix_name, source, doc_id, repeats int, n_tokens bigint`` (tokens of one use).

    ``documents`` has doc_id, text, source; ``targets`` has mix_name, source, target_share, max_repeats,
    corpus_fraction. A mix wants corpus_fraction of all documents' tokens, each source its share of that; no source gets
    more. A source that cannot give its share even when repeated gives all it has (max_repeats times); the others keep
    their quotas, or with ``rebalance`` share what it lacks. Of equal texts in a source the lowest doc_id stands for all, and all
    copies together are used max_repeats times at most. Null or empty texts, null sources and sources outside the mix are
    never chosen; targets with null names, or shares, fractions or repeats that are null or not positive ask for nothing.
    Empty tables give no rows.
    """
    spark = documents.sparkSession
    rows = targets.select("mix_name", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"), F.col("corpus_fraction").cast("double")).dropna().where("target_share > 0 AND max_repeats > 0 AND corpus_fraction > 0").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError("too many targets")
    schema = "mix_name string, source string, doc_id bigint, repeats int, n_tokens bigint"
    sized = cut(
        count_column(documents.withColumn("_t", F.md5("text")), ["doc_id", "source", "_t"], "text", path).where("n_tokens > 0")
    )
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = sorted({r["source"] for r in rows})
    if not wanted or not total:
        return spark.createDataFrame([], schema)
    per_source = sized.where(F.col("source").isin(wanted)).groupBy("_t", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    # A text has at most one row per wanted source here, so a list is as long as the number of sources.
    units = per_source.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("_in"), F.max("n_tokens").alias("n_tokens"))
    member = cut(units.select("_t", "n_tokens", "_in", F.transform("_in", lambda x: x["source"]).alias("_p"), F.xxhash64(F.lit(seed), "_t").alias("_h")))
    supply: dict[tuple[str, ...], int] = {}
    most = 1
    for p, n, k in member.groupBy("_p").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect():  # a row per pattern in the data
        supply[tuple(p)] = n
        most = max(most, k)
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    size: dict[str, int] = {}
    for r in rows:
        mixes.setdefault(r["mix_name"], {})[r["source"]] = (r["target_share"], r["max_repeats"])
        size[r["mix_name"]] = int(r["corpus_fraction"] * total)
    lines, asked = [], {}
    for m, t in mixes.items():
        flow, holds = share_out({p: n for p, n in supply.items() if any(s in t for s in p)}, size[m], t, rebalance)
        asked |= {(m, s): n for s, n in holds.items()}
        for p in supply:
            at, segments = 0, []
            for s in p:
                if much := flow.get((p, s), 0):
                    segments.append((s, at, at + much))
                    at += much
            if segments:
                lines.append((m, list(p), segments, supply[p], max(t[x][1] for x in p if x in t)))
    groups = -(-most // GROUP_ROWS)
    part = ["_p", "_s"]
    salted = member.withColumn("_s", F.floor((F.col("_h") / 2.0**64 + 0.5) * groups).cast("int"))
    sums = salted.groupBy(*part).agg(F.sum("n_tokens").alias("_n"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*part).orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = cut(salted.withColumn("_local", local).join(base, part).select("_t", "_h", "n_tokens", "_in", "_p", (F.col("_base") + F.col("_local")).alias("_at")))
    table = spark.createDataFrame(lines, "mix_name string, _p array<string>, _of array<struct<source:string,start:bigint,stop:bigint>>, _all bigint, _uses int")
    placed = laid.join(F.broadcast(table) if len(lines) <= MOST_FLOWS else table, "_p")

    def uses(x: Column) -> Column:
        """How often the unit stands wholly within a source's stretch."""
        begins = lambda k: k * F.col("_all") + F.col("_at")
        return F.size(F.filter(F.sequence(F.lit(0), F.col("_uses") - 1), lambda k: (begins(k) >= x["start"]) & (begins(k) + F.col("n_tokens") <= x["stop"])))

    placed = placed.withColumn("_got", F.transform("_of", lambda x: F.struct(x["source"].alias("source"), uses(x).alias("repeats"))))
    taken = placed.select("mix_name", "_in", "n_tokens", F.inline("_got")).where("repeats > 0")
    got = {(m, s): n for m, s, n in taken.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats"))).collect()}
    room = spark.createDataFrame([(m, s, n - got.get((m, s), 0)) for (m, s), n in asked.items() if n > got.get((m, s), 0)], "mix_name string, source string, _room bigint")
    # Of a pattern's unused units each is offered to one of its sources, so that none is taken twice.
    unused = placed.where(F.aggregate("_got", F.lit(0), lambda s, x: s + x["repeats"]) == 0)
    offered = unused.select("mix_name", "_t", "_h", "_in", "n_tokens", F.get("_of", F.pmod("_h", F.size("_of")).cast("int"))["source"].alias("source"))
    fits = offered.join(F.broadcast(room), ["mix_name", "source"]).where(F.col("n_tokens") <= F.col("_room")).drop("_room")  # as many rows as targets at most
    stock: dict[tuple[str, str], dict[int, int]] = {}
    for m, s, n, k in fits.groupBy("mix_name", "source", "n_tokens").count().collect():  # a row per target and length
        stock.setdefault((m, s), {})[n] = k
    picks = [(m, s, n, k) for (m, s), counts in stock.items() for n, k in fitting(asked[m, s] - got.get((m, s), 0), counts).items() if k]
    doc = F.filter("_in", lambda x: x["source"] == F.col("source"))[0]["doc_id"].alias("doc_id")
    columns = ["mix_name", "source", doc, "repeats", "n_tokens"]
    if not picks:
        return taken.select(*columns)
    rank = F.row_number().over(Window.partitionBy("mix_name", "source", "n_tokens").orderBy("_h", "_t"))
    chosen = spark.createDataFrame(picks, "mix_name string, source string, n_tokens bigint, _k bigint")
    last = fits.join(F.broadcast(chosen), ["mix_name", "source", "n_tokens"]).withColumn("_rank", rank).where(F.col("_rank") <= max(k for *_, k in picks)).where("_rank <= _k")
    return taken.select(*columns).unionByName(last.withColumn("repeats", F.lit(1)).select(*columns))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mix holds: ``mix_name, source, target_share, actual_share, gap, tokens, documents, most_repeats``.

    One row per target; a source that gave nothing has zeros, a mix without tokens null shares.
    """
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    # The targets are a small fixed table; its join with the per-source sums is tiny whichever way it runs.
    out = targets.select("mix_name", "source", "target_share").join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).alias("actual_share"), F.when(whole > 0, F.col("tokens") / whole - F.col("target_share")).alias("gap"), "tokens", "documents", "most_repeats")
