"""Problem 3: filling containers of fixed capacity by minimum bin slack over the length histogram.

Items of one length are interchangeable, so the plan is made on counts per length (at most ``capacity`` rows, whatever
the number of items): a bitset subset-sum finds the fullest combination of the lengths that are left and the plan takes it as
often as the counts allow. Items are then ranked within their length, without any global sort, and the
rank says which container of the plan holds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.plans.frames import cut

#: Items of one length are ranked in groups of about this many rows.
GROUP_ROWS = 250_000
#: Largest number of capacities and their largest sum: the bound of the histogram that is collected.
MOST_KINDS, MOST_CAPACITY = 1_000, 4_000_000
#: Rows of the plan (a few per kind and length) that are broadcast; more are joined by a shuffle.
MOST_PLAN = 200_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination (length -> how many) with the largest sum <= capacity; it holds the largest length left.

    Subset sums are bits of one integer. Each length enters in powers of two of its usable count, so a layer costs a
    few shifts; walking the layers back names the combination, longest items first.
    """
    largest = max(counts)
    room, mask = capacity - largest, (1 << (capacity - largest + 1)) - 1
    layers, reach = [], 1
    for length in sorted(counts):  # shortest first, so that the walk back meets the longest first
        usable = min(counts[length] - (length == largest), room // length)
        step = 1
        while usable > 0:
            take = min(step, usable)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            usable -= take
            step *= 2
        if reach >> room & 1 and length * 2 > room:
            break
    best = reach.bit_length() - 1
    out = {largest: 1}
    for length, take, before in reversed(layers):
        if best >= length * take and before >> (best - length * take) & 1:
            out[length] = out.get(length, 0) + take
            best -= length * take
        if not best:
            break
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, last rank + 1, first container, items per container) and the number of containers."""
    left, used, rows, containers = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        mix = fullest(left, capacity)
        times = min(left[length] // many for length, many in mix.items())
        for length, many in mix.items():
            rows.append((length, used[length], used[length] + many * times, containers, many))
            used[length] += many * times
            left[length] -= many * times
            if not left[length]:
                del left[length]
        containers += times
    return rows, containers


def pack(items: DataFrame, keys: list[str], length: str, limits: list[tuple[str, int]]) -> DataFrame:
    """A container for each item (or piece): ``container_kind, container_no, keys, piece_no, piece_len``.

    An item longer than the capacity is cut into full pieces and a rest; no other item is split. Null and negative
    lengths count as 0; an item of length 0 is put into the container that its key's hash names (0 if there is none).
    ``keys`` must be unique; ties in length are settled by the keys' hash, then the keys. Kinds with a null or
    non-positive capacity are refused; no kinds give no rows.
    """
    spark = items.sparkSession
    if len(limits) > MOST_KINDS or sum(c or 0 for _, c in limits) > MOST_CAPACITY or any(not c or c <= 0 for _, c in limits):
        raise ValueError("capacities must be positive and within the stated bounds")
    if not limits:
        named = ", ".join(f"`{k}` {dict(items.dtypes)[k]}" for k in keys)
        return spark.createDataFrame([], f"container_kind string, container_no bigint, {named}, piece_no int, piece_len int")
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in limits])
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("int")
    each = items.select(*keys, n.alias("_n"), F.xxhash64(*keys).alias("_h")).select("*", F.inline(kinds))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / F.col("capacity")).cast("int") - 1, F.lit(0)))
    cutup = each.select("*", F.explode(pieces).alias("piece_no")).withColumn("piece_len", F.least(F.col("capacity"), F.col("_n") - F.col("capacity") * F.col("piece_no")))
    rows = cut(cutup.select("container_kind", *keys, "piece_no", "piece_len", "_h"))

    fine = rows.groupBy("container_kind", "piece_len").count()
    histogram = [tuple(r) for r in fine.collect()]
    groups = max([1, *(-(-c // GROUP_ROWS) for _, size, c in histogram if size)])
    planned, totals = [], {}
    for kind, capacity in limits:
        made, totals[kind] = plan({size: c for k, size, c in histogram if k == kind and size > 0}, capacity)
        planned += [(kind, *r) for r in made]

    salted = rows.where("piece_len > 0").withColumn("_s", F.pmod(F.col("_h"), F.lit(groups)).cast("int"))
    part = ["container_kind", "piece_len", "_s"]
    before = (
        salted.groupBy(*part).count()
        .withColumn("_base", F.sum("count").over(Window.partitionBy("container_kind", "piece_len").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*part, F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    local = F.row_number().over(Window.partitionBy(*part).orderBy("_h", *keys, "piece_no")) - 1
    ranked = salted.withColumn("_local", local).join(before, part).withColumn("_rank", F.col("_base") + F.col("_local"))
    schema = "container_kind string, piece_len int, _from bigint, _to bigint, _first bigint, _many int"
    table = spark.createDataFrame(planned, schema).groupBy("container_kind", "piece_len").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_first", "_many"))).alias("_plan"))
    step = F.filter("_plan", lambda p: (p["_from"] <= F.col("_rank")) & (F.col("_rank") < p["_to"]))[0]
    placed = ranked.join(F.broadcast(table) if len(planned) <= MOST_PLAN else table, ["container_kind", "piece_len"]).withColumn("_p", step).select(
        "container_kind", (F.col("_p._first") + F.floor((F.col("_rank") - F.col("_p._from")) / F.col("_p._many"))).cast("bigint").alias("container_no"), *keys, "piece_no", "piece_len"
    )
    number = F.coalesce(*[F.when(F.col("container_kind") == k, F.lit(max(t, 1))) for k, t in totals.items()])
    blank = rows.where("piece_len = 0").select("container_kind", F.pmod(F.col("_h"), number).cast("bigint").alias("container_no"), *keys, "piece_no", "piece_len")
    return placed.unionByName(blank)
