"""Problem 6: repeated consecutive events. Each maximal run of equal events becomes one event with count and duration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcanvas.plans.frames import latest

# The marks that end a text action list.
STOP_MARKS = ("END_OF_RESPONSE", "STOP")
#: Pairs of marks that may be set around an operand, and how many of them around each other.
AROUND, DEPTH = ("()", "[]", "{}", "<>", '""', "''", "“”", "‘’", "«»"), 3
_PAIR = "(?s)^(?:" + "|".join(rf"\{a}\s*(.*?)\s*\{b}?" for a, b in AROUND) + ")$"
_KEPT = "".join(f"${i}" for i in range(1, len(AROUND) + 1))


def canonical_action(action: Column) -> Column:
    """A text action in one spelling: ``MOVE`` and sign and number, ``INSERT`` and the exact letters, ``DELETE``, ``STOP``.

    Case of the verb, blanks, leading zeros of a number and marks set around the operand (the closing one may be missing) do not
    count; the case of inserted letters does. Text that is no known action stays itself without outer blanks, so it
    equals only itself. Null stays null.
    """
    text = F.trim(F.regexp_replace(action, r"(?s)^\s*\[(.*)\]\s*$", "$1"))
    verb = F.upper(F.regexp_extract(text, r"(?s)^\s*([A-Za-z_]+)", 1))
    bare = F.trim(F.regexp_extract(text, r"(?s)^\s*[A-Za-z_]+[\s:=_]*(.*?)\s*$", 1))
    for _ in range(DEPTH):
        bare = F.regexp_replace(bare, _PAIR, _KEPT)
    operand = F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), r"^([+-]?)0+(?=\d)", "$1")
    return (
        F.when(verb.isin(*STOP_MARKS), F.lit("STOP"))
        .when(verb == "MOVE", F.concat(F.lit("MOVE "), F.regexp_replace(operand, r"^(?=\d)", "+")))
        .when(verb == "DELETE", F.concat(F.lit("DELETE"), operand))
        .when(verb == "INSERT", F.concat(F.lit("INSERT "), bare))
        .otherwise(F.trim(action))
    )


def runs(events: Column, times: Column, least: int = 1) -> Column:
    """``array<struct<run_start int, run_len int, duration bigint>>`` of an event array, runs of ``least`` or more.

    Boundary-only rows: the positions whose event differs from its predecessor are kept; the lead over these starts
    gives the count. ``duration`` is the time of the run's end less the time of the previous run's end (for the first
    run, less 0), from ``times``; in steps (the count) where there are no times or too few. A null array gives null, an empty one
    no runs; a null element equals no other element.
    """
    kind = "array<struct<run_start:int,run_len:int,duration:bigint>>"

    def build(a: Column) -> Column:
        size = F.size(a)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | F.coalesce(F.get(a, i) != F.get(a, i - 1), F.lit(True)))

        def event(pair: Column) -> Column:
            start, end = pair["s"], pair["e"]
            before = F.when(start == 0, F.lit(0)).otherwise(F.get(times, start - 1))
            lasted = F.coalesce(F.get(times, end - 1) - before, end - start).cast("bigint")
            return F.struct(start.alias("run_start"), (end - start).alias("run_len"), lasted.alias("duration"))

        def lead(s: Column) -> Column:
            leads = F.concat(F.slice(s, 2, F.size(s)), F.array(size))
            pairs = F.zip_with(s, leads, lambda x, y: F.struct(x.alias("s"), y.alias("e")))
            return F.transform(F.filter(pairs, lambda p: p["e"] - p["s"] >= least) if least > 1 else pairs, event)

        return F.when(a.isNull(), F.lit(None)).when(size == 0, F.array()).otherwise(bind(starts, lead)).cast(kind)

    return bind(events, build)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a lambda variable is not expanded into its uses as an expression is."""
    return F.transform(F.array(value), body)[0]


def run_table(df: DataFrame, keys: list[str], events: Column, times: Column, arrived: str, least: int = 1) -> DataFrame:
    """One row per run: ``keys``, run_start, run_len, duration. Re-delivered keys count once (the last arrival).

    The runs are built before the shuffle that finds the last arrival, so only they travel, not the sequences.
    Keys whose last delivery holds a null or empty sequence have no rows.
    """
    narrow = df.select(*keys, F.col(arrived).alias("_at"), runs(events, times, least).alias("_runs"))
    last = latest(narrow, keys, ["_runs"], ["_at", F.xxhash64("_runs")])
    return last.select(*keys, F.explode("_runs").alias("_r")).select(*keys, "_r.run_start", "_r.run_len", "_r.duration")


def collapse(events: Column, times: Column) -> Column:
    """The sequence with each run as one event: ``array<struct<event, run_start, run_len, duration>>``."""
    return F.transform(
        runs(events, times),
        lambda r: F.struct(F.get(events, r["run_start"]).alias("event"), r["run_start"].alias("run_start"), r["run_len"].alias("run_len"), r["duration"].alias("duration")),
    )
