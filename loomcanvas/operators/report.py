"""Reports: best samples, tables, summaries, viewer states, manifest, metric series."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.functions import text as T
from loomcanvas.functions import vocab as V
from loomcanvas.operators.collate import positions
from loomcanvas.operators.metrics import distinct_ratio
from loomcanvas.operators.replay import trace


def sample_score(text: Column) -> Column:
    """0.7 times the share of distinct words plus 0.3 times the length in words up to 180."""
    w = T.split_words(text)
    return 0.7 * distinct_ratio(w) + 0.3 * F.least(F.lit(1.0), F.size(w) / 180.0)


def top_share(df: DataFrame, keep: list[str], text: str, order: str, percent: float = 10.0) -> DataFrame:
    """The best ``percent`` of rows with text (one at least), by score, then ``order``. Their number grows with the rows, so they are
    told by their places in a range sort, not gathered."""
    scored = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(*keep, order, F.round(sample_score(F.col(text)), 6).alias("score"))
    placed = positions(scored.withColumn("_low", -F.col("score")), ["_low", order])
    n = placed.agg(F.max("position")).first()[0]
    return placed.where(F.col("position") < max(1, -(-int(((n or 0) + 1) * percent) // 100))).drop("_low", "position")


def rate_rows(df: DataFrame, name: Column, rate: Column, other: Column) -> DataFrame:
    """Table rows of win rates in per cent; rows without a rate are left out, underscores escaped."""
    return df.where(rate.isNotNull() & other.isNotNull()).select(T.latex(name).alias("name"), T.percent(rate).alias("rate_pct"), T.percent(other).alias("other_pct"))


def number_rows(df: DataFrame, section: str, name: Column, first: Column, second: Column) -> DataFrame:
    """``section, name, first, second`` of a table of figures to four places; rows without a first figure are left out."""
    shown = lambda c: F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))
    return df.where(first.isNotNull()).select(F.lit(section).alias("section"), T.latex(name).alias("name"), shown(first).alias("first"), shown(second).alias("second"))


def table_rows(*parts: DataFrame) -> DataFrame:
    """The rows of several tables (section, name, first, second) as one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("first IS NOT NULL")


def latex_table(rows: list[tuple[str, str, str]], caption: str, heads: tuple[str, str, str]) -> str:
    """A small table as LaTeX; names are taken as they are (``table_rows`` escapes them), per cent signs escaped."""
    body = [" & ".join(x.replace("%", "\\%") for x in r) + " \\\\" for r in rows]
    lines = ["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", "\\begin{tabular}{lcc}", "\\toprule", " & ".join(heads) + " \\\\", "\\midrule", *body, "\\bottomrule", "\\end{tabular}", "\\end{table}"]
    return "\n".join(lines) + "\n"


def without_key(value: Any, key: str) -> Any:  # noqa: ANN401
    """``value`` without ``key`` in it and in all that is nested in it."""
    if isinstance(value, dict):
        return {k: without_key(v, key) for k, v in value.items() if k != key}
    return [without_key(v, key) for v in value] if isinstance(value, list) else value


def drop_json_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """``df`` with ``key`` dropped everywhere in the JSON texts of ``column``; null and unreadable texts give null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(without_key(json.loads(text), key), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array([one(x) for x in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


# What is kept of a published summary of each task, with what stands for it where a summary lacks it.
KEPT: dict[str, dict[str, Any]] = {
    "evalppl": {"ranked": [], "by_source": {}, "eval_model": None, "scorer": None},
    "mauve": {"protocol": None, "settings": {}, "models": [], "results": {}},
    "trajectory_stats": {"datasets": [], "results": {}, "config": {}},
}


def normalise_summary(task: str, summary: Any, **about: Any) -> dict[str, Any]:  # noqa: ANN401
    """A published summary (a small JSON document) in one shape: ``task``, ``about``, ``status`` and what the task keeps.

    An arena's ``comparisons`` are kept without ``elo`` entries, whether they are a list or a map of lists; an arena summary
    without comparisons passes through as ``payload``, also without them.
    """
    out: dict[str, Any] = {"task": task, **about, "status": "normalized_summary"}
    if task == "arena":
        if "comparisons" in summary:
            return {**out, "n_comparisons": len(summary["comparisons"]), "comparisons": without_key(summary["comparisons"], "elo")}
        return {**out, "status": "passthrough_summary", "payload": without_key(summary, "elo")}
    if task not in KEPT:
        return {**out, "payload": summary}
    return {**out, **{k: summary.get(k, instead) for k, instead in KEPT[task].items()}}


STATES = "array<struct<tokens:array<int>,token_strings:array<string>,cursor:int,action:string,action_detail:string,text:string>>"


def action_text(t: Column) -> Column:
    """What a viewer shows of an id: ``[MOVE +4]``, ``DELETE``, the marks of the structural ids, or the id that is inserted."""
    amount = V.move_amount(t)
    return (
        F.when(t == V.DELETE, "DELETE").when(t == V.STOP, "[END_OF_RESPONSE]").when(t == V.END_OF_INPUT, "[END_OF_INPUT]").when(t == V.CURSOR, "[CURSOR]")
        .when(amount.isNotNull(), F.concat(F.lit("[MOVE "), F.when(amount > 0, "+").otherwise(""), amount.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("INSERT "), t.cast("string")))
    )


def cursor_text(canvas: Column, cursor: Column) -> Column:
    """The canvas (strings) as one line with ``[CURSOR]`` in its place; a cursor off the canvas stands at its nearer end."""
    at = F.least(F.greatest(cursor, F.lit(0)), F.size(canvas))
    line = lambda x: T.one_line(F.array_join(x, " "))
    return F.concat(line(F.slice(canvas, 1, at)), F.lit("[CURSOR]"), line(F.slice(canvas, at + 1, F.size(canvas))))


def prefix_target(given: Column, states: Column, default: int = 0) -> Column:
    """The state a viewer starts at: the sample's prefix length (else ``default``), within the states."""
    return F.least(F.greatest(F.coalesce(given, F.lit(default)), F.lit(0)), F.greatest(states - 1, F.lit(0)))


def viewer_states(actions: Column, final_text: Column, states: Column | None = None, trajectory: Column | None = None) -> Column:
    """JSON of the viewer's states, from the first of these that has any: ``states`` (an array of structs as in STATES),
    ``trajectory`` (an array of texts), the replayed actions, the final text.

    Missing fields of given states get defaults: cursor 0, action ``STEP``, detail ``Step n``, the joined token strings as text. A
    replay has a start state and one state per action up to the stop; a final text has a start and a final state.
    """
    none, no_words = F.array().cast("array<int>"), F.array().cast("array<string>")

    def state(tokens: Column, words: Column, cursor: Column, action: Column, detail: Column, text: Column) -> Column:
        return F.struct(tokens.alias("tokens"), words.alias("token_strings"), cursor.cast("int").alias("cursor"), action.alias("action"), detail.alias("action_detail"), text.alias("text"))

    def given(s: Column, i: Column) -> Column:
        words = F.coalesce(s["token_strings"], F.transform(s["tokens"], lambda t: t.cast("string")), no_words)
        return state(F.coalesce(s["tokens"], none), words, F.coalesce(s["cursor"], F.lit(0)), F.coalesce(s["action"], F.lit("STEP")), F.coalesce(s["action_detail"], F.concat(F.lit("Step "), (i + 1).cast("string"))), F.coalesce(s["text"], F.array_join(words, "")))

    def told(text: Column, i: Column) -> Column:
        return state(none, no_words, F.lit(0), F.lit("STEP"), F.concat(F.lit("Step "), (i + 1).cast("string")), F.coalesce(text, F.lit("")))

    live = F.slice(actions, 1, F.when(F.array_position(actions, F.lit(V.STOP)) > 0, F.array_position(actions, F.lit(V.STOP)).cast("int")).otherwise(F.size(actions)))

    def shown(r: Column, t: Column) -> Column:
        words = F.transform(r["canvas"], lambda x: x.cast("string"))
        return state(r["canvas"], words, r["cursor"], F.upper(V.kind(t, "tokenizer")), action_text(t), F.array_join(words, " "))

    first = state(none, no_words, F.lit(0), F.lit("START"), F.lit("Initial empty canvas"), F.lit(""))
    replayed = F.concat(F.array(first), F.zip_with(trace(live, "viewer"), live, shown))
    final = F.array(first, state(none, no_words, F.lit(0), F.lit("FINAL"), F.lit("Final response"), F.coalesce(final_text, F.lit(""))))
    out = F.when(F.size(actions) > 0, replayed).otherwise(final)
    if trajectory is not None:
        out = F.when(F.size(trajectory) > 0, F.transform(trajectory, told)).otherwise(out)
    if states is not None:
        kept = F.filter(states, lambda s: s.isNotNull())
        out = F.when(F.size(kept) > 0, F.transform(kept, given)).otherwise(out)
    return F.to_json(out)


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """``name, sha256`` of each row's content; null content is left out."""
    return df.where(F.col(content).isNotNull()).select(name, F.sha2(content, 256).alias("sha256"))


def metric_series(df: DataFrame, group: str, at: str, value: str, most: int) -> DataFrame:
    """The decimated series of a metric per group, NaN and infinite values left out."""
    from loomcanvas.operators.buckets import decimate

    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return decimate(fine.select(group, at, value), group, at, most)


def tokens_per_second(df: DataFrame, group: str, at: str, tokens: str) -> DataFrame:
    """Rate since the row before, per group."""
    w = Window.partitionBy(group).orderBy(at)
    seconds = F.col(at).cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(w)
    return df.select("*", F.round(F.col(tokens) / F.nullif(gap, F.lit(0.0)), 4).alias("per_second"))
