"""Equivalent DuckDB SQL of those queries that SQL can express on whole tables: runs, ranking, decoded texts."""

from __future__ import annotations

def _last(table: str, keys: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at DESC) = 1)"


def _canonical(a: str) -> str:
    """What a text action does, told apart from its spelling: a signed number, inserted letters, or one of two words.

    Written without the operator's rules: marks around an operand are trimmed as a set, a move is read as a number.
    """
    around = "' ()[]{}<>\"''“”‘’«»:=_'"
    low = f"lower(trim({a}, ' []'))"
    after = lambda n: f"trim(substr(trim({a}, ' ['), {n + 1}), {around})"
    number = f"replace({after(4)}, ' ', '')"
    return (
        f"CASE WHEN {low} IN ('stop', 'end_of_response') THEN 'stop' WHEN {low} LIKE 'move%' THEN coalesce('m' || CAST(TRY_CAST(replace({number}, '+', '') AS BIGINT) AS VARCHAR), 'M' || {number})"
        f" WHEN {low} LIKE 'delete%' THEN 'd' || {after(6)} WHEN {low} LIKE 'insert%' THEN 'i' || {after(6)} ELSE 'x' || trim({a}) END"
    )


def _runs() -> str:
    parts = (
        ("rollouts", "action_history", "id", _last("rollouts", "id"), "CAST(unnest(action_history) AS VARCHAR)", "action_ms"),
        ("rollouts_text_actions", "action_history", "id", _last("rollouts_text_actions", "id"), "unnest(action_history)", "action_ms"),
        ("trajectories", "action_ids", "shard_idx || ':' || sample_idx", _last("trajectories", "shard_idx, sample_idx"), "CAST(unnest(action_ids) AS VARCHAR)", "CAST(NULL AS INTEGER[])"),
    )
    each = []
    for table, field, key, source, value, times in parts:
        v = _canonical("v") if table == "rollouts_text_actions" else "v"
        each.append(f"""
          SELECT '{table}' AS table_name, record_key, '{field}' AS field_name, CAST(min(pos) AS INTEGER) AS run_start, CAST(count(*) AS INTEGER) AS run_len, any_value(ms) AS ms FROM (
            SELECT *, pos - row_number() OVER (PARTITION BY record_key, c ORDER BY pos) AS island FROM (
              SELECT record_key, pos, ms, {v} AS c FROM (SELECT {key} AS record_key, unnest(range(len({field}))) AS pos, {value} AS v, {times} AS ms FROM {source} WHERE len({field}) > 0)))
          GROUP BY record_key, c, island""")
    return f"({' UNION ALL '.join(each)})"


def _ranking() -> str:
    """Votes to a matrix of moves, squared 32 times (rows kept at a sum of 1): they are then the stationary distribution."""
    cell = "list_sum(list_transform(range(1, n + 1), lambda x: m[i][x] * m[x][j]))"
    return f"""
      WITH RECURSIVE names AS (SELECT model_name, row_number() OVER (ORDER BY model_name) AS i FROM arena_models),
      raw AS (SELECT trim(split_part(e.key, '>', 1)) AS w, trim(split_part(e.key, '>', 2)) AS l, e.value AS v FROM (SELECT unnest(map_entries(pairwise_wins)) AS e FROM {_last('run_arena', 'pair_id')}) WHERE e.value > 0),
      votes AS (SELECT a.i AS w, b.i AS l, sum(v) AS v FROM raw JOIN names a ON a.model_name = w JOIN names b ON b.model_name = l WHERE w <> l GROUP BY a.i, b.i),
      met AS (SELECT w AS a, l AS b FROM votes UNION SELECT l, w FROM votes),
      moves AS (SELECT met.b AS src, met.a AS dst, coalesce(v, 0) + 0.5 AS q FROM met LEFT JOIN votes ON votes.w = met.a AND votes.l = met.b),
      leaving AS (SELECT src, sum(q) AS q FROM moves GROUP BY src), busiest AS (SELECT max(q) AS q FROM leaving),
      grid AS (SELECT a.i AS i, b.i AS j, CASE WHEN a.i = b.i THEN 1 - coalesce(leaving.q, 0) / busiest.q ELSE coalesce(moves.q, 0) / busiest.q END AS p FROM names a CROSS JOIN names b CROSS JOIN busiest LEFT JOIN moves ON moves.src = a.i AND moves.dst = b.i LEFT JOIN leaving ON leaving.src = a.i),
      matrix AS (SELECT list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT i, list(CAST(p AS DOUBLE) ORDER BY j) AS r FROM grid GROUP BY i)),
      power AS (SELECT 0 AS k, m, n FROM matrix UNION ALL SELECT k + 1, list_transform(list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: {cell})), lambda r: list_transform(r, lambda x: x / list_sum(r))), n FROM power WHERE k < 32),
      rest AS (SELECT unnest(m[1]) AS s, unnest(range(1, n + 1)) AS i FROM power WHERE k = 32)
      SELECT model_name, round(s, 9) AS strength, CAST(row_number() OVER (ORDER BY round(s, 12) DESC, model_name) AS INTEGER) AS rank_no FROM rest JOIN names USING (i)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"SELECT model_name, rank_no FROM ({_ranking()})",
        "p4_ranking": _ranking(),
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p6_found": f"SELECT table_name, record_key, run_start, run_len FROM {_runs()} WHERE run_len > 1",
        "p6_runs": f"SELECT table_name, record_key, field_name, run_start, run_len, CAST(coalesce(ms[run_start + run_len] - CASE WHEN run_start = 0 THEN 0 ELSE ms[run_start] END, run_len) AS BIGINT) AS duration FROM {_runs()}",
    }
