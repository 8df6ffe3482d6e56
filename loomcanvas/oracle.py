"""Equivalent DuckDB SQL of the core queries, over the same tables."""

from __future__ import annotations

ROLLOUTS = "(SELECT * FROM rollouts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
TEXTS = "(SELECT * FROM rollouts_text_actions QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
PATHS = "(SELECT * FROM trajectories QUALIFY row_number() OVER (PARTITION BY shard_idx, sample_idx ORDER BY ingested_at DESC) = 1)"
PAIRS = "(SELECT * FROM run_arena QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC) = 1)"


def insert(t: str) -> str:
    return f"({t} >= 0 AND {t} < 50256)"


def kind(t: str, rule: str = "module") -> str:
    yes = {"module": insert(t), "tokenizer": f"({t} <> 50256 AND NOT ({t} >= 50257 AND {t} < 50281))", "stats": f"({t} < 50257)"}[rule]
    return f"CASE WHEN {yes} THEN 'insert' WHEN {t} BETWEEN 50261 AND 50280 THEN 'move' WHEN {t} = 50259 THEN 'delete' WHEN {t} = 50260 THEN 'end_of_response' ELSE 'other' END"


def amount(t: str) -> str:
    return f"(CASE WHEN {t} BETWEEN 50261 AND 50280 THEN (1 << CAST(({t} - 50261) // 2 AS INTEGER)) * (CASE WHEN ({t} - 50261) % 2 = 0 THEN 1 ELSE -1 END) END)"


def count(a: str, test: str) -> str:
    return f"CAST(len(list_filter({a}, lambda t: {test})) AS BIGINT)"


def text(a: str) -> str:
    return f"coalesce(array_to_string(list_transform({a}, lambda z: CAST(z AS VARCHAR)), ' '), '')"


def words(x: str) -> str:
    return f"list_filter(string_split(translate(lower({x}), chr(10), ' '), ' '), lambda w: w <> '')"


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[\\s\\v\\p{{Z}}]+'), lambda w: w <> '')"


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT)"


def stand_in(x: str) -> str:
    return f"list_transform({words(x)}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50256 AS INTEGER))"


def blank(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[^\\s\\v\\p{{Z}}]') THEN {c} END"


def initial(a: str) -> str:
    return f"CAST(coalesce(list_position(list_transform({a}, lambda t: NOT {insert('t')}), true) - 1, len({a})) AS INTEGER)"


def initial_capped(a: str, cap: int) -> str:
    return f"least({initial(a)}, {cap})"


def _mix(per: str) -> str:
    return f"list_filter({per}, lambda t: t NOT IN (50260, 50258))"


def _fold(dialect: str, source: str, keys: str = "id") -> str:
    """A recursive fold over ``source`` (``keys`` and a list ``a``): the CTE ``run`` with a row per sequence and step."""
    inserts = insert("t") if dialect != "viewer" else "(NOT (t BETWEEN 50261 AND 50280) AND t NOT IN (50258, 50259, 50260))"
    target, size = f"(cursor + {amount('t')})", "len(canvas)"
    outside = f"({target} < 0 OR {target} > {size})"
    off = "cursor" if dialect == "strict" else f"greatest(0, least({size}, {target}))"
    stops = "false" if dialect == "clamp_through" else "t = 50260"
    return f"""
    WITH RECURSIVE src AS (SELECT {keys}, list_transform(a, lambda z: CAST(z AS INTEGER)) AS a FROM ({source})),
    run AS (
      SELECT {keys}, a, 0 AS k, CAST([] AS INTEGER[]) AS canvas, 0 AS cursor, false AS stopped, 0 AS bad FROM src
      UNION ALL
      SELECT {keys}, a, k + 1,
        CASE WHEN t = 50259 AND cursor > 0 THEN list_concat(canvas[1:cursor - 1], canvas[cursor + 1:])
             WHEN t <> 50260 AND {inserts} THEN list_concat(list_concat(canvas[1:cursor], [t]), canvas[cursor + 1:]) ELSE canvas END,
        CAST(CASE WHEN t = 50259 THEN greatest(cursor - 1, 0) WHEN t BETWEEN 50261 AND 50280 THEN (CASE WHEN {outside} THEN {off} ELSE {target} END)
             WHEN t <> 50260 AND {inserts} THEN cursor + 1 ELSE cursor END AS INTEGER),
        {stops},
        bad + CASE WHEN t = 50259 AND cursor = 0 THEN 1 WHEN t BETWEEN 50261 AND 50280 AND {outside} THEN 1 ELSE 0 END
      FROM (SELECT *, a[k + 1] AS t FROM run WHERE NOT stopped AND k < len(a))),
    done AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY k DESC) = 1)"""


HISTORIES = f"SELECT id, action_history AS a FROM {ROLLOUTS} WHERE action_history IS NOT NULL"


def _replay(dialect: str) -> str:
    return f"{_fold(dialect, HISTORIES)} SELECT id, {text('canvas')} AS canvas, cursor, stopped, CAST(bad AS INTEGER) AS n_invalid FROM done"


AMOUNTS = "[" + ", ".join(f"{x * a}" for a in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512) for x in (1, -1)) + "]"


def to_id(x: str) -> str:
    return f"CAST(50261 + 2 * CAST(round(log2(abs({x}))) AS INTEGER) + (CASE WHEN {x} < 0 THEN 1 ELSE 0 END) AS INTEGER)"


def _decode(source: str, budget: str, least: int) -> str:
    """The decoding loop with the hash policy over ``source`` (key, prefix list ``given``): the CTE ``done``."""
    share = f"({draw('7::VARCHAR', 'key', 'k::VARCHAR', chr(39) + 'kind' + chr(39))} / 4294967296.0)"
    token = f"CAST({draw('7::VARCHAR', 'key', 'k::VARCHAR', chr(39) + 'token' + chr(39))} % 50256 AS INTEGER)"
    picked = f"legal[CAST({draw('7::VARCHAR', 'key', 'k::VARCHAR', chr(39) + 'move' + chr(39))} % greatest(len(legal), 1) AS INTEGER) + 1]"
    return f"""
    WITH RECURSIVE src AS ({source}),
    run AS (
      SELECT key, given, 0 AS k, CAST([] AS INTEGER[]) AS canvas, 0 AS cursor, CAST([] AS INTEGER[]) AS actions, false AS stopped FROM src
      UNION ALL
      SELECT key, given, k + 1,
        CASE WHEN t = 50259 AND cursor > 0 THEN list_concat(canvas[1:cursor - 1], canvas[cursor + 1:]) WHEN {insert('t')} THEN list_concat(list_concat(canvas[1:cursor], [t]), canvas[cursor + 1:]) ELSE canvas END,
        CAST(CASE WHEN t = 50259 THEN greatest(cursor - 1, 0) WHEN t BETWEEN 50261 AND 50280 THEN greatest(0, least(len(canvas), cursor + {amount('t')})) WHEN {insert('t')} THEN cursor + 1 ELSE cursor END AS INTEGER),
        list_concat(actions, [t]), t = 50260
      FROM (SELECT *, CAST(CASE WHEN k < len(given) THEN given[k + 1] WHEN r < 0.04 AND k >= {least} THEN 50260 WHEN r < 0.12 AND cursor > 0 THEN 50259 WHEN r < 0.35 AND len(legal) > 0 THEN {to_id('move')} ELSE token END AS INTEGER) AS t
        FROM (SELECT *, {picked} AS move FROM (SELECT *, {share} AS r, {token} AS token, list_filter({AMOUNTS}, lambda m: cursor + m >= 0 AND cursor + m <= len(canvas)) AS legal FROM run WHERE NOT stopped AND k < {budget})))),
    done AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)"""


CURSORS = f"""
    e AS (SELECT id, CAST(unnest(range(len(action_history))) AS INTEGER) AS pos, CAST(unnest(action_history) AS INTEGER) AS token FROM {ROLLOUTS} WHERE len(action_history) > 0),
    s AS (SELECT *, coalesce(max(CAST(token = 50260 AS INTEGER)) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e),
    g AS (SELECT id, pos, token, CASE WHEN {insert('token')} THEN 1 WHEN token = 50259 THEN -1 ELSE 0 END AS grow, coalesce({amount('token')}, 0) AS mv FROM s WHERE ended = 0),
    p AS (SELECT id, pos, token, CAST(sum(grow + mv) OVER w AS INTEGER) AS cursor, CAST(sum(grow) OVER w AS INTEGER) AS size FROM g WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    path AS (SELECT *, min(CAST(cursor >= 0 AND cursor <= size AS INTEGER)) OVER (PARTITION BY id) = 1 AS legal FROM p)"""

LOGITS = "(SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS token_id, round(CAST(unnest(embedding) AS DOUBLE) * 8, 2) AS logit FROM embeddings)"
DIST = [f"{count('action_history', kind('t') + f' = {chr(39)}{k}{chr(39)}')} AS \"{k}\"" for k in ("insert", "move", "delete", "end_of_response", "other")]


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    n = "greatest(sum(n), 1)"
    out["trajectory_stats"] = f"""
      SELECT CAST(count(*) AS BIGINT) AS n_examples, round(sum(n) / greatest(count(*), 1), 4) AS mean_total_actions, round(sum(i) / {n}, 6) AS insert_fraction, round(sum(m) / {n}, 6) AS move_fraction,
        round(sum(x) / {n}, 6) AS delete_fraction, round(sum(dist) / greatest(sum(m), 1), 4) AS mean_abs_move_distance
      FROM (SELECT len(action_history) AS n, {count('action_history', 't < 50257')} AS i, {count('action_history', 't BETWEEN 50261 AND 50280')} AS m, {count('action_history', 't = 50259')} AS x,
        coalesce(list_sum(list_transform(list_filter(action_history, lambda t: t BETWEEN 50261 AND 50280), lambda t: abs({amount('t')}))), 0) AS dist FROM {ROLLOUTS} WHERE action_history IS NOT NULL)"""
    out["text_trajectory_stats"] = f"""
      SELECT CAST(count(*) AS BIGINT) AS n_examples, round(sum(n) / greatest(count(*), 1), 4) AS mean_total_actions, round(sum(i) / {n}, 6) AS insert_fraction, round(sum(m) / {n}, 6) AS move_fraction, round(sum(x) / {n}, 6) AS delete_fraction
      FROM (SELECT len(action_history) AS n, {count('action_history', "starts_with(t, 'INSERT')")} AS i, {count('action_history', "starts_with(t, 'MOVE')")} AS m, {count('action_history', "starts_with(t, 'DELETE')")} AS x FROM {TEXTS} WHERE action_history IS NOT NULL)"""
    out["action_distribution"] = f"SELECT id, {', '.join(DIST)}, CAST(len(action_history) AS BIGINT) AS total FROM {ROLLOUTS} WHERE action_history IS NOT NULL"
    mixed = [f"{count('a', kind('t') + f' = {chr(39)}{k}{chr(39)}')} AS {k}_n" for k in ("insert", "move", "delete")]
    out["action_mix_by_source"] = f"""
      SELECT source, CAST(sum(len(a)) AS BIGINT) AS n_actions, {', '.join(f'CAST(sum({k}_n) AS BIGINT) AS n_{k}' for k in ('insert', 'move', 'delete'))}, {', '.join(f'round(sum({k}_n) / nullif(sum(len(a)), 0), 6) AS {k}_share' for k in ('insert', 'move', 'delete'))}
      FROM (SELECT *, {', '.join(mixed)} FROM (SELECT coalesce(source, 'unknown') AS source, {_mix('action_history')} AS a FROM {ROLLOUTS} WHERE action_history IS NOT NULL)) GROUP BY source"""
    out["action_mix_macro_by_source"] = f"""
      SELECT source, CAST(count(*) AS BIGINT) AS n_examples, {', '.join(f'round(avg({k}_n * 100.0 / len(a)), 6) AS {k}_pct' for k in ('insert', 'move', 'delete'))}
      FROM (SELECT *, {', '.join(mixed)} FROM (SELECT coalesce(source, 'unknown') AS source, {_mix('action_history')} AS a FROM {ROLLOUTS} WHERE action_history IS NOT NULL)) WHERE len(a) > 0 GROUP BY source"""
    ids = f"(SELECT unnest(action_ids) AS t FROM {PATHS})"
    out["id_kinds"] = "SELECT rule, kind, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {kind('t', r)} AS kind FROM {ids}" for r in ("module", "tokenizer", "stats")) + ") GROUP BY rule, kind"
    share = lambda a, b: f"round(sum({a}) / nullif(sum({b}), 0), 6)"
    out["revision_stats"] = f"""
      WITH {CURSORS}, r AS (SELECT *, {insert('token')} AS ins, {amount('token')} AS mv, size - 1 AS before, cursor - 1 AS spot FROM path WHERE legal),
      q AS (SELECT id, count(*) AS n, max_by(size, pos) AS outn, count(*) FILTER (mv IS NOT NULL) AS moves, count(*) FILTER (mv < 0) AS back, count(*) FILTER (ins) AS inserts, count(*) FILTER (ins AND spot = before) AS appends,
        sum(CASE WHEN ins AND before > 0 THEN spot / before END) AS place, count(*) FILTER (ins AND before > 0) AS placed, {', '.join(f'count(*) FILTER (abs(mv) = {x}) AS d{x}' for x in (1, 2, 4, 8))} FROM r GROUP BY id)
      SELECT CAST(count(*) AS BIGINT) AS n_examples, {share('n', 'outn')} AS actions_per_token, {', '.join(f'{share(f"d{x}", "moves")} AS moves_of_{x}' for x in (1, 2, 4, 8))}, {share('back', 'moves')} AS backward_fraction,
        {share('place', 'placed')} AS mean_insert_position, {share('appends', 'inserts')} AS end_append_fraction, round(avg(CASE WHEN back > 0 THEN 1 ELSE 0 END), 6) AS with_backward_move FROM q"""
    out["cursor_path"] = f"WITH {CURSORS} SELECT id, pos, token, cursor, size, legal FROM path"
    parts = "list_concat(list_transform(range(abs(n) // 512), lambda i: 512), list_filter(list_transform([256, 128, 64, 32, 16, 8, 4, 2, 1], lambda p: abs(n) & p), lambda x: x <> 0))"
    moves = f"list_transform({parts}, lambda x: CAST(x * (CASE WHEN n < 0 THEN -1 ELSE 1 END) AS INTEGER))"
    out["move_decomposition"] = f"SELECT n, {text(moves)} AS moves, {text(f'list_transform({moves}, lambda y: {to_id(chr(121))})')} AS ids FROM (SELECT DISTINCT CAST(l_partkey % 2501 - 1250 AS INTEGER) AS n FROM lineitem)"
    out["move_amounts"] = f"SELECT t, CAST({amount('t')} AS INTEGER) AS amount, t AS again FROM (SELECT DISTINCT t FROM {ids}) WHERE t BETWEEN 50261 AND 50280"
    for d in ("clamp", "strict", "viewer"):
        out[f"canvas_replay_{d}"] = _replay(d)
    tokens = stand_in("text")
    out["restoration_roundtrip"] = f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, true AS same, true AS legal FROM (SELECT doc_id, {tokens} AS t FROM documents WHERE text IS NOT NULL)"
    out["training_samples"] = f"""
      SELECT shard_idx, sample_idx, {text('list_concat(list_concat(action_ids[1:4], [50258]), action_ids[5:])')} AS input_ids, {text('list_concat(list_transform(range(len(action_ids[1:4]) + 1), lambda q: -100), action_ids[5:])')} AS labels, CAST(len(action_ids[1:4]) + 1 AS INTEGER) AS prompt_length
      FROM {PATHS} WHERE action_ids IS NOT NULL"""
    fit = lambda x, a: f"CAST(greatest(0, least({x}, len({a}))) AS INTEGER)"
    out["prefix_lengths"] = f"""
      SELECT shard_idx, sample_idx, {initial('action_ids')} AS initial, {fit(f"least(coalesce(prefix_len, {initial_capped('action_ids', 35)}), 35)", 'action_ids')} AS inferred, {fit('coalesce(prefix_len, 16)', 'action_ids')} AS fixed
      FROM {PATHS} WHERE action_ids IS NOT NULL"""
    cut64 = f"(SELECT *, {fit(f'least(coalesce(prefix_len, {initial_capped(chr(97), 35)}), 35)', 'a')} AS p FROM (SELECT *, action_ids[1:64] AS a FROM {PATHS}) WHERE len(a) > 0)"
    shifted, masked = "list_concat([50258], a[1:len(a) - 1])", "list_transform(a, lambda t, i: CASE WHEN i <= p THEN -100 ELSE t END)"
    out["collate_shift_mask"] = f"SELECT shard_idx, sample_idx, {text(shifted)} AS input_ids, {text(masked)} AS labels, p AS prefix_len FROM {cut64}"

    def batch(rows: str, size: int) -> str:
        h = draw("'42'", "'0'", "shard_idx || ':' || sample_idx")
        return f"""(SELECT *, CAST((pos // {size}) * 16 + s AS BIGINT) AS batch_no, CAST(pos % {size} AS INTEGER) AS in_batch FROM (
          SELECT *, row_number() OVER (PARTITION BY bucket, s ORDER BY h, shard_idx, sample_idx) - 1 AS pos FROM (SELECT *, h % 16 AS s FROM (SELECT *, {h} AS h FROM {rows} WHERE bucket IS NOT NULL))))"""

    out["batch_ids"] = f"SELECT shard_idx, sample_idx, bucket, batch_no, in_batch FROM {batch(PATHS, 32)}"
    out["padded_batches"] = f"""
      SELECT shard_idx, sample_idx, b AS batch, CAST(w AS INTEGER) AS width, CAST(len(a) AS INTEGER) AS used, md5({text(f'list_concat({masked}, list_transform(range(w - len(a)), lambda q: -100))')}) AS labels_md5
      FROM (SELECT *, max(len(a)) OVER (PARTITION BY b) AS w FROM (SELECT *, bucket || '/' || batch_no AS b FROM {batch(cut64, 16)}))"""
    out["length_filter"] = f"SELECT shard_idx, sample_idx, CAST(len(action_ids) AS INTEGER) AS n, seq_len FROM {PATHS} WHERE len(action_ids) BETWEEN 32 AND 128"
    out["round_robin_workers"] = "SELECT shard_idx, CAST((row_number() OVER (ORDER BY shard_idx) - 1) % 4 AS INTEGER) AS worker FROM (SELECT DISTINCT shard_idx FROM shard_listing)"
    low = "CAST((n // 5) * 5 AS INTEGER)"
    out["bucket_assign"] = f"""
      SELECT shard_idx, sample_idx, CAST(CASE WHEN n BETWEEN 10 AND 256 THEN (n - 10) // 16 ELSE -1 END AS INTEGER) AS bucket_no, 'len_' || lpad(CAST({low} AS VARCHAR), CAST(greatest(4, len(CAST({low} AS VARCHAR))) AS INTEGER), '0') || '_' || lpad(CAST({low} + 4 AS VARCHAR), CAST(greatest(4, len(CAST({low} + 4 AS VARCHAR))) AS INTEGER), '0') AS name
      FROM (SELECT *, coalesce(len(action_ids), 0) AS n FROM {PATHS})"""
    piece = lambda g: f"TRY_CAST(nullif(regexp_extract(bucket, '^len_(\\d+)_(\\d+)$', {g}), '') AS INTEGER)"
    out["bucket_names"] = f"SELECT DISTINCT bucket, {piece(1)} AS len_start, {piece(2)} AS len_end FROM trajectories"
    out["bucket_overlap"] = "SELECT DISTINCT bucket, len_start, len_end FROM bucket_index WHERE len_end >= 64 AND len_start <= 80"
    out["bucket_index_join"] = f"SELECT i.shard_idx, i.sample_idx, i.bucket, i.len_start, i.len_end, CAST(len(p.action_ids) AS INTEGER) AS n FROM (SELECT DISTINCT * FROM bucket_index) i JOIN {PATHS} p ON i.shard_idx = p.shard_idx AND i.sample_idx = p.sample_idx"
    out["bucket_index_missing"] = "SELECT DISTINCT shard_idx, sample_idx, bucket FROM bucket_index i WHERE NOT EXISTS (SELECT 1 FROM trajectories t WHERE t.shard_idx = i.shard_idx AND t.sample_idx = i.sample_idx)"
    out["shard_semi_join"] = f"""
      SELECT shard_idx, CAST(count(*) AS BIGINT) AS samples FROM {PATHS} WHERE shard_idx IN (SELECT shard_idx FROM shard_listing, (SELECT coalesce(max(CAST(coalesce(done, false) AS INTEGER)), 0) AS m FROM shard_listing) WHERE has_tokens AND has_offsets AND (m = 0 OR done)) GROUP BY shard_idx"""
    out["paired_shards"] = "SELECT shard_idx FROM shard_listing WHERE has_tokens INTERSECT SELECT shard_idx FROM shard_listing WHERE has_offsets"
    out["new_shards"] = "SELECT shard_idx FROM shard_listing EXCEPT SELECT shard_idx FROM shard_listing WHERE done"
    out["shard_counts"] = f"SELECT shard_idx, CAST(count(*) AS BIGINT) AS samples FROM {PATHS} GROUP BY shard_idx"
    shuffled = draw("'42'", "'1'", "shard_idx || ':' || sample_idx")
    out["seeded_shuffle"] = f"SELECT shard_idx, sample_idx, CAST(row_number() OVER (ORDER BY {shuffled}, shard_idx, sample_idx) - 1 AS BIGINT) AS position FROM {PATHS}"
    grams = f"(SELECT coalesce(source, 'unknown') AS source, unnest({words('text')}) AS token FROM documents WHERE text IS NOT NULL)"
    counts = f"(SELECT source, token, CAST(count(*) AS BIGINT) AS n FROM {grams} GROUP BY source, token)"
    out["unigram_counts_by_source"] = f"SELECT * FROM {counts}"
    out["unigram_divergence_by_source"] = f"""
      WITH c AS {counts}, f AS (SELECT min(source) AS first FROM c), q AS (SELECT source, token, n / sum(n) OVER (PARTITION BY source) AS q FROM c), s AS (SELECT DISTINCT source FROM c), v AS (SELECT DISTINCT token FROM c),
      r AS (SELECT token, q AS p FROM q, f WHERE source = first),
      j AS (SELECT q.source, q.token, coalesce(r.p, 0) AS p, q.q FROM q LEFT JOIN r USING (token) UNION ALL SELECT s.source, r.token, r.p, 0 FROM s CROSS JOIN r WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.source = s.source AND q.token = r.token)),
      t AS (SELECT source, sum(CASE WHEN p > 0 THEN 0.5 * p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12)) ELSE 0 END) AS d FROM j GROUP BY source)
      SELECT source, round(d, 6) AS jsd, round(exp(-d), 6) AS proxy FROM t, f WHERE source <> first"""
    answers = f"(SELECT id, coalesce(source, 'unknown') AS source, unnest({words('response')}) AS token FROM {ROLLOUTS} WHERE response IS NOT NULL)"
    out["perplexity_by_source"] = f"""
      WITH w AS {answers}, c AS (SELECT token, count(*) AS n FROM w GROUP BY token), l AS (SELECT token, -ln(n / (SELECT sum(n) FROM c)) AS nll FROM c), e AS (SELECT id, source, avg(nll) AS nll FROM w JOIN l USING (token) GROUP BY id, source)
      SELECT source, round(avg(exp(nll)), 4) AS mean_ppl, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY source"""
    out["source_rows"] = "SELECT coalesce(source, 'unknown') AS source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1"
    half = "1.96 * sqrt(greatest(1e-12, w * (1 - w) / greatest(n_valid, 1)))"
    rates = f"""(SELECT *, wins / greatest(n_valid, 1) AS w FROM (SELECT model_a, model_b, CAST(count(*) AS BIGINT) AS n_examples, CAST(count(*) FILTER (ok) AS BIGINT) AS n_valid, CAST(count(*) FILTER (ok AND length(response_a) > length(response_b)) AS BIGINT) AS wins
      FROM (SELECT *, coalesce(response_a, '') <> '' AND coalesce(response_b, '') <> '' AS ok FROM {PAIRS}) GROUP BY model_a, model_b))"""
    out["arena_win_rates"] = f"SELECT model_a, model_b, n_examples, n_valid, wins, round(w, 4) AS win_rate, round(greatest(0.0, w - {half}), 4) AS low, round(least(1.0, w + {half}), 4) AS high FROM {rates}"
    out["answer_pairs"] = f"""
      WITH per AS (SELECT prompt, source, count(*) AS n FROM {ROLLOUTS} WHERE prompt IS NOT NULL AND source IS NOT NULL GROUP BY prompt, source)
      SELECT a.source AS source_a, b.source AS source_b, CAST(count(*) AS BIGINT) AS prompts, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM per a JOIN per b ON a.prompt = b.prompt AND a.source < b.source GROUP BY 1, 2"""
    w = split_words("response")
    out["top_samples_10pct"] = f"""
      WITH s AS (SELECT id, round(0.7 * (len(list_distinct(w)) / greatest(len(w), 1)) + 0.3 * least(1.0, len(w) / 180.0), 6) AS score FROM (SELECT id, {w} AS w FROM {ROLLOUTS} WHERE coalesce(response, '') <> ''))
      SELECT id, score FROM s ORDER BY score DESC, id LIMIT (SELECT greatest(1, CAST(ceil(count(*) * 0.1) AS BIGINT)) FROM s)"""
    out["prompt_response_pairs"] = f"""
      SELECT id, md5(coalesce({blank('prompt')}, '')) AS prompt_md5, md5(coalesce({blank('response')}, {blank('final_canvas')}, '')) AS response_md5, md5(CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) || chr(10) || coalesce(prompt, '') ELSE coalesce(prompt, '') END) AS chat_md5 FROM {ROLLOUTS}"""
    from loomcanvas.functions.text import REPLACEMENTS

    fixed = "response"
    for points, good in REPLACEMENTS:
        fixed = f"replace({fixed}, {' || '.join(f'chr({p})' for p in points)}, '{good.replace(chr(39), chr(39) * 2)}')"
    out["quote_repair"] = f"SELECT id, md5({fixed}) AS text_md5, {fixed} <> response AS changed FROM {ROLLOUTS} WHERE response IS NOT NULL"
    line = "replace(replace(text, chr(10), '\\n'), chr(13), '\\r')"
    out["text_previews"] = f"""
      SELECT doc_id, md5(CASE WHEN length({line}) > 80 THEN substring({line}, 1, 40) || ' … ' || substring({line}, length({line}) - 39, 40) ELSE {line} END) AS middle_md5,
        md5(CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END) AS head_md5, CAST(len({split_words('text')}) AS INTEGER) AS n_words FROM documents WHERE text IS NOT NULL"""
    out["stand_in_tokens"] = f"SELECT id, {text(stand_in('prompt'))} AS ids FROM {ROLLOUTS} WHERE prompt IS NOT NULL"
    out["text_manifest"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"
    out["top_k_logits"] = f"SELECT * FROM {LOGITS} QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 8"
    out["nucleus_logits"] = f"""
      WITH x AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS w FROM {LOGITS}), p AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM x)
      SELECT vec_id, token_id, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM p) WHERE c <= 0.5"""
    out["greedy_logits"] = f"SELECT vec_id, token_id, logit FROM {LOGITS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) = 1"
    fitting = f"list_transform(list_filter({AMOUNTS}, lambda m: cursor + m >= 0 AND cursor + m <= size), lambda y: {to_id('y')})"
    out["legal_actions"] = f"SELECT cursor, size, {text(fitting)} AS moves, cursor > 0 AS can_delete FROM (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS cursor, CAST(l_quantity AS INTEGER) AS size FROM lineitem) WHERE cursor <= size"
    out["metric_series"] = """
      SELECT event_type, event_id, value FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)) WHERE i % greatest(1, CAST(ceil(n / 500) AS BIGINT)) = 0"""
    out["windowed_loss"] = "SELECT CAST(l_orderkey // 200 AS BIGINT) AS \"window\", round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1"
    mean = "sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)"
    out["dev_eval"] = f"SELECT round({mean}, 6) AS loss, round(exp(least(20.0, {mean})), 6) AS ppl, round(sum(l_tax * l_quantity) / greatest(sum(l_quantity), 1), 6) AS accuracy FROM lineitem"
    out["learning_rate_curve"] = "SELECT step, round(CASE WHEN step < 100 THEN step / 100 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, greatest(0.0, (step - 100) / 900)))) END, 8) AS share FROM (SELECT DISTINCT event_id % 1200 AS step FROM events)"
    out["event_windows"] = "SELECT time_bucket(INTERVAL '1 hour', ts) AS \"start\", event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    out["prompt_clean"] = f"SELECT id, md5(regexp_replace(regexp_replace(coalesce(prompt, ''), '^[\\s\\v]+', ''), '\\n+$', '')) AS prompt_md5 FROM {ROLLOUTS}"
    out["arena_table_rows"] = f"SELECT replace(model_a || ' ' || model_b, '_', '\\_') AS name, printf('%.2f', round(w, 4) * 100) AS rate_pct, printf('%.2f', (1 - round(w, 4)) * 100) AS other_pct FROM {rates} WHERE n_valid > 0"
    out["event_rates"] = "SELECT event_id, round(value / nullif(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts), 0), 4) AS per_second FROM events"
    dot = lambda i: f"exp(list_inner_product(e[{i} * n + 1:{i + 1} * n], e[1:n]))"
    out["canvas_pooling"] = f"""
      SELECT vec_id, pos, round((e[pos + 1] * w0 + e[n + pos + 1] * w1 + e[2 * n + pos + 1] * w2) / (w0 + w1 + w2), 5) + 0.0 AS x
      FROM (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS pos FROM (SELECT *, {dot(0)} AS w0, {dot(1)} AS w1, {dot(2)} AS w2 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) // 4 AS n FROM embeddings)))"""
    d, ff = "CAST(size_m AS BIGINT)", "CAST(size_m * 4 AS BIGINT)"
    out["compute_costs"] = f"SELECT model_name, (12 * (12 * 128 * {d} * {d} + 2 * 128 * 128 * {d} + 4 * 128 * {d} * {ff}) + 128 * {d} * 50291) * 256 AS decode_macs, 50291 * {d} + 12 * (4 * {d} * {d} + 2 * {d} + 2 * {d} * {ff} + {ff} + {d}) + {d} + 2 * {d} AS parameters FROM arena_models"
    return out | _more(out)


def _more(out: dict[str, str]) -> dict[str, str]:
    kinds = ("insert", "move", "delete", "end_of_response", "other")
    counted = {k: count("action_history", kind("t") + f" = '{k}'") for k in kinds}
    tenth = lambda x: f"printf('%.1f', round({x} + 1e-9, 1))"
    more: dict[str, str] = {}
    more["action_percentages"] = "SELECT id, " + " || ' ' || ".join(f"'{k}=' || {tenth(f'{c} * 100.0 / len(action_history)')} || '%'" for k, c in counted.items()) + f" AS text FROM {ROLLOUTS} WHERE len(action_history) > 0"
    more["action_counts_json"] = "SELECT id, '{' || " + " || ',' || ".join(f"'\"{k}\":' || {c}" for k, c in counted.items()) + f" || ',\"total\":' || len(action_history) || '}}' AS counts FROM {ROLLOUTS} WHERE action_history IS NOT NULL"
    shown = f"CASE WHEN t = 50259 THEN 'DELETE' WHEN t = 50260 THEN '[END_OF_RESPONSE]' WHEN t = 50258 THEN '[END_OF_INPUT]' WHEN t = 50257 THEN '[CURSOR]' WHEN t BETWEEN 50261 AND 50280 THEN printf('[MOVE %+d]', {amount('t')}) ELSE 'INSERT ' || t END"
    more["action_texts"] = f"SELECT t, {shown} AS text FROM (SELECT DISTINCT unnest(action_ids) AS t FROM trajectories) WHERE t IS NOT NULL"
    more["vocabulary_checks"] = f"SELECT shard_idx, CAST(sum(len(list_filter(action_ids, lambda t: t < 0 OR t >= 50291))) AS BIGINT) AS outside, CAST(max(CASE WHEN len(action_ids) > 0 THEN greatest(0, least(50290, list_max(action_ids))) END) AS INTEGER) AS largest FROM {PATHS} GROUP BY shard_idx"
    bad = f"(t IN (50256, 50257, 50258) OR t BETWEEN 50281 AND 50290 OR t = 50259 AND cursor = 0 OR coalesce(cursor + {amount('t')} > size OR cursor + {amount('t')} < 0, false))"
    more["label_legality"] = f"""
      WITH RECURSIVE run AS (
        SELECT id, action_history AS a, 0 AS k, 0 AS cursor, 0 AS size, 0 AS ignored FROM {ROLLOUTS} WHERE len(action_history) > 0
        UNION ALL
        SELECT id, a, k + 1, CAST(CASE WHEN t = 50259 THEN greatest(cursor - 1, 0) WHEN t BETWEEN 50261 AND 50280 THEN greatest(0, least(size, cursor + {amount('t')})) WHEN {insert('t')} THEN cursor + 1 ELSE cursor END AS INTEGER),
          CAST(CASE WHEN t = 50259 AND cursor > 0 THEN size - 1 WHEN {insert('t')} THEN size + 1 ELSE size END AS INTEGER), ignored + CAST({bad} AS INTEGER)
        FROM (SELECT *, a[k + 1] AS t FROM run WHERE k < len(a)))
      SELECT id, CAST(len(a) AS INTEGER) AS n, CAST(ignored AS INTEGER) AS ignored FROM run WHERE k = len(a)"""
    done = f"SELECT id, len(action_history) AS n, action_history[1:len(action_history) - 1] AS a FROM {ROLLOUTS} WHERE len(action_history) > 0"
    row = "list_concat(list_concat(canvas[1:cursor], [50257]), canvas[cursor + 1:])"
    more["canvas_rows"] = f"{_fold('clamp_through', done, 'id, n')} SELECT id, CAST(n AS INTEGER) AS n_rows, {text(f'{row}[greatest(len(canvas) - 30, 1):]')} AS last_row FROM done"
    paths = f"SELECT shard_idx, sample_idx, action_ids AS a FROM {PATHS} WHERE action_ids IS NOT NULL"
    more["canvas_replay_long"] = f"{_fold('clamp', paths, 'shard_idx, sample_idx')} SELECT shard_idx, sample_idx, md5({text('canvas')}) AS canvas_md5, CAST(len(canvas) AS INTEGER) AS size, cursor, stopped, CAST(bad AS INTEGER) AS n_invalid FROM done"
    more["stream_session_replay"] = f"{_fold('clamp', HISTORIES)} SELECT id AS session, CAST(k - 1 AS BIGINT) AS step, {text('canvas')} AS canvas, cursor FROM run WHERE k > 0"
    words_of = lambda part: f"array_to_string(list_transform({part}, lambda z: CAST(z AS VARCHAR)), ' ')"
    more["cursor_texts"] = f"{_fold('clamp', HISTORIES)} SELECT id, coalesce({words_of('canvas[1:cursor]')}, '') || '[CURSOR]' || coalesce({words_of('canvas[cursor + 1:]')}, '') AS line FROM done"
    more["replay_agreement_by_source"] = f"""
      SELECT coalesce(r.source, 'unknown') AS source, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(c.canvas = s.canvas AS INTEGER)), 6) AS exact
      FROM ({_replay('clamp')}) c JOIN ({_replay('strict')}) s USING (id) JOIN {ROLLOUTS} r USING (id) GROUP BY 1"""
    more["viewer_prefix_targets"] = f"""
      SELECT id, CAST(states AS INTEGER) AS states, CAST(least(greatest(coalesce(prefix_len, 5), 0), states - 1) AS INTEGER) AS target
      FROM (SELECT id, prefix_len, CASE WHEN len(action_history) > 0 THEN coalesce(nullif(list_position(action_history, 50260), 0), len(action_history)) + 1 ELSE 2 END AS states FROM {ROLLOUTS})"""
    drawn = draw("'7'", "doc_id::VARCHAR", "'prefix'")
    more["user_prefixes"] = f"SELECT doc_id, n, CAST(CASE WHEN n < 5 THEN 0 ELSE 1 + {drawn} % (CASE WHEN n < 10 THEN least(3, n) ELSE least(7, n) END) END AS INTEGER) AS given FROM (SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL)"
    more["decode_with_policy"] = f"{_decode('SELECT model_name AS key, CAST([] AS INTEGER[]) AS given FROM arena_models', '64', 8)} SELECT key AS model_name, {text('canvas')} AS canvas, cursor, {text('actions')} AS actions FROM done"
    titles = f"SELECT key, ids[1:CAST(CASE WHEN n < 5 THEN 0 ELSE 1 + {draw(chr(39) + '7' + chr(39), 'key', chr(39) + 'prefix' + chr(39))} % (CASE WHEN n < 10 THEN least(3, n) ELSE least(7, n) END) END AS INTEGER)] AS given FROM (SELECT *, len(ids) AS n FROM (SELECT p_partkey::VARCHAR AS key, {stand_in('p_name')} AS ids FROM part))"
    more["inference_test"] = f"{_decode(titles, 'len(given) + 24', 0)} SELECT key, CAST(len(given) AS INTEGER) AS prefix_len, {text('canvas')} AS canvas, cursor, {text('actions')} AS actions, canvas = ids AS exact FROM done JOIN (SELECT p_partkey::VARCHAR AS key, {stand_in('p_name')} AS ids FROM part) USING (key)"
    more["batch_order"] = f"SELECT bucket, batch_no, CAST(row_number() OVER (ORDER BY {draw(chr(39) + '42' + chr(39), chr(39) + '0' + chr(39), 'bucket || chr(58) || batch_no')}, bucket, batch_no) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT bucket, batch_no FROM ({out['batch_ids']}))"
    more["greedy_packing"] = f"""
      WITH RECURSIVE items AS (SELECT shard_idx || ':' || sample_idx AS key, CAST(len(action_ids) AS INTEGER) AS len FROM {PATHS} WHERE len(action_ids) > 0),
      h AS (SELECT *, row_number() OVER (ORDER BY len) AS i FROM (SELECT len, count(*) AS n FROM items GROUP BY len)),
      plan AS (
        SELECT CAST(0 AS BIGINT) AS i, 0 AS len, CAST(0 AS BIGINT) AS first_batch, CAST(0 AS BIGINT) AS room, CAST(1 AS BIGINT) AS most, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS held
        UNION ALL
        SELECT i, len, batch, room, most, CAST(CASE WHEN n <= room THEN batch ELSE batch + (n - room + most - 1) // most END AS BIGINT), CAST(CASE WHEN n <= room THEN held + n ELSE (n - room - 1) % most + 1 END AS BIGINT)
        FROM (SELECT h.i, h.len, h.n, p.batch, p.held, CAST(greatest(1, 4096 // h.len) AS BIGINT) AS most, CAST(CASE WHEN p.held = 0 THEN greatest(1, 4096 // h.len) ELSE greatest(0, 4096 // h.len - p.held) END AS BIGINT) AS room FROM plan p JOIN h ON h.i = p.i + 1))
      SELECT 'all' AS slice, key, len, CAST(CASE WHEN r < room THEN first_batch ELSE first_batch + 1 + (r - room) // most END AS INTEGER) AS batch_no
      FROM (SELECT *, row_number() OVER (PARTITION BY len ORDER BY key) - 1 AS r FROM items) JOIN plan USING (len) WHERE i > 0"""
    cells = lambda n, test: f"coalesce(array_to_string(list_transform(range(1, {n} + 1), lambda j: CAST(CAST({test} AS INTEGER) AS VARCHAR)), ''), '')"
    grid = lambda n, m: f"coalesce(array_to_string(list_transform(range(1, {n} + 1), lambda i: {cells(m, 'j <= i')}), ' '), '')"
    more["attention_masks"] = f"SELECT n, most, {grid('n', 'n')} AS causal, {grid('n', 'most')} AS crossed, {cells('most', 'j <= n')} AS padding FROM (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS n, CAST(l_quantity % 8 AS INTEGER) AS most FROM lineitem)"
    more["buffered_shuffle"] = f"""
      SELECT event_id, buffer_no, CAST(row_number() OVER (PARTITION BY buffer_no ORDER BY {draw(chr(39) + '42' + chr(39), 'event_id::VARCHAR')}, event_id) - 1 AS INTEGER) AS in_buffer
      FROM (SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 1000 AS BIGINT) AS buffer_no FROM events)"""
    b, h = draw("'42'", "'1'", "bucket"), draw("'42'", "'1'", "bucket || ':' || shard_idx || ':' || sample_idx")
    more["seeded_index_scan"] = f"""
      SELECT bucket, shard_idx, sample_idx, CAST(row_number() OVER (ORDER BY {b}, bucket, {h}, shard_idx, sample_idx) - 1 AS BIGINT) AS position
      FROM (SELECT DISTINCT i.bucket, i.shard_idx, i.sample_idx FROM bucket_index i JOIN trajectories t ON i.shard_idx = t.shard_idx AND i.sample_idx = t.sample_idx WHERE i.len_end >= 32 AND i.len_start <= 128)"""
    more["sample_prefixes"] = f"SELECT b.shard_idx, b.sample_idx, prefix_len FROM (SELECT DISTINCT shard_idx, sample_idx FROM bucket_index) b LEFT JOIN {PATHS} p ON b.shard_idx = p.shard_idx AND b.sample_idx = p.sample_idx"
    more["random_access"] = "SELECT doc_id, md5(text) AS text_md5, CAST(doc_id // 50 AS BIGINT) AS file_no, CAST(doc_id % 50 AS INTEGER) AS in_file FROM documents WHERE doc_id = 123"
    more["eval_batch_estimate"] = f"SELECT shard_idx, CAST(greatest(1, ceil(samples / 32)) AS BIGINT) AS batches, CAST(20 AS INTEGER) AS at_most_20 FROM ({out['shard_counts']})"
    more["stream_new_shards"] = out["shard_counts"]
    more["stream_bucket_batches"] = "SELECT bucket, CAST(n // 16 AS BIGINT) AS batches, CAST(n // 16 * 16 AS BIGINT) AS samples FROM (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT bucket, shard_idx, sample_idx FROM bucket_index WHERE bucket IS NOT NULL) GROUP BY bucket) WHERE n >= 16"
    more["stream_token_triggers"] = f"SELECT run, CAST(n // 5000 AS BIGINT) AS triggers, CAST(n // 5000 * 5000 AS BIGINT) AS last FROM (SELECT coalesce(source, 'unknown') AS run, sum(coalesce(len(action_history), 0)) AS n FROM {ROLLOUTS} GROUP BY 1) WHERE n >= 5000"
    more["continuation_perplexity"] = f"""
      WITH r AS (SELECT id, coalesce(source, 'unknown') AS source, coalesce({words('prompt')}, []) AS p, coalesce({words('response')}, []) AS a FROM {ROLLOUTS}),
      w AS (SELECT id, source, len(p) AS np, unnest(list_concat(p, a)) AS token, unnest(range(len(p) + len(a))) AS pos FROM r),
      s AS (SELECT *, lag(token) OVER (PARTITION BY id ORDER BY pos) AS before FROM w),
      b AS (SELECT before, token, count(*) AS n FROM s GROUP BY before, token), f AS (SELECT before, sum(n) AS of FROM b GROUP BY before), v AS (SELECT count(DISTINCT token) AS size FROM s),
      e AS (SELECT s.id, avg(-ln((b.n + 1) / (f.of + v.size))) AS nll FROM s JOIN b ON s.before IS NOT DISTINCT FROM b.before AND s.token = b.token JOIN f ON s.before IS NOT DISTINCT FROM f.before, v WHERE s.pos >= s.np GROUP BY s.id)
      SELECT source, round(avg(nll), 5) AS mean_nll, CAST(count(nll) AS BIGINT) AS n, CAST(count(*) - count(nll) AS BIGINT) AS empty FROM r LEFT JOIN e USING (id) GROUP BY source"""
    per = f"(SELECT prompt, source, min(id) AS k FROM {ROLLOUTS} WHERE prompt IS NOT NULL AND source IS NOT NULL GROUP BY prompt, source)"
    more["answer_pair_rows"] = f"SELECT md5(a.prompt) AS prompt_md5, a.source AS source_a, b.source AS source_b, a.k AS key_a, b.k AS key_b FROM {per} a JOIN {per} b ON a.prompt = b.prompt AND a.source < b.source"
    escaped = "replace(source, '_', '\\_')"
    more["paper_tables"] = f"""
      SELECT 'arena' AS section, name, rate_pct AS first, other_pct AS second FROM ({out['arena_table_rows']})
      UNION ALL SELECT 'evalppl', {escaped}, printf('%.4f', mean_ppl), NULL FROM ({out['perplexity_by_source']})
      UNION ALL SELECT 'mauve', {escaped}, printf('%.4f', round(proxy + 1e-9, 4)), printf('%.4f', round(jsd + 1e-9, 4)) FROM ({out['unigram_divergence_by_source']})"""
    one = "'{\"family\":\"' || family || '\",\"size_m\":' || size_m || '}'"
    more["json_without_key"] = f"SELECT model_name, '{{\"rows\":[' || {one} || ',' || {one} || '],\"one\":' || {one} || '}}' AS payload FROM arena_models"
    step = lambda what: draw("'123'", "key", "'0'", "k::VARCHAR", f"'{what}'")
    walk = lambda ids, more="": f"""
      WITH RECURSIVE run(doc_id, key, ids, k, canvas, c, inverse) USING KEY (doc_id) AS (
        SELECT doc_id, doc_id::VARCHAR, ids, 0, {ids}, 0, CAST([] AS INTEGER[]) FROM (SELECT doc_id, {stand_in('text')} AS ids FROM documents WHERE text IS NOT NULL)
        UNION
        SELECT doc_id, key, ids, k + 1, CASE WHEN del THEN list_concat(canvas[1:c - 1], canvas[c + 1:]) ELSE canvas END, CAST(CASE WHEN del THEN c - 1 ELSE c + move END AS INTEGER), list_append(inverse, CASE WHEN del THEN canvas[c] ELSE {to_id('(-move)')} END)
        FROM (SELECT *, legal[CAST({step('move')} % greatest(len(legal), 1) AS INTEGER) + 1] AS move
          FROM (SELECT *, c > 0 AND {step('action')} / 4294967296.0 < 0.8 AS del, list_filter({AMOUNTS}, lambda m: c + m >= 0 AND c + m <= len(canvas)) AS legal FROM run WHERE len(canvas) > 0 AND k < greatest(1000, 16 * len(ids))))){more}"""  # noqa: E731
    more["restoration_trajectories"] = f"{walk('ids')} SELECT doc_id, trim({text('list_reverse(inverse)')} || ' 50260') AS actions, CAST(len(inverse) AS INTEGER) AS n_steps FROM run WHERE len(canvas) = 0"
    sizes = "[" + ", ".join(str(1 << i) for i in range(10)) + "]"
    off = f"list_transform({sizes}, lambda a: abs(a - place))"
    ends = f""",
      ended AS (SELECT doc_id, ids[1:8] AS prompt, ids[9:] AS told, inverse, CASE WHEN len(ids) > 8 THEN {draw("'123'", 'key', "'final'")} % (len(ids) - 7) ELSE 0 END AS place FROM run WHERE len(canvas) = 0),
      near AS (SELECT *, CASE WHEN place > 0 THEN list_position({off}, list_min({off})) END AS nth FROM ended),
      acted AS (SELECT *, list_concat(list_concat(list_reverse(inverse), CASE WHEN nth IS NULL THEN [] ELSE [CAST(50261 + 2 * (nth - 1) AS INTEGER)] END), [50260]) AS actions, CASE WHEN nth IS NULL THEN 0 ELSE CAST(least({sizes}[nth], len(told)) AS INTEGER) END AS spot FROM near),
      shown AS (SELECT *, list_concat(list_concat(told[1:spot], [50257]), told[spot + 1:]) AS canvas FROM acted)"""
    labels = "list_concat(list_transform(range(len(prompt) + 1), lambda q: CAST(-100 AS INTEGER)), actions)"
    more["synthetic_samples"] = f"{walk('ids[9:]', ends)} SELECT doc_id, md5({text('list_concat(list_concat(prompt, [50258]), actions)')}) AS input_md5, md5({text(labels)}) AS labels_md5, CAST(len(prompt) + 1 AS INTEGER) AS prompt_length, CAST(len(actions) AS INTEGER) AS n_canvas, {text('canvas[greatest(len(canvas) - 31, 1):]')} AS last_canvas FROM shown"
    more["timing_means"] = f"""
      SELECT source, CAST(i // 16 AS INTEGER) AS "window", CAST(count(ms) AS BIGINT) AS steps, round(avg(ms), 4) AS mean_ms
      FROM (SELECT source, i, took - CASE WHEN i = 0 THEN 0 ELSE lag(took) OVER (PARTITION BY id ORDER BY i) END AS ms FROM (SELECT id, coalesce(source, 'unknown') AS source, unnest(action_ms) AS took, unnest(range(len(action_ms))) AS i FROM {ROLLOUTS})) GROUP BY 1, 2"""
    more["utc_stamps"] = f"SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(epoch(created_at)) AS BIGINT) AS unix FROM {ROLLOUTS} WHERE created_at IS NOT NULL"
    in_index = "SELECT DISTINCT shard_idx, sample_idx FROM bucket_index WHERE len_end >= 64 AND len_start <= 80"
    order = draw("'42'", "shard_idx || ':' || sample_idx")
    more["random_sample"] = f"""
      SELECT shard_idx, sample_idx, {text('CASE WHEN action_ids[-1] = 50260 THEN action_ids[1:len(action_ids) - 1] ELSE action_ids END')} AS ids
      FROM (SELECT *, (shard_idx, sample_idx) IN (SELECT (shard_idx, sample_idx) FROM ({in_index})) AS known FROM {PATHS} WHERE len(action_ids) BETWEEN 64 AND 80) ORDER BY known DESC, {order}, shard_idx, sample_idx LIMIT 1"""
    d5 = lambda what: draw("'5'", "key", "k::VARCHAR", f"'{what}'")
    span, n = "canvas[c - z + 1:c]", "len(canvas)"
    state = lambda tokens, cursor, action, detail, line: f"{{'tokens': {tokens}, 'token_strings': list_transform({tokens}, lambda z: CAST(z AS VARCHAR)), 'cursor': CAST({cursor} AS INTEGER), 'action': {action}, 'action_detail': {detail}, 'text': {line}}}"
    first = state("CAST([] AS INTEGER[])", "0", "'START'", "'Initial empty canvas'", "''")
    final = state("CAST([] AS INTEGER[])", "0", "'FINAL'", "'Final response'", "coalesce(final_canvas, response, '')")
    one = state("canvas", "cursor", f"upper({kind('t', 'tokenizer')})", shown, text("canvas"))
    more["viewer_states"] = f"""{_fold('viewer', f'SELECT id, action_history AS a FROM {ROLLOUTS} WHERE len(action_history) > 0')},
      told AS (SELECT id, list({one} ORDER BY k) AS steps FROM (SELECT *, a[k] AS t FROM run WHERE k > 0) GROUP BY id)
      SELECT id, CAST(to_json(CASE WHEN steps IS NULL THEN [{first}, {final}] ELSE list_concat([{first}], steps) END) AS VARCHAR) AS states FROM {ROLLOUTS} LEFT JOIN told USING (id)"""
    more["extended_edits"] = f"""
      WITH RECURSIVE src AS (SELECT p_partkey, p_partkey::VARCHAR AS key, {stand_in('p_name')} AS ids FROM part),
      run AS (
        SELECT p_partkey, key, 0 AS k, ids AS canvas, CAST(len(ids) AS INTEGER) AS c, 0 AS bad FROM src
        UNION ALL
        SELECT p_partkey, key, k + 1,
          CASE WHEN NOT ok THEN canvas WHEN op = 0 THEN list_concat(list_concat(canvas[1:c - 1], [x]), canvas[c + 1:]) WHEN op = 1 THEN list_concat(canvas[1:c - z], canvas[c + 1:])
            WHEN op = 2 THEN list_concat(list_concat(canvas[1:c - 2], [canvas[c], canvas[c - 1]]), canvas[c + 1:])
            WHEN op = 3 AND j < c THEN list_concat(list_concat(canvas[1:j], {span}), list_concat(canvas[j + 1:c - z], canvas[c + 1:]))
            WHEN op = 3 THEN list_concat(list_concat(canvas[1:c - z], canvas[c + 1:j]), list_concat({span}, canvas[j + 1:]))
            WHEN op = 4 THEN list_concat(list_concat(canvas[1:j], {span}), canvas[j + 1:]) ELSE canvas END,
          CAST(CASE WHEN NOT ok THEN c WHEN op = 1 THEN c - z WHEN op = 3 AND j >= c THEN j WHEN op = 4 THEN j + z WHEN op = 5 THEN c + z ELSE c END AS INTEGER), bad + CASE WHEN ok THEN 0 ELSE 1 END
        FROM (SELECT *, CASE op WHEN 0 THEN c > 0 WHEN 1 THEN z BETWEEN 1 AND c WHEN 2 THEN c > 1 WHEN 3 THEN z BETWEEN 1 AND c AND (j BETWEEN 1 AND c - z OR j BETWEEN c AND {n}) WHEN 4 THEN z BETWEEN 1 AND c AND j <= {n} ELSE c + z BETWEEN 0 AND {n} END AS ok
          FROM (SELECT *, {d5('op')} % 6 AS op, CAST({d5('token')} % 50256 AS INTEGER) AS x, {d5('k')} % 4 - 1 AS z, {d5('j')} % 8 AS j FROM run WHERE k < 8)))
      SELECT p_partkey, {text('canvas')} AS canvas, c AS cursor, CAST(bad AS INTEGER) AS n_invalid FROM run WHERE k = 8"""
    ids_of = lambda low, high: text(f"range({low}, {high})")
    more["id_lists"] = f"SELECT 'reserved' AS name, {ids_of(50281, 50291)} AS ids UNION ALL SELECT 'move', {ids_of(50261, 50281)} UNION ALL SELECT 'control', '50259 ' || {ids_of(50261, 50281)}"
    whole = f"list_transform(list_filter({words('text')}, lambda w: regexp_full_match(w, '[+-]?[0-9]{{1,9}}')), lambda w: CAST(w AS BIGINT))"
    more["integers_in_texts"] = f"SELECT doc_id, CAST(len(v) AS INTEGER) AS n, CAST(coalesce(list_sum(v), 0) AS BIGINT) AS total FROM (SELECT doc_id, {whole} AS v FROM documents WHERE text IS NOT NULL)"
    return more
