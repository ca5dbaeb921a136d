"""The grid world in SQL: what the world queries are checked against."""

from __future__ import annotations

_KINDS = "('MOVE', 'COLLECT', 'REST', 'DEPOSIT', 'WAIT')"
_NO_MAP = "MAP {}::MAP(VARCHAR, INTEGER)"

#: Scenarios by record: world, state and goal are the three lines of JSON of its first delivery's question.
SCENES = f"""
sq AS (SELECT id, arg_min(q, row_ord) AS q FROM (SELECT id, row_ord, list_filter(messages, lambda m: m.role = 'user')[1].content AS q FROM sft_records) WHERE contains(q, '"locations"') GROUP BY id),
sj AS (SELECT id, TRY_CAST(l[1] AS JSON) AS w, TRY_CAST(l[2] AS JSON) AS s, TRY_CAST(l[3] AS JSON) AS g FROM (SELECT id, regexp_extract_all(q, '(\\{{[^\\n]*\\}})', 1) AS l FROM sq)),
scene AS (SELECT id AS source_record_id, CAST(w->'$.edges' AS VARCHAR[][]) AS edges, json_transform(w->'$.resources', '[{{"resource_id":"VARCHAR","location_id":"VARCHAR","collect_cost":"INTEGER"}}]') AS goods,
 coalesce((w->>'$.move_cost')::INT, 1) AS move_cost, coalesce((w->>'$.rest_gain')::INT, 2) AS rest_gain, coalesce((w->>'$.max_energy')::INT, 10) AS max_energy, coalesce((w->>'$.inventory_capacity')::INT, 3) AS capacity, (w->>'$.deposit_location') AS depot,
 (s->>'$.location') AS loc, (s->>'$.energy')::INT AS en, coalesce(CAST(s->'$.inventory' AS MAP(VARCHAR, INTEGER)), {_NO_MAP}) AS inv, coalesce(CAST(s->'$.deposited' AS MAP(VARCHAR, INTEGER)), {_NO_MAP}) AS dep,
 (g->>'$.kind') AS kind, (g->>'$.location') AS goal_loc, coalesce(CAST(g->'$.resources' AS MAP(VARCHAR, INTEGER)), {_NO_MAP}) AS want, coalesce((g->>'$.step_limit')::INT, 12) AS step_limit
 FROM sj WHERE (w->'$.locations') IS NOT NULL AND (s->'$.location') IS NOT NULL AND (g->'$.kind') IS NOT NULL)"""


def _count(m: str, key: str) -> str:
    return f"coalesce({m}[{key}], 0)"


def _plus(m: str, key: str, by: str) -> str:
    return f"map_from_entries(list_concat(list_filter(map_entries({m}), lambda e: e.key <> {key}), CASE WHEN {_count(m, key)} + {by} > 0 THEN [{{'key': {key}, 'value': ({_count(m, key)} + {by})::INTEGER}}] ELSE [] END))"


def _reason(kind: str, target: str, resource: str) -> str:
    rule = f"list_filter(goods, lambda r: r.resource_id = {resource} AND r.location_id = loc)"
    return f"""CASE {kind}
 WHEN 'MOVE' THEN CASE WHEN coalesce({target}, '') = '' THEN 'illegal_bad_arguments' WHEN len(list_filter(edges, lambda e: (e[1] = loc AND e[2] = {target}) OR (e[2] = loc AND e[1] = {target}))) = 0 THEN 'illegal_not_adjacent' WHEN en < move_cost THEN 'illegal_insufficient_energy' ELSE 'legal' END
 WHEN 'COLLECT' THEN CASE WHEN coalesce({resource}, '') = '' THEN 'illegal_bad_arguments' WHEN len({rule}) = 0 THEN 'illegal_resource_absent' WHEN coalesce(list_sum(map_values(inv)), 0) >= capacity THEN 'illegal_inventory_full' WHEN en < coalesce(({rule})[1].collect_cost, 0) THEN 'illegal_insufficient_energy' ELSE 'legal' END
 WHEN 'DEPOSIT' THEN CASE WHEN coalesce({resource}, '') = '' THEN 'illegal_bad_arguments' WHEN depot IS DISTINCT FROM loc THEN 'illegal_not_at_deposit' WHEN {_count('inv', resource)} <= 0 THEN 'illegal_nothing_to_deposit' ELSE 'legal' END
 WHEN 'REST' THEN 'legal' WHEN 'WAIT' THEN 'legal' ELSE 'illegal_unknown_action' END"""


def _met(have: str) -> str:
    return f"len(list_filter(map_entries(want), lambda e: coalesce({have}[e.key], 0) < e.value)) = 0"


_SATISFIED = f"CASE kind WHEN 'reach_location' THEN goal_loc IS NOT DISTINCT FROM loc WHEN 'collect_resources' THEN {_met('inv')} WHEN 'deposit_resources' THEN {_met('dep')} ELSE false END"
_ELEMENT = f"""CASE WHEN json_type(e) <> 'OBJECT' THEN 'action_not_object' WHEN coalesce(json_type(e, '$.type'), '') <> 'VARCHAR' OR (e->>'$.type') NOT IN {_KINDS} THEN 'unknown_action_type'
 WHEN len(list_filter(json_keys(e), lambda k: k NOT IN ('type', 'target', 'resource'))) > 0 OR coalesce(json_type(e, '$.target'), 'NULL') NOT IN ('VARCHAR', 'NULL') OR coalesce(json_type(e, '$.resource'), 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'action_schema_invalid' END"""

#: Candidates of such records: their parsed plan, every legal step of it up to the first illegal one, and where the episode ends.
EPISODES = f"""{SCENES},
span AS (SELECT c.row_ord, c.model_id, c.completion_tokens, c.text, s.*, CASE WHEN json_valid(regexp_extract(c.text, '(?s)\\{{.*\\}}')) THEN regexp_extract(c.text, '(?s)\\{{.*\\}}')::JSON END AS j FROM candidates c JOIN scene s ON c.source_record_id = s.source_record_id),
els AS (SELECT *, CASE WHEN json_type(j, '$.actions') = 'ARRAY' THEN CAST(j->'$.actions' AS JSON[]) END AS el FROM span),
parsed AS (SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'malformed_json' WHEN coalesce(len(el), 0) = 0 THEN 'missing_actions_field' ELSE coalesce(list_filter(list_transform(el, lambda e: {_ELEMENT}), lambda x: x IS NOT NULL)[1], 'ok') END AS reason,
 coalesce(json_type(j, '$.final_state'), 'NULL') AS claim FROM els),
plan AS (SELECT *, CASE WHEN reason = 'ok' THEN list_transform(el, lambda e: {{'type': (e->>'$.type'), 'target': (e->>'$.target'), 'resource': (e->>'$.resource')}}) END AS actions FROM parsed),
walk AS (SELECT row_ord, 0::BIGINT AS k, 'legal' AS why, loc, en, inv, dep, false AS ok, edges, goods, move_cost, rest_gain, max_energy, capacity, depot, kind, goal_loc, want, actions FROM plan WHERE actions IS NOT NULL
 UNION ALL SELECT row_ord, k, why, loc, en, inv, dep, why = 'legal' AND {_SATISFIED}, edges, goods, move_cost, rest_gain, max_energy, capacity, depot, kind, goal_loc, want, actions FROM (
 SELECT row_ord, k + 1 AS k, r AS why, CASE WHEN r = 'legal' AND a.type = 'MOVE' THEN a.target ELSE loc END AS loc,
 CASE WHEN r <> 'legal' THEN en WHEN a.type = 'MOVE' THEN en - move_cost WHEN a.type = 'COLLECT' THEN en - coalesce(list_filter(goods, lambda g: g.resource_id = a.resource AND g.location_id = loc)[1].collect_cost, 0) WHEN a.type = 'REST' THEN least(en + rest_gain, max_energy) ELSE en END AS en,
 CASE WHEN r = 'legal' AND a.type = 'COLLECT' THEN {_plus('inv', 'a.resource', '1')} WHEN r = 'legal' AND a.type = 'DEPOSIT' THEN {_plus('inv', 'a.resource', '-1')} ELSE inv END AS inv, CASE WHEN r = 'legal' AND a.type = 'DEPOSIT' THEN {_plus('dep', 'a.resource', '1')} ELSE dep END AS dep,
 edges, goods, move_cost, rest_gain, max_energy, capacity, depot, kind, goal_loc, want, actions FROM (SELECT *, actions[k + 1] AS a, {_reason('actions[k + 1].type', 'actions[k + 1].target', 'actions[k + 1].resource')} AS r FROM walk WHERE why = 'legal' AND k < len(actions)))),
ends AS (SELECT w.row_ord, min(k) FILTER (WHERE ok AND k <= step_limit) AS goal, min(k) FILTER (WHERE why <> 'legal' AND k <= step_limit) AS bad, max(k) FILTER (WHERE why = 'legal') AS legal, min(why) FILTER (WHERE why <> 'legal') AS why, any_value(len(w.actions)) AS n, any_value(step_limit) AS step_limit FROM walk w JOIN plan p ON w.row_ord = p.row_ord GROUP BY 1),
ending AS (SELECT row_ord, n, legal, coalesce(why, 'legal') AS legality, step_limit, goal IS NOT NULL AND goal < coalesce(bad, goal + 1) AS reached, CASE WHEN goal IS NOT NULL AND goal < coalesce(bad, goal + 1) THEN 'goal_reached' WHEN bad IS NOT NULL THEN why WHEN n > step_limit THEN 'step_limit_exceeded' ELSE 'episode_ended' END AS "end",
 CASE WHEN goal IS NOT NULL AND goal < coalesce(bad, goal + 1) THEN goal WHEN bad IS NOT NULL THEN bad ELSE least(n, step_limit) END AS steps FROM ends),
episode AS (SELECT e.*, w.loc AS last_loc, w.en AS last_en FROM ending e JOIN walk w ON w.row_ord = e.row_ord AND w.k = e.steps),
judged_world AS (SELECT p.row_ord, p.model_id, p.completion_tokens, p.text, p.reason, e.reached, e."end", e.steps, e.last_en AS energy, e.legal, e.legality, e.n,
 CASE WHEN p.reason <> 'ok' OR p.claim = 'NULL' THEN 'skipped' WHEN p.claim <> 'OBJECT' THEN 'failed'
 WHEN ((p.j->'$.final_state.location') IS NOT NULL AND (json_type(p.j, '$.final_state.location') <> 'VARCHAR' OR (p.j->>'$.final_state.location') IS DISTINCT FROM e.last_loc))
 OR ((p.j->'$.final_state.energy') IS NOT NULL AND TRY_CAST((p.j->>'$.final_state.energy') AS DOUBLE) IS DISTINCT FROM e.last_en::DOUBLE) THEN 'failed' ELSE 'passed' END AS consistency FROM plan p LEFT JOIN episode e ON p.row_ord = e.row_ord),
parts AS (SELECT *, CASE WHEN reason <> 'ok' THEN NULL WHEN legality = 'legal' THEN 1.0 ELSE legal / n END AS legal_score, CASE WHEN reason = 'ok' THEN reached::INT::DOUBLE END AS goal_score, CASE consistency WHEN 'passed' THEN 1.0 WHEN 'failed' THEN 0.0 END AS state_score FROM judged_world),
held AS (SELECT *, legality = 'legal' AND reached AND consistency <> 'failed' AS held, (0.35 * legal_score + 0.45 * goal_score + CASE WHEN state_score IS NULL THEN 0 ELSE 0.2 * state_score END) / (CASE WHEN state_score IS NULL THEN 0.8 ELSE 1.0 END) AS mean FROM parts),
hybrid AS (SELECT *, CASE WHEN reason <> 'ok' THEN 'failed' WHEN held AND mean >= 0.8 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN reason <> 'ok' THEN 'gate_failed:' || reason WHEN held AND mean >= 0.8 THEN 'weighted_aggregation' WHEN NOT held THEN 'required_component_failed' ELSE 'below_threshold' END AS reason_code, CASE WHEN reason <> 'ok' THEN 0.0 ELSE round(mean, 6) END AS score FROM held)"""

REPLAY = f"WITH RECURSIVE {EPISODES} SELECT row_ord, reason, reached, \"end\", steps, energy, legal FROM judged_world"
VERDICT = f"WITH RECURSIVE {EPISODES} SELECT row_ord, status, reason_code, score FROM hybrid"
STEPS = f"WITH RECURSIVE {EPISODES} SELECT w.row_ord, w.k - 1 AS step, w.why = 'legal' AS legal, w.why AS reason FROM walk w JOIN episode e ON w.row_ord = e.row_ord WHERE w.k BETWEEN 1 AND e.steps"
LEGAL = f"""WITH {SCENES}, tries AS (SELECT *, 'REST' AS type, NULL::VARCHAR AS target, NULL::VARCHAR AS resource FROM scene UNION ALL SELECT *, 'WAIT', NULL, NULL FROM scene
 UNION ALL SELECT *, 'MOVE', unnest(list_distinct(list_concat(list_transform(list_filter(edges, lambda e: e[1] = loc), lambda e: e[2]), list_transform(list_filter(edges, lambda e: e[2] = loc), lambda e: e[1])))), NULL FROM scene
 UNION ALL SELECT *, 'COLLECT', NULL, unnest(list_distinct(list_transform(list_filter(goods, lambda r: r.location_id = loc), lambda r: r.resource_id))) FROM scene
 UNION ALL SELECT *, 'DEPOSIT', NULL, unnest(map_keys(inv)) FROM scene)
SELECT source_record_id, type, target, resource FROM tries WHERE {_reason('type', 'target', 'resource')} = 'legal'"""
