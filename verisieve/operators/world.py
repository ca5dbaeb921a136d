"""The grid world as expressions: transitions, replay as a fold, search, generation."""

from __future__ import annotations

import random
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .settle import settled

WORLD = (
    "struct<locations array<string>, edges array<array<string>>, resources array<struct<resource_id string, location_id string, collect_cost int>>, "
    "move_cost int, rest_gain int, max_energy int, inventory_capacity int, deposit_location string>"
)
STATE = "struct<location string, energy int, inventory map<string,int>, deposited map<string,int>, turn int>"
GOAL = "struct<kind string, location string, resources map<string,int>, step_limit int>"
#: What a world leaves out (fixed values).
DEFAULTS = {"move_cost": 1, "rest_gain": 2, "max_energy": 10, "inventory_capacity": 3, "collect_cost": 1, "step_limit": 12}
EMPTY = "cast(map() as map<string,int>)"


def quoted(text: str) -> str:
    return f"'{text}'"


def scenario_columns(text: Column, collect_cost: int = DEFAULTS["collect_cost"]) -> tuple[Column, Column, Column]:
    """World, state and goal of a question that holds them as three lines of JSON; nulls where it holds none.

    collect_cost: of goods that name none.
    """
    lines = F.regexp_extract_all(text, F.lit(r"(\{[^\n]*\})"), F.lit(1))
    line = lambda k, ddl: F.from_json(F.get(lines, F.lit(k)), ddl)
    w, s, g = line(0, WORLD), line(1, STATE), line(2, GOAL)
    fill = lambda c, k: F.coalesce(c[k], F.lit(DEFAULTS[k]))
    world = F.when(w["locations"].isNotNull(), F.struct(
        w["locations"].alias("locations"), F.coalesce(w["edges"], F.expr("cast(array() as array<array<string>>)")).alias("edges"),
        F.coalesce(F.transform(w["resources"], lambda r: F.struct(r["resource_id"].alias("resource_id"), r["location_id"].alias("location_id"), F.coalesce(r["collect_cost"], F.lit(collect_cost)).alias("collect_cost"))), F.expr("cast(array() as array<struct<resource_id string, location_id string, collect_cost int>>)")).alias("resources"),
        *(fill(w, k).alias(k) for k in ("move_cost", "rest_gain", "max_energy", "inventory_capacity")), w["deposit_location"].alias("deposit_location"),
    ))
    state = F.when(s["location"].isNotNull(), F.struct(s["location"].alias("location"), s["energy"].alias("energy"), F.coalesce(s["inventory"], F.expr(EMPTY)).alias("inventory"), F.coalesce(s["deposited"], F.expr(EMPTY)).alias("deposited"), F.coalesce(s["turn"], F.lit(0)).alias("turn")))
    goal = F.when(g["kind"].isNotNull(), F.struct(g["kind"].alias("kind"), g["location"].alias("location"), F.coalesce(g["resources"], F.expr(EMPTY)).alias("resources"), fill(g, "step_limit").alias("step_limit")))
    return world, state, goal


# The expressions below read columns world, state0, goal and actions; `s` is a state and `a` an action.
_REACH = "exists({w}.edges, e -> (e[0] = {s}.location and e[1] = {a}.target) or (e[1] = {s}.location and e[0] = {a}.target))"
_RULE = "filter({w}.resources, r -> r.resource_id = {a}.resource and r.location_id = {s}.location)"
_HELD = "aggregate(map_values({s}.inventory), 0, (x, y) -> x + y)"


def reason_sql(s: str, a: str, w: str = "world") -> str:
    """Why an action is illegal in a state, else ``legal``; the checks come in a fixed order."""
    f = {"s": s, "a": a, "w": w}
    return (
        "case {a}.type "
        "when 'MOVE' then case when coalesce({a}.target, '') = '' then 'illegal_bad_arguments' when not " + _REACH + " then 'illegal_not_adjacent' when {s}.energy < {w}.move_cost then 'illegal_insufficient_energy' else 'legal' end "
        "when 'COLLECT' then case when coalesce({a}.resource, '') = '' then 'illegal_bad_arguments' when size(" + _RULE + ") = 0 then 'illegal_resource_absent' when " + _HELD + " >= {w}.inventory_capacity then 'illegal_inventory_full' "
        "when {s}.energy < get(" + _RULE + ", 0).collect_cost then 'illegal_insufficient_energy' else 'legal' end "
        "when 'DEPOSIT' then case when coalesce({a}.resource, '') = '' then 'illegal_bad_arguments' when not ({w}.deposit_location <=> {s}.location) then 'illegal_not_at_deposit' when coalesce(try_element_at({s}.inventory, {a}.resource), 0) <= 0 then 'illegal_nothing_to_deposit' else 'legal' end "
        "when 'REST' then 'legal' when 'WAIT' then 'legal' else 'illegal_unknown_action' end"
    ).format(**f)


def _plus(m: str, key: str, by: int) -> str:
    """Map ``m`` with the count of ``key`` changed; a count of 0 is left out."""
    now = f"coalesce(try_element_at({m}, {key}), 0) + {by}"
    return f"map_concat(map_filter({m}, (k, v) -> k <> {key}), if({now} > 0, map({key}, {now}), {EMPTY}))"


def next_sql(s: str, a: str, w: str = "world") -> str:
    """The state after a legal action."""
    make = lambda loc, energy, inv, dep: f"named_struct('location', {loc}, 'energy', {energy}, 'inventory', {inv}, 'deposited', {dep}, 'turn', {s}.turn + 1)"
    inv, dep, loc, en = f"{s}.inventory", f"{s}.deposited", f"{s}.location", f"{s}.energy"
    rule = _RULE.format(s=s, a=a, w=w)
    return (
        f"case {a}.type when 'MOVE' then {make(f'{a}.target', f'{en} - {w}.move_cost', inv, dep)} "
        f"when 'COLLECT' then {make(loc, f'{en} - get({rule}, 0).collect_cost', _plus(inv, f'{a}.resource', 1), dep)} "
        f"when 'DEPOSIT' then {make(loc, en, _plus(inv, f'{a}.resource', -1), _plus(dep, f'{a}.resource', 1))} "
        f"when 'REST' then {make(loc, f'least({en} + {w}.rest_gain, {w}.max_energy)', inv, dep)} else {make(loc, en, inv, dep)} end"
    )


def satisfied_sql(s: str, g: str = "goal") -> str:
    """The goal holds in a state; resource goals need every count."""
    have = lambda m: f"forall(map_entries({g}.resources), e -> coalesce(try_element_at({m}, e.key), 0) >= e.value)"
    return f"case {g}.kind when 'reach_location' then {g}.location <=> {s}.location when 'collect_resources' then {have(f'{s}.inventory')} when 'deposit_resources' then {have(f'{s}.deposited')} else false end"


def replay(df: DataFrame) -> DataFrame:
    """Adds ``episode``: reached, reason, state, steps, and ``legality``: legal (prefix length), reason.

    df: world, state0, goal and actions. The episode is one fold over the
    actions that stops at the step limit, the first illegal action or the first
    state that satisfies the goal; a plan without actions has reached a goal that holds at the start. The legality walk takes all actions and
    knows neither limit nor goal. Rows without world, state, goal or actions
    get null.
    """
    acc = "named_struct('state', {state}, 'done', {done}, 'reason', {reason}, 'steps', {steps})"
    keep = lambda **k: acc.format(**({"state": "x.state", "done": "true", "reason": "x.reason", "steps": "x.steps"} | k))
    # The reason of an action is bound once as `r`, the new state as `n`.
    why = f"case when x.done then 'done' when x.steps >= goal.step_limit then 'step_limit_exceeded' else {reason_sql('x.state', 'a')} end"
    go = (
        f"transform(array({next_sql('x.state', 'a')}), n -> case when {satisfied_sql('n')} then {keep(state='n', reason=quoted('goal_reached'), steps='x.steps + 1')} "
        f"else {keep(state='n', done='false', reason=quoted('episode_ended'), steps='x.steps + 1')} end)[0]"
    )
    step = (
        f"transform(array({why}), r -> case when r = 'done' then x when r = 'legal' then {go} "
        f"when r = 'step_limit_exceeded' then {keep(reason='r')} else {keep(reason='r', steps='x.steps + 1')} end)[0]"
    )
    start = acc.format(state="state0", done="false", reason="'episode_ended'", steps="0")
    episode = f"aggregate(actions, {start}, (x, a) -> {step}, x -> named_struct('reached', x.reason = 'goal_reached' or (x.reason = 'episode_ended' and {satisfied_sql('x.state')}), 'reason', x.reason, 'state', x.state, 'steps', x.steps))"
    walk = "named_struct('state', {state}, 'legal', {legal}, 'reason', {reason})"
    first = walk.format(state="state0", legal="0", reason="'legal'")
    on = f"transform(array(case when x.reason <> 'legal' then 'done' else {reason_sql('x.state', 'a')} end), r -> case when r = 'done' then x when r = 'legal' then {walk.format(state='(' + next_sql('x.state', 'a') + ')', legal='x.legal + 1', reason='r')} else {walk.format(state='x.state', legal='x.legal', reason='r')} end)[0]"
    legality = f"aggregate(actions, {first}, (x, a) -> {on}, x -> named_struct('legal', x.legal, 'reason', x.reason))"
    whole = "world is not null and state0 is not null and goal is not null and actions is not null"
    return settled(df, episode=F.expr(f"case when {whole} then {episode} end"), legality=F.expr(f"case when {whole} then {legality} end"))


def step_trace(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, legal, reason: a row per action up to where the episode stops."""
    acc = "named_struct('state', {state}, 'done', {done}, 'trace', {trace})"
    row = "concat(x.trace, array(named_struct('legal', r = 'legal', 'reason', r)))"
    why = f"case when x.done or size(x.trace) >= goal.step_limit then 'done' else {reason_sql('x.state', 'a')} end"
    go = f"transform(array({next_sql('x.state', 'a')}), n -> {acc.format(state='n', done=satisfied_sql('n'), trace=row)})[0]"
    step = f"transform(array({why}), r -> case when r = 'done' then {acc.format(state='x.state', done='true', trace='x.trace')} when r = 'legal' then {go} else {acc.format(state='x.state', done='true', trace=row)} end)[0]"
    start = acc.format(state="state0", done="false", trace="cast(array() as array<struct<legal boolean, reason string>>)")
    e = f"aggregate(actions, {start}, (x, a) -> {step}, x -> x.trace)"
    d = df.where("world is not null and state0 is not null and goal is not null and actions is not null")
    return d.select(*keys, F.posexplode(F.expr(e)).alias("step", "t")).select(*keys, "step", "t.legal", "t.reason")


def legal_actions(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type, target, resource: all actions that are legal in ``state0``."""
    none = "cast(null as string)"
    make = lambda kind, target, resource: f"named_struct('type', '{kind}', 'target', {target}, 'resource', {resource})"
    moves = f"transform(array_distinct(concat(transform(filter(world.edges, e -> e[0] = state0.location), e -> e[1]), transform(filter(world.edges, e -> e[1] = state0.location), e -> e[0]))), t -> {make('MOVE', 't', none)})"
    picks = f"transform(array_distinct(transform(filter(world.resources, r -> r.location_id = state0.location), r -> r.resource_id)), r -> {make('COLLECT', none, 'r')})"
    puts = f"transform(map_keys(state0.inventory), r -> {make('DEPOSIT', none, 'r')})"
    every = f"filter(concat(array({make('REST', none, none)}, {make('WAIT', none, none)}), {moves}, {picks}, {puts}), a -> ({reason_sql('state0', 'a')}) = 'legal')"
    return df.where("world is not null and state0 is not null").select(*keys, F.explode(F.expr(every)).alias("a")).select(*keys, "a.type", "a.target", "a.resource")


PLANNED = "solvable boolean, n_actions int, actions array<struct<type string, target string, resource string>>"


def shortest_plan(world: dict, state: dict, goal: dict, max_states: int = 200_000) -> list[tuple[str, str | None, str | None]] | None:
    """The first shortest legal plan in a fixed order of actions; None where there is none within the limits.

    Breadth first over (place, energy, held, put down); the turn doesn't count as part of a state. No more than ``max_states`` states are gone on from.
    """
    near: dict[str, list[str]] = {}
    for a, b in (e for e in world["edges"] if len(e) == 2):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    rules: dict[str, dict[str, int]] = {}
    for r in world["resources"]:
        rules.setdefault(r["location_id"], {}).setdefault(r["resource_id"], r["collect_cost"])
    counts = lambda m: tuple(sorted((k, v) for k, v in dict(m or {}).items() if v))
    want = counts(goal["resources"])

    def reached(place: str, held: tuple, down: tuple) -> bool:
        if goal["kind"] == "reach_location":
            return place == goal["location"]
        have = dict(held if goal["kind"] == "collect_resources" else down)
        return goal["kind"] in ("collect_resources", "deposit_resources") and all(have.get(k, 0) >= v for k, v in want)

    def add(m: tuple, k: str, by: int) -> tuple:
        d = dict(m)
        d[k] = d.get(k, 0) + by
        return counts(d)

    start = (state["location"], state["energy"], counts(state["inventory"]), counts(state["deposited"]))
    if reached(start[0], start[2], start[3]):
        return []
    came: dict[tuple, tuple | None] = {start: None}
    layer = deque([(start, 0)])
    for _ in range(max_states):
        if not layer:
            break
        now, depth = layer.popleft()
        if depth >= goal["step_limit"]:
            continue
        place, energy, held, down = now
        after = [(("MOVE", t, None), (t, energy - world["move_cost"], held, down)) for t in sorted(set(near.get(place, ()))) if energy >= world["move_cost"]]
        if sum(v for _, v in held) < world["inventory_capacity"]:
            after += [(("COLLECT", None, r), (place, energy - c, add(held, r, 1), down)) for r, c in sorted(rules.get(place, {}).items()) if energy >= c]
        after.append((("REST", None, None), (place, min(energy + world["rest_gain"], world["max_energy"]), held, down)))
        if place == world["deposit_location"]:
            after += [(("DEPOSIT", None, r), (place, energy, add(held, r, -1), add(down, r, 1))) for r, _ in held]
        for action, state_ in after:
            if state_ in came:
                continue
            came[state_] = (now, action)
            if reached(state_[0], state_[2], state_[3]):
                plan = []
                while came[state_] is not None:
                    state_, action = came[state_]
                    plan.append(action)
                return plan[::-1]
            layer.append((state_, depth + 1))
    return None


def solve(df: DataFrame) -> DataFrame:
    """Adds ``plan``: solvable, n_actions, actions of a shortest plan; null without world, state or goal.

    Worlds are independent of each other and small, so that each is searched
    where its row is.
    """

    @F.arrow_udf(PLANNED)
    def search(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            if r["world"] is None or r["state0"] is None or r["goal"] is None:
                out.append(None)
                continue
            plan = shortest_plan(r["world"], r["state0"], r["goal"])
            out.append({"solvable": plan is not None, "n_actions": None if plan is None else len(plan), "actions": None if plan is None else [dict(zip(("type", "target", "resource"), a)) for a in plan]})
        return pa.array(out, pa.struct([("solvable", pa.bool_()), ("n_actions", pa.int32()), ("actions", pa.list_(pa.struct([("type", pa.string()), ("target", pa.string()), ("resource", pa.string())])))]))

    return df.withColumn("plan", search(F.struct("world", "state0", "goal")))


#: Suites with their families and rules (fixed values).
SUITES = {
    "eval_id": (3, ("movement", "collection", "deposit")),
    "eval_template_ood": (2, ("movement", "collection", "deposit")),
    "eval_comp_ood": (2, ("movement", "collection", "capacity", "deposit")),
    "eval_rule_ood": (2, ("movement", "energy_budget", "collection", "capacity", "deposit")),
    "eval_adversarial": (1, ("movement", "capacity", "deposit")),
}
RULES = ("movement", "energy_budget", "collection", "capacity", "deposit")
SCENARIO = f"suite string, family string, scenario_id string, world {WORLD}, state0 {STATE}, goal {GOAL}"


#: Kinds of goals by the rules that they need, the most demanding first.
GOALS = (({"collection", "deposit"}, "deposit_resources"), ({"collection"}, "collect_resources"), (set(), "reach_location"))


def make_scenario(rng: random.Random, rules: tuple[str, ...], size: int = 6) -> tuple[dict, dict, dict]:
    """A chain of places with some shortcuts, two goods and a depot as the rules ask.

    Collecting costs one or two; goods lie anywhere, so that a good may be
    where the depot is.
    """
    if not set(rules) <= set(RULES):
        raise ValueError(f"unknown rules: {sorted(set(rules) - set(RULES))}")
    places = [f"loc_{i}" for i in range(size)]
    chain = {(i, i + 1) for i in range(size - 1)}
    # Some of all pairs of places; those that are next to each other already add nothing.
    drawn = rng.choices([(i, j) for j in range(size) for i in range(j)], k=max(1, size // 3))
    links = sorted(chain) + [p for p in dict.fromkeys(drawn) if p not in chain]
    goods = {f"res_{k}": (rng.choice(places), rng.choice((1, 2))) for k in range(2 * ("collection" in rules))}
    here = rng.choice(places)
    kind = next(k for need, k in GOALS if need <= set(rules))
    world = {
        "locations": places, "edges": [[places[a], places[b]] for a, b in links], "resources": [{"resource_id": r, "location_id": at, "collect_cost": cost} for r, (at, cost) in goods.items()],
        "move_cost": 1, "rest_gain": 2, "max_energy": 10, "inventory_capacity": 2 if "capacity" in rules else 8, "deposit_location": places[0] if "deposit" in rules else None,
    }
    state = {"location": here, "energy": rng.randrange(5, world["max_energy"] + 1), "inventory": {}, "deposited": {}, "turn": 0}
    goal = {"kind": kind, "location": None, "resources": {}, "step_limit": 4 * size}
    if kind == "reach_location":
        goal["location"] = rng.choice([p for p in places if p != here])
    else:
        goal["resources"] = {rng.choice(sorted(goods)): 1}
    return world, state, goal


def scenario_suites(spark: SparkSession, episodes: int = 300, seed: int = 42, suites: dict | None = None) -> DataFrame:
    """Scenarios of all suites; a scenario depends on the seed, its suite, family and number only."""
    plan = [(s, f"{s.replace('_', '-')}-fam{k}", list(rules), episodes // n) for s, (n, rules) in (suites or SUITES).items() for k in range(n)]
    rows = spark.createDataFrame(plan, "suite string, family string, rules array<string>, n int")
    rows = rows.select("suite", "family", "rules", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                rng = random.Random(f"{seed + zlib.crc32(r['suite'].encode()) % 1000}|{r['family']}|{r['i']}")
                world, state, goal = make_scenario(rng, tuple(r["rules"]))
                out.append({"suite": r["suite"], "family": r["family"], "scenario_id": f"{r['family']}-{r['i']:04d}", "world": world, "state0": {**state, "inventory": [], "deposited": []}, "goal": {**goal, "resources": list(goal["resources"].items())}})
            yield pa.RecordBatch.from_pylist(out, schema)

    counts = pa.map_(pa.string(), pa.int32())
    schema = pa.schema([
        ("suite", pa.string()), ("family", pa.string()), ("scenario_id", pa.string()),
        ("world", pa.struct([("locations", pa.list_(pa.string())), ("edges", pa.list_(pa.list_(pa.string()))), ("resources", pa.list_(pa.struct([("resource_id", pa.string()), ("location_id", pa.string()), ("collect_cost", pa.int32())]))), ("move_cost", pa.int32()), ("rest_gain", pa.int32()), ("max_energy", pa.int32()), ("inventory_capacity", pa.int32()), ("deposit_location", pa.string())])),
        ("state0", pa.struct([("location", pa.string()), ("energy", pa.int32()), ("inventory", counts), ("deposited", counts), ("turn", pa.int32())])),
        ("goal", pa.struct([("kind", pa.string()), ("location", pa.string()), ("resources", counts), ("step_limit", pa.int32())])),
    ])
    return rows.mapInArrow(run, SCENARIO)
