import json
import random

import pytest
from pyspark.sql import functions as F

from verisieve.functions.actions import plan
from verisieve.operators import pairs, verify, world

TWO = {"locations": ["loc_0", "loc_1"], "edges": [["loc_0", "loc_1"]], "resources": [{"resource_id": "res_0", "location_id": "loc_1"}], "deposit_location": "loc_0"}
START = {"location": "loc_0", "energy": 6}
GOAL = {"kind": "deposit_resources", "resources": {"res_0": 1}, "step_limit": 8}
STEPS = [{"type": "MOVE", "target": "loc_1"}, {"type": "COLLECT", "resource": "res_0"}, {"type": "MOVE", "target": "loc_0"}, {"type": "DEPOSIT", "resource": "res_0"}]
GOOD = json.dumps({"actions": STEPS, "final_state": {"location": "loc_0", "energy": 3}})
ILLEGAL = json.dumps({"actions": [STEPS[1]]})
LYING = json.dumps({"actions": STEPS, "final_state": {"location": "loc_0", "energy": 99}})


def scenes(spark, rows):
    """Rows of (key, world, state, goal, text) as scenarios read from a question."""
    d = spark.createDataFrame([(k, "\n".join(f"x: {json.dumps(j)}" for j in (w, s, g)), t) for k, w, s, g, t in rows], "k string, q string, text string")
    w, s, g = world.scenario_columns(F.col("q"))
    return d.select("k", "text", w.alias("world"), s.alias("state0"), g.alias("goal"))


def replayed(spark, rows):
    d = scenes(spark, rows).withColumn("actions", plan(F.col("text"))["actions"])
    return {r.k: r for r in world.replay(d).collect()}


def act(*steps):
    return json.dumps({"actions": [dict(zip(("type", "target", "resource"), s)) for s in steps]})


def test_fixed_episodes(spark):
    three = {"locations": ["loc_0", "loc_1", "loc_2"], "edges": [["loc_0", "loc_1"], ["loc_1", "loc_2"]], "resources": [{"resource_id": "res_0", "location_id": "loc_1"}], "inventory_capacity": 1, "deposit_location": "loc_0"}
    at = lambda loc, e, **k: {"location": loc, "energy": e, **k}
    far = {"kind": "reach_location", "location": "nowhere"}
    got = replayed(spark, [
        ("move", three, at("loc_0", 5), far, act(("MOVE", "loc_1"))),
        ("jump", three, at("loc_0", 5), far, act(("MOVE", "loc_2"))),
        ("tired", three, at("loc_0", 0), far, act(("MOVE", "loc_1"))),
        ("full", three, at("loc_1", 5, inventory={"res_0": 1}), far, act(("COLLECT", None, "res_0"))),
        ("bare", three, at("loc_0", 5), far, act(("MOVE",))),
        ("nothing", three, at("loc_0", 5), far, act(("DEPOSIT", None, "res_0"))),
        ("elsewhere", three, at("loc_1", 5), far, act(("DEPOSIT", None, "res_0"))),
        ("absent", three, at("loc_0", 5), far, act(("COLLECT", None, "res_9"))),
        ("long", three, at("loc_0", 5), far | {"step_limit": 2}, act(("WAIT",), ("REST",), ("WAIT",))),
        ("good", TWO, START, GOAL, GOOD),
        ("prose", TWO, START, GOAL, "no plan"),
        ("unread", TWO, START, GOAL, None),
    ])
    reason = {k: r.episode and r.episode.reason for k, r in got.items()}
    assert reason == {"move": "episode_ended", "jump": "illegal_not_adjacent", "tired": "illegal_insufficient_energy", "full": "illegal_inventory_full", "bare": "illegal_bad_arguments", "nothing": "illegal_nothing_to_deposit", "elsewhere": "illegal_not_at_deposit", "absent": "illegal_resource_absent", "long": "step_limit_exceeded", "good": "goal_reached", "prose": None, "unread": None}
    assert got["move"].episode.state.energy == 4 and got["move"].episode.state.turn == 1
    assert got["good"].episode.state.deposited == {"res_0": 1} and got["good"].episode.steps == 4
    assert got["long"].legality.legal == 3


def test_a_plan_without_actions_has_reached_a_goal_that_holds(spark):
    rows = [(k, TWO, {"location": "loc_0", "energy": 1}, {"kind": "reach_location", "location": where}, "") for k, where in (("here", "loc_0"), ("away", "loc_1"))]
    d = scenes(spark, rows).withColumn("actions", F.expr("cast(array() as array<struct<type string, target string, resource string>>)"))
    assert {r.k: (r.episode.reached, r.episode.reason, r.episode.steps) for r in world.replay(d).collect()} == {"here": (True, "episode_ended", 0), "away": (False, "episode_ended", 0)}


def test_scenarios_vary_in_what_they_should():
    rng = random.Random(1)
    made = [world.make_scenario(rng, ("movement", "collection", "deposit")) for _ in range(300)]
    assert {r["collect_cost"] for w, _, _ in made for r in w["resources"]} == {1, 2}
    assert {r["location_id"] for w, _, _ in made for r in w["resources"]} == {f"loc_{i}" for i in range(6)}
    assert {len(w["edges"]) for w, _, _ in made} == {5, 6, 7} and {g["kind"] for _, _, g in made} == {"deposit_resources"}
    w, s, g = made[0]
    n = len(world.shortest_plan(w, s, g))
    assert n and world.shortest_plan(w, s, g, max_states=1) is None


def simulate(w, s, g, steps):
    """The same rules in plain Python."""
    loc, en, inv, dep = s["location"], s["energy"], {}, {}
    near = {frozenset(e) for e in w["edges"]}
    for i, a in enumerate(steps):
        if i >= g["step_limit"]:
            return "step_limit_exceeded", loc, en
        kind, target, res = a["type"], a.get("target"), a.get("resource")
        if kind == "MOVE":
            why = "illegal_bad_arguments" if not target else "illegal_not_adjacent" if frozenset((loc, target)) not in near else "illegal_insufficient_energy" if en < w["move_cost"] else None
            if why:
                return why, loc, en
            loc, en = target, en - w["move_cost"]
        elif kind == "COLLECT":
            here = [r for r in w["resources"] if r["resource_id"] == res and r["location_id"] == loc]
            why = "illegal_bad_arguments" if not res else "illegal_resource_absent" if not here else "illegal_inventory_full" if sum(inv.values()) >= w["inventory_capacity"] else "illegal_insufficient_energy" if en < here[0]["collect_cost"] else None
            if why:
                return why, loc, en
            inv[res], en = inv.get(res, 0) + 1, en - here[0]["collect_cost"]
        elif kind == "DEPOSIT":
            why = "illegal_bad_arguments" if not res else "illegal_not_at_deposit" if loc != w["deposit_location"] else "illegal_nothing_to_deposit" if not inv.get(res) else None
            if why:
                return why, loc, en
            inv[res], dep[res] = inv[res] - 1, dep.get(res, 0) + 1
        elif kind == "REST":
            en = min(en + w["rest_gain"], w["max_energy"])
        have = {"collect_resources": inv, "deposit_resources": dep}.get(g["kind"], {})
        if (g["kind"] == "reach_location" and loc == g["location"]) or (g["kind"] != "reach_location" and all(have.get(k, 0) >= v for k, v in g["resources"].items())):
            return "goal_reached", loc, en
    return "episode_ended", loc, en


def test_replay_matches_plain_simulation(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(150):
        w, s, g = world.make_scenario(rng, ("movement", "collection", "capacity", "deposit")[: rng.randint(1, 4)], 4)
        steps = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["MOVE"] * 4 + ["COLLECT", "COLLECT", "DEPOSIT", "REST", "WAIT"])
            a = {"type": kind}
            if kind == "MOVE" and rng.random() < 0.97:
                a["target"] = rng.choice(w["locations"])
            if kind in ("COLLECT", "DEPOSIT") and rng.random() < 0.97:
                a["resource"] = rng.choice(["res_0", "res_1"])
            steps.append(a)
        rows.append((str(i), w, s, g, json.dumps({"actions": steps})))
        want[str(i)] = simulate(w, s, g, steps)
    got = replayed(spark, rows)
    assert {k: (r.episode.reason, r.episode.state.location, r.episode.state.energy) for k, r in got.items()} == want
    trace = world.step_trace(scenes(spark, rows).withColumn("actions", plan(F.col("text"))["actions"]), ["k"])
    assert {r.k: r.n for r in trace.groupBy("k").agg(F.count("*").alias("n")).collect()} == {k: r.episode.steps for k, r in got.items() if r.episode.steps}


def test_shortest_plans_reach_the_goal(spark):
    d = world.solve(world.scenario_suites(spark, 6, suites={"eval_id": (3, ("movement", "collection", "deposit")), "eval_adversarial": (1, ("movement", "capacity", "deposit"))}))
    solved = d.where("plan.solvable").select("scenario_id", "world", "state0", "goal", F.col("plan.actions").alias("actions"), F.col("plan.n_actions").alias("n"))
    r = world.replay(solved).where("n > 0").collect()
    assert len(r) >= 8 and all(x.episode.reached and x.episode.steps == x.n for x in r)
    assert world.solve(scenes(spark, [("a", TWO, START, GOAL, "")])).first().plan.n_actions == 4
    nothing = scenes(spark, [("a", {}, {}, {}, "")])
    assert world.solve(nothing).first().plan is None


def test_scenarios_are_the_same_again(spark):
    a, b = (world.scenario_suites(spark, 4).orderBy("scenario_id").collect() for _ in range(2))
    assert a == b and len(a) > 0
    with pytest.raises(ValueError):
        world.make_scenario(random.Random(1), ("teleport",))


def test_legal_actions(spark):
    got = world.legal_actions(scenes(spark, [("a", TWO, START, GOAL, "")]), ["k"]).collect()
    assert {(r.type, r.target) for r in got} == {("REST", None), ("WAIT", None), ("MOVE", "loc_1")}


def verdicts(spark, texts):
    d = verify.world_verdicts(scenes(spark, [(k, TWO, START, GOAL, t) for k, t in texts.items()]), "text")
    return {r.k: r for r in d.select("k", "schema", "legality_verdict", "goal_verdict", "consistency_verdict", "verdict", verify.reward(F.col("verdict")).alias("reward")).collect()}


def test_hybrid_verdicts(spark):
    got = verdicts(spark, {"good": GOOD, "illegal": ILLEGAL, "prose": "prose", "lying": LYING, "null": None})
    v = {k: (r.verdict.status, r.verdict.reason_code, r.verdict.score, r.reward) for k, r in got.items()}
    assert v["good"] == ("passed", "weighted_aggregation", 1.0, 1.0)
    assert v["illegal"] == ("failed", "required_component_failed", 0.0, 0.0)
    assert v["prose"] == v["null"] == ("failed", "gate_failed:malformed_json", 0.0, 0.0)
    assert v["lying"] == ("failed", "required_component_failed", 0.8, 0.0)
    assert got["lying"].consistency_verdict.reason_code == "state_contradiction"
    assert got["illegal"].consistency_verdict.status == "skipped"


def test_exact_answers(spark):
    rows = [("The answer is $1,200.", "1200", "passed"), ("#### 41", "42", "failed"), ("#### 42", None, "skipped"), ("Answer: A  b", "a B", "passed"), ("nothing", "1", "failed"), (None, "1", "failed")]
    d = spark.createDataFrame(rows, "p string, g string, want string")
    assert all(r.want == r.verdict.status for r in verify.exact_answers(d, "p", "g").collect())


def mined(spark, texts, **k):
    d = verify.world_verdicts(scenes(spark, [(str(i), TWO, START, GOAL, t) for i, t in enumerate(texts)]), "text").selectExpr("'s' as src", "cast(k as int) as i", "text", "verdict")
    return (pairs.random_pairs(d, "src", "text", "i", **k) if k else pairs.mine(d, "src", "text", "i", "i")).first()


def test_pair_mining(spark):
    r = mined(spark, [GOOD, ILLEGAL, "prose"])
    assert r.decision == "accepted" and r.chosen == 0 and r.score_margin >= 0.1
    assert mined(spark, [ILLEGAL, "prose"]).decision == "no_passed_candidate"
    assert mined(spark, [GOOD, GOOD + " "]).decision == "identical_texts"
    assert mined(spark, [GOOD]).decision == "insufficient_candidates"
    assert mined(spark, [GOOD, ILLEGAL, "prose"], seed=7).decision == "accepted"
    again = [mined(spark, [GOOD, ILLEGAL, "prose"], seed=7).chosen for _ in range(2)]
    assert again[0] == again[1]
