"""Verdicts: schema, legality, goal, consistency, exact answers, their aggregate and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.actions import plan
from .settle import settled
from .world import replay

#: Weights of the scored components and the score from which a verdict passes (fixed values).
WEIGHTS = {"legality": 0.35, "goal": 0.45, "state_consistency": 0.20}
PASS = 0.8


def _verdict(status: Column, reason: Column, score: Column) -> Column:
    return F.struct(status.alias("status"), reason.alias("reason_code"), score.cast("double").alias("score"))


def component_verdicts(df: DataFrame, prediction: str) -> DataFrame:
    """Adds schema, legality_verdict, goal_verdict and consistency_verdict to rows with world, state0, goal and a prediction.

    A null prediction is malformed. Rows without a scenario are infra_error.
    """
    d = df.withColumn("parsed", plan(F.col(prediction))).withColumn("actions", F.col("parsed.actions"))
    d = replay(d)
    ok = F.col("parsed.reason") == "ok"
    no_world = F.col("episode").isNull()
    infra = lambda c: F.when(ok & no_world, _verdict(F.lit("infra_error"), F.lit("verifier_exception"), F.lit(None))).otherwise(c)
    skip = _verdict(F.lit("skipped"), F.concat(F.lit("unparseable:"), "parsed.reason"), F.lit(None))
    schema = F.when(ok, _verdict(F.lit("passed"), F.lit("schema_valid"), F.lit(1.0))).otherwise(_verdict(F.lit("failed"), F.col("parsed.reason"), F.lit(0.0)))
    rate = F.col("legality.legal") / F.size("actions")
    legality = F.when(~ok, skip).when(F.col("legality.reason") == "legal", _verdict(F.lit("passed"), F.lit("all_actions_legal"), F.lit(1.0))).otherwise(_verdict(F.lit("failed"), F.col("legality.reason"), rate))
    goal = F.when(~ok, skip).when(F.col("episode.reached"), _verdict(F.lit("passed"), F.col("episode.reason"), F.lit(1.0))).otherwise(_verdict(F.lit("failed"), F.col("episode.reason"), F.lit(0.0)))
    claims = F.col("parsed.claims")
    wrong = (F.contains(claims, F.lit("!")) | (F.contains(claims, F.lit("l")) & ~F.col("parsed.claim_location").eqNullSafe(F.col("episode.state.location")))) | (F.contains(claims, F.lit("e")) & ~F.col("parsed.claim_energy").eqNullSafe(F.col("episode.state.energy").cast("long")))
    consistency = (
        F.when(F.col("parsed.reason") == "malformed_json", skip)
        .when(claims == "none", _verdict(F.lit("skipped"), F.lit("no_claimed_state"), F.lit(None)))
        .when(~ok, skip)
        .when(claims == "bad", _verdict(F.lit("failed"), F.lit("claimed_state_not_object"), F.lit(0.0)))
        .when(wrong, _verdict(F.lit("failed"), F.lit("state_contradiction"), F.lit(0.0)))
        .otherwise(_verdict(F.lit("passed"), F.lit("state_consistent"), F.lit(1.0)))
    )
    return settled(d, schema=schema, legality_verdict=infra(legality), goal_verdict=infra(goal), consistency_verdict=infra(consistency))


def hybrid(gate: Column, components: dict[str, tuple[Column, float]], required: tuple[str, ...], threshold: float = PASS) -> Column:
    """The aggregate verdict: a failed gate fails, infrastructure trouble is passed on, else a weighted mean over scored components.

    Skipped components and null scores are left out of the mean and of the
    required check; without any the verdict is indeterminate.
    """
    if not components or sum(w for _, w in components.values()) <= 0:
        raise ValueError("components need a positive weight")
    infra = lambda c: c["status"].isin("infra_error", "timeout")
    counts = {k: (c["status"] != "skipped") & c["score"].isNotNull() for k, (c, _) in components.items()}
    used = sum((F.when(counts[k], F.lit(w)).otherwise(0.0) for k, (_, w) in components.items()), F.lit(0.0))
    total = sum((F.when(counts[k], c["score"] * w).otherwise(0.0) for k, (c, w) in components.items()), F.lit(0.0))
    score = total / F.when(used > 0, used)
    held = F.lit(True)
    for k in required:
        c, _ = components[k]
        held = held & (~counts[k] | (c["status"] == "passed"))
    passed = held & (score >= threshold)
    out = F.when(infra(gate), _verdict(gate["status"], F.concat(F.lit("gate_"), gate["status"]), F.lit(None))).when(gate["status"] != "passed", _verdict(F.lit("failed"), F.concat(F.lit("gate_failed:"), gate["reason_code"]), F.lit(0.0)))
    for k, (c, _) in components.items():
        out = out.when(infra(c), _verdict(c["status"], F.concat(F.lit("component_"), c["status"], F.lit(f":{k}")), F.lit(None)))
    return (
        out.when(used == 0, _verdict(F.lit("indeterminate"), F.lit("no_scoring_evidence"), F.lit(None)))
        .when(passed, _verdict(F.lit("passed"), F.lit("weighted_aggregation"), F.round(score, 6)))
        .otherwise(_verdict(F.lit("failed"), F.when(~held, F.lit("required_component_failed")).otherwise(F.lit("below_threshold")), F.round(score, 6)))
    )


def world_verdicts(df: DataFrame, prediction: str) -> DataFrame:
    """Adds the components' verdicts and ``verdict``, their aggregate with the world's fixed weights."""
    d = component_verdicts(df, prediction)
    parts = {"legality": "legality_verdict", "goal": "goal_verdict", "state_consistency": "consistency_verdict"}
    return settled(d, verdict=hybrid(F.col("schema"), {k: (F.col(c), WEIGHTS[k]) for k, c in parts.items()}, tuple(parts)))


def exact_answers(df: DataFrame, prediction: str, gold: str, out: str = "verdict") -> DataFrame:
    """Adds the verdict of a final answer against the gold one: as numbers where both are, else as squeezed text.

    Skipped without gold; failed without an answer. The answer and what it comes
    to are settled, so that filters on the verdict don't repeat them.
    """
    d = settled(df, _found=text.final_answer(F.col(prediction)))
    d = settled(d, _a=text.to_number(F.col("_found")), _b=text.to_number(F.col(gold)))
    found, a, b = F.col("_found"), F.col("_a"), F.col("_b")
    same = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-6).otherwise(text.squeeze(found) == text.squeeze(F.col(gold)))
    d = settled(d, _case=F.when(F.col(gold).isNull(), 0).when(found.isNull(), 1).when(same, 2).otherwise(3))
    case = F.col("_case")
    status = F.when(case == 0, "skipped").when(case == 2, "passed").otherwise("failed")
    reason = F.when(case == 0, "no_gold_answer").when(case == 1, "no_final_answer").when(case == 2, "answer_match").otherwise("answer_mismatch")
    score = F.when(case == 2, 1.0).when(case > 0, 0.0)
    return d.withColumn(out, _verdict(status, reason, score)).drop("_found", "_a", "_b", "_case")


def eligible(verdict: Column) -> Column:
    """Only passed and failed verdicts count for rewards."""
    return F.coalesce(verdict["status"].isin("passed", "failed"), F.lit(False))


def reward(verdict: Column) -> Column:
    """The score of a passed verdict (1 where it is null), 0 of a failed one, else null."""
    return F.when(verdict["status"] == "passed", F.coalesce(verdict["score"], F.lit(1.0))).when(verdict["status"] == "failed", F.lit(0.0))
