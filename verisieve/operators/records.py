"""Records for trainers: of sources, of mined pairs, of solved worlds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gold_after_hashes, id_renamed, joined_prompt, last_boxed, strip
from .contracts import ContractError
from .world import replay, scenario_suites, solve

#: The kind of records that each objective trains on (fixed values).
KIND_OF = {"sft": "sft", "dpo": "preference", "grpo": "evaluation", "rloo": "evaluation"}
#: Families of training worlds with their rules (fixed values).
TRAINING = {
    "train-fam0": ("movement", "collection", "deposit"),
    "train-fam1": ("movement", "collection", "deposit"),
    "train-fam2": ("movement", "collection", "capacity"),
    "train-fam3": ("movement", "energy_budget", "collection", "deposit"),
    "train-fam4": ("movement", "collection"),
}
# What a world's prompt says.
PROMPT = (
    "You control an agent in a grid world.\nWorld spec (JSON): ", "\nInitial state (JSON): ", "\nGoal (JSON): ",
    '\nRespond with ONLY a JSON object: {"actions": [{"type": "MOVE|COLLECT|REST|DEPOSIT|WAIT", ...}], "final_state": {"location": "...", "energy": N}}',
)
#: How the rows of a source give a prompt, a response and a gold answer.
SOURCES: dict[str, tuple[str, str, Callable[[Column], Column]]] = {"gsm8k": ("question", "answer", gold_after_hashes), "math": ("problem", "solution", last_boxed)}


def trainer_rows(objective: str, df: DataFrame, kind: str) -> DataFrame:
    """What a trainer of the objective reads: messages, or prompt, chosen and rejected, or prompt and scenario.

    Records of another kind than the objective's are an error.
    """
    if objective not in KIND_OF:
        raise ContractError(f"{objective} has no rows of its own")
    if KIND_OF[objective] != kind:
        raise ContractError(f"{objective} needs {KIND_OF[objective]} records, not {kind}")
    prompt = joined_prompt(F.col("prompt")).alias("prompt") if kind != "sft" else None
    return {"sft": lambda: df.select("messages"), "preference": lambda: df.select(prompt, "chosen", "rejected"), "evaluation": lambda: df.select(prompt, "scenario")}[kind]()


def adapted(df: DataFrame, source: str, key: str) -> DataFrame:
    """key, prompt, response, gold of a source's rows; rows with a blank prompt or response are left out."""
    asks, says, gold = SOURCES[source]
    d = df.select(key, F.col(asks).alias("prompt"), F.col(says).alias("response"), gold(F.col(says)).alias("gold"))
    return d.where((strip(F.col("prompt")) != "") & (strip(F.col("response")) != ""))


def supervised(df: DataFrame, name: str, key: str, source_id: str, revision: str = "main", version: str = "p1-v2-mixture") -> DataFrame:
    """Supervised records of adapted rows; the id holds the source's name and the row's six-digit place."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    none = F.lit(None).cast("string")
    return df.select(
        F.format_string(f"p1-{name}-%06d", F.col(key).cast("long")).alias("id"), F.array(turn("user", "prompt"), turn("assistant", "response")).alias("messages"),
        F.struct(F.lit("public").alias("source_type"), F.lit(source_id).alias("source_id"), F.lit(revision).alias("source_revision"), none.alias("generator_model"), F.lit(version).alias("transformation_version"), none.alias("created_at")).alias("provenance"),
        F.lit(f"general_{name}").alias("task_family"), none.alias("scenario_family_id"), F.map_filter(F.create_map(F.lit("gold_answer"), F.col("gold"), F.lit("source_index"), F.col(key).cast("string")), lambda _, v: v.isNotNull()).alias("metadata"),
    )


def accepted_records(best: DataFrame, key: str, prompt: str, text: str, gold: str, model: str, family: str) -> DataFrame:
    """Supervised records of the answers that rejection sampling kept; the record that an answer was sampled for is their parent."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return best.select(
        id_renamed(F.col(key), "p1-", "p1rs-").alias("id"), F.array(turn("user", F.col(prompt)), turn("assistant", strip(F.col(text)))).alias("messages"),
        F.struct(F.lit("synthetic").alias("source_type"), F.concat(F.lit("rejection-sampling:"), F.coalesce(model, F.lit("?"))).alias("source_id"), F.lit("p1rs-v1").alias("transformation_version")).alias("provenance"),
        F.col(family).alias("task_family"), F.create_map(F.lit("gold_answer"), F.col(gold), F.lit("parent_id"), F.col(key)).alias("metadata"),
    )


def mixture_manifest(taken: DataFrame, source: str, seed: int, holdout: int) -> DataFrame:
    """per_source (map), seed, train_records, holdout_records of a corpus that was mixed from sources."""
    per = taken.groupBy(source).count()
    rows = F.coalesce(F.sum("count"), F.lit(0))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "count")))).alias("per_source"), F.lit(seed).alias("seed"), (rows - F.least(rows, F.lit(holdout))).alias("train_records"), F.least(rows, F.lit(holdout)).alias("holdout_records"))


def pair_records(mined: DataFrame, group: str, version: str, method: str = "hybrid_verifier_rank") -> DataFrame:
    """Preference records of accepted pairs: id, chosen, rejected, the verification of both, selection_method, score_margin."""
    proof = lambda side: F.struct(F.col(f"{side}_verdict.status").alias("status"), F.col(f"{side}_verdict.score").alias("score"), F.lit(version).alias("verifier_version")).alias(f"{side}_verification")
    return mined.where("decision = 'accepted'").select(F.concat(F.lit("pair-"), group).alias("id"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), proof("chosen"), proof("rejected"), F.lit(method).alias("selection_method"), F.round("score_margin", 6).alias("score_margin"))


def mining_manifest(mined: DataFrame, decisions: DataFrame, method: str, margin: float, seed: int) -> DataFrame:
    """prompts_processed, pairs_accepted, decision_counts (map), selection_method, minimum_margin, seed of one mining job."""
    counts = decisions.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n")))).alias("decision_counts"))
    whole = mined.agg(F.count("*").alias("prompts_processed"), F.count_if(F.col("decision") == "accepted").alias("pairs_accepted"))
    return whole.crossJoin(F.broadcast(counts)).select("prompts_processed", "pairs_accepted", "decision_counts", F.lit(method).alias("selection_method"), F.lit(margin).alias("minimum_margin"), F.lit(seed).alias("seed"))


def prediction_rows(df: DataFrame, key: str, family: str, text: str, gold: str, verdict: str = "verdict") -> DataFrame:
    """id, task_family, prediction, gold_answer, passed: one row per judged prediction; an unknown family reads ``unknown``."""
    return df.select(F.col(key).alias("id"), F.coalesce(family, F.lit("unknown")).alias("task_family"), F.col(text).alias("prediction"), F.col(gold).alias("gold_answer"), F.coalesce(F.col(f"{verdict}.status") == "passed", F.lit(False)).alias("passed"))


def world_prompt(spec_id: Column, family: Column, rules: Column) -> Column:
    """The question that puts a world, its state and its goal as compact JSON; nulls and defaults are written."""
    w, g = F.col("world"), F.col("goal")
    goods = F.transform(w["resources"], lambda r: F.struct(r["resource_id"].alias("resource_id"), r["location_id"].alias("location_id"), r["collect_cost"].alias("collect_cost"), F.lit(1).alias("quantity")))
    spec = F.struct(spec_id.alias("spec_id"), family.alias("family_id"), rules.alias("rule_primitives"), w["locations"].alias("locations"), w["edges"].alias("edges"), goods.alias("resources"), *(w[k].alias(k) for k in ("move_cost", "rest_gain", "max_energy", "inventory_capacity", "deposit_location")))
    dump = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return F.concat(F.lit(PROMPT[0]), dump(spec), F.lit(PROMPT[1]), dump(F.col("state0")), F.lit(PROMPT[2]), dump(F.struct(g["kind"].alias("kind"), g["location"].alias("location"), g["resources"].alias("resources"))), F.lit(PROMPT[3]))


def plan_text(actions: Column, state: Column) -> Column:
    """A plan and where it ends as JSON with sorted keys, a space after each comma and colon, and no nulls."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pair = lambda a, k: F.when(a[k].isNotNull(), F.concat(F.lit(f'"{k}": '), quoted(a[k])))
    each = F.transform(actions, lambda a: F.concat(F.lit("{"), F.concat_ws(", ", pair(a, "resource"), pair(a, "target"), pair(a, "type")), F.lit("}")))
    return F.concat(F.lit('{"actions": ['), F.array_join(each, ", "), F.lit('], "final_state": {"energy": '), state["energy"].cast("string"), F.lit(', "location": '), quoted(state["location"]), F.lit("}}"))


def solved_worlds(spark: SparkSession, per_family: int = 400, seed: int = 1042, families: dict | None = None, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """family, scenario_id, prompt, target, solvable: training worlds with the text of a shortest plan, null where there is none.

    A training family that is forbidden (as one of an evaluation suite) is an error.
    """
    families = families or TRAINING
    shared = sorted(set(families) & set(forbidden))
    if shared:
        raise ContractError(f"training families of evaluation suites: {shared}")
    d = scenario_suites(spark, per_family, seed, {f: (1, rules) for f, rules in families.items()})
    rules = F.create_map(*(x for f, r in families.items() for x in (F.lit(f), F.array(*map(F.lit, r)))))
    d = d.withColumn("family", F.col("suite")).withColumn("number", F.substring_index("scenario_id", "-", -1))
    d = d.withColumn("scenario_id", F.concat_ws("-", "family", "number")).withColumn("prompt", world_prompt(F.concat(F.col("family"), F.lit("-spec"), F.col("number").cast("int")), F.col("family"), F.try_element_at(rules, F.col("family"))))
    d = replay(solve(d).withColumn("actions", F.coalesce(F.col("plan.actions"), F.expr("cast(array() as array<struct<type string, target string, resource string>>)"))))
    return d.select("family", "scenario_id", "prompt", F.when(F.col("plan.solvable"), plan_text(F.col("actions"), F.col("episode.state"))).alias("target"), F.col("plan.solvable").alias("solvable"), "actions", "world", "state0", "goal")


def training_records(solved: DataFrame, seed: int = 1042) -> tuple[DataFrame, DataFrame]:
    """Supervised records and prompts of the worlds that have a plan; the others are left out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    d = solved.where("solvable").withColumn("provenance", F.struct(F.lit("synthetic").alias("source_type"), F.lit(f"oracle-bfs-seed{seed}").alias("source_id")))
    sft = d.select(F.concat(F.lit("sft-"), "scenario_id").alias("id"), F.array(turn("user", "prompt"), turn("assistant", "target")).alias("messages"), "provenance", F.col("family").alias("scenario_family_id"))
    prompts = d.select(F.concat(F.lit("prompt-"), "scenario_id").alias("id"), F.lit("eval_id").alias("suite"), F.to_json(F.struct("world", "state0", "goal")).alias("scenario"), F.array(turn("user", "prompt")).alias("prompt"), F.col("family").alias("scenario_family_id"), "provenance")
    return sft, prompts
