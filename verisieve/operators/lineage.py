"""Where runs come from: identities of adapters, gates on parents and fetched folders, registries."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import fingerprint
from ..sources.files import folder_fingerprint
from .contracts import ContractError

#: Files that make up an adapter, in this order (fixed values).
IDENTITY = ("adapter_model.safetensors", "adapter_config.json")
#: What a fetched run must hold (fixed values).
NEEDED = {"adapter": ("final_adapter", "lineage.json"), "eval": ("evaluation_summary.json",)}


def adapter_fingerprint(hashes: DataFrame) -> DataFrame:
    """fingerprint of the identity files among ``path`` and ``sha256``, in declared order; without any of them an error."""
    order = F.create_map(*(x for k, name in enumerate(IDENTITY) for x in (F.lit(name), F.lit(k))))
    name = F.substring_index("path", "/", -1)
    d = hashes.select(name.alias("path"), "sha256", order[name].alias("at")).where("at is not null")
    if d.isEmpty():
        raise ContractError(f"no file of {IDENTITY}")
    return folder_fingerprint(d, F.col("at"))


def lineage_findings(runs: DataFrame, run: str, mode: Column, parent: Column, expected: Column, known: DataFrame, known_name: str, known_hash: str) -> DataFrame:
    """run, finding: runs whose start contradicts their parent.

    parent_unused: from the base, yet with a parent; parent_missing: a
    continuation without one; parent_unknown: a parent that is not among
    ``known``; hash_mismatch: its hash is not the recorded one, if one was.
    """
    k = known.select(F.col(known_name).alias("_name"), F.col(known_hash).alias("_hash")).where("_name is not null").groupBy("_name").agg(F.max("_hash").alias("_hash"))
    d = runs.select(run, mode.alias("_mode"), parent.alias("_parent"), expected.alias("_expected")).join(k, F.col("_parent") == F.col("_name"), "left")
    base = F.col("_mode") == "from_base"
    finding = F.when(base & F.col("_parent").isNotNull(), "parent_unused").when(~base & F.col("_parent").isNull(), "parent_missing").when(~base & F.col("_name").isNull(), "parent_unknown").when(~base & F.col("_expected").isNotNull() & (F.col("_expected") != F.col("_hash")), "hash_mismatch")
    return d.select(run, finding.alias("finding")).where("finding is not null")


def manifest_fingerprint(suites: dict[str, dict]) -> str:
    """Of the suites' contents; where their files lie does not matter."""
    return fingerprint({name: {k: v for k, v in entry.items() if k != "path"} for name, entry in suites.items()})


def written_json(path: Path, payload: object) -> str:
    """Writes sorted, indented JSON and returns the hash of the file."""
    text = json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return hashlib.sha256(text.encode()).hexdigest()


def exemplar_digest(exemplars: list[dict]) -> str:
    """Of the indented JSON of few-shot exemplars, as it is written to a file."""
    return hashlib.sha256(json.dumps(exemplars, indent=2, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def registered(registry: DataFrame | None, hashes: DataFrame, kind: str, now: dt.datetime | None = None) -> DataFrame:
    """name, kind, sha256, registered_at: ``hashes`` (path, sha256) on top of a registry; a name that is registered again has its last entry."""
    new = hashes.select(F.col("path").alias("name"), F.lit(kind).alias("kind"), F.concat(F.lit("sha256:"), "sha256").alias("sha256"), F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp").alias("registered_at"))
    both = new if registry is None else registry.unionByName(new)
    return both.groupBy("name").agg(F.max_by(F.struct("kind", "sha256", "registered_at"), "registered_at").alias("r")).select("name", "r.*")


def lineage_record(run_id: str, config: dict, datasets: dict[str, str] | None = None, commit: str | None = None) -> dict:
    """What is kept of a run's origin."""
    model, origin = config.get("model") or {}, config.get("lineage") or {}
    return {
        "run_id": run_id, "phase": config.get("phase"), "base_model_repo_id": model.get("repo_id"), "base_model_revision": model.get("revision"), "initialization_mode": origin.get("initialization_mode") or "from_base",
        "parent_adapter": origin.get("parent_adapter"), "parent_run_id": origin.get("parent_run_id"), "dataset_fingerprints": dict(datasets or {}), "config_fingerprint": fingerprint(config), "code_commit": commit, "output_adapter_sha256": None,
    }


def run_card(run_id: str, config: dict, status: str, created: str, updated: str) -> dict:
    """One run in brief."""
    top = {k: config.get(k) for k in ("experiment_name", "track", "phase", "objective")}
    return {"run_id": run_id, **top, "protocol_version": (config.get("project") or {}).get("protocol_version"), "seed": (config.get("runtime") or {}).get("seed"), "status": status, "config_fingerprint": fingerprint(config), "created_at": created, "updated_at": updated, "notes": ""}


def fetched(local: Path, remote: Path, run_id: str, kind: str = "adapter") -> Path:
    """The folder of a run: the local one if it is whole, else copied from the remote one.

    A folder that lacks what its kind needs, or that is another run's, is an error.
    """
    whole = lambda folder: all((folder / n).exists() for n in NEEDED[kind])
    if not whole(local):
        if not remote.is_dir():
            raise ContractError(f"{run_id}: neither {local} nor {remote} is there")
        shutil.copytree(remote, local, dirs_exist_ok=True)
        if not whole(local):
            raise ContractError(f"{run_id}: {remote} lacks one of {NEEDED[kind]}")
    if kind == "adapter":
        held = json.loads((local / "lineage.json").read_text(encoding="utf-8")).get("run_id")
        if held != run_id:
            raise ContractError(f"{local} holds run {held}, not {run_id}")
    elif not list(local.glob("evaluation_*.jsonl")):
        raise ContractError(f"{run_id}: a summary without episodes")
    return local


def fetched_findings(lineage: DataFrame, run: str, wanted: str, expected: str, actual: str) -> DataFrame:
    """run, finding: folders that hold another run (run_mismatch) or another adapter than recorded (integrity)."""
    finding = F.when(~F.col(run).eqNullSafe(F.col(wanted)), "run_mismatch").when(~F.col(expected).eqNullSafe(F.col(actual)), "integrity")
    return lineage.select(run, finding.alias("finding")).where("finding is not null")
