"""JSON-lines files: strict and tolerant readers, gates, canonical sink."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_column, list_fingerprint
from ..operators.contracts import ContractError, assert_empty, assert_filled, conversation_rules, duplicate_keys, leaking, preference_rules, violations

MESSAGES = "array<struct<role string, content string>>"
PROVENANCE = "struct<source_type string, source_id string, source_revision string, generator_model string, transformation_version string, created_at string>"
EVIDENCE = "struct<status string, score double, verifier_version string>"
#: Record kinds and their columns; the last entry lists those that must be there.
KINDS = {
    "sft": (f"schema_version string, id string, messages {MESSAGES}, provenance {PROVENANCE}, task_family string, scenario_family_id string, metadata map<string,string>", ("id", "messages", "provenance")),
    "preference": (f"schema_version string, id string, prompt {MESSAGES}, chosen string, rejected string, chosen_verification {EVIDENCE}, rejected_verification {EVIDENCE}, selection_method string, score_margin double, provenance {PROVENANCE}, scenario_family_id string", ("id", "prompt", "chosen", "rejected", "provenance")),
    "evaluation": (f"schema_version string, id string, suite string, scenario string, prompt {MESSAGES}, scenario_family_id string, provenance {PROVENANCE}", ("id", "suite", "prompt")),
}
# Closed lists of the record contract.
ALLOWED = {
    "role": ("system", "user", "assistant"),
    "source_type": ("synthetic", "public", "human_curated", "generated"),
    "selection_method": ("hybrid_verifier_rank", "random_pairing"),
    "suite": ("eval_id", "eval_template_ood", "eval_comp_ood", "eval_rule_ood", "eval_adversarial"),
}


def lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """file, ord, line: non-blank lines, split at line feeds only; ``ord`` is the line's place in its file.

    Files are split like any text. A first pass counts the lines of each block
    of a file, a second one adds up what comes before; only one number a block
    goes to all tasks.
    """
    raw = spark.read.options(lineSep="\n", **options).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        n = 0
        for b in batches:
            out = []
            for at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = n + 1 if at == last else 1
                last = at
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["file", "block", "line", "n"])

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("size")).select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    placed = raw.mapInArrow(numbered, "file string, block long, line string, n long").join(F.broadcast(blocks), ["file", "block"])
    return placed.where(F.trim("line") != "").select("file", (F.col("before") + F.col("n")).alias("ord"), "line")


def _object(line: str) -> dict | None:
    try:
        got = json.loads(line)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def parsed_keys(line: Column) -> Column:
    """Keys of a line that is one JSON object; null for any other line, trailing text included."""

    @F.arrow_udf("array<string>")
    def keys(rows: pa.Array) -> pa.Array:
        return pa.array([None if (d := _object(x)) is None else sorted(d) for x in rows.to_pylist()], pa.list_(pa.string()))

    return keys(line)


def read_strict(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a kind with ``file`` and ``ord``.

    Broken lines, unknown or missing keys and values outside the closed lists
    raise with their file and line.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    ddl, needed = KINDS[kind]
    fields = T.StructType.fromDDL(ddl).names
    raw = lines(spark, path).withColumn("keys", parsed_keys(F.col("line")))
    at = raw.select("file", "ord", "keys")
    assert_empty(at.where("keys is null"), "lines that are no JSON object")
    lit = lambda xs: F.array(*map(F.lit, xs))
    assert_empty(at.select("file", "ord", F.array_except("keys", lit(fields)).alias("unknown")).where(F.size("unknown") > 0), "unknown keys")
    assert_empty(at.select("file", "ord", F.array_except(lit(needed), "keys").alias("missing")).where(F.size("missing") > 0), "missing keys")
    d = raw.select("file", "ord", F.from_json("line", ddl, {"allowSingleQuotes": "false"}).alias("r")).select("file", "ord", "r.*")
    d = d.withColumn("schema_version", F.coalesce("schema_version", F.lit("1.0")))
    roles = "prompt" if kind != "sft" else "messages"
    bad = ~F.coalesce(F.forall(roles, lambda m: m["role"].isin(*ALLOWED["role"])), F.lit(False)) | ~F.coalesce(F.col("provenance.source_type").isin(*ALLOWED["source_type"]) if kind != "evaluation" else F.lit(True), F.lit(False))
    for c in ("selection_method", "suite"):
        if c in fields:
            bad = bad | ~F.coalesce(F.col(c).isin(*ALLOWED[c]), F.lit(False))
    assert_empty(d.where(bad).select("file", "ord", "id"), "values outside the closed lists")
    return d


def load(spark: SparkSession, path: str, kind: str, expected: str | None = None, forbidden_families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and a one-row manifest (kind, n, families, fingerprint) after all gates.

    In order: schema, content rules, unique ids, forbidden families, not empty,
    frozen fingerprint; the first that fails raises ContractError.
    """
    d = read_strict(spark, path, kind)
    rules = conversation_rules(F.col("messages")) if kind == "sft" else {}
    if kind == "preference":
        rules = preference_rules(d)
        d2 = d.withColumn("chosen_status", F.col("chosen_verification.status"))
    else:
        d2 = d
    if rules:
        assert_empty(violations(d2, "id", rules), "broken records")
    assert_empty(duplicate_keys(d, "id"), "repeated ids")
    if forbidden_families is not None:
        assert_empty(leaking(d, forbidden_families, "scenario_family_id").select("id", "scenario_family_id"), "forbidden families")
    assert_filled(d)
    body = d.drop("file")
    mark = list_fingerprint(body, "ord", [c for c in body.columns if c != "ord"]).first()[0]
    if expected is not None and mark != expected:
        raise ContractError(f"fingerprint {mark} instead of {expected}")
    families = d.where("scenario_family_id is not null").groupBy("scenario_family_id").count()
    manifest = families.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario_family_id", "count")))).alias("families"))
    n = d.agg(F.count("*").alias("n"))
    return d, manifest.crossJoin(n).select(F.lit(kind).alias("kind"), "n", "families", F.lit(mark).alias("fingerprint"))


def read_tolerant(spark: SparkSession, folder: str, ddl: str, glob: str = "*.jsonl", needed: str = "prediction") -> DataFrame:
    """Rows of all matching files below a folder with ``file`` and ``ord``; lines that are no object or lack ``needed`` are skipped."""
    raw = lines(spark, folder, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("keys", parsed_keys(F.col("line")))
    return raw.where(F.array_contains("keys", needed)).select("file", "ord", F.from_json("line", ddl).alias("r")).select("file", "ord", "r.*")


def write_canonical(df: DataFrame, path: str, order: str | None = None, by: str | None = None) -> str | None:
    """Canonical JSON, a record a line, sorted by ``order``; in a folder per value of ``by``. Returns the list fingerprint where an order is given."""
    cols = [c for c in df.columns if c != order]
    body = df.select(*([order] if order else []), *([by] if by else []), canonical_column(df, cols).alias("value"))
    if order:
        body = body.orderBy(order)
    out = body.select(*([by] if by else []), "value").write.mode("overwrite")
    (out.partitionBy(by) if by else out).text(path)
    return list_fingerprint(df, order, cols).first()[0] if order else None
