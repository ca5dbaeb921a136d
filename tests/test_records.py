import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from verisieve.functions.canonical import fingerprint
from verisieve.operators import contracts
from verisieve.operators.contracts import ContractError
from verisieve.plans import settings
from verisieve.sources import files, jsonl

RECORD = {"schema_version": "1.0", "id": "r1", "messages": [{"role": "user", "content": "q\u2028x\ry"}, {"role": "assistant", "content": "a"}], "provenance": {"source_type": "public", "source_id": "s"}, "task_family": "general", "scenario_family_id": "fam-a", "metadata": {}}


def write(path, *records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n\n", encoding="utf-8")
    return str(path)


def test_load_and_gates(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", RECORD, RECORD | {"id": "r2"})
    d, m = jsonl.load(spark, p, "sft")
    assert d.count() == 2 and m.first().families == {"fam-a": 2}
    assert d.orderBy("ord").first().messages[0].content == "q\u2028x\ry"
    mark = m.first().fingerprint
    jsonl.load(spark, p, "sft", expected=mark)
    fam = spark.createDataFrame([("fam-a",)], "scenario_family_id string")
    for bad, kwargs in (
        ((RECORD, RECORD), {}),
        ((RECORD,), {"forbidden_families": fam}),
        ((RECORD,), {"expected": "sha256:0"}),
        ((RECORD | {"extra": 1},), {}),
        (({"id": "x"},), {}),
        (("{broken",), {}),
        (('{"a": 1} x',), {}),
        (("[1]",), {}),
        ((RECORD | {"messages": RECORD["messages"][:1]},), {}),
        ((RECORD | {"messages": [{"role": "user", "content": "\u00a0"}, RECORD["messages"][1]]},), {}),
        ((RECORD | {"provenance": {"source_type": "stolen", "source_id": "s"}},), {}),
        ((), {}),
    ):
        with pytest.raises(ContractError):
            jsonl.load(spark, write(tmp_path / "bad.jsonl", *bad), "sft", **kwargs)


def test_preference_gates(spark, tmp_path):
    ok = {"id": "p", "prompt": RECORD["messages"][:1], "chosen": "a", "rejected": "b", "chosen_verification": {"status": "passed", "score": 1.0, "verifier_version": "1"}, "rejected_verification": {"status": "failed", "score": 0.0, "verifier_version": "1"}, "selection_method": "hybrid_verifier_rank", "score_margin": 1.0, "provenance": RECORD["provenance"]}
    assert jsonl.load(spark, write(tmp_path / "p.jsonl", ok), "preference")[0].count() == 1
    failed = {**ok["chosen_verification"], "status": "failed"}
    for bad in (ok | {"rejected": " a "}, ok | {"chosen_verification": failed}):
        with pytest.raises(ContractError):
            jsonl.load(spark, write(tmp_path / "q.jsonl", bad), "preference")
    jsonl.load(spark, write(tmp_path / "r.jsonl", ok | {"chosen_verification": failed, "selection_method": "random_pairing"}), "preference")


def test_canonical_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "ä"), (0, None)], "o long, t string")
    mark = jsonl.write_canonical(d, str(tmp_path / "out"), order="o")
    assert mark == fingerprint([{"t": None}, {"t": "ä"}])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text == '{"t":null}\n{"t":"ä"}\n'


def test_tolerant_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "evaluation_a.jsonl", {"id": "1", "prediction": "x"}, "{no", {"id": "2"})
    write(tmp_path / "other.jsonl", {"id": "3", "prediction": "x"})
    got = jsonl.read_tolerant(spark, str(tmp_path), "id string, prediction string", "evaluation*.jsonl")
    assert [r.id for r in got.collect()] == ["1"]


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "a.bin").write_bytes(b"1")
    (tmp_path / "d" / "b.bin").write_bytes(b"22")
    h = files.file_hashes(spark, str(tmp_path))
    want = sorted([p, "sha256:" + hashlib.sha256(b).hexdigest()] for p, b in (("a.bin", b"1"), ("d/b.bin", b"22")))
    assert files.folder_fingerprint(h).first()[0] == fingerprint(want)
    n = spark.createDataFrame([("checkpoint-9",), ("checkpoint-100",), ("last",)], "name string")
    assert tuple(files.latest(n, "name").first()) == ("checkpoint-100", 100)


def test_set_gates(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "id string")
    b = spark.createDataFrame([("y",), ("z",)], "id string")
    assert [r.id for r in contracts.leaking(a, b, "id").collect()] == ["y"]
    assert {r.id for r in contracts.without_leaks(a, b, "id").collect()} == {"x", None}
    assert tuple(contracts.id_set_difference(a.where("id is not null"), b, ["id"]).first()) == (1, 1, 1)
    log = spark.createDataFrame([("r", 1, "pending"), ("r", 2, "running"), ("r", 3, "pending"), ("s", 1, "running")], "run string, t int, status string")
    assert {tuple(r) for r in contracts.illegal_moves(log, "run", "status", ["t"]).collect()} == {("r", "running", "pending"), ("s", None, "running")}


def test_null_conversations(spark):
    d = spark.createDataFrame([(1, None), (2, [])], "k int, m array<struct<role string, content string>>")
    got = {tuple(r) for r in contracts.violations(d, "k", contracts.conversation_rules(F.col("m"))).collect()}
    assert got == {(1, "too_few_messages"), (2, "too_few_messages")}


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": 2}, "l": [1]}')
    (tmp_path / "top.json").write_text('{"extends": "base.json", "a": {"b": 5}}')
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    (tmp_path / "empty.json").write_text("")
    c = settings.composed(tmp_path / "top.json")
    assert c == {"a": {"b": 5, "c": 2}, "l": [1]} and settings.composed(tmp_path / "empty.json") == {}
    assert settings.overridden(c, ["a.c=true", "x.y=1.5"])["x"] == {"y": 1.5}
    for bad in (lambda: settings.composed(tmp_path / "loop.json"), lambda: settings.overridden(c, ["l.x=1"]), lambda: settings.overridden(c, ["nothing"])):
        with pytest.raises(ContractError):
            bad()
    assert settings.overridden({"x": None}, ["x.y={a: 1}"]) == {"x": {"y": {"a": 1}}}
    assert settings.broken_rules({"track": "track_b_two_stage", "phase": "phase2_playworld", "lineage": {"initialization_mode": "from_base"}}) == ["second_phase_continues"]
    assert settings.broken_rules({"track": "ablation", "runtime": {"environment_policy": "strict", "attention_backend": "flash"}, "model": {"revision": "main"}, "adapter": {"kind": "qlora"}}) == ["attention", "revision"]
    assert settings.broken_rules({"lineage": {"initialization_mode": settings.CONTINUE}}) == ["parent_missing"]
    assert settings.broken_rules({"lineage": {"parent_adapter": {"sha256": "x"}}}) == ["parent_unused"]
    assert settings.broken_rules({"phase": "phase1_general", "objective": "sft", "lineage": {"initialization_mode": settings.CONTINUE, "parent_adapter": {}}}) == ["first_phase_from_base"]
    assert settings.moved("pending", "running") == "running"
    with pytest.raises(ContractError):
        settings.moved("completed", "running")
    assert settings.lacking(["metrics"]) and settings.environment("A100", 80, "a100", 40, True) == []
    assert settings.run_name("My Run!", 3).split("--")[1:3] == ["my-run", "s3"]


def test_lines_of_a_file_in_several_blocks(spark, tmp_path):
    """Line numbers hold across the blocks of a file, which several tasks read."""
    from verisieve.sources import jsonl

    text = [f'{{"id": "{i}", "x": "{"y" * (i % 90)}"}}' if i % 7 else "" for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(text))
    (tmp_path / "b.jsonl").write_text('{"id": "z\u2028\r"}\n\n{"id": "q"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        d = jsonl.lines(spark, str(tmp_path))
        assert d.rdd.getNumPartitions() > 4
        rows = d.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(r.file[-7:], r.ord): r.line for r in rows}
    assert got == {("a.jsonl", i + 1): t for i, t in enumerate(text) if t} | {("b.jsonl", 1): '{"id": "z\u2028\r"}', ("b.jsonl", 3): '{"id": "q"}'}


def test_staged_tables_go_when_their_scope_ends(spark):
    import os

    from verisieve.sources import tables

    with tables.staging(spark):
        kept = tables.stage(spark.range(5).toDF("x"), "try")
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_lineage(spark, tmp_path):
    import hashlib
    import json

    from verisieve.operators import lineage
    from verisieve.sources import files

    for name, body in (("adapter_config.json", "{}"), ("adapter_model.safetensors", "weights"), ("notes.txt", "x")):
        (tmp_path / name).write_text(body)
    h = files.file_hashes(spark, str(tmp_path))
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    want = json.dumps([["adapter_model.safetensors", sha("weights")], ["adapter_config.json", sha("{}")]], separators=(",", ":"))
    assert lineage.adapter_fingerprint(h).first()[0] == sha(want)
    with pytest.raises(ContractError):
        lineage.adapter_fingerprint(h.where("path like '%txt'"))
    runs = spark.createDataFrame([(1, "from_base", "p", None), (2, "c", None, None), (3, "c", "lost", None), (4, "c", "p", "bad"), (5, "c", "p", "h"), (6, "from_base", None, "x"), (7, "c", "p", None)], "run int, mode string, parent string, sha string")
    known = spark.createDataFrame([("p", "h"), (None, "z")], "name string, hash string")
    got = lineage.lineage_findings(runs, "run", F.col("mode"), F.col("parent"), F.col("sha"), known, "name", "hash")
    assert {tuple(r) for r in got.collect()} == {(1, "parent_unused"), (2, "parent_missing"), (3, "parent_unknown"), (4, "hash_mismatch")}
    a, b = ({"s": {"path": p, "episodes": 3}} for p in ("/x", "/y"))
    assert lineage.manifest_fingerprint(a) == lineage.manifest_fingerprint(b) != lineage.manifest_fingerprint({"s": {"episodes": 4}})
    shots = [{"prompt": "é", "completion": "b"}]
    assert lineage.written_json(tmp_path / "deep" / "x.json", shots) == lineage.exemplar_digest(shots) == hashlib.sha256((tmp_path / "deep" / "x.json").read_bytes()).hexdigest()
    first = lineage.registered(None, h, "checkpoint", dt.datetime(2024, 1, 1))
    both = lineage.registered(first, h.where("path like '%txt'"), "log", dt.datetime(2024, 1, 2))
    assert {r.name.rsplit("/", 1)[-1]: r.kind for r in both.collect()} == {"adapter_config.json": "checkpoint", "adapter_model.safetensors": "checkpoint", "notes.txt": "log"}
    config = {"model": {"repo_id": "m", "revision": "r"}, "track": "ablation", "runtime": {"seed": 3}}
    assert lineage.lineage_record("x", config)["initialization_mode"] == "from_base" and lineage.run_card("x", config, "pending", "a", "b")["seed"] == 3
    f = spark.createDataFrame([("a", "a", "1", "1"), ("b", "c", "1", "1"), ("d", "d", "1", None)], "run string, want string, exp string, act string")
    assert {tuple(r) for r in lineage.fetched_findings(f, "run", "want", "exp", "act").collect()} == {("b", "run_mismatch"), ("d", "integrity")}


def test_fetching_a_run(tmp_path):
    import json

    from verisieve.operators.lineage import fetched

    far, here = tmp_path / "far", tmp_path / "here"
    with pytest.raises(ContractError):
        fetched(here, far, "r1")
    (far / "final_adapter").mkdir(parents=True)
    with pytest.raises(ContractError):
        fetched(here, far, "r1")
    (far / "lineage.json").write_text(json.dumps({"run_id": "r1"}))
    assert fetched(here, far, "r1") == here and (here / "lineage.json").exists()
    with pytest.raises(ContractError):
        fetched(here, far, "r2")


def test_trainer_rows_and_records(spark):
    from verisieve.operators import records

    m = "array<struct<role string, content string>>"
    p = spark.createDataFrame([([("user", "a"), ("user", "b")], "x", "y", "{}")], f"prompt {m}, chosen string, rejected string, scenario string").withColumn("messages", F.col("prompt"))
    assert tuple(records.trainer_rows("dpo", p, "preference").first()) == ("a\nb", "x", "y")
    assert records.trainer_rows("rloo", p, "evaluation").columns == ["prompt", "scenario"] and records.trainer_rows("sft", p, "sft").columns == ["messages"]
    for bad in (("dpo", "sft"), ("none", "sft")):
        with pytest.raises(ContractError):
            records.trainer_rows(bad[0], p, bad[1])
    s = spark.createDataFrame([(7, "q", "is 4\n#### 4"), (8, " ", "x"), (9, "q", None), (10, "q", "none")], "i int, question string, answer string")
    got = {r.id: (r.metadata, r.messages[1].content) for r in records.supervised(records.adapted(s, "gsm8k", "i"), "gsm8k", "i", "src").collect()}
    assert got == {"p1-gsm8k-000007": ({"gold_answer": "4", "source_index": "7"}, "is 4\n#### 4"), "p1-gsm8k-000010": ({"source_index": "10"}, "none")}
    with pytest.raises(ContractError):
        records.solved_worlds(spark, forbidden=("train-fam0",))


def test_training_worlds_have_targets(spark):
    import json

    from verisieve.operators import records, world

    s = records.solved_worlds(spark, per_family=20, families={"f": ("movement", "collection", "deposit")})
    rows = s.collect()
    assert len(rows) == 20 and all((r.target is not None) == r.solvable for r in rows)
    r = next(r for r in rows if r.solvable and r.actions)
    t = json.loads(r.target)
    assert r.target == json.dumps(t, sort_keys=True) and len(t["actions"]) == len(r.actions)
    lines = r.prompt.split("\n")
    spec = json.loads(lines[1].split(": ", 1)[1])
    assert spec["family_id"] == "f" and spec["resources"][0]["quantity"] == 1 and spec["deposit_location"] == "loc_0" and json.loads(lines[3].split(": ", 1)[1])["location"] is None
    sft, prompts = records.training_records(s)
    assert sft.count() == prompts.count() == sum(r.solvable for r in rows)
    assert {len(world.SUITES), len(records.TRAINING)} == {5}


def test_renamed_ids_and_renderings(spark):
    from verisieve.functions import text

    d = spark.createDataFrame([("p1-a-p1-b",), ("x",), (None,)], "i string")
    assert [r[0] for r in d.select(text.id_renamed(F.col("i"), "p1-", "p1rs-")).collect()] == ["p1rs-a-p1-b", "x", None]
    r = spark.createDataFrame([("abc", "ab"), ("abc", "ax"), ("a", "abc"), ("", "")], "a string, b string")
    assert [x[0] for x in r.select(text.rendering_check(F.col("a"), F.col("b"))).collect()] == [None, 1, 1, None]
