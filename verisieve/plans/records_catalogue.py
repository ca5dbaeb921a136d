"""Named queries on records, files, models and audits, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, contracts, corpus, lineage, pairs, records, selection, stats, verify, world
from ..sources import files, jsonl
from ..sources.tables import stage, stage_home, table
from . import world_sql
from .catalogue import _B, _DRAWN, _FILLED, _JUDGED, _MARK, _REPEATS, _SEQUENTIAL, _ends, _final, _judged, _last_number, _plain, _poisson, _strip, _uniform, _verdicts, query, sequential_mixture

# --- models: rates of their plans and answers ------------------------------


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """World candidates with their verdict, actions, and the share of them that are legal."""
    v = _verdicts(spark, d)
    n = F.when(F.col("actions").isNotNull(), F.size("actions"))
    return v.select("row_ord", "model_id", "completion_tokens", "text", "verdict", "episode", n.alias("n_actions"), F.col("legality.legal").alias("legal"), (F.col("legality.legal") / n).alias("legal_rate"))


def _intervals(rows: str, by: str, metrics: tuple[str, ...]) -> str:
    """Bootstrap intervals of the metrics of ``rows`` (by, k, metrics), in SQL."""
    means = ", ".join(f"sum(w * {m}) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN w END), 0) AS {m}" for m in metrics)
    lists = ", ".join(f"list({m} ORDER BY {m}) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in metrics)
    each = " UNION ALL ".join(f"SELECT p.{by}, '{m}' AS metric, p.n_{m} AS n, round(p.{m}, 6) AS mean, {_ends('s.' + m)} FROM pts p JOIN srt s ON p.{by} IS NOT DISTINCT FROM s.{by} WHERE p.n_{m} > 0" for m in metrics)
    return f"""smp AS (SELECT *, {_poisson(_uniform("'42'", "b::VARCHAR", "k"))} AS w FROM {rows}, range({_B}) t(b)), bts AS (SELECT {by}, b, {means} FROM smp GROUP BY 1, 2), srt AS (SELECT {by}, {lists} FROM bts GROUP BY 1),
pts AS (SELECT {by}, {", ".join(f"count({m}) AS n_{m}, avg({m}) AS {m}" for m in metrics)} FROM {rows} GROUP BY 1) {each}"""


@query(f"WITH v AS (SELECT suite, row_ord::VARCHAR AS k, (verdict.status = 'passed')::INT::DOUBLE AS pass_rate, coalesce(verdict.score, 0.0) AS mean_score FROM traces WHERE verdict.status IN ('passed', 'failed')), {_intervals('v', 'suite', ('pass_rate', 'mean_score'))}")
def suite_intervals(spark, d):
    return stats.suite_intervals(table(spark, d, "traces").select("suite", "row_ord", "verdict"), ["suite"], "row_ord", resamples=_B)


@query(f"WITH RECURSIVE {world_sql.EPISODES}, v AS (SELECT model_id, row_ord::VARCHAR AS k, (status = 'passed')::INT::DOUBLE AS pass_rate, score AS mean_score, legal / n AS legal_action_rate FROM hybrid), {_intervals('v', 'model_id', ('pass_rate', 'mean_score', 'legal_action_rate'))}")
def world_summary(spark, d):
    return stats.suite_intervals(_episodes(spark, d), ["model_id"], "row_ord", legal="legal_rate", resamples=_B)


@query(f"WITH RECURSIVE {world_sql.EPISODES} SELECT model_id, coalesce(sum(legal), 0)::BIGINT AS part, coalesce(sum(n), 0)::BIGINT AS whole, round(sum(legal) / nullif(sum(n), 0), 6) AS rate FROM hybrid GROUP BY 1")
def pooled_legal_rate(spark, d):
    return selection.pooled_rate(_episodes(spark, d), ["model_id"], F.col("legal").cast("long"), F.col("n_actions").cast("long"))


@query(f"WITH RECURSIVE {world_sql.EPISODES} SELECT model_id, coalesce(sum(completion_tokens) FILTER (WHERE n IS NOT NULL), 0)::BIGINT AS part, coalesce(sum(n) FILTER (WHERE completion_tokens IS NOT NULL), 0)::BIGINT AS whole, round(sum(completion_tokens) FILTER (WHERE n IS NOT NULL) / nullif(sum(n) FILTER (WHERE completion_tokens IS NOT NULL), 0), 6) AS rate FROM hybrid GROUP BY 1")
def tokens_per_decision(spark, d):
    return selection.pooled_rate(_episodes(spark, d), ["model_id"], F.col("completion_tokens").cast("long"), F.col("n_actions").cast("long"))


_TEXT_REPEATS = _REPEATS.replace("prediction", "text")
_HACK = f"status = 'passed' AND (coalesce({_TEXT_REPEATS}, false) OR coalesce(steps < n, false))"


def _hacks() -> dict:
    """Audit rules on passed episodes: a repeated tail, actions after the goal."""
    return {"repeated_tail": text.tail_repeats(F.col("text")), "beyond_the_goal": F.col("episode.steps") < F.col("n_actions")}


@query(f"WITH RECURSIVE {world_sql.EPISODES} SELECT model_id, count(*) AS n, count(*) FILTER (WHERE {_HACK}) AS flagged, round(count(*) FILTER (WHERE {_HACK}) / count(*), 6) AS share FROM hybrid GROUP BY 1")
def hacking_incidence(spark, d):
    return selection.incidence(_episodes(spark, d), ["model_id"], F.col("verdict.status") == "passed", _hacks())


#: Hard constraints of a champion (fixed values).
LIMITS = {"validity": (">=", 0.95), "legal_rate": (">=", 0.90), "drop": ("<=", 0.03), "hacking": ("<=", 0.02), "repetition": ("<=", 0.05)}


@query(f"""WITH RECURSIVE {world_sql.EPISODES}, {_JUDGED}, a AS (SELECT model_id, avg((reason = 'ok')::INT::DOUBLE) AS validity, sum(legal) / nullif(sum(n), 0) AS legal_rate, count(*) FILTER (WHERE {_HACK}) / count(*) AS hacking FROM hybrid WHERE model_id IS NOT NULL GROUP BY 1),
g AS (SELECT model_id, avg((status = 'passed')::INT::DOUBLE) FILTER (WHERE gold IS NOT NULL) AS general, avg(coalesce({_TEXT_REPEATS}, false)::INT::DOUBLE) AS repetition FROM scored WHERE model_id IS NOT NULL GROUP BY 1), f AS (SELECT general AS base FROM g ORDER BY model_id LIMIT 1)
SELECT g.model_id, round(validity, 6) AS validity, round(legal_rate, 6) AS legal_rate, round((SELECT base FROM f) - general, 6) AS drop, round(hacking, 6) AS hacking, round(repetition, 6) AS repetition,
coalesce(round(validity, 6) >= 0.95 AND round(legal_rate, 6) >= 0.9 AND round((SELECT base FROM f) - general, 6) <= 0.03 AND round(hacking, 6) <= 0.02 AND round(repetition, 6) <= 0.05, false) AS admitted FROM g LEFT JOIN a ON a.model_id = g.model_id""")
def hard_constraints(spark, d):
    """All five constraints of every model; general answers are compared with those of the first model."""
    e = _episodes(spark, d).where("model_id is not null")
    hit = (F.col("verdict.status") == "passed") & (_hacks()["repeated_tail"] | _hacks()["beyond_the_goal"])
    plans = e.groupBy("model_id").agg(F.avg(F.col("n_actions").isNotNull().cast("double")).alias("validity"), (F.sum("legal") / F.nullif(F.sum("n_actions"), F.lit(0))).alias("legal_rate"), (F.count_if(F.coalesce(hit, F.lit(False))) / F.count("*")).alias("hacking"))
    j = _judged(spark, d).where("model_id is not null")
    g = stage(j.groupBy("model_id").agg(F.avg(F.when(F.col("gold").isNotNull(), (F.col("verdict.status") == "passed").cast("double"))).alias("general"), F.avg(text.tail_repeats(F.col("text")).cast("double")).alias("repetition")), "general")
    base = g.agg(F.min_by("general", "model_id").alias("base"))
    m = g.join(plans, "model_id", "left").crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("general"))
    return selection.within_limits(m.select("model_id", *(F.round(k, 6).alias(k) for k in LIMITS)), LIMITS)


@query("""WITH m AS (SELECT run_id, suite, avg((verdict.status = 'passed')::INT::DOUBLE) AS p, avg((coalesce(verdict.reason_code, '') <> 'gate_failed:malformed_json')::INT::DOUBLE) AS validity, avg(coalesce(verdict.score, 0.0)) AS reward, avg(coalesce(""" + _REPEATS + """, false)::INT::DOUBLE) AS hacking FROM traces GROUP BY 1, 2)
SELECT DISTINCT run_id, rule FROM (SELECT run_id, unnest(list_filter([CASE WHEN coalesce(p, 0) = 0 THEN 'loss_diverged' END, CASE WHEN validity < 0.5 THEN 'low_validity' END, CASE WHEN reward >= 0.999 AND hacking > 0.1 THEN 'reward_hacking' END], lambda x: x IS NOT NULL)) AS rule FROM m)""")
def stopping_rules(spark, d):
    """Runs that a stopping rule ends in any suite; the loss of a suite without any passed episode is infinite."""
    t = table(spark, d, "traces")
    ok = F.avg((F.col("verdict.status") == "passed").cast("double"))
    m = t.groupBy("run_id", "suite").agg(ok.alias("p"), F.avg((F.coalesce("verdict.reason_code", F.lit("")) != "gate_failed:malformed_json").cast("double")).alias("validity"), F.avg(F.coalesce("verdict.score", F.lit(0.0))).alias("reward"), F.avg(text.tail_repeats(F.col("prediction")).cast("double")).alias("hacking"))
    m = m.withColumn("loss", F.when(F.coalesce("p", F.lit(0.0)) > 0, -F.ln("p")).otherwise(F.lit(float("inf"))))
    return selection.stopped_runs(m, "run_id", selection.protocol_rules(F.col("loss"), F.col("validity"), F.col("reward"), F.col("hacking")))


# --- audits ----------------------------------------------------------------

_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, suite, id ORDER BY row_ord) AS rn FROM traces) WHERE rn = 1)"


@query(f"WITH {_FIRST}, g AS (SELECT run_id, coalesce(verdict.reason_code, 'None') AS reason_code, count(*) AS n, min(row_ord) AS o FROM f GROUP BY 1, 2) SELECT run_id, reason_code, n, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, o) AS place FROM g")
def run_reason_codes(spark, d):
    return audit.reason_counts(table(spark, d, "traces"), F.col("verdict.reason_code")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_FIRST}, s AS (SELECT run_id, count(*) FILTER (WHERE verdict.status = 'timeout') AS cut FROM traces GROUP BY 1) SELECT f.run_id, count(*) AS rows, any_value(cut) AS truncated_outputs, round(any_value(cut) / count(*), 4) AS truncation_rate, any_value(cut) >= count(*) AS all_truncated FROM f JOIN s ON f.run_id = s.run_id GROUP BY 1")
def run_truncation(spark, d):
    """The run audit beside a summary of outputs that were cut; timeouts stand in for these."""
    t = table(spark, d, "traces")
    s = t.groupBy("run_id").agg(F.count_if(F.col("verdict.status") == "timeout").alias("truncated_outputs"))
    return audit.run_audit(t, summary=s).select("run_id", "rows", "truncated_outputs", "truncation_rate", "all_truncated")


@query("WITH s AS (SELECT run_id, suite, count(*) AS episodes, round(avg((verdict.status = 'passed')::INT::DOUBLE) FILTER (WHERE verdict.status IN ('passed', 'failed')), 4) AS pass_rate FROM traces GROUP BY 1, 2) SELECT run_id, suite, episodes, pass_rate, 512 AS max_new_tokens, 'none' AS conditioning, 'sha256:0' AS freeze_fingerprint FROM s")
def run_report(spark, d):
    r = audit.run_report(table(spark, d, "traces"), "run_id", F.struct(F.lit(512).alias("max_new_tokens")), F.lit("none"), F.lit("sha256:0"))
    return r.select("run_id", F.explode("suites").alias("suite", "s"), "decoding.max_new_tokens", "conditioning", "freeze_fingerprint").select("run_id", "suite", "s.episodes", "s.pass_rate", "max_new_tokens", "conditioning", "freeze_fingerprint")


@query("WITH r AS (SELECT row_ord, array_to_string(list_transform(messages, lambda m: m.content), chr(10)) AS a, array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: m.content), chr(10)) AS b FROM sft_records) SELECT row_ord, a IS DISTINCT FROM b AS differs, CASE WHEN NOT starts_with(a, b) THEN CASE WHEN a = b THEN NULL ELSE coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])[1] - 1, least(length(a), length(b))) END END AS leaves_at FROM r")
def rendering_mismatch(spark, d):
    """Where a record's conversation leaves its prompt as it is put at evaluation."""
    m = F.col("messages")
    r = table(spark, d, "sft_records").select("row_ord", text.joined_prompt(m).alias("a"), text.joined_prompt(F.filter(m, lambda x: x["role"] != "assistant")).alias("b"))
    return r.select("row_ord", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs"), text.rendering_check(F.col("a"), F.col("b")).cast("long").alias("leaves_at"))


_IDS = "list_transform(string_split(text, ' '), lambda x: length(x)::INTEGER)"


def _ids(c: str):
    return F.transform(F.split(c, " ", -1), F.length)


@query(f"""WITH t AS (SELECT row_ord, {_IDS} AS ids FROM candidates WHERE text <> ''), l AS (SELECT row_ord, ids, list_transform(ids, lambda x, i: CASE WHEN i <= 3 OR x = 6 THEN -100 ELSE x END) AS labels FROM t),
p AS (SELECT row_ord, ids, labels, list_filter(range(len(ids), 0, -1), lambda i: ids[i] <> 6 OR labels[i] <> -100 OR i = 1)[1] AS e, list_filter(range(len(ids), 0, -1), lambda i: ids[i] IN (5, 6))[1] AS s FROM l)
SELECT row_ord, e - 1 AS terminal, ids[e] IN (5, 6) AS is_stop, coalesce(labels[CASE WHEN ids[e] IN (5, 6) THEN e ELSE s END] = -100, false) AS masked FROM p""")
def label_masks(spark, d):
    """Stop ids and their labels; the lengths of words stand in for token ids."""
    c = table(spark, d, "candidates").where("text <> ''").select("row_ord", _ids("text").alias("ids"))
    c = c.withColumn("labels", F.transform("ids", lambda x, i: F.when((i < 3) | (x == 6), -100).otherwise(x)))
    return c.select("row_ord", audit.label_mask(F.col("ids"), F.col("labels"), 6, [5, 6]).alias("m")).select("row_ord", F.col("m.terminal").cast("long").alias("terminal"), "m.is_stop", "m.masked")


@query(f"WITH t AS (SELECT model_id, {_IDS} AS ids FROM candidates WHERE text IS NOT NULL) SELECT model_id, count(*) AS n, count(*) FILTER (WHERE len(ids) = 24 AND NOT list_has_any(ids, [13, 14])) AS at_cap FROM t GROUP BY 1")
def outputs_at_cap(spark, d):
    c = table(spark, d, "candidates").where("text is not null").select("model_id", _ids("text").alias("ids"))
    return c.groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(audit.hits_cap(F.col("ids"), 24, [13, 14])).alias("at_cap"))


@query(f"WITH t AS (SELECT row_ord, {_IDS} AS p, list_transform(string_split(replace(text, 'e', ''), ' '), lambda x: length(x)::INTEGER) AS w FROM candidates WHERE text <> '') SELECT row_ord, list_filter(range(1, len(p) + 1), lambda i: w[i] IS DISTINCT FROM p[i])[1] - 1 AS at FROM t")
def boundary_mismatches(spark, d):
    c = table(spark, d, "candidates").where("text <> ''").select("row_ord", _ids("text").alias("p"), F.transform(F.split(F.replace("text", F.lit("e"), F.lit("")), " ", -1), F.length).alias("w"))
    return c.select("row_ord", audit.boundary_mismatch(F.col("w"), F.col("p")).cast("long").alias("at"))


@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), k AS (SELECT vec_id, v, list_filter(range(1, len(v)), lambda i: i % 3 <> 0) AS pos FROM t), s AS (SELECT vec_id, v, pos, list_sort(list_transform(pos, lambda i: v[i + 1])) AS x, list_filter(pos, lambda i: i % 7 = 3)[-1] AS stop FROM k)
SELECT vec_id, len(pos)::BIGINT AS supervised, round(list_avg(x), 4) AS mean, round(x[floor(0.5 * (len(x) - 1))::INT + 1], 4) AS p50, round(x[floor(0.9 * (len(x) - 1))::INT + 1], 4) AS p90, stop::BIGINT AS stop_at, round(v[stop + 1], 4) AS stop_nll FROM s""")
def nll_profiles(spark, d):
    """Loss profiles; the entries' sizes stand in for losses, every third one is masked."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    labels = F.transform("embedding", lambda _, i: F.when(i % 3 == 0, -100).otherwise(i))
    p = audit.nll_profile(F.col("v"), F.col("labels"), F.transform("v", lambda _, i: i % 7), 3)
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"), labels.alias("labels")).select("vec_id", p.alias("p")).select("vec_id", "p.*")
    return e.withColumn("supervised", F.col("supervised").cast("long")).withColumn("stop_at", F.col("stop_at").cast("long"))


_ARMS = "SELECT coalesce(model_id, '?') AS arm, min(regexp_extract(coalesce(model_id, '?'), '^(.*)-\\d+$', 1)) AS disk, count(*) % 2 AS live, max(cand_index) AS probe FROM candidates GROUP BY 1"


@query(f"WITH m AS ({_ARMS}) SELECT a.arm AS a, b.arm AS b, a.disk = b.disk AS disk_equal, a.live = b.live AS live_equal, a.probe IS NOT DISTINCT FROM b.probe AS probe_equal, CASE WHEN a.live = b.live AND a.disk <> b.disk THEN 'loader_leakage' WHEN a.live <> b.live AND a.probe IS NOT DISTINCT FROM b.probe THEN 'degenerate_application' WHEN a.live <> b.live THEN 'healthy' ELSE 'same_adapter' END AS finding FROM m a JOIN m b ON a.arm < b.arm")
def arm_verdicts(spark, d):
    m = F.coalesce("model_id", F.lit("?"))
    arms = table(spark, d, "candidates").groupBy(m.alias("arm")).agg(F.min(F.regexp_extract(m, r"^(.*)-\d+$", 1)).alias("disk"), (F.count("*") % 2).alias("live"), F.max("cand_index").alias("probe"))
    return audit.arm_verdicts(stage(arms, "arms"), "arm", "disk", "live", "probe")


@query("SELECT max(n_chars) AS longest FROM documents WHERE lang IS NULL HAVING max(n_chars) < 16")
def implausible_lengths(spark, d):
    return audit.implausible_lengths(table(spark, d, "documents").where("lang is null"), "n_chars")


@query(_DRAWN)
def comparison_table(spark, d):
    """The comparisons of the first few runs as lines of a table would show them."""
    from .catalogue import _compared

    c = _compared(spark, d)
    return stats.comparison_lines(c, ["run_id", "suite"]).select("run_id", "suite", "metric", F.trim(F.substring_index("line", " ", -1)).alias("sig"))


# --- records ---------------------------------------------------------------


@query(f"SELECT row_ord, CASE WHEN contains(text, '####') THEN {_strip('string_split(text, ' + chr(39) + '####' + chr(39) + ')[-1]')} END AS after_hashes, {_strip('list_extract(regexp_extract_all(text, ' + chr(39) + r'\\boxed\{([^}]*)\}' + chr(39) + ', 1), -1)')} AS boxed FROM candidates")
def gold_answers(spark, d):
    return table(spark, d, "candidates").select("row_ord", text.gold_after_hashes(F.col("text")).alias("after_hashes"), text.last_boxed(F.col("text")).alias("boxed"))


_USER = "list_filter(messages, lambda m: m.role = 'user')[1].content"


@query(f"""WITH q AS (SELECT id, arg_min({_USER}, row_ord) AS question FROM sft_records GROUP BY id)
SELECT 'p1-gsm8k-' || lpad(c.row_ord::VARCHAR, 6, '0') AS id, question AS prompt, text AS response, CASE WHEN contains(text, '####') THEN {_strip('string_split(text, ' + chr(39) + '####' + chr(39) + ')[-1]')} END AS gold, 'general_gsm8k' AS task_family FROM candidates c JOIN q ON c.source_record_id = q.id WHERE {_strip('question')} <> '' AND {_strip('text')} <> ''""")
def source_records(spark, d):
    """Candidates as rows of a public source, made into supervised records."""
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    q = table(spark, d, "sft_records").where("id is not null").groupBy(F.col("id").alias("source_record_id")).agg(F.min_by(user, "row_ord").alias("question"))
    rows = table(spark, d, "candidates").join(q, "source_record_id").select("row_ord", "question", F.col("text").alias("answer"))
    r = records.supervised(records.adapted(rows, "gsm8k", "row_ord"), "gsm8k", "row_ord", "openai/gsm8k")
    return r.select("id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("response"), F.col("metadata")["gold_answer"].alias("gold"), "task_family")


@query(f"WITH {_JUDGED}, p AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY length({_strip('text')}), cand_index, row_ord) AS rank FROM scored WHERE status = 'passed') SELECT CASE WHEN contains(source_record_id, 'p1-') THEN substr(source_record_id, 1, instr(source_record_id, 'p1-') - 1) || 'p1rs-' || substr(source_record_id, instr(source_record_id, 'p1-') + 3) ELSE source_record_id END AS id, {_strip('text')} AS answer, gold, source_record_id AS parent_id, 'rejection-sampling:' || coalesce(model_id, '?') AS source_id FROM p WHERE rank = 1")
def accepted_records(spark, d):
    j = _judged(spark, d).withColumn("prompt", F.lit(""))
    best = corpus.rejection_sample(j, "source_record_id", "text", F.col("verdict.status") == "passed", ["cand_index", "row_ord"])
    r = records.accepted_records(best, "source_record_id", "prompt", "text", "gold", "model_id", "task_family")
    return r.select("id", F.col("messages")[1]["content"].alias("answer"), F.col("metadata")["gold_answer"].alias("gold"), F.col("metadata")["parent_id"].alias("parent_id"), "provenance.source_id")


@query(f"WITH taken AS ({_SEQUENTIAL}), n AS (SELECT count(*) AS n FROM taken) SELECT source, count(*) AS n, 42 AS seed, (SELECT n - least(n, 100) FROM n) AS train_records, (SELECT least(n, 100) FROM n) AS holdout_records FROM taken GROUP BY source")
def mixture_manifest(spark, d):
    m = records.mixture_manifest(sequential_mixture(spark, d), "source", 42, 100)
    return m.select(F.explode("per_source").alias("source", "n"), "seed", "train_records", "holdout_records")


@query(f"WITH {_JUDGED} SELECT candidate_id AS id, coalesce(task_family, 'unknown') AS task_family, text AS prediction, gold AS gold_answer, status = 'passed' AS passed FROM scored")
def prediction_dump(spark, d):
    return records.prediction_rows(_judged(spark, d), "candidate_id", "task_family", "text", "gold")


_PAIRED = "e AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY md5('7-' || row_ord), row_ord) AS rank FROM scored WHERE status IN ('passed', 'failed')), g AS (SELECT source_record_id, count(*) AS n, max(text) FILTER (WHERE rank = 1) AS ct, max(text) FILTER (WHERE rank = 2) AS rt, max(status) FILTER (WHERE rank = 1) AS cs FROM e GROUP BY 1)"


@query(f"WITH {_JUDGED}, {_PAIRED} SELECT source_record_id, unnest(list_filter([CASE WHEN {_strip('ct')} = {_strip('rt')} THEN 'identical_texts' END, CASE WHEN cs <> 'passed' THEN 'chosen_not_passed' END], lambda x: x IS NOT NULL)) AS rule FROM g WHERE n >= 2")
def preference_violations(spark, d):
    """What keeps pairs drawn at random from being ranked ones."""
    j = _judged(spark, d).where(F.col("verdict.status").isin("passed", "failed"))
    key = F.struct(F.md5(F.concat(F.lit("7-"), F.col("row_ord").cast("string"))), F.col("row_ord"))
    row = F.struct("text", F.col("verdict.status").alias("status"))
    first = j.groupBy("source_record_id").agg(F.count("*").alias("n"), F.min_by(row, key).alias("c"), F.min(key).alias("k"))
    rest = j.join(first.select("source_record_id", "k"), "source_record_id").where(key > F.col("k")).groupBy("source_record_id").agg(F.min_by(row, key).alias("r"))
    p = first.where("n >= 2").join(rest, "source_record_id").select("source_record_id", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"), F.col("c.status").alias("chosen_status"), F.lit("hybrid_verifier_rank").alias("selection_method"))
    return contracts.violations(p, "source_record_id", contracts.preference_rules(p))


def _mined_records(spark: SparkSession, d: str) -> DataFrame:
    return records.pair_records(pairs.mine(_judged(spark, d), "source_record_id", "text", "cand_index", "row_ord"), "source_record_id", "1")


def _mined_sql() -> str:
    from .catalogue import _MINED

    return _MINED


@query(_mined_sql() + " SELECT 'pair-' || source_record_id AS id, ct AS chosen, rt AS rejected, 'passed' AS chosen_status, rs AS rejected_score, round(cs - rs, 6) AS score_margin FROM m WHERE decision = 'accepted'")
def pair_records(spark, d):
    return _mined_records(spark, d).select("id", "chosen", "rejected", F.col("chosen_verification.status").alias("chosen_status"), F.col("rejected_verification.score").alias("rejected_score"), "score_margin")


@query(_mined_sql() + ", c AS (SELECT d.decision, count(m.decision) AS n FROM (VALUES ('accepted'), ('no_passed_candidate'), ('insufficient_margin'), ('insufficient_candidates'), ('identical_texts')) d(decision) LEFT JOIN m ON m.decision = d.decision GROUP BY 1) SELECT decision, n, (SELECT count(*) FROM m) AS prompts_processed, (SELECT count(*) FROM m WHERE decision = 'accepted') AS pairs_accepted, 'hybrid_verifier_rank' AS selection_method, 0.1::DOUBLE AS minimum_margin, 42 AS seed FROM c")
def mining_manifest(spark, d):
    m = stage(pairs.mine(_judged(spark, d), "source_record_id", "text", "cand_index", "row_ord").select("source_record_id", "decision"), "mined")
    out = records.mining_manifest(m, pairs.decision_counts(m), "hybrid_verifier_rank", 0.1, 42)
    return out.select(F.explode("decision_counts").alias("decision", "n"), "prompts_processed", "pairs_accepted", "selection_method", "minimum_margin", "seed")


@query(_mined_sql() + f", q AS (SELECT id, arg_min(array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'assistant'), lambda m: m.content), chr(10)), row_ord) AS prompt FROM sft_records GROUP BY id) SELECT prompt, ct AS chosen, rt AS rejected FROM m JOIN q ON m.source_record_id = q.id WHERE decision = 'accepted'")
def preference_rows(spark, d):
    prompt = F.filter("messages", lambda m: m["role"] != "assistant")
    q = table(spark, d, "sft_records").where("id is not null").groupBy(F.concat(F.lit("pair-"), "id").alias("id")).agg(F.min_by(prompt, "row_ord").alias("prompt"))
    return records.trainer_rows("dpo", _mined_records(spark, d).join(q, "id"), "preference")


@query("SELECT item_text AS prompt, '{\"family\":' || to_json(scenario_family_id)::VARCHAR || '}' AS scenario FROM eval_items")
def rollout_rows(spark, d):
    e = table(spark, d, "eval_items").select(F.array(F.struct(F.lit("user").alias("role"), F.col("item_text").alias("content"))).alias("prompt"), F.to_json(F.struct(F.col("scenario_family_id").alias("family"))).alias("scenario"))
    return records.trainer_rows("grpo", e, "evaluation")


# --- worlds built for training ---------------------------------------------


@query("SELECT * FROM (VALUES ('train-fam0', 400, true), ('train-fam1', 400, true), ('train-fam2', 400, true), ('train-fam3', 400, true), ('train-fam4', 400, true)) t(family, scenarios, targets_pass)")
def training_build(spark, d):
    """Training worlds by family: how many there are, and whether every solved one's target passes all verifiers and has two records."""
    s = stage(records.solved_worlds(spark, forbidden=tuple(f"{k.replace('_', '-')}-fam{i}" for k, (n, _) in world.SUITES.items() for i in range(n))), "solved")
    v = verify.world_verdicts(s.where("solvable").drop("actions"), "target").groupBy("family").agg(F.count_if(~F.coalesce((F.col("verdict.status") == "passed") & (F.col("verdict.score") == 1.0) & (F.col("consistency_verdict.status") == "passed"), F.lit(False))).alias("bad"), F.count("*").alias("solved"))
    both = [r.groupBy(F.col("scenario_family_id").alias("family")).agg(F.count("*").alias(f"n{k}")) for k, r in enumerate(records.training_records(s))]
    g = s.groupBy("family").agg(F.count("*").cast("int").alias("scenarios")).join(v, "family").join(both[0], "family").join(both[1], "family")
    return g.select("family", "scenarios", (F.col("bad") + F.abs(F.col("solved") - F.col("n0")) + F.abs(F.col("solved") - F.col("n1")) == 0).alias("targets_pass"))


_TWO = '{"locations":["loc_0","loc_1"],"edges":[["loc_0","loc_1"]],"resources":[{"resource_id":"res_0","location_id":"loc_1"}],"deposit_location":"loc_0"}\n{"location":"loc_0","energy":6}\n{"kind":"deposit_resources","resources":{"res_0":1},"step_limit":8}'
_STEPS = '{"type":"MOVE","target":"loc_1"},{"type":"COLLECT","resource":"res_0"},{"type":"MOVE","target":"loc_0"},{"type":"DEPOSIT","resource":"res_0"}'


@query("SELECT * FROM (VALUES ('good', 'passed', 'weighted_aggregation', 1.0::DOUBLE, 1.0::DOUBLE, 4), ('illegal', 'failed', 'required_component_failed', 0.0, 0.0, 4), ('malformed', 'failed', 'gate_failed:malformed_json', 0.0, 0.0, 4), ('lying', 'failed', 'required_component_failed', 0.8, 0.0, 4)) t(name, status, reason_code, score, reward, shortest)")
def fixture_verdicts(spark, d):
    """Four outputs for a world of two places, and the length of its shortest plan."""
    claim = lambda e: f'{{"actions":[{_STEPS}],"final_state":{{"location":"loc_0","energy":{e}}}}}'
    rows = [("good", claim(3)), ("illegal", '{"actions":[{"type":"COLLECT","resource":"res_0"}]}'), ("malformed", "plain prose"), ("lying", claim(99))]
    w, s, g = world.scenario_columns(F.lit(_TWO))
    f = world.solve(verify.world_verdicts(spark.createDataFrame(rows, "name string, text string").select("name", "text", w.alias("world"), s.alias("state0"), g.alias("goal")), "text"))
    return f.select("name", "verdict.status", "verdict.reason_code", "verdict.score", verify.reward(F.col("verdict")).alias("reward"), F.col("plan.n_actions").alias("shortest"))


# --- files -----------------------------------------------------------------

_LINE = """'{"id":' || to_json(id)::VARCHAR || ',"prompt":[{"content":' || to_json(item_text)::VARCHAR || ',"role":"user"}],"provenance":{"created_at":null,"generator_model":null,"source_id":"items","source_revision":null,"source_type":"synthetic","transformation_version":"v1"},"scenario":null,"scenario_family_id":' || coalesce(to_json(scenario_family_id)::VARCHAR, 'null') || ',"schema_version":"1.0","suite":' || to_json(suite)::VARCHAR || '}'"""


def _home(spark: SparkSession, name: str) -> str:
    return f"{stage_home(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT 'evaluation' AS kind, count(*) AS n, count(DISTINCT scenario_family_id) AS families, 'sha256:' || sha256('[' || string_agg({_LINE}, ',' ORDER BY item_id) || ']') AS fingerprint FROM eval_items")
def bundle_round_trip(spark, d):
    """Evaluation records written as canonical lines and loaded again through all gates, with the fingerprint that writing gave."""
    none = F.lit(None).cast("string")
    e = table(spark, d, "eval_items").select(
        "item_id", F.lit("1.0").alias("schema_version"), "id", "suite", none.alias("scenario"), F.array(F.struct(F.lit("user").alias("role"), F.col("item_text").alias("content"))).alias("prompt"), "scenario_family_id",
        F.struct(F.lit("synthetic").alias("source_type"), F.lit("items").alias("source_id"), none.alias("source_revision"), none.alias("generator_model"), F.lit("v1").alias("transformation_version"), none.alias("created_at")).alias("provenance"),
    )
    home = _home(spark, "bundle")
    mark = jsonl.write_canonical(e.coalesce(1), home, "item_id")
    _, manifest = jsonl.load(spark, home, "evaluation", expected=mark)
    return manifest.select("kind", "n", F.size("families").cast("long").alias("families"), "fingerprint")


@query("SELECT suite, count(*) AS n, count(prediction) AS n_text, count(DISTINCT row_ord) AS n_rows FROM traces WHERE suite IS NOT NULL GROUP BY suite")
def trace_files(spark, d):
    """Traces written in a folder per suite and read again, tolerant of lines that are no records."""
    t = table(spark, d, "traces").where("suite is not null").select("row_ord", "id", "suite", F.col("suite").alias("folder"), "prediction")
    home = _home(spark, "traces")
    jsonl.write_canonical(t, home, by="folder")
    spark.range(3).select(F.concat(F.lit("{broken "), "id").alias("value")).coalesce(1).write.text(f"{home}/folder=none")
    r = jsonl.read_tolerant(spark, home, "row_ord long, id string, suite string, prediction string", "*.txt")
    return r.groupBy("suite").agg(F.count("*").alias("n"), F.count("prediction").alias("n_text"), F.countDistinct("row_ord").alias("n_rows"))


_NATION = "string_agg('{\"n_name\":' || to_json(n_name)::VARCHAR || ',\"n_nationkey\":' || n_nationkey || '}' || chr(10), '' ORDER BY n_nationkey)"


@query(f"WITH f AS (SELECT {_NATION} AS t FROM nation) SELECT octet_length(encode(t)) AS bytes, sha256(t) AS sha256, 'sha256:' || sha256('[[\"lines\",\"sha256:' || sha256(t) || '\"]]') AS folder FROM f")
def file_audit(spark, d):
    """Size and hash of a file of canonical lines, and the fingerprint of its folder."""
    home = _home(spark, "files")
    jsonl.write_canonical(table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("o")).coalesce(1), home, "o")
    h = stage(files.file_hashes(spark, home, "*.txt").where("bytes > 0").select(F.lit("lines").alias("path"), "bytes", "sha256"), "hashes")
    return h.crossJoin(F.broadcast(files.folder_fingerprint(h))).select("bytes", "sha256", F.col("fingerprint").alias("folder"))


@query("SELECT 'checkpoint-' || max(step) AS name, max(step) AS step FROM (SELECT TRY_CAST(regexp_extract(model_id, '-(\\d+)$', 1) AS BIGINT) AS step FROM candidates)")
def latest_checkpoint(spark, d):
    names = table(spark, d, "candidates").select(F.concat(F.lit("checkpoint-"), F.regexp_extract("model_id", r"-(\d+)$", 1)).alias("name"))
    return files.latest(names.unionByName(spark.createDataFrame([("other-99999999",)], "name string")), "name")


_KEY = "trim(family_label)"


@query(f"WITH k AS (SELECT DISTINCT {_KEY} AS name FROM families WHERE family_label IS NOT NULL) SELECT family_key, CASE WHEN label_field = 'task_family' AND forked_from IS NOT NULL THEN 'parent_unused' WHEN label_field <> 'task_family' AND forked_from IS NULL THEN 'parent_missing' WHEN label_field <> 'task_family' AND k.name IS NULL THEN 'parent_unknown' WHEN label_field <> 'task_family' AND family_key % 2 = 0 AND md5(trim(forked_from)) <> md5(k.name || '!') THEN 'hash_mismatch' END AS finding FROM families f LEFT JOIN k ON trim(f.forked_from) = k.name WHERE finding IS NOT NULL")
def lineage_gate(spark, d):
    """Forks of families as continued runs; labels' hashes stand in for those of adapters."""
    f = table(spark, d, "families")
    mode = F.when(F.col("label_field") == "task_family", "from_base").otherwise("continue_training_existing_adapter")
    known = f.select(F.trim("family_label").alias("name"), F.md5(F.concat(F.trim("family_label"), F.lit("!"))).alias("hash"))
    return lineage.lineage_findings(f, "family_key", mode, F.trim("forked_from"), F.when(F.col("family_key") % 2 == 0, F.md5(F.trim("forked_from"))), known, "name", "hash")
