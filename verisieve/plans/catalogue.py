"""Named queries of the engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, draws, text
from ..operators import audit, contracts, corpus, ordering, pairs, selection, stats, verify, world
from ..sources.tables import stage, table
from . import world_sql
from .shipping import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = prepared(f)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL fragments that mean what functions/text.py does.
_SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace(lower({_strip(x)}), '{_SP}+', ' ', 'g')"


def _line_after(marker: str, x: str) -> str:
    tail = _strip(f"regexp_extract({x}, '(?is)^.*{marker}(.*)$', 1)")
    return f"nullif({_strip(f'regexp_extract({tail}, {chr(39)}^([^\\n\\r]*){chr(39)}, 1)')}, '')"


_NUM = r"(-?\d[\d,]*(?:\.\d+)?)"


def _last_number(x: str) -> str:
    return f"list_extract(regexp_extract_all({x}, '{_NUM}', 1), -1)"


def _final(x: str) -> str:
    boxed = f"list_extract(regexp_extract_all({x}, '\\\\boxed\\{{([^}}]*)\\}}', 1), -1)"
    return f"coalesce({_strip(boxed)}, {', '.join(_line_after(m, x) for m in ('####', 'answer:', 'final answer:', '정답:'))}, {_last_number(x)})"


def _number(x: str) -> str:
    plain = f"regexp_replace(replace(replace({x}, ',', ''), '$', ''), '\\.+$', '')"
    return f"CASE WHEN regexp_matches({plain}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST({plain} AS DOUBLE) END"


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def _poisson(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c})::INT" for c in draws.POISSON) + ")"


#: Resamples and sign flips.
_B = 10_000

_JUDGED = f"""
gold AS (SELECT id, arg_min(metadata['gold_answer'], row_ord) FILTER (WHERE metadata['gold_answer'] IS NOT NULL) AS gold, arg_min(task_family, row_ord) AS task_family FROM sft_records GROUP BY id),
found AS (SELECT c.row_ord, c.candidate_id, c.request_id, c.source_record_id, c.text, c.cand_index, c.model_id, g.gold, g.task_family, {_final("c.text")} AS answer FROM candidates c LEFT JOIN gold g ON c.source_record_id = g.id),
judged AS (SELECT *, CASE WHEN gold IS NULL THEN 'skipped' WHEN answer IS NULL THEN 'failed' WHEN coalesce(CASE WHEN ({_number("answer")}) IS NOT NULL AND ({_number("gold")}) IS NOT NULL THEN abs(({_number("answer")}) - ({_number("gold")})) < 1e-6 ELSE {_squeeze("answer")} = {_squeeze("gold")} END, false) THEN 'passed' ELSE 'failed' END AS status FROM found),
scored AS (SELECT *, CASE status WHEN 'skipped' THEN 'no_gold_answer' WHEN 'passed' THEN 'answer_match' ELSE CASE WHEN answer IS NULL THEN 'no_final_answer' ELSE 'answer_mismatch' END END AS reason_code, CASE status WHEN 'passed' THEN 1.0 WHEN 'failed' THEN 0.0 END::DOUBLE AS score FROM judged)
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the verdict of their final answer against the source record's gold answer."""
    g = table(spark, d, "sft_records").groupBy(F.col("id").alias("source_record_id")).agg(F.min_by(F.col("metadata")["gold_answer"], F.when(F.col("metadata")["gold_answer"].isNotNull(), F.col("row_ord"))).alias("gold"), F.min_by("task_family", "row_ord").alias("task_family"))
    c = table(spark, d, "candidates").select("row_ord", "candidate_id", "request_id", "source_record_id", "text", "cand_index", "model_id")
    return verify.exact_answers(c.join(g, "source_record_id", "left"), "text", "gold")


# --- contracts -------------------------------------------------------------


@query(
    f"""WITH r AS (SELECT row_ord, messages, len(messages) AS n FROM sft_records)
SELECT row_ord, unnest(list_filter([
 CASE WHEN len(list_filter(messages, lambda m: coalesce({_strip('m.content')} = '', true))) > 0 THEN 'blank_content' END,
 CASE WHEN n < 2 THEN 'too_few_messages' END,
 CASE WHEN n > 0 AND coalesce(messages[-1].role <> 'assistant', true) THEN 'last_not_assistant' END,
 CASE WHEN n > 0 AND len(list_filter(messages, lambda m: m.role = 'user')) = 0 THEN 'no_user' END], lambda x: x IS NOT NULL)) AS rule FROM r"""
)
def sft_contract_violations(spark, d):
    r = table(spark, d, "sft_records")
    return contracts.violations(r, "row_ord", contracts.conversation_rules(F.col("messages")))


@query("SELECT id, count(*) AS n FROM sft_records WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return contracts.duplicate_keys(table(spark, d, "sft_records").select("id"), "id")


@query("""SELECT row_ord, scenario_family_id FROM sft_records WHERE split_name = 'train' AND scenario_family_id IN (SELECT scenario_family_id FROM sft_records WHERE split_name <> 'train' AND scenario_family_id IS NOT NULL)""")
def leakage_gate(spark, d):
    r = table(spark, d, "sft_records").select("row_ord", "scenario_family_id", "split_name")
    return contracts.leaking(r.where("split_name = 'train'"), r.where("split_name <> 'train'"), "scenario_family_id").select("row_ord", "scenario_family_id")


@query("""SELECT row_ord FROM sft_records s WHERE split_name = 'train' AND NOT EXISTS (SELECT 1 FROM sft_records e WHERE e.split_name <> 'train' AND e.scenario_family_id = s.scenario_family_id)""")
def leak_free_training(spark, d):
    r = table(spark, d, "sft_records").select("row_ord", "scenario_family_id", "split_name")
    return contracts.without_leaks(r.where("split_name = 'train'"), r.where("split_name <> 'train'"), "scenario_family_id").select("row_ord")


@query("""SELECT scenario_family_id FROM sft_records WHERE split_name = 'train' AND scenario_family_id IS NOT NULL INTERSECT SELECT scenario_family_id FROM sft_records WHERE split_name IN ('validation', 'holdout', 'test')""")
def shared_families(spark, d):
    r = table(spark, d, "sft_records").select("scenario_family_id", "split_name")
    return contracts.shared_keys(r.where("split_name = 'train'"), r.where(F.col("split_name").isin("validation", "holdout", "test")), "scenario_family_id")


@query("""WITH a AS (SELECT DISTINCT id FROM traces), b AS (SELECT DISTINCT id FROM eval_items)
SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.id IS NULL) AS n_only_a, count(*) FILTER (WHERE a.id IS NULL) AS n_only_b FROM a FULL JOIN b ON a.id = b.id""")
def id_set_gate(spark, d):
    return contracts.id_set_difference(table(spark, d, "traces"), table(spark, d, "eval_items"), ["id"])


@query("""SELECT r.run_id, s.suite FROM (SELECT DISTINCT run_id FROM traces) r, (SELECT DISTINCT suite FROM eval_items) s WHERE NOT EXISTS (SELECT 1 FROM traces t WHERE t.run_id = r.run_id AND t.suite = s.suite)""")
def missing_suites(spark, d):
    return contracts.missing_members(table(spark, d, "traces").select("run_id", "suite"), "run_id", "suite", table(spark, d, "eval_items").select("suite"))


@query("""WITH l AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events)
SELECT user_id, before, after FROM l WHERE NOT coalesce(CASE WHEN before IS NULL THEN after = 'pending' ELSE (before = 'view' AND after IN ('click', 'view')) OR (before = 'click' AND after IN ('purchase', 'view')) END, false)""")
def illegal_moves(spark, d):
    return contracts.illegal_moves(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], {"view": ("click", "view"), "click": ("purchase", "view")})


@query("""WITH a AS (SELECT suite, count(*) AS n FROM eval_items GROUP BY suite), b AS (SELECT suite, count(DISTINCT id) AS n FROM traces GROUP BY suite)
SELECT coalesce(a.suite, b.suite) AS suite, b.n AS actual, a.n AS expected FROM b FULL JOIN a ON a.suite = b.suite WHERE a.n IS DISTINCT FROM b.n""")
def frozen_sizes(spark, d):
    n = lambda t, c: table(spark, d, t).groupBy("suite").agg(c.alias("n"))
    return contracts.mismatched(n("traces", F.countDistinct("id")), n("eval_items", F.count("*")), "suite", "n")


# --- fingerprints ----------------------------------------------------------

_ITEM = "'{\"gold_answer\":' || coalesce(to_json(gold_answer)::VARCHAR, 'null') || ',\"id\":' || to_json(id)::VARCHAR || ',\"item_id\":' || item_id || ',\"item_text\":' || coalesce(to_json(item_text)::VARCHAR, 'null') || ',\"suite\":' || to_json(suite)::VARCHAR || '}'"


_ITEM_COLUMNS = ["gold_answer", "id", "item_id", "item_text", "suite"]


@query(f"SELECT item_id, 'sha256:' || sha256({_ITEM}) AS fingerprint FROM eval_items")
def row_fingerprints(spark, d):
    e = table(spark, d, "eval_items")
    return e.select("item_id", canonical.row_fingerprints(e, _ITEM_COLUMNS).alias("fingerprint"))


@query(f"SELECT 'sha256:' || sha256('[' || string_agg({_ITEM}, ',' ORDER BY item_id) || ']') AS fingerprint FROM eval_items")
def dataset_fingerprint(spark, d):
    return canonical.list_fingerprint(table(spark, d, "eval_items"), "item_id", _ITEM_COLUMNS)


_TREE = "SELECT doc_id AS k, sha256('{\"doc_id\":' || doc_id || ',\"n_chars\":' || n_chars || ',\"text\":' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS h FROM documents"
for _ in range(4):
    _TREE = f"SELECT floor(k / 4096.0)::BIGINT AS k, sha256(string_agg(h, ',' ORDER BY k)) AS h FROM ({_TREE}) GROUP BY 1"


@query(f"SELECT 'sha256-tree:' || sha256(string_agg(h, ',' ORDER BY k)) AS fingerprint FROM ({_TREE})")
def tree_fingerprint(spark, d):
    return canonical.tree_fingerprint(table(spark, d, "documents"), "doc_id", ["doc_id", "n_chars", "text"])


# --- texts and answers -----------------------------------------------------


@query(f"SELECT row_ord, {_final('text')} AS answer, {_last_number('text')} AS last_number FROM candidates")
def final_answer(spark, d):
    return table(spark, d, "candidates").select("row_ord", text.final_answer(F.col("text")).alias("answer"), text.last_number(F.col("text")).alias("last_number"))


@query(f"WITH {_JUDGED} SELECT row_ord, status, reason_code, score FROM scored")
def exact_answer_verdict(spark, d):
    return _judged(spark, d).select("row_ord", "verdict.status", "verdict.reason_code", "verdict.score")


@query(f"WITH {_JUDGED} SELECT task_family AS family, grouping(task_family)::BIGINT AS overall, count(*) AS n, round(avg((status = 'passed')::INT::DOUBLE), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((), (task_family))")
def family_accuracy(spark, d):
    return stats.accuracy(_judged(spark, d), "task_family").withColumn("overall", F.col("overall").cast("long"))


@query(f"WITH {_JUDGED} SELECT status, count(*) AS n, sum(CASE status WHEN 'passed' THEN coalesce(score, 1.0) WHEN 'failed' THEN 0.0 END) AS reward FROM scored GROUP BY status")
def reward_map(spark, d):
    j = _judged(spark, d)
    return j.groupBy("verdict.status").agg(F.count("*").alias("n"), F.sum(verify.reward(F.col("verdict"))).alias("reward"))


_REPEATS = "CASE WHEN length(prediction) >= 32 THEN contains(substr(prediction, greatest(length(prediction) - 544, 0) + 1, greatest(length(prediction) - 32 - greatest(length(prediction) - 544, 0), 0)), right(prediction, 32)) ELSE false END"


@query(f"SELECT run_id, count(*) AS n, count(*) FILTER (WHERE coalesce({_REPEATS}, false)) AS runaway, round(avg(coalesce({_REPEATS}, false)::INT::DOUBLE), 6) AS share FROM traces GROUP BY run_id")
def runaway_tail(spark, d):
    r = text.tail_repeats(F.col("prediction"))
    return table(spark, d, "traces").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(r).alias("runaway"), F.round(F.avg(r.cast("double")), 6).alias("share"))


@query("SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object(text.json_span(F.col("props")), "$.k").try_cast("long")).alias("k"))


@query("SELECT row_ord, array_to_string(list_transform(list_slice(messages, 1, len(messages) - 1), lambda m: m.content), chr(10)) AS prompt, messages[-1].content AS completion FROM sft_records WHERE len(messages) > 1")
def training_rows(spark, d):
    m = F.col("messages")
    r = table(spark, d, "sft_records").where(F.size(m) > 1)
    return r.select("row_ord", text.joined_prompt(F.slice(m, F.lit(1), F.size(m) - 1)).alias("prompt"), text.completion_text(m).alias("completion"))


# --- worlds ----------------------------------------------------------------


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sft_records")
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    # The questions name no cost of collecting, and their answers count none.
    w, s0, g = world.scenario_columns(F.col("question"), collect_cost=0)
    q = s.select("id", "row_ord", user.alias("question")).where(F.col("question").contains('"locations"'))
    q = q.groupBy("id").agg(F.min_by("question", "row_ord").alias("question"))
    return q.select(F.col("id").alias("source_record_id"), w.alias("world"), s0.alias("state0"), g.alias("goal")).where("world is not null and state0 is not null and goal is not null")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("row_ord", "source_record_id", "request_id", "cand_index", "text", "model_id", "completion_tokens")
    return verify.world_verdicts(c.join(_scenarios(spark, d), "source_record_id"), "text")


@query(world_sql.REPLAY)
def world_replay(spark, d):
    v = _verdicts(spark, d)
    return v.select("row_ord", "parsed.reason", "episode.reached", F.col("episode.reason").alias("end"), "episode.steps", F.col("episode.state.energy").alias("energy"), F.col("legality.legal").alias("legal"))


@query(world_sql.VERDICT)
def hybrid_verdict(spark, d):
    return _verdicts(spark, d).select("row_ord", "verdict.status", "verdict.reason_code", "verdict.score")


@query(world_sql.STEPS)
def world_step_trace(spark, d):
    c = table(spark, d, "candidates").select("row_ord", "source_record_id", "text").join(_scenarios(spark, d), "source_record_id")
    from ..functions.actions import plan

    return world.step_trace(c.withColumn("actions", plan(F.col("text"))["actions"]), ["row_ord"])


@query(world_sql.LEGAL)
def world_legal_actions(spark, d):
    return world.legal_actions(_scenarios(spark, d), ["source_record_id"])


@query()
def world_shortest_plans(spark, d):
    p = world.solve(_scenarios(spark, d))
    return p.select("source_record_id", "plan.solvable", "plan.n_actions")


@query()
def scenario_suites(spark, d):
    s = world.solve(world.scenario_suites(spark))
    return s.groupBy("suite").agg(F.count("*").alias("scenarios"), F.countDistinct("family").alias("families"), F.count_if("plan.solvable").alias("solvable"), F.max("plan.n_actions").alias("longest"))


# --- corpora ---------------------------------------------------------------


@query(f"WITH k AS (SELECT doc_id, {_squeeze('text')} AS t FROM documents) SELECT min(doc_id) AS doc_id FROM k WHERE t <> '' GROUP BY t")
def dedup_normalised(spark, d):
    k = table(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("t")).where("t <> ''")
    return k.groupBy(F.md5("t").alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def _taken_in_turn(sources: int) -> str:
    """Each source's quota in hash order without texts that sources before it took; the sources of the targets are few."""
    steps, before = [], []
    for k in range(sources):
        seen = " UNION ALL ".join(f"SELECT t FROM t{j}" for j in before) or "SELECT NULL::VARCHAR AS t WHERE false"
        steps.append(
            f"t{k} AS (SELECT doc_id, source, t FROM (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rank FROM (SELECT doc_id, source, t, h, row_number() OVER (PARTITION BY t ORDER BY h, doc_id) AS rn FROM docs WHERE place = {k + 1} AND t NOT IN ({seen})) WHERE rn = 1) "
            f"WHERE rank <= (SELECT quota FROM quotas WHERE place = {k + 1}))"
        )
        before.append(k)
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT doc_id, source FROM t{k}" for k in before)


_SEQUENTIAL = f"""WITH quotas AS (SELECT source, row_number() OVER (ORDER BY source) AS place, floor(((SELECT count(*) // 2 FROM documents) * target_share / (SELECT sum(target_share) FROM mix_targets))::DECIMAL(18, 6)) AS quota FROM mix_targets),
docs AS (SELECT d.doc_id, d.source, q.place, {_squeeze("d.text")} AS t, md5('42-' || d.doc_id) AS h FROM documents d JOIN quotas q ON d.source = q.source WHERE {_squeeze("d.text")} <> ''), {_taken_in_turn(12)}"""


@query(_SEQUENTIAL)
def sequential_mixture(spark, d):
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    weights = {r[0]: r[1] for r in targets.orderBy("source").select("source", "target_share").collect()}
    total = docs.count() // 2
    return corpus.sequential_mixture(docs.select("doc_id", "source", "text"), "source", weights, total, "text", "doc_id").select("doc_id", "source")


@query("WITH q AS (SELECT source, (target_share * (SELECT count(*) FROM documents) / 2)::DECIMAL(18, 6) AS quota FROM mix_targets), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS rank FROM documents) SELECT r.source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM r JOIN q ON r.source = q.source WHERE rank <= floor(quota) GROUP BY r.source")
def mixture_quota(spark, d):
    docs, n = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "documents").count()
    quota = F.floor((F.col("target_share") * n / 2).cast("decimal(18,6)"))
    # The place among a source's rows: that among all rows by source, less the rows of sources before it.
    placed = ordering.ranked(docs.where("source is not null").withColumn("_h", draws.order_key(42, F.col("doc_id").cast("string"))), ["source", "_h", "doc_id"])
    first = placed.groupBy("source").agg(F.min("rank").alias("_first"))
    q = table(spark, d, "mix_targets").select("source", quota.alias("quota"))
    got = placed.join(first.join(q, "source"), "source").where("rank - _first + 1 <= quota")
    return got.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("WITH r AS (SELECT row_ord, row_number() OVER (ORDER BY md5('42-' || row_ord), row_ord) AS rank, count(*) OVER () AS n FROM sft_records) SELECT row_ord, CASE WHEN rank > n - 100 THEN 'holdout' ELSE 'train' END AS part FROM r")
def holdout_split(spark, d):
    return corpus.holdout(table(spark, d, "sft_records").select("row_ord"), "row_ord", 100)


@query("WITH r AS (SELECT family_key, row_number() OVER (ORDER BY md5('42-' || family_key), family_key) AS rank, count(*) OVER () AS n FROM families) SELECT family_key, CASE WHEN rank <= greatest(least(floor(n * 0.7), n - 1), 1) THEN 'train' ELSE 'eval' END AS part FROM r")
def family_split(spark, d):
    return corpus.family_split(table(spark, d, "families"), "family_key")


@query(f"SELECT row_ord FROM traces WHERE {_uniform(chr(39) + '42' + chr(39), 'row_ord::VARCHAR')} < 0.1")
def judge_sample(spark, d):
    return corpus.hash_sample(table(spark, d, "traces").select("row_ord"), "row_ord", 0.1)


@query("WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS upto, sum(n_chars) OVER () AS total FROM documents) SELECT doc_id FROM r WHERE upto <= total / 2")
def token_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    half = (docs.agg(F.sum("n_chars")).first()[0] or 0) / 2
    return corpus.within_budget(docs, ["doc_id"], "n_chars", F.lit(half)).select("doc_id")


@query(f"WITH {_JUDGED}, p AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY length({_strip('text')}), cand_index, row_ord) AS rank FROM scored WHERE status = 'passed') SELECT source_record_id, row_ord, candidate_id FROM p WHERE rank = 1")
def rejection_sampling(spark, d):
    j = _judged(spark, d).select("source_record_id", "row_ord", "candidate_id", "cand_index", "text", "verdict")
    return corpus.rejection_sample(j, "source_record_id", "text", F.col("verdict.status") == "passed", ["cand_index", "row_ord"]).select("source_record_id", "row_ord", "candidate_id")


@query(f"WITH {_JUDGED}, s AS (SELECT source_record_id, max((status = 'passed')::INT) AS ok FROM scored WHERE gold <> '' GROUP BY 1) SELECT count(*) AS verifiable, coalesce(sum(ok), 0)::BIGINT AS accepted, round(coalesce(sum(ok), 0) / greatest(count(*), 1), 4) AS rate FROM s")
def acceptance_rate(spark, d):
    s = _judged(spark, d).where("gold <> ''").groupBy("source_record_id").agg(F.max((F.col("verdict.status") == "passed").cast("int")).alias("ok"))
    ok = F.coalesce(F.sum("ok"), F.lit(0))
    return s.agg(F.count("*").alias("verifiable"), ok.alias("accepted"), F.round(ok / F.greatest(F.count("*"), F.lit(1)), 4).alias("rate"))


@query("SELECT row_ord, list_filter(messages, lambda m: m.role = 'user')[-1].content AS prompt, list_filter(messages, lambda m: m.role = 'assistant')[-1].content AS answer FROM sft_records WHERE trim(list_filter(messages, lambda m: m.role = 'user')[-1].content) <> '' AND trim(list_filter(messages, lambda m: m.role = 'assistant')[-1].content) <> '' ORDER BY row_ord LIMIT 4")
def few_shot_exemplars(spark, d):
    return corpus.exemplars(table(spark, d, "sft_records"), "messages", "row_ord", 4)


@query("WITH r AS (SELECT request_id, max(cand_index) + 1 AS n FROM candidates GROUP BY request_id), e AS (SELECT request_id, unnest(range(n)) AS cand_index FROM r) SELECT request_id, cand_index::BIGINT AS cand_index, request_id || '-c' || cand_index AS candidate_id FROM e")
def candidate_expansion(spark, d):
    r = table(spark, d, "candidates").groupBy("request_id").agg((F.max("cand_index") + 1).alias("n"))
    return corpus.expand_candidates(r, "request_id", "n").select("request_id", F.col("cand_index").cast("long").alias("cand_index"), "candidate_id")


@query("WITH m AS (SELECT DISTINCT regexp_extract(model_id, '^(.*)-\\d+$', 1) AS arm, TRY_CAST(regexp_extract(model_id, '-(\\d+)$', 1) AS BIGINT) AS step FROM candidates WHERE model_id IS NOT NULL), r AS (SELECT arm, step, row_number() OVER (PARTITION BY arm ORDER BY step DESC) AS age FROM m WHERE step IS NOT NULL) SELECT arm, step, age, age <= 2 AS kept FROM r")
def checkpoint_retention(spark, d):
    m = table(spark, d, "candidates").where("model_id is not null").select(F.regexp_extract("model_id", r"^(.*)-\d+$", 1).alias("arm"), F.regexp_extract("model_id", r"-(\d+)$", 1).try_cast("long").alias("s")).distinct()
    return corpus.newest(m, "arm", F.col("s"), 2).select("arm", "step", F.col("age").cast("long").alias("age"), "kept")


# --- preference pairs ------------------------------------------------------

_MINED = f"""WITH {_JUDGED},
e AS (SELECT *, coalesce(score, 0.0) AS sc, status IN ('passed', 'failed') AS el FROM scored),
k AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY CASE WHEN status = 'passed' THEN 0 ELSE 1 END, -sc, length(text) NULLS FIRST, cand_index, row_ord) AS best, row_number() OVER (PARTITION BY source_record_id ORDER BY CASE WHEN el THEN 0 ELSE 1 END, -sc DESC, length(text) DESC NULLS LAST, cand_index DESC, row_ord DESC) AS worst FROM e),
g AS (SELECT source_record_id, count(*) FILTER (WHERE el) AS n, max(row_ord) FILTER (WHERE best = 1 AND status = 'passed') AS cu, max(text) FILTER (WHERE best = 1 AND status = 'passed') AS ct, max(sc) FILTER (WHERE best = 1 AND status = 'passed') AS cs, max(row_ord) FILTER (WHERE worst = 1 AND el) AS ru, max(text) FILTER (WHERE worst = 1 AND el) AS rt, max(sc) FILTER (WHERE worst = 1 AND el) AS rs FROM k GROUP BY 1),
m AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient_candidates' WHEN cu IS NULL THEN 'no_passed_candidate' WHEN cu = ru THEN 'insufficient_candidates' WHEN {_strip('ct')} = {_strip('rt')} THEN 'identical_texts' WHEN cs - rs < 0.1 THEN 'insufficient_margin' ELSE 'accepted' END AS decision FROM g)"""


@query(_MINED + " SELECT source_record_id, decision, CASE WHEN decision = 'accepted' THEN cu END AS chosen, CASE WHEN decision = 'accepted' THEN ru END AS rejected, CASE WHEN decision = 'accepted' THEN round(cs - rs, 6) END AS score_margin FROM m")
def pair_mining(spark, d):
    return pairs.mine(_judged(spark, d), "source_record_id", "text", "cand_index", "row_ord").select("source_record_id", "decision", "chosen", "rejected", "score_margin")


@query(_MINED + " SELECT d.decision, count(m.decision) AS n FROM (VALUES ('accepted'), ('no_passed_candidate'), ('insufficient_margin'), ('insufficient_candidates'), ('identical_texts')) d(decision) LEFT JOIN m ON m.decision = d.decision GROUP BY 1")
def pair_decisions(spark, d):
    return pairs.decision_counts(pairs.mine(_judged(spark, d), "source_record_id", "text", "cand_index", "row_ord"))


@query(f"""WITH {_JUDGED}, e AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY md5('7-' || row_ord), row_ord) AS rank FROM scored WHERE status IN ('passed', 'failed')),
g AS (SELECT source_record_id, count(*) AS n, max(row_ord) FILTER (WHERE rank = 1) AS cu, max(text) FILTER (WHERE rank = 1) AS ct, max(row_ord) FILTER (WHERE rank = 2) AS ru, max(text) FILTER (WHERE rank = 2) AS rt FROM e GROUP BY 1),
m AS (SELECT s.source_record_id, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient_candidates' WHEN {_strip('ct')} = {_strip('rt')} THEN 'identical_texts' ELSE 'accepted' END AS decision, cu, ru FROM (SELECT DISTINCT source_record_id FROM scored) s LEFT JOIN g ON s.source_record_id = g.source_record_id)
SELECT source_record_id, decision, CASE WHEN decision = 'accepted' THEN cu END AS chosen, CASE WHEN decision = 'accepted' THEN ru END AS rejected FROM m""")
def random_pairing(spark, d):
    return pairs.random_pairs(_judged(spark, d), "source_record_id", "text", "row_ord").select("source_record_id", "decision", "chosen", "rejected")


# --- summaries and comparisons ---------------------------------------------


@query("SELECT suite, count(*) AS episodes, count(*) FILTER (WHERE verdict.status IN ('passed', 'failed')) AS eligible, round(avg((verdict.status = 'passed')::INT::DOUBLE) FILTER (WHERE verdict.status IN ('passed', 'failed')), 6) AS pass_rate, round(avg(coalesce(verdict.score, 0.0)) FILTER (WHERE verdict.status IN ('passed', 'failed')), 6) AS mean_score, NULL::DOUBLE AS legal_action_rate FROM traces GROUP BY suite")
def suite_summary(spark, d):
    return stats.suite_summary(table(spark, d, "traces"), ["suite"])


@query("SELECT suite, verdict.status AS status, count(*) AS n FROM traces GROUP BY 1, 2")
def status_counts(spark, d):
    return table(spark, d, "traces").groupBy("suite", F.col("verdict.status").alias("status")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT suite, coalesce(verdict.reason_code, 'unknown') AS reason_code, count(*) AS n, min(row_ord) AS o FROM traces WHERE verdict.status = 'failed' GROUP BY 1, 2) SELECT suite, reason_code, n, row_number() OVER (PARTITION BY suite ORDER BY n DESC, o) AS place FROM f")
def failure_taxonomy(spark, d):
    return stats.failure_taxonomy(table(spark, d, "traces"), ["suite"], "row_ord").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH v AS (SELECT suite, row_ord::VARCHAR AS k, (verdict.status = 'passed')::INT::DOUBLE AS v FROM traces WHERE verdict.status IN ('passed', 'failed')),
r AS (SELECT suite, b, v, {_poisson(_uniform("'42'", 'b::VARCHAR', 'k'))} AS w FROM v, range({_B}) t(b)),
m AS (SELECT suite, b, sum(w * v) / nullif(sum(w), 0) AS m FROM r GROUP BY 1, 2), s AS (SELECT suite, list(m ORDER BY m) AS s FROM m GROUP BY 1), p AS (SELECT suite, count(*) AS n, round(avg(v), 6) AS mean FROM v GROUP BY 1)
SELECT p.suite, p.n, p.mean, round(s[floor(0.025 * {_B})::INT + 1], 6) AS ci_low, round(s[least(floor(0.975 * {_B})::INT, {_B - 1}) + 1], 6) AS ci_high FROM p JOIN s ON p.suite = s.suite""")
def bootstrap_ci(spark, d):
    v = F.col("verdict")
    t = table(spark, d, "traces").select("suite", "row_ord", F.when(v["status"].isin("passed", "failed"), (v["status"] == "passed").cast("double")).alias("v"))
    return stats.poisson_bootstrap(t, ["suite"], F.col("v"), "row_ord", _B)


_EPISODES = "e AS (SELECT run_id, suite, id, arg_max(coalesce((verdict.status = 'passed')::INT::DOUBLE, 0.0), row_ord) AS passed, arg_max(coalesce(verdict.score, 0.0), row_ord) AS score FROM traces GROUP BY 1, 2, 3)"
_ENDS = "round({s}[floor(0.025 * len({s}))::INT + 1], 6) AS {low}, round({s}[least(floor(0.975 * len({s}))::INT, len({s}) - 1) + 1], 6) AS {high}"


def _ends(s: str, low: str = "ci_low", high: str = "ci_high") -> str:
    return _ENDS.format(s=s, low=low, high=high)


_SIDES = ("ap", "bp", "dp", "as_", "bs", "ds")
_COMPARED = f"""WITH {_EPISODES}, base AS (SELECT min(run_id) AS run_id FROM e),
pr AS (SELECT a.run_id, a.suite, a.suite || '/' || a.id AS k, a.passed AS ap, b.passed AS bp, a.passed - b.passed AS dp, a.score AS as_, b.score AS bs, a.score - b.score AS ds FROM e a JOIN e b ON a.suite = b.suite AND a.id = b.id AND b.run_id = (SELECT run_id FROM base) WHERE a.run_id <> (SELECT run_id FROM base)),
pt AS (SELECT run_id, suite, count(*) AS n, {", ".join(f"round(avg({x}), 6) AS m_{x}" for x in _SIDES)}, sum(dp) AS sp, sum(ds) AS ss FROM pr GROUP BY 1, 2),
bo AS (SELECT run_id, suite, x, {", ".join(f"sum(w * {c}) / nullif(sum(w), 0) AS {c}" for c in _SIDES)} FROM (SELECT *, {_poisson(_uniform("'42'", "x::VARCHAR", "k"))} AS w FROM pr, range({_B}) t(x)) GROUP BY 1, 2, 3),
so AS (SELECT run_id, suite, {", ".join(f"list({c} ORDER BY {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _SIDES)} FROM bo GROUP BY 1, 2),
fl AS (SELECT run_id, suite, x, sum(CASE WHEN h THEN dp ELSE -dp END) AS fp, sum(CASE WHEN h THEN ds ELSE -ds END) AS fs FROM (SELECT *, {_uniform("'flip42'", "x::VARCHAR", "k")} < 0.5 AS h FROM pr, range({_B}) t(x)) GROUP BY 1, 2, 3),
hi AS (SELECT fl.run_id, fl.suite, count(*) FILTER (WHERE abs(fp) >= abs(sp) - 1e-9) AS hp, count(*) FILTER (WHERE abs(fs) >= abs(ss) - 1e-9) AS hs FROM fl JOIN pt ON fl.run_id = pt.run_id AND fl.suite = pt.suite GROUP BY 1, 2),
long AS ({" UNION ALL ".join(f"SELECT pt.run_id, pt.suite, '{m}' AS metric, n, m_{a} AS mean_a, {_ends('so.' + a, 'low_a', 'high_a')}, m_{b} AS mean_b, {_ends('so.' + b, 'low_b', 'high_b')}, m_{c} AS delta, {_ends('so.' + c)}, round((1 + {h}) / {1 + _B}, 6) AS p_value FROM pt JOIN so ON pt.run_id = so.run_id AND pt.suite = so.suite JOIN hi ON pt.run_id = hi.run_id AND pt.suite = hi.suite" for m, a, b, c, h in (("pass_rate", "ap", "bp", "dp", "hp"), ("mean_score", "as_", "bs", "ds", "hs")))}),
compared AS (SELECT *, NOT (ci_low <= 0 AND ci_high >= 0) AS significant FROM long)"""


_DRAWN = _COMPARED + " SELECT run_id, suite, metric, CASE WHEN significant THEN 'YES' ELSE 'no' END AS sig FROM compared"


@query(_COMPARED + " SELECT * FROM compared")
def compare_runs(spark, d):
    return _compared(spark, d)


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return stage(stats.episode_scores(table(spark, d, "traces"), ["run_id", "suite", "id"], "row_ord"), "episodes")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """Every run against the first one by suite, on the episodes that both have."""
    e = _episodes(spark, d)
    base = e.agg(F.min("run_id").alias("base"))
    e = e.crossJoin(F.broadcast(base))
    b = e.where("run_id = base").select("suite", "id", F.col("passed").alias("bp"), F.col("score").alias("bs"))
    p = e.where("run_id <> base").join(b, ["suite", "id"]).select("run_id", "suite", F.concat_ws("/", "suite", "id").alias("k"), "passed", "score", "bp", "bs")
    return stats.compared_metrics(p, ["run_id", "suite"], {"pass_rate": (F.col("passed"), F.col("bp")), "mean_score": (F.col("score"), F.col("bs"))}, "k", _B)


@query(_COMPARED + """, t AS (SELECT run_id || '/' || suite AS test, p_value FROM compared WHERE metric = 'pass_rate'), r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS i, count(*) OVER () AS m FROM t)
SELECT test, p_value, round(max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i), 6) AS adjusted FROM r""")
def holm_bonferroni(spark, d):
    t = _compared(spark, d).where("metric = 'pass_rate'").select(F.concat_ws("/", "run_id", "suite").alias("test"), "p_value")
    return stats.holm(stage(t, "tests"), "p_value", "test")


_FILLED = f"coalesce({_strip('prediction')} <> '', false)"


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY run_id, suite, id ORDER BY row_ord) AS rn, count(*) OVER (PARTITION BY run_id, suite, id) AS copies FROM traces), f AS (SELECT * FROM d WHERE rn = 1)
SELECT run_id, count(*) AS rows, (sum(copies) - count(*))::BIGINT AS duplicates, count(DISTINCT suite) AS suites, count(*) FILTER (WHERE NOT {_FILLED}) AS empty, count(*) FILTER (WHERE {_FILLED} AND coalesce({_REPEATS}, false)) AS runaway, round(avg(({_FILLED} AND coalesce({_REPEATS}, false))::INT::DOUBLE), 4) AS runaway_rate, round(avg(length(coalesce(prediction, ''))), 6) AS mean_chars, max(length(coalesce(prediction, '')))::BIGINT AS max_chars FROM f GROUP BY run_id""")
def run_audit(spark, d):
    return audit.run_audit(table(spark, d, "traces")).withColumn("max_chars", F.col("max_chars").cast("long"))


def _plain(x: str) -> str:
    return f"regexp_replace(replace({x}, ',', ''), '\\.+$', '')"


_MARK = "coalesce(regexp_matches(lower(text), '####|answer:|정답:'), false)"
_AGAIN = _final("('#### ' || answer)")
_ALONE = f"coalesce(CASE WHEN ({_number('again')}) IS NOT NULL AND ({_number('gold')}) IS NOT NULL THEN abs(({_number('again')}) - ({_number('gold')})) < 1e-6 ELSE {_squeeze('again')} = {_squeeze('gold')} END, false)"


@query(f"""WITH {_JUDGED}, a AS (SELECT *, {_MARK} AS marked, {_AGAIN} AS again, {_last_number('text')} AS naive FROM scored WHERE text <> '' AND gold IS NOT NULL),
b AS (SELECT *, coalesce(marked AND {_plain('answer')} <> {_plain('naive')}, false) AS drift FROM a)
SELECT model_id, count(*) AS n, round(avg((status = 'passed')::INT::DOUBLE), 4) AS pass_rate, round(avg(marked::INT::DOUBLE), 4) AS marker_rate, count(*) FILTER (WHERE drift) AS drifted, count(*) FILTER (WHERE drift AND status <> 'passed' AND {_ALONE}) AS drift_failures FROM b GROUP BY model_id""")
def answer_drift(spark, d):
    return audit.answer_drift(_judged(spark, d), ["model_id"], "text", "gold", F.col("verdict.status") == "passed")


_QS = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


@query(f"WITH l AS (SELECT source, list(n_chars ORDER BY n_chars) AS s FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) SELECT source, len(s) AS n, q, s[round_even(q * (len(s) - 1), 0)::INT + 1] AS value FROM l, (VALUES {', '.join(f'({q}::DOUBLE)' for q in _QS)}) t(q)")
def length_percentiles(spark, d):
    return stats.nearest_rank(table(spark, d, "documents"), ["source"], "n_chars", list(_QS))


@query("WITH l AS (SELECT coalesce(len(array_to_string(list_transform(list_slice(messages, 1, len(messages) - 1), lambda m: m.content), chr(10))), 0) AS p, coalesce(len(array_to_string(list_transform(messages, lambda m: m.content), chr(10))), 0) AS f FROM sft_records), c AS (SELECT unnest([256, 512, 1024])::BIGINT AS cap) SELECT cap, count(*) AS n, count(*) FILTER (WHERE f > cap) AS truncated, count(*) FILTER (WHERE p >= cap) AS lost, count(*) FILTER (WHERE p < cap AND f > cap) AS partial FROM l, c GROUP BY cap")
def cap_audit(spark, d):
    m = F.col("messages")
    size = lambda x: F.coalesce(F.length(text.joined_prompt(x)), F.lit(0))
    r = table(spark, d, "sft_records").select(size(F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))).alias("p"), size(m).alias("f"))
    return audit.cap_audit(r, "p", "f", [256, 512, 1024]).withColumn("cap", F.col("cap").cast("long"))


@query("SELECT label, count(*) AS n, count(*) FILTER (WHERE list_min(embedding) = 0 AND list_max(embedding) = 0) AS zeros, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS mean_norm FROM embeddings GROUP BY label")
def tensor_norms(spark, d):
    n = audit.norms(table(spark, d, "embeddings"), "embedding")
    return n.groupBy("label").agg(F.count("*").alias("n"), F.count_if("zeros").alias("zeros"), F.round(F.avg("norm"), 4).alias("mean_norm"))


@query("WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), m AS (SELECT avg(norm) AS mean FROM n) SELECT vec_id, round(norm, 4) AS norm, round(norm / mean, 4) AS ratio, norm / mean > 10 AS outlier FROM n, m ORDER BY n.norm DESC, vec_id LIMIT 5")
def norm_outliers(spark, d):
    o = audit.norm_outliers(table(spark, d, "embeddings"), "embedding", "vec_id")
    return o.withColumn("norm", F.round("norm", 4)).withColumn("ratio", F.round("ratio", 4))


@query("""WITH t AS (SELECT label AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, embedding AS v FROM embeddings), s AS (SELECT f, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT x.f AS a, y.f AS b, count(*) AS common, count(*) FILTER (WHERE x.v = y.v) AS identical, max(list_max(list_transform(range(1, len(x.v) + 1), lambda i: abs(x.v[i]::DOUBLE - y.v[i]::DOUBLE)))) AS g FROM t x JOIN t y ON x.k = y.k AND x.f < y.f GROUP BY 1, 2)
SELECT p.f AS a, q.f AS b, coalesce(common, 0) AS common, p.n - coalesce(common, 0) AS only_a, q.n - coalesce(common, 0) AS only_b, coalesce(identical, 0) AS identical, round(g, 4) AS max_abs_diff FROM s p JOIN s q ON p.f < q.f LEFT JOIN m ON m.a = p.f AND m.b = q.f""")
def tensor_pairwise_diff(spark, d):
    t = table(spark, d, "embeddings").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return audit.tensor_differences(t, "label", "k", "embedding").withColumn("max_abs_diff", F.round("max_abs_diff", 4))


@query("SELECT vec_id, (len(list_filter(embedding, lambda x: x > embedding[1])) + 1)::BIGINT AS first_rank, round(list_sort(embedding, 'DESC')[1]::DOUBLE, 5) AS top, round(list_sort(embedding)[floor(0.9 * (len(embedding) - 1))::INT + 1]::DOUBLE, 5) AS q90 FROM embeddings")
def distribution_ranks(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", audit.stop_rank(v, F.lit(0)).cast("long").alias("first_rank"), F.round(F.get(audit.top_entries(v, 5), F.lit(0)).cast("double"), 5).alias("top"), F.round(audit.floor_quantile(v, 0.9).cast("double"), 5).alias("q90"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS head, round(list_avg(list_transform(embedding[9:], lambda x: x::DOUBLE)), 5) AS tail FROM embeddings")
def span_means(spark, d):
    head, tail = audit.span_means(F.col("embedding"), F.lit(8))
    return table(spark, d, "embeddings").select("vec_id", F.round(head, 5).alias("head"), F.round(tail, 5).alias("tail"))


# --- protocol statistics ---------------------------------------------------


@query("SELECT run_id, round(quantile_cont(verdict.latency_ms, 0.95), 6) AS p95, round(avg(verdict.latency_ms), 6) AS mean FROM traces GROUP BY run_id")
def latency(spark, d):
    x = F.col("verdict.latency_ms")
    return table(spark, d, "traces").groupBy("run_id").agg(F.round(F.percentile(x, 0.95), 6).alias("p95"), F.round(F.avg(x), 6).alias("mean"))


@query("SELECT run_id, count(*) FILTER (WHERE verdict.status = 'passed') AS valid, round(sum(verdict.latency_ms) / 1000 / nullif(count(*) FILTER (WHERE verdict.status = 'passed'), 0), 4) AS seconds_per_valid FROM traces GROUP BY run_id")
def cost_per_valid(spark, d):
    ok = F.count_if(F.col("verdict.status") == "passed")
    return table(spark, d, "traces").groupBy("run_id").agg(ok.alias("valid"), F.round(F.sum("verdict.latency_ms") / 1000 / F.nullif(ok, F.lit(0)), 4).alias("seconds_per_valid"))


@query("SELECT suite, round(avg((coalesce(verdict.reason_code, '') <> 'gate_failed:malformed_json')::INT::DOUBLE), 6) AS valid_json, round(avg((coalesce(verdict.reason_code, '') LIKE 'gate_failed:%')::INT::DOUBLE), 6) AS gate_failures FROM traces GROUP BY suite")
def validity_rate(spark, d):
    r = F.coalesce("verdict.reason_code", F.lit(""))
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, d, "traces").groupBy("suite").agg(mean(r != "gate_failed:malformed_json").alias("valid_json"), mean(r.startswith("gate_failed:")).alias("gate_failures"))


@query(f"""WITH x AS (SELECT row_ord::VARCHAR AS k, verdict.score AS a, verdict.latency_ms AS b FROM traces WHERE verdict.score IS NOT NULL AND verdict.latency_ms IS NOT NULL), r AS (SELECT k, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x),
u AS (SELECT k, ra / (SELECT avg(ra) FROM r) - 1 AS u, rb / (SELECT avg(ra) FROM r) - 1 AS v FROM r), w AS (SELECT *, {_poisson(_uniform("'42'", "x::VARCHAR", "k"))} AS w FROM u, range({_B}) t(x)),
q AS (SELECT x, sum(w) AS n, sum(w * u) AS a, sum(w * v) AS b, sum(w * u * u) AS aa, sum(w * v * v) AS bb, sum(w * u * v) AS ab FROM w GROUP BY x), z AS (SELECT list((n * ab - a * b) / sqrt((n * aa - a * a) * (n * bb - b * b)) ORDER BY (n * ab - a * b) / sqrt((n * aa - a * a) * (n * bb - b * b))) AS s FROM q WHERE (n * aa - a * a) * (n * bb - b * b) > 1e-9)
SELECT (SELECT count(*) FROM r) AS n, (SELECT round(corr(ra, rb), 6) FROM r) AS rho, {_ends("s")} FROM z""")
def spearman(spark, d):
    t = table(spark, d, "traces").select("row_ord", F.col("verdict.score").alias("a"), F.col("verdict.latency_ms").alias("b"))
    return stats.spearman(t, "a", "b", "row_ord", _B)


@query("WITH s AS (SELECT suite, run_id, avg((verdict.status = 'passed')::INT::DOUBLE) AS p FROM traces GROUP BY 1, 2) SELECT suite, count(*) AS runs, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd FROM s GROUP BY suite")
def seed_variance(spark, d):
    s = table(spark, d, "traces").groupBy("suite", "run_id").agg(F.avg(F.coalesce((F.col("verdict.status") == "passed").cast("double"), F.lit(0.0))).alias("p"))
    return s.groupBy("suite").agg(F.count("*").alias("runs"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("sd"))


_RUN_STATS = """m AS (SELECT run_id, round(avg((verdict.status = 'passed')::INT::DOUBLE), 6) AS pass_rate, round(avg((coalesce(verdict.reason_code, '') <> 'gate_failed:malformed_json')::INT::DOUBLE), 6) AS validity, round(avg(verdict.latency_ms), 4) AS mean_latency, round(avg(length(coalesce(prediction, ''))), 4) AS mean_chars FROM traces GROUP BY 1)"""


def _run_stats(spark: SparkSession, d: str) -> DataFrame:
    r = F.coalesce("verdict.reason_code", F.lit(""))
    return table(spark, d, "traces").groupBy("run_id").agg(
        F.round(F.avg((F.col("verdict.status") == "passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg((r != "gate_failed:malformed_json").cast("double")), 6).alias("validity"),
        F.round(F.avg("verdict.latency_ms"), 4).alias("mean_latency"), F.round(F.avg(F.length(F.coalesce("prediction", F.lit("")))), 4).alias("mean_chars"),
    )


@query(f"WITH {_RUN_STATS} SELECT run_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.pass_rate >= a.pass_rate AND b.validity >= a.validity AND b.mean_latency <= a.mean_latency AND b.mean_chars <= a.mean_chars AND (b.pass_rate > a.pass_rate OR b.validity > a.validity OR b.mean_latency < a.mean_latency OR b.mean_chars < a.mean_chars))")
def pareto_frontier(spark, d):
    m = stage(_run_stats(spark, d), "runs")
    return selection.pareto(m, "run_id", ["pass_rate", "validity"], ["mean_latency", "mean_chars"]).select("run_id")


_BEATEN = "EXISTS (SELECT 1 FROM m b WHERE b.pass_rate >= a.pass_rate AND b.validity >= a.validity AND b.mean_latency <= a.mean_latency AND b.mean_chars <= a.mean_chars AND (b.pass_rate > a.pass_rate OR b.validity > a.validity OR b.mean_latency < a.mean_latency OR b.mean_chars < a.mean_chars))"


@query(f"""WITH {_RUN_STATS}, front AS (SELECT * FROM m a WHERE NOT {_BEATEN}), {_EPISODES}, lead AS (SELECT run_id FROM front ORDER BY pass_rate DESC, run_id LIMIT 1),
pr AS (SELECT a.run_id, a.suite || '/' || a.id AS k, a.passed - b.passed AS v FROM e a JOIN e b ON a.suite = b.suite AND a.id = b.id AND b.run_id = (SELECT run_id FROM lead) WHERE a.run_id IN (SELECT run_id FROM front)),
bo AS (SELECT run_id, x, sum(w * v) / nullif(sum(w), 0) AS v FROM (SELECT *, {_poisson(_uniform("'42'", "x::VARCHAR", "k"))} AS w FROM pr, range({_B}) t(x)) GROUP BY 1, 2), so AS (SELECT run_id, list(v ORDER BY v) FILTER (WHERE v IS NOT NULL) AS s FROM bo GROUP BY 1), ci AS (SELECT run_id, {_ends("s")} FROM so),
t AS (SELECT front.*, coalesce(ci_low <= 0 AND ci_high >= 0, false) OR front.run_id = (SELECT run_id FROM lead) AS tied FROM front LEFT JOIN ci ON front.run_id = ci.run_id)
SELECT run_id, row_number() OVER (ORDER BY tied DESC, CASE WHEN NOT tied THEN -pass_rate END NULLS FIRST, validity DESC, mean_latency, run_id) AS rank, tied FROM t""")
def champion(spark, d):
    """The best run of the frontier; runs whose paired interval of differences to it holds zero are tied with it."""
    front = stage(selection.pareto(stage(_run_stats(spark, d), "runs"), "run_id", ["pass_rate", "validity"], ["mean_latency", "mean_chars"]), "front")
    lead = front.orderBy(F.desc("pass_rate"), "run_id").limit(1).select(F.col("run_id").alias("lead"))
    e = _episodes(spark, d)
    b = e.join(F.broadcast(lead), e["run_id"] == lead["lead"]).select("suite", "id", F.col("passed").alias("b"))
    p = e.join(front.select("run_id"), "run_id", "left_semi").join(b, ["suite", "id"]).select("run_id", F.concat_ws("/", "suite", "id").alias("k"), F.col("passed").alias("a"), "b")
    tied = stats.paired_tests(p, ["run_id"], "a", "b", "k", _B).where("not significant").select("run_id").unionByName(lead.select(F.col("lead").alias("run_id")))
    return selection.champion(front, "run_id", "pass_rate", tied, [F.desc("validity"), F.asc("mean_latency")]).withColumn("rank", F.col("rank").cast("long"))


@query("WITH s AS (SELECT run_id, task, avg(p) AS p FROM (SELECT run_id, suite AS task, (verdict.status = 'passed')::INT::DOUBLE AS p FROM traces) GROUP BY 1, 2), b AS (SELECT task, p FROM s WHERE run_id = (SELECT min(run_id) FROM traces)) SELECT s.run_id, s.task, round(b.p - s.p, 6) AS drop, b.p - s.p <= 0.03 AS retained FROM s JOIN b ON s.task = b.task")
def retention(spark, d):
    s = table(spark, d, "traces").groupBy("run_id", F.col("suite").alias("task")).agg(F.avg((F.col("verdict.status") == "passed").cast("double")).alias("p"))
    s = stage(s, "rates")
    first = s.agg(F.min("run_id").alias("first"))
    b = s.crossJoin(F.broadcast(first)).where("run_id = first").select("task", F.col("p").alias("b"))
    return s.join(b, "task").select("run_id", "task", F.round(F.col("b") - F.col("p"), 6).alias("drop"), (F.col("b") - F.col("p") <= 0.03).alias("retained"))


_GRAMS = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"


_SHARED = (f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('item_text')} AS w FROM eval_items),
ds AS (SELECT doc_id, {_GRAMS} AS g FROM d), bs AS (SELECT item_id, {_GRAMS} AS g FROM b),
de AS (SELECT doc_id, len(g) AS nd, unnest(g) AS s FROM ds), be AS (SELECT item_id, len(g) AS nb, unnest(g) AS s FROM bs),
j AS (SELECT doc_id, item_id, nd, nb, count(*) AS shared FROM de JOIN be ON de.s = be.s GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, shared, round(shared / (nd + nb - shared), 6) AS jaccard, round(shared / nb, 6) AS containment FROM j WHERE """)


@query(_SHARED + "shared / (nd + nb - shared) >= 0.8")
def contamination(spark, d):
    return selection.contamination(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


@query(_SHARED + "shared / nb >= 0.8")
def contained_items(spark, d):
    return selection.contamination(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text", by="containment")


@query("SELECT coalesce(model_id, '?') AS model_id, count(*) AS n, count(*) FILTER (WHERE lower(finish_reason) IN ('length', 'max_tokens')) AS at_limit, CASE WHEN avg((lower(coalesce(finish_reason, '')) IN ('length', 'max_tokens'))::INT::DOUBLE) >= 0.2 THEN 'budget_too_small' WHEN avg((lower(coalesce(finish_reason, '')) IN ('length', 'max_tokens'))::INT::DOUBLE) >= 0.05 THEN 'watch' ELSE 'fine' END AS finding FROM candidates GROUP BY 1")
def limit_audit(spark, d):
    hit = F.lower("finish_reason").isin("length", "max_tokens")
    g = table(spark, d, "candidates").groupBy(F.coalesce("model_id", F.lit("?")).alias("model_id")).agg(F.count("*").alias("n"), F.count_if(hit).alias("at_limit"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("share"))
    return g.select("model_id", "n", "at_limit", audit.ladder(F.col("share"), [(0.2, "budget_too_small"), (0.05, "watch")], "fine").alias("finding"))


@query()
def trace_stream(spark, d):
    """Episodes of the trace table as a stream: each once, pass rates by suite and day."""
    import uuid

    from ..sources.tables import stage_home
    from ..streaming import traces as live

    source = table(spark, d, "traces").select("suite", "run_id", "id", "finished_at", (F.col("verdict.status") == "passed").alias("passed"))
    home = f"{stage_home(spark)}/stream-{uuid.uuid4().hex}"
    source.where("finished_at is not null").write.parquet(f"{home}/in")
    s = live.stream(spark, f"{home}/in", spark.read.parquet(f"{home}/in").schema)
    once = live.first_seen(s, ["run_id", "suite", "id"], "finished_at", "36500 days")
    live.run_to_end(once, f"{home}/once", f"{home}/state")
    return live.pass_rates(spark.read.parquet(f"{home}/once"), "finished_at", "passed", ["suite"])
