import random
import statistics

import pytest
from pyspark.sql import functions as F

from verisieve.functions import draws
from verisieve.operators import audit, corpus, ordering, selection, stats
from verisieve.plans import catalogue


def test_running_sums_match_plain_ones(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "k long, c string, w int").repartition(7)
    want, total = {}, 0
    for k, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = total
        total += w
    assert {r.k: r.before for r in ordering.running(d, ["c", "k"], "w").collect()} == want
    assert sorted(r["rank"] for r in ordering.ranked(d, ["c", "k"]).collect()) == list(range(1, 501))
    assert ordering.running(d.limit(0), ["k"], "w").count() == 0


def run_pair(spark):
    rows = [(f"e{i}", float(i < 30), float(i < 5)) for i in range(50)]
    return spark.createDataFrame(rows, "id string, a double, b double")


def test_paired_tests(spark):
    r = stats.paired_tests(run_pair(spark).withColumn("g", F.lit("x")), ["g"], "a", "b", "id", 300).first()
    assert (r.mean_a, r.mean_b, r.delta) == (0.6, 0.1, 0.5) and r.significant and r.p_value < 0.01
    flat = spark.createDataFrame([("x", f"e{i}", float(i % 2), float(1 - i % 2)) for i in range(40)], "g string, id string, a double, b double")
    r = stats.paired_tests(flat, ["g"], "a", "b", "id", 300).first()
    assert not r.significant and r.p_value > 0.05


def test_intervals_hold_the_mean(spark):
    d = run_pair(spark).withColumn("g", F.lit("x"))
    a = stats.poisson_bootstrap(d, ["g"], F.col("a"), "id", 300).first()
    mean, low, high = stats.classic_bootstrap([r.a for r in d.collect()], 2000)
    assert a.ci_low < a["mean"] == mean < a.ci_high and abs(a.ci_low - low) < 0.06 and abs(a.ci_high - high) < 0.06
    b = stats.small_group_bootstrap(d, "g", "a", "id", resamples=2000).first()
    assert (b.ci_low, b.ci_high) == stats.classic_bootstrap([r.a for r in d.orderBy("id").collect()], 2000)[1:]
    with pytest.raises(ValueError):
        stats.small_group_bootstrap(d, "g", "a", "id", largest=10)
    with pytest.raises(ValueError):
        stats.classic_bootstrap([])


def test_draws_are_those_of_md5():
    import hashlib

    for seed, n, key in (("42", 1200, "7"), ("flip42", 10_000, "suite/é-12"), ("42", 30, None), ("42", 120, "k" * 60), ("42", 1, ""), ("flip42", 100, "k" * 45)):
        want = [int(hashlib.md5("-".join([seed, str(b), *([key] if key is not None else [])]).encode()).hexdigest()[:8], 16) for b in range(n)]
        assert draws.heads(seed, n, key).tolist() == want
        assert draws.weights(seed, n, key).tolist() == [sum(x / 2**32 >= c for c in draws.POISSON) for x in want]


def test_resamples_in_pieces(spark, monkeypatch):
    d = run_pair(spark).withColumn("g", F.lit("x"))
    whole = stats.paired_tests(d, ["g"], "a", "b", "id", 300).collect(), stats.poisson_bootstrap(d, [], F.col("a"), "id", 300).collect()
    monkeypatch.setattr(stats, "PIECE", 7)
    assert whole == (stats.paired_tests(d, ["g"], "a", "b", "id", 300).collect(), stats.poisson_bootstrap(d, [], F.col("a"), "id", 300).collect())


def test_registered_resamples_can_tell_many_runs_apart(spark, data):
    """269 tests at 0.05 need p-values below 0.0002."""
    p = [r.p_value for r in catalogue.QUERIES["compare_runs"](spark, data).collect()]
    assert catalogue._B == 10_000 and all(abs(x * 10_001 - round(x * 10_001)) < 0.006 for x in p)


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "n string, p double")
    assert {r.n: r.adjusted for r in stats.holm(d, "p", "n").collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}


def test_spearman_with_ties(spark):
    xs, ys = [1, 2, 2, 3, 5, 5, 8], [2, 1, 4, 4, 6, 9, 9]

    def ranks(v):
        return [statistics.mean(i + 1 for i, y in enumerate(sorted(v)) if y == x) for x in v]

    want = statistics.correlation(ranks(xs), ranks(ys))
    d = spark.createDataFrame([*zip(xs, ys), (None, 1)], "x int, y int")
    r = stats.spearman(d, "x", "y").first()
    assert r.n == 7 and abs(r.rho - want) < 1e-5


def test_nearest_rank(spark):
    d = spark.createDataFrame([("a", v) for v in [5, 1, 9, 9, 3, None]] + [("b", 4)], "g string, v int")
    got = {(r.g, r.q): r.value for r in stats.nearest_rank(d, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): 1, ("a", 0.5): 5, ("a", 1.0): 9, ("b", 0.0): 4, ("b", 0.5): 4, ("b", 1.0): 4}


def test_sequential_mixture_matches_a_loop(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), f"  Text {rng.randint(0, 25)}" if rng.random() < 0.95 else " ") for i in range(120)] + [(500, None, "x"), (501, "a", None)]
    weights, total = {"a": 0.5, "b": 0.3, "c": 0.2}, 40
    h = lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest()
    seen, want = set(), set()
    for s, quota in corpus.quotas(weights, total).items():
        n = 0
        for i, _, t in sorted((r for r in rows if r[1] == s), key=lambda r: (h(r[0]), r[0])):
            k = " ".join((t or "").lower().split())
            if n < quota and k and k not in seen:
                seen.add(k)
                want.add(i)
                n += 1
    d = spark.createDataFrame(rows, "k long, s string, t string").repartition(5)
    assert {r.k for r in corpus.sequential_mixture(d, "s", weights, total, "t", "k").collect()} == want


def test_splits_and_samples(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    parts = {r.part: r.n for r in corpus.holdout(d, "k", 30).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 70, "holdout": 30}
    assert corpus.holdout(d, "k", 500).where("part = 'train'").isEmpty()
    f = corpus.family_split(d.limit(1), "k").collect()
    assert [r.part for r in f] == ["eval"]
    assert 0 < corpus.hash_sample(d, "k", 0.3).count() < 60
    assert [r.k for r in corpus.within_budget(d.withColumn("n", F.lit(10)), ["k"], "n", 35).orderBy("k").collect()] == [0, 1, 2]


def test_rejection_sampling_takes_the_shortest(spark):
    d = spark.createDataFrame([("a", 0, "long one", True), ("a", 1, " ab ", True), ("a", 2, "cd", True), ("a", 3, "x", False), ("b", 0, "y", False), (None, 0, "z", True)], "s string, i int, t string, ok boolean")
    got = {r.s: r.i for r in corpus.rejection_sample(d, "s", "t", F.col("ok"), ["i"]).collect()}
    assert got == {"a": 1, None: 0}


def test_exemplars_skip_incomplete_records(spark):
    m = "array<struct<role string, content string>>"
    d = spark.createDataFrame([(1, [("user", "q")]), (2, [("user", "q"), ("assistant", "a")]), (3, None), (4, [("user", "r"), ("assistant", " ")])], f"k long, m {m}")
    assert [tuple(r) for r in corpus.exemplars(d, "m", "k", 3).collect()] == [(2, "q", "a")]


def test_pareto_and_champion(spark):
    d = spark.createDataFrame([("a", 0.9, 10.0), ("b", 0.8, 5.0), ("c", 0.8, 6.0), ("d", 0.9, 10.0), ("e", None, 1.0)], "k string, up double, down double")
    assert {r.k for r in selection.pareto(d, "k", ["up"], ["down"]).collect()} == {"a", "b", "d"}
    runs = spark.createDataFrame([("a", 0.9, 3.0), ("b", 0.88, 1.0), ("c", 0.5, 0.0)], "k string, m double, t double")
    tied = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [(r.k, r.tied) for r in selection.champion(runs, "k", "m", tied, [F.asc("t")]).orderBy("rank").collect()] == [("b", True), ("a", True), ("c", False)]
    assert [r.k for r in selection.champion(runs, "k", "m", tied.where("k = 'a'"), [F.asc("t")]).orderBy("rank").collect()] == ["a", "b", "c"]


def test_pareto_of_many_candidates_is_whole(spark, monkeypatch):
    # More candidates and more points left than one pass compares; the frontier of all of them, in several passes.
    monkeypatch.setattr(selection, "CANDIDATES", 50)
    n = 400
    rows = [(f"{kind}{i}", float(i), float(n - i - drop), i % 3) for kind, drop in (("front", 0), ("twin", 0), ("below", 1)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, x double, y double, z int")
    got = {r.k for r in selection.pareto(d.repartition(4), "k", ["x", "y"], []).collect()}
    # (i, n - i - 1) is beaten by (i, n - i).
    assert got == {f"{kind}{i}" for kind in ("front", "twin") for i in range(n)}
    mixed = selection.pareto(d.withColumn("c", F.col("y").cast("decimal(10,2)")), "k", ["x", "z"], ["c"])
    brute = {a[0] for a in rows if not any(b[1] >= a[1] and b[3] >= a[3] and b[2] <= a[2] and (b[1] > a[1] or b[3] > a[3] or b[2] < a[2]) for b in rows)}
    assert {r.k for r in mixed.collect()} == brute
    odd = spark.createDataFrame([("a", float("nan"), 0.0), ("b", 1.0, -0.0), ("c", 2.0, 0.0), ("d", float("inf"), 1.0), ("e", 3.0, float("nan"))], "k string, x double, y double")
    # NaN is above all numbers, as in SQL: best where it is maximised, worst where it is minimised.
    assert {r.k for r in selection.pareto(odd, "k", ["x"], ["y"]).collect()} == {"a"}
    assert {r.k for r in selection.pareto(odd, "k", [], ["x", "y"]).collect()} == {"b"}
    assert selection.pareto(d.limit(0), "k", ["x"], ["y"]).collect() == []


def test_champion_ranks_a_large_frontier_in_ranges(spark):
    runs = spark.range(1000).select(F.format_string("r%04d", "id").alias("k"), (F.col("id") % 7 / 7).alias("m"), (F.col("id") % 11).alias("t"))
    tied = runs.where("m > 0.8 or k = 'r0003'").select("k")
    got = selection.champion(runs, "k", "m", tied, [F.asc("t")])
    keys = {r.k for r in tied.collect()}
    want = sorted(runs.collect(), key=lambda r: (r.k not in keys, 0 if r.k in keys else -r.m, r.t, r.k))
    assert [(r.k, r.rank, r.tied) for r in got.orderBy("rank").collect()] == [(r.k, i + 1, r.k in keys) for i, r in enumerate(want)]
    assert "Window [row_number" not in got._jdf.queryExecution().toString()


def test_rates_and_incidence(spark):
    d = spark.createDataFrame([("a", 1, 2, True), ("a", 1, 4, False), ("a", None, 9, True), (None, 0, 0, None)], "k string, x int, n int, ok boolean")
    assert {r.k: (r.part, r.whole, r.rate) for r in selection.pooled_rate(d, ["k"], F.col("x"), F.col("n")).collect()} == {"a": (2, 6, 0.333333), None: (0, 0, None)}
    got = selection.incidence(d, ["k"], F.col("ok"), {"big": F.col("n") > 3, "one": F.col("x") == 1})
    assert {r.k: (r.n, r.flagged) for r in got.collect()} == {"a": (3, 2), None: (1, 0)}
    log = spark.createDataFrame([("a", float("nan"), 0.9, 0.1, 0.0), ("b", 1.0, 0.4, 1.0, 0.2), ("c", 1.0, 0.9, 1.0, 0.1), ("d", None, None, None, None)], "r string, loss double, v double, w double, h double")
    rules = selection.protocol_rules(F.col("loss"), F.col("v"), F.col("w"), F.col("h"))
    assert {tuple(r) for r in selection.stopped_runs(log, "r", rules).collect()} == {("a", "loss_diverged"), ("b", "low_validity"), ("b", "reward_hacking")}


def test_summaries_with_intervals(spark):
    v = "struct<status string, score double>"
    rows = [(i, "s", ("passed" if i % 2 else "failed", 1.0 if i % 2 else None), 0.5 if i < 10 else None) for i in range(40)] + [(99, "t", ("skipped", None), None), (100, None, ("passed", 1.0), None)]
    d = spark.createDataFrame(rows, f"k long, suite string, verdict {v}, legal double")
    r = {x.suite: x for x in stats.suite_summary(d, ["suite"], legal="legal").collect()}
    assert (r["s"].pass_rate, r["s"].legal_action_rate, r["t"].pass_rate, r["t"].eligible) == (0.5, 0.5, None, 0)
    got = {(x.suite, x.metric): x for x in stats.suite_intervals(d, ["suite"], "k", legal="legal", resamples=400).collect()}
    assert set(got) == {("s", "pass_rate"), ("s", "mean_score"), ("s", "legal_action_rate"), (None, "pass_rate"), (None, "mean_score")}
    x = got["s", "pass_rate"]
    assert x.n == 40 and x.ci_low < 0.5 < x.ci_high and x.ci_high - x.ci_low < 0.4 and got["s", "legal_action_rate"].ci_low == 0.5
    assert stats.suite_intervals(d.limit(0), ["suite"], "k", resamples=10).isEmpty()


def test_spearman_interval(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(i, x := rng.random(), x + rng.random() * 0.3) for i in range(200)], "k long, x double, y double")
    r = stats.spearman(d, "x", "y", "k", 500).first()
    assert r.ci_low < r.rho < r.ci_high and r.ci_high - r.ci_low < 0.2


def test_contamination_matches_sets(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    item = [rng.choice(words) for _ in range(30)]
    docs = [(1, " ".join(["x"] * 9 + item)), (2, " ".join(rng.choice(words) for _ in range(60))), (3, None), (4, ""), (5, " ".join(item[:15]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shared", F.lit(1))
    b = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, item_text string")
    r = selection.contamination(d, "doc_id", "text", b, "item_id", "item_text", by="containment").collect()
    assert [(x.doc_id, x.item_id, x.containment) for x in r] == [(1, 7, 1.0)]
    far = spark.createDataFrame([(1, " ".join([f"x{i}" for i in range(9)] + item))], "doc_id long, text string")
    assert selection.contamination(far, "doc_id", "text", b, "item_id", "item_text").isEmpty() and selection.contamination(far, "doc_id", "text", b, "item_id", "item_text", by="containment").count() == 1
    near = spark.createDataFrame([(6, "x " + " ".join(item))], "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in selection.contamination(near, "doc_id", "text", b, "item_id", "item_text").collect()] == [(6, 7)]


def test_tensor_audits(spark):
    d = spark.createDataFrame([(1, "x", [3.0, 4.0]), (1, "y", [0.0, 0.0]), (2, "x", [3.0, 4.5]), (2, "z", [1.0]), (3, "n", None)], "f int, k string, v array<float>")
    r = {(x.a, x.b): x for x in audit.tensor_differences(d, "f", "k", "v").collect()}
    assert (r[1, 2].common, r[1, 2].only_a, r[1, 2].only_b, r[1, 2].max_abs_diff) == (1, 1, 1, 0.5)
    n = {x.k: (x.norm, x.zeros) for x in audit.norms(d.where("f = 1 or f = 3"), "v").collect()}
    assert n == {"x": (5.0, False), "y": (0.0, True), "n": (None, None)}


def test_run_audit_and_drift_edges(spark):
    v = "struct<reason_code string>"
    rows = [(1, "r", "s", "a", None, ("x",)), (2, "r", "s", "b", " " * 600, ("x",)), (3, "r", "s", "c", "loop " * 200, (None,)), (4, "r", "s", "c", "again", ("y",)), (5, None, None, None, "\u2003", None)]
    t = spark.createDataFrame(rows, f"row_ord long, run_id string, suite string, id string, prediction string, verdict {v}").withColumn("copies", F.lit("clash"))
    s = spark.createDataFrame([("r", 3)], "run_id string, truncated_outputs long")
    got = {x.run_id: x for x in audit.run_audit(t.drop("copies"), summary=s).collect()}
    x = got["r"]
    assert (x.rows, x.duplicates, x.empty, x.runaway, x.truncation_rate, x.all_truncated) == (3, 1, 2, 1, 1.0, True) and got[None].empty == 1
    assert {(y.reason_code, y.n, y.place) for y in audit.reason_counts(t, F.col("verdict.reason_code")).where("run_id = 'r'").collect()} == {("x", 2, 1), ("None", 1, 2)}
    a = spark.createDataFrame([("Answer: 4\nthen 9", "4", True), ("answer: 5, then 9", "9", False), ("", "1", False), ("#### 7", None, False), ("7", "8", False), (None, "1", None)], "t string, gold string, ok boolean")
    r = audit.answer_drift(a, [], "t", "gold", F.col("ok")).first()
    assert (r.n, r.pass_rate, r.marker_rate, r.drifted, r.drift_failures) == (3, 0.3333, 0.6667, 2, 0)


def test_label_mask_and_profile(spark):
    d = spark.createDataFrame([(1, [4, 5, 9, 9], [-100, 5, -100, -100]), (2, [4, 7, 9], [4, -100, -100]), (3, [4, 7, 8], [4, -100, 8]), (4, [], []), (5, None, None), (6, [9], [-100])], "k int, ids array<int>, labels array<int>")
    got = {r.k: r.m and (r.m.terminal, r.m.is_stop, r.m.masked) for r in d.select("k", audit.label_mask(F.col("ids"), F.col("labels"), 9, [7]).alias("m")).collect()}
    assert got == {1: (1, False, False), 2: (1, True, True), 3: (2, False, True), 4: None, 5: None, 6: (0, False, False)}
    p = spark.createDataFrame([([0.0, 1.0, 2.0, 4.0], [1, 2, -100, 3], [0, 3, 3, 3])], "n array<double>, l array<int>, i array<int>").select(audit.nll_profile(F.col("n"), F.col("l"), F.col("i"), 3).alias("p")).first().p
    assert (p.supervised, p["mean"], p.p50, p.p90, p.stop_at, p.stop_nll) == (2, 2.5, 1.0, 1.0, 3, 4.0)


def test_label_audits(spark):
    d = spark.createDataFrame([([-100, -100, 5, 6],)], "l array<int>")
    r = d.select(audit.masked(F.col("l")).alias("m"), audit.hits_cap(F.col("l"), 4, [9]).alias("cap"), audit.stop_rank(F.col("l"), F.lit(2)).alias("rank")).first()
    assert (r.m, r.cap, r["rank"]) == ([5, 6], True, 2)
