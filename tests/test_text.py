from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verisieve.functions import actions, canonical, draws, text


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names)).alias("x")).first()[0]


def test_final_answer(spark):
    cases = {
        "so the total is 42.\n#### 42": "42",
        "Thus \\boxed{3.5} is the result.": "3.5",
        "First 3 apples, then 7, total 10 apples.": "10",
        "The answer is $1,200.": "1,200",
        "final answer: x y \nrest": "x y",
        "no number": None,
        "": None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in d.select("t", text.final_answer(F.col("t"))).collect()}
    assert all(got[k] == cases[k] for k in got)
    # An empty tail falls through to the last number.
    assert one(spark, text.final_answer, "Answer: 7\nAnswer: \u00a0") == "7"
    assert one(spark, text.final_answer, None) is None


def test_numbers(spark):
    for raw, want in {"1,200": 1200.0, "$5.": 5.0, "5d": None, "1_000": None, "": None, "-.5": -0.5, "nan": None}.items():
        assert one(spark, text.to_number, raw) == want


def test_strip_is_unicode_aware(spark):
    assert one(spark, text.squeeze, "\u2003 A\u00a0\t b \x0b") == "a b"
    assert one(spark, text.strip, "\u200bx") == "\u200bx"


def test_tail_repetition(spark):
    unit = "and then the agent checks the next place "
    assert one(spark, text.tail_repeats, unit * 4) is True
    assert one(spark, text.tail_repeats, "short") is False
    assert one(spark, text.tail_repeats, None) is False
    assert one(spark, text.tail_repeats, "x" * 31) is False
    assert one(spark, text.tail_repeats, "".join(chr(100 + i) for i in range(600))) is False


def test_divergence(spark):
    assert one(spark, text.first_divergence, "abcd", "abxd") == 2
    assert one(spark, text.first_divergence, "ab", "abxd") == 2
    assert one(spark, text.first_divergence, "ab", "ab") is None


def test_plan_reasons():
    r = lambda t: actions.read_plan(t)["reason"]
    assert r(None) == r("") == r("prose") == r('{"a": 1} {"b": 2}') == r("[1]") == "malformed_json"
    assert r('{"actions": []}') == r('{"actions": 3}') == "missing_actions_field"
    assert r('{"actions": [1]}') == "action_not_object"
    assert r('{"actions": [{"type": []}]}') == r('{"actions": [{"type": "FLY"}]}') == "unknown_action_type"
    assert r('{"actions": [{"type": "MOVE", "target": 5}]}') == r('{"actions": [{"type": "MOVE", "x": 1}]}') == "action_schema_invalid"
    got = actions.read_plan('so: {"actions": [{"type": "REST"}], "final_state": {"location": "a", "energy": 3.0}} end')
    assert got["reason"] == "ok" and got["claims"] == "le" and got["claim_energy"] == 3
    assert actions.read_plan('{"actions": [{"type": "REST"}], "final_state": 4}')["claims"] == "bad"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_plan_never_fails(t):
    assert actions.read_plan(t)["reason"]


def test_canonical_json_is_the_same_in_both_engines(spark):
    rows = [(1, "ä\u2028\"\\/", {"b": "2", "a": None}, [("z", 1)]), (2, None, None, None)]
    d = spark.createDataFrame(rows, "k long, t string, m map<string,string>, s array<struct<y string, x long>>")
    got = [r[0] for r in d.orderBy("k").select(canonical.canonical_column(d)).collect()]
    want = [{"k": k, "t": t, "m": m, "s": None if s is None else [{"y": y, "x": x} for y, x in s]} for k, t, m, s in rows]
    assert got == [canonical.canonical(w) for w in want]
    floats = spark.createDataFrame([(1, 1e20), (2, 0.1)], "k long, f double")
    assert [r[0] for r in floats.orderBy("k").select(canonical.canonical_column(floats)).collect()] == ['{"f":1e+20,"k":1}', '{"f":0.1,"k":2}']
    listed = canonical.list_fingerprint(d, "k", ["k", "t"]).first()[0]
    assert listed == canonical.fingerprint([{"k": k, "t": t} for k, t, *_ in rows])
    assert canonical.list_fingerprint(d.limit(0), "k").first()[0] == canonical.fingerprint([])


def test_tree_fingerprint_ignores_partitions(spark):
    d = spark.range(9000).selectExpr("id as k", "cast(id * 7 as string) as t")
    a = canonical.tree_fingerprint(d, "k").first()[0]
    assert a == canonical.tree_fingerprint(d.repartition(7), "k").first()[0]
    assert a != canonical.tree_fingerprint(d.where("k <> 5"), "k").first()[0]


def test_draws_are_uniform(spark):
    u = spark.range(4000).select(draws.uniform(F.col("id").cast("string")).alias("u"))
    mean, w = u.agg(F.avg("u"), F.avg(draws.poisson(F.col("u")))).first()
    assert abs(mean - 0.5) < 0.02 and abs(w - 1) < 0.05
