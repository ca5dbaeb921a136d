import random
from collections import Counter

from pyspark.sql import functions as F

from verisieve.llm import overlaps, splits

SFT = "row_ord long, id string, messages array<struct<role string, content string>>, provenance struct<source_id string>, task_family string, scenario_family_id string, metadata map<string,string>, split_name string"


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {i: find(i) for i in range(n)}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(75)] + [(5, 5), (7, 8), (7, 8)] + [(119, i) for i in range(30)] + [(i, i + 1) for i in range(40, 60)]
    d = spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [(None, "x"), ("x", None)], "a string, b string").withColumn("node", F.lit("clash"))
    got = {r.node: r.root for r in splits.components(d).collect()}
    want = roots(120, edges)
    touched = {x for e in edges for x in e}
    assert set(got) == set(map(str, touched))
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({int(k): v for k, v in got.items()}) == groups({k: want[k] for k in touched})
    assert splits.components(d.limit(0)).isEmpty()


def test_labels_have_one_spelling(spark):
    d = spark.createDataFrame([(x,) for x in ("Craft-Wood_store-0000037", " craft–woodstore–37\t", "CRAFT WOODSTORE 0037", "--", None)], "l string")
    assert [r[0] for r in d.select(splits.label_key(F.col("l"))).collect()] == ["craftwoodstore37"] * 3 + [None, None]


def record(k, id_, family=None, task="playworld", author=None, item=None, parent=None):
    meta = {a: b for a, b in (("author", author), ("source_index", item), ("parent_id", parent)) if b is not None}
    return (k, id_, [("user", "q"), ("assistant", "a")], ("src",), task, family, meta, "train")


def tied(spark):
    rows = [
        record(1, "a", "fam-1", author="@Ann "), record(2, "b", "FAM_01", item="7"), record(3, "c", None, "general_x_02", author="ann"),
        record(4, "d", "fam-3", author="unknown"), record(5, "e", "fam-4", author="Unknown", parent="nobody"), record(6, "f", None, item="7"),
        record(7, "g", "fam-5", parent="f"), record(8, "h", None), record(9, None, None), record(10, "h", None), (11, None, None, None, None, None, None, None),
    ]
    f = [(1, "fam-1", None), (2, "general-x-2", None), (3, "fam-3", None), (4, "fam-4", "lost"), (5, "fam-5", None), (6, "fam-6", " FAM_3"), (7, None, None), (None, "fam-9", None)]
    return spark.createDataFrame(rows, SFT), spark.createDataFrame(f, "family_key long, family_label string, forked_from string")


def test_bound_families(spark):
    r, f = tied(spark)
    got = {tuple(x) for x in splits.bound_families(r, f).collect()}
    # 1-2 by an author, 1-5 by a source item and a parent, 3-6 by a fork.
    assert got == {(1, 2), (1, 5), (2, 5), (3, 6)}
    assert splits.bound_families(r.limit(0), f.limit(0)).isEmpty()


def test_assignment_keeps_components_together(spark):
    rng = random.Random(1)
    rows = [record(i, f"r{i}", f"fam-{rng.randrange(60)}", author=f"u{rng.randrange(400)}") for i in range(900)]
    r = spark.createDataFrame(rows, SFT)
    f = spark.createDataFrame([(i, f"fam-{i}", None) for i in range(60)], "family_key long, family_label string, forked_from string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    a = splits.assign_splits(r, f, t)
    assert a.count() == 900 and a.select("root").distinct().count() == a.select("root", "split_name").distinct().count()
    alone = r.drop("metadata").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    s = {x.split_name: x.share for x in splits.split_shares(splits.assign_splits(alone, f, t), t).collect()}
    assert abs(s["train"] - 0.8) < 0.04 and abs(s["test"] - 0.1) < 0.04
    assert splits.assign_splits(r.limit(0), f, t).isEmpty()
    nulls, fam = tied(spark)
    assert splits.assign_splits(nulls, fam, t).count() == nulls.count()


def test_cosine_join_loses_no_pair(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    texts = []
    for i in range(160):
        base = texts[rng.randrange(len(texts))].split() if texts and rng.random() < 0.5 else [rng.choice(["qqa", "qqb", "qqc", "alpha", "beta", "gamma", str(rng.randrange(300))]) for _ in range(20)]
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = str(rng.randrange(300))
        if i % 3 == 0 and texts:  # the numbers and names of an earlier text, other words
            base = [rng.choice(["alpha", "beta", "gamma", "delta"]) if x.isalpha() and x[:2] != "qq" and rng.random() < 0.5 else x for x in rng.choice(texts).split()]
            rng.shuffle(base)
        texts.append(" ".join(base))
    d = spark.createDataFrame([(str(i).encode(), t, i % 3 > 0, i % 3 == 0) for i, t in enumerate(texts)], "cls binary, canon string, train boolean, eval boolean")
    counts = overlaps.document_counts(d)
    assert counts.total == 160
    t = overlaps.Terms(pa.array(texts), counts)
    vec = [dict(zip(t.term[t.owner == i].tolist(), t.weight[t.owner == i].tolist())) for i in range(160)]
    cos = lambda a, b: sum(w * vec[b].get(k, 0) for k, w in vec[a].items())
    hard = [Counter(x for x in z.split() if x[:2] == "qq" or x[0].isdigit()) for z in texts]
    for least in (0.4, 0.7, 0.9):
        got = {(int(r.a), int(r.b)) for r in overlaps.cosine_candidates(d, counts, least).collect()}
        want = {(a, b) for a in range(160) for b in range(160) if a % 3 > 0 and b % 3 == 0 and cos(a, b) >= least and hard[a] == hard[b]}
        assert want and want <= got
        exact = {(int(r.a), int(r.b)): r.cosine for r in overlaps.compared(spark.createDataFrame([(str(a).encode(), str(b).encode(), texts[a], texts[b]) for a, b in sorted(want)], "a binary, b binary, x string, y string"), counts, least).collect()}
        assert set(exact) == want and all(np.isclose(c, cos(*k)) for k, c in exact.items())


def question(k, split, text):
    return (k, f"r{k}", None if text is None else [("system", "s"), ("user", text), ("assistant", "a")], ("src",), "t", None, {}, split)


def test_overlaps(spark):
    places = ["mill", "kiln", "fort", "pier", "moat", "loft", "silo", "weir", "barn", "dock"]
    say = "A crew led by {n} works near the {p} hauling {g} all day. Each trip brings {a} crates and {b} trips are made while {c} crates break on the way. How many crates arrive unbroken?"
    fill = lambda i: say.format(n=f"Name{chr(97 + i % 20)}", p=places[i % 10], g=places[(i * 3) % 10] + "x", a=100 + i, b=20 + i % 17, c=5000 + 7 * i)
    rows = [question(i, "train", fill(i)) for i in range(60)]
    rows += [question(100, "test", fill(3)), question(101, "validation", "Please! " + fill(4).upper().replace("ARRIVE", "REACH")), question(102, "holdout", fill(5).replace(places[5], places[6])), question(103, "test", fill(6).replace("106", "107")), question(104, "test", None), question(105, "test", " "), question(106, "other", fill(7)), question(107, "train", fill(3)), question(108, None, fill(3))]
    d = spark.createDataFrame(rows, SFT).withColumn("canon", F.lit("clash")).withColumn("cls", F.lit(1))
    got = {(r.train_row, r.eval_row) for r in overlaps.cross_split_overlaps(d).collect()}
    assert got == {(3, 100), (107, 100), (4, 101)}
    counts = {r.split_name: (r.n_pairs, r.n_rows) for r in overlaps.overlap_counts(d).collect()}
    assert counts == {"test": (2, 1), "validation": (1, 1)}
    assert overlaps.cross_split_overlaps(d.limit(0)).isEmpty()
