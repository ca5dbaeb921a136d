import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verisieve.llm import defects, endings, leaks, mixture, reading, truncation, words


def test_words_and_shingles():
    w = words.split(pa.array(["Für A1, b!", None, "", "x y"]))
    assert [w.vocab[c] for c in w.codes] == ["für", "a1", "b", "x", "y"] and w.counts.tolist() == [3, 0, 0, 2]
    h, owner = words.shingles(words.split(pa.array(["a b c d e f", "a b c d e", "b c d e f", "a", ""])), 5)
    assert owner.tolist() == [0, 0, 1, 2, 3] and h[0] == h[2] and h[1] == h[3]
    assert len(words.split(pa.array([], pa.string())).codes) == 0


def test_words_are_runs_of_letters_numbers_and_marks():
    rng = random.Random(4)
    alphabet = [chr(c) for c in range(128)] + list("ÄÖßéè’“—\u2028\u0301\u0345\u212aİK№²½Ⅷ٣中文\ufffd…ǅΣς😀") + ["ab ", "X1"]
    for _ in range(60):
        t = [None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(12))]
        w = words.split(pa.array([None, *t], pa.string()).slice(1))
        marked = pa.compute.replace_substring_regex(pa.compute.utf8_lower(pa.array([x or "" for x in t], pa.string())), r"[^\pL\pN\pM]+", " ").to_pylist()
        want = [[y for y in x.split(" ") if y] for x in marked]
        assert [[w.vocab[c] for c in w.codes[i:j]] for i, j in zip(w.offsets, w.offsets[1:])] == want
        # Codes are numbered in the order in which words come.
        assert w.vocab == list(dict.fromkeys(y for x in want for y in x))


def test_empty_answers():
    bad = [None, "", "  \n", "​", "...", "####", "N/A", "null", "[no output]", "<answer></answer>", "```\n```", "Answer:", "-" * 500]
    good = ["42", "No.", "Die Antwort ist 4.", "x"]
    assert endings.emptied(pa.array(bad + good)).tolist() == [True] * len(bad) + [False] * len(good)


def test_open_structures():
    bad = ['{"a": [1', "```json\n{}", "Result = 5 (noth", "1. MOVE to x\n2.", "ta�", "La dis [...]", "and so…"]
    good = ['{"a": [1]}', "```json\n{}\n```", "Done.", "#### 42", "", None, "It is 3."]
    assert endings.opened(pa.array(bad + good)).tolist() == [True] * len(bad) + [False] * len(good)
    assert endings.shortened_number("so 51 = 1305. Answer: 13") and not endings.shortened_number("so 51 = 13. Answer: 13") and not endings.shortened_number("")


def outputs(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        a, b = rng.randrange(100, 999), rng.randrange(10, 99)
        rows.append(f"We multiply {a} by {b} and obtain {a * b}. Nothing else in the story changes the count for Velk. " + rng.choice(["Answer: %d", "Final answer: %d in total", "The answer is %d.", "#### %d"]) % (a * b))
    return rows


def test_truncated_outputs(spark):
    whole = outputs()
    # Cut within the first sentence, within a word further on, and in a near-copy's number.
    cut = [t[: t.index("obtain") + 3] for t in whole[:10]] + [t[: t.index("story") + 2] for t in whole[10:20]]
    number = whole[30][: whole[30].index("Nothing")] + "Nothing else in the story changes the count for Velk. Answer: 123456"
    texts = [(i, t) for i, t in enumerate(whole)] + [(1000 + i, t) for i, t in enumerate(cut)] + [(2000, number), (2001, number[:-3]), (3000, None), (3001, ""), (3002, "####")] + [(4000, cut[0]), (4001, whole[0])]
    c = spark.createDataFrame(texts, "row_ord long, text string").selectExpr("row_ord", "text", "cast(null as string) as model_id", "'b' as backend", "1 as cls", "2 as bands")
    t = spark.createDataFrame([], "row_ord long, prediction string, run_id string")
    found = truncation.cut_outputs(truncation.outputs(c, t))
    got = {r.row_ord: r.how for r in found.collect()}
    assert {k for k in got} == {1000 + i for i in range(20)} | {2001, 4000}
    assert got[2001] == "copy"
    rates = truncation.cut_rates(found, c, t).first()
    assert (rates.source, rates.n, rates.n_cut) == ("?/b", len(texts), 22)
    assert truncation.cut_outputs(truncation.outputs(c.limit(0), t)).isEmpty()


def test_closing_counts_are_the_same_in_passes(spark, monkeypatch):
    d = spark.createDataFrame([(t[: 40 + k % 60],) for k, t in enumerate(outputs())], "text string")
    (want,) = endings.closing_counts(d)
    monkeypatch.setattr(endings, "KEYS", 150)
    parts = endings.closing_counts(d)
    got = np.concatenate(endings.Terminality(parts).parts, axis=1)
    assert len(parts) > 1 and (got[:, np.argsort(got[0])] == want).all() and want[2].sum() > 0
    t = d.toArrow().column(0).combine_chunks()
    assert all((a == b).all() for a, b in zip(endings.Terminality([want]).score(t), endings.Terminality(parts).score(t)))


def test_copies_meet_every_longer_text(spark):
    """The longest text of a bucket lacks a copy's end; the true whole is a shorter one."""
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(40):
        words_ = [f"w{rng.randrange(1000, 9999)}" for _ in range(60)]
        whole, copy = " ".join(words_), " ".join(words_[:54])[:-2]
        # Ever longer texts that differ from the whole in the word that is cut.
        hubs = [" ".join([*words_[:53], f"other{k}", *words_[54:59], "xyz"[k] * (20 + k)]) for k in range(3)]
        rows += [(10 * i, whole), (10 * i + 1, copy), *((10 * i + 2 + k, h) for k, h in enumerate(hubs))]
        a = truncation.band_keys(pa.array([whole, copy]))
        if (a[0] == a[1]).any() and truncation.aligned(copy, whole):
            want.add(10 * i + 1)
    assert len(want) > 30
    c = spark.createDataFrame(rows, "row_ord long, text string").withColumn("tab", F.lit("candidates")).select("tab", "row_ord", "text")
    got = {r.row_ord for r in truncation.cut_outputs(c).where("how = 'copy'").collect()}
    assert got >= want and not got - {r[0] for r in rows if r[0] % 10 == 1}


def test_copies_cut_early_meet_their_wholes(spark):
    """A copy of any length from the shortest beginning on is looked for, also one that is a small part of its whole."""
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(60):
        whole = " ".join(f"w{rng.randrange(1000, 9999)}" for _ in range(90))
        copy = whole[: rng.randrange(45, len(whole) - 20)]
        rows += [(10 * i, whole), (10 * i + 1, copy)]
        if copy[-1] != " " and whole[len(copy)] != " ":
            want.add(10 * i + 1)
    # A band that many share: all begin alike, one of them is the whole.
    opening = " ".join(f"o{k}" for k in range(20))
    rows += [(5000 + k, f"{opening} z{k}z{k * 7} " + " ".join(f"y{k}x{j}" for j in range(30 + k % 5))) for k in range(300)]
    rows += [(9000 + k, t[: t.index(" y") + 3]) for k, t in ((k, rows[-300 + k][1]) for k in (3, 100, 250))]
    d = spark.createDataFrame(rows, "row_ord long, text string").withColumn("tab", F.lit("traces")).select("tab", "row_ord", "text")
    got = {r.row_ord for r in truncation.cut_outputs(d).where("how = 'copy'").collect()}
    assert got >= want and len(want) > 30 and {9003, 9100, 9250} <= got and not got & {r[0] for r in rows if r[0] % 10 == 0 and r[0] < 5000}


def test_equal_outputs_are_read_once(spark, monkeypatch):
    """What is staged about texts has a row for each distinct one, and rows that are there again change nothing, also where texts come to their hashes."""
    staged, stage = [], truncation.stage
    monkeypatch.setattr(truncation, "stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    whole = [t for k, t in enumerate(outputs()) if k < 60]
    texts = whole + [t[: t.index("story") + 2] for t in whole[:20]]
    rows = [("traces", 1000 * k + i, t) for k in range(5) for i, t in enumerate(texts)]
    rows += [("traces", 7, texts[7])] * 3 + [("traces", 7, texts[70]), ("traces", None, texts[71]), ("traces", None, texts[71]), ("traces", None, None)]
    d = spark.createDataFrame(rows, "tab string, row_ord long, text string")
    got = sorted((x.row_ord or -1, x.how) for x in truncation.cut_outputs(d).collect())
    distinct = len(set(texts))
    assert all(x.count() <= distinct for x in staged if {"mark", "text"} & {*x.columns})
    assert sorted(k for k, _ in got) == sorted([1000 * k + i for k in range(5) for i in range(60, 80)] + [7, -1, -1])
    # The terminality of texts that are there more than once is that of all their rows.
    (want,), p = endings.closing_counts(d.where("text is not null"), with_states=True)
    (have,), q = endings.closing_counts(d.where("text is not null").groupBy("text").agg(F.count("*").alias("k")), with_states=True, times="k")
    assert (want == have).all() and (p == q).all() and want[1].max() > 5
    monkeypatch.setattr(truncation, "SENT", 0)
    assert sorted((x.row_ord or -1, x.how) for x in truncation.cut_outputs(d).collect()) == got


def test_copies_with_blank_ends_meet_their_wholes(spark):
    """Any white space after a copy is no part of it."""
    rng = random.Random(13)
    rows = []
    for i in range(20):
        whole = " ".join(f"wörd{rng.randrange(1000, 9999)}" for _ in range(60))
        rows += [(10 * i, whole), (10 * i + 1, whole[: whole.index(" ", 200) - 2] + "\u00a0\u3000 \n"[i % 4] * (1 + i))]
    d = spark.createDataFrame(rows, "row_ord long, text string").withColumn("tab", F.lit("traces")).select("tab", "row_ord", "text")
    assert {r.row_ord for r in truncation.cut_outputs(d).where("how = 'copy'").collect()} == {10 * i + 1 for i in range(20)}


def test_alignment():
    whole = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    assert truncation.aligned(whole[:17], whole) == ("r", "five six seven eight nine ten eleven twelve thirteen fourteen")
    assert truncation.aligned(whole[:13], whole) == ("", whole[14:]) and truncation.aligned(whole, whole) == ("", "")
    long = " ".join(f"w{k}" for k in range(100))
    edited = long.replace("w10 ", "x ")
    assert truncation.aligned(edited[: edited.index("w75") + 2], long) == ("5", " ".join(f"w{k}" for k in range(76, 100)))
    assert truncation.aligned(edited, long) == ("", "") and truncation.aligned(long[:-1] + " other", long) is None
    assert truncation.aligned("a b c", "x y z a") is None


def test_states_have_their_terminality(spark):
    texts = ['{"a": 1, "b": 2, "c": [1, 2]}'] * 30 + ['{"a": 1, "b"', "```\nx y\n```", "```\nx y", "1. a\n2. b\n3.", "plain (so it is) text", None, ""]
    ends, inside = endings.states(pa.array(texts)), endings.goings_on(pa.array(texts))
    assert ends.sum(1).tolist() == [1, 1, 1] and [np.flatnonzero(x).tolist() for x in ends] == [[30], [32], [33]]
    assert inside.tolist() == [30 * 3 + 1, 4, 1]
    _, p = endings.closing_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), with_states=True)
    assert np.allclose(p, [1 / 92, 1 / 5, 1 / 2])
    assert endings.closing_counts(spark.createDataFrame([], "text string"), with_states=True)[1].tolist() == [1.0, 1.0, 1.0]
    assert endings.broken_off(pa.array(["ta\ufffd", "and so\u2026", "La dis [...]", "Done.", None, ""])).tolist() == [True, True, True, False, False, False]


def test_bands_find_near_copies():
    rng = random.Random(3)
    base = [" ".join(str(rng.randrange(5000)) for _ in range(80)) for _ in range(60)]
    near = [" ".join(t.split()[:74]) for t in base]
    assert all(truncation.jaccard(a, b) >= 0.8 for a, b in zip(base, near))
    a, b = truncation.band_keys(pa.array(base)), truncation.band_keys(pa.array(near))
    assert (a == b).any(1).mean() > 0.95 and not (a == np.roll(b, 1, axis=0)).any()


SFT = "row_ord long, id string, messages array<struct<role string, content string>>"
CAND = "row_ord long, candidate_id string, source_record_id string, text string, finish_reason string"


def pairs_of(spark):
    q = lambda a, b: f"Velk keeps the ledger of the mill and counts each sack twice. Each trip brings {a} crates and {b} trips are made. How many crates arrive?"
    good = lambda a, b: f"We multiply {a} by {b} and obtain {a * b}. I will not answer with a range here, since Velk needs one number. The answer is {a * b}."
    rows = [(i, f"r{i}", [("user", q(100 + i, 7)), ("assistant", good(100 + i, 7))]) for i in range(120)]
    bad = {
        200: ("empty", "N/A"), 201: ("empty", None), 202: ("refusal", "I'm sorry, but I cannot help with this request."), 203: ("refusal", "Lo siento, pero no me está permitido ayudar con eso."),
        204: ("copied", "Question: " + q(300, 7)), 205: ("other_language", "Wir multiplizieren 300 mit 7 und erhalten 2100. Nach dem Abzug von nichts stehen noch 2100 im Buch. Die Antwort ist 2100."),
        206: ("truncated", good(300, 7)[:30]), 207: ("truncated", good(300, 7)[:70]), 208: (None, q(300, 7) + " " + good(300, 7)), 209: (None, "The goal can't be reached within 9 steps, so no legal plan exists."),
    }
    rows += [(k, f"r{k}", [("system", "s"), ("user", q(300, 7)), ("assistant", a)]) for k, (_, a) in bad.items()]
    rows += [(300, None, None), (301, "x", []), (302, "y", [("assistant", "orphan text with no question.")]), (303, "z", [("user", q(1, 2) + " Please write the answer in German."), ("assistant", bad[205][1])])]
    return spark.createDataFrame(rows, SFT), {(k, d) for k, (d, _) in bad.items() if d}


def test_defective_pairs(spark):
    r, want = pairs_of(spark)
    c = spark.createDataFrame([(1, "c", "r0", "We multiply 100 by 7 and obt", "length"), (2, "c", "nobody", "", None), (3, None, None, None, None)], CAND).withColumn("question", F.lit("clash"))
    got = defects.defective_pairs(r, c).collect()
    assert {(x.row_ord, x.defect) for x in got if x.tab == "sft_records"} == want
    assert {(x.row_ord, x.defect) for x in got if x.tab == "candidates"} == {(1, "truncated"), (2, "empty"), (3, "empty")}
    assert {x.msg_pos for x in got if x.row_ord == 200} == {2}
    assert defects.defective_pairs(r.limit(0), c.limit(0)).isEmpty()


def drawn_votes(rng, n):
    """Kinds and votes of pairs that follow the starting probabilities."""
    theta = defects.starting()
    kind = rng.choice(len(defects.KINDS), n, p=[0.8, 0.08, 0.02, 0.04, 0.02, 0.02, 0.02])
    u = rng.random((n, len(defects.FUNCTIONS)))
    return kind, (u > theta[kind, :, 0]).astype(int) + (u > theta[kind, :, 0] + theta[kind, :, 1])


def test_label_model_recovers_labels():
    rng = np.random.default_rng(1)
    kind, v = drawn_votes(rng, 6000)
    p, back, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    theta, prior = defects.fit(lambda a, b: defects.sufficient(p, n.astype(float), a, b))
    post = defects.posteriors(p, theta, prior)[back.ravel()]
    assert abs(prior[: defects.SOUND].sum() - 0.88) < 0.02
    for k, d in enumerate(defects.DEFECTS, defects.SOUND):
        y = kind == k
        flagged = post[:, k] >= defects.cutoff(post[:3000, k], np.ones(3000), y[:3000].astype(float))
        assert 2 * (flagged & y).sum() / (flagged.sum() + y.sum()) > (0.8 if d == "truncated" else 0.93), d
    # Sums over parts are sums over all rows.
    whole = defects.sufficient(p, n.astype(float), theta, prior)
    parts = defects.sufficient(p[:50], n[:50].astype(float), theta, prior) + defects.sufficient(p[50:], n[50:].astype(float), theta, prior)
    assert np.allclose(whole, parts)
    none = defects.fit(lambda a, b: np.zeros((*a.shape[:2], 4)))
    assert np.allclose(none[0], defects.starting()) and defects.cutoff(np.zeros(0), np.zeros(0), np.zeros(0)) == 0.5


def test_defects_do_not_veto_each_other():
    """An answer that repeats the question and stops in the middle draws votes for both, as does a refusal in another language."""

    class Sound:
        def score(self, texts):
            return np.ones(len(texts)), np.zeros(len(texts), bool)

    q = "Velk keeps the ledger of the mill (see the log) and counts each sack twice. Each trip brings 14 crates and 7 trips are made. How many crates arrive?"
    answers = [q[:25] + q[25:60] + " [", "Es tut mir leid, aber ich kann das hier leider nicht beantworten.", "We get 98. The answer is 98."]
    v = defects.votes(pa.array([q] * 3), pa.array(answers), pa.array([None] * 3, pa.string()), Sound())
    votes_for = lambda d, k: int((v[d][k] == 1).sum())
    assert votes_for("copied", 0) >= 2 and votes_for("truncated", 0) >= 1
    assert votes_for("refusal", 1) >= 2 and votes_for("other_language", 1) >= 2
    assert not any(votes_for(d, 2) for d in defects.DEFECTS)


def test_votes_read_every_text_once(monkeypatch):
    """A question beside several answers, and an answer that is a question, are split into words once, however many rows hold them."""

    class Sound:
        def score(self, texts):
            return np.ones(len(texts)), np.zeros(len(texts), bool)

    read = []
    monkeypatch.setattr(defects, "split", lambda texts, *a: read.extend(x for x in texts.to_pylist() if x) or words.split(texts, *a))
    q = ["Velk counts 14 crates. How many arrive?", "Wo ist der Weg zur Mühle und was kostet er?"]
    rows = [(x, y) for x in q for y in (x, q[0], "We get 98 crates.", "Der Weg ist weit.")]
    v = defects.votes(pa.array([x for x, _ in rows]), pa.array([y for _, y in rows]), pa.array([None] * len(rows), pa.string()), Sound())
    assert len(read) == len(set(read)) == 4
    assert [int(x) for x in v["copied"][:, 0]] == [1, 1, 2, 2, 1, 2, 2, 2]
    # What a row draws doesn't rest on the rows beside it.
    for k, (x, y) in enumerate(rows):
        alone = defects.votes(pa.array([x]), pa.array([y]), pa.array([None], pa.string()), Sound())
        assert all((alone[d][0] == v[d][k]).all() for d in defects.DEFECTS)


def test_words_and_runs_are_looked_up_exactly(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 7, rng.integers(0, 12)), rng.integers(0, 7, rng.integers(0, 30))) for _ in range(50)]
    flat = lambda k: (np.concatenate([r[k] for r in rows]), np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]))
    want = [x in set(by.tolist()) for mine, by in rows for x in mine.tolist()]
    for cells in (1, 20, 1 << 22):
        monkeypatch.setattr(defects, "CELLS", cells)
        assert defects._held(*flat(0), *flat(1), 7).tolist() == want
    share, total = defects._run_share(*flat(0), *flat(1))
    runs = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    assert total.tolist() == [len(runs(x)) for x, _ in rows]
    assert share.tolist() == [sum(y in runs(by) for y in runs(x)) / max(1, len(runs(x))) for x, by in rows]


def test_two_labels_are_kept(spark, monkeypatch):
    r, _ = pairs_of(spark)
    monkeypatch.setattr(defects, "_validated", lambda *a: {d: 1e-12 for d in defects.DEFECTS})
    none = spark.createDataFrame([], CAND)
    got = defects.defective_pairs(r.where("row_ord = 205"), none).groupBy("row_ord").count().collect()
    assert got[0]["count"] > 1


def test_model_and_cutoffs_take_all_pairs(spark, monkeypatch):
    """All pairs are fitted to, and every sound one has defects planted in it, however many there are."""
    r, _ = pairs_of(spark)
    seen, graded = [], []
    fit, cutoff, plant = defects.fit, defects.cutoff, defects.planted
    monkeypatch.setattr(defects, "fit", lambda total: fit(lambda a, b: seen.append(total(a, b)) or seen[-1]))
    monkeypatch.setattr(defects, "cutoff", lambda grade, weight, *a: graded.append(weight.sum()) or cutoff(grade, weight, *a))
    found = []
    monkeypatch.setattr(defects, "planted", lambda sound: found.append((sound, plant(sound))) or found[-1][1])
    many = r.where("row_ord < 120")
    for k in range(1, 25):
        many = many.unionByName(r.where("row_ord < 120").withColumn("row_ord", F.col("row_ord") + 1000 * k))
    rows = r.where("row_ord >= 200").unionByName(many)
    defects.defective_pairs(rows, spark.createDataFrame([], CAND))
    n = defects.pairs(rows, spark.createDataFrame([], CAND)).count()
    assert {round(x[:, 0, 3].sum()) for x in seen} == {n} and n > 3000
    sound, put = found[0]
    assert sound.count() >= 3000
    kinds = {x.defect: x.n for x in put.groupBy("defect").agg(F.sum("n").alias("n")).collect()}
    assert kinds["empty"] == kinds["copied"] == sound.count() and kinds["truncated"] == sound.where("length(answer) > 60").count()
    # Each defect's cutoff is chosen over all pairs and the planted ones beside them.
    assert len(graded) == len(defects.DEFECTS) and min(graded) > n


def test_other_answers_are_in_another_language(spark):
    q = {"en": "Where do they go with {}?", "de": "Wohin geht der Weg und was ist {}?"}
    d = spark.createDataFrame([("t", i, 0, q[("en", "de", "en")[i % 3]].format(i), f"{('en', 'de', 'en')[i % 3]} {i}", None) for i in range(200)], "tab string, row_ord long, msg_pos int, question string, answer string, finish string")
    got = defects.beside_others(d, 200).collect()
    assert len(got) == 200 and all(x.other is None or x.other[:2] != x.answer[:2] for x in got)
    assert sum(x.other is not None for x in got) > 170
    # Groups of rows give one to every row too.
    assert defects.beside_others(d, 9000).count() == 200


def item(rng, i):
    w = lambda: f"w{rng.randrange(900)}"
    return " ".join(f"stock wording goes here {w()} and then {rng.randrange(10000)} at the {w()} for {w()}" for _ in range(8))


def test_leaks(spark):
    rng = random.Random(8)
    items = [item(rng, i) for i in range(40)]
    words_ = items[3].split()
    edited = [x if k % 17 else "edit" for k, x in enumerate(words_[20:70])]
    other = items[4].split()
    docs = [
        (1, "lead in " + items[0] + " and more"), (2, "<p>" + " ".join(edited[:25]) + " -- remark: odd! -- " + " ".join(edited[25:]) + "</p>"), (3, " ".join(words_[:20])),
        (4, " ".join(x if not x[0] == "w" or not x[1:].isdigit() else "w1" for x in other)), (5, None), (6, ""), (7, items[0].upper() + " " + items[1]), (8, "x " * 30000 + items[2]), (1, "lead in " + items[0] + " and more"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1))
    e = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (None, "x y z")], "item_id long, item_text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.evaluation_leaks(d, e).collect())
    assert got == [(1, 0), (1, 0), (2, 3), (7, 0), (7, 1), (8, 2)]
    assert {r.doc_id for r in leaks.clean_documents(d, leaks.evaluation_leaks(d, e)).collect()} == {3, 4, 5, 6}
    assert leaks.evaluation_leaks(d, e.limit(0)).isEmpty() and leaks.evaluation_leaks(d.limit(0), e).isEmpty()


def test_longest_matches_match_a_loop():
    rng = random.Random(6)
    it = [" ".join(f"a{rng.randrange(40)}" for _ in range(30)) for _ in range(12)]
    items = leaks.Items(list(range(12)), it)
    text = " ".join(f"a{rng.randrange(40)}" for _ in range(200)) + " " + it[5]
    seq = np.array([items.code_of.get(x, 0) for x in text.split()] + [0])
    i, j, n = leaks.longest_matches(items, seq)
    rare = set(items.keys.tolist())
    keys = leaks.gram_keys(items.seq)
    for a, b, k in zip(i, j, n):
        assert (items.seq[a : a + k] == seq[b : b + k]).all() and items.seq[a + k] != seq[b + k] or items.seq[a + k] == 0
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(items.seq)):
        for b in range(len(seq) - 3):
            if keys[a] >= 0 and int(keys[a]) in rare and (items.seq[a : a + 3] == seq[b : b + 3]).all():
                assert any((a - s, b - s) in found for s in range(40))


def test_wording_that_all_items_share_is_looked_up(spark, monkeypatch):
    """Every item shares most of its words with all others; matches in them count like any, in one run or many."""
    shared = " ".join(f"s{k % 37} t{k}" for k in range(30))
    items = [f"own{k} name{k} {shared} end{k}" for k in range(25)]
    docs = [(1, "before " + shared + " after"), (2, items[4]), (3, " ".join(shared.split()[:12])), (4, "nothing of it"), (5, " ".join(f"own{k} s1 t1 s2 t2" for k in range(25)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(list(enumerate(items)), "item_id long, item_text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.evaluation_leaks(d, e).collect())
    # The wording alone is a stretch of each item; a whole item is its own, with the wording of the others.
    assert {x for x in got if x[0] == 1} == {(1, k) for k in range(25)} and (2, 4) in got
    assert {x[0] for x in got} == {1, 2}
    texts = pa.array([t for _, t in docs])
    own = leaks.Items(list(range(25)), items)
    whole = sorted(leaks.leaks_of(own, texts, 0.4))
    monkeypatch.setattr(leaks, "MEETINGS", 100)
    assert sorted(leaks.leaks_of(own, texts, 0.4)) == whole
    # All matches of three words are inside one of those found.
    seq = np.array([own.code_of.get(x, 0) for x in docs[0][1].split()] + [0])
    i, j, n = leaks.longest_matches(own, seq)
    inside = {(a + k, b + k) for a, b, m in zip(i.tolist(), j.tolist(), n.tolist()) for k in range(m - 2)}
    a_keys, b_keys = leaks.gram_keys(own.seq), leaks.gram_keys(seq)
    assert inside == {(a, b) for a in range(len(own.seq)) for b in range(len(seq)) if a_keys[a] >= 0 and a_keys[a] == b_keys[b]}


def test_texts_passed_over_have_no_stretch():
    rng = np.random.default_rng(2)
    for _ in range(400):
        item, own = rng.integers(1, 9, 12), rng.random(9) < 0.4
        text = rng.integers(0, 9, 15)
        n, hit, miss = leaks.best_stretch(item, text, own)
        if n >= 0.4 * 12 and hit >= 0.85 * (hit + miss):
            assert leaks.can_hold(np.isin(item, text)[None, :], own[item], 0.4, 0.85).all()


def test_flight_keeps_number_and_size():
    rng = random.Random(5)
    units = [(i, rng.randrange(1, 500), 0.3) for i in range(600)]
    out = list(mixture.flight(iter(units), 7))
    open_ = [u for u in out if u[2] not in (0, 1)]
    assert len(out) == 600 and len(open_) <= 2
    assert abs(sum(u[2] for u in out) - 180) < 1e-6
    assert abs(sum(u[1] * u[2] for u in out) - sum(s * 0.3 for _, s, _ in units)) < 1e-3
    landed = mixture.land(open_, 7)
    assert all(p in (0.0, 1.0) for _, _, p in landed)
    assert list(mixture.flight(iter([(1, 5, 0.5), (2, 5, 0.5), (3, 5, 0.5)]), 1))


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaab"), " ".join(["word"] * rng.randrange(1, 60))) for i in range(1500)] + [(9000, None, "x"), (9001, "a", None), (9002, "zz", "no target")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(0)).withColumn("rate", F.lit(0)).repartition(5)
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("gone", 0.0, 1), ("a", 0.6, 1)], "source string, target_share double, max_repeats int")
    sizes = mixture.token_counts(docs)
    assert sizes.where("doc_id = 9001").first().n_tokens == 0
    rates = mixture.plan_rates(sizes, t)
    m = mixture.balanced_mixture(sizes, rates)
    assert m.agg(F.max("copies")).first()[0] <= 3 and m.where("source = 'a' and copies > 1").isEmpty()
    s = {r.source: r for r in mixture.reached_shares(m, rates).collect()}
    assert abs(s["a"].share - 0.6) < 0.01 and abs(s["b"].share - 0.4) < 0.01 and s["gone"].share == 0
    more = mixture.plan_rates(sizes, t, 1e9)
    assert {r.source: r.rate for r in more.collect()} == {"a": 1.0, "b": 3.0, "gone": 0.0}
    none = mixture.balanced_mixture(sizes.limit(0), mixture.plan_rates(sizes.limit(0), t))
    assert none.isEmpty()


def test_ordinal_regression_on_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    y = np.clip(np.digitize(x @ [2.0, -1.0, 0.5, 0] + rng.normal(size=900) * 0.3, [-2.5, -1, 1, 2.5]) + 1, 1, 5)
    mean, scale, w, cuts = reading.fit_ordinal(x[:600], y[:600])
    assert (np.diff(cuts) > 0).all()
    s = (x[600:] - mean) / scale @ w
    level = 1 + (s[:, None] > cuts[None, :]).sum(1)
    assert (abs(level - y[600:]) <= 1).mean() > 0.97 and (level == y[600:]).mean() > 0.7


def test_calibration_is_held_out():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 3))
    y = np.clip(np.digitize(x @ [1.5, -1.0, 0.0] + rng.normal(size=1200) * 0.4, [-2, -0.7, 0.7, 2]) + 1, 1, 5).astype(float)
    held = np.arange(1200) % 5 == 0
    fit, ridge = reading.calibrated(x[:1000], y[:1000], held[:1000])
    p = reading.above(fit, x[1000:])
    assert ridge in reading.RIDGES and (np.diff(p, axis=1) <= 0).all()
    assert abs(p[:, 2].mean() - (y[1000:] > 3).mean()) < 0.04 and ((p[:, 2] > 0.5) == (y[1000:] > 3)).mean() > 0.9
    few, _ = reading.calibrated(x[:40], y[:40], held[:40])
    assert np.isfinite(few[2]).all()


def test_word_counts_are_exact(spark):
    texts = ["a b a 7", "b c", None, "", "B, c! d"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = reading.word_counts(d)
    assert counts.of(words.hashes(["a", "b", "c", "d", "7", "z"]).view(np.int64)).tolist() == [1, 3, 2, 1, 0, 0] and counts.total == 5
    assert len(reading.word_counts(d, 0.4).keys) == 2
    w = words.split(pa.array(texts))
    assert all([x.tolist() for x in words.distinct_words(w, n)] == [[0, 0, 0, 1, 1, 4, 4, 4], [0, 1, 2, 1, 3, 1, 3, 4]] for n in (1, 11, 1 << 20))


def test_reading_levels(spark):
    rng = random.Random(4)
    easy = "The dog runs home. It is tired and sits down. Can you see the bag? Now it is your turn.".split(". ")
    hard = "Whereas the ergodicity of the estimator precludes any ostensible identification, the asymptotic variance of the likelihood remains, albeit contingently, unbounded. Notwithstanding counterfactual exchangeability, the cardinality of the lattice confounds its decomposition".split(". ")
    docs, labels = [], []
    for i in range(300):
        level = rng.choice([1, 5])
        docs.append((i, ". ".join(rng.choices(hard if level == 5 else easy, k=6)), "s"))
        if i % 3 == 0:
            labels.append((i, level, "r"))
            if i % 30 == 0:
                labels.append((i, level, "q"))
    truth = {i: t for i, t, _ in docs}
    docs += [(900, None, None), (901, " ", "s"), (902, "# {\n<p></p>", "s"), (0, docs[0][1], "s")]
    labels += [(5000, 3, "r"), (1, None, "r"), (None, 2, "r"), (2, 9, "r")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("level", F.lit(9))
    lab = spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")
    levels = reading.reading_levels(d, lab)
    got = {r.doc_id: r.level for r in levels.collect()}
    assert levels.count() == len(docs) and got[900] is None and got[901] is None
    assert np.mean([(got[k] >= 4) == ("ergodicity" in t or "counterfactual" in t) for k, t in truth.items()]) > 0.98
    assert reading.reading_levels(d, lab.limit(0)).where("level is not null").isEmpty()
    assert reading.reading_levels(d.limit(0), lab).isEmpty()
    assert reading.source_profile(levels, d).count() == 2


@pytest.mark.parametrize("name", ["p1_counts", "p2_rates", "p3_counts", "p4_shares", "p5_leaked_items", "p6_shares", "p6_shares_at_corpus_size", "p7_source_profile", "p5_clean_documents", "p4_assignment"])
def test_queries_run(spark, data, name):
    from verisieve.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() >= 0
