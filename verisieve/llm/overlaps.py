"""Problem 3: the same question in a training split and an evaluation split."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .words import Counts, Words, hashes, mix, split

EVALUATION = ("validation", "holdout", "test")
#: Share of texts from which on a term's own frequency counts; rarer terms weigh alike.
COMMON = 1 / 2000
#: Weights of a plain word and of a quoted name against that of a number, a pair of numbers or a run.
PLAIN, QUOTED = 0.5, 0.5
#: Cosine from which on two questions are compared.
LEAST = 0.55
#: Successive numbers and quoted names that make up one further term; numbers of a text of which all pairs are terms.
RUN, NUMBERS = 4, 6
#: A context that was seen less often says nothing about its words.
SEEN = 8
#: Bits of the filter that keeps contexts nobody asks for out of the shuffle; it changes no result.
FILTER = 24


def canonical(text: Column) -> Column:
    """Lower-case words with single spaces; quoted names get the prefix ``qq``, the spec_id of a world is left out."""
    t = F.translate(F.lower(text), "_", "")
    t = F.when(F.contains(t, F.lit("spec")), F.regexp_replace(t, r'"?specid"?\s*:?\s*"?w\W{0,3}\d+"?', " ")).otherwise(t)
    t = F.when(F.contains(t, F.lit('"')), F.regexp_replace(t, r'"(\w+)"', " qq$1 ")).otherwise(t)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def questions(records: DataFrame) -> DataFrame:
    """row_ord, split_name, source, canon, cls: first user messages; none where it is missing or has no words."""
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    q = records.select("row_ord", "split_name", F.col("provenance.source_id").alias("source"), canonical(user).alias("canon"))
    return q.where("canon <> ''").withColumn("cls", F.unhex(F.md5("canon")))


class Terms:
    """Weighted terms of a batch of canonical texts, rarest first within a text."""

    def __init__(self, texts: pa.Array, counts: Counts | None = None):
        w: Words = split(texts)
        self.words = w
        h = hashes(w.vocab)
        quoted = np.fromiter((x.startswith("qq") for x in w.vocab), bool, len(w.vocab))
        number = np.fromiter((any(c.isdigit() for c in x) for x in w.vocab), bool, len(w.vocab)) & ~quoted
        owner, n = w.owners(), len(w.offsets) - 1
        code = h[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
        q, d = (x[w.codes] if len(w.codes) else np.zeros(0, bool) for x in (quoted, number))
        # What must agree: numbers and quoted names, however often and in whatever order.
        self.hard = np.zeros(n, np.uint64)
        at = np.flatnonzero(q | d)
        if len(at):
            begin = np.flatnonzero(np.append(True, owner[at][1:] != owner[at][:-1]))
            with np.errstate(over="ignore"):
                self.hard[owner[at][begin]] = np.add.reduceat(mix(code[at], 9), begin)
        parts = [(owner, code, np.where(d, 1.0, np.where(q, QUOTED, PLAIN)))]
        # Runs of quoted names and numbers, where names are quoted.
        named = np.bincount(owner[q], minlength=n) > 0
        at = np.flatnonzero((q | d) & named[owner])
        parts.append(self._runs(owner[at], code[at], RUN))
        # Elsewhere pairs of numbers, whatever their order; where these are many, only successive ones.
        at = np.flatnonzero(d & ~named[owner])
        many = np.bincount(owner[at], minlength=n) > NUMBERS
        far = NUMBERS if len(at) else 1
        for k in range(1, far):
            if len(at) > k:
                a, b = at[:-k], at[k:]
                ok = (owner[a] == owner[b]) & ((k == 1) | ~many[owner[a]])
                x, y = code[a[ok]], code[b[ok]]
                with np.errstate(over="ignore"):
                    parts.append((owner[a[ok]], mix(mix(np.minimum(x, y), 2) + np.maximum(x, y), 3), np.ones(int(ok.sum()))))
        owner, term, scale = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((term, owner))
        owner, term, scale = owner[order], term[order], scale[order]
        first = np.ones(len(term), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
        start = np.flatnonzero(first)
        tf = np.diff(np.append(start, len(term)))
        self.owner, self.term = owner[start], term[start].view(np.int64)
        if counts is None:
            return
        distinct, back = np.unique(self.term, return_inverse=True)
        share = np.maximum(counts.of(distinct) / max(1, counts.total), COMMON)[back]
        weight = np.log(1 + 1 / share) * scale[start] * (1 + np.log(tf))
        order = np.lexsort((self.term, share, self.owner))
        self.owner, self.term, weight = self.owner[order], self.term[order], weight[order]
        norm = np.sqrt(np.bincount(self.owner, weights=weight**2, minlength=n))
        self.weight = weight / norm[self.owner]

    @staticmethod
    def _runs(owner: np.ndarray, code: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(owner) < run:
            return owner[:0], code[:0], np.ones(0)
        same = owner[: len(owner) - run + 1] == owner[run - 1 :]
        key = np.zeros(len(owner) - run + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(run):
                key = key * np.uint64(0x100000001B3) + code[k : len(code) - run + 1 + k]
        return owner[: len(owner) - run + 1][same], mix(key[same], run), np.ones(int(same.sum()))

    def prefixes(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms to index; of each term the norm, the largest and the sum of its text's weights from it on."""
        if not len(self.owner):
            return np.zeros(0, bool), np.zeros(0), np.zeros(0), np.zeros(0)
        begin = np.append(True, self.owner[1:] != self.owner[:-1])
        first = np.flatnonzero(begin)[np.cumsum(begin) - 1]

        def onward(x: np.ndarray) -> np.ndarray:
            done = np.cumsum(x)
            return np.add.reduceat(x, np.flatnonzero(begin))[np.cumsum(begin) - 1] - (done - x - (done[first] - x[first]))

        left = np.maximum(onward(self.weight**2), 0)
        lift = (self.owner.max() - self.owner[::-1]) * 2.0
        top = (np.maximum.accumulate(self.weight[::-1] + lift) - lift)[::-1]
        return left >= (least - 1e-6) ** 2, np.sqrt(left), top, onward(self.weight)


def document_counts(reps: DataFrame) -> Counts:
    """Texts that each term occurs in, exact; only terms of the share COMMON of all texts or more.

    No more than (mean terms of a text) / COMMON terms reach the driver,
    whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, n = np.unique(Terms(b.column(0)).term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], ["k", "n"])

    total = reps.count()
    got = reps.select("canon").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * total).toArrow()
    return Counts(got.column(0).to_numpy(), got.column(1).to_numpy(), total)


def cosine_candidates(reps: DataFrame, counts: Counts, least: float) -> DataFrame:
    """a (train class), b (evaluation class): pairs of equal numbers and quoted names whose cosine may reach ``least``.

    Inverted lists hold the terms of a vector, rarest first, up to where the
    norm of the rest falls under ``least``. All that two vectors share comes
    from their first common term on, so a meeting in a list is dropped at once
    where the norms from there on, or the largest weight of one times the sum
    of the other, multiply to less than ``least``; only what is left is
    shuffled as a pair. The exact check that numbers and names agree is part
    of the join, which splits the lists of frequent terms.
    """
    sent = reps.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Terms(b.column(1), sent.value)
            inside, left, top, whole = t.prefixes(least)
            o = t.owner[inside]
            cols = [*(b.column(k).take(pa.array(o)) for k in (0, 2, 3)), pa.array(t.term[inside]), pa.array(t.hard.view(np.int64)[o]), *(pa.array(x[inside].astype(np.float32)) for x in (left, top, whole))]
            yield pa.RecordBatch.from_arrays(cols, ["cls", "train", "eval", "term", "hard", "left", "top", "whole"])

    lists = stage(reps.select("cls", "canon", "train", "eval").mapInArrow(run, "cls binary, train boolean, eval boolean, term long, hard long, left float, top float, whole float"), "lists")
    side = lambda c, k: lists.where(c).select("term", "hard", *(F.col(x).alias(f"{k}_{x}") for x in ("cls", "left", "top", "whole")))
    pairs = side("train", "a").join(side("eval", "b"), ["term", "hard"]).where("a_cls <> b_cls")
    most = F.least(F.col("a_left") * F.col("b_left"), F.col("a_top") * F.col("b_whole"), F.col("b_top") * F.col("a_whole"))
    return pairs.where(most >= least - 1e-4).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()


def context_counts(reps: DataFrame, asked: DataFrame) -> DataFrame:
    """ctx, n, top, kinds: how often a context occurs, its commonest word, how many words fill it; of the contexts in ``asked``.

    A bit table of fixed size keeps most other contexts out of the shuffle; the
    join that follows is exact.
    """
    wanted = np.zeros(1 << FILTER, bool)
    low = F.col("ctx").bitwiseAND((1 << FILTER) - 1)
    wanted[asked.select(low.alias("bit")).distinct().toArrow().column(0).to_numpy()] = True
    sent = reps.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            w = split(b.column(0))
            masked = ["#" if any(c.isdigit() for c in x) else x for x in w.vocab]
            code = hashes(masked)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
            plain = np.fromiter((not x.startswith("qq") and x != "#" for x in masked), bool, len(masked))[w.codes] if len(w.codes) else np.zeros(0, bool)
            keys = np.concatenate(_contexts(code, w.owners()))
            keep = np.flatnonzero(bits[(keys & np.uint64((1 << FILTER) - 1)).astype(np.int64)] & np.tile(plain, 5)) if len(keys) else np.zeros(0, np.int64)
            pairs, n = np.unique(np.stack([keys[keep], np.tile(code, 5)[keep]]), axis=1, return_counts=True) if len(keep) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array(n.astype(np.int64))], ["ctx", "word", "n"])

    each = reps.select("canon").mapInArrow(run, "ctx long, word long, n long").groupBy("ctx", "word").agg(F.sum("n").alias("n"))
    return each.groupBy("ctx").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("kinds"))


def _contexts(code: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Hashes of the five contexts of every word: both neighbours, either one, the two before, the two after."""
    near = []
    for step in (-2, -1, 1, 2):
        at = np.arange(len(code)) + step
        same = (at >= 0) & (at < len(code))
        same[same] = owner[at[same]] == owner[same]
        x = np.zeros(len(code), np.uint64)
        x[same] = code[at[same]]
        near.append(x)
    before2, before, after, after2 = near
    with np.errstate(over="ignore"):
        return [mix(before, 1) + mix(after, 2), mix(before, 3), mix(after, 4), mix(before2, 5) + mix(before, 6), mix(after, 7) + mix(after2, 8)]


def compared(pairs: DataFrame, counts: Counts, least: float) -> DataFrame:
    """Pairs of equal numbers and quoted names whose exact cosine reaches ``least``; ``odd``: the side and contexts of words that only one side has, if names aren't quoted."""
    sent = pairs.sparkSession.sparkContext.broadcast(counts)
    hard = lambda c: {k: n for k, n in c.items() if k.startswith("qq") or any(x.isdigit() for x in k)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            t = Terms(pa.concat_arrays([b.column(2), b.column(3)]), sent.value)
            order = np.lexsort((t.term, t.owner % n))
            o, term, w = (t.owner % n)[order], t.term[order], t.weight[order]
            twin = (o[1:] == o[:-1]) & (term[1:] == term[:-1])
            dot = np.bincount(o[1:][twin], weights=(w[1:] * w[:-1])[twin], minlength=n)
            masked = hashes(["#" if any(c.isdigit() for c in x) else x for x in t.words.vocab])
            contexts = np.stack(_contexts(masked[t.words.codes], t.words.owners())).view(np.int64)
            keep, odd = [], []
            for i in np.flatnonzero(dot >= least):
                spans = [range(t.words.offsets[k], t.words.offsets[k + 1]) for k in (i, n + i)]
                x, y = (Counter(t.words.vocab[t.words.codes[k]] for k in span) for span in spans)
                if hard(x) != hard(y):
                    continue
                keep.append(i)
                # Where names stand in quotes, the running text around them is framing.
                quoted = any(k.startswith("qq") for k in x)
                odd.append([] if quoted else [[side, *contexts[:, k].tolist()] for side, (span, only) in enumerate(zip(spans, (x - y, y - x))) for k in span if t.words.vocab[t.words.codes[k]] in only])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dot[keep] if keep else [], pa.float64()), pa.array(odd, pa.list_(pa.list_(pa.int64())))], ["a", "b", "cosine", "odd"])

    return pairs.mapInArrow(run, "a binary, b binary, cosine double, odd array<array<long>>")


def same_questions(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: classes of train and evaluation texts that differ in wording only.

    ``reps`` holds one row per distinct canonical text: cls, canon, train,
    eval. After the weighted cosine join, a pair stands if its numbers and
    quoted names agree exactly and the differing words don't fill a slot on both sides. A slot is
    a context that many words fill evenly in the corpus (names, places,
    goods); where one word prevails, another one there is an edit.
    """
    counts = document_counts(reps)
    found = stage(cosine_candidates(reps, counts, least), "pairs")
    text = lambda k: reps.select(F.col("cls").alias(k), F.col("canon").alias(f"{k}_text"))
    pairs = found.join(text("a"), "a").join(text("b"), "b").select("a", "b", "a_text", "b_text")
    close = stage(compared(pairs, counts, least), "close")
    odd = close.select("a", "b", F.posexplode("odd").alias("word", "keys")).select("a", "b", "word", F.element_at("keys", 1).alias("side"), F.posexplode(F.slice("keys", 2, 5)).alias("kind", "ctx"))
    odd = odd.join(context_counts(reps, odd.select("ctx")), "ctx", "left")
    open_ = (F.col("n") >= SEEN) & (F.col("top") < 0.5 * F.col("n")) & (F.col("kinds") >= 5)
    at = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    word = odd.groupBy("a", "b", "side", "word").agg(*(at(k, F.coalesce("n", F.lit(0))).alias(f"n{k}") for k in range(5)), *(at(k, F.coalesce(open_, F.lit(False))).alias(f"o{k}") for k in range(5)))
    # Where the two neighbours are too rare together, all wider contexts that are known must be open.
    known = [F.col(f"n{k}") >= SEEN for k in range(1, 5)]
    wide = reduce(and_, (~c | F.col(f"o{k}") for k, c in enumerate(known, 1))) & reduce(or_, known)
    slot = F.when(F.col("n0") >= SEEN, F.col("o0")).otherwise(wide)
    other = word.where(slot).groupBy("a", "b").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("a", "b")
    return close.select("a", "b").join(other, ["a", "b"], "left_anti")


def matched_classes(records: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rows with the class of their question, and the pairs (a, b) of train and evaluation classes that put the same one."""
    rows = stage(questions(records).where(F.col("split_name").isin("train", *EVALUATION)), "questions")
    train = F.col("split_name") == "train"
    reps = stage(rows.groupBy("cls").agg(F.min("canon").alias("canon"), F.max(train).alias("train"), F.max(~train).alias("eval")), "classes")
    pairs = same_questions(reps, least).unionByName(reps.where("train and eval").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    return rows, pairs


def cross_split_overlaps(records: DataFrame, least: float = LEAST) -> DataFrame:
    """train_row, eval_row, split_name, source: rows whose first user messages put the same question.

    Exact copies are joined as classes and expanded at the end, so a text that
    a third of all rows hold is compared once. split_name and source are those
    of the evaluation row. Null or blank questions overlap with nothing;
    repeated rows are cases of their own; rows of other splits are ignored.
    """
    rows, pairs = matched_classes(records, least)
    t = rows.where("split_name = 'train'").select(F.col("cls").alias("a"), F.col("row_ord").alias("train_row"))
    e = rows.where("split_name <> 'train'").select(F.col("cls").alias("b"), F.col("row_ord").alias("eval_row"), "split_name", "source")
    return pairs.join(t, "a").join(e, "b").select("train_row", "eval_row", "split_name", "source")


def overlap_counts(records: DataFrame, least: float = LEAST) -> DataFrame:
    """split_name, source, n_pairs, n_rows: overlaps per evaluation split and source of the evaluation row.

    Made of the classes' sizes; no pair of rows is formed.
    """
    rows, pairs = matched_classes(records, least)
    t = rows.where("split_name = 'train'").groupBy(F.col("cls").alias("a")).agg(F.count("*").alias("n_train"))
    e = rows.where("split_name <> 'train'").groupBy(F.col("cls").alias("b"), "split_name", "source").agg(F.count("*").alias("n_eval"))
    by = pairs.join(t, "a").groupBy("b").agg(F.sum("n_train").alias("n_train")).join(e, "b")
    return by.groupBy("split_name", "source").agg(F.sum(F.col("n_train") * F.col("n_eval")).alias("n_pairs"), F.sum("n_eval").alias("n_rows"))
