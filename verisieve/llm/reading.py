"""Problem 7: the reading level of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .words import Counts, distinct_words, hashes, split

#: Share of documents from which on a word's own frequency counts; rarer words are all alike.
COMMON = 1 / 2000
#: Graded documents that the regression is fitted on at most, the first by hash.
SAMPLE = 20_000
#: Words of a window.
WINDOW = 12
LEVELS = 5
#: Levels that a school reader follows.
SCHOOL = 3
#: Penalties that are tried on held-out graded documents; each holds for all features alike.
RIDGES = (10.0, 30.0, 100.0, 300.0)

# Connectives of everyday text, and of academic text, in four languages.
EVERYDAY = frozenset("and but so then because when if or now after before y pero luego porque cuando si o ahora después und aber dann weil wenn oder jetzt nach et mais puis parce quand ou maintenant après car".split())
ACADEMIC = frozenset(
    "whereas whereby whence hence thus albeit notwithstanding provided insofar inasmuch therefore furthermore moreover consequently thereby conversely nevertheless nonetheless whilst ergo viz modulo iff "
    "wohingegen sofern insofern ungeachtet hieraus demzufolge folglich gleichwohl mithin indes nichtsdestotrotz gdw hinfällig "
    "tandis néanmoins toutefois nonobstant lequel laquelle dès lors partant or quoique ainsi pourvu "
    "mientras empero conque asimismo mediante salvo puesto siempre cuyo cuya cuyos no obstante pese".split()
)
SUBORDINATORS = frozenset("which that whose whom where while although though since unless der die das dass deren dessen welche obwohl während qui que dont où bien lorsque que quien cual donde aunque cuyo".split())
#: Standard deviations beyond which a feature says no more: unpunctuated or very long texts are no evidence of their own.
CLIP = 2.0
#: What the features belong to: lexical diversity, word rarity, connectives, clause depth, lengths.
GROUPS = {
    "diversity": ("diversity",),
    "rarity": ("rarity", "rare_share", "unfamiliar", "unfamiliar_share", "unfamiliar_windows", "strange_windows"),
    "connectives": ("everyday", "academic", "academic_windows"),
    "clauses": ("clauses", "subordination"),
    "lengths": ("word_length", "long_words", "sentence_length"),
}
FEATURES = tuple(x for g in GROUPS.values() for x in g)


def plain(texts: pa.Array) -> pa.Array:
    """Texts without markup, structured lines and line breaks."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    t = pc.replace_substring_regex(t, r"<[^<>\n]{1,80}>|&[a-z]{2,8};|https?://\S+", " ")
    return pc.replace_substring_regex(t, r"(?m)^.*\{.*\}.*$|^[#=>*\s-]+", " ")


class Text:
    """Words of a batch and what single words say."""

    def __init__(self, texts: pa.Array):
        t = plain(texts)
        self.n = len(texts)
        self.words = w = split(t)
        self.owner = w.owners()
        self.key = hashes(w.vocab).view(np.int64)
        self.is_word = np.array([not x[0].isdigit() for x in w.vocab], bool)
        self.marks = [pc.count_substring_regex(t, p).to_numpy(zero_copy_only=False).astype(float) for p in (r"[.!?](?:\s|$)|\n", r"[,;:]")]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, word code) of each distinct word of each text; numbers are none."""
        owner, code = distinct_words(self.words)
        keep = self.is_word[code]
        return owner[keep], code[keep]

    def features(self, corpus: Counts, school: Counts, own: np.ndarray | None = None) -> np.ndarray:
        """FEATURES of each text.

        own: 1 where the text itself is one that ``school`` counts; it is then
        left out of its own words' counts.
        """
        w, n = self.words, self.n
        count = np.maximum(1, w.counts).astype(float)
        by = lambda x: np.bincount(self.owner, weights=x, minlength=n) / count
        each = lambda f: np.array([f(x) for x in w.vocab], float)[w.codes] if len(w.codes) else np.zeros(0)
        at = (np.arange(len(self.owner)) - w.offsets[:-1][self.owner]) // WINDOW if len(self.owner) else self.owner
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (self.owner[1:] != self.owner[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))

        def windows(x: np.ndarray, least: float) -> np.ndarray:
            """Share of a text's length in windows whose mean is above ``least``."""
            if not len(begin):
                return np.zeros(n)
            return np.bincount(self.owner[begin], weights=size * (np.add.reduceat(x, begin) / size > least), minlength=n) / count

        share = corpus.of(self.key) / max(1, corpus.total)
        rare = np.where(self.is_word, -np.log(np.maximum(share, COMMON)), 0.0)
        known = school.of(self.key)[w.codes] if len(w.codes) else np.zeros(0)
        if own is not None:
            known = np.maximum(known - own[self.owner], 0)
        # How much rarer a word is in text for school readers than in all text.
        ahead = np.log(np.maximum(share, COMMON))[w.codes] - np.log((known + 0.5) / (school.total + 1)) if len(w.codes) else np.zeros(0)
        ahead = np.where((self.is_word & (share >= COMMON))[w.codes], np.clip(ahead, 0, 4), 0.0) if len(w.codes) else ahead
        rare = rare[w.codes] if len(w.codes) else np.zeros(0)
        academic = each(lambda x: x in ACADEMIC)
        sentences = np.maximum(1, self.marks[0])
        values = {
            "diversity": np.bincount(self.distinct()[0], minlength=n) / np.sqrt(count),
            "rarity": by(rare), "rare_share": by(rare > np.log(100)), "unfamiliar": by(ahead), "unfamiliar_share": by(ahead > 1.5), "unfamiliar_windows": windows(ahead, 0.5), "strange_windows": windows(ahead, 1.0),
            "everyday": by(each(lambda x: x in EVERYDAY)), "academic": by(academic), "academic_windows": windows(academic, 0.05),
            "clauses": self.marks[1] / sentences, "subordination": by(each(lambda x: x in SUBORDINATORS)),
            "word_length": by(each(len)), "long_words": by(each(lambda x: len(x) >= 10)), "sentence_length": np.log(count / sentences),
        }
        return np.stack([values[f] for f in FEATURES], 1)


def word_counts(texts: DataFrame, least: float = 0.0) -> Counts:
    """Documents of the column ``text`` that each word occurs in; only words of the share ``least`` of all documents or more.

    Counts are exact and added up by word in a shuffle. With a positive
    ``least`` no more than (mean distinct words of a document) / least words
    reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Text(b.column(0))
            n = np.bincount(t.distinct()[1], minlength=len(t.key))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(t.key[at]), pa.array(n[at])], ["k", "n"])

    total = texts.count()
    counts = texts.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") >= least * total).toArrow()
    return Counts(got.column(0).to_numpy(), got.column(1).to_numpy(), total)


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Proportional-odds regression with a ridge penalty: (mean, scale, weights, cut points).

    P(level > k) = sigmoid(w x - c_k); the cut points are kept in order by
    their differences' logarithms. Fitted by Newton-scaled gradient steps.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    n, d = z.shape
    above = (y[:, None] > np.arange(1, LEVELS)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(LEVELS - 1) * 1e-3)
    params = np.concatenate([np.zeros(d), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        c = np.concatenate([[params[d]], params[d] + np.cumsum(np.exp(params[d + 1 :]))])
        # Each level is a difference of two of these; the sum of the binary likelihoods keeps the order and is convex.
        g = 1 / (1 + np.exp(-np.clip((z @ params[:d])[:, None] - c[None, :], -40, 40))) - above
        gc = -g.sum(0)
        gp = np.empty_like(params)
        gp[:d] = z.T @ g.sum(1) + ridge * params[:d]
        gp[d] = gc.sum()
        tail = np.cumsum(gc[::-1])[::-1]
        gp[d + 1 :] = tail[1:] * np.exp(params[d + 1 :])
        m, v = 0.9 * m + 0.1 * gp, 0.99 * v + 0.01 * gp**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return mean, scale, params[:d], np.concatenate([[params[d]], params[d] + np.cumsum(np.exp(params[d + 1 :]))])


def scores(fit: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w, _ = fit
    return np.clip((x - mean) / scale, -CLIP, CLIP) @ w


def above(fit: tuple, x: np.ndarray) -> np.ndarray:
    """P(level > k) of each text, k = 1 to 4."""
    return 1 / (1 + np.exp(-np.clip(scores(fit, x)[:, None] - fit[3][None, :], -40, 40)))


def calibrated(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[tuple, float]:
    """The regression and its penalty.

    Of RIDGES the penalty is taken under which the held-out graded texts are
    likeliest; slope and cut points are then fitted to the held-out texts'
    scores alone. Too few held-out texts, or ones of a single level, take part
    in the fit instead.
    """
    y = np.round(y + 1e-9)
    if held.sum() < 50 or len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        return fit_ordinal(x, y, RIDGES[1]), RIDGES[1]
    is_above = y[held][:, None] > np.arange(1, LEVELS)[None, :]
    tried = []
    for ridge in RIDGES:
        fit = fit_ordinal(x[~held], y[~held], ridge)
        p = np.clip(above(fit, x[held]), 1e-6, 1 - 1e-6)
        tried.append((np.log(np.where(is_above, p, 1 - p)).sum(), -ridge, fit))
    _, ridge, (mean, scale, w, _) = max(tried, key=lambda t: t[:2])
    s = scores((mean, scale, w, None), x[held])[:, None]
    center, spread, slope, cuts = fit_ordinal(s, y[held], 1.0)
    by = slope[0] / spread[0]
    return (mean, scale, w * by, cuts + center[0] * by), -ridge


def reading_levels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, level (1 to 5), demanding: the probability of level 4 or 5.

    A proportional-odds regression with one ridge penalty over lexical
    diversity, word rarity, connectives, a proxy of clause depth and lengths,
    fitted to at most ``sample`` graded documents (the mean of their raters)
    and calibrated on a held-out fifth of them. A word's rarity is taken in all
    documents and, as for a school reader, in those graded SCHOOL or less
    against all; the share of windows that are full of such words tells how
    much of a text is demanding. Two passes over the corpus: word counts and
    scores.

    Texts without a word have level null, as all have where no document is
    graded. Further columns are ignored, repeated rows kept.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    graded = labels.where("reading_level between 1 and 5 and doc_id is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    known = docs.where("text is not null").join(graded, "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    known = stage(known.select("text", "level", (F.pmod("h", F.lit(5)) == 0).alias("held")), "graded")
    if known.isEmpty():
        return docs.select("doc_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("demanding"))
    counts = word_counts(docs, COMMON), word_counts(known.where(F.col("level") < SCHOOL + 0.5))
    sent = spark.sparkContext.broadcast(counts)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy(zero_copy_only=False) < SCHOOL + 0.5
            x = Text(b.column(0)).features(*sent.value, own=own.astype(float))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["level", "held", "x"])

    got = known.mapInArrow(described, "level double, held boolean, x array<double>").toArrow()
    fit, _ = calibrated(np.array(got.column(2).to_pylist()), got.column(0).to_numpy(), got.column(1).to_numpy().astype(bool))
    model = spark.sparkContext.broadcast((fit, counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, counts = model.value
        for b in batches:
            t = Text(b.column(1))
            p = above(fit, t.features(*counts))
            blank = t.words.counts == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((1 + (p > 0.5).sum(1)).astype(np.int32), mask=blank), pa.array(p[:, SCHOOL - 1], mask=blank)], ["doc_id", "level", "demanding"])

    return docs.mapInArrow(score, "doc_id long, level int, demanding double")


def source_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """source, n, mean_level, demanding_share: reading levels of each source; blank documents count in n only."""
    d = documents.select("doc_id", "source").join(levels, "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.avg("level").alias("mean_level"), F.avg((F.col("level") >= 4).cast("int")).alias("demanding_share"))
