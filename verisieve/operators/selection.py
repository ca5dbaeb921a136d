"""Choosing a champion, sampling for audits, stopping rules, contamination."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .ordering import ranked

#: Points of a frontier that are sent to the tasks at once; more take more passes.
CANDIDATES = 20_000
#: Comparisons of two points that are held at once.
COMPARED = 1 << 22


def within_limits(df: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds ``admitted``: all hard constraints hold; a null value holds none."""
    ops = {">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x}
    return df.withColumn("admitted", reduce(and_, (F.coalesce(ops[op](F.col(k), F.lit(x)), F.lit(False)) for k, (op, x) in limits.items()), F.lit(True)))


def _places(columns: list[pa.ChunkedArray], up: list[bool]) -> np.ndarray:
    """Rows by objectives: the values' places among each other, larger ones better; NaN is above all numbers, as in SQL."""
    out = []
    for c, rises in zip(columns, up):
        plain = pa.types.is_floating(c.type) or pa.types.is_integer(c.type)
        x = c.to_numpy() if plain else np.array([*c.to_pylist(), None], object)[:-1]
        at = np.unique(x, return_inverse=True)[1].ravel().astype(np.int64)
        out.append(at if rises else -at)
    return np.stack(out, 1)


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some of the others is at least as good as in all objectives and better in one."""
    out = np.zeros(len(points), bool)
    if not len(points):
        return out
    wide = max(1, COMPARED // len(points))
    for k in range(0, len(by), wide):
        other = by[k : k + wide]
        no_worse, better = np.ones((len(points), len(other)), bool), np.zeros((len(points), len(other)), bool)
        for j in range(points.shape[1]):
            no_worse &= other[None, :, j] >= points[:, j, None]
            better |= other[None, :, j] > points[:, j, None]
        out |= (no_worse & better).any(1)
    return out


def _front(points: np.ndarray, block: int = 512) -> np.ndarray:
    """Numbers of the points that no other one beats; a point is beaten only by one of a larger sum."""
    order = np.argsort(-points.sum(1), kind="stable")
    kept = order[:0]
    for k in range(0, len(order), block):
        new = order[k : k + block]
        new = new[~_beaten(points[new], points[kept])]
        kept = np.concatenate([kept, new[~_beaten(points[new], points[new])]])
    return kept


def pareto(df: DataFrame, key: str, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Rows that no other row is at least as good as in all objectives and better in one; rows with a null objective are left out.

    Rows of equal objectives are one point. Each task leaves out the points
    that another one of its own beats; those left are compared with all others
    that are left, CANDIDATES of them in each pass, whatever their number.
    """
    names = [*maximise, *minimise]
    up = [True] * len(maximise) + [False] * len(minimise)
    d = df.where(reduce(and_, (F.col(c).isNotNull() for c in names)))
    points = d.select(*names).distinct()
    spark = df.sparkSession

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            yield from t.take(pa.array(_front(_places(t.columns, up)))).to_batches()

    def against(sent) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            others = sent.value
            for b in batches:
                t = pa.Table.from_batches([b])
                all_of = _places([pa.chunked_array([*x.chunks, *y.cast(x.type).chunks]) for x, y in zip(t.columns, others.columns)], up)
                yield b.filter(pa.array(~_beaten(all_of[: len(t)], all_of[len(t) :])))

        return run

    left = stage(points.mapInArrow(own, points.schema), "points")
    passes = -(-left.count() // CANDIDATES)
    front = left
    if passes > 1:
        left = stage(left.withColumn("_pass", F.pmod(F.xxhash64(*names), F.lit(passes))), "passes")
    for k in range(passes):
        part = (left.where(F.col("_pass") == k) if passes > 1 else left).select(*names).toArrow()
        front = front.mapInArrow(against(spark.sparkContext.broadcast(part)), points.schema)
    return d.join(front, names, "left_semi").select(*df.columns)


def champion(df: DataFrame, key: str, primary: str, tied: DataFrame, ties: list[Column]) -> DataFrame:
    """key, rank, tied: by the primary metric; the leader and all in ``tied`` (a column of keys) come first, ranked by ``ties``."""
    d = df.join(tied.select(key).distinct().withColumn("tied", F.lit(True)), key, "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    order = [F.desc("tied"), F.when(~F.col("tied"), -F.col(primary)), *ties, F.col(key)]
    return ranked(d, order).select(key, "rank", "tied")


def incidence(df: DataFrame, by: list[str], passed: Column, flags: dict[str, Column]) -> DataFrame:
    """by, n, flagged, share: passed rows that any audit rule flags, among all rows."""
    hit = F.coalesce(passed, F.lit(False)) & reduce(or_, (F.coalesce(c, F.lit(False)) for c in flags.values()))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("flagged"), F.round(F.count_if(hit) / F.count("*"), 6).alias("share"))


def pooled_rate(df: DataFrame, by: list[str], part: Column, whole: Column) -> DataFrame:
    """by, part, whole, rate: a ratio of sums, null over nothing; rows with a null on either side are left out."""
    both = part.isNotNull() & whole.isNotNull()
    a, b = F.sum(F.when(both, part)), F.sum(F.when(both, whole))
    return df.groupBy(*by).agg(F.coalesce(a, F.lit(0)).alias("part"), F.coalesce(b, F.lit(0)).alias("whole"), F.round(a / F.nullif(b, F.lit(0)), 6).alias("rate"))


def stopped_runs(log: DataFrame, run: str, rules: dict[str, Column]) -> DataFrame:
    """run, rule: runs in whose log any row meets a stopping rule."""
    hit = F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())).alias("rule")
    return log.select(run, hit).distinct()


def protocol_rules(loss: Column, validity: Column, reward: Column, hacking: Column, ceiling: float = 0.999) -> dict[str, Column]:
    """Why a run is to be stopped: its loss is no finite number, fewer than half of its outputs are valid, its reward is at the ceiling while a tenth of its episodes are hacked."""
    return {"loss_diverged": F.isnan(loss) | (F.abs(loss) == F.lit(float("inf"))), "low_validity": validity < 0.5, "reward_hacking": (reward >= ceiling) & (hacking > 0.10)}


def word_shingles(text: Column, width: int = 5) -> Column:
    """Distinct hashes of runs of ``width`` words, lower case; a shorter text has one of all its words, one without words none."""
    import xxhash

    @F.arrow_udf("array<long>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            w = (t or "").lower().split()
            grams = {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
            out.append(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams)).view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return cut(text)


def contamination(corpus: DataFrame, corpus_key: str, corpus_text: str, bench: DataFrame, bench_key: str, bench_text: str, least: float = 0.8, width: int = 5, by: str = "jaccard") -> DataFrame:
    """corpus_key, bench_key, shared, jaccard, containment: pairs whose measure ``by`` reaches ``least``.

    jaccard tells near-copies, containment documents that hold an item.

    Documents are shingled where they are; only shingles that some item has
    are kept, by a join on the shingle, and counted by pair.
    """
    c = corpus.select(F.col(corpus_key).alias("_c"), word_shingles(F.col(corpus_text), width).alias("_s"))
    b = bench.select(F.col(bench_key).alias("_b"), word_shingles(F.col(bench_text), width).alias("_s"))
    cs = c.select("_c", F.size("_s").alias("_nc"), F.explode("_s").alias("s"))
    bs = b.select("_b", F.size("_s").alias("_nb"), F.explode("_s").alias("s"))
    both = cs.join(bs, "s").groupBy("_c", "_b", "_nc", "_nb").agg(F.count("*").alias("shared"))
    jaccard, holds = F.col("shared") / (F.col("_nc") + F.col("_nb") - F.col("shared")), F.col("shared") / F.col("_nb")
    return both.where({"jaccard": jaccard, "containment": holds}[by] >= least).select(F.col("_c").alias(corpus_key), F.col("_b").alias(bench_key), "shared", F.round(jaccard, 6).alias("jaccard"), F.round(holds, 6).alias("containment"))
