"""Summaries of runs, resampling, tests and corrections."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .verify import eligible


def suite_summary(traces: DataFrame, by: list[str], verdict: str = "verdict", legal: str | None = None) -> DataFrame:
    """by, episodes, eligible, pass_rate, mean_score, legal_action_rate: rates over eligible rows only, null scores as 0; null without any.

    legal: a column with each episode's share of legal actions; the rate is
    the mean of those that have one.
    """
    v = F.col(verdict)
    e = eligible(v)
    rate = lambda c: F.round(F.avg(F.when(e, c)), 6)
    legality = F.round(F.avg(F.col(legal).cast("double")), 6) if legal else F.lit(None).cast("double")
    return traces.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_if(e).alias("eligible"), rate((v["status"] == "passed").cast("double")).alias("pass_rate"), rate(F.coalesce(v["score"], F.lit(0.0))).alias("mean_score"), legality.alias("legal_action_rate"))


def suite_intervals(traces: DataFrame, by: list[str], key: str, verdict: str = "verdict", legal: str | None = None, resamples: int = 10_000) -> DataFrame:
    """by, metric, n, mean, ci_low, ci_high: the metrics of ``suite_summary`` with their bootstrap intervals; a metric that no row has is left out."""
    v = F.col(verdict)
    e = eligible(v)
    values = {"pass_rate": F.when(e, (v["status"] == "passed").cast("double")), "mean_score": F.when(e, F.coalesce(v["score"], F.lit(0.0)))}
    if legal:
        values["legal_action_rate"] = F.col(legal).cast("double")
    return bootstrap_intervals(traces, by, values, key, resamples)


def failure_taxonomy(traces: DataFrame, by: list[str], order: str, verdict: str = "verdict") -> DataFrame:
    """by, reason_code, n, place: failures by reason, most frequent first, ties by first appearance."""
    d = traces.where(F.col(verdict)["status"] == "failed").select(*by, F.coalesce(F.col(verdict)["reason_code"], F.lit("unknown")).alias("reason_code"), order)
    d = d.groupBy(*by, "reason_code").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first"))).drop("_first")


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet; the keys are those of ``a``."""
    other = b.select(*(F.col(c).alias(f"_b_{c}") for c in keys), *(c for c in b.columns if c not in keys))
    return a.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys))).drop(*(f"_b_{c}" for c in keys))


#: Rows of a group that are resampled in one piece.
PIECE = 2_000


def _resampled(d: DataFrame, by: list[str], width: int, resamples: int, alpha: float, seed: int, flips: bool) -> DataFrame:
    """by, at, low, high, hits of the groups' arrays of ``width`` values ``_v`` with keys ``_k``; a null value takes no part.

    Each group, or piece of a large one, adds its rows' draws into arrays of
    ``resamples`` sums; only pieces' arrays are shuffled, never a row a
    resample. All values of a row share its draws.
    """
    spark = d.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    pieces = F.least(F.ceil(F.col("_n") / PIECE), F.lit(slots)).cast("int")
    counts = d.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, pieces.alias("_of"))
    d = _beside(d, counts, by).withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_of")).cast("int")).repartition(slots, *by, "_part")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*by).schema)

    def ends(sums: np.ndarray, totals: np.ndarray) -> dict:
        out: dict = {"at": [], "low": [], "high": [], "hits": []}
        for j, ((w, wv, below), total) in enumerate(zip(sums, totals)):
            m = np.sort(wv[w > 0] / w[w > 0])
            at = lambda q: float(m[min(math.floor(q * len(m)), len(m) - 1)]) if len(m) else None  # noqa: B023, E731
            for k, x in zip(out, (j, at(alpha / 2), at(1 - alpha / 2), int((np.abs(2 * below - total) >= abs(total) - 1e-9).sum()))):
                out[k].append(x)
        return out

    sent = {"at": pa.int32(), "low": pa.float64(), "high": pa.float64(), "hits": pa.int64()}

    def rows(first: pa.Table, n: int, got: dict, kinds: dict) -> pa.Table:
        key = first.slice(0, 1).select(by)
        return pa.table([*(pa.concat_arrays([c.combine_chunks()] * n) if n != 1 else c for c in key.columns), *(pa.array(got.get(c, [None] * n), t) for c, t in kinds.items())], names=[*by, *kinds])

    def piece(t: pa.Table) -> pa.Table:
        sums, totals = np.zeros((width, 3, resamples)), np.zeros(width)
        for k, values in zip(t.column("_k").to_pylist(), t.column("_v").to_pylist()):
            x = draws.weights(str(seed), resamples, k)
            half = draws.lower_half(f"flip{seed}", resamples, k) if flips else None
            for j, v in enumerate(values):
                if v is None:
                    continue
                sums[j, 0] += x
                if v:
                    sums[j, 1] += x * v
                    totals[j] += v
                    if flips:
                        sums[j, 2] += half * v
        if t.column("_of")[0].as_py() > 1:
            return rows(t, 1, {"sums": [sums.tobytes()], "totals": [totals.tobytes()]}, sent | {"sums": pa.binary(), "totals": pa.binary()})
        return rows(t, width, ends(sums, totals), sent | {"sums": pa.binary(), "totals": pa.binary()})

    def merged(t: pa.Table) -> pa.Table:
        if t.column("sums")[0].as_py() is None:
            return t.select([*by, *sent])
        sums, totals = np.zeros((width, 3, resamples)), np.zeros(width)
        for x, y in zip(t.column("sums"), t.column("totals")):
            sums += np.frombuffer(x.as_buffer()).reshape(sums.shape)
            totals += np.frombuffer(y.as_buffer())
        return rows(t, width, ends(sums, totals), sent)

    parts = d.groupBy(*by, "_part").applyInArrow(piece, f"{kinds}, at int, low double, high double, hits long, sums binary, totals binary")
    return parts.groupBy(*by).applyInArrow(merged, f"{kinds}, at int, low double, high double, hits long")


def bootstrap_intervals(df: DataFrame, by: list[str], values: dict[str, Column], key: str, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by, metric, n, mean, ci_low, ci_high: percentile bootstrap of several values whose weights are Poisson(1) draws by row and resample.

    The percentiles stand at floor(q * resamples). ``key`` is unique; null
    values are left out, as are metrics without any.
    """
    groups = by or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(1))
    d = d.select(*groups, F.col(key).cast("string").alias("_k"), F.array(*(c.cast("double") for c in values.values())).alias("_v")).where(F.exists("_v", lambda x: x.isNotNull()))
    names = list(values)
    point = d.groupBy(*groups).agg(*(f(F.get("_v", F.lit(j))).alias(f"_{k}{j}") for j in range(len(names)) for k, f in (("n", F.count), ("m", F.avg))))
    point = point.select(*groups, F.explode(F.array(*(F.struct(F.lit(j).alias("at"), F.lit(m).alias("metric"), F.col(f"_n{j}").alias("n"), F.col(f"_m{j}").alias("mean")) for j, m in enumerate(names)))).alias("p")).select(*groups, "p.*").where("n > 0")
    got = _resampled(d, groups, len(names), resamples, alpha, seed, False)
    return _beside(point, got, [*groups, "at"]).select(*by, "metric", "n", *(F.round(c, 6).alias(name) for c, name in (("mean", "mean"), ("low", "ci_low"), ("high", "ci_high"))))


def poisson_bootstrap(df: DataFrame, by: list[str], value: Column, key: str, resamples: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by, n, mean, ci_low, ci_high: ``bootstrap_intervals`` of one value."""
    return bootstrap_intervals(df, by, {"value": value}, key, resamples, alpha, seed).drop("metric")


def classic_bootstrap(values: list[float], resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """(mean, low, high) by drawing with replacement from a seeded stream; the ends stand at floor(q * resamples) of the sorted means."""
    x = np.asarray(values, float)
    if not x.size:
        raise ValueError("no values")
    rng = np.random.default_rng(seed)
    block = max(1, 4_000_000 // x.size)
    means = np.concatenate([x[rng.integers(x.size, size=(min(block, resamples - k), x.size))].mean(axis=1) for k in range(0, resamples, block)])
    ends = [min(resamples - 1, math.floor(q * resamples)) for q in (alpha / 2, 1 - alpha / 2)]
    low, high = np.partition(means, ends)[ends]
    return float(x.mean()), float(low), float(high)


def small_group_bootstrap(df: DataFrame, by: str, value: str, order: str, largest: int = 100_000, **options) -> DataFrame:
    """by, mean, ci_low, ci_high with the seeded stream, for suites of bounded size; larger groups are an error."""
    if df.groupBy(by).count().where(F.col("count") > largest).limit(1).count():
        raise ValueError(f"a group has more than {largest} rows; use poisson_bootstrap")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, low, high = classic_bootstrap(pdf.sort_values(order)[value].tolist(), **options)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [mean], "ci_low": [low], "ci_high": [high]})

    return df.select(by, value, order).where(F.col(value).isNotNull()).groupBy(by).applyInPandas(one, f"{by} string, mean double, ci_low double, ci_high double")


def episode_scores(traces: DataFrame, keys: list[str], order: str, verdict: str = "verdict") -> DataFrame:
    """keys, score, passed: the last row of each episode; a null score counts as 0."""
    row = F.struct(F.coalesce(F.col(verdict)["score"], F.lit(0.0)).alias("score"), F.coalesce((F.col(verdict)["status"] == "passed").cast("double"), F.lit(0.0)).alias("passed"))
    return traces.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.score", "r.passed")


def paired_tests(pairs: DataFrame, by: list[str], a: str, b: str, key: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """by, n, mean_a, mean_b, delta, ci_low, ci_high, significant, p_value of paired values."""
    got = compared_metrics(pairs, by, {"value": (F.col(a), F.col(b))}, key, resamples, seed)
    return got.select(*by, "n", "mean_a", "mean_b", "delta", "ci_low", "ci_high", "significant", "p_value")


def compared_metrics(pairs: DataFrame, by: list[str], metrics: dict[str, tuple[Column, Column]], key: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """by, metric, n, then mean, low and high of either side, delta, ci_low, ci_high, significant, p_value of paired values.

    Intervals are Poisson bootstraps, that of the difference among them; the
    p-value comes from random sign flips, (1 + hits) / (1 + resamples). All
    draw by key and resample. A pair with a null on either side is left out of
    that metric.
    """
    both = [c for a, b in metrics.values() for c in (a, b, a - b)]
    keep = [a.isNotNull() & b.isNotNull() for a, b in metrics.values() for _ in range(3)]
    d = pairs.select(*by, F.col(key).cast("string").alias("_k"), F.array(*(F.when(ok, c.cast("double")) for c, ok in zip(both, keep))).alias("_v")).where(F.exists("_v", lambda x: x.isNotNull()))
    at = lambda j: F.get("_v", F.lit(j))
    point = d.groupBy(*by).agg(*(x for m in range(len(metrics)) for x in (F.count(at(3 * m)).alias(f"_n{m}"), *(F.round(F.avg(at(3 * m + k)), 6).alias(f"_m{m}{k}") for k in range(3)))))
    rows = [F.struct(F.lit(m).alias("at"), F.lit(name).alias("metric"), F.col(f"_n{m}").alias("n"), *(F.col(f"_m{m}{k}").alias(c) for k, c in enumerate(("mean_a", "mean_b", "delta")))) for m, name in enumerate(metrics)]
    point = point.select(*by, F.explode(F.array(*rows)).alias("p")).select(*by, "p.*").where("n > 0")
    got = _resampled(d, by, len(both), resamples, 0.05, seed, True).select(*by, F.floor(F.col("at") / 3).cast("int").alias("at"), (F.col("at") % 3).alias("side"), "low", "high", "hits")
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    got = got.groupBy(*by, "at").agg(*(F.round(side(k, c), 6).alias(f"{c}_{s}") for k, s in ((0, "a"), (1, "b")) for c in ("low", "high")), F.round(side(2, "low"), 6).alias("ci_low"), F.round(side(2, "high"), 6).alias("ci_high"), side(2, "hits").alias("hits"))
    return _beside(point, got, [*by, "at"]).select(*by, "metric", "n", "mean_a", "low_a", "high_a", "mean_b", "low_b", "high_b", "delta", "ci_low", "ci_high", (~F.lit(0.0).between(F.col("ci_low"), F.col("ci_high"))).alias("significant"), F.round((1 + F.col("hits")) / F.lit(1 + resamples), 6).alias("p_value"))


def comparison_lines(compared: DataFrame, label: list[str]) -> DataFrame:
    """label, metric, line: each comparison as a line of a table of fixed widths."""
    num = lambda f, *c: F.format_string(f, *(F.col(x) for x in c))
    line = F.concat_ws(" ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 20, " ") for c in label), F.rpad("metric", 11, " "), num("%10.4f %10.4f %+8.4f", "mean_a", "mean_b", "delta"), F.lpad(num("[%+.3f,%+.3f]", "ci_low", "ci_high"), 18, " "), num("%9.5f", "p_value"), F.when(F.col("significant"), "YES").otherwise("no"))
    return compared.select(*label, "metric", line.alias("line"))


def accuracy(df: DataFrame, family: str, verdict: str = "verdict") -> DataFrame:
    """family (null for all), n, accuracy: everything but passed counts as 0; all and each in one pass."""
    d = df.select(F.col(family).alias("family"), F.coalesce((F.col(verdict)["status"] == "passed").cast("double"), F.lit(0.0)).alias("p"))
    d = d.groupingSets([[], ["family"]], "family").agg(F.grouping("family").alias("overall"), F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("accuracy"))
    return d


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds ``adjusted``: step-down corrected p-values. The family of tests is small by definition."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(p, name))
    d = df.withColumn("_m", F.count(p).over(everything)).withColumn("_r", rank)
    return d.withColumn("adjusted", F.round(F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_m", "_r")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the mean rank of a value among all, ties sharing theirs; over counts of distinct values, which ``running`` spreads by ranges."""
    from .ordering import running

    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    placed = running(counts, [value], "_c", "_b").select(value, (F.col("_b") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(placed, value)


def spearman(df: DataFrame, x: str, y: str, key: str | None = None, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """n, rho, and with a unique ``key`` ci_low and ci_high: correlation of mean ranks; rows with a null are left out.

    The interval is a Poisson bootstrap of the rows with their ranks in all
    rows; percentiles stand at floor(q * resamples) of the defined values.
    """
    d = df.select(x, y, *([key] if key else [])).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_ranks(average_ranks(d, x, "_rx"), y, "_ry")
    point = d.agg(F.count("*").alias("n"), F.round(F.corr("_rx", "_ry"), 6).alias("rho"))
    if key is None:
        return point

    def sums(batches):
        # Weighted sums of 1, x, y, xx, yy, xy of each resample.
        out = np.zeros((6, resamples))
        for b in batches:
            for k, u, v in zip(*(c.to_pylist() for c in b.columns)):
                w = draws.weights(str(seed), resamples, k)
                out += np.array([1, u, v, u * u, v * v, u * v])[:, None] * w
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([out.tobytes()], pa.binary())], ["one", "sums"])

    def ends(t: pa.Table) -> pa.Table:
        w, a, b, aa, bb, ab = sum(np.frombuffer(x.as_buffer()).reshape(6, resamples) for x in t.column("sums"))
        spread = (w * aa - a * a) * (w * bb - b * b)
        ok = spread > 1e-9
        r = np.sort((w * ab - a * b)[ok] / np.sqrt(spread[ok]))
        got = [float(r[min(math.floor(q * len(r)), len(r) - 1)]) if len(r) else None for q in (alpha / 2, 1 - alpha / 2)]
        return pa.table([pa.array([x], pa.float64()) for x in got], names=["low", "high"])

    # Ranks around their middle keep the sums small.
    middle = d.agg(F.avg("_rx").alias("_mx"))
    d = d.crossJoin(F.broadcast(middle)).select(F.col(key).cast("string").alias("k"), ((F.col("_rx") - F.col("_mx")) / F.col("_mx")).alias("u"), ((F.col("_ry") - F.col("_mx")) / F.col("_mx")).alias("v"))
    interval = d.mapInArrow(sums, "one long, sums binary").groupBy("one").applyInArrow(ends, "low double, high double")
    return point.crossJoin(F.broadcast(interval)).select("n", "rho", F.round("low", 6).alias("ci_low"), F.round("high", 6).alias("ci_high"))


def nearest_rank(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by, n, q, value: the element at round-half-even(q * (n - 1)) of the sorted values.

    Values are counted first; only distinct ones are ranked, so that a hot
    group costs no more than its distinct values.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_hi", F.sum("_c").over(up)).withColumn("n", F.sum("_c").over(w))
    c = c.withColumn("q", F.explode(F.array(*map(F.lit, qs)))).withColumn("_at", F.bround(F.col("q") * (F.col("n") - 1)))
    return c.where((F.col("_at") < F.col("_hi")) & (F.col("_at") >= F.col("_hi") - F.col("_c"))).select(*by, "n", "q", F.col(value).alias("value"))
