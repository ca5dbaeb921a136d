"""Audits of runs, answers, lengths and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import final_answer, has_marker, last_number, squeeze, strip, tail_repeats, to_number
from .settle import settled


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, and ``copies``: how many there were."""
    cols = [c for c in df.columns if c not in keys]
    d = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"), F.count("*").alias("copies"))
    return d.select(*keys, "_r.*", "copies")


def run_audit(traces: DataFrame, text: str = "prediction", summary: DataFrame | None = None) -> DataFrame:
    """run_id, rows, duplicates, suites, empty, runaway, runaway_rate, mean_chars, max_chars: each run after dropping repeated episodes, the first row wins.

    A text without anything but white space is empty and never runaway.
    summary: run_id and truncated_outputs as counted when the outputs were
    made; adds truncated_outputs, truncation_rate and all_truncated.
    """
    d = first_rows(traces.select("run_id", "suite", "id", "row_ord", text), ["run_id", "suite", "id"], ["row_ord"])
    n = F.length(F.coalesce(text, F.lit("")))
    empty = F.coalesce(strip(F.col(text)) == "", F.lit(True))
    d = d.groupBy("run_id").agg(
        F.count("*").alias("rows"), (F.sum("copies") - F.count("*")).alias("duplicates"), F.countDistinct("suite").alias("suites"), F.count_if(empty).alias("empty"),
        F.count_if(~empty & tail_repeats(F.col(text))).alias("runaway"), F.round(F.avg((~empty & tail_repeats(F.col(text))).cast("double")), 4).alias("runaway_rate"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("max_chars"),
    )
    if summary is None:
        return d
    d = d.join(summary.select("run_id", "truncated_outputs"), "run_id", "left")
    return d.withColumn("truncation_rate", F.round(F.col("truncated_outputs") / F.col("rows"), 4)).withColumn("all_truncated", F.coalesce(F.col("truncated_outputs") >= F.col("rows"), F.lit(False)))


def reason_counts(traces: DataFrame, reason: Column) -> DataFrame:
    """run_id, reason_code, n, place: reasons of each run's distinct episodes, most frequent first, ties by first appearance; a null reason reads ``None``."""
    d = first_rows(traces.select("run_id", "suite", "id", "row_ord", F.coalesce(reason, F.lit("None")).alias("reason_code")), ["run_id", "suite", "id"], ["row_ord"])
    g = d.groupBy("run_id", "reason_code").agg(F.count("*").alias("n"), F.min("row_ord").alias("_first"))
    # As many rows a run as there are reasons.
    return g.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "_first"))).drop("_first")


def run_report(traces: DataFrame, by: str, decoding: Column, conditioning: Column, fingerprint: Column) -> DataFrame:
    """by, suites (map of a suite's episodes and pass rate), decoding, conditioning, freeze_fingerprint: a nested row per run."""
    ok = F.avg(F.when(F.col("verdict.status").isin("passed", "failed"), (F.col("verdict.status") == "passed").cast("double")))
    s = traces.groupBy(by, "suite").agg(F.count("*").alias("episodes"), F.round(ok, 4).alias("pass_rate"))
    suites = F.map_from_entries(F.array_sort(F.collect_list(F.struct("suite", F.struct("episodes", "pass_rate")))))
    return s.groupBy(by).agg(suites.alias("suites")).select(by, "suites", decoding.alias("decoding"), conditioning.alias("conditioning"), fingerprint.alias("freeze_fingerprint"))


def answer_drift(df: DataFrame, by: list[str], text: str, gold: str, passed: Column) -> DataFrame:
    """by, n, pass_rate, marker_rate, drifted, drift_failures: answers whose marked result isn't their last number.

    Rows without text or gold are left out. drift_failures: drifted answers
    that fail although the marked result alone would pass.
    """
    plain = lambda c: F.regexp_replace(F.translate(c, ",", ""), r"\.+$", "")
    d = df.where((F.col(text) != "") & F.col(gold).isNotNull()).select(*by, F.coalesce(passed, F.lit(False)).alias("_ok"), F.col(gold).alias("_gold"), has_marker(F.col(text)).alias("_marked"), F.col(text).alias("_text"))
    d = settled(d, _anchored=final_answer(F.col("_text")), _last=last_number(F.col("_text")))
    d = settled(d, _again=F.when(F.col("_marked") & ~F.col("_ok"), final_answer(F.concat(F.lit("#### "), "_anchored"))), _b=to_number(F.col("_gold")))
    a = to_number(F.col("_again"))
    alone = F.coalesce(F.when(a.isNotNull() & F.col("_b").isNotNull(), F.abs(a - F.col("_b")) < 1e-6).otherwise(squeeze(F.col("_again")) == squeeze(F.col("_gold"))), F.lit(False))
    drift = F.coalesce(F.col("_marked") & (plain(F.col("_anchored")) != plain(F.col("_last"))), F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    return d.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("_ok")).alias("pass_rate"), rate(F.col("_marked")).alias("marker_rate"), F.count_if(drift).alias("drifted"), F.count_if(drift & ~F.col("_ok") & alone).alias("drift_failures"))


def cap_audit(df: DataFrame, prompt: str, full: str, caps: list[int]) -> DataFrame:
    """cap, n, truncated, lost, partial: rows longer than a cap, those whose prompt alone fills it, and those cut within the answer."""
    d = df.select(F.explode(F.array(*map(F.lit, caps))).alias("cap"), F.col(prompt).alias("p"), F.col(full).alias("f"))
    return d.groupBy("cap").agg(F.count("*").alias("n"), F.count_if(F.expr("f > cap")).alias("truncated"), F.count_if(F.expr("p >= cap")).alias("lost"), F.count_if(F.expr("p < cap and f > cap")).alias("partial"))


def norms(df: DataFrame, vector: str) -> DataFrame:
    """Adds norm and zeros: length of a vector, and whether all of it is 0; null for null."""
    v = F.col(vector)
    return df.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).withColumn("zeros", F.forall(v, lambda x: x == 0))


def norm_outliers(df: DataFrame, vector: str, key: str, ratio: float = 10.0, top: int = 5) -> DataFrame:
    """key, norm, ratio, outlier of the ``top`` longest vectors against the mean length."""
    d = norms(df, vector).where("norm is not null")
    mean = d.agg(F.avg("norm").alias("mean"))
    d = d.crossJoin(F.broadcast(mean)).select(key, "norm", (F.col("norm") / F.nullif("mean", F.lit(0.0))).alias("ratio"))
    return d.orderBy(F.desc("norm"), key).limit(top).select(key, F.round("norm", 6).alias("norm"), F.round("ratio", 6).alias("ratio"), F.coalesce(F.col("ratio") > ratio, F.lit(False)).alias("outlier"))


def tensor_differences(df: DataFrame, folder: str, name: str, vector: str) -> DataFrame:
    """a, b, common, only_a, only_b, identical, max_abs_diff for each two folders a < b.

    Folders are few; tensors meet by name only.
    """
    t = df.select(F.col(folder).alias("f"), F.col(name).alias("k"), F.col(vector).alias("v"))
    sizes = t.groupBy("f").agg(F.count("*").alias("n"))
    a, b = t.select(F.col("f").alias("a"), "k", F.col("v").alias("va")), t.select(F.col("f").alias("b"), "k", F.col("v").alias("vb"))
    gap = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    met = a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.count_if(F.col("va") == F.col("vb")).alias("identical"), F.max(gap).alias("max_abs_diff"))
    x, y = sizes.select(F.col("f").alias("a"), F.col("n").alias("na")), sizes.select(F.col("f").alias("b"), F.col("n").alias("nb"))
    every = x.join(y, F.col("a") < F.col("b"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return every.join(met, ["a", "b"], "left").select("a", "b", z("common").alias("common"), (F.col("na") - z("common")).alias("only_a"), (F.col("nb") - z("common")).alias("only_b"), z("identical").alias("identical"), F.round("max_abs_diff", 6).alias("max_abs_diff"))


def stop_rank(probabilities: Column, at: Column) -> Column:
    """1-based rank of one entry of a distribution: entries that are larger, plus one."""
    return F.size(F.filter(probabilities, lambda p: p > F.get(probabilities, at))) + 1


def top_entries(values: Column, k: int) -> Column:
    """The ``k`` largest entries, largest first."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def floor_quantile(values: Column, q: float) -> Column:
    """Element at floor(q * (n - 1)) of the sorted values; null for none."""
    return F.get(F.sort_array(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def span_means(values: Column, cut: Column) -> tuple[Column, Column]:
    """Means of the entries before and from a position; null of an empty span."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double")) / F.nullif(F.size(a), F.lit(0))
    return mean(F.slice(values, F.lit(1), cut)), mean(F.slice(values, cut + 1, F.greatest(F.size(values) - cut, F.lit(0))))


def masked(labels: Column, ignore: int = -100) -> Column:
    """Entries that aren't masked."""
    return F.filter(labels, lambda x: x != ignore)


def hits_cap(ids: Column, cap: int, stops: list[int]) -> Column:
    """An output of exactly ``cap`` ids with no stop id among them."""
    return (F.size(ids) == cap) & ~F.arrays_overlap(ids, F.array(*map(F.lit, stops)))


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first name whose bound the value reaches."""
    out = None
    for bound, name in steps:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return F.lit(last) if out is None else out.otherwise(last)


def nll_profile(nlls: Column, labels: Column, ids: Column, stop: int, ignore: int = -100) -> Column:
    """supervised, mean, p50, p90, stop_at, stop_nll of the positions that count in a loss; entry 0 never does.

    nlls: the loss of each position; quantiles are the elements at
    floor(q * (n - 1)). stop_at: the last position of the stop id that counts.
    """
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: (i < F.size(labels)) & (F.get(labels, i) != ignore))
    x = F.transform(at, lambda i: F.get(nlls, i).cast("double"))
    stops = F.filter(at, lambda i: F.get(ids, i) == stop)
    last = F.try_element_at(stops, F.lit(-1))
    return F.struct(
        F.size(at).alias("supervised"), F.round(F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(x), F.lit(0)), 4).alias("mean"), F.round(floor_quantile(x, 0.5), 4).alias("p50"), F.round(floor_quantile(x, 0.9), 4).alias("p90"),
        last.alias("stop_at"), F.round(F.get(nlls, last).cast("double"), 4).alias("stop_nll"),
    )


def label_mask(ids: Column, labels: Column, pad: int, stops: list[int], ignore: int = -100) -> Column:
    """terminal, is_stop, masked: the last position that isn't padding, whether a stop id stands there, and whether the stop id that should be learned is masked.

    Padding is a masked pad id at the end, so that a stop id with a live label
    counts even where it equals the pad id. Without a stop id at the end, the
    last stop id anywhere is looked at.
    """
    place = F.sequence(F.size(ids) - 1, F.lit(0), F.lit(-1))
    live = F.filter(place, lambda i: (F.get(ids, i) != pad) | (F.get(labels, i) != ignore) | (i == 0))
    end = F.get(live, F.lit(0))
    stop = F.array(*map(F.lit, stops))
    fallback = F.get(F.filter(place, lambda i: F.array_contains(stop, F.get(ids, i))), F.lit(0))
    is_stop = F.array_contains(stop, F.get(ids, end))
    return F.when(F.size(ids) > 0, F.struct(end.alias("terminal"), is_stop.alias("is_stop"), F.coalesce(F.get(labels, F.when(is_stop, end).otherwise(fallback)) == ignore, F.lit(False)).alias("masked")))


def boundary_mismatch(whole: Column, prompt: Column) -> Column:
    """0-based place where the beginning of ``whole`` differs from ``prompt``; null where the prompt is a prefix."""
    n = F.size(prompt)
    at = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ~F.get(whole, i).eqNullSafe(F.get(prompt, i)))
    return F.get(at, F.lit(0))


def arm_verdicts(arms: DataFrame, arm: str, disk: str, live: str, probe: str) -> DataFrame:
    """a, b, disk_equal, live_equal, probe_equal, finding for each two arms a < b; arms are few by definition."""
    side = lambda k: arms.select(F.col(arm).alias(k), *(F.col(c).alias(f"{k}_{n}") for c, n in ((disk, "disk"), (live, "live"), (probe, "probe"))))
    equal = {n: F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")).alias(f"{n}_equal") for n in ("disk", "live", "probe")}
    d = side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b")).select("a", "b", *equal.values())
    finding = F.when(F.col("live_equal") & ~F.col("disk_equal"), "loader_leakage").when(~F.col("live_equal") & F.col("probe_equal"), "degenerate_application").when(~F.col("live_equal"), "healthy").otherwise("same_adapter")
    return d.withColumn("finding", finding)


def implausible_lengths(df: DataFrame, length: str, least: int = 16) -> DataFrame:
    """longest: a row if even the longest of some texts is shorter than ``least``; no texts give no row."""
    return df.agg(F.max(length).alias("longest")).where(F.col("longest") < least)
