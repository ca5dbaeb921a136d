"""Building corpora: quotas, deduplication, splits, rejection sampling, exemplars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import order_key, uniform
from ..functions.text import squeeze, strip
from ..sources.tables import stage
from .ordering import ranked, running


def quotas(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole parts of each source's share of ``total``; no or negative weights are an error."""
    whole = sum(weights.values())
    if whole <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    return {s: int(total * w / whole) for s, w in weights.items()}


def first_by_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One row per key, the first in the order; rows of a null key are dropped."""
    cols = df.columns
    first = df.withColumn("_k", key).where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def sequential_mixture(df: DataFrame, source: str, weights: dict[str, float], total: int, text: str, key: str, seed: int = 42) -> DataFrame:
    """Rows of each source in turn up to its quota, in hash order, without texts that an earlier row has.

    Texts are compared squeezed; blank ones are left out; a source is only
    held back by what earlier sources took, and what is skipped uses up no
    quota. ``key`` is a unique column.
    """
    taken, out = None, None
    for s, quota in quotas(weights, total).items():
        d = df.where(F.col(source) == s).withColumn("_text", squeeze(F.col(text))).where("_text <> ''").withColumn("_h", order_key(seed, F.col(key).cast("string")))
        d = first_by_key(d, F.col("_text"), ["_h", key])
        if taken is not None:
            d = d.join(taken, "_text", "left_anti")
        got = stage(ranked(d, ["_h", key]).where(F.col("rank") <= quota).drop("rank"), "taken")
        texts = got.select("_text")
        taken = texts if taken is None else taken.unionByName(texts)
        part = got.drop("_text", "_h")
        out = part if out is None else out.unionByName(part)
    return out


def holdout(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Adds ``part``: the last ``n`` rows in hash order are the holdout; all of them where there are fewer."""
    d = ranked(df.withColumn("_h", order_key(seed, F.col(key).cast("string"))), ["_h", key])
    total = df.count()
    return d.withColumn("part", F.when(F.col("rank") > total - n, "holdout").otherwise("train")).drop("_h", "rank")


def family_split(families: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """key, part: whole families in hash order; at least one on the eval side, and one on the train side if there are two."""
    f = families.select(key).distinct()
    total = f.count()
    cut = max(min(int(total * share), total - 1), 1) if total > 1 else 0
    d = ranked(f.withColumn("_h", order_key(seed, F.col(key).cast("string"))), ["_h", key])
    return d.select(key, F.when(F.col("rank") <= cut, "train").otherwise("eval").alias("part"))


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A fixed share of the rows, chosen by their key."""
    return df.where(uniform(F.lit(str(seed)), F.col(key).cast("string")) < share)


def within_budget(df: DataFrame, order: list[str], size: str, budget: Column | int) -> DataFrame:
    """Rows in order for as long as their running size stays within the budget."""
    return running(df, order, size, "_before").where(F.col("_before") + F.coalesce(F.col(size), F.lit(0)) <= budget).drop("_before")


def rejection_sample(df: DataFrame, group: str, text: str, passed: Column, order: list[str]) -> DataFrame:
    """The shortest passing text of each group, first in order among equals; groups without one are left out."""
    d = df.where(passed).withColumn("_n", F.length(strip(F.col(text))))
    cols = [c for c in d.columns if c != group]
    best = d.groupBy(group).agg(F.min_by(F.struct(*cols), F.struct("_n", *order)).alias("_r"))
    return best.select(group, "_r.*").drop("_n")


def exemplars(df: DataFrame, messages: str, order: str, n: int) -> DataFrame:
    """order, prompt, answer: last user and last assistant turn of the first ``n`` records that have both."""
    last = lambda r: F.try_element_at(F.filter(messages, lambda m: m["role"] == r), F.lit(-1))["content"]
    d = df.select(order, last("user").alias("prompt"), last("assistant").alias("answer"))
    return d.where("trim(prompt) <> '' and trim(answer) <> ''").orderBy(order).limit(n)


def few_shot(messages: Column, shots: Column, opener: str = "") -> Column:
    """Exemplars as alternating turns, then the conversation; ``opener`` follows as the start of the answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    before = F.flatten(F.transform(shots, lambda s: F.array(turn("user", s["prompt"]), turn("assistant", s["answer"]))))
    out = F.concat(before, messages)
    return F.concat(out, F.array(turn("assistant", F.lit(opener)))) if opener else out


def expand_candidates(requests: DataFrame, request: str, n: str) -> DataFrame:
    """Adds candidate_id and cand_index: ``n`` rows per request, none where it is null or not positive."""
    return requests.where(F.col(n) > 0).withColumn("cand_index", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))).withColumn("candidate_id", F.concat(F.col(request), F.lit("-c"), F.col("cand_index")))


def newest(df: DataFrame, group: str, step: Column, keep: int) -> DataFrame:
    """Adds step, age and ``kept``: the ``keep`` highest steps of each group."""
    d = df.withColumn("step", step).where("step is not null")
    return d.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("step")))).withColumn("kept", F.col("age") <= keep)
