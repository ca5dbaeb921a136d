"""Gates on records: each yields the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Status moves that a run may make, and artifacts that a complete run holds (fixed values).
MOVES = {"pending": ("running",), "running": ("completed", "failed", "aborted")}
ARTIFACTS = ("resolved_config.yaml", "environment_manifest.json", "dataset_manifest.json", "git_state.json", "run_card.json", "metrics.json", "lineage.json", "checkpoint_pointer.json")


class ContractError(ValueError):
    """A gate found rows that break its rule."""


def conversation_rules(messages: Column) -> dict[str, Column]:
    """Rules of a supervised record's conversation; True where broken. A null conversation breaks the length rule only."""
    role = lambda r: lambda m: F.coalesce(m["role"] == r, F.lit(False))
    n = F.coalesce(F.size(messages), F.lit(0))
    return {
        "blank_content": F.coalesce(F.exists(messages, lambda m: F.coalesce(strip(m["content"]) == "", F.lit(True))), F.lit(False)),
        "too_few_messages": F.when(messages.isNull(), True).otherwise(n < 2),
        "last_not_assistant": F.coalesce((n > 0) & ~F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False)), F.lit(False)),
        "no_user": F.coalesce((n > 0) & ~F.exists(messages, role("user")), F.lit(False)),
    }


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row per rule that a row breaks."""
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def preference_rules(df: DataFrame) -> dict[str, Column]:
    """Rules of a preference record with chosen, rejected, chosen_status and selection_method."""
    return {
        "identical_texts": F.coalesce(strip(F.col("chosen")) == strip(F.col("rejected")), F.lit(False)),
        "chosen_not_passed": F.coalesce((F.col("selection_method") == "hybrid_verifier_rank") & ~F.coalesce(F.col("chosen_status") == "passed", F.lit(False)), F.lit(False)),
    }


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n: keys of more than one row; nulls are no key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def leaking(df: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """Rows whose key is forbidden; null keys never are."""
    return df.join(forbidden.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def without_leaks(df: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't forbidden; null keys stay."""
    return df.join(forbidden.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key))


def id_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """n_both, n_only_a, n_only_b: distinct keys of two tables compared."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, keys, "full_outer")
    return j.agg(F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("n_only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("n_only_b"))


def missing_members(df: DataFrame, group: str, member: str, required: DataFrame) -> DataFrame:
    """group, member: required members that a group lacks. The required set is small by definition."""
    groups = df.select(group).distinct()
    wanted = groups.crossJoin(F.broadcast(required.select(member).distinct()))
    return wanted.join(df.select(group, member).distinct(), [group, member], "left_anti")


def illegal_moves(log: DataFrame, key: str, status: str, order: list[str], moves: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """key, before, after: successive statuses of a key that no rule allows; a first status must be pending."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.select(key, F.lag(status).over(w).alias("before"), F.col(status).alias("after"))
    allowed = F.lit(False)
    for a, bs in (moves or MOVES).items():
        allowed = allowed | ((F.col("before") == a) & F.col("after").isin(*bs))
    return steps.where(~F.coalesce(F.when(F.col("before").isNull(), F.col("after") == "pending").otherwise(allowed), F.lit(False)))


def mismatched(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """key, actual, expected: keys whose value differs from the frozen one or that only one side has."""
    a, e = actual.select(key, F.col(value).alias("actual")), expected.select(key, F.col(value).alias("expected"))
    return a.join(e, key, "full_outer").where(~F.col("actual").eqNullSafe(F.col("expected")))


def assert_empty(df: DataFrame, message: str) -> None:
    """Raises with a few of the rows if there are any."""
    rows = df.limit(5).collect()
    if rows:
        raise ContractError(f"{message}: {[r.asDict() for r in rows]}")


def assert_filled(df: DataFrame, message: str = "no records") -> None:
    if df.isEmpty():
        raise ContractError(message)
