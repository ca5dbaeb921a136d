"""Preference pairs from verified candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import order_key
from ..functions.text import strip
from .verify import eligible

DECISIONS = ("accepted", "no_passed_candidate", "insufficient_margin", "insufficient_candidates", "identical_texts")


def mine(df: DataFrame, group: str, text: str, index: str, unique: str, verdict: str = "verdict", margin: float = 0.10, shorter: bool = True) -> DataFrame:
    """group, decision, chosen, rejected (of ``unique``), chosen_text, rejected_text, chosen_verdict, rejected_verdict, score_margin: a row per group.

    Candidates rank by score (a null one as 0), then length if ``shorter``,
    then index, then ``unique``. Chosen is the best passed one, rejected the last eligible.
    One pass of partial aggregates: no group is gathered.
    """
    v = F.col(verdict)
    score = F.coalesce(v["score"], F.lit(0.0))
    rank = F.struct((-score).alias("s"), (F.length(text) if shorter else F.lit(0)).alias("n"), F.col(index).alias("i"), F.col(unique).alias("u"))
    row = F.struct(F.col(unique).alias("u"), F.col(text).alias("t"), score.alias("s"), v["status"].alias("v"))
    d = df.select(group, eligible(v).alias("e"), (F.coalesce(v["status"] == "passed", F.lit(False))).alias("p"), rank.alias("rank"), row.alias("row"))
    g = d.groupBy(group).agg(
        F.count_if("e").alias("n"),
        F.min_by(F.when(F.col("p"), F.col("row")), F.when(F.col("p"), F.col("rank"))).alias("c"),
        F.max_by(F.when(F.col("e"), F.col("row")), F.when(F.col("e"), F.col("rank"))).alias("r"),
    )
    gap = F.col("c.s") - F.col("r.s")
    decision = (
        F.when(F.col("n") < 2, "insufficient_candidates")
        .when(F.col("c").isNull(), "no_passed_candidate")
        .when(F.col("c.u") == F.col("r.u"), "insufficient_candidates")
        .when(strip(F.col("c.t")) == strip(F.col("r.t")), "identical_texts")
        .when(gap < margin, "insufficient_margin")
        .otherwise("accepted")
    )
    return _pairs(g, group, decision, gap)


def random_pairs(df: DataFrame, group: str, text: str, unique: str, verdict: str = "verdict", seed: int = 7) -> DataFrame:
    """The same columns for two eligible candidates by hash order, whatever their scores; the control of ``mine``."""
    v = F.col(verdict)
    row = F.struct(F.col(unique).alias("u"), F.col(text).alias("t"), F.coalesce(v["score"], F.lit(0.0)).alias("s"), v["status"].alias("v"))
    key = F.struct(order_key(seed, F.col(unique).cast("string")).alias("h"), F.col(unique).alias("u"))
    d = df.where(eligible(v)).select(group, key.alias("key"), row.alias("row"))
    first = d.groupBy(group).agg(F.count("*").alias("n"), F.min(F.struct("key", "row")).alias("a"))
    rest = d.join(first.select(group, F.col("a.key").alias("first")), group).where("key > first")
    second = rest.groupBy(group).agg(F.min(F.struct("key", "row")).alias("b"))
    g = df.select(group).distinct().join(first, group, "left").join(second, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), F.col("a.row").alias("c"), F.col("b.row").alias("r"))
    decision = F.when(F.col("n") < 2, "insufficient_candidates").when(strip(F.col("c.t")) == strip(F.col("r.t")), "identical_texts").otherwise("accepted")
    return _pairs(g, group, decision, F.col("c.s") - F.col("r.s"))


def _pairs(g: DataFrame, group: str, decision: Column, gap: Column) -> DataFrame:
    ok = F.col("decision") == "accepted"
    d = g.withColumn("decision", decision)
    return d.select(group, "decision", *(F.when(ok, c).alias(n) for n, c in (("chosen", F.col("c.u")), ("rejected", F.col("r.u")), ("chosen_text", F.col("c.t")), ("rejected_text", F.col("r.t")), *((f"{n}_verdict", F.struct(F.col(f"{x}.v").alias("status"), F.col(f"{x}.s").alias("score"))) for n, x in (("chosen", "c"), ("rejected", "r"))), ("score_margin", F.round(gap, 6)))))


def decision_counts(mined: DataFrame) -> DataFrame:
    """decision, n: all five decisions, zeros included."""
    all_ = mined.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    return all_.join(mined.groupBy("decision").count(), "decision", "left").select("decision", F.coalesce("count", F.lit(0)).alias("n"))
