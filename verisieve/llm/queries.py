"""Queries of the training-data operators and, where SQL can tell, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import prepared
from ..sources.tables import stage, table
from . import defects, leaks, mixture, overlaps, reading, splits, truncation


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.bound_families(table(spark, d, "sft_records"), table(spark, d, "families"))


def p4_assignment(spark: SparkSession, d: str) -> DataFrame:
    out = splits.assign_splits(*(table(spark, d, t) for t in ("sft_records", "families", "split_targets")))
    return out.select("row_ord", "id", "split_name")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets")
    return splits.split_shares(splits.assign_splits(table(spark, d, "sft_records"), table(spark, d, "families"), targets), targets)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.evaluation_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p5_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, d))


def p5_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.clean_documents(docs, _leaks(spark, d)).select("doc_id", "source", "n_chars")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    o = overlaps.cross_split_overlaps(table(spark, d, "sft_records"))
    return o.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_counts(table(spark, d, "sft_records"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_outputs(truncation.outputs(table(spark, d, "candidates"), table(spark, d, "traces")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).select("tab", "row_ord")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(_cut(spark, d), table(spark, d, "candidates"), table(spark, d, "traces"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective_pairs(table(spark, d, "sft_records"), table(spark, d, "candidates"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("tab", "defect").agg(F.count("*").alias("n"))


def _mixture(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    sizes = stage(mixture.token_counts(table(spark, d, "documents")), "tokens")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0 if whole else None
    rates = stage(mixture.plan_rates(sizes, table(spark, d, "mix_targets"), total), "rates")
    return mixture.balanced_mixture(sizes, rates), rates


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached_shares(*_mixture(spark, d))


def p6_shares_at_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached_shares(*_mixture(spark, d, whole=True))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4").select("doc_id")


def p7_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level")


def p7_source_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.source_profile(_levels(spark, d), table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: prepared(f) for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}



def _label(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '(^|[^\\p{{N}}])0+(\\p{{N}})', '\\1\\2', 'g')"
    return f"nullif({plain}, '')"


_AUTHOR = "lower(regexp_replace(regexp_replace(metadata['author'], '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), '^@\\s*', ''))"
_TIED = f"""WITH RECURSIVE r AS (SELECT 'rec:' || id AS rec, 'fam:' || coalesce({_label("scenario_family_id")}, nullif({_label("task_family")}, 'playworld')) AS fam, CASE WHEN {_AUTHOR} NOT IN ({", ".join(f"'{a}'" for a in splits.NO_AUTHOR)}) THEN 'author:' || {_AUTHOR} END AS author,
'item:' || provenance.source_id || '|' || metadata['source_index'] AS item, 'rec:' || metadata['parent_id'] AS parent FROM sft_records),
o AS (SELECT coalesce(fam, rec) AS a, rec AS b FROM r UNION SELECT coalesce(fam, rec), author FROM r UNION SELECT coalesce(fam, rec), item FROM r UNION SELECT coalesce(fam, rec), parent FROM r WHERE parent IN (SELECT rec FROM r) UNION SELECT 'fam:' || {_label("family_label")}, 'fam:' || {_label("forked_from")} FROM families),
e AS (SELECT a, b FROM o WHERE a <> b UNION SELECT b, a FROM o WHERE a <> b), f AS (SELECT family_key, coalesce('fam:' || {_label("family_label")}, 'key:' || family_key) AS node FROM families WHERE family_key IS NOT NULL),
reach AS (SELECT family_key, node FROM f UNION SELECT family_key, e.b FROM reach JOIN e ON e.a = reach.node)
SELECT DISTINCT reach.family_key AS family_a, f.family_key AS family_b FROM reach JOIN f ON reach.node = f.node WHERE reach.family_key < f.family_key"""

ORACLES: dict[str, str] = {"p4_found": _TIED}
