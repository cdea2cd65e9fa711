"""Exact classification and ranking metrics over score tables (group..., label, score).

Tied scores count as one threshold. Rows with a null label or score are left
out. Tables are first reduced to one row a distinct score, with hits and
misses combined before the shuffle; running sums are over those, range by range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.ranking import running_sums


def thresholds(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., score, p, n, tp, fp, pos, neg): by distinct score, hits and misses there and from there up."""
    own = scored.filter("label IS NOT NULL AND score IS NOT NULL").groupBy(*group, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    # The running sums are read back from a table, so the totals don't compute the scores again.
    up = running_sums(own.withColumn("_down", -F.col("score")), group, "_down", {"tp": "p", "fp": "n"}).drop("_down").alias("a")
    totals = up.groupBy(*group).agg(F.max("tp").alias("pos"), F.max("fp").alias("neg"))
    if not group:
        return up.crossJoin(totals).select("score", "p", "n", "tp", "fp", "pos", "neg")
    b = totals.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group])
    return up.join(b, on).select(*[F.col(f"a.{g}") for g in group], "score", "p", "n", "tp", "fp", "pos", "neg")


def average_precision(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., auprc, n, n_pos): sum over thresholds of the recall gained times the precision; null without positives."""
    t = thresholds(scored, group)
    gain = F.col("p") / F.nullif("pos", F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.groupBy(*group).agg(F.round(F.sum(gain), 6).alias("auprc"), F.sum(F.col("p") + F.col("n")).alias("n"), F.sum("p").alias("n_pos"))


def auroc(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., auroc): the share of positive-negative pairs in order, ties half; null without both classes."""
    t = thresholds(scored, group)
    won = F.col("p") * (F.col("neg") - F.col("fp") + 0.5 * F.col("n"))
    return t.groupBy(*group).agg(F.round(F.sum(won) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0)), 6).alias("auroc"))


def ranking_report(scored: DataFrame, group: list[str]) -> DataFrame:
    """Both areas in one pass."""
    t = thresholds(scored, group)
    gain = F.col("p") / F.nullif("pos", F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))
    won = F.col("p") * (F.col("neg") - F.col("fp") + 0.5 * F.col("n"))
    return t.groupBy(*group).agg(
        F.round(F.sum(won) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0)), 6).alias("auroc"), F.round(F.sum(gain), 6).alias("auprc"),
        F.sum(F.col("p") + F.col("n")).alias("n_test"), F.sum("p").alias("n_pos_test"),
    )


def _f1():
    return 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))


def f1_threshold(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., threshold, f1): the lowest threshold of the highest F1; predictions are scores of at least it."""
    t = thresholds(scored, group).filter("pos > 0").withColumn("f1", F.round(_f1(), 12))
    best = t.groupBy(*group).agg(F.max(F.struct("f1", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*group, (-F.col("b.s")).alias("threshold"), F.round("b.f1", 6).alias("f1"))


def confusion(scored: DataFrame, group: list[str], threshold: float | str) -> DataFrame:
    """(group..., tp, fp, fn, tn, precision, recall, f1) of scores of at least the threshold (a number or a column); 0 where undefined."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    yes, true = F.col("score") >= limit, F.col("label") == 1
    c = scored.filter("label IS NOT NULL AND score IS NOT NULL").groupBy(*group).agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    part = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return c.select("*", part(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def pr_curve(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., threshold, precision, recall) by distinct score."""
    t = thresholds(scored, group)
    return t.select(*group, F.col("score").alias("threshold"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / F.nullif("pos", F.lit(0)), 6).alias("recall"))


def roc_curve(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group..., threshold, fpr, tpr) by distinct score."""
    t = thresholds(scored, group)
    return t.select(*group, F.col("score").alias("threshold"), F.round(F.col("fp") / F.nullif("neg", F.lit(0)), 6).alias("fpr"), F.round(F.col("tp") / F.nullif("pos", F.lit(0)), 6).alias("tpr"))


def precision_at(scored: DataFrame, group: list[str], key: str, k: int = 10) -> DataFrame:
    """(group..., precision_at_k): positives among the k best scores, ties by key; groups of fewer rows use those."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), key)
    top = scored.filter("label IS NOT NULL AND score IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*group).agg(F.round(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)), 6).alias("precision_at_k"), F.count("*").alias("n_ranked"))


def hits_and_mrr(ranked: DataFrame, group: list[str], query: str, k: int = 10) -> DataFrame:
    """(group..., hits_at_k, mrr, n_queries): of candidates (query, is_true, score), the true one's place, ties in its favour."""
    true = ranked.groupBy(*group, query).agg(F.max(F.when(F.col("is_true"), F.col("score"))).alias("_t"))
    place = ranked.join(true.filter("_t IS NOT NULL"), [*group, query]).groupBy(*group, query).agg((1 + F.count_if(F.col("score") > F.col("_t"))).alias("rank"))
    return place.groupBy(*group).agg(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("hits_at_k"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n_queries"))


def hits_among_scores(scored: DataFrame, group: list[str], query: list[str], k: int = 10) -> DataFrame:
    """(group..., hits_at_k, mrr, n_queries): each positive's place among the negatives of its query (label, score), ties in its favour.

    The place follows from the running count of negatives over the query's
    distinct scores, so a query of any number of positives and negatives is
    never expanded into their pairs.
    """
    at = thresholds(scored, [*group, *query]).filter("p > 0").withColumn("_rank", 1 + F.col("fp") - F.col("n"))
    total = F.nullif(F.sum("p"), F.lit(0))
    hits = F.sum(F.when(F.col("_rank") <= k, F.col("p")).otherwise(0))
    return at.groupBy(*group).agg(F.round(hits / total, 6).alias("hits_at_k"), F.round(F.sum(F.col("p") / F.col("_rank")) / total, 6).alias("mrr"), F.sum("p").alias("n_queries"))
