"""Aggregations: modes, reconciliation, agreement, funnels, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mode(df: DataFrame, by: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Per group the value of greatest total weight, the lower of equals (E01, E13): ``by``, ``value``, ``weight``. A null or zero
    weight counts as 1."""
    w = F.when(F.coalesce(weight, F.lit(0)) == 0, F.lit(1)).otherwise(weight)
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(w).alias("weight"))
    # heaviest first, then lowest value; a null group is a group as well
    best = sums.groupBy(*by).agg(F.max("weight").alias("weight"), F.min_by(value, F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))).alias(value))
    return best.select(*by, value, "weight")


def dominant(df: DataFrame, by: Sequence[str], value: str, least: float) -> DataFrame:
    """The most frequent value where it has at least the share ``least`` of the non-null ones, else null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.max_by(value, F.struct("n", value)).alias(value))
    return top.select(*by, F.when(F.col("n") >= least * F.col("all"), F.col(value)).alias(value), F.round(F.col("n") / F.col("all"), 6).alias("share"))


def reconcile(left: DataFrame, right: DataFrame, key: str, left_count: str, right_count: str) -> DataFrame:
    """Keys whose counts differ between two tables, or that one lacks (E08): ``key, left, right, problem``."""
    j = left.select(key, F.col(left_count).alias("left")).join(right.select(key, F.col(right_count).alias("right")), key, "full_outer")
    problem = F.when(F.col("left").isNull(), "only right").when(F.col("right").isNull(), "only left").when(F.col("left") != F.col("right"), "counts differ")
    return j.withColumn("problem", problem).where("problem IS NOT NULL")


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn and the share of false negatives among the dropped."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    n = lambda c, a: F.count_if(c).alias(a)
    out = df.agg(n(t & p, "tp"), n(~t & p, "fp"), n(t & ~p, "fn"), n(~t & ~p, "tn"))
    return out.withColumn("missed", F.round(F.when(F.col("fn") + F.col("tn") > 0, F.col("fn") / (F.col("fn") + F.col("tn"))).otherwise(0.0), 6))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """How many rows survive each stage and all before it (E23), one column per stage."""
    upto, aggs = F.lit(True), []
    for name, c in stages:
        upto = upto & F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(upto).alias(name))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def furniture(pages: DataFrame, doc: str, page: str, text: str, share: float = 0.3) -> DataFrame:
    """Lines that repeat over the pages of a document, digits masked (E09): on at least greatest(3, share of the pages)."""
    lines = pages.select(doc, page, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), "[0-9]+", "#")))).alias("line"))
    sizes = pages.groupBy(doc).agg(F.countDistinct(page).alias("n"))
    seen = lines.where(F.length("line") > 0).groupBy(doc, "line").agg(F.countDistinct(page).alias("pages"))
    return seen.join(sizes, doc).where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n") * share))).select(doc, "line", "pages")


def rank_of(df: DataFrame, by: Sequence[str], score: str, theta: float) -> DataFrame:
    """Share of scores below a threshold per group."""
    return df.groupBy(*by).agg(F.round(F.avg((F.col(score) < theta).cast("double")), 6).alias("below"), F.count(score).alias("n"))


def vote(first: Column, second: Column, third: Column) -> Column:
    """Outcome of two verdicts and a third as tie-breaker."""
    return F.when(first.isNull() | second.isNull(), "error").when(first == second, "agree").when(third.isNull(), "error").when(third == first, "tiebreak_upheld").otherwise("tiebreak_overturned")
