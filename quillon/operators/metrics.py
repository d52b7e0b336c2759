"""Ranking quality, scorecards, percentiles and judge agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import average_ranks, percentiles

#: Points of the three dimensions of an evaluation (fixed values); a partial match earns half.
WEIGHTS = {"topic": 50, "method": 30, "setting": 20}
#: Weights of the layers of the overall score (fixed values).
LAYERS = {"L1": 0.30, "L2": 0.50, "L3": 0.20}


def ranking_quality(judged: DataFrame, k: int = 10, threshold: float = 2.0) -> DataFrame:
    """By case: n, nDCG and precision at k, the gap of mean scores between halves, and whether all scores are equal.
    judged: case_id, rn (from 1), score. The ideal order is that of the same k items."""
    ideal = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "rn"))
    n = F.count("*").over(W.partitionBy("case_id"))
    top = judged.withColumn("n", n).where(F.col("rn") <= k).withColumn("best", ideal)
    gain = lambda place: F.col("score") / F.log2(F.col(place) + 1)
    first = top.groupBy("case_id").agg(
        F.sum(gain("rn")).alias("dcg"),
        F.sum(gain("best")).alias("idcg"),
        F.avg((F.col("score") >= threshold).cast("int")).alias("precision"),
    )
    halves = judged.withColumn("n", n)
    upper = F.col("rn") <= F.floor(F.col("n") / 2)
    rest = halves.groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(upper, F.col("score"))) - F.avg(F.when(~upper, F.col("score"))), F.lit(0.0)).alias("gap"),
        (F.min("score") == F.max("score")).alias("saturated"),
    )
    return first.join(rest, "case_id").select("case_id", "n", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), "precision", "gap", "saturated")


def completeness(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Shares of rows whose field is filled; 0 of nothing."""
    return rows.agg(*[F.coalesce(F.avg(c.cast("int")), F.lit(0.0)).alias(k) for k, c in fields.items()])


def suite(cases: DataFrame) -> DataFrame:
    """All cases in one row. cases: status, judge_status, saturated, ndcg, precision, gap, recall, latency. Means of
    judged figures leave saturated cases out; success counts all."""
    ok = F.col("status") == "ok"
    judged = ok & (F.col("judge_status") == "ok")
    fair = judged & ~F.coalesce("saturated", F.lit(False))
    counts = cases.agg(
        F.count("*").alias("cases"),
        F.count_if(ok).alias("ok_cases"),
        F.count_if(judged & F.coalesce("saturated", F.lit(False))).alias("saturated_cases"),
        *[F.avg(F.when(fair, F.col(c))).alias(c) for c in ("ndcg", "precision", "gap")],
        F.avg(F.when(judged, F.col("recall"))).alias("recall"),
    )
    return counts.join(percentiles(cases.where(ok), [], {"latency_p50": ("latency", 0.5, "linear"), "latency_p95": ("latency", 0.95, "linear")}), how="left").fillna(0.0, ["latency_p50", "latency_p95"])


def points(value: Column, target: Column, direction: Column) -> Column:
    """A metric as 0 to 100: higher or lower is better, a judge's five points, or any violation."""
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(direction == "higher", 100 * F.least(value / target, F.lit(1.0)))
        .when(direction == "lower", 100 * F.least(target / F.greatest(value, F.lit(1e-9)), F.lit(1.0)))
        .when(direction == "judge", 100 * value / 5)
        .when(direction == "violation", F.when(value > 0, 0.0).otherwise(100.0))
    )


def layer_scores(metrics: DataFrame) -> DataFrame:
    """layer -> score, scored, missing. metrics: layer, value, target, direction."""
    scored = metrics.withColumn("p", points(F.col("value"), F.col("target"), F.col("direction")))
    return scored.groupBy("layer").agg(F.avg("p").alias("score"), F.count("p").alias("scored"), F.count_if(F.col("p").isNull()).alias("missing"))


def overall(layers: DataFrame) -> DataFrame:
    """The weighted mean over the layers that have a score."""
    weight = F.lit(None).cast("double")
    for name, w in LAYERS.items():
        weight = F.when(F.col("layer") == name, w).otherwise(weight)
    kept = layers.where("score IS NOT NULL").withColumn("w", weight)
    return kept.agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("overall"))


def trend(runs: DataFrame, order: str, score: str, flat: float = 0.05) -> DataFrame:
    """Each run against the one before: up, down or flat. Runs are few: one row per evaluation."""
    before = F.lag(score).over(W.partitionBy("suite").orderBy(order))
    change = F.col(score) - before
    return runs.withColumn("before", before).withColumn("trend", F.when(before.isNull(), F.lit(None)).when(F.abs(change) < flat, "flat").when(change > 0, "up").otherwise("down"))


def match_score(levels: dict[str, Column]) -> Column:
    """50 / 30 / 20 points: all for a match, half for a partial one, none for anything else."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.when(levels[name] == "match", float(weight)).when(levels[name] == "partial_match", weight / 2).otherwise(0.0)
    return F.floor(total + 0.5).cast("int")


def completeness_score(covered: Column, partial: Column, total: Column) -> Column:
    """1 to 5 in halves: 1 + 4 (covered + partial / 2) / total."""
    raw = 1 + 4 * (covered + 0.5 * partial) / total
    return F.when(total > 0, F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.floor(raw * 2 + 0.5) / 2)))


def agreement(pairs: DataFrame) -> DataFrame:
    """n, share within one point, share equal, and rank correlation of human and judge scores (null under 3 cases)."""
    ranked = pairs
    for c in ("human", "judge"):
        ranked = ranked.join(average_ranks(pairs.select(c), c, f"r_{c}"), c)
    return ranked.agg(
        F.count("*").alias("n"),
        F.avg((F.abs(F.col("human") - F.col("judge")) <= 1).cast("int")).alias("within_one"),
        F.avg((F.col("human") == F.col("judge")).cast("int")).alias("exact"),
        F.when(F.count("*") >= 3, F.corr("r_human", "r_judge")).alias("spearman"),
    )


def golden_recall(results: DataFrame, golden: DataFrame, top: int = 20) -> DataFrame:
    """(case_id, recall, golden): the share of a case's golden records among its first `top` results: the same preprint
    number, the same DOI, or one title within the other. results: case_id, place (from 1), doi, arxiv, title; golden:
    case_id, gid, doi, arxiv, title; all normalised, empty where unknown. Cases without golden records have no row (their
    recall counts as 1). Rows meet by case only, at most `top` for each golden record."""
    r = results.where(F.col("place") <= top).select("case_id", *[F.col(c).alias(f"r_{c}") for c in ("doi", "arxiv", "title")])
    same = lambda c: (F.col(c) != "") & (F.col(c) == F.col(f"r_{c}"))
    within = (F.col("title") != "") & (F.col("r_title") != "") & (F.contains("title", "r_title") | F.contains("r_title", "title"))
    hits = golden.join(r, "case_id", "left").groupBy("case_id", "gid").agg(F.bool_or(F.coalesce(same("arxiv") | same("doi") | within, F.lit(False))).alias("hit"))
    return hits.groupBy("case_id").agg(F.avg(F.col("hit").cast("int")).alias("recall"), F.count("*").alias("golden"))
