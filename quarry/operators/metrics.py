"""Ranking, graded and answer metrics. Rankings: (case, id, rank); judgments: (case, id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(rankings: DataFrame, judgments: DataFrame, case: str, id_: str, k: int) -> DataFrame:
    """First k distinct results of each case with their grade (0 if not judged)."""
    first = rankings.groupBy(case, id_).agg(F.min("rank").alias("rank"))
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("rank", id_)))
    return again.where(F.col("rank") <= k).join(judgments, [case, id_], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ranking_metrics(rankings: DataFrame, judgments: DataFrame, case: str, id_: str, k: int = 5, by_k: bool = True) -> DataFrame:
    """precision, recall, hit, mrr, ndcg at k, and map, per judged case; null where nothing is relevant.

    by_k: precision over k, else over the number returned.
    """
    rel = judgments.where(F.col("grade") > 0)
    wanted = judgments.groupBy(case).agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    hits = judged(rankings, judgments, case, id_, k).withColumn("r", (F.col("grade") > 0).cast("int"))
    running = hits.withColumn("sofar", F.sum("r").over(Window.partitionBy(case).orderBy("rank")))
    got = running.groupBy(case).agg(
        F.sum("r").alias("found"), F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("r") == 1, F.col("rank"))).alias("first"),
        F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("r") * F.col("sofar") / F.col("rank")).alias("ap"),
    )
    place = Window.partitionBy(case).orderBy(F.desc("grade"), id_)
    ideal = rel.withColumn("p", F.row_number().over(place)).where(F.col("p") <= k).groupBy(case).agg(
        F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("p") + 1.0)).alias("best"))
    all_ = wanted.join(got, case, "left").join(ideal, case, "left").na.fill(0, ["found", "returned", "dcg", "ap"])
    some = F.col("relevant") > 0
    under = F.lit(k) if by_k else F.greatest(F.col("returned"), F.lit(1))
    return all_.select(
        case, "relevant",
        F.when(some, F.col("found") / under).alias("precision"), F.when(some, F.col("found") / F.col("relevant")).alias("recall"),
        F.when(some, (F.col("found") > 0).cast("int")).alias("hit"), F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.col("dcg") / F.col("best")).alias("ndcg"), F.when(some, F.col("ap") / F.least(F.col("relevant"), F.lit(k))).alias("map"),
    )


def recall_ceiling(relevant: Column, k: int) -> Column:
    return F.least(F.lit(1.0), k / relevant)


def answer_metrics(df: DataFrame) -> DataFrame:
    """Shares over answers: claims array<struct<support, cited>>, should_refuse, did_refuse."""
    weight = F.aggregate("claims", F.lit(0.0), lambda s, c: s + F.when(c["support"] == "supported", 1.0).when(c["support"] == "partial", 0.5).otherwise(0.0))
    cited = F.aggregate("claims", F.lit(0.0), lambda s, c: s + F.when(c["cited"], 1.0).otherwise(0.0))
    n = F.size("claims")
    return df.agg(
        F.avg(F.when(n > 0, weight / n)).alias("faithfulness"), F.avg(F.when(n > 0, cited / n)).alias("citation_coverage"),
        F.avg((F.col("should_refuse") == F.col("did_refuse")).cast("double")).alias("refusal_accuracy"),
    )


def tool_metrics(matches: DataFrame, observed: DataFrame, case: str) -> DataFrame:
    """Per case: expected, observed, matched and exact calls, with precision and recall."""
    e = matches.groupBy(case).agg(F.count(F.lit(1)).alias("expected"), F.count("observed_position").alias("matched"), F.count_if(F.col("exact")).alias("exact"))
    o = observed.groupBy(case).agg(F.count(F.lit(1)).alias("observed"))
    return e.join(o, case, "full").na.fill(0).select(
        case, "expected", "observed", "matched", "exact",
        F.try_divide(F.col("matched"), F.col("observed")).alias("precision"), F.try_divide(F.col("matched"), F.col("expected")).alias("recall"),
    )


def label_violations(cases: DataFrame, judgments: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows that break a labelled set: repeated cases, topics in two splits, foreign or repeated judgments, bad grades."""
    parts = [
        cases.groupBy("case_id").count().where("count > 1").select(F.lit("repeated_case").alias("kind"), F.col("case_id").cast("string").alias("ref")),
        cases.groupBy("topic").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("split_leak"), F.col("topic").cast("string")),
        judgments.join(corpus, "id", "left_anti").select(F.lit("foreign_judgment"), F.concat_ws(":", "case_id", "id")),
        judgments.groupBy("case_id", "id").count().where("count > 1").select(F.lit("repeated_judgment"), F.concat_ws(":", "case_id", "id")),
        judgments.where(~F.col("grade").between(0, 3)).select(F.lit("bad_grade"), F.concat_ws(":", "case_id", "id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def gold_gate(kappa: Column, annotated_pairs: Column, all_pairs: Column, conflicts: Column) -> Column:
    return (kappa >= 0.7) & (annotated_pairs == all_pairs) & (conflicts == 0)
