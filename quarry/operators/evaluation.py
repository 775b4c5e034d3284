"""Evaluation of tool calls, memories, candidates and rankings, per case and over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import greedy_matches


def with_defaults(gold: DataFrame, observed: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Every gold case with its observation, or the default one where it has none."""
    return gold.join(observed, key, "left").withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def share(part: Column, whole: Column, empty: Column | float | None) -> Column:
    """part / whole; `empty` where the whole is 0."""
    none = empty if isinstance(empty, Column) else F.lit(empty).cast("double")
    return F.when(whole == 0, none).otherwise(part / whole)


def tool_case_metrics(cases: DataFrame, expected: DataFrame, calls: DataFrame, case: str) -> DataFrame:
    """Selection, argument, validity, duplicate and cost metrics of each case's tool calls.

    cases(case, completed), expected(case, position, name, arguments map, required, forbidden), calls(case, position, name,
    arguments map, status, schema_valid, semantically_valid, duplicate, unnecessary, retry_of, tokens, cost).
    """
    wanted = expected.where("required AND NOT forbidden")
    pairs = greedy_matches(wanted, calls, case)
    one = F.count(F.lit(1))
    by_name = wanted.groupBy(case, "name").agg(one.alias("a")).join(calls.groupBy(case, "name").agg(one.alias("b")), [case, "name"])
    names = by_name.groupBy(case).agg(F.sum(F.least("a", "b")).alias("names"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])
    targets = wanted.groupBy(case).agg(one.alias("expected"), said.alias("wanted_names"))
    matched = pairs.where("observed_position IS NOT NULL")
    a = wanted.select(case, F.col("position").alias("expected_position"), F.col("arguments").alias("want"))
    b = calls.select(case, F.col("position").cast("long").alias("observed_position"), F.col("arguments").alias("got"))
    fields = matched.join(a, [case, "expected_position"]).join(b, [case, "observed_position"]).select(
        case, F.size(F.coalesce(F.map_keys("want"), F.array().cast("array<string>"))).alias("fields"),
        F.size(F.filter(F.coalesce(F.map_entries("want"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.try_element_at(F.col("got"), e["key"]) == e["value"])).alias("right"))
    arguments = fields.groupBy(case).agg(one.alias("pairs"), F.sum("fields").alias("fields"), F.sum("right").alias("right"), F.count_if(F.col("fields") == F.col("right")).alias("exact"))
    # A call that repeats an earlier one's name and arguments, and is no retry.
    signature = Window.partitionBy(case, "name", F.to_json(F.array_sort(F.map_entries("arguments")))).orderBy("position")
    banned = expected.where("forbidden").select(case, F.col("name"), F.lit(True).alias("banned")).distinct()
    marked = calls.withColumn("again", (F.row_number().over(signature) > 1) & F.col("retry_of").isNull()).join(banned, [case, "name"], "left")
    bad = ~F.coalesce("schema_valid", F.lit(True)), ~F.coalesce("semantically_valid", F.lit(True))
    seen = marked.groupBy(case).agg(
        one.alias("calls"), said.alias("names_said"), F.count_if(F.col("banned")).alias("banned"),
        (F.count_if(F.col("duplicate")) + F.count_if("again")).alias("repeats"), F.count_if(F.col("unnecessary")).alias("needless"),
        F.count_if(bad[0]).alias("bad_schema"), F.count_if(bad[1]).alias("bad_meaning"), F.count_if(bad[0] | bad[1]).alias("invalid"),
        F.count_if(F.col("status") == "SUCCESS").alias("good"), F.count_if(F.col("retry_of").isNotNull() | (F.col("status") == "RETRYING")).alias("retries"),
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
    )
    zeros = ["expected", "names", "pairs", "fields", "right", "exact", "calls", "banned", "repeats", "needless", "bad_schema", "bad_meaning", "invalid", "good", "retries", "tokens"]
    all_ = cases.join(targets, case, "left").join(names, case, "left").join(arguments, case, "left").join(seen, case, "left").na.fill(0, zeros).na.fill(0.0, ["cost"])
    c = {n: F.col(n) for n in zeros}
    none, any_ = F.when(c["expected"] == 0, 1.0).otherwise(0.0), F.greatest(c["calls"], F.lit(1))
    precision, recall = share(c["names"], c["calls"], none), share(c["names"], c["expected"], 1.0)
    empty = F.array().cast("array<string>")
    return all_.select(
        case, precision.alias("selection_precision"), recall.alias("selection_recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("selection_f1"),
        share(c["pairs"], c["expected"], 1.0).alias("required_recall"),
        (F.coalesce("wanted_names", empty) == F.coalesce("names_said", empty)).alias("exact_sequence"), (c["banned"] > 0).alias("forbidden_violation"),
        share(c["right"], c["fields"], 1.0).alias("argument_accuracy"), share(c["exact"], c["pairs"], none).alias("argument_exact"),
        ((c["calls"] - c["bad_schema"]) / any_).alias("schema_valid_rate"), ((c["calls"] - c["bad_meaning"]) / any_).alias("semantic_valid_rate"),
        (c["invalid"] / any_).alias("invalid_rate"), (c["repeats"] / any_).alias("duplicate_rate"),
        ((c["needless"] + c["calls"] - c["pairs"]) / any_).alias("unnecessary_rate"), share(c["expected"] - c["pairs"], c["expected"], 0.0).alias("missing_rate"),
        (c["good"] / any_).alias("success_rate"), (c["retries"] / any_).alias("retry_rate"), F.col("completed"), c["calls"].alias("tool_calls"), c["tokens"].alias("tokens"),
        F.when(F.col("completed"), F.col("cost")).alias("cost_per_success"), F.when(F.col("completed"), c["tokens"]).alias("tokens_per_success"),
    )


def over_cases(metrics: DataFrame, numbers: list[str], flags: list[str]) -> DataFrame:
    """One row: cases and the mean of each metric (nulls aside) and the share of each flag."""
    return metrics.agg(
        F.count(F.lit(1)).alias("cases"), *[F.avg(c).alias(c) for c in numbers], *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in flags])


def memory_case_metrics(cases: DataFrame, k: int = 5) -> DataFrame:
    """Extraction and retrieval metrics of each case, from arrays of what was expected and what came.

    cases(case_id, expected, extracted array<string>, quotes_ok, supported array<boolean> along `extracted`, wanted, retrieved,
    stale, foreign array<string>, reject, saved boolean).
    """
    top = F.slice(F.array_distinct("retrieved"), 1, k)
    hits = F.size(F.array_intersect(top, F.col("wanted")))
    places = F.transform(top, lambda x, i: F.when(F.array_contains("wanted", x), i + 1))
    first = F.array_min(F.array_compact(places))
    n_expected, n_got, n_top, n_wanted = F.size("expected"), F.size("extracted"), F.size(top), F.size(F.array_distinct("wanted"))
    found = F.size(F.array_intersect("expected", "extracted"))
    yes = lambda c: F.size(F.filter(c, lambda x: x))
    fine = F.size(F.filter(F.zip_with("quotes_ok", "supported", lambda a, b: a & b), lambda x: x))
    idle = F.when(n_wanted == 0, 1.0).otherwise(0.0)
    return cases.select(
        "case_id", share(found, n_got, F.when(n_expected == 0, 1.0).otherwise(0.0)).alias("candidate_precision"), share(found, n_expected, 1.0).alias("candidate_recall"),
        share(yes("quotes_ok"), n_got, 1.0).alias("quote_accuracy"), share(n_got - fine, n_got, 0.0).alias("unsupported_rate"),
        share(hits, n_wanted, 1.0).alias("recall_at_k"), share(hits, n_top, idle).alias("precision_at_k"), F.coalesce(1.0 / first, idle).alias("mrr"),
        share(F.size(F.array_intersect(top, F.col("stale"))), n_top, 0.0).alias("stale_rate"), share(F.size(F.array_intersect(top, F.col("foreign"))), n_top, 0.0).alias("leak_rate"),
        (F.col("reject") & F.col("saved")).cast("double").alias("sensitive_violation"),
    )


def candidate_metrics(candidates: DataFrame, relevant: DataFrame, cited: DataFrame, case: str, id_: str, k: int) -> DataFrame:
    """Per case with relevant items: candidate recall and hit at k, their ceiling and share of it, and citation coverage."""
    first = candidates.groupBy(case, id_).agg(F.min("rank").alias("rank"))
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("rank", id_))).where(F.col("rank") <= k)
    one, rel = F.count(F.lit(1)), relevant.select(case, id_).distinct()
    n = rel.groupBy(case).agg(one.alias("relevant"))
    hits = again.join(rel, [case, id_]).groupBy(case).agg(one.alias("found"))
    said = cited.select(case, id_).distinct().join(rel, [case, id_]).groupBy(case).agg(one.alias("said"))
    all_ = n.join(hits, case, "left").join(said, case, "left").na.fill(0, ["found", "said"])
    recall, ceiling = F.col("found") / F.col("relevant"), F.least(F.lit(1.0), k / F.col("relevant"))
    return all_.select(
        case, "relevant", recall.alias("candidate_recall"), (F.col("found") > 0).cast("int").alias("candidate_hit"), ceiling.alias("recall_ceiling"),
        (recall / ceiling).alias("normalized_recall"), (F.col("said") / F.col("relevant")).alias("citation_coverage"))


def graded_signals(rankings: DataFrame, judgments: DataFrame, hard: DataFrame, case: str, id_: str, k: int) -> DataFrame:
    """Per ranked case: context precision and recall, hard-negative rejection and false-evidence rate of the first k."""
    first = rankings.groupBy(case, id_).agg(F.min("rank").alias("rank"))
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("rank", id_))).where(F.col("rank") <= k)
    worst = hard.select(case, id_, F.lit(True).alias("hard")).distinct()
    marked = top.join(judgments, [case, id_], "left").join(worst, [case, id_], "left")
    good, bad = F.coalesce(F.col("grade") > 0, F.lit(False)), F.coalesce("hard", F.lit(False))
    one = F.count(F.lit(1))
    seen = marked.groupBy(case).agg(one.alias("n"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"), F.count_if(bad | ~good).alias("false"))
    rel = judgments.groupBy(case).agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    negatives = worst.groupBy(case).agg(one.alias("negatives"))
    all_ = seen.join(rel, case, "left").join(negatives, case, "left").na.fill(0, ["relevant", "negatives"])
    return all_.select(
        case, (F.col("good") / F.col("n")).alias("context_precision"), share(F.col("good"), F.col("relevant"), None).alias("context_recall"),
        (1 - share(F.col("bad"), F.col("negatives"), 0.0)).alias("hard_negative_rejection"), (F.col("false") / F.col("n")).alias("false_evidence"))


def paired_bootstrap(pairs: DataFrame, topic: str, delta: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Mean paired difference with a 95 % interval, whole topics resampled (Poisson weights from hashes)."""
    from .aggregates import bootstrap

    return bootstrap(pairs, topic, delta, rounds, seed)


def verdict_rates(decisions: DataFrame, by: str, expected: str, said: str) -> DataFrame:
    """Per group: n, accuracy, and the shares of wrongly allowed and wrongly refused calls (null without such cases)."""
    allow, deny = F.col(expected) == "allow", F.col(expected) != "allow"
    return decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(expected) == F.col(said)).cast("double")).alias("accuracy"),
        F.avg(F.when(deny, (F.col(said) == "allow").cast("double"))).alias("wrongly_allowed"),
        F.avg(F.when(allow, (F.col(said) != "allow").cast("double"))).alias("wrongly_refused"),
    )


def retrieval_trace(hits: DataFrame, case: str) -> DataFrame:
    """Per query: evidence yield, reciprocal rank of the first evidence, rerank hit rate and a class of confidence.

    hits(case, rank, reranked boolean, evidence boolean, score).
    """
    one = F.count(F.lit(1))
    got = hits.groupBy(case).agg(
        one.alias("hits"), F.count_if(F.col("evidence")).alias("used"), F.min(F.when(F.col("evidence"), F.col("rank"))).alias("first"),
        F.count_if(F.col("reranked")).alias("reranked"), F.count_if(F.col("reranked") & F.col("evidence")).alias("reranked_used"), F.avg("score").alias("quality"))
    level = F.when((F.col("used") >= 3) & (F.col("quality") >= 0.5), "high").when(F.col("used") >= 1, "medium").otherwise("low")
    return got.select(
        case, "hits", (F.col("used") / F.col("hits")).alias("evidence_yield"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        share(F.col("reranked_used"), F.col("reranked"), 0.0).alias("rerank_hit_rate"), level.alias("confidence"))
