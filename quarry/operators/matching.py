"""Matching of requirements: evaluation, quick scores with a ledger, reliability, caches and cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the components, and what stands for one without requirements.
COMPONENTS = {"direction": 0.20, "must_have": 0.45, "preferred": 0.10, "experience": 0.15, "education": 0.10}
UNKNOWN = {"direction": 50.0, "must_have": 45.0, "preferred": 50.0, "experience": 55.0, "education": 55.0}
#: Requirement types of the components.
TYPES = {"direction": "direction", "must_have": "must_have_skill", "preferred": "preferred_skill", "experience": "experience", "education": "education"}
#: Upper bounds of a score by what failed.
CAPS = {"direction_mismatch": 35.0, "critical_skill_missing": 50.0, "education_missing": 40.0, "experience_gap": 55.0, "rules": 25.0}
#: Weights of a score's reliability, and its bounds by status.
RELIABILITY = {"completeness": 0.25, "extraction": 0.25, "logic": 0.2, "coverage": 0.2, "known": 0.1}
RELIABILITY_CAPS = {"PARTIAL": 0.74, "INSUFFICIENT_DATA": 0.35}


def evaluated(requirements: DataFrame, have: Column) -> DataFrame:
    """status and score of each requirement (type, wanted array<string>, relation, at_least, level, minimum) against what is had.

    have: struct(skills array<string>, direction string, level int, years double). Skills: as many of the wanted ones as
    the relation asks (ALL_OF, ANY_OF, AT_LEAST_N); others by level and years; null on either side is unknown.
    """
    n = F.size(F.array_intersect("wanted", have["skills"]))
    need = F.when(F.col("relation") == "ANY_OF", 1).when(F.col("relation") == "AT_LEAST_N", F.coalesce("at_least", F.lit(1))).otherwise(F.size("wanted"))
    skill = F.col("type").endswith("skill")
    share = 100.0 * F.least(F.lit(1.0), n / F.greatest(need, F.lit(1)))
    status = (
        F.when(skill & have["skills"].isNull(), "unknown").when(skill, F.when(n >= need, "matched").otherwise("missing"))
        .when(F.col("type") == "direction", F.when(have["direction"].isNull() | (F.size("wanted") == 0), "unknown").when(F.array_contains("wanted", have["direction"]), "matched").otherwise("missing"))
        .when(F.col("type") == "education", F.when(have["level"].isNull() | F.col("level").isNull(), "unknown").when(have["level"] >= F.col("level"), "matched").otherwise("missing"))
        .otherwise(F.when(have["years"].isNull() | F.col("minimum").isNull(), "unknown").when(have["years"] >= F.col("minimum"), "matched").otherwise("missing"))
    )
    score = (
        F.when(F.col("status") == "unknown", 50.0).when(F.col("status") == "matched", 100.0).when(skill, share)
        .when(F.col("type") == "experience", F.greatest(F.lit(0.0), 100.0 * have["years"] / F.col("minimum"))).otherwise(0.0)
    )
    return requirements.withColumn("status", status).withColumn("score", score)


def quick_scores(evaluations: DataFrame, case: str, rules_passed: Column | None = None, digits: int = 2) -> DataFrame:
    """Per case: the components, base, deduction, final score, hard_passed and the ledger of what held it down.

    evaluations(case, type, status, score, importance, specificity, hard, critical, deduction). Must-have skills weigh only
    those that are matched; a hard failure counts once, as a cap, and its component is not held against the base again.
    """
    weight = F.greatest(F.lit(0.1), F.col("importance") * F.col("specificity"))
    missing = F.col("status") == "missing"
    of = lambda c: F.col("type") == TYPES[c]
    sums = []
    for c in COMPONENTS:
        counted = of(c) & (F.col("status") == "matched") if c == "must_have" else of(c)
        sums += [
            F.sum(F.when(counted, F.col("score") * weight)).alias(f"{c}_s"), F.sum(F.when(counted, weight)).alias(f"{c}_w"), F.count_if(of(c)).alias(f"{c}_n"),
        ]
    failed = {
        "direction_mismatch": of("direction") & missing, "critical_skill_missing": of("must_have") & missing & F.col("critical"),
        "education_missing": of("education") & missing & F.col("hard"), "experience_gap": of("experience") & missing & F.col("hard"),
    }
    got = evaluations.groupBy(case).agg(
        *sums, F.sum(F.when(of("must_have") & missing, F.col("deduction")).otherwise(0.0)).alias("deduction"),
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in failed.items()],
        (F.lit(True) if rules_passed is None else F.coalesce(F.bool_and(rules_passed), F.lit(True))).alias("passed"),
    )
    part = {}
    for c in COMPONENTS:
        none = F.when(F.col(f"{c}_n") == 0, UNKNOWN[c]).otherwise(0.0) if c == "must_have" else F.lit(UNKNOWN[c])
        part[c] = F.coalesce(F.round(F.try_divide(F.col(f"{c}_s"), F.col(f"{c}_w")), 2), none)
    got = got.withColumns(part)
    forgiven = {"direction": "direction_mismatch", "education": "education_missing", "experience": "experience_gap"}
    base = F.lit(0.0)
    for c, w in COMPONENTS.items():
        base = base + w * (F.when(F.col(forgiven[c]), 100.0).otherwise(F.col(c)) if c in forgiven else F.col(c))
    score = base - F.col("deduction")
    for name in failed:
        score = F.when(F.col(name), F.least(score, F.lit(CAPS[name]))).otherwise(score)
    score = F.when(~F.col("passed"), F.least(score, F.lit(CAPS["rules"]))).otherwise(score)
    entry = lambda name, penalty, cap: F.struct(F.lit(name).alias("reason"), penalty.alias("penalty"), cap.alias("cap"))
    ledger = F.array_compact(F.array(
        F.when((F.col("deduction") > 0), entry("must_have_skill_missing", F.col("deduction"), F.lit(None).cast("double"))),
        *[F.when(F.col(name), entry(name, F.lit(0.0), F.lit(CAPS[name]))) for name in failed],
    ))
    hard = ~(F.col("direction_mismatch") | F.col("critical_skill_missing") | F.col("education_missing") | F.col("experience_gap"))
    return got.select(
        case, *COMPONENTS, F.round(base, 4).alias("base"), F.col("deduction").alias("deduction"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), digits).alias("final"), hard.alias("hard_passed"), ledger.alias("ledger"),
    )


def reliability(evaluations: DataFrame, case: str, description_chars: str, digits: int = 3) -> DataFrame:
    """status (SUFFICIENT, PARTIAL, INSUFFICIENT_DATA) and confidence of each case's score.

    evaluations(case, type, status, extraction_confidence, grouped boolean) with the length of the case's description.
    """
    kinds = ("must_have_skill", "preferred_skill", "education", "experience")
    real, skill = F.col("type").isin(*kinds), F.col("type").isin("must_have_skill", "preferred_skill")
    one = F.count(F.lit(1))
    got = evaluations.groupBy(case).agg(
        F.max(description_chars).alias("chars"), one.alias("n"), F.count_if(real).alias("real"), F.count_if(F.col("type") == "must_have_skill").alias("must"),
        F.avg("extraction_confidence").alias("extraction"), F.avg(F.when(real, F.when(F.col("grouped"), 0.95).otherwise(0.65))).alias("logic"),
        F.avg(F.when(skill, F.col("status").isin("matched", "not_required").cast("double"))).alias("coverage"),
        F.avg((F.col("status") == "unknown").cast("double")).alias("unknown"),
    )
    status = F.when((F.col("real") == 0) | (F.col("chars") < 40), "INSUFFICIENT_DATA").when((F.col("chars") < 120) | (F.col("must") == 0), "PARTIAL").otherwise("SUFFICIENT")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    value = (
        RELIABILITY["completeness"] * F.least(F.lit(1.0), F.col("chars") / 500.0) + RELIABILITY["extraction"] * zero("extraction")
        + RELIABILITY["logic"] * zero("logic") + RELIABILITY["coverage"] * zero("coverage") + RELIABILITY["known"] * (1.0 - F.col("unknown"))
    )
    capped = value
    for name, most in RELIABILITY_CAPS.items():
        capped = F.when(status == name, F.least(capped, F.lit(most))).otherwise(capped)
    return got.select(case, status.alias("status"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), digits).alias("confidence"))


def uncached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be scored again: rows without a cached score of the same keys (version and fingerprint among them)."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def cards(items: DataFrame, scores: DataFrame, active: DataFrame, key: str, most: int) -> DataFrame:
    """Result cards: latest score, active flag, warnings and the default selection; selected ones first, then by score."""
    latest = scores.groupBy(key).agg(F.max(F.struct("scored_at", "score"))["score"].alias("score"))
    flags = active.select(key, F.lit(True).alias("active")).distinct()
    joined = items.join(latest, key, "left").join(flags, key, "left").withColumn("active", F.coalesce("active", F.lit(False)))
    warnings = F.array_compact(F.array(
        F.when(F.col("score").isNull(), "not_scored"), F.when(F.col("active"), "already_active"), F.when(F.col("score") < 50, "low_score"),
    ))
    chosen = (F.coalesce("score", F.lit(-1.0)) >= 70) & ~F.col("active")
    out = joined.select(key, "score", "active", warnings.alias("warnings"), chosen.alias("selected"))
    return out.orderBy(F.desc("selected"), F.desc(F.coalesce("score", F.lit(-1.0))), key).limit(most)


def fuzzy_pairs(rows: DataFrame, key: str, company: str, fields: list[str], least: float = 0.86) -> DataFrame:
    """first_id, second_id, ratio: rows of one company whose fields are alike by the mean ratio of matching blocks.

    Candidates are rows of a company whose first field begins or ends with the same eight letters; so a company with many
    rows is dealt by these keys. Equal rows are one class: one row (representative, member) of ratio 1 for each other one.
    """
    import difflib

    low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"f{k}") for k, c in enumerate(fields)]
    named = rows.select(F.col(key).alias("id"), F.lower(F.col(company)).alias("company"), *low).where(F.col("company").isNotNull() & F.col("id").isNotNull())
    texts = [f"f{k}" for k in range(len(fields))]
    classes = named.groupBy("company", *texts).agg(F.min("id").alias("id"))
    same = named.join(classes.withColumnRenamed("id", "first_id"), ["company", *texts]).where(F.col("id") != F.col("first_id"))
    same = same.select("first_id", F.col("id").alias("second_id"), F.lit(1.0).alias("ratio"))
    ends = F.array_distinct(F.array(F.concat(F.lit("<"), F.substring("f0", 1, 8)), F.concat(F.lit(">"), F.reverse(F.substring(F.reverse("f0"), 1, 8)))))
    keyed = classes.withColumn("block", F.explode(ends))
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, (F.col("x.company") == F.col("y.company")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")))
    # No more letters can match than the shorter text has.
    bound = F.lit(0.0)
    for c in ["company", *texts]:
        a, b = F.length(f"x.{c}"), F.length(f"y.{c}")
        bound = bound + F.when(a + b == 0, 1.0).otherwise(2.0 * F.least(a, b) / (a + b))
    pairs = met.where(bound / (1 + len(texts)) >= least - 0.001).select(
        F.col("x.id").alias("first_id"), F.col("y.id").alias("second_id"), *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in texts]).distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [1.0 + sum(difflib.SequenceMatcher(None, r[f"x{c}"], r[f"y{c}"]).ratio() for c in texts) for r in b.to_dict("records")]
            b["ratio"] = pd.Series(made, index=b.index, dtype=float).div(1 + len(texts)).round(3)
            yield b.loc[b["ratio"] >= least, ["first_id", "second_id", "ratio"]]

    kind = rows.schema[key].dataType.simpleString()
    return pairs.mapInPandas(compare, f"first_id {kind}, second_id {kind}, ratio double").unionByName(same)
