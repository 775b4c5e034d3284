"""Explainable scores and the ranking cascade."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_contains


def skill_score(have: Column, required: Column, preferred: Column) -> Column:
    """80 for required and 20 for preferred skills by coverage; 50 where none is asked for."""
    r = F.size(F.array_intersect(required, have)) / F.greatest(F.size(required), F.lit(1))
    p = F.size(F.array_intersect(preferred, have)) / F.greatest(F.size(preferred), F.lit(1))
    return (
        F.when((F.size(required) == 0) & (F.size(preferred) == 0), 50.0)
        .when(F.size(preferred) == 0, 100.0 * r).when(F.size(required) == 0, 100.0 * p).otherwise(80.0 * r + 20.0 * p)
    )


def education_score(have: Column, need: Column) -> Column:
    """100 when reached, 45 one level below, 70 when unknown, else 0."""
    return F.when(need.isNull() | (need == 0), 100.0).when(have.isNull(), 70.0).when(have >= need, 100.0).when(have == need - 1, 45.0).otherwise(0.0)


def experience_score(have: Column, need: Column) -> Column:
    return F.when(need.isNull() | (need == 0), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(20.0), 100.0 * F.coalesce(have, F.lit(0)) / need)))


def preference_score(*parts: Column) -> Column:
    """Mean of the criteria that apply (nulls don't); 100 if none does."""
    given = F.array_compact(F.array(*parts))
    return F.when(F.size(given) == 0, 100.0).otherwise(F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given))


WEIGHTS = {"skill": 0.25, "semantic": 0.25, "experience": 0.15, "education": 0.10, "preference": 0.10, "llm": 0.10, "freshness": 0.05}


def final_score(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the parts that are there."""
    weights = weights or WEIGHTS
    total, mass = F.lit(0.0), F.lit(0.0)
    for name, c in parts.items():
        total = total + F.when(c.isNotNull(), c * weights[name]).otherwise(0.0)
        mass = mass + F.when(c.isNotNull(), F.lit(weights[name])).otherwise(0.0)
    return F.try_divide(total, mass)


def recommendation(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 70, "good").when(score >= 50, "possible").otherwise("weak")


def capped(score: Column, caps: list[tuple[Column, float]]) -> Column:
    """A score held below every cap whose condition is met."""
    return F.least(score, *[F.when(test, F.lit(float(cap))).otherwise(F.lit(100.0)) for test, cap in caps])


def resolve_groups(requirements: DataFrame, by: list[str]) -> DataFrame:
    """Per group: satisfied if ALL_OF, ANY_OF or AT_LEAST_N of its members are met."""
    met = F.count_if(F.col("met"))
    n = F.count(F.lit(1))
    need = F.when(F.first("relation") == "ALL_OF", n).when(F.first("relation") == "ANY_OF", 1).otherwise(F.coalesce(F.max("at_least"), F.lit(1)))
    weight = F.col("importance") * F.col("specificity")
    return requirements.groupBy(*by).agg(
        n.alias("members"), met.alias("met"), (met >= need).alias("satisfied"),
        F.max(F.struct(weight.alias("w"), "name"))["name"].alias("representative"),
    )


def cascade(df: DataFrame, key: str, stages: list[tuple[str, str, int]]) -> tuple[DataFrame, DataFrame]:
    """(survivors, trace): each stage (name, score column, how many) keeps its best of the stage before.

    Top-k is the feature; each stage is one TakeOrdered, never a full sort.
    """
    now, trace = df, None
    for n, (name, score, most) in enumerate(stages):
        kept = now.orderBy(F.desc(score), key).limit(most)
        rows = now.join(kept.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left").select(
            F.lit(n + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(key), F.col(score).alias("score"), F.col("__k").isNotNull().alias("selected"))
        trace = rows if trace is None else trace.unionByName(rows)
        now = kept
    return now, trace


#: Words that are no terms of a query, and word ends that are cut off.
STOP_TERMS = frozenset("岗位 方向 工作 职位 要求 学习 相关 想做 希望 了解".split())
TERM_ENDS = ("实习生", "工程师", "专家", "岗位", "方向", "职位")


def query_terms(query: str) -> list[str]:
    """The whole query, its words (ASCII words, CJK runs of two or more), and of CJK terms of four or more what is left without
    the usual ends, and their pairs of characters; the longest first."""
    low = query.lower().strip()
    terms = {low, *re.findall(r"[a-z][a-z0-9+.#-]+|[一-鿿]{2,}", low)}
    for term in [t for t in terms if re.fullmatch("[一-鿿]{4,}", t)]:
        short = term
        for end in TERM_ENDS:
            short = short.replace(end, "")
        terms |= {short, *(term[k : k + 2] for k in range(len(term) - 1))}
    return sorted((t for t in terms if len(t) >= 2 and t not in STOP_TERMS), key=lambda t: (-len(t), t))


def market_relevance(title: Column, skills: Column, text: Column, query: str) -> Column:
    """16 if the title holds the query; and for each of its terms 3, 2 or .7 weights by the first of title, skills and text
    that holds it. A term weighs half its length, between 1 and 6; ASCII terms must stand alone. Nulls hold nothing."""
    filled = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.contains(filled(title), F.lit(query.lower())), 16.0).otherwise(0.0)
    for term in query_terms(query):
        weight = min(6.0, max(1.0, len(term) / 2))
        held = [bounded_contains(filled(c), term) for c in (title, skills, text)]
        out = out + F.when(held[0], 3.0 * weight).when(held[1], 2.0 * weight).when(held[2], 0.7 * weight).otherwise(0.0)
    return out


def capability(overlap: Column, suitable: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * overlap + 0.2 * F.when(suitable, 1.0).otherwise(0.0) + 0.1)
