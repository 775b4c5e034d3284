"""Aggregations. All are grouped, partially aggregated sums unless a note says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def facets(df: DataFrame, by: str, filters: Column | None = None) -> DataFrame:
    """Counts by value; the facet's own filter is left to the caller to omit."""
    return (df.where(filters) if filters is not None else df).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, label: Column, blank: str = "unspecified") -> DataFrame:
    """label, n and percentage (one digit, half even) of each value."""
    named = df.select(F.when(F.coalesce(F.trim(label), F.lit("")) == "", blank).otherwise(label).alias("label"))
    counts = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.bround(100.0 * F.col("n") / F.col("__total"), 1).alias("pct"))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """n and the values at places (from 0) of each group's ascending order; the places are expressions of n.

    Values are counted, dealt into ranges and looked up in the range that holds a place: no task orders more than
    one range of a group, whatever the size of the group.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    counts = known.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    edges = known.agg(F.percentile_approx("__v", [k / 64 for k in range(1, 64)], 10_000).alias("e")).first()["e"] or []
    inside = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
    dealt = counts.withColumn("__range", F.size(F.filter(inside, lambda e: e < F.col("__v"))))
    parts = dealt.groupBy(*by, "__range").agg(F.sum("__c").alias("__m"))  # at most 64 rows a group
    upto = F.sum("__m").over(Window.partitionBy(*by).orderBy("__range"))
    parts = parts.withColumn("n", F.sum("__m").over(Window.partitionBy(*by))).withColumn("__before", upto - F.col("__m"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in ranks.items()]))
    wanted = parts.withColumn("__a", asked).where((F.col("__a.at") >= F.col("__before")) & (F.col("__a.at") < F.col("__before") + F.col("__m")))
    wanted = wanted.select(*by, "__range", "n", F.col("__a.name").alias("__name"), (F.col("__a.at") - F.col("__before")).alias("__at"))
    keys = [*by, "__range"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    within = dealt.alias("d").join(wanted.alias("w"), same("d", "w")).select(*[F.col(f"d.{k}").alias(k) for k in keys], "__v", "__c", "n", "__name", "__at")
    seen = F.sum("__c").over(Window.partitionBy(*keys, "__name").orderBy("__v"))
    hit = within.withColumn("__seen", seen).where((F.col("__seen") > F.col("__at")) & (F.col("__seen") - F.col("__c") <= F.col("__at")))
    return hit.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks])


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """n and quantiles, interpolated between neighbours, of each group's values."""
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    ranks = {}
    for name, p in shares.items():
        ranks |= {f"__lo_{name}": F.floor(place(p)), f"__hi_{name}": F.ceil(place(p))}
    got = at_ranks(df, by, value, ranks)
    low, high = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}"))
    return got.select(*by, "n", *[(low(n) + (place(p) - F.floor(place(p))) * (high(n) - low(n))).alias(n) for n, p in shares.items()])


def bands(df: DataFrame, unit: str, low: str, high: str) -> DataFrame:
    """Percentile bands by unit of the midpoints (or the one bound that is known)."""
    value = F.coalesce((F.col(low) + F.col(high)) / 2, F.col(low), F.col(high))
    known = df.select(F.col(unit).alias("unit"), value.alias("v")).where(F.col("v").isNotNull())
    return quantiles(known, ["unit"], "v", {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "high": 1.0})


def discrete_percentile(df: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """The values at places max(0, int(n p) - 1) and ceil(n p) - 1 of the ascending order."""
    floor_at = F.greatest(F.lit(0), F.floor(F.col("n") * share).cast("long") - 1)
    return at_ranks(df, [by], value, {"p_floor": floor_at, "p_ceil": F.ceil(F.col("n") * share).cast("long") - 1})


def total_or_null(value: str) -> Column:
    """A sum that one null makes null."""
    return F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value))


def weighted_mean(df: DataFrame, by: str, value: Column, weight: Column, default: float = 0.0) -> DataFrame:
    w = F.greatest(F.lit(0.1), weight)
    out = df.groupBy(by).agg(F.sum(value * w).alias("__s"), F.sum(w).alias("__w"))
    return out.select(by, F.coalesce(F.try_divide(F.col("__s"), F.col("__w")), F.lit(default)).alias("weighted_mean"))


def reciprocal_top(df: DataFrame, by: str, value: str, tie: str, k: int = 3) -> DataFrame:
    """Mean of the k greatest values, weighted 1, 1/2, 1/3, ..."""
    w = Window.partitionBy(by).orderBy(F.desc(value), F.asc(tie))
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(by).agg((F.sum(F.col(value) / F.col("__r")) / F.sum(1 / F.col("__r"))).alias("rr_mean"))


def slices(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Means over each single dimension: dimension, slice, n, mean."""
    parts = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims]))
    return df.select(parts.alias("p"), value).groupBy("p.dimension", "p.slice").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean")).select("dimension", "slice", "n", "mean")


def bootstrap(df: DataFrame, topic: str, value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and percentile interval over resampled topics.

    Each topic's weight in a round is a Poisson(1) draw made from a hash of round and topic, so
    that every task can draw it alone; topics are reduced to sums first.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(topic).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    u = F.pmod(F.xxhash64(F.col(topic), F.col("round"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    edges, p, q = [], 0.36787944117144233, 0.0
    for k in range(8):
        q += p
        edges.append(q)
        p /= k + 1
    weight = F.lit(0)
    for e in edges:
        weight = weight + F.when(u >= e, 1).otherwise(0)
    drawn = sums.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    means = drawn.groupBy("round").agg(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum(F.col("c") * F.col("w"))).alias("m"))
    ends = means.agg(F.percentile("m", [0.025, 0.975]).alias("ci"))
    point = sums.agg((F.sum("s") / F.sum("c")).alias("mean"))
    return point.crossJoin(ends).select("mean", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed agreement, Cohen's kappa, and quadratic weighted kappa of two raters with grades."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = cells.groupBy(F.col("a").alias("g")).agg(F.sum("c").alias("na"))
    cols = cells.groupBy(F.col("b").alias("g")).agg(F.sum("c").alias("nb"))
    same = rows.join(cols, "g").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("same"))
    # The squared distances of all pairs of grades, from their moments: one row.
    n = cells.agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("a")).alias("a1"), F.sum(F.col("c") * F.col("a") ** 2).alias("a2"),
        F.sum(F.col("c") * F.col("b")).alias("b1"), F.sum(F.col("c") * F.col("b") ** 2).alias("b2"))
    chance = n.crossJoin(same).select("same", (F.col("n") * (F.col("a2") + F.col("b2")) - 2 * F.col("a1") * F.col("b1")).alias("far"))
    n = n.select("n")
    seen = cells.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0.0)).alias("hit"), F.sum((F.col("a") - F.col("b")) ** 2 * F.col("c")).alias("off"))
    po, pe = F.col("hit") / F.col("n"), F.col("same") / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).crossJoin(seen).select(
        F.col("n").cast("long").alias("n"), po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"),
        (1 - F.try_divide(F.col("off") * F.col("n"), F.col("far"))).alias("weighted_kappa"),
    )


def binary_scores(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """Precision, recall, F1 and false positive rate of a yes/no answer."""
    c = df.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    return c.select(
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"),
    )


def frontier(df: DataFrame, key: str, most: list[str], least: list[str], block: int = 4096) -> DataFrame:
    """Rows that no other row dominates (as good in all, better in one); rows with a null among the values are none.

    Each task first drops what its own rows dominate. What is left meets in blocks: every block's rows against every
    block's, so no task holds more than two blocks, however many rows stay. A row is dominated by a row that was
    dropped only if it is also by one that was kept.
    """
    names = [*most, *least]
    spark, values = df.sparkSession, df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).na.drop(subset=names)

    def better(x: np.ndarray) -> np.ndarray:
        """Larger is better in all columns; best sums first, so that dominated rows fall early."""
        return np.concatenate([x[:, : len(most)], -x[:, len(most) :]], axis=1)

    def beaten(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.array([bool(((by >= r).all(axis=1) & (by > r).any(axis=1)).any()) for r in x], bool)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = better(b[names].to_numpy(float))
                best = x[np.argsort(-x.sum(axis=1), kind="stable")[:256]]
                yield b[~beaten(x, best)]

    kept = stored(values.mapInPandas(local, values.schema), "frontier")
    blocks = max(1, -(-kept.count() // block))
    number = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = kept.select(key, *names, number.alias("__a"), every.alias("__b"))
    right = kept.select(*[F.col(c).alias(f"__{c}") for c in names], number.alias("__b"), every.alias("__a"))

    def against(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        lost = beaten(better(a[names].to_numpy(float)), better(b[[f"__{c}" for c in names]].to_numpy(float))) if len(a) and len(b) else np.zeros(len(a), bool)
        return a.loc[lost, [key]]

    kind = spark.createDataFrame([], df.select(key).schema).schema
    lost = left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInPandas(against, kind)
    whole = kept.select(F.col(key).alias("__k")).join(lost.select(F.col(key).alias("__k")).distinct(), "__k", "left_anti")
    return df.join(whole.distinct(), F.col(key) == F.col("__k"), "left_semi")


def duplicate_groups(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """fingerprint, n and smallest id of groups of more than one row."""
    return df.groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id")).where((F.col("n") > 1) & F.col("fingerprint").isNotNull())


def coverage(covered: Column, missing: Column) -> Column:
    n, m = F.size(covered), F.size(missing)
    return F.when(n + m == 0, 0.0).otherwise(100.0 * n / (n + m))


def sample_confidence(n: Column) -> Column:
    return F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("insufficient")


def term_categories(facts: DataFrame, owner: str, term: str, kind: str, owners: int) -> DataFrame:
    """term, n, required, preferred and category; one fact per owner and lower-cased term, required first.

    core: required by half of the owners; high_frequency: a quarter name it; bonus: more preferred than required.
    """
    rank = F.when(F.col(kind) == "required", 2).when(F.col(kind) == "preferred", 1).otherwise(0)
    one = facts.groupBy(owner, F.lower(term).alias("term")).agg(F.max(rank).alias("r"))
    n = F.count(F.lit(1))
    counted = one.groupBy("term").agg(n.alias("n"), F.count_if(F.col("r") == 2).alias("required"), F.count_if(F.col("r") == 1).alias("preferred"))
    category = (
        F.when(F.col("required") / owners >= 0.5, "core").when(100.0 * F.col("n") / owners >= 25, "high_frequency")
        .when(F.col("preferred") > F.col("required"), "bonus").otherwise("emerging")
    )
    return counted.withColumn("category", category)


def clusters(df: DataFrame, role: Column, title: str, most: int = 5) -> DataFrame:
    """role, n and up to `most` distinct titles, the most frequent first."""
    counts = df.select(role.alias("role"), F.col(title).alias("title")).groupBy("role", "title").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("role").orderBy(F.desc("c"), "title")
    top = counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    titles = top.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "title"))), lambda x: x["title"]).alias("titles"))
    return counts.groupBy("role").agg(F.sum("c").alias("n")).join(titles, "role")


def progress(df: DataFrame, by: str, status: str, done: tuple[str, ...]) -> DataFrame:
    """total, done and percentage done of each group."""
    n = F.count(F.lit(1))
    good = F.count_if(F.col(status).isin(*done))
    return df.groupBy(by).agg(n.alias("total"), good.alias("done"), F.bround(100.0 * good / n, 1).alias("pct"))


def watermark(df: DataFrame, id_: str, *columns: str) -> DataFrame:
    """What a cache of this table is valid for: distinct ids and the greatest values."""
    return df.agg(F.countDistinct(id_).alias("ids"), *[F.max(c).cast("string").alias(f"max_{c}") for c in columns])


def possible_duplicates(df: DataFrame, key: Column) -> DataFrame:
    """One row: how many rows could go, the sum of n - 1 over the groups of one fingerprint."""
    groups = df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("possible_duplicates"), F.count_if(F.col("n") > 1).alias("groups"))


def newest_groups(df: DataFrame, parent: str, child: str, updated: str, most: int = 20) -> DataFrame:
    """parent, n, last_updated and the ids of its newest children (at most `most`), for parents by their newest child."""
    w = Window.partitionBy(parent).orderBy(F.desc(updated), child)
    top = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    ids = top.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(child).alias("id")))), lambda x: x["id"]).alias("newest"))
    return df.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.max(updated).alias("last_updated")).join(ids, parent)


#: How much evidence an answer needs by intent.
FLOORS = {"chat": 0, "lookup": 1, "comparison": 3, "market": 5}


def evidence_floor(df: DataFrame, intent: str, fresh: Column) -> DataFrame:
    """Per intent: fresh samples, stale ones that are left out, the floor and whether it is reached."""
    floor = F.lit(0)
    for name, n in FLOORS.items():
        floor = F.when(F.col(intent) == name, n).otherwise(floor)
    good = F.count_if(fresh)
    return df.groupBy(intent).agg(good.alias("samples"), F.count_if(~F.coalesce(fresh, F.lit(False))).alias("stale"), F.max(floor).alias("floor"), (good >= F.max(floor)).alias("enough"))
