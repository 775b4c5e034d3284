"""Reports over ranked rows: market reports, roadmaps, evidence, cached results, comparisons, checks and resumption."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from . import scoring as S

#: What makes a relation between two notes an update.
UPDATE_WORDS = ("正在", "学完", "已经", "优先", "只考虑")
#: Phases of a roadmap, and which of the ranked names each one takes (first, how many).
PHASES = (("1-2", ((0, 3),)), ("3-5", ((0, 4), (4, 2))), ("6-8", ((4, 4),)), ("9-10", ((8, 2),)), ("11-12", ((0, 4),)))


def market_report(df: DataFrame, title: str, skills: str, text: str, newest: str, key: str, query: str, least: float = 2.0, most: int = 100) -> DataFrame:
    """The rows that are relevant to a query, best and then newest first, at most `most` (a top-k, as asked for)."""
    scored = df.withColumn("relevance", S.market_relevance(F.col(title), F.col(skills), F.col(text), query))
    return scored.where(F.col("relevance") >= least).orderBy(F.desc("relevance"), F.desc(newest), key).limit(most)


def ranked_names(df: DataFrame, by: str, name: str, most: int = 10) -> DataFrame:
    """by, names: the most frequent names of each group in order. Counted first, so a group holds its distinct names only."""
    counts = df.where(F.col(name).isNotNull()).groupBy(by, name).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), name))).where(F.col("rank") <= most)
    return ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias("names"))


def roadmap(names: Column) -> Column:
    """array of struct(weeks, names): ranked names dealt to phases; names that come later stand in for missing ones."""
    def part(first: int, n: int) -> Column:
        cut = F.slice(names, first + 1, n)
        return F.when((F.size(cut) == 0) & (F.lit(first) == 4), F.slice(names, 1, n)).otherwise(cut)

    return F.array(*[F.struct(F.lit(weeks).alias("weeks"), F.concat(*[part(*p) for p in parts]).alias("names")) for weeks, parts in PHASES])


def reusable(df: DataFrame, key: str, done: Column, fallback: Column, when: str, id_: str) -> DataFrame:
    """One finished row per key: those that aren't from a fallback first, then the newest."""
    best = F.max(F.struct((~fallback).alias("own"), F.col(when), F.col(id_))).alias("best")
    return df.where(done).groupBy(key).agg(best).select(key, F.col(f"best.{id_}").alias(id_), F.col(f"best.{when}").alias(when), (~F.col("best.own")).alias("from_fallback"))


def ordered_children(df: DataFrame, parent: str, updated: str, child: str) -> DataFrame:
    """Child rows with their group's last update, groups by that (newest first), then children by their own number."""
    last = df.groupBy(parent).agg(F.max(updated).alias("updated_at"), F.count(F.lit(1)).alias("tasks"))
    return df.select(parent, child).join(last, parent).orderBy(F.desc("updated_at"), parent, child)


def first_seen(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group once, where it came first, with its place."""
    first = df.groupBy(group, value).agg(F.min(order).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("first", value)))


def terms(text: Column) -> Column:
    """Distinct ASCII words of two characters or more and CJK runs, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z0-9+#.\-]+|[一-鿿]{2,})"), 1))


def relation(new: Column, old: Column, same_key: Column) -> Column:
    """SAME, EXTENDS, UPDATES, CONFLICTS or UNRELATED: how a note stands to an older one of its key; null counts as empty."""
    a, b = F.lower(F.coalesce(new, F.lit(""))), F.lower(F.coalesce(old, F.lit("")))
    mine, theirs = terms(a), terms(b)
    wider = (F.size(theirs) > 0) & (F.size(F.array_except(theirs, mine)) == 0) & (F.size(mine) > F.size(theirs))
    update = reduce(lambda x, y: x | y, [a.contains(w) | b.contains(w) for w in UPDATE_WORDS])
    return F.when(~F.coalesce(same_key, F.lit(False)), "UNRELATED").when(a == b, "SAME").when(wider, "EXTENDS").when(update, "UPDATES").otherwise("CONFLICTS")


def evidence_window(text: Column, pattern: str, before: int = 70, after: int = 100) -> Column:
    """The first match of a pattern with what is around it; null without a match. The pattern has no lookarounds."""
    hit = F.regexp_substr(text, F.lit(pattern))
    start = F.greatest(F.lit(1), F.instr(text, hit) - before)
    return F.substring(text, start, F.instr(text, hit) + F.length(hit) + after - start)


def bare(text: Column) -> Column:
    """Letters, digits, _, + and # alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_+#]+", "")


def uncovered_lines(text: Column, covered: Column) -> Column:
    """Distinct lines that no covering value holds: equal, or inside one of at least three quarters of the line's length
    (which being inside implies), of six characters or more."""
    values = F.filter(F.transform(covered, bare), lambda v: F.length(v) >= 6)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: bare(x) != "")
    return F.array_distinct(F.filter(lines, lambda x: ~F.exists(values, lambda v: v.contains(bare(x)))))


def fenced(df: DataFrame, key: str, order: list[str], generation: str) -> DataFrame:
    """accepted: whether a write's generation is at least that of every write of its key before it."""
    before = F.max(generation).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("accepted", F.coalesce(F.col(generation) >= before, F.lit(True)))


def pending(items: DataFrame, checkpoint: DataFrame, key: str, attempts: int = 5) -> DataFrame:
    """Items to take up again: never tried, or tried fewer than `attempts` times and not done. checkpoint(key, done, tried)."""
    known = items.join(checkpoint, key, "left")
    return known.where(~F.coalesce("done", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < attempts))


def named_in(text: Column, values: list[str]) -> Column:
    """The values that a free text names, in their order here."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(low, F.lower(v)))


def guarded(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """reason: why a vector can't be searched (missing, dimensions, not_finite, zero), or null."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(v.isNull(), "missing").when(F.size(v) != dimensions, "dimensions").when(bad, "not_finite").when(F.forall(v, lambda x: x == 0), "zero")
    return vectors.withColumn("reason", reason)


def consistent(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """failed: names of the checks that don't hold (a null doesn't), in order."""
    return df.withColumn("failed", F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in checks.items()])))


def evidence_hits(hits: DataFrame, query: str, item: str, semantic: str, lexical: str, most: int = 4) -> DataFrame:
    """The best items of each query over several field queries: the highest semantic and lexical score of each, .65 and .35."""
    one = hits.groupBy(query, item).agg((0.65 * F.coalesce(F.max(semantic), F.lit(0.0)) + 0.35 * F.coalesce(F.max(lexical), F.lit(0.0))).alias("score"))
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return one.withColumn("rank", place).where(F.col("rank") <= most)


def config_summary(df: DataFrame, by: list[str], relevant: str, metrics: list[str], latency: str) -> DataFrame:
    """Per configuration: how many cases have relevant items, the mean of each metric over those, median and 95th percentile latency."""
    has = F.col(relevant) > 0
    means = df.groupBy(*by).agg(
        F.count_if(has).alias("answerable"), F.count_if(~F.coalesce(has, F.lit(False))).alias("unanswerable"),
        *[F.avg(F.when(has, F.col(m))).alias(m) for m in metrics])
    n = F.col("n")
    half = {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)}
    places = A.at_ranks(df, by, latency, half | {"p95": F.greatest(F.lit(0), F.least(n - 1, F.floor(n * 0.95) - 1))})
    return means.join(places.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("p50"), "p95"), by)


def text_match(columns: list[Column], query: str, extra: tuple[str, ...] = ()) -> Column:
    """All of the query's words among a column's words, or any of the query and the extra terms inside a column."""
    words = [w for w in query.lower().split() if w]
    out = F.lit(False)
    for c in columns:
        low = F.lower(F.coalesce(c, F.lit("")))
        tokens = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), 1)
        out = out | F.size(F.array_except(F.array(*[F.lit(w) for w in words]), tokens)).eqNullSafe(0)
        for term in (query.lower(), *extra):
            out = out | F.contains(low, F.lit(term.lower()))
    return out
