"""Samples that balance several dimensions, and intervals from resampling with a seeded generator."""

from __future__ import annotations

import math
import random
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Kinds of rows that are looked at in one go.
HEADS = 2048
RARITY = 0.2
#: Values that a task of the bootstrap holds.
MOST_VALUES = 5_000_000


def coverage_sample(df: DataFrame, id_: str, dimensions: list[str], size: int, seed: str = "s", heads: int = HEADS) -> DataFrame:
    """`size` rows (all, if there are fewer) that cover the dimensions' values as they occur: id_, place (from 1).

    One after the other, the row is taken whose values lack most of their share of the sample (relative to it, shares under
    one row count as one), with .2 of the values' rarity added; ties go to the kind of rows whose first row comes first by a
    hash of the id and the seed, then by id. Null values are values. Ids must be unique and not null.

    Rows of equal values are one kind with one score, and what is taken can only lower scores. So the driver looks at the
    best `heads` kinds, and the score of the next one, as it was read, bounds all others; it asks Spark for new scores, with
    the counts of what was taken, only when its best falls below. It holds `heads` kinds and the sample, whatever the table.
    """
    n = df.count()
    names = [f"v{k}" for k in range(len(dimensions))]
    first = F.struct(F.md5(F.concat(F.lit(seed), F.col(id_).cast("string"))).alias("h"), F.col(id_).alias("id"))
    rows = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("\x00")).alias(v) for d, v in zip(dimensions, names, strict=True)], first.alias("first"))
    rows = stored(rows, "sample-rows")
    if size >= n:
        order = Window.orderBy("first")
        return rows.where(F.lit(size) > 0).select(F.col("first.id").alias(id_), F.row_number().over(order).alias("place"))
    kinds = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    rarity = F.lit(0.0)
    for v in names:
        totals = rows.groupBy(v).agg(F.count(F.lit(1)).alias(f"{v}_total"))
        kinds = kinds.join(totals, v)
        rarity = rarity + 1.0 / F.col(f"{v}_total")
    kinds = stored(kinds.withColumn("rarity", rarity), "sample-kinds")
    target = lambda total: size * total / max(n, 1)

    counts: list[Counter] = [Counter() for _ in names]
    taken: Counter = Counter()
    chosen: list[tuple] = []

    def bound(some: DataFrame) -> DataFrame:
        """The kinds with their scores as the sample is now."""
        score = F.lit(0.0)
        for v, count in zip(names, counts, strict=True):
            seen = F.lit(0)
            if count:  # no more values than rows in the sample
                known = some.sparkSession.createDataFrame([(x, c) for x, c in count.items()], f"{v} string, {v}_seen int")
                some = some.join(F.broadcast(known), v, "left")
                seen = F.coalesce(F.col(f"{v}_seen"), F.lit(0))
            goal = F.lit(size) * F.col(f"{v}_total") / F.lit(max(n, 1))
            score = score + F.greatest(F.lit(0.0), goal - seen) / F.greatest(goal, F.lit(1.0))
        return some.withColumn("score", score + F.col("rarity") * RARITY)

    def score(kind) -> float:
        cover = rare = 0.0
        for v, count in zip(names, counts, strict=True):
            goal = target(kind[f"{v}_total"])
            cover += max(0.0, goal - count[kind[v]]) / max(goal, 1.0)
            rare += 1.0 / kind[f"{v}_total"]
        return cover + rare * RARITY

    def read():
        """The best kinds, and what no other kind exceeds: a score, and the first row of the kind that has it."""
        scored = bound(kinds)
        used = [(*k, c) for k, c in taken.items()]  # no more kinds than rows in the sample
        if used:
            spent = kinds.sparkSession.createDataFrame(used, ", ".join(f"{v} string" for v in names) + ", used long")
            scored = scored.join(F.broadcast(spent), names, "left").where(F.coalesce("used", F.lit(0)) < F.col("n"))
        found = scored.orderBy(F.desc("score"), "first").limit(heads + 1).collect()
        return found[:heads], (found[heads]["score"], tuple(found[heads]["first"])) if len(found) > heads else (-math.inf, ())

    def leader():
        alive = (k for k in held if taken[tuple(k[v] for v in names)] < k["n"])
        return min(((-score(k), tuple(k["first"]), k) for k in alive), key=lambda x: x[:2], default=None)

    held, others = read()
    while len(chosen) < size:
        best = leader()
        # Scores only fall, and among equal ones the kinds read come first.
        if best is None or -best[0] < others[0] - 1e-12 or (-best[0] <= others[0] + 1e-12 and best[1] > others[1]):
            held, others = read()
            best = leader()
        kind = tuple(best[2][v] for v in names)
        taken[kind] += 1
        chosen.append((*kind, taken[kind], len(chosen) + 1))
        for v, count in zip(kind, counts, strict=True):
            count[v] += 1
    wanted = df.sparkSession.createDataFrame(chosen, ", ".join(f"{v} string" for v in names) + ", r int, place int")
    own = rows.join(F.broadcast(wanted.select(*names).distinct()), names, "left_semi")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy(*names).orderBy("first"))).where(F.col("r") <= size)
    return ranked.join(F.broadcast(wanted), [*names, "r"]).select(F.col("first.id").alias(id_), "place")


def _rounds(n: int, low: int, high: int, state: tuple, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """n results of randrange(n) for each round from low to high, of a generator in that state; one round is held."""
    raw = np.random.RandomState()
    raw.set_state(("MT19937", np.array(state[1][:-1], np.uint32), state[1][-1]))
    shift, skip, parts, have, left = 32 - n.bit_length(), low * n, [], 0, high - low
    while left > 0:
        draws = raw.randint(0, 1 << 32, size=chunk, dtype=np.uint32) >> shift
        draws = draws[draws < n]
        gone = min(skip, len(draws))
        skip, draws = skip - gone, draws[gone:]
        while left > 0 and have + len(draws) >= n:
            yield np.concatenate([*parts, draws[: n - have]])
            draws, parts, have, left = draws[n - have :], [], 0, left - 1
        if len(draws):
            parts.append(draws.copy())  # not a view, which would hold its chunk
            have += len(draws)


def seeded_interval(df: DataFrame, order: str, value: str, seed: int = 20260910, rounds: int = 1000, tasks: int = 16) -> DataFrame:
    """n, mean, low, high: the mean of a value and its percentile interval over rounds of resampling, to the digit of a seeded run.

    Rows are taken in the order given; null and non-finite values don't count; one value is its own interval, none gives
    nulls. Rounds (100 at least) are dealt to tasks; each replays the generator from its seed up to its own rounds, which is
    a few nanoseconds a draw, and holds the values, of which there may be `MOST_VALUES`.
    """
    spark = df.sparkSession
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) != float("inf"))).select(order, F.col(value).cast("double").alias("v"))
    n = kept.count()
    if n > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values: use aggregates.bootstrap")
    values = array("d", kept.orderBy(order, "v").select("v").toArrow().column(0).to_numpy().tobytes())  # MOST_VALUES at most
    made = "n long, mean double, low double, high double"
    if n < 2:
        return spark.createDataFrame([(n, *(list(values) * 3 or [None] * 3))], made)
    rounds = max(100, rounds)
    sent, state = spark.sparkContext.broadcast(np.array(values)), random.Random(seed).getstate()
    share = -(-rounds // tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for batch in batches:
            for k in batch["id"]:
                low, high = k * share, min(rounds, (k + 1) * share)
                if low < high:  # one round at a time, added as floats in turn
                    yield pd.DataFrame({"m": [sum(array("d", held[row].tobytes())) / n for row in _rounds(n, low, high, state)]})

    means = sorted(r["m"] for r in spark.range(0, tasks, 1, tasks).mapInPandas(run, "m double").collect())  # a number a round
    return spark.createDataFrame([(n, sum(values) / n, means[int(0.025 * (rounds - 1))], means[int(0.975 * (rounds - 1))])], made)


def seeded_topic_interval(df: DataFrame, topic: str, value: str, seed: int = 42, rounds: int = 2000, tasks: int = 16) -> DataFrame:
    """n, mean, low, high of a value whose topics are resampled whole, to the digit of a seeded run over the sorted topics.

    A topic is reduced to its exact sum and count before rounds are dealt; means are rounded once. Nulls don't count.
    """
    spark = df.sparkSession
    kept = df.where(F.col(topic).isNotNull() & F.col(value).isNotNull()).select(topic, F.col(value).cast("double").alias("v"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = defaultdict(Fraction), Counter()
        for batch in batches:
            for t, v in zip(batch["t"], batch["v"], strict=True):
                sums[t] += Fraction(v)
                counts[t] += 1
            if len(sums) > 100_000:
                yield pd.DataFrame([(t, str(s.numerator), str(s.denominator), counts[t]) for t, s in sums.items()], columns=["t", "a", "b", "c"])
                sums, counts = defaultdict(Fraction), Counter()
        yield pd.DataFrame([(t, str(s.numerator), str(s.denominator), counts[t]) for t, s in sums.items()], columns=["t", "a", "b", "c"])

    kind = df.schema[topic].dataType.simpleString()
    topics, sums, counts = [], defaultdict(Fraction), Counter()
    for t, a, b, c in kept.select(F.col(topic).alias("t"), "v").mapInPandas(exact, f"t {kind}, a string, b string, c long").collect():  # a row a topic and task
        sums[t] += Fraction(int(a), int(b))
        counts[t] += c
    topics = sorted(sums)
    n, made = sum(counts.values()), "n long, mean double, low double, high double"
    if not topics:
        return spark.createDataFrame([(0, None, None, None)], made)
    scale = max(s.denominator for s in sums.values())  # powers of two
    whole = [int(sums[t] * scale) for t in topics]
    sizes, share = [counts[t] for t in topics], -(-rounds // tasks)
    sent, state = spark.sparkContext.broadcast((whole, sizes)), random.Random(seed).getstate()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, sizes = sent.value
        for batch in batches:
            for k in batch["id"]:
                low, high = k * share, min(rounds, (k + 1) * share)
                if low < high:
                    raw = np.random.RandomState()
                    raw.set_state(("MT19937", np.array(state[1][:-1], np.uint32), state[1][-1]))
                    for _ in range(low):
                        raw.random_sample(len(whole))
                    means = []
                    for _ in range(high - low):  # one round at a time
                        row = np.floor(raw.random_sample(len(whole)) * len(whole)).astype(int).tolist()
                        means.append(float(Fraction(sum(map(whole.__getitem__, row)), scale * sum(map(sizes.__getitem__, row)))))
                    yield pd.DataFrame({"m": means})

    means = sorted(r["m"] for r in spark.range(0, tasks, 1, tasks).mapInPandas(run, "m double").collect())
    mean = float(Fraction(sum(whole), scale * n))
    return spark.createDataFrame([(n, mean, means[int(0.025 * rounds) - 1], means[int(0.975 * rounds) - 1])], made)
