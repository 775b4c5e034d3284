"""Ordered folds against loops over each group."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import folds


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups go over the edges of batches
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def made(spark, n=400):
    rng = random.Random(n)
    rows = [(rng.choice([None, "a", "hot", "hot", f"g{rng.randrange(20)}"]), k, rng.choice([None, 0, *range(1, 60)]), rng.choice(["PRIMARY", "SUPPORTING", "CONTRADICTORY", "BACKGROUND", "OTHER", None])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, k int, cost int, tier string").repartition(5)


def groups(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out.values()


def test_running_state(spark, small_batches):
    rows, df = made(spark)
    got = folds.fold(df, ["g"], [F.desc("k")], 0, lambda s, c: (s + (c or 0), s), ["cost"], "before", T.LongType())
    want = Counter()
    for group in groups(rows):
        s = 0
        for r in reversed(group):
            want[(*r, s)] += 1
            s += r[2] or 0
    assert got.columns == [*df.columns, "before"] and Counter(map(tuple, got.collect())) == want
    assert folds.fold(df.limit(0), ["g"], [F.col("k")], 0, lambda s, c: (s, s), ["cost"], "before", T.LongType()).count() == 0


@pytest.mark.parametrize("first_always,most", [(False, None), (True, None), (True, 3)])
def test_within_budget(spark, small_batches, first_always, most):
    rows, df = made(spark)
    got = {r["k"]: r["taken"] for r in folds.within_budget(df, ["g"], [F.col("k")], "cost", 40, first_always, most).collect()}
    want = {}
    for group in groups(rows):
        used, count = 0, 0
        for _, k, cost, _ in group:
            want[k] = cost is not None and (used + cost <= 40 or (first_always and count == 0)) and (most is None or count < most)
            if want[k]:
                used, count = used + cost, count + 1
    assert got == want and len(got) == len(rows)


def test_tiers(spark, small_batches):
    rows, df = made(spark)
    got = {r["k"]: (r["taken"], r["place"]) for r in folds.tiered(df, ["g"], [F.col("k")], "tier", "cost", 200).collect()}
    want = {r[1]: (None, None) for r in rows}
    for group in groups(rows):
        used, place, passed = 0, 1, []
        for tier, share in (("PRIMARY", 120), ("SUPPORTING", 50), ("CONTRADICTORY", 30), ("BACKGROUND", 30)):
            own = 0
            for _, k, cost, _ in (r for r in group if r[3] == tier and r[2] is not None):
                if own + cost > share or used + cost > 200:
                    passed.append((k, cost))
                    continue
                want[k], place, used, own = ("tier", place), place + 1, used + cost, own + cost
        for k, cost in passed:
            if used + cost <= 200:
                want[k], place, used = ("rest", place), place + 1, used + cost
    assert got == want
