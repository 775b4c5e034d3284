"""Ordered folds: what each row becomes by the rows before it in its group.

Rows are dealt by group and sorted (Spark spills, where it must); a task then reads them in order and carries one state, that
of the group it is in, across Arrow batches. So a group may have any number of rows and none is ever collected. A fold over
other orders of the same groups only sorts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Tiers of a context in order, and their shares of its budget.
TIERS = (("PRIMARY", 0.6), ("SUPPORTING", 0.25), ("CONTRADICTORY", 0.15), ("BACKGROUND", 0.15))


def fold(df: DataFrame, by: list[str], order: list[Column], start: Any, step: Callable, inputs: list[str], out: str, kind: T.DataType) -> DataFrame:
    """df with a column `out`: step(state, *inputs) gives (next state, value), from `start` in each group.

    Null keys are a group. Rows that tie in `order` come in no given order: let it be complete where that matters.
    """
    names = [c for c in df.columns if c != out]
    made = T.StructType([*(df.schema[c] for c in names), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            values = []
            columns = [batch.column(c).to_pylist() for c in (*by, *inputs)]
            for row in zip(*columns, strict=True):
                if row[: len(by)] != group:
                    group, state = row[: len(by)], start
                state, value = step(state, *row[len(by) :])
                values.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, to_arrow_type(kind))], names=[*names, out])

    return df.select(*names).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, made)


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: int, first_always: bool = False, most: int | None = None, out: str = "taken") -> DataFrame:
    """Whether each row is taken: in order, rows that fit what is left of the budget; others are passed over.

    first_always: the first row is taken whatever it costs. most: no more rows than that. A null cost is never taken.
    """

    def step(state, cost):
        used, count = state
        fits = cost is not None and (used + cost <= budget or (first_always and not count)) and (most is None or count < most)
        return ((used + cost, count + 1), True) if fits else (state, False)

    return fold(df, by, order, (0, 0), step, [cost], out, T.BooleanType())


def tiered(df: DataFrame, by: list[str], order: list[Column], tier: str, cost: str, budget: int, tiers: tuple[tuple[str, float], ...] = TIERS) -> DataFrame:
    """df with `taken` (null, 'tier' or 'rest') and `place`: a context of several tiers, each within its share of the budget.

    Tiers are filled one after the other, each up to its share and all up to the budget; then what was passed over takes up
    what is left, in the same order. Shares are of their sum over the first three tiers. Rows of other tiers are never taken.
    """
    whole = sum(share for _, share in tiers[:3])
    shares = {name: int(budget * share / whole) for name, share in tiers}
    number = F.lit(None).cast("int")
    for n, (name, _) in enumerate(tiers):
        number = F.when(F.col(tier) == name, n).otherwise(number)
    ranked = df.withColumn("__tier", number)

    def fill(state, at, cost):
        tier_, used, own = state
        own = own if at == tier_ else 0
        fits = at is not None and cost is not None and own + cost <= shares[tiers[at][0]] and used + cost <= budget
        return (at, used + cost, own + cost) if fits else (at, used, own), fits

    first = fold(ranked, by, [F.col("__tier").asc_nulls_last(), *order], (None, 0, 0), fill, ["__tier", cost], "__first", T.BooleanType())

    def rest(state, first, at, cost):
        used, place = state
        fits = first or (at is not None and cost is not None and used + cost <= budget)
        value = {"taken": "tier" if first else "rest", "place": place} if fits else {"taken": None, "place": None}
        return ((used + cost, place + 1) if fits else state), value

    kind = T.StructType([T.StructField("taken", T.StringType()), T.StructField("place", T.IntegerType())])
    out = fold(first, by, [F.desc("__first"), F.col("__tier").asc_nulls_last(), *order], (0, 1), rest, ["__first", "__tier", cost], "__out", kind)
    return out.select(*df.columns, "__out.taken", "__out.place")
