"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in doc_id order, form blocks. The i-th block of a source
of weight w may be placed from slot floor(i / w) on and before slot
ceil((i + 1) / w); the block of the earliest deadline goes first. Then at every slot
each source has been given less than one block more or less than its weight's
share. Weights are never rounded: a float is a fraction, so all of them are whole
numbers over one denominator, and windows are computed from these.

What is given at a slot depends only on how many blocks each source was given
before. The driver runs through the schedule once (a few microseconds a block, so
its time grows with the number of blocks) and keeps these counts at every SEGMENT-th
slot; tasks run the segments of their own blocks again. One count for each source
and segment, and one for each source and range of ids, is all that is held outside
of Spark's tables.

When a source has no blocks left a new phase begins in which the others share its
weight in proportion. The mixture proper ends when the sources left hold less than
half of the target weight: from then on it can't follow the targets (`in_mixture`
is false for the rest, which is the surplus of the over-full sources).

Numbering within a source goes by ranges of doc_id, so a source with a third of all
rows is numbered by as many tasks as there are ranges.

Edge cases: a null source counts as the empty name; a null doc_id sorts first; equal
doc_ids keep any order among themselves; a deadline past the greatest long is that
long; a source without a given weight gets none
and its documents no slot (null, outside the mixture); without given weights each
source has the square root of its documents; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_ranges, partitions

BLOCK_DOCS = 8
SEGMENT = 4096
LAST = (1 << 63) - 1
SCHEDULE = "doc_id long, source string, block long, place int, phase int, slot long, release long, deadline long, in_mixture boolean"


def dealt(shares: list[int], given: list[int], first: int, slots: int) -> np.ndarray:
    """Which source each of the next slots goes to, after `given` blocks of each in the first ones."""
    if len(shares) == 1:
        return np.zeros(slots, np.int32)
    total, n, out = sum(shares), list(given), np.empty(slots, np.int32)
    waiting = [(n[k] * total // share, k) for k, share in enumerate(shares)]  # by release
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # by deadline
    for slot in range(first, first + slots):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(n[k] + 1) * total // shares[k]), k))
        _, k = heapq.heappop(ready)
        out[slot - first] = k
        n[k] += 1
        heapq.heappush(waiting, (n[k] * total // shares[k], k))
    return out


@dataclass
class Phase:
    first_slot: int
    shares: dict[str, int]
    first_block: dict[str, int]
    given: np.ndarray  # blocks of each source before each segment
    inside: bool

    def segment(self, at: int) -> dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each source: the first block of a segment, and its blocks' slots, releases and deadlines."""
        before, first, total = self.given[at].tolist(), at * SEGMENT, sum(self.shares.values())
        slots = int(self.given[at + 1].sum()) - first
        order, out = dealt(list(self.shares.values()), before, first, slots), {}
        for k, (s, share) in enumerate(self.shares.items()):
            places = np.flatnonzero(order == k) + first
            numbers = range(before[k], before[k] + len(places))
            release = np.array([i * total // share for i in numbers], np.int64)
            deadline = np.array([min(-(-(i + 1) * total // share), LAST - self.first_slot) for i in numbers], np.int64)
            out[s] = (before[k], places + self.first_slot, release + self.first_slot, deadline + self.first_slot)
        return out


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[Phase]:
    """The phases of the schedule, from the number of blocks of each source."""
    left = {s: n for s, n in sorted(blocks.items()) if n > 0 and shares.get(s, 0) > 0}
    done, slot, whole, out = dict.fromkeys(left, 0), 0, sum(shares[s] for s in left), []
    while left:
        now = {s: shares[s] for s in left}
        most, ended = np.array(list(left.values()), np.int64), False
        given = [np.zeros(len(now), np.int64)]
        while not ended:
            slots = min(SEGMENT, int((most - given[-1]).sum()))
            order = dealt(list(now.values()), given[-1].tolist(), SEGMENT * (len(given) - 1), slots)
            # As far as the slot in which the first source runs out.
            for k, n in enumerate((most - given[-1]).tolist()):
                places = np.flatnonzero(order == k)
                if len(places) >= n:
                    order, ended = order[: places[n - 1] + 1], True
            given.append(given[-1] + np.bincount(order, minlength=len(now)))
        out.append(Phase(slot, now, {s: done[s] for s in now}, np.stack(given), 2 * sum(now.values()) >= whole))
        for s, n in zip(now, given[-1].tolist(), strict=True):
            done[s] += n
            left[s] -= n
        slot += int(given[-1].sum())
        left = {s: n for s, n in left.items() if n}
    return out


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items() if w > 0}
    over = math.lcm(*[x.denominator for x in parts.values()])
    whole = {s: int(x * over) for s, x in parts.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: x // common for s, x in whole.items()}


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, source, number (from 0, by doc_id within the source); and documents by source."""
    count = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"))
    ranged = id_ranges(rows, "doc_id", count)
    before, totals = {}, {}
    # One count for each source and range.
    for r in sorted(ranged.groupBy("source", "bucket").count().collect(), key=lambda r: (r["source"], r["bucket"])):
        before[(r["source"], r["bucket"])] = totals.get(r["source"], 0)
        totals[r["source"]] = totals.get(r["source"], 0) + r["count"]
    order = Window.partitionBy("source", "bucket").orderBy("doc_id")
    inner = ranged.withColumn("number", F.row_number().over(order).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [before[k] for k in zip(batch["source"], batch["bucket"], strict=True)]
            batch["number"] += np.array(base, np.int64) - 1
            yield batch[["doc_id", "source", "number"]].astype({"doc_id": "Int64"})

    return inner.mapInPandas(run, "doc_id long, source string, number long"), totals


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_DOCS) -> DataFrame:
    """Every document with its block, slot, window (release, deadline) and phase."""
    rows, totals = numbered(docs)
    shares = whole_shares(weights or {s: n**0.5 for s, n in totals.items()})
    plan = phases({s: -(-n // block) for s, n in totals.items()}, shares)
    starts = {s: np.array([p.first_block[s] for p in plan if s in p.shares]) for s in totals}
    which = {s: [k for k, p in enumerate(plan) if s in p.shares] for s in totals}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments: dict[tuple[int, int], dict] = {}
        for batch in batches:
            out = batch[["doc_id", "source"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            number = batch["number"].to_numpy()
            out["block"], out["place"] = number // block, (number % block).astype("int32")
            made = {c: np.zeros(len(batch), np.int64) for c in ("phase", "slot", "release", "deadline")}
            inside, known = np.zeros(len(batch), bool), np.zeros(len(batch), bool)
            for s, at in batch.groupby("source").indices.items():
                if not len(starts[s]):
                    continue
                k = np.searchsorted(starts[s], number[at] // block, "right") - 1
                for j in np.unique(k):
                    some, phase = at[k == j], plan[which[s][j]]
                    i = number[some] // block - phase.first_block[s]
                    part = np.searchsorted(phase.given[:, list(phase.shares).index(s)], i, "right") - 1
                    for g in np.unique(part):
                        if (which[s][j], g) not in segments:
                            if len(segments) >= 64:
                                segments.clear()
                            segments[which[s][j], g] = phase.segment(int(g))
                        mine = part == g
                        first, *columns = segments[which[s][j], g][s]
                        for c, x in zip(("slot", "release", "deadline"), columns, strict=True):
                            made[c][some[mine]] = x[i[mine] - first]
                    made["phase"][some] = which[s][j]
                    inside[some], known[some] = phase.inside, True
            for c, x in made.items():
                out[c] = pd.array(x, dtype="Int32" if c == "phase" else "Int64")
                out.loc[~known, c] = pd.NA
            out["in_mixture"] = inside
            yield out

    return rows.mapInPandas(run, SCHEDULE)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_DOCS) -> DataFrame:
    """The documents of the mixture, all columns; rows that share a doc_id and source go together."""
    chosen = schedule(docs, weights, block).where("in_mixture")
    chosen = chosen.select("doc_id", F.col("source").alias("from")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("source"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("source") == F.col("from")), "left_semi")
    return kept.select("row.*")
