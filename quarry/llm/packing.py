"""Best-fit packing of documents into sequences by bin completion.

Only the number of pieces of each length decides a packing, and there are at most
`capacity` lengths. So the search runs over that table of counts (bounded,
whatever the size of the corpus) and gives patterns: the lengths of one sequence
and how many sequences are filled that way. Spark cuts and counts the pieces,
numbers the pieces of each length, and places every piece by its number. Full
pieces are sequences of their own and are neither numbered nor shuffled.

The search fills one sequence at a time around the largest piece left. Its fillings
come by waste, then with the largest pieces first, one after the other as they are
asked for; a filling is dominated, and passed over, if a piece that it leaves could
stand in its waste, or in place of some of its pieces and as much more as fits. A
filling is used as often as its pieces allow, then half as often, down to once. A
branch is cut when its waste rules out fewer sequences than the incumbent has; the
first incumbent is best-fit decreasing. The search ends when the incumbent meets the
lower bound (of Martello and Toth), when no branch is left, both of which prove it
optimal, or after `steps` elementary steps (some 15 seconds at the default): then the
packing is the best one found, whole as ever, and `optimal` is false.

Edge cases: a null or empty text is the end id alone; a longer document than the
capacity is cut into full pieces and a rest; repeated rows are packed each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .wordids import END_ID, default_vocabulary, word_ids

CAPACITY = 4096
SHARDS = 64
STEPS = 20_000_000
KEPT = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, ...], int]


@dataclass
class Packing:
    patterns: list[Pattern]
    bound: int  # no packing has fewer sequences
    optimal: bool  # proven to have as few as possible

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.patterns)


@dataclass
class Steps:
    """What is left of the search's bounded effort."""

    left: int

    def spent(self, n: int = 1) -> bool:
        self.left -= n
        return self.left < 0


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best over k of: pieces over capacity - k each alone, those over half each in a sequence, and
    what pieces of k up to half need beyond the room that these leave."""
    n, size = np.cumsum(np.r_[0, counts]), np.cumsum(np.r_[0, counts * np.arange(len(counts))])
    half = capacity // 2
    k = np.arange(half + 1)
    large = n[-1] - n[half + 1]
    room = (n[capacity - k + 1] - n[half + 1]) * capacity - (size[capacity - k + 1] - size[half + 1])
    more = -(-(size[half + 1] - size[k] - room) // capacity)
    return int((large + np.maximum(more, 0)).max())


def bits_of(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


class Sums:
    """Sets of pieces by their sum, out of some lengths."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.lengths = np.flatnonzero(counts)[::-1].tolist()  # descending
        self.place = {x: k for k, x in enumerate(self.lengths)}
        # What the lengths from each place on can add up to, any number of each.
        mask, sums, self.reach = (1 << (capacity + 1)) - 1, 1, []
        for x in reversed(self.lengths):
            shift = x
            while shift <= capacity:
                sums |= (sums << shift) & mask
                shift *= 2
            self.reach.append(sums)
        self.reach.reverse()

    def exactly(self, free: list[int], target: int, steps: Steps) -> Iterator[tuple[int, ...]]:
        """Sets that add up to the target, those with the largest pieces first; free: pieces of each length."""
        if target == 0:
            yield ()
            return
        lengths, reach, chosen, left = self.lengths, self.reach, [], target
        at = bisect_left(lengths, -target, key=lambda x: -x)
        while True:
            while at < len(lengths) and reach[at] >> left & 1:
                if steps.spent():
                    return
                x = lengths[at]
                if x <= left and free[x] and reach[at] >> (left - x) & 1:
                    chosen.append(at)
                    free[x] -= 1
                    left -= x
                    if not left:
                        yield tuple(lengths[k] for k in chosen)
                        break
                else:
                    at += 1
            if not chosen or steps.spent():
                return
            at = chosen.pop()
            free[lengths[at]] += 1
            left += lengths[at]
            at += 1


def dominated(some: tuple[int, ...], there: np.ndarray, there_bits: int, waste: int) -> bool:
    """Whether a piece left out could stand in the waste, or in place of some pieces and part of the waste."""
    single = several = 0
    left_out = there_bits
    for x in set(some):
        if there[x] <= some.count(x):
            left_out &= ~(1 << x)
    for x in some:
        several |= (several | single) << x
        single |= 1 << x
    reached, width = (1 | single | several) << 1, 1  # sums and up to the waste more, at least one
    if waste:
        while width < waste:
            grow = min(width, waste - width)
            reached |= reached << grow
            width += grow
        if left_out & reached:
            return True
    return bool(left_out & several)


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: the first incumbent."""
    there, out = counts.copy(), []
    for length in range(capacity, 0, -1):
        while there[length]:
            pattern, left, use = [], capacity, there.copy()
            at = length
            while at:
                pattern.append(at)
                use[at] -= 1
                left -= at
                fits = np.flatnonzero(use[1 : left + 1])
                at = int(fits[-1]) + 1 if len(fits) else 0
            used, times = np.unique(pattern, return_counts=True)
            m = int((there[used] // times).min())
            there[used] -= m * times
            out.append((tuple(pattern), m))
    return out


def complete(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """Patterns that hold every piece. counts[n]: how many pieces of length n (n up to capacity)."""
    there = np.asarray(counts, np.int64).copy()
    total = int((there * np.arange(len(there))).sum())
    incumbent, bound = best_fit(there, capacity), lower_bound(there, capacity)
    best, path, wasted, bins = sum(m for _, m in incumbent), [], 0, 0
    if best <= bound:
        return Packing(incumbent, bound, True)
    sums, effort = Sums(there, capacity), Steps(steps)

    def options() -> Iterator[Pattern]:
        """Fillings around the largest piece and how often to use each; `there` is as now at every resumption."""
        largest = int(np.flatnonzero(there)[-1])
        rest = there.copy()
        rest[largest] -= 1
        rest_bits, room, free = bits_of(rest > 0), capacity - largest, rest.tolist()
        effort.spent(400)
        for waste in range(room + 1):
            # With more waste, as many sequences as the incumbent has would be needed.
            if wasted + waste > (best - 1) * capacity - total:
                return
            effort.spent(5)
            for some in sums.exactly(free, room - waste, effort):
                effort.spent(10 * len(some) + 50)
                if dominated(some, rest, rest_bits, waste):
                    continue
                pattern = (largest, *some)
                used, times = np.unique(pattern, return_counts=True)
                m = int((there[used] // times).min())
                while m:
                    yield pattern, m
                    m //= 2
            if effort.left < 0:
                return

    # Far above the end of the path only the number of options tried is kept; they are made again if it comes to that.
    stack: list[tuple[Iterator[Pattern] | None, int]] = [(options(), 0)]
    while stack and effort.left >= 0 and best > bound:
        source, tried = stack.pop()
        if source is None:
            source = islice(options(), tried, None)
        found = next(source, None)
        if found is not None:
            stack.append((source, tried + 1))
            pattern, m = found
            if wasted + m * (capacity - sum(pattern)) > (best - 1) * capacity - total:
                continue
            used, times = np.unique(pattern, return_counts=True)
            there[used] -= m * times
            path.append(found)
            wasted, bins = wasted + m * (capacity - sum(pattern)), bins + m
            if there.any():
                stack.append((options(), 0))
                if len(stack) > KEPT:
                    stack[-KEPT] = (None, stack[-KEPT][1])
                continue
            # All is placed in fewer sequences; go on from here.
            best, incumbent = bins, list(path)
        if path:
            pattern, m = path.pop()
            used, times = np.unique(pattern, return_counts=True)
            there[used] += m * times
            wasted, bins = wasted - m * (capacity - sum(pattern)), bins - m
    return Packing(incumbent, bound, best == bound or effort.left >= 0)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, step = word_ids(vocabulary), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode.ids(text) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, shards: int = SHARDS, steps: int = STEPS) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = stored(cut_pieces(docs, capacity, vocabulary), "pieces")
    part = pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    # At most capacity * shards numbers.
    table = np.zeros((capacity + 1, shards), np.int64)
    for row in part.groupBy("length", "shard").count().toLocalIterator():
        table[row["length"], row["shard"]] = row["count"]
    first = np.zeros_like(table)
    first[:, 1:] = np.cumsum(table, axis=1)[:, :-1]

    places, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, m in complete(table.sum(axis=1), capacity, steps).patterns:
        offset = 0
        for length in pattern:
            places.append((length, taken[length], sequence, offset))
            taken[length] += m
            offset += length
        sequence += m
    places = np.array(sorted(places), np.int64).reshape(-1, 4)
    keys = (places[:, 0] << 48) + places[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy()
            number = first[length, batch["shard"].to_numpy()] + batch["number"].to_numpy() - 1
            at = places[np.searchsorted(keys, (length << 48) + number, "right") - 1]
            batch["sequence_id"] = at[:, 2] + number - at[:, 1]
            batch["offset"] = at[:, 3]
            yield batch.drop(columns=["shard", "number"])

    order = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    numbered = part.withColumn("number", F.row_number().over(order).cast("long"))
    placed = numbered.mapInPandas(place, PIECES + ", sequence_id long, offset long")
    # A full piece is a sequence of its own, numbered after the others.
    full = pieces.where(F.col("length") == capacity).select(
        "*", (F.monotonically_increasing_id() + F.lit(sequence)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)
