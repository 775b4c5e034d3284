"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of paragraph pieces: its lines with what ends them, long lines
cut at sentence ends and at 160 characters; every character is in a piece. Each piece has a 64-bit digest (the n-th repeat of a piece has one of its
own). The sketch has a few cells; a digest is added to three of them, each
holding a count, the xor of digests and the xor of their check hashes. The cells
of two versions subtract; a cell that then holds one digest gives it up, which
frees others ("peeling"), until the differing digests of both sides are known.
If peeling stops early, both versions are sketched again with more cells.

The likeness of two fingerprints is (a + b - d) / (a + b + d) for sets of a and
b digests of which d differ: the Jaccard similarity, exactly.

The next document in doc_id order is found by dealing ranges of doc_id to tasks
and sorting within them; each range is given the first document of the one after
it, so no task holds more than its range and no window spans the table.

Edge cases: null texts count as empty; two empty texts are alike (1.0); equal
doc_ids are ordered by text; rows without doc_id come first; a table of one
document follows itself; very long texts are hashed whole; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_ranges, partitions

CELLS = 24
GROWTH = 4
ROUNDS = 16
PIECE = re.compile(r"[^\n.!?]{1,160}[\n.!?]*|[\n.!?]+")
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, differing_edited long, differing_next long"
)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit finalizer, another one for each k."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[k % 4]
    x = (x ^ (x >> np.uint64(29)) ^ np.uint64(k * 0x51ED27)) * _ODD[(k + 1) % 4]
    return x ^ (x >> np.uint64(32))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The piece digests of all texts, one after the other, and where each text's begin (and the end)."""
    found, ends, hashed = [], [0], xxhash.xxh3_64_intdigest
    for text in texts:
        found += [hashed(piece) for piece in PIECE.findall(text)]
        ends.append(len(found))
    ends = np.array(ends, np.int64)
    made = np.array(found, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    order = np.lexsort((made, owner))
    a, o = made[order], owner[order]
    if len(a):
        new = np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])]
        at = np.arange(len(a))
        repeat = at - np.maximum.accumulate(np.where(new, at, 0))
        made = _mix(a + repeat.astype(np.uint64) * _ODD[3], 2)
    return made, ends


class Cells:
    """Sketches of several sets with the same number of cells."""

    def __init__(self, sets: int, cells: int, round_: int = 0):
        self.third, self.round = max(cells // 3, 2), round_
        self.size = 3 * self.third
        self.count = np.zeros(sets * self.size, np.int64)
        self.key = np.zeros(sets * self.size, np.uint64)
        self.check = np.zeros(sets * self.size, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        check = _mix(keys, 5 * self.round + 7)
        for j in range(3):
            at = owner * self.size + j * self.third + (_mix(keys, 5 * self.round + j) % np.uint64(self.third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and side (1 or -1) of each digest that could be recovered."""
        got = []
        found = True
        while found:
            found = False
            for j in range(3):  # a digest has one cell in each third, so it is met once
                at = np.flatnonzero(np.abs(self.count) == 1)
                at = at[at % self.size // self.third == j]
                at = at[self.check[at] == _mix(self.key[at], 5 * self.round + 7)]
                if len(at):
                    found = True
                    owner, key, side = at // self.size, self.key[at], self.count[at]
                    got.append((owner, key, side))
                    self.add(owner, key, -side)
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def empty(self) -> np.ndarray:
        return ((self.count == 0) & (self.key == 0) & (self.check == 0)).reshape(-1, self.size).all(axis=1)


def _gather(made: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chosen sets and, for each, the place of its set in the choice."""
    sizes = (ends[1:] - ends[:-1])[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return made[np.repeat(ends[which], sizes) + inner], owner


def differences(made: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int = CELLS):
    """For each pair of sets: owner, digest, side of every digest that only one side has."""
    waiting, out, size = np.arange(len(left)), [], cells
    for round_ in range(ROUNDS):
        both = Cells(len(waiting), size, round_)
        for which, sign in ((left, 1), (right, -1)):
            keys, owner = _gather(made, ends, which[waiting])
            both.add(owner, keys, sign)
        owner, key, side = both.peel()
        done = both.empty()
        good = done[owner]
        out.append((waiting[owner[good]], key[good], side[good]))
        waiting = waiting[~done]
        if not len(waiting):
            break
        sizes = ends[1:] - ends[:-1]
        size = min(size * GROWTH, max(3 * int((sizes[left[waiting]] + sizes[right[waiting]]).max()) + 12, size + 12))
    else:
        for k in waiting:  # compared outright after so many tries
            a, b = made[ends[left[k]] : ends[left[k] + 1]], made[ends[right[k]] : ends[right[k] + 1]]
            for key, side in ((np.setdiff1d(a, b), 1), (np.setdiff1d(b, a), -1)):
                out.append((np.full(len(key), k), key, np.full(len(key), side)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprints(made: np.ndarray, ends: np.ndarray, cells: int = CELLS) -> list[str]:
    """The sketch of each set as text: its size, then its cells."""
    keys, owner = _gather(made, ends, np.arange(len(ends) - 1))
    each = Cells(len(ends) - 1, cells)
    each.add(owner, keys, 1)
    sizes = np.diff(ends)
    packed = np.zeros((len(sizes), each.size), [("count", "<u4"), ("key", "<u8"), ("check", "<u4")])
    packed["count"] = each.count.reshape(-1, each.size)
    packed["key"] = each.key.reshape(-1, each.size)
    packed["check"] = (each.check & np.uint64(0xFFFFFFFF)).reshape(-1, each.size)
    return [f"{n}:{b64encode(row.tobytes()).decode()}" for n, row in zip(sizes, packed, strict=True)]


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(ids: list, texts: list[str], cells: int = CELLS) -> pd.DataFrame:
    """Rows for all texts but the last, which only follows."""
    n = len(ids)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    made, ends = digests(texts + changed)
    prints = fingerprints(made, ends, cells)
    sizes, here = np.diff(ends), np.arange(n)
    out = {
        "doc_id": pd.array(ids, dtype="Int64"),
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": prints[:n],
        "edited_fingerprint": prints[n + 1 :],
    }
    for name, other in (("edited", here + n + 1), ("next", here + 1)):
        owner, _, _ = differences(made, ends, here, other, cells)
        d = np.bincount(owner, minlength=n)
        both = sizes[here] + sizes[other]
        out[f"near_{name}"] = np.where(both == 0, 1.0, (both - d) / np.maximum(both + d, 1))
        out[f"differing_{name}"] = d
    return pd.DataFrame(out)[[c.split()[0] for c in RESULT.split(", ")]]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, follows: ranges of doc_id, each with the next range's first document(s)
    (follows = 1); the last range is followed by the first."""
    count = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = id_ranges(texts, "doc_id", count)
    # One row per range.
    firsts = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "first long, to int")
    led = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first")))
    own = dealt.withColumn("follows", F.lit(0))
    return own.unionByName(led.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("follows")))


def fingerprint(docs: DataFrame, cells: int = CELLS, rows: int = 512) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    count = partitions(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, now, ended, chars = [], [], None, False, 0
        for batch in batches:
            for doc_id, text, bucket, follows in zip(batch["doc_id"], batch["text"], batch["bucket"], batch["follows"], strict=True):
                if bucket != now:
                    now, ended, ids, texts, chars = bucket, False, [], [], 0
                if ended:
                    continue  # other copies of the following document
                texts.append(text)
                if follows:
                    ended = True
                if follows or len(texts) > rows or chars > 4_000_000:
                    if ids:
                        yield compare(ids, texts, cells)
                    ids, texts, chars = [], [text], 0
                if not follows:
                    ids.append(None if pd.isna(doc_id) else doc_id)
                    chars += len(text)

    dealt = with_neighbours(docs).repartitionById(count, "bucket").sortWithinPartitions("bucket", "follows", "doc_id", "text")
    return dealt.mapInPandas(run, RESULT)
