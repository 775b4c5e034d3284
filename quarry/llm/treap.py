"""Ranked lexical search in K2-treaps over the grid of terms and documents.

A shard holds up to `SHARD_DOCS` documents. Its grid has a row for each term (frequent terms
first), a column for each document (by doc_id), and in a cell the impact of the term in the
document. The treap is a quadtree of this grid: a node keeps the largest impact of its square
with that cell's place, which is then taken out of the square; what is left goes to the
node's quadrants. A node holds one posting, so there are as many nodes as postings. Level by
level, the quadrants that exist are four bits a node, impacts are differences to the node
above and places are counted within the square; each of these is compressed by zstandard.

An item asks for several rows. Their paths go down together: a range of documents has, for
each of the item's terms, the square that holds the term's row in it, and cells of the row
met on the way. The weighted sum of their maxima bounds every score of the range. Ranges with
the largest bounds are halved first (some at a time), until no bound reaches the k-th best
document; a range without squares left has exact scores. Nothing is skipped otherwise, so
results are exact, ties included.

Spark cuts the documents into shards where they are read, writes the counts, adds up documents
and lengths, builds a treap in each shard, and searches every shard for a block of items; the
k best of each shard and item meet in a window. A shard's size is bounded in documents and in
postings, and items come in blocks, so no task grows with the corpus; it holds one shard at a
time, however many it reads or writes.

Edge cases: a null text has no terms and doesn't count as a document; rows that repeat a
doc_id are documents of their own; documents without an id are last among equal scores;
terms that no document holds and terms of weight 0 add nothing; rows that repeat an item are
each answered; items without terms, or an empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import batches_of
from .common import scratch, stored

SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Bytes of shards that a writer gathers before it writes them, and texts that a task's worker gets at once. Of shards it gets one at a time.
GROUP_BYTES, TEXTS = 8 << 20, 256
BLOCK_ITEMS = 1024
K = 10
#: Ranges halved at a time.
BATCH = 96
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = "shard long, doc_ids array<long>, lengths array<long>, terms array<binary>, dfs array<int>, cells binary"
_INDEX = "shard long, doc_ids array<long>, terms array<binary>, dfs array<int>, height int, levels array<int>, masks binary, drops binary, places binary"
_BELOW = np.array([[bin(mask & ((1 << q) - 1)).count("1") for q in range(5)] for mask in range(16)], np.int64)


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of digits, letters and all that isn't ASCII; only A-Z in lower case."""
    return text.encode().translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The part of a score that is known before the term's weight."""
    m = 10 + (90 * lengths * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _interleaved(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for bit in range(height):
        out |= (((rows >> bit) & 1).astype(np.int64) << (2 * bit + 1)) | (((columns >> bit) & 1).astype(np.int64) << (2 * bit))
    return out


def _apart(places: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    rows, columns = np.zeros(len(places), np.int32), np.zeros(len(places), np.int32)
    for bit in range(height):
        rows |= (((places >> (2 * bit + 1)) & 1) << bit).astype(np.int32)
        columns |= (((places >> (2 * bit)) & 1) << bit).astype(np.int32)
    return rows, columns


@dataclass
class Treap:
    """Nodes level by level: largest value of the square, its row and column, quadrants that exist, first child."""

    height: int
    levels: list[int]
    masks: np.ndarray
    values: np.ndarray
    rows: np.ndarray
    columns: np.ndarray

    def __post_init__(self):
        kids = _BELOW[self.masks, 4]
        self.first = 1 + np.cumsum(kids) - kids

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> Treap:
        place = _interleaved(rows, columns, height)
        order = np.argsort(place, kind="stable")
        place, value = place[order], values[order]
        levels, masks, tops, places, above = [], [], [], [], None
        for level in range(height + 1):
            if not len(place):
                break
            square = place >> 2 * (height - level)
            new = np.r_[True, square[1:] != square[:-1]]
            group = np.cumsum(new) - 1
            most = np.maximum.reduceat(value, np.flatnonzero(new))
            met = np.flatnonzero(value == most[group])
            chosen = met[np.r_[True, group[met][1:] != group[met][:-1]]]
            key = square[chosen]
            if above is not None:
                np.add.at(masks[-1], np.searchsorted(above, key >> 2), (1 << (key & 3)).astype(np.uint8))
            levels.append(len(chosen))
            masks.append(np.zeros(len(chosen), np.uint8))
            tops.append(most)
            places.append(place[chosen])
            left = np.ones(len(place), bool)
            left[chosen] = False
            place, value, above = place[left], value[left], key
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        return cls(height, levels, join(masks, np.uint8), join(tops, np.int64), *_apart(join(places, np.int64), height))

    def _parents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.masks)), _BELOW[self.masks, 4])

    def packed(self) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        drops = np.r_[self.values[:1], self.values[self._parents()] - self.values[1:]]  # the first is the root's value itself
        bits = np.repeat(self.height - np.arange(len(self.levels)), self.levels)
        within = _interleaved(self.rows & ((1 << bits) - 1), self.columns & ((1 << bits) - 1), self.height)
        by_byte = lambda x, kind, n: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, n).T).tobytes()
        nibbles = np.r_[self.masks, np.zeros(len(self.masks) % 2, np.uint8)].reshape(-1, 2)
        return {
            "height": self.height, "levels": self.levels, "masks": pack((nibbles[:, 0] | nibbles[:, 1] << 4).tobytes()),
            "drops": pack(by_byte(drops, "<u4", 4)), "places": pack(by_byte(within, "<u8", 8)),
        }

    @classmethod
    def unpacked(cls, height: int, levels, masks: bytes, drops: bytes, places: bytes) -> Treap:
        unpack = zstandard.ZstdDecompressor().decompress
        count = int(sum(levels))
        plane = lambda raw, kind, n: np.ascontiguousarray(np.frombuffer(unpack(raw), np.uint8).reshape(n, -1).T).view(kind).reshape(-1).astype(np.int64)
        nibbles = np.frombuffer(unpack(masks), np.uint8)
        mask = np.stack([nibbles & 15, nibbles >> 4], axis=1).reshape(-1)[:count]
        values, place = plane(drops, "<u4", 4), plane(places, "<u8", 8)
        out = cls(height, list(levels), mask, values, place, place)
        # Each level gets its values and squares from the one above.
        square, low = np.zeros(count, np.int64), 0
        for level, n in enumerate(levels):
            high = low + n
            if level:
                before = slice(low - levels[level - 1], low)
                kids = _BELOW[mask[before], 4]
                parent = np.repeat(np.arange(before.start, before.stop), kids)
                quadrant = (mask[before, None] >> np.arange(4) & 1).nonzero()[1]
                square[low:high] = square[parent] << 2 | quadrant
                values[low:high] = values[parent] - values[low:high]
            low = high
        shift = np.repeat(2 * (height - np.arange(len(levels))), levels)
        out.values = values
        out.rows, out.columns = _apart(square << shift | place, height)
        return out


class _Held:
    """What ranges hold: rows of (term, node or -1 for a cell of the term's row, column, value), kept by offset."""

    def __init__(self):
        self.rows, self.size = np.zeros((4, 1024), np.int64), 0

    def add(self, *columns: np.ndarray) -> int:
        offset, self.size = self.size, self.size + len(columns[0])
        if self.size > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros((4, self.size), np.int64)], axis=1)
        self.rows[:, offset : self.size] = columns
        return offset

    def take(self, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the range, its rows) for each of the ranges."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return owner, self.rows[:, np.arange(len(owner)) + np.repeat(offsets - (np.cumsum(sizes) - sizes), sizes)]


class _Best:
    """The k best documents so far, as (-score, column), and the score that another needs."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.found = k, least, []

    def useful(self, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ranges that may hold one of the best: those that can only tie must start before the last of them."""
        if len(self.found) < self.k or -self.found[-1][0] < self.least:
            return bounds >= self.least
        return (bounds > self.least) | ((bounds == self.least) & (starts < self.found[-1][1]))

    def add(self, columns: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(columns, kind="stable")
        columns, parts = columns[order], parts[order]
        new = np.flatnonzero(np.r_[True, columns[1:] != columns[:-1]])
        scores = np.add.reduceat(parts, new)
        good = scores >= self.least
        if good.any():
            self.found = sorted([*self.found, *zip((-scores[good]).tolist(), columns[new][good].tolist(), strict=True)])[: self.k]
            if len(self.found) == self.k:
                self.least = max(self.least, -self.found[-1][0])


def best_columns(treap: Treap, rows: np.ndarray, weights: np.ndarray, k: int = K, least: int = 1, batch: int = BATCH) -> list[tuple[int, int]]:
    """The k best (score, column) of the weighted rows with a score of `least` or more: by score, then lower columns."""
    terms, height, best, held = len(rows), treap.height, _Best(k, least), _Held()
    if not terms or not len(treap.masks):
        return []
    met = np.flatnonzero(rows == treap.rows[0])
    whole = np.arange(terms)
    held.add(np.r_[whole, met], np.r_[0 * whole, 0 * met - 1], np.full(terms + len(met), treap.columns[0]), np.full(terms + len(met), treap.values[0]))
    # Ranges: bound, first column, level, offset and number of what they hold.
    ranges = np.array([[int(weights.sum()) * int(treap.values[0])], [0], [0], [0], [held.size]])
    while True:
        ranges = ranges[:, best.useful(ranges[0], ranges[1])]
        if not ranges.shape[1]:
            return [(-s, c) for s, c in best.found]
        if ranges.shape[1] > batch:
            part = np.argpartition(-ranges[0], batch)
            now, ranges = ranges[:, part[:batch]], ranges[:, part[batch:]]
        else:
            now, ranges = ranges, ranges[:, :0]
        owner, (t, n, c, v) = held.take(now[3], now[4])
        bit = height - 1 - now[2][owner]
        cell = n < 0
        new = [(2 * owner[cell] + ((c[cell] >> bit[cell]) & 1), t[cell], n[cell], c[cell], v[cell])]
        t, n, owner, bit = t[~cell], n[~cell], owner[~cell], bit[~cell]
        mask, first, upper = treap.masks[n], treap.first[n], 2 * ((rows[t] >> bit) & 1)
        for half in (0, 1):
            quadrant = upper + half
            there = (mask >> quadrant & 1) > 0
            child = first[there] + _BELOW[mask[there], quadrant[there]]
            own, side = t[there], 2 * owner[there] + half
            for some, node in ((treap.rows[child] == rows[own], None), (treap.masks[child] > 0, child)):
                kept = child[some]
                new.append((side[some], own[some], np.full(len(kept), -1) if node is None else kept, treap.columns[kept], treap.values[kept]))
        o, t, n, c, v = (np.concatenate(x) for x in zip(*new, strict=True))
        alive = np.zeros(2 * now.shape[1], bool)
        alive[o[n >= 0]] = True
        ended = ~alive[o]  # nothing but cells: exact
        if ended.any():
            best.add(c[ended], weights[t[ended]] * v[ended])
        going = np.flatnonzero(~ended)
        if not len(going):
            continue
        going = going[np.argsort(o[going], kind="stable")]
        o, t, n, c, v = o[going], t[going], n[going], c[going], v[going]
        most = np.zeros(2 * now.shape[1] * terms, np.int64)
        np.maximum.at(most, o * terms + t, v)
        starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        named = o[starts]
        level = now[2][named // 2] + 1
        made = np.array([
            (most.reshape(-1, terms) @ weights)[named], now[1][named // 2] + ((named & 1) << (height - level)), level,
            starts + held.add(t, n, c, v), np.diff(np.r_[starts, len(o)]),
        ])
        ranges = np.concatenate([ranges, made], axis=1)


def count_terms(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row for each shard of documents with terms: their ids and lengths, the terms, and (term, document, count) of each posting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, known, docs, ids, counts, sizes = TaskContext.get().partitionId() << 32, {}, [], array("i"), array("i"), []

        def shard() -> pd.DataFrame:
            nonlocal number
            order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
            column = np.empty(len(docs), np.int64)
            column[order] = np.arange(len(docs))
            term = np.array(ids, np.int32)
            df = np.bincount(term, minlength=len(known))
            by_df = np.argsort(-df, kind="stable")
            row = np.empty(len(known), np.uint32)
            row[by_df] = np.arange(len(known))
            names = list(known)
            cells = np.concatenate([row[term], np.repeat(column.astype("<u4"), sizes), np.array(counts, "<u4")]).tobytes()
            out = pd.DataFrame([[number, [docs[k][0] for k in order], [docs[k][1] for k in order], [names[k] for k in by_df], df[by_df].tolist(), cells]],
                               columns=["shard", "doc_ids", "lengths", "terms", "dfs", "cells"])
            number += 1
            for x in (known, docs, sizes):
                x.clear()
            del ids[:], counts[:]
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                met = Counter(terms_of(text or ""))
                if not met:
                    continue
                docs.append((None if doc_id is None or doc_id != doc_id or doc_id is pd.NA else int(doc_id), met.total()))
                ids.extend([known.setdefault(term, len(known)) for term in met])
                counts.extend(met.values())
                sizes.append(len(met))
                if len(docs) >= shard_docs or len(ids) >= shard_postings:
                    yield shard()
        if docs:
            yield shard()

    # Ids travel as text: a column of integers with nulls would become floats.
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, _COUNTS)


@dataclass
class Index:
    """Shards with their treaps, and how many documents with terms and terms with repeats there are."""

    shards: DataFrame
    documents: int
    total: int


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> Index:
    """The index of `docs` (doc_id, text), written to the shared folder."""
    spark = docs.sparkSession

    def written(frame: DataFrame, name: str, rows: int) -> DataFrame:
        path = scratch(spark, name)
        # A row is a shard, of megabytes: the writer looks at its buffer's size after each row, not after 100.
        out = frame.write.options(**{"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1})
        with batches_of(spark, rows):
            out.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    counted = written(count_terms(docs, shard_docs, shard_postings), "term-counts", TEXTS)
    sums = counted.agg(F.sum(F.size("doc_ids")).alias("documents"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    documents, total = sums["documents"] or 0, sums["total"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                term, column, tf = np.frombuffer(row.column("cells")[0].as_py(), "<u4").astype(np.int64).reshape(3, -1)
                lengths = np.asarray(row.column("lengths")[0].values)
                side = max(len(row.column("terms")[0].values), len(lengths))
                treap = Treap.of(term, column, impacts(tf, lengths[column], documents, total), (side - 1).bit_length())
                cells = treap.packed()
                yield pa.RecordBatch.from_arrays(
                    [row.column(c) for c in ("shard", "doc_ids", "terms", "dfs")]
                    + [pa.array([cells["height"]], pa.int32()), pa.array([cells["levels"]], pa.list_(pa.int32()))]
                    + [pa.array([cells[c]], pa.binary()) for c in ("masks", "drops", "places")],
                    names=["shard", "doc_ids", "terms", "dfs", "height", "levels", "masks", "drops", "places"],
                )

    return Index(written(counted.mapInArrow(run, _INDEX), "treaps", 1), documents, total)


def _answer(index: Index, items: list[tuple], k: int) -> DataFrame:
    """search() for a block of items."""
    spark = index.shards.sparkSession
    asked = [list(dict.fromkeys(terms_of(text or ""))) for _, text in items]
    terms = sorted({t for a in asked for t in a})
    sent = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total, wanted = np.zeros(len(sent.value), np.int64), pa.array(sent.value, pa.binary())
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), wanted)
            there = np.asarray(at.is_valid())
            np.add.at(total, np.asarray(at.drop_null()), np.asarray(batch.column("dfs").flatten())[there])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["term", "df"])

    # At most one row for each term of the block reaches the driver.
    with batches_of(spark, 1):
        counts = index.shards.select("terms", "dfs").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = {terms[r["term"]]: w for r in counts if (w := weight(index.documents, r["df"]))}
    queries = [[(t, weights[t]) for t in a if t in weights] for a in asked]
    queries_sent = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = queries_sent.value
        wanted = pa.array(sent.value, pa.binary())
        place = {t: i for i, t in enumerate(sent.value)}
        # A document that scores less than this task's k-th best of an item can't be one of the k best of all.
        found: list[list[int]] = [[] for _ in queries]
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                doc_ids = row.column("doc_ids")[0].values
                at = pc.index_in(wanted, row.column("terms")[0].values).to_pylist()
                treap = Treap.unpacked(row.column("height")[0].as_py(), row.column("levels")[0].as_py(), *(row.column(c)[0].as_py() for c in ("masks", "drops", "places")))
                numbers, columns, scores = [], [], []
                for number, query in enumerate(queries):
                    here = [(at[place[t]], w) for t, w in query if at[place[t]] is not None]
                    if not here:
                        continue
                    rows, ws = np.array(here, np.int64).T
                    least = found[number][-1] if len(found[number]) == k else 1
                    for score, column in best_columns(treap, np.ascontiguousarray(rows), np.ascontiguousarray(ws), k, least):
                        numbers.append(number)
                        columns.append(column)
                        scores.append(score)
                        found[number] = sorted([*found[number], score], reverse=True)[:k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int32()), doc_ids.take(pa.array(columns, pa.int64())), pa.array(scores, pa.int64())], names=["number", "doc_id", "score"])

    each = index.shards.select("doc_ids", "terms", "height", "levels", "masks", "drops", "places").mapInArrow(run, "number int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "number int, item_id long")
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    with batches_of(spark, 1):
        return stored(best.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"), "best")


def search(index: Index, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's (item_id, text) k best documents with a score above 0."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = -(-items.count() // block_items)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    out = index.shards.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        some = dealt.where(F.col("block") == b).drop("block").collect() if blocks > 1 else items.collect()
        if some and index.documents:
            out = out.unionByName(_answer(index, [tuple(r) for r in some], k))
    return out


#: The same rows from SQL, every posting of an item's terms scored.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, terms, len(terms) AS n FROM split WHERE len(terms) > 0),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sums GROUP BY term, docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
