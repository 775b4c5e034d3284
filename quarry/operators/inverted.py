"""An inverted index in blocks of documents, and BM25 from it.

A block holds some thousand documents as they were read: their ids and lengths, the terms that occur, and for each
term its postings (document, count) with the largest count and the smallest length among them. These two bound
what the term can add to any score of the block, whatever the statistics of the whole corpus become, so blocks
can be written once and searched as more are added. A search adds up a block's postings for all its queries at once;
it passes over a block for a query whose bounds don't reach the k-th best score that its task has found.

Texts are read once, and only counts are written. With `wanted`, terms that no query has are left out before anything
leaves the task that reads the text.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import batches_of, scratch, stored

BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 20
#: Queries that are answered together; more come in several rounds.
BLOCK_QUERIES = 4096
#: Texts that a task's worker gets at once, and hits that it sends at once. Of blocks it gets one at a time.
TEXTS, SENT = 256, 1 << 18
_KEPT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_CELLS = [("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("most", pa.list_(pa.int32())), ("least", pa.list_(pa.int64())),
          ("docs", pa.binary()), ("counts", pa.binary())]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits: what `functions.text.ascii_tokens` gives."""
    return (text or "").lower().encode().translate(_KEPT).split()


class _Block:
    """What a task has read of a block: eight bytes or so a posting."""

    def __init__(self):
        self.ids, self.lengths, self.known = [], [], {}
        self.term, self.tf, self.sizes = array("q"), array("q"), array("q")

    def add(self, id_: object, words: list[bytes], only: frozenset[bytes] | None) -> None:
        found = Counter(words if only is None else [w for w in words if w in only])
        self.ids.append(id_)
        self.lengths.append(len(words))
        self.sizes.append(len(found))
        self.term.extend([self.known.setdefault(w, len(self.known)) for w in found])
        self.tf.extend(found.values())

    def cells(self, kind: pa.DataType) -> list[pa.Array]:
        """ids, lengths and the cells of _CELLS."""
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.array(self.sizes, np.int64))
        names = sorted(self.known)
        place = np.empty(len(names), np.int64)
        place[[self.known[w] for w in names]] = np.arange(len(names))
        order = np.argsort(place[term], kind="stable")
        term, doc, tf = place[term][order], doc[order], tf[order]
        ends = np.searchsorted(term, np.arange(len(names) + 1))
        size = np.array(self.lengths, np.int64)[doc]
        most = np.maximum.reduceat(tf, ends[:-1]) if len(names) else ends[:0]
        least = np.minimum.reduceat(size, ends[:-1]) if len(names) else ends[:0]
        cells = [names, ends.tolist(), most.tolist(), least.tolist(), doc.astype("<u4").tobytes(), tf.astype("<u4").tobytes()]
        return [pa.array([self.ids], pa.list_(kind)), pa.array([self.lengths], pa.list_(pa.int64())), *(pa.array([x], k) for x, (_, k) in zip(cells, _CELLS, strict=True))]


@dataclass
class Index:
    """blocks(ids, lengths, terms, ends, most, least, docs, counts) in files; documents and their mean length."""

    blocks: DataFrame
    documents: int
    mean_length: float


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: frozenset[bytes] | None = None,
          block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Index:
    """Index `docs`. wanted: the only terms to be held. Every row is a document, a null or empty text one without terms."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    sent = spark.sparkContext.broadcast(wanted) if wanted is not None else None
    names = ["ids", "lengths", *(n for n, _ in _CELLS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if sent is None else sent.value
        block, id_kind = _Block(), None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(id_, tokens(value), only)
                if len(block.ids) >= block_docs or len(block.term) >= block_postings:
                    yield pa.RecordBatch.from_arrays(block.cells(id_kind), names=names)
                    block = _Block()
        if block.ids:
            yield pa.RecordBatch.from_arrays(block.cells(id_kind), names=names)

    many = lambda t: T.ArrayType(t)
    made = T.StructType([
        T.StructField("ids", many(kind)), T.StructField("lengths", many(T.LongType())), T.StructField("terms", many(T.BinaryType())),
        T.StructField("ends", many(T.IntegerType())), T.StructField("most", many(T.IntegerType())), T.StructField("least", many(T.LongType())),
        T.StructField("docs", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    path = scratch(spark, "inverted")
    with batches_of(spark, TEXTS):
        docs.select(key, F.col(text).cast("string")).mapInArrow(run, made).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(made).parquet(path)
    sums = blocks.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    return Index(blocks, sums["n"] or 0, (sums["total"] or 0) / max(sums["n"] or 0, 1))


def frequencies(index: Index, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents have each of the terms (at most a block of queries')."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, asked = np.zeros(len(sent.value), np.int64), pa.array(sent.value, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(asked, batch.column("terms")[k].values)
                there = np.flatnonzero(np.asarray(at.is_valid()))
                total[there] += np.diff(np.asarray(batch.column("ends")[k].values))[np.asarray(at.drop_null())]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["term", "df"])

    counted = index.blocks.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    with batches_of(index.blocks.sparkSession, 1):
        return {terms[r["term"]]: r["df"] for r in counted.collect()}


@dataclass
class _Queries:
    """Queries as places in a list of terms, with the terms' weights."""

    terms: list[bytes]
    idf: np.ndarray
    asked: list[np.ndarray]


def _answers(index: Index, queries: _Queries, k: int | None, k1: float, b: float) -> DataFrame:
    """number, id, bm25, shared: all hits, or with k those of each block that may be among the k best."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(queries)
    mean = index.mean_length
    kind = index.blocks.schema["ids"].dataType.elementType

    def sent_on(ids: pa.Array, numbers: list, places: list, scores: list, shared: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(numbers), pa.int32()), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores)), pa.array(np.concatenate(shared), pa.int64())],
            names=["number", "id", "bm25", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        asked = pa.array(q.terms, pa.binary())
        best: list[list[float]] = [[] for _ in q.asked]
        for batch in batches:
            for n in range(batch.num_rows):
                cell = {c: batch.column(c)[n] for c in batch.schema.names}
                ids, lengths, ends = cell["ids"].values, np.asarray(cell["lengths"].values), np.asarray(cell["ends"].values).astype(np.int64)
                at = np.asarray(pc.fill_null(pc.index_in(asked, cell["terms"].values), -1))
                docs, tf = np.frombuffer(cell["docs"].as_py(), "<u4").astype(np.int64), np.frombuffer(cell["counts"].as_py(), "<u4").astype(np.float64)
                part = lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
                weight = part(tf, lengths[docs])
                bound = part(np.asarray(cell["most"].values).astype(np.float64), np.asarray(cell["least"].values)) if k else None
                numbers, places, scores, shared, waiting = [], [], [], [], 0
                for number, mine in enumerate(q.asked):
                    own = at[mine]
                    there = own >= 0
                    own, idf = own[there], q.idf[mine[there]]
                    if not len(own) or (k and len(best[number]) == k and (idf * bound[own]).sum() < best[number][0] - 1e-6):
                        continue
                    sizes = ends[own + 1] - ends[own]
                    rows = np.arange(sizes.sum()) + np.repeat(ends[own] - (np.cumsum(sizes) - sizes), sizes)
                    score = np.bincount(docs[rows], np.repeat(idf, sizes) * weight[rows], len(ids))
                    terms = np.bincount(docs[rows], minlength=len(ids))
                    hit = np.flatnonzero(terms)
                    if k and len(hit) > k:  # with all that rounding may put level with the k-th
                        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k] - 1e-6]
                    if k:
                        best[number] = sorted([*best[number], *score[hit].tolist()])[-k:]
                    numbers.append(np.full(len(hit), number))
                    places.append(hit)
                    scores.append(score[hit])
                    shared.append(terms[hit])
                    waiting += len(hit)
                    if waiting >= SENT:
                        yield sent_on(ids, numbers, places, scores, shared)
                        numbers, places, scores, shared, waiting = [], [], [], [], 0
                if numbers:
                    yield sent_on(ids, numbers, places, scores, shared)

    made = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("id", kind), T.StructField("bm25", T.DoubleType()), T.StructField("shared", T.LongType())])
    return index.blocks.mapInArrow(run, made)


def hits(index: Index, queries: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """item_id, key, bm25 (6 digits), shared (terms that both have), terms (of the query) for queries(item_id, text).

    All documents with a term of a query; with k, at least those that may be among its k best (rank them by bm25, then
    key). Rows that repeat an item_id are one query, of all their terms. The result is a stored table.
    """
    spark = index.blocks.sparkSession
    id_kind = queries.schema["item_id"].dataType
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    dealt = queries.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        mine: dict = {}
        for item, text in dealt.where(F.col("block") == block).drop("block").collect():
            mine.setdefault(item, {}).update(dict.fromkeys(tokens(text)))
        names = sorted({w for words in mine.values() for w in words})
        df = frequencies(index, names)
        place = {w: n for n, w in enumerate(names)}
        idf = np.array([np.log(1 + (index.documents - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) for w in names])
        found = _answers(index, _Queries(names, idf, [np.array([place[w] for w in words], np.int64) for words in mine.values()]), k, k1, b)
        items = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", id_kind), T.StructField("terms", T.IntegerType())])
        named = spark.createDataFrame([(n, item, len(words)) for n, (item, words) in enumerate(mine.items())], items)
        some = found.join(F.broadcast(named), "number").select("item_id", F.col("id").alias(key), F.round("bm25", 6).alias("bm25"), "shared", "terms")
        with batches_of(spark, 1):
            some = stored(some, "hits")
        out = some if out is None else out.unionByName(some)
    return out


def wanted_terms(queries: DataFrame, most: int = 1 << 20) -> frozenset[bytes] | None:
    """The terms of queries(text), or None where they are more than `most`: then an index holds all terms."""
    found = queries.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), 1))).alias("w")).distinct().limit(most + 1).collect()
    return None if len(found) > most else frozenset(r["w"].encode() for r in found)
