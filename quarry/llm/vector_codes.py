"""Vector codes: short codebook indexes in place of vectors, by per-dimension value dictionaries.

Components become integers, floor(scale * x). A block of rows holds, for each dimension,
the dictionary of the distinct integers that occur in it and every row's place in that
dictionary. Vectors are cut into parts with a codebook each. To compare a block with the
codebooks, the squared difference of every distinct integer to every entry is tabulated
once for each dimension; the distances of a part to all entries are then rows gathered
from these tables and added. The sums that move an entry come from counts of (entry,
dictionary place), so no row's components are ever unfolded again.

Spark makes the blocks (an Arrow batch each), writes them once, and in each round adds up
what the blocks count for each entry; the driver holds the codebooks alone, parts x
entries x part width integers, whatever the number of rows. Dictionaries belong to blocks,
so nothing that grows with the data is sent to tasks. All arithmetic is in integers.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped;
vectors shorter than the longest count as filled up with zeros, as does a last part that
is too short; integers beyond 2**27 either way count as that bound, so that distances fit
in 64 bits; codebooks start from the rows of the smallest ids (equal ids by their vectors,
rows without an id last), fewer than `entries` rows give as many entries; repeated rows
are coded each for itself; an empty table gives an empty result; other columns are carried
through, those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_MOST = 1 << 27
_COUNTS = "part int, entry int, place int, total long"


def finite(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is there and wholly finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~odd)


def integers(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row of `width` integers for every list."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.floor(np.asarray(lists.flatten(), np.float64) * scale)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.clip(flat, -_MOST, _MOST).astype(np.int64)
    return out


@dataclass
class Block:
    """values[d]: the distinct integers of dimension d, ascending; codes[d]: each row's place among them."""

    values: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in rows.T]
        small = np.uint16 if len(rows) <= 1 << 16 else np.uint32
        return cls([v for v, _ in found], np.array([c for _, c in found], small).reshape(len(found), len(rows)))

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry (ties to the lower one) and squared distance, for every row."""
        parts, entries, size = books.shape
        rows = self.codes.shape[1]
        best, error = np.zeros((parts, rows), np.int64), np.zeros((parts, rows), np.int64)
        for p in range(parts):
            distance = np.zeros((rows, entries), np.int64)
            for i in range(size):
                d = p * size + i
                table = (self.values[d][:, None] - books[p, :, i]) ** 2
                distance += table[self.codes[d]]
            best[p] = distance.argmin(axis=1)
            error[p] = distance.min(axis=1)
        return best, error

    def counts(self, best: np.ndarray, entries: int) -> Iterator[tuple[int, int, int, int]]:
        """(part, entry, place, total): the sums at each place of the rows of an entry; place -1: their number."""
        size = len(self.values) // len(best)
        for p, chosen in enumerate(best):
            for e, n in enumerate(np.bincount(chosen, minlength=entries)):
                yield p, e, -1, int(n)
            for i in range(size):
                d = p * size + i
                met = len(self.values[d])
                table = np.bincount(chosen * met + self.codes[d], minlength=entries * met).reshape(entries, met)
                for e, total in enumerate(table @ self.values[d]):
                    yield p, e, i, int(total)


def _packed(block: Block) -> dict:
    return {
        "sizes": [len(v) for v in block.values],
        "dictionary": np.concatenate([*block.values, np.zeros(0, np.int64)]).astype("<i4").tobytes(),
        "codes": block.codes.tobytes(),
    }


def _unpacked(sizes, dictionary: bytes, codes: bytes, rows: int) -> Block:
    values = np.split(np.frombuffer(dictionary, "<i4").astype(np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
    kind = np.uint16 if rows <= 1 << 16 else np.uint32
    return Block(values, np.frombuffer(codes, kind).reshape(len(values), rows))


@dataclass
class Codes:
    """Coded vectors: blocks of rows with their dictionaries, and the codebooks (parts, entries, width)."""

    blocks: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """sha256 of all entries' components, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for x in self.books.ravel().tolist()).encode()).hexdigest()


def in_blocks(vectors: DataFrame, column: str, width: int, scale: int) -> DataFrame:
    """rows (the other columns), sizes, dictionary, codes: one row for each block."""
    others = [f for f in vectors.schema.fields if f.name != column]
    made = T.StructType([
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(others)]))),
        T.StructField("n", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("dictionary", T.BinaryType()), T.StructField("codes", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(1))
            cells = _packed(Block.of(integers(batch.column(0), width, scale)))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([batch.num_rows], pa.int32()), pa.array([cells["sizes"]], pa.list_(pa.int32())),
                 pa.array([cells["dictionary"]], pa.binary()), pa.array([cells["codes"]], pa.binary())],
                names=made.names,
            )

    carried = F.struct(*[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)], F.lit(None).cast("int").alias("none"))
    if others:
        carried = carried.dropFields("none")
    return vectors.select(F.col(f"`{column}`").cast("array<double>"), carried).mapInArrow(run, made)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of its parts; unused entries stay."""
    entries = books.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, sizes, dictionary, codes in batch.itertuples(index=False):
                block = _unpacked(sizes, dictionary, codes, n)
                yield pd.DataFrame(list(block.counts(block.nearest(books)[0], entries)), columns=["part", "entry", "place", "total"])

    counted = blocks.select("n", "sizes", "dictionary", "codes").mapInPandas(run, _COUNTS)
    summed = counted.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in summed.collect()}  # parts x entries x (width + 1)
    out = books.copy()
    for (p, e, i), total in totals.items():
        if i >= 0 and totals[p, e, -1]:
            out[p, e, i] = total // totals[p, e, -1]
    return out


def learn(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes | None:
    """Blocks and codebooks of the finite vectors; None where there are none."""
    kept = finite(vectors, column)
    longest = kept.agg(F.max(F.size(column)).alias("n")).first()["n"]
    if longest is None:
        return None
    size = -(-longest // parts)
    first = kept.orderBy(F.col(id_column).asc_nulls_last(), column).select(F.col(column).cast("array<double>")).limit(entries).collect()
    starts = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts * size, scale)
    books = np.ascontiguousarray(starts.reshape(len(starts), parts, size).transpose(1, 0, 2))
    blocks = stored(in_blocks(kept, column, parts * size, scale), "vector-blocks")
    for _ in range(rounds):
        books = moved(blocks, books)
    return Codes(blocks, books)


def encode(codes: Codes, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The other columns of `vectors` with code (two hex digits a part) and error (squared distance over all parts)."""
    others = [f for f in vectors.schema.fields if f.name != column]
    books = codes.books
    made = T.StructType([T.StructField("row", codes.blocks.schema["rows"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{k:02x}" for k in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, sizes, dictionary, coded = (batch.column(c)[k].as_py() for c in ("n", "sizes", "dictionary", "codes"))
                best, error = _unpacked(sizes, dictionary, coded, n).nearest(books)
                code = ["".join(x) for x in digits[best].T]
                yield pa.RecordBatch.from_arrays([batch.column("rows")[k].values, pa.array(code, pa.string()), pa.array(error.sum(axis=0), pa.int64())], names=made.names)

    out = codes.blocks.mapInArrow(run, made)
    carried = [F.col(f"row.c{k}").alias(f.name) for k, f in enumerate(others) if f.name.lower() not in ("code", "error")]
    return out.select(*carried, "code", "error")


def with_group_error(coded: DataFrame, label: str, out: str = "label_error") -> DataFrame:
    """Add the error summed over the rows of an equal label (nulls are equal).

    Labels that hold more than a hundred-thousandth of the rows (fewer than 100,000 labels) are sent to every task, so
    that a label with most of the rows stays spread; the others are joined.
    """
    sums = stored(coded.groupBy(label).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("rows")), "label-sums")
    many = max(1000, (sums.agg(F.sum("rows")).first()[0] or 0) // 100_000)
    total = F.least("sum", F.lit((1 << 63) - 1)).cast("long").alias(out)
    hot, cold = (sums.where(c).select(F.col(label).alias("__label"), total) for c in (F.col("rows") > many, F.col("rows") <= many))
    same = F.col(label).eqNullSafe(F.col("__label"))
    near = coded.join(F.broadcast(hot), same).drop("__label")
    far = coded.join(F.broadcast(hot.select("__label")), same, "left_anti").join(cold, same).drop("__label")
    return near.unionByName(far)


def _oracle() -> str:
    """The same rows from SQL, round after round."""
    distance = "list_sum(list_transform(list_zip({0}.w, {1}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept, range({PARTS}) AS t(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, w AS c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts) WHERE e < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, x.w, b.e, {distance.format('x', 'b')} AS d FROM parts x JOIN b{k} b USING (p))")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(w) AS w, min({{'d': d, 'e': e}}) AS near FROM d{k} GROUP BY vec_id, p)")
        if k < ROUNDS:
            steps.append(
                f"m{k} AS (SELECT p, near.e AS e, i, floor(sum(w[i]) / count(*))::BIGINT AS x FROM a{k}, range(1, 65) AS t(i) WHERE i <= len(w) GROUP BY p, near.e, i)")
            steps.append(f"n{k} AS (SELECT p, e, list(x ORDER BY i) AS c FROM m{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n USING (p, e))")
    last = ROUNDS
    steps.append(
        f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg('0' || substr('0123456789abcdef', near.e + 1, 1), '' ORDER BY p) AS code,"
        f" sum(near.d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})")
    return (
        "WITH " + ",\n".join(steps)
        + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"
    )


ORACLE = _oracle()
