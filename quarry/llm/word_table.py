"""BPE ids by way of a table of distinct words, and text from ids by a join with the pieces.

For vocabularies whose pre-tokenizer drops white space, what lies between white space is
encoded by itself: the ids of a text are those of its words in order.

1. Texts are split at ASCII white space, in blocks of rows (some 8 MB of text). A block
   keeps its distinct words once and each position as a place among them. A mark after a
   letter is a word of its own, and words of Latin letters count in lower case, as the
   vocabulary sees them; words that could hold a special token are left as they are.
2. The blocks' words are dealt by a hash of the word, so that each distinct word of the whole
   corpus is encoded once, by the library, where its blocks' words meet. A word comes once
   from a block, however often it occurs: no key is hot. A block sends its words of one part
   as one compressed row. The parts grow in number with the words, so that each task holds
   about a million words at most.
3. The ids go back to the places of their block, and from there to every position. Blocks are
   stored in buckets of the block number, so only words and ids are shuffled, never texts.

Decoding joins each id with its piece. The pieces are as many as the model has, whatever
the corpus, so the table is sent to every task and the join is a gather from it.

Edge cases: null and empty texts and texts of white space have no ids and decode to the
empty text; repeated rows are each encoded; a word of any length is one word; ids that the
model doesn't have decode to nothing, null ids to a null text; an empty table gives an
empty result; other columns are carried through, one named `ids` (or `text`, in decoding)
is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, scratch
from .wordids import default_vocabulary

BLOCK_BYTES = 8 << 20
PART_WORDS = 1 << 20
#: Words whose ids a task puts in one batch, and texts that are decoded together.
OUT_WORDS, OUT_TEXTS = 1 << 17, 512
_MARKS = pa.array([".", ",", ";", ":", "!", "?"])
#: A mark that ends a word after one of these is a pre-token of its own.
_LETTERS = pa.array([chr(k) for k in range(256) if chr(k) in "0123456789" or chr(k).isalpha() and chr(k) not in "\u00aa\u00b5\u00ba"])
_LATIN = r"^[\x01-\x7FÀ-ÖØ-öø-ÿ]*$"


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def cut_words(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word as (stem, tail): the tail is a mark at its end or empty, the stem is lower case where that is safe."""
    ends = pc.and_(pc.is_in(pc.utf8_slice_codeunits(words, -1, None), _MARKS), pc.is_in(pc.utf8_slice_codeunits(words, -2, -1), _LETTERS))
    stems = pc.if_else(ends, pc.utf8_slice_codeunits(words, 0, -1), words)
    tails = pc.if_else(ends, pc.utf8_slice_codeunits(words, -1, None), "")
    plain = pc.string_is_ascii(stems)
    other = np.flatnonzero(~np.asarray(plain))
    if len(other):
        mask = np.array(plain)
        mask[other] = np.asarray(pc.match_substring_regex(stems.take(pa.array(other)), _LATIN))
        plain = pa.array(mask)
    plain = pc.and_(plain, pc.invert(pc.match_substring(stems, "<|")))
    return pc.if_else(plain, pc.utf8_lower(stems), stems), tails


def block_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(words of each text, distinct words, the place among them of each word in turn)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = np.diff(np.asarray(split.offsets))
    flat = split.flatten().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    stems, tails = cut_words(flat.dictionary)
    n = len(stems)
    parts = pa.concat_arrays([stems, tails]).dictionary_encode()
    place = np.asarray(parts.indices)
    empty = pc.index(parts.dictionary, "").as_py()  # -1 where there is none
    pairs = np.stack([place[:n], place[n:]], axis=1)
    keep = pairs != empty
    # Each distinct word is one or two places (none if it is empty); positions take them in turn.
    sizes = keep.sum(axis=1)
    at = np.asarray(flat.indices)
    starts = np.cumsum(sizes) - sizes
    places = _gather(pairs[keep], starts, sizes, at)
    per_text = np.add.reduceat(np.r_[sizes[at], 0], np.r_[0, np.cumsum(counts)[:-1]]) if len(counts) else counts
    return np.where(counts > 0, per_text, 0), parts.dictionary, places


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + sizes[k]] for each k of `at`, one after the other."""
    size = sizes[at]
    ends = np.cumsum(size)
    shift = np.repeat(starts[at] - (ends - size), size)
    return values[np.arange(len(shift)) + shift]


def in_blocks(docs: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, rows (the other columns), counts (words a row), words (distinct), places (packed): one row for each block."""
    spark = docs.sparkSession
    others = [f for f in docs.schema.fields if f.name != column]
    made = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(others)]))),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("places", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), np.int64))
            edges = np.unique(np.searchsorted(size, np.arange(block_bytes, (size[-1] if len(size) else 0) + block_bytes, block_bytes), "right"))
            edges = np.unique(np.r_[0, edges, batch.num_rows])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(low, high - low)
                counts, words, places = block_of(part.column(0))
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), rows, pa.array([counts], pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), pa.array([_packed(places, "<u4")], pa.binary())],
                    names=made.names,
                )
                number += 1
            pa.default_memory_pool().release_unused()

    carried = F.struct(*[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)], F.lit(None).cast("int").alias("none"))
    if others:
        carried = carried.dropFields("none")
    blocks = docs.select(F.col(f"`{column}`").cast("string"), carried).mapInArrow(run, made)
    name = f"quarry_word_blocks_{uuid.uuid4().hex}"
    count = partitions(spark)
    (blocks.write.bucketBy(count, "block").option("path", scratch(spark, "word-blocks")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def deal_words(blocks: DataFrame, parts: int) -> DataFrame:
    """part, block, places, words: a block's words by a hash of the word, a row for each part that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words")[k].values
                if not len(words):
                    continue
                part = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % parts).astype(np.int64)
                order = np.argsort(part, kind="stable")
                words, part = words.take(pa.array(order)).to_pylist(), part[order]
                edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)].tolist()
                some = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[edges[:-1]], pa.int32()), pa.array(np.full(len(some), batch.column("block")[k].as_py()), pa.int64()),
                     pa.array([_packed(order[a:b], "<u4") for a, b in some], pa.binary()), pa.array([pack("\n".join(words[a:b]).encode()) for a, b in some], pa.binary())],
                    names=["part", "block", "places", "words"],
                )

    return blocks.select("block", "words").mapInArrow(run, "part int, block long, places binary, words binary").repartitionById(parts, "part")


def encode_words(dealt: DataFrame, vocabulary: str) -> DataFrame:
    """block, places, sizes, ids of dealt words: each distinct word is encoded once, in the task of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, unpack, known = _tokenizer(vocabulary), zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            out = []
            for block, places, raw in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = unpack(raw).split(b"\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                out.append((block, places, _packed(sizes, "<u4"), _packed(np.frombuffer(b"".join(ids), "<u4"), "<u4")))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "places", "sizes", "ids"])

    return dealt.mapInArrow(run, "block long, places binary, sizes binary, ids binary")


def _word_ids(coded: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each place) of a block, from its parts."""
    if not coded:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    places, sizes, ids = (np.concatenate([_unpacked(c[name], "<u4") for c in coded]).astype(np.int64) for name in ("places", "sizes", "ids"))
    order = np.argsort(places)
    return _gather(ids, np.cumsum(sizes) - sizes, sizes, order).astype(np.int32), sizes[order]


def encode(docs: DataFrame, column: str = "text", vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The other columns of `docs` and ids (array<int>), as the tokenizers library gives them without special tokens added."""
    vocabulary = vocabulary or default_vocabulary()
    blocks = in_blocks(docs, column, block_bytes)
    words = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = deal_words(blocks, max(partitions(docs.sparkSession), -(-words // PART_WORDS)))
    # Bounded: a block's distinct words are no more than its text has.
    coded = encode_words(dealt, vocabulary).groupBy("block").agg(F.collect_list(F.struct("places", "sizes", "ids")).alias("coded"))
    joined = blocks.select("block", "rows", "counts", "places").join(coded.hint("merge"), "block", "left")
    row = blocks.schema["rows"].dataType.elementType
    made = T.StructType([T.StructField("row", row), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, counts = batch.column("rows")[k].values, np.asarray(batch.column("counts")[k].values)
                places = _unpacked(batch.column("places")[k].as_py(), "<u4").astype(np.int64)
                values, sizes = _word_ids(batch.column("coded")[k].as_py())
                starts, ends, n = np.cumsum(sizes) - sizes, np.r_[0, np.cumsum(counts, dtype=np.int64)], len(counts)
                edges = np.searchsorted(ends, np.arange(OUT_WORDS, ends[-1] + OUT_WORDS, OUT_WORDS))
                edges = np.unique(np.r_[0, np.minimum(edges, n), n])
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    at = places[ends[low] : ends[high]]
                    ids = _gather(values, starts, sizes, at)
                    offsets = np.r_[0, np.cumsum(sizes[at])][ends[low : high + 1] - ends[low]]
                    yield pa.RecordBatch.from_arrays([rows.slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=made.names)
                pa.default_memory_pool().release_unused()

    others = [f for f in docs.schema.fields if f.name != column]
    out = joined.select("rows", "counts", "places", "coded").mapInArrow(run, made)
    carried = [F.col(f"row.c{k}").alias(f.name) for k, f in enumerate(others) if f.name.lower() != "ids"]
    return out.select(*carried, "ids")


def pieces(vocabulary: str | None = None) -> pa.Array:
    """The piece of every id from 0, null where the model has none."""
    library = _tokenizer(vocabulary or default_vocabulary())
    if library.decoder is not None:
        raise ValueError("pieces are joined by spaces, as for vocabularies without a decoder")
    known = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
    return pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.string())


def decode(frame: DataFrame, column: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """All columns of `frame` and text: the pieces of its ids, special ones too, joined by spaces."""
    table = pieces(vocabulary)
    made = T.StructType([T.StructField("row", frame.select(F.struct(*frame.columns)).schema[0].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, OUT_TEXTS) for b in batches for low in range(0, b.num_rows, OUT_TEXTS)):
            lists = batch.column("ids")
            flat = lists.flatten()
            there = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
            named = table.take(there)
            if named.null_count == 0 and lists.null_count == 0:
                offsets = pc.subtract(lists.offsets, lists.offsets[0])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pc.binary_join(pa.ListArray.from_arrays(offsets, named), " ")], names=made.names)
                continue
            texts, at, held = [], 0, named.to_pylist()
            for size in pc.list_value_length(lists).to_pylist():
                texts.append(None if size is None else " ".join(p for p in held[at : at + size] if p is not None))
                at += size or 0
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=made.names)

    out = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row"), F.col(f"`{column}`").cast("array<int>").alias("ids")).mapInArrow(run, made)
    return out.select(*[F.col(f"row.`{c}`") for c in frame.columns if c.lower() != "text"], "text")
