"""Token ids in bit-plane files: fixed-size blocks, one compressed plane per bit or byte.

A file holds the ids of a run of documents, one document after the other, cut
into blocks of `block` ids. A block is transposed into planes (the n-th bit, or
the n-th byte, of every id) and each plane is compressed by zstandard: the high
planes of a small vocabulary are almost empty. Then come the documents' ids and
token counts, the chunk index (first id, number of ids, offset and plane sizes of
every block) and a fixed-size tail that points to them, so that any block can be
read by itself.

Layout, all numbers little-endian:
    8 bytes        magic
    blocks         planes one after the other, lowest first
    footer         zstandard over: doc ids (int64), presence (uint8), token counts (int64),
                   then one row (int64) per block: first id, ids, offset, planes' sizes
    32 bytes       footer offset, footer length, documents, blocks (int64 each)
    8 bytes        planes, block size (uint32 each)

Edge cases: a null text counts as empty and holds the end id alone; documents
without an id come first; equal ids keep the order of their texts; an empty table
gives no files. Files of lost or repeated task attempts are never named in the
manifest, so they are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_ranges, partitions, scratch, stored
from .wordids import END_ID, default_vocabulary, word_ids

MAGIC = b"BPLANE01"
BLOCK_IDS = 1 << 16
MANIFEST = "range int, path string, documents long, ids long, bytes long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 32 bit planes or 4 byte planes of unsigned 32-bit ids."""
    by_byte = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [plane.tobytes() for plane in by_byte]
    return [np.packbits((plane >> bit) & 1).tobytes() for plane in by_byte for bit in range(8)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    by_byte = np.zeros((4, count), np.uint8)
    if len(planes) == 4:
        for k, plane in enumerate(planes):
            by_byte[k] = np.frombuffer(plane, np.uint8)
    else:
        for k, plane in enumerate(planes):
            by_byte[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count) << (k % 8)
    return np.ascontiguousarray(by_byte.T).view("<u4").reshape(-1)


def open_folder(path: str):
    """The file system and the path in it of a folder given as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class PlaneWriter:
    """Writes one file; ids may be added in pieces of any size."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK_IDS):
        self.stream, self.kind, self.block = stream, kind, block
        self.waiting, self.waits, self.total = [], 0, 0
        self.doc_ids, self.present, self.counts, self.chunks = [], [], [], []
        self.packer = zstandard.ZstdCompressor(level=1)
        self.at = self.stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers of one document."""
        self.doc_ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waits += len(ids) // 4
        if self.waits >= self.block:
            held = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = self.waits // self.block * self.block
            for k in range(0, whole, self.block):
                self._put(held[k : k + self.block])
            self.waiting, self.waits = [held[whole:].tobytes()], self.waits - whole

    def _put(self, ids: np.ndarray) -> None:
        sizes = []
        first, at = self.total, self.at
        for plane in to_planes(ids, self.kind):
            packed = self.packer.compress(plane)
            sizes.append(len(packed))
            self.at += self.stream.write(packed)
        self.total += len(ids)
        self.chunks.append([first, len(ids), at, *sizes])

    def close(self) -> None:
        if self.waits:
            self._put(np.frombuffer(b"".join(self.waiting), "<u4"))
        footer = self.packer.compress(
            np.array(self.doc_ids, "<i8").tobytes() + np.array(self.present, np.uint8).tobytes()
            + np.array(self.counts, "<i8").tobytes() + np.array(self.chunks, "<i8").tobytes()
        )
        self.stream.write(footer)
        self.stream.write(np.array([self.at, len(footer), len(self.doc_ids), len(self.chunks)], "<i8").tobytes())
        self.stream.write(np.array([4 if self.kind == "byte" else 32, self.block], "<u4").tobytes())
        self.at += len(footer) + 40
        self.stream.close()


class PlaneReader:
    """Reads one file: its documents, its chunk index, any block, or all ids in turn."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = self._read(size - 40, 40)
        at, length, documents, chunks = (int(x) for x in np.frombuffer(tail[:32], "<i8"))
        planes, self.block = (int(x) for x in np.frombuffer(tail[32:], "<u4"))
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a bit-plane file")
        self.unpacker = zstandard.ZstdDecompressor()
        raw = self.unpacker.decompress(self._read(at, length), max_output_size=documents * 17 + chunks * 8 * (3 + planes) + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", documents)
        self.present = np.frombuffer(raw, np.uint8, documents, documents * 8).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", documents, documents * 9)
        self.chunks = np.frombuffer(raw, "<i8", chunks * (3 + planes), documents * 17).reshape(chunks, 3 + planes)

    def _read(self, at: int, length: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(length)

    def read_block(self, number: int) -> np.ndarray:
        _, count, at, *sizes = (int(x) for x in self.chunks[number])
        raw, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpacker.decompress(raw[:size], max_output_size=count))
            raw = raw[size:]
        return from_planes(planes, count)

    def read_slice(self, first: int, count: int) -> np.ndarray:
        """Any run of ids, through the chunk index."""
        k = int(np.searchsorted(self.chunks[:, 0], first, "right")) - 1
        parts = []
        while count > 0 and k < len(self.chunks):
            ids = self.read_block(k)
            skip = first - int(self.chunks[k, 0])
            parts.append(ids[skip : skip + count])
            first, count, k = first + len(parts[-1]), count - len(parts[-1]), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Per document: id, first id, number of ids, crc32 of its ids' bytes."""
        held, left, k = b"", 0, 0
        start = 0
        for doc_id, there, count in zip(self.doc_ids, self.present, self.counts, strict=True):
            need, crc = int(count) * 4, 0
            while need:
                if left == len(held):
                    held, left, k = self.read_block(k).tobytes(), 0, k + 1
                take = min(need, len(held) - left)
                crc = zlib.crc32(held[left : left + take], crc)
                left, need = left + take, need - take
            yield (int(doc_id) if there else None), start, int(count), crc
            start += int(count)


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, kind: str = "byte", block: int = BLOCK_IDS) -> DataFrame:
    """Encode `docs` (doc_id, text) and write one file per range of doc_id; returns the manifest."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    count = partitions(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        encode, end, now, out = word_ids(vocabulary), END_ID.to_bytes(4, "little"), None, None

        def finish():
            out.close()
            return pd.DataFrame([[now, path, len(out.counts), out.total, out.at]], columns=["range", "path", "documents", "ids", "bytes"])

        for batch in batches:
            for bucket, doc_id, text in zip(batch["bucket"], batch["doc_id"], batch["text"], strict=True):
                if bucket != now:
                    if out:
                        yield finish()
                    now, path = bucket, f"ids-{bucket + 1:06d}-{uuid.uuid4().hex}.bpl"
                    out = PlaneWriter(files.open_output_stream(f"{base}/{path}"), kind, block)
                out.add(None if pd.isna(doc_id) else int(doc_id), encode.ids(text) + end)
        if out:
            yield finish()

    dealt = (
        id_ranges(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id", count)
        .repartitionById(count, "bucket")
        .sortWithinPartitions("bucket", "doc_id", "text")
    )
    # The manifest is committed by Spark: it names one attempt's file per range.
    return stored(dealt.mapInPandas(write, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add each file's first id among all ids. The manifest has one row per file,
    so this window orders no more rows than there are ranges."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (range order)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_folder(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with files.open_input_file(f"{base}/{path}") as stream:
                    rows = []
                    for doc_id, first, count, crc in PlaneReader(stream).documents():
                        rows.append((doc_id, start + first, count, crc))
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    named = with_starts(manifest).repartitionById(partitions(spark), F.col("range").cast("int"))
    return named.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def round_trip(docs: DataFrame, vocabulary: str | None = None, kind: str = "byte", block: int = BLOCK_IDS) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "bitplanes")
    return read_documents(spark, write_ids(docs, folder, vocabulary, kind, block), folder)
