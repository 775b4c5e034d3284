"""Merkle fixity audit of WARC replicas.

Archives are .warc.gz files, one gzip member per record, with an index of each
record's offset and length. For every replica, each record's stored bytes are
hashed; the hashes of up to FANOUT ordered offset ranges give the hash of the range
that spans them, up to one root per file and on to one root of all files. Each level
is a table. Two replicas are compared from the root down: of the next level only the
children of nodes that differ are joined, and with equal roots no other level is read.
What is left at the leaves are the records that are changed, cut off or missing.

Files are written and read by tasks of their own through the file system that their
path names; a record is held in memory, never a file. The levels of the trees are
grouped sums of at most FANOUT children.

Edge cases: null urls and html are written as empty; a null page_id sorts first and
is kept as null; a replica's missing file has only missing records; records beyond
the index (an appended tail) show in the file's length leaf as `extra`; equal rows
are records of their own; an empty table has no files and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplane import open_folder
from .common import partitions, scratch, stored

FANOUT = 16
RECORDS_PER_FILE = 500
INDEX = "file_no long, path string, record_no long, page_id long, url string, offset long, length long"
LEAVES = "file_no long, record_no long, digest string, kind string"


def record(page_id: int | None, url: str, html: str) -> bytes:
    """A response record."""
    body = html.encode("utf-8", "surrogatepass")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}")
    head = (
        "WARC/1.0\r\nWARC-Type: response\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {url}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, folder: str, files: int) -> DataFrame:
    """Write pages as archives; returns the index. `files`: how many, dealt by a hash of id and url."""
    count = partitions(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        now, out, rows, at = None, None, [], 0

        def index():
            return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})

        for batch in batches:
            for file_no, page_id, url, raw in zip(batch["file_no"], batch["page_id"], batch["url"], batch["raw"], strict=True):
                if file_no != now:
                    if out:
                        out.close()
                        yield index()
                    now, path, rows, at = file_no, f"pages-{file_no:06d}-{uuid.uuid4().hex}.warc.gz", [], 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                page_id = None if pd.isna(page_id) else int(page_id)
                out.write(raw)
                rows.append((file_no, path, len(rows) + 1, page_id, url, at, len(raw)))
                at += len(raw)
        if out:
            out.close()
            yield index()

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            batch["raw"] = [record(*x) for x in zip(ids, batch["url"], batch["html"], strict=True)]
            batch["page_id"] = batch["page_id"].astype("Int64")
            yield batch[["file_no", "page_id", "url", "raw"]]

    # Records are compressed before they are dealt to files.
    made = with_files(pages, files).mapInPandas(compress, "file_no long, page_id long, url string, raw binary")
    dealt = made.repartitionById(count, (F.col("file_no") % count).cast("int")).sortWithinPartitions("file_no", "page_id", "url", "raw")
    return stored(dealt.mapInPandas(write, INDEX), "warc-index")


def with_files(pages: DataFrame, files: int) -> DataFrame:
    text = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % files
    return pages.select(
        number.alias("file_no"), F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """Digest of each indexed record's bytes as this replica stores them (null: it ends before)."""
    count = partitions(index.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        now, stream, size, end = None, None, -1, 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.file_no != now:
                    if now is not None:
                        rows.append(_tail(now, size, end))
                    now, end = r.file_no, 0
                    if stream:
                        stream.close()
                    try:
                        stream = store.open_input_file(f"{base}/{r.path}")
                        size = stream.size()
                    except FileNotFoundError:
                        stream, size = None, -1
                end = r.offset + r.length
                if end > size:
                    rows.append((r.file_no, r.record_no, "", "record"))
                    continue
                stream.seek(r.offset)
                rows.append((r.file_no, r.record_no, hashlib.sha256(stream.read(r.length)).hexdigest(), "record"))
            yield pd.DataFrame(rows, columns=["file_no", "record_no", "digest", "kind"])
        if now is not None:
            yield pd.DataFrame([_tail(now, size, end)], columns=["file_no", "record_no", "digest", "kind"])
            if stream:
                stream.close()

    dealt = index.select("file_no", "path", "record_no", "offset", "length").repartitionById(count, (F.col("file_no") % count).cast("int")).sortWithinPartitions("file_no", "offset")
    return dealt.mapInPandas(read, LEAVES)


def _tail(file_no: int, size: int, end: int) -> tuple:
    """A last leaf for what lies after the indexed records."""
    return (file_no, 0, "" if size <= end else str(size - end), "tail")


@dataclass
class Tree:
    """The levels of a tree, the leaves first, the root last: file_no, number, digest of each node.

    A node's number is its place in its level: within its file below `roots`, the level of the files'
    roots, and among all nodes (file_no -1) from there on.
    """

    levels: list[DataFrame]
    roots: int


def tree(leaf_rows: DataFrame, fanout: int = FANOUT) -> Tree:
    levels, roots = [stored(leaf_rows.select("file_no", F.col("record_no").alias("number"), "digest"), "nodes")], None
    while True:
        nodes = levels[-1]
        most = nodes.agg(F.max("number")).first()[0] or 0
        if not most and roots is not None:
            return Tree(levels, roots)
        if not most:  # one node per file: on to groups of files
            roots = len(levels)
            levels.append(nodes.select(F.lit(-1).cast("long").alias("file_no"), F.col("file_no").alias("number"), "digest"))
            continue
        kids = F.transform(F.sort_array(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"])
        up = nodes.groupBy("file_no", F.floor(F.col("number") / fanout).cast("long").alias("number"))
        levels.append(stored(up.agg(F.sha2(F.concat_ws("|", kids), 256).alias("digest")), "nodes"))


def audit(index: DataFrame, folder: str, replica: str, fanout: int = FANOUT) -> DataFrame:
    """Indexed records whose bytes differ between two replicas of the archives."""
    return differing(index, tree(leaves(index, folder), fanout), tree(leaves(index, replica), fanout), fanout)


def differing(index: DataFrame, one: Tree, two: Tree, fanout: int = FANOUT) -> DataFrame:
    """The records below the nodes that differ between two trees of an index, found from the roots down."""
    kin = None
    for level in range(len(one.levels) - 1, -1, -1):
        sides = [one.levels[level], two.levels[level]]
        if kin is not None:  # children of nodes that differ
            if level == one.roots - 1:
                parent = [F.lit(-1).cast("long").alias("home"), F.col("file_no").alias("up")]
            else:
                parent = [F.col("file_no").alias("home"), F.floor(F.col("number") / fanout).cast("long").alias("up")]
            sides = [nodes.select("*", *parent).join(kin, ["home", "up"], "left_semi").drop("home", "up") for nodes in sides]
        a, b = (x.withColumnRenamed("digest", name) for x, name in zip(sides, ("first", "second"), strict=True))
        differ = stored(a.join(b, ["file_no", "number"], "full").where(~F.col("first").eqNullSafe(F.col("second"))), "differing")
        if not differ.limit(1).count():
            return index.where(F.lit(False)).select("file_no", "record_no", "page_id", "url", "offset", "length", F.lit("").alias("kind"))
        kin = differ.select(F.col("file_no").alias("home"), F.col("number").alias("up"))
    second, first = F.coalesce("second", F.lit("")), F.coalesce("first", F.lit(""))
    kind = F.when(F.col("number") == 0, "extra").when(second == "", "missing").when(first == "", "restored").otherwise("changed")
    found = differ.select("file_no", F.col("number").alias("record_no"), kind.alias("kind"))
    return found.join(index.drop("path"), ["file_no", "record_no"], "left").select(
        "file_no", "record_no", "page_id", "url", "offset", "length", "kind"
    )


def rotted_copy(index: DataFrame, folder: str, replica: str, flips: Column, cuts: Column) -> None:
    """Copy the archives with damage: one bit of each record that `flips` names, and the last
    record of each file that `cuts` names cut off."""
    count = partitions(index.sparkSession)

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        _, target = open_folder(replica)
        store.create_dir(target, recursive=True)
        now, source, out, held = None, None, None, b""

        def finish(cut):
            if out:
                if not cut:
                    out.write(held)
                out.close()
                source.close()

        cut = False
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.file_no != now:
                    finish(cut)
                    now, held = r.file_no, b""
                    source, out = store.open_input_file(f"{base}/{r.path}"), store.open_output_stream(f"{target}/{r.path}", compression=None)
                out.write(held)
                source.seek(r.offset)
                held, cut = source.read(r.length), r.cut
                if r.flip:
                    k = len(held) // 2
                    held = held[:k] + bytes([held[k] ^ 1]) + held[k + 1 :]
            yield pd.DataFrame({"copied": [len(batch)]})
        finish(cut)

    rows = index.select("file_no", "path", "offset", "length", flips.alias("flip"), cuts.alias("cut"))
    dealt = rows.repartitionById(count, (F.col("file_no") % count).cast("int")).sortWithinPartitions("file_no", "offset")
    stored(dealt.mapInPandas(copy, "copied long"), "copied")


def audit_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of the pages, a damaged replica of them, and what the audit finds."""
    first, second = scratch(spark, "archives"), scratch(spark, "replica")
    files = max(1, -(-pages.count() // RECORDS_PER_FILE))
    index = write_archives(pages, first, files)
    rotted_copy(index, first, second, F.coalesce(F.col("page_id") % 53 == 5, F.lit(False)), F.col("file_no") % 3 == 1)
    return audit(index, first, second)


#: The records that the replica's damage names, with their places.
ORACLE = """
WITH sized AS (SELECT greatest(1, -(-count(*) // 500)) AS files FROM pages),
placed AS (
  SELECT page_id, coalesce(url, '') AS url,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')), 1, 8))::BIGINT % files AS file_no, html
  FROM pages, sized),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY page_id, url, html) AS record_no,
         count(*) OVER (PARTITION BY file_no) AS records FROM placed)
SELECT file_no::BIGINT AS file_no, record_no::BIGINT AS record_no, page_id, url,
       CASE WHEN file_no % 3 = 1 AND record_no = records THEN 'missing' ELSE 'changed' END AS kind
FROM numbered WHERE (file_no % 3 = 1 AND record_no = records) OR page_id % 53 = 5
"""
