"""Similarity self-join of word-shingle sets, with the connected components of its links.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold. Exact, at any size of groups:

1. Copies (equal sets) are one class; only one document of each is joined.
2. Answers by set relations: sets that share two of their four least shingle hashes
   are likely alike, so each first meets the most typical set of such a group, its
   leader, alone. A group of near copies costs one comparison each. From these answers
   others follow: sets in one component need no comparison, and as 1 - Jaccard is a
   metric, sets whose distances to one leader differ by more than 1 - t can't link.
3. Shingles are ordered rare first, by a table of counts over all documents, then by
   hash. Two sets that link share a shingle among the first n - ceil(t n) + 1 of each
   (prefix filter). Index lists hold (set, size, position) by shingle, for shingles in
   the prefixes of two components; others can't tell anything new.
4. A set at a position reaches partners of a bounded size only (what is left of it
   must hold the overlap). Lists are blocks by size; a set visits the blocks between
   its least possible partner and its reach there, and skips the others whole; only
   positions that reach the set's own size are indexed. What meets is compared exactly.
5. Components come from repeated minimum labels with pointer jumping.

Nothing grows with the square of a group of copies or near copies. Tables that grow
with the input are never broadcast; bitmaps, labels and the table of counts are only
up to a fixed size, and shuffled or made coarser beyond it.

Edge cases: null or empty text has no shingles and links with nothing; with fewer
words than a shingle has, the whole sequence is one; rows that share a doc_id share
a component, each with its own links; a null doc_id has no component (null); very
long texts are hashed whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import having, stored

MAX_SLOTS = 1 << 23
CHUNK = 1 << 14
FAN_IN = 64
STARS = 2
MARKS = 4
SIZES = 1
BYTES = 1_000_000
SENT_LABELS = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and where each begins."""
    joined = "\n".join(t if isinstance(t, str) else "" for t in texts) + "\n"
    data = _LOWER[np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)]
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    n_texts = len(texts)
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    # A word's hash: its bytes times powers of an odd number, by place in the word.
    sizes = np.flatnonzero(space & np.r_[False, ~space[:-1]]) - begins
    inside = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD[2]))
    words = _mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first) + sizes.astype(np.uint64))
    bytes_of = np.array([len(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) and not t.isascii() else len(t) if isinstance(t, str) else 0 for t in texts])
    ends = np.cumsum(bytes_of + 1)
    owner = np.searchsorted(ends, begins, "right")
    count = np.bincount(owner, minlength=n_texts)
    start = np.cumsum(count) - count
    # Shingles begin at every word that has enough words of its text after it; a short text is one.
    left = np.repeat(start + count, count) - np.arange(len(words))
    padded = np.r_[words, np.zeros(width, np.uint64)]
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total += np.where(left > k, padded[k : k + len(words)] * _ODD[k % 5] + np.uint64(k), np.uint64(0))
        if k % 5 == 4:
            total = _mix(total)
    whole = (left >= width) | (np.arange(len(words)) == np.repeat(start, count))
    hashed, of = _mix(total)[whole], owner[whole]
    order = np.lexsort((hashed, of))
    hashed, of = hashed[order], of[order]
    new = np.r_[True, (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])]
    return hashed[new], np.r_[0, np.cumsum(np.bincount(of[new], minlength=n_texts))]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of a few megabytes of text."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).to_numpy().cumsum() // BYTES
        for k in np.unique(size):
            yield batch[size == k].reset_index(drop=True)


def shingle_rarity(docs: DataFrame, width: int, slots: int) -> np.ndarray:
    """A class for each slot of a table by how many of all documents' shingles fall in it: one later for every factor of the root of two."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(slots, np.uint32)
        for batch in _batches(batches):
            hashed, _ = shingle_sets(list(batch["text"]), width)
            np.add.at(table, (hashed % np.uint64(slots)).astype(np.int64), 1)
        if table.any():
            task = TaskContext.get().partitionId()
            yield pd.DataFrame([(task, at, _packed(table[at : at + CHUNK])) for at in range(0, slots, CHUNK)], columns=["grp", "chunk", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_unpacked(x) for x in pdf["counts"])
        return pd.DataFrame({"grp": [pdf["grp"][0] // FAN_IN], "chunk": [pdf["chunk"][0]], "counts": [_packed(total)]})

    shape = "grp long, chunk int, counts binary"
    # A group holds FAN_IN arrays of CHUNK slots at most; the groups are added again until one is left.
    parts, more = docs.select("text").mapInPandas(count, shape), True
    while more:
        up = F.floor(F.col("grp") / FAN_IN).alias("up")
        parts = stored(parts.groupBy(up, "chunk").applyInPandas(add, shape), "slot-counts")
        more = parts.where("grp > 0").limit(1).count()
    out = np.zeros(slots, np.uint8)
    for r in parts.collect():
        out[r["chunk"] : r["chunk"] + CHUNK] = np.log2(_unpacked(r["counts"]) + 1.0) * 2
    return out


def _packed(x: np.ndarray) -> bytes:
    import zlib

    kind = "<u2" if x.max(initial=0) < 1 << 16 else "<i8"
    return kind[1:].encode() + zlib.compress(x.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(raw[2:]), "<" + raw[:2].decode()).astype(np.int64)


def profiles(docs: DataFrame, width: int, per_cent: int, rarity: np.ndarray, *carried: str) -> DataFrame:
    """Per document: n_shingles, a key that equal sets share, how typical its shingles are, its least hashes, its prefix."""
    slots = len(rarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(batches):
            hashed, ends = shingle_sets(list(batch["text"]), width)
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(batch)), sizes)
            common = rarity[(hashed % np.uint64(slots)).astype(np.int64)]
            order = np.lexsort((hashed, common, owner))
            ordered = hashed[order]
            cum1, cum2 = np.r_[np.uint64(0), np.cumsum(_mix(hashed))], np.r_[np.uint64(0), np.cumsum(_mix(hashed ^ _ODD[3]))]
            typical = np.bincount(owner, common, len(batch)) / np.maximum(sizes, 1)
            prefix = sizes - -(-per_cent * sizes // 100) + 1
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n": sizes,
                "key1": (cum1[ends[1:]] - cum1[ends[:-1]]).view(np.int64), "key2": (cum2[ends[1:]] - cum2[ends[:-1]]).view(np.int64),
                "typical": typical, "marks": [hashed[b : min(b + MARKS, e)].view(np.int64) for b, e in zip(ends[:-1], ends[1:], strict=True)],
                "prefix": [ordered[b : b + p if e > b else b].view(np.int64) for b, e, p in zip(ends[:-1], ends[1:], prefix, strict=True)],
                **{c: batch[c] for c in carried},
            })

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInPandas(
        run, "doc_id long, n long, key1 long, key2 long, typical double, marks array<long>, prefix array<long>" + "".join(f", {c} long" for c in carried)
    )


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(batches):
            hashed, ends = shingle_sets(list(batch["text"]), width)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "shingles": [hashed[b:e].view(np.int64) for b, e in zip(ends[:-1], ends[1:], strict=True)]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id) of every id on an edge (a, b)."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        roots = labels.select(F.col("id").alias("to"), F.col("component").alias("root"))
        new = stored(lower.join(roots, "to").select("id", F.least("to", "root").alias("component"), "was"), "labels")
        changed = new.where(F.col("component") != F.col("was")).limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


def size_class(n: Column, per_cent: int) -> Column:
    return F.floor(F.log(n.cast("double")) * (SIZES / math.log(100 / per_cent))).cast("int")


def reach(n: str, pos: str, per_cent: int) -> Column:
    """The largest set that one of n shingles can link with if they share none before `pos`."""
    return F.expr(f"(({n} - {pos}) * {100 + per_cent}) div {per_cent} - {n}")


def sent(rows: DataFrame) -> DataFrame:
    """The rows for a broadcast join if there are few enough, else for a shuffled one."""
    return F.broadcast(rows) if rows.limit(SENT_LABELS + 1).count() <= SENT_LABELS else rows.hint("merge")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with each set's component so far (its own id where it has no link)."""
    named = rows.join(sent(labels), rows["doc_id"] == labels["id"], "left").drop("id")
    return named.withColumn("component", F.coalesce("component", "doc_id"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """a, b, distance (1 - Jaccard), linked of pairs (a, b). Only the documents in some pair are shingled again."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "paired-ids")
    sets = stored(sets_of(having(docs, "doc_id", ids), width), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).hint("merge")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")).hint("merge")
    both = pairs.join(right, "b").join(left, "a").select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared")
    )
    union = F.col("na") + F.col("nb") - F.col("shared")
    return both.select("a", "b", (1 - F.col("shared") / union).alias("distance"), (F.col("shared") * 100 >= union * per_cent).alias("linked"))


def star_pairs(marked: DataFrame, labels: DataFrame, again: bool) -> DataFrame:
    """(a, b): each set b and the leader a of sets that share two marks with it, where their components differ."""
    keys = ["mark", "size_class"]
    known = labelled(marked, labels)
    top = F.max(F.struct("typical", "doc_id", "component")).alias("top")
    groups = known.groupBy(*keys).agg(top, F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    if again:  # the most typical set that the group's leader has not drawn in
        minor = known.join(groups.select(*keys, F.col("top.component").alias("major")).hint("merge"), keys)
        groups = minor.where(F.col("component") != F.col("major")).groupBy(*keys).agg(top)
    met = known.join(groups.select(*keys, "top").hint("merge"), keys).where(F.col("component") != F.col("top.component"))
    both = met.groupBy(F.col("top.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.max("few").alias("few"))
    return both.where(F.col("few") | (F.col("times") >= 2)).select("a", "b")


def list_pairs(lists: DataFrame, compared: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of sets in different components that may link, by the index lists and what is known of them."""
    own = compared.select(F.col("a").alias("doc_id"), F.struct(F.lit(0.0).alias("distance"), F.col("a").alias("leader")).alias("told"))
    told = compared.select(F.col("b").alias("doc_id"), F.struct("distance", F.col("a").alias("leader")).alias("told")).unionByName(own)
    told = told.groupBy("doc_id").agg(F.min("told").alias("told")).select("doc_id", "told.distance", "told.leader")
    near = lists.join(sent(told), "doc_id", "left").withColumn("reach", reach("n", "pos", per_cent)).drop("pos")
    least = F.ceil(F.col("n") * per_cent / 100 - 1e-9)
    blocks = F.sequence(size_class(least, per_cent), size_class(F.least("n", "reach"), per_cent))
    x = near.where(F.col("reach") >= least).withColumn("size_class", F.explode(blocks)).alias("x")
    y = near.where("reach >= n").withColumn("size_class", size_class(F.col("n"), per_cent)).hint("merge").alias("y")
    apart = (F.col("x.leader") == F.col("y.leader")) & (F.abs(F.col("x.distance") - F.col("y.distance")) > 1 - per_cent / 100 + 1e-9)
    met = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.size_class") == F.col("y.size_class"))
        & (F.col("x.component") != F.col("y.component")) & ~F.coalesce(apart, F.lit(False))
        & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.doc_id") < F.col("x.doc_id"))))
        & (F.col("x.n") * per_cent <= F.col("y.n") * 100) & (F.col("y.n") <= F.col("x.reach")) & (F.col("x.n") <= F.col("y.reach")),
    )
    pairs = met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(sent(done), ["a", "b"], "left_anti")


def near_components(docs: DataFrame, width: int = 4, per_cent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _near(docs, width, per_cent)
    # Ids with several rows: rows are joined by a number of their own, and rows of an id are linked.
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    known = rows.where("doc_id IS NOT NULL")
    found = stored(_near(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text", F.col("row")), width, per_cent, "row"), "row-components")
    first = known.groupBy("doc_id").agg(F.min("row").alias("first"))
    same = known.join(first, "doc_id").select(F.col("row").alias("a"), F.col("first").alias("b"))
    links = found.where("component_id IS NOT NULL").select(F.col("row").alias("a"), F.col("component_id").alias("b"))
    labels = components(links.unionByName(same))
    least = labels.join(known.select("row", "doc_id"), F.col("id") == F.col("row")).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(least, "component").select(F.col("id").alias("row"), "component_id")
    out = rows.select("row", "doc_id").join(found.select("row", "n_shingles"), "row").join(named, "row", "left")
    return out.select("doc_id", "n_shingles", "component_id")


def _near(docs: DataFrame, width: int, per_cent: int, *carried: str) -> DataFrame:
    """near_components of documents whose doc_ids differ (or are null); `carried` names a long column to keep."""
    slots = min(MAX_SLOTS, 1 << max(16, (16 * docs.count()).bit_length()))
    base = stored(profiles(docs, width, per_cent, shingle_rarity(docs, width, slots), *carried), "profiles")
    real = base.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = real.groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = real.select("doc_id", "key1", "key2", "n").join(classes.where("copies > 1"), ["key1", "key2", "n"]).where(F.col("doc_id") != F.col("rep"))
    copies = stored(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    gone = copies.select(F.col("a").alias("doc_id"))

    marked = real.select(
        "doc_id", "typical", size_class(F.col("n"), per_cent).alias("size_class"), (F.size("marks") < MARKS).alias("few"), F.explode("marks").alias("mark")
    )
    marked = stored(marked.join(sent(gone), "doc_id", "left_anti"), "marked")
    labels, links, compared = components(copies), copies, None
    for k in range(STARS):
        new = stored(verified(star_pairs(marked, labels, k > 0), docs, width, per_cent), "stars")
        compared = new if compared is None else compared.unionByName(new)
        linked = new.where("linked").select("a", "b")
        if linked.limit(1).count():
            links = links.unionByName(linked)
            labels = components(links)

    # Shingles in the prefixes of two components, and the lists of those alone.
    entries = labelled(real.select("doc_id", "n", "prefix"), labels).select("doc_id", "n", "component", F.posexplode("prefix").alias("pos", "shingle"))
    spread = entries.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max(reach("n", "pos", per_cent) >= F.col("n")).alias("indexed")
    )
    shared = stored(spread.where("low != high AND indexed").select("shingle"), "shared-shingles")
    lists = stored(having(entries, "shingle", shared).join(sent(gone), "doc_id", "left_anti"), "lists")
    new = stored(verified(list_pairs(lists, compared, per_cent), docs, width, per_cent), "rest")
    fresh = new.where("linked").select("a", "b")
    labels = components(links.unionByName(fresh)) if fresh.limit(1).count() else labels
    out = base.select("doc_id", F.col("n").alias("n_shingles"), *carried).join(labels, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *carried)
