"""Approximate nearest neighbours by learned partitions.

On a bounded sample the nearest-neighbour graph is built and cut into parts of
equal size, moving vertices to the part of most of their neighbours while sizes
stay balanced. A small network then learns, from each sample vector, in which
parts its neighbours lie. The network places every vector of the table in its
most probable part, and sends each query to its most probable parts, as many as
together hold its neighbours with a probability of `MASS`: few where vectors form
clusters, most where they are noise. There it is compared with every vector in exact
double precision. The number of parts grows with the table, from 16 to 64.

Parts hold unequal and growing numbers of rows, so each is cut into blocks of a
fixed size (salted by vec_id): a task holds one block of vectors and one block of
queries, whatever the size of the part or of a group of copies in it. The fitted
state (a few thousand numbers a part) is all that is sent to the tasks.

Edge cases: finite vectors of any size take part (distances are scaled where squares
would overflow; one beyond the largest double is infinite); vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part; copies are all found, ties going to
the smaller vec_id; fewer candidates than k give fewer rows; a row is no candidate
of its own query (rows are told apart by vec_id); query rows that repeat an id ask
once, those of another length than the table's vectors not at all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PARTS = 16, 64
MASS = 0.95
SAMPLE = 6000
NEIGHBOURS = 10
BLOCK = 4096
QUERY_BLOCK = 8192
HITS = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """A network of one hidden layer over the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def best(self, x: np.ndarray, count: int | None = None, mass: float = MASS) -> tuple[np.ndarray, np.ndarray]:
        """(the parts of all rows, most probable first, one row after the other; how many each has): `count`, or up to `mass`."""
        z = self.scores(x)
        order = np.argsort(-z, axis=1, kind="stable")
        if count is not None:
            many = np.full(len(x), min(count, z.shape[1]))
        else:
            p = np.exp(z - z.max(axis=1, keepdims=True))
            sums = np.cumsum(np.take_along_axis(p / p.sum(axis=1, keepdims=True), order, axis=1), axis=1)
            many = np.minimum((sums < mass).sum(axis=1) + 1, z.shape[1])
        return order[np.arange(z.shape[1]) < many[:, None]], many


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows, in blocks."""
    k = min(k, len(x) - 1)
    out, square = np.zeros((len(x), k), np.int64), (x * x).sum(axis=1)
    for at in range(0, len(x), 1024):
        d = square[None] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12) -> np.ndarray:
    """A part of equal size for each vertex, with few edges between parts."""
    n = len(x)
    part = np.zeros(n, np.int64)
    groups = [(np.arange(n), parts)]
    number = 0
    while groups:  # to begin with: halves along random differences
        rows, into = groups.pop()
        if into == 1 or len(rows) < 2:
            part[rows] = number
            number += into
            continue
        line = x[rows] @ (x[rng.choice(rows)] - x[rng.choice(rows)])
        rows, left = rows[np.argsort(line, kind="stable")], into // 2
        cut = len(rows) * left // into
        groups += [(rows[:cut], left), (rows[cut:], into - left)]
    most = -(-n // parts)
    both = np.concatenate([graph, graph], axis=1) if graph.size else graph
    for _ in range(sweeps):  # exchanges between parts keep the sizes
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), both.shape[1]), part[both].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        lists: dict[tuple[int, int], list[int]] = {}
        for v in movers:
            lists.setdefault((int(part[v]), int(wish[v])), []).append(int(v))
        moved, sizes = 0, np.bincount(part, minlength=parts)
        for (a, b), go in lists.items():
            back = lists.get((b, a), []) if a < b else []
            for v, w in zip(go, back, strict=False):
                part[v], part[w] = b, a
                moved += 2
            for v in go[len(back):] if a < b else []:
                if sizes[b] < most:
                    part[v] = b
                    sizes[a], sizes[b], moved = sizes[a] - 1, sizes[b] + 1, moved + 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
    """Cross-entropy to the parts' shares of each row's neighbours, by Adam."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, parts = x.shape[1], target.shape[1]
    net = [rng.normal(0, 1.5 / np.sqrt(d), (d, hidden)) * np.sqrt(d), np.zeros(hidden), rng.normal(0, 0.1, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            h = np.tanh(x[rows] @ net[0] + net[1])
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            e = (p - target[rows]) / len(rows)
            back = (e @ net[2].T) * (1 - h * h)
            grads = [x[rows].T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*net)


def parts_for(rows: int) -> int:
    """A power of two that grows with the square root of the table."""
    return int(np.clip(1 << int(np.log2(max(rows, 1) ** 0.5 / 32 + 1)), *PARTS))


def fit(sample: np.ndarray, parts: int = PARTS[0], neighbours: int = NEIGHBOURS, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    x = np.unique(np.clip(np.asarray(sample, np.float64), -1e100, 1e100), axis=0)  # copies teach nothing more
    parts = max(1, min(parts, len(x) // 4))
    graph = neighbour_graph(x, neighbours)
    part = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), part] += 1
    if graph.size:
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
    return train(x, target / target.sum(axis=1, keepdims=True), rng)


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that take part; length: that of most rows unless given."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    if length is None:
        most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = most["n"] if most else 0
    return rows.where(F.size("embedding") == length)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q; scaled by the largest difference where squares leave the doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = x - q
        d = np.sqrt((apart**2).sum(axis=1))
        far = np.flatnonzero(~np.isfinite(d))
        if len(far):
            most = np.abs(apart[far]).max(axis=1, keepdims=True)
            scaled = np.where(np.isfinite(most), apart[far] / most, 0.0)
            d[far] = np.where(np.isfinite(most[:, 0]), most[:, 0] * np.sqrt((scaled**2).sum(axis=1)), np.inf)
    return d


def nearest_in_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact distances of a block of queries to a block of vectors: each query's k nearest."""
    if not len(queries) or not len(block):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    block = block.sort_values("vec_id", kind="stable")
    ids, x = block["vec_id"].to_numpy(), np.stack(block["embedding"])
    out = []
    for query, q in zip(queries["query_id"], queries["embedding"], strict=True):
        other = np.flatnonzero(ids != query)
        d = distances(x[other] if len(other) < len(x) else x, q)
        at = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
        if len(d) > k:  # with all that tie with the last, then the smaller ids
            at = np.flatnonzero(d <= d[at].max())
        at = at[np.lexsort((ids[other][at], d[at]))][:k]
        out.append((np.full(len(at), query), ids[other][at], d[at]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None, probes: int | None = None,
           sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    vectors: vec_id, embedding; queries: the same columns. sample: at most as many vectors to fit on. probes: as many
    parts for every query, rather than up to a probability of `mass`.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    total = rows.count()
    # The least hashes: out of twice as many as are wanted, so that few rows are sorted.
    share = min(1.0, 2 * sample / max(total, 1))
    key = F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 30) - 1))
    picked = rows.where(key < F.lit(int(share * (1 << 30)))).orderBy(key, "vec_id", "embedding").limit(sample).select("embedding").toPandas()
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(np.stack(picked["embedding"]), parts or parts_for(total))
    shape = "vec_id long, embedding array<double>, part int"

    def route(count: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    best, many = router.best(np.stack(batch["embedding"]), count, mass)
                    out = batch.loc[batch.index.repeat(many)].reset_index(drop=True)
                    out["part"] = best.astype("int32")
                    yield out
        return run

    placed = stored(rows.mapInPandas(route(1), shape), "placed")
    # Rows that repeat a query's id ask once.
    asked = usable(queries, len(picked["embedding"][0])).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.mapInPandas(route(probes), shape)
    # One row per part.
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    blocks = {p: -(-n // block) for p, n in sizes.items()}
    asks = -(-max(queries.count(), 1) // query_block)
    of_part = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("part")]
    left = (
        asked.where(F.col("part").isin(list(blocks)))
        .withColumnRenamed("vec_id", "query_id")
        .withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), (of_part - 1).cast("int"))))
    )
    right = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of_part).cast("int")).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))
    )
    keys = ("part", "block", "ask")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: nearest_in_block(a, b, k), HITS)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
