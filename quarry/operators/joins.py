"""Joins: lookups, existence, nearest vectors, near copies, paired runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .firstcome import FEW, Alike, candidates
from .storage import stored


def with_children(parent: DataFrame, child: DataFrame, key: str, foreign: str, into: str, fields: list[str]) -> DataFrame:
    """Each parent with its children as an ordered array of structs (empty if none)."""
    kids = child.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
    return parent.join(kids, key, "left").withColumn(into, F.coalesce(into, F.array()))


def ordered_lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows for (position, key) requests, with `missing` for keys that aren't there."""
    there = table.withColumn("__there", F.lit(True))
    return ids.join(there, key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there")


def latest(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of the greatest order columns for each key, by partial aggregation."""
    top = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("__top")
    return df.groupBy(*key).agg(top).select(*key, *[F.col(f"__top.{c}").alias(c) for c in keep])


def all_done(parent: DataFrame, child: DataFrame, key: str, foreign: str, open_child: Column) -> DataFrame:
    """Parents that have children, none of which is open."""
    refs = child.select(F.col(foreign).alias(key))
    still = child.where(open_child).select(F.col(foreign).alias(key))
    return parent.join(refs, key, "left_semi").join(still, key, "left_anti")


def flagged(parent: DataFrame, child: DataFrame, key: str, foreign: str, test: Column, flag: str) -> DataFrame:
    """Whether any child passes a test, as a column."""
    flags = child.groupBy(F.col(foreign).alias(key)).agg(F.bool_or(test).alias(flag))
    return parent.join(flags, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """Dictionary join on whole tokens: one row for each (key, canonical) whose alias occurs."""
    words = texts.select(key, F.explode(F.array_distinct(T.ascii_tokens(F.col(text)))).alias("alias"))
    return words.join(terms, "alias").select(key, "canonical").distinct()


def delta(now: DataFrame, before: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Differences of the values of common keys."""
    b = before.select(key, *[F.col(v).alias(f"__{v}") for v in values])
    return now.join(b, key).select(key, *[(F.col(v) - F.col(f"__{v}")).alias(f"{v}_delta") for v in values])


def paired(a: DataFrame, b: DataFrame, key: str, value: str, eps: float = 1e-9) -> DataFrame:
    """Wins, ties and losses of run a against run b, with the mean difference."""
    d = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key)
    diff = F.col("__a") - F.col("__b")
    return d.agg(
        F.count_if(diff > eps).alias("wins"), F.count_if(F.abs(diff) <= eps).alias("ties"),
        F.count_if(diff < -eps).alias("losses"), F.avg(diff).alias("mean_delta"),
    )


def nearest(queries: DataFrame, table: DataFrame, k: int, query_block: int = 4096, block: int = 8192) -> DataFrame:
    """Exact cosine top k of each query, any number of queries against all rows.

    queries(query_id, vector), table(id, vector). Both are dealt into blocks by a hash of their ids;
    every block of queries meets every block of rows, which keeps k rows of each query. As in
    `vectors.cosine`, unequal lengths and zero vectors score 0; a missing vector or element makes the
    score null, which comes last.
    """
    # Two numbers.
    asks, blocks = max(1, -(-queries.count() // query_block)), max(1, -(-table.count() // block))
    kinds = queries.schema["query_id"].dataType.simpleString(), table.schema["id"].dataType.simpleString()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.where("query_id IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    left = left.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")).withColumn("block", every(blocks))
    right = table.where("id IS NOT NULL").select("id", F.col("vector").cast("array<double>").alias("vector"))
    right = right.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("ask", every(asks))
    found = left.groupBy("ask", "block").cogroup(right.groupBy("ask", "block")).applyInPandas(
        lambda a, b: _nearest_in_block(a, b, k), f"query_id {kinds[0]}, id {kinds[1]}, score double"
    )
    return top_k(found.withColumn("score", F.round("score", 6)), "query_id", [F.desc("score"), F.asc("id")], k)


def _nearest_in_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, chunk: int = 256) -> pd.DataFrame:
    """The k best rows of a block for each query of a block, by score rounded to 6 digits, then id."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": queries["query_id"][:0], "id": rows["id"][:0], "score": pd.Series(dtype="float64")})
    size = lambda vectors: np.array([-1 if v is None else len(v) for v in vectors])
    rows = rows.sort_values("id", kind="stable")
    ids, lengths, out = rows["id"].to_numpy(), size(rows["vector"]), []
    missing = np.flatnonzero(lengths < 0)
    for length, asked in queries.groupby(size(queries["vector"])):
        same = np.flatnonzero(lengths == length)
        x = np.stack(rows["vector"].to_numpy()[same]) if length > 0 and len(same) else None
        for at in range(0, len(asked), chunk):
            some = asked.iloc[at : at + chunk]
            scores = np.full((len(some), len(ids)), np.nan if length < 0 else 0.0)
            if x is not None:
                q = np.stack(some["vector"])
                n = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores[:, same] = np.where(n == 0, 0.0, (q @ x.T) / n)
            scores[:, missing] = np.nan
            for query, score in zip(some["query_id"], scores, strict=True):
                order = np.where(np.isnan(score), np.inf, -np.round(score, 6))
                mine = np.flatnonzero(ids != query)
                if len(mine) > k:  # with all that tie with the last, then the smaller ids
                    mine = mine[order[mine] <= np.partition(order[mine], k - 1)[k - 1]]
                mine = mine[np.argsort(order[mine], kind="stable")][:k]
                out.append((np.full(len(mine), query), ids[mine], score[mine]))
    return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def top_k(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """rank 1..k within each group; Spark keeps only k rows per group and task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def simhash_pairs(texts: DataFrame, key: str, text: str, most_bits: int = 6, least_jaccard: float = 0.88) -> DataFrame:
    """Near copies: token sets of at least that Jaccard similarity whose SimHashes differ in few bits.

    Candidates share one of the n - ceil(j n) + 1 rarest tokens of both (every pair of that
    similarity does), so lists stay short; equal token lists are one class before the join.

    Two kinds of rows: pairs of the classes' representatives (their least ids; `copy` is false), and
    for every other member of a class one row (representative, member; 0 bits, Jaccard 1; `copy` is
    true). Members are near whatever their representative is near; those pairs aren't listed. Texts
    without ASCII tokens and rows without an id have no row.
    """
    tokens = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), T.ascii_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    # Tokens are compared by 64-bit hashes, which are a third of their size; rows have numbers, as ids may repeat.
    hashed = tokens.select("id", F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens"), F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(1), "tokens").alias("h2"))
    hashed = stored(hashed.withColumns({"sign": T.simhash_of(F.col("tokens")), "row": F.monotonically_increasing_id()}), "token-sets")
    ids = hashed.select("id", "h", "h2", "row")
    ranges = ids.groupBy("h", "h2").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(ids.join(ranges, ["h", "h2"]).select(F.col("first.id").alias("first_id"), "id", "row", (F.col("row") != F.col("first.row")).alias("later")).where("later"), "copies")
    members = copies.where("id > first_id").select("first_id", F.col("id").alias("second_id"), F.lit(0).alias("bits"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy")).distinct()
    later = copies.select("row")
    sets = hashed.join(F.broadcast(later) if later.count() <= FEW else later, "row", "left_anti").select("id", "tokens", "sign")
    pairs = stored(candidates(sets, Alike(least_jaccard, most_bits)), "candidates")
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"), F.col("sign").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"), F.col("sign").alias("sb"))
    shared = F.size(F.array_intersect("x", "y"))
    near = pairs.join(one, "a").join(two, "b").select(
        F.col("a").alias("first_id"), F.col("b").alias("second_id"), T.hamming(F.col("sa"), F.col("sb")).alias("bits"),
        (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard")).where((F.col("bits") <= most_bits) & (F.col("jaccard") >= least_jaccard))
    return near.withColumn("copy", F.lit(False)).unionByName(members)


def greedy_matches(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """One-to-one matches of expected to observed calls per case: first equal name with the expected
    arguments among the observed ones, then equal name, in order. Cases are small by nature.

    expected(key, position, name, arguments map), observed(the same columns).
    """

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("position"), b.sort_values("position")
        seen = [(int(p), n, dict(x or [])) for p, n, x in zip(b["position"], b["name"], b["arguments"], strict=True)]
        used, out, wait = set(), [], []
        for row in zip(a[key], a["position"], a["name"], a["arguments"], strict=True):
            args = dict(row[3] or [])
            hit = next((p for p, n, x in seen if p not in used and n == row[2] and args.items() <= x.items()), None)
            if hit is None:
                wait.append(row)
            else:
                used.add(hit)
                out.append((row[0], int(row[1]), hit, True))
        for row in wait:
            hit = next((p for p, n, _ in seen if p not in used and n == row[2]), None)
            used.add(hit)
            out.append((row[0], int(row[1]), hit, False))
        return pd.DataFrame(out, columns=[key, "expected_position", "observed_position", "exact"]).astype({"observed_position": "Int64"})

    kind = expected.schema[key].dataType.simpleString()
    return expected.groupBy(key).cogroup(observed.groupBy(key)).applyInPandas(
        match, f"{key} {kind}, expected_position int, observed_position long, exact boolean"
    )


def substring_hits(texts: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Dictionary join on substrings: key and every canonical name with an alias in the text.

    The dictionary is literal, so this is one projection; nothing is joined.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = []
    for name, words in aliases.items():
        test = low.contains(name)
        for w in words:
            test = test | low.contains(w)
        found.append(F.when(test, name))
    return texts.select(key, F.explode(F.array_compact(F.array(*found))).alias("canonical"))


def conflicts(claims: DataFrame, topic: str, id_: str, tokens: str, numbers: str, least: float = 0.45) -> DataFrame:
    """Pairs of claims on a topic whose tokens overlap and whose numbers differ.

    Pairs meet on a shared token of their topic, so unrelated claims never do.
    """
    words = claims.select(topic, id_, tokens, numbers, F.explode(F.array_distinct(tokens)).alias("__w"))
    x, y = words.alias("x"), words.alias("y")
    met = x.join(y, (F.col(f"x.{topic}") == F.col(f"y.{topic}")) & (F.col("x.__w") == F.col("y.__w")) & (F.col(f"x.{id_}") < F.col(f"y.{id_}")))
    differ = (F.size(F.col(f"x.{numbers}")) > 0) & (F.size(F.col(f"y.{numbers}")) > 0) & (F.array_sort(F.array_distinct(f"x.{numbers}")) != F.array_sort(F.array_distinct(f"y.{numbers}")))
    near = T.min_overlap(F.col(f"x.{tokens}"), F.col(f"y.{tokens}"))
    return met.where(differ & (near >= least)).select(
        F.col(f"x.{topic}").alias(topic), F.col(f"x.{id_}").alias("first_id"), F.col(f"y.{id_}").alias("second_id"), near.alias("overlap")).distinct()


def multiset_overlap(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Size of the multiset intersection of each key's items in two tables."""
    n = a.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    m = b.groupBy(key, item).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, [key, item]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("shared"))
