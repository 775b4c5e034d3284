"""Snapshots, upserts, change sets and embedding reuse on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_snapshots(have: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored, one for each key."""
    return incoming.dropDuplicates(key).join(have.select(*key), key, "left_anti")


def upsert(have: DataFrame, incoming: DataFrame, key: list[str], generation: str = "generation", at: str | None = None) -> DataFrame:
    """Rows of both; a key that comes again takes the incoming values and the next generation.

    Of several incoming rows of a key the one with the greatest `at` counts, or else with the greatest values.
    """
    values = [c for c in have.columns if c not in (*key, generation)]
    last = F.max(F.struct(*([F.col(at).alias("__at")] if at else []), *values)).alias("__r")
    incoming = incoming.groupBy(*key).agg(last).select(*key, *[F.col(f"__r.{c}").alias(c) for c in values])
    new = incoming.select(*key, *[F.col(c).alias(f"__{c}") for c in values]).withColumn("__new", F.lit(True))
    both = have.withColumn("__old", F.lit(True)).join(new, key, "full")
    came = F.col("__new").isNotNull()
    return both.select(
        *key, *[F.when(came, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(F.col("__old").isNull(), F.lit(1)).when(came, F.col(generation) + 1).otherwise(F.col(generation)).alias(generation),
    )


def replaced(have: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the incoming keys in place of the stored ones."""
    return have.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def newest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key of a keyed store."""
    rest = [c for c in rows.columns if c not in (*key, at)]
    return rows.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("r")).select(*key, "r.*")


def changed(have: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Incoming rows that are new or differ in a value, nulls being equal."""
    old = have.select(key, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__there"))
    same = F.col("__there").isNotNull()
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return incoming.join(old, key, "left").where(~same).select(*incoming.columns)


def merged_links(links: DataFrame, by: list[str], at: str, context: str) -> DataFrame:
    """First and last time of each link, the latest context, and how often it came."""
    return links.groupBy(*by).agg(F.min(at).alias("first_linked_at"), F.max(at).alias("last_linked_at"), F.max(F.struct(at, context))[context].alias(context), F.count(F.lit(1)).alias("n"))


def needs_index(items: DataFrame, index: DataFrame, key: str, wanted: dict[str, str]) -> DataFrame:
    """Items with the reason why they must be indexed: no_document, hash, or a setting that differs."""
    i = index.select(key, F.col("content_hash").alias("__hash"), *[F.col(c).alias(f"__{c}") for c in wanted], F.lit(True).alias("__there"))
    reason = F.when(F.col("__there").isNull(), "no_document").when(~F.col("__hash").eqNullSafe(F.col("content_hash")), "content_hash")
    for c, v in wanted.items():
        reason = reason.when(~F.col(f"__{c}").eqNullSafe(F.lit(v)), c)
    return items.join(i, key, "left").select(*items.columns, reason.alias("reason")).where(F.col("reason").isNotNull())


def reuse_embeddings(chunks: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector, distinct keys that must be embedded)."""
    one = cache.groupBy(*key).agg(F.any_value("vector").alias("vector"))
    return chunks.join(one, key), chunks.select(*key).distinct().join(one, key, "left_anti")


def health(parents: DataFrame, documents: DataFrame, key: str, active: Column, compatible: Column) -> DataFrame:
    """Index status of each parent: ready, partial, needs_update or not_built."""
    docs = documents.where(active).groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.count_if(compatible).alias("compatible"))
    out = parents.join(docs, key, "left").na.fill(0, ["documents", "compatible"])
    status = F.when(F.col("documents") == 0, "not_built").when(F.col("compatible") == F.col("documents"), "ready").when(F.col("compatible") > 0, "partial").otherwise("needs_update")
    return out.withColumn("status", status)


def refreshed(df: DataFrame, fresh: dict[str, Column]) -> DataFrame:
    """Rows for which some new value (as fresh_<name>) differs from the old one; running it again changes nothing."""
    made = df.withColumns({f"fresh_{c}": value for c, value in fresh.items()})
    same = F.lit(True)
    for c in fresh:
        same = same & F.col(c).eqNullSafe(F.col(f"fresh_{c}"))
    return made.where(~same)


def with_error(df: DataFrame, into: str, value: Column, message: str) -> DataFrame:
    """A column and an error: rows whose value can't be made keep a null and say so."""
    return df.withColumn(into, value).withColumn("error", F.when(F.col(into).isNull(), message))


def soft_deleted(df: DataFrame, which: Column, status: str = "status", previous: str = "previous") -> DataFrame:
    """The named rows marked deleted, what they were before kept; rows that are deleted already stay as they are."""
    hit = F.coalesce(which, F.lit(False)) & (F.coalesce(status, F.lit("")) != "deleted")
    return df.withColumns({previous: F.when(hit, F.col(status)).otherwise(F.col(previous)), status: F.when(hit, "deleted").otherwise(F.col(status))})


def restored(df: DataFrame, which: Column, status: str = "status", previous: str = "previous") -> DataFrame:
    """The named deleted rows as they were before."""
    hit = F.coalesce(which, F.lit(False)) & (F.coalesce(status, F.lit("")) == "deleted")
    return df.withColumns({status: F.when(hit, F.col(previous)).otherwise(F.col(status)), previous: F.when(hit, F.lit(None)).otherwise(F.col(previous))})


def decoded_strings(json: Column, decode) -> Column:
    """JSON text with every string value decoded; keys, numbers and structure stay. decode: of a string column without its quotes."""
    # Strings, then what stands between them; a string that a colon follows is a key.
    strings = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*"\s*:?)'), 1)
    rest = F.split(json, r'"(?:[^"\\]|\\.)*"\s*:?', -1)
    told = F.transform(strings, lambda s: F.when(s.endswith(":"), s).otherwise(F.concat(F.lit('"'), decode(F.substring(s, F.lit(2), F.length(F.rtrim(s)) - 2)), F.lit('"'))))
    return F.concat(F.array_join(F.zip_with(F.slice(rest, 1, F.size(told)), told, lambda a, b: F.concat(a, b)), ""), F.element_at(rest, -1))


def debounced(events: DataFrame, key: str, at: str, id_: str, gap: int, wait: int, most: int) -> DataFrame:
    """Runs of each key's events with gaps of at most `gap` seconds: run, items and when it is due (`wait` seconds after its
    last event, but at most `most` seconds after its first, and never before its last)."""
    order = Window.partitionBy(key).orderBy(at, id_)
    new = F.when(F.lag(at).over(order).isNull() | (F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(order).cast("timestamp")) > gap), 1).otherwise(0)
    runs = events.withColumn("run", F.sum(new).over(order))
    later = lambda c, s: c + F.expr(f"INTERVAL {s} SECONDS")
    return runs.groupBy(key, "run").agg(
        F.count(F.lit(1)).alias("items"), F.least(later(F.max(at), wait), F.greatest(later(F.min(at), most), F.max(at))).alias("due"))
