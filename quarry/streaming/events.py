"""Event tails, queues and state machines, in batches and in streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tail(spark: SparkSession, path: str, schema: str, key: str, at: str, late: str = "30 days") -> DataFrame:
    """A stream of events, each delivered once: state is kept for `late` of event time."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, into: str, checkpoint: str) -> None:
    """Run a stream over what is there, into Parquet, with exactly-once files."""
    query = stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _table_files(table: str):
    """The file system and the folder in it of a keyed table."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(table if "://" in table else "file://" + table.removeprefix("file:"))


def _versions(table: str) -> list[dict]:
    """The table's versions in order: number, and the version in which each bucket was written last."""
    from pyarrow import fs

    files, base = _table_files(table)
    found = [f.path for f in files.get_file_info(fs.FileSelector(f"{base}/versions", allow_not_found=True)) if f.path.endswith(".json")]
    out = []
    for path in sorted(found):
        with files.open_input_file(path) as f:
            out.append(json.loads(f.read()))
    return out


def _bucket_paths(table: str, held: dict[str, int], buckets: list[int] | None = None) -> list[str]:
    return [f"{table}/data/{v:08d}/__bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]


def upserts(stream: DataFrame, table: str, key: list[str], at: str, checkpoint: str, buckets: int = 64, keep: int = 2) -> None:
    """Micro-batches of a stream merged into a keyed table (read it by `upserted`); a repeated batch changes nothing.

    Keys are dealt into buckets by a hash. A batch rewrites the buckets that it touches, then one small file that names where
    each bucket is makes the new version; data that the last `keep` versions don't name is removed. The number of buckets is
    fixed when the table is made. Of a key's rows the one with the greatest `at`, then the greatest values, stays.
    """
    schema = T.StructType(list(stream.schema.fields))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(table) if v["number"] < number]
        held, parts = (before[-1]["held"], before[-1]["buckets"]) if before else ({}, buckets)
        dealt = batch.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
        touched = [r["__bucket"] for r in dealt.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        old = _bucket_paths(table, held, touched)
        both = dealt
        if old:
            both = dealt.unionByName(spark.read.schema(schema).parquet(*old).withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")))
        rest = [c for c in batch.columns if c not in (*key, at)]
        newest = both.groupBy("__bucket", *key).agg(F.max(F.struct(at, *rest)).alias("r")).select("__bucket", *key, "r.*")
        newest.repartition("__bucket").write.partitionBy("__bucket").mode("overwrite").parquet(f"{table}/data/{number:08d}")
        files, base = _table_files(table)
        files.create_dir(f"{base}/versions", recursive=True)
        staged = f"{base}/versions/{uuid.uuid4().hex}.staged"
        with files.open_output_stream(staged) as f:
            f.write(json.dumps({"number": number, "buckets": parts, "held": held | {str(b): number for b in touched}}).encode())
        files.move(staged, f"{base}/versions/{number:08d}.json")
        named = _versions(table)
        wanted = {(b, v) for x in named[-keep:] for b, v in x["held"].items()}
        for b, v in {(b, v) for x in named[:-keep] for b, v in x["held"].items()} - wanted:
            if files.get_file_info(f"{base}/data/{v:08d}/__bucket={b}").type.name == "Directory":
                files.delete_dir(f"{base}/data/{v:08d}/__bucket={b}")
        for x in named[:-keep]:
            files.delete_file(f"{base}/versions/{x['number']:08d}.json")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, table: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a table of `upserts` as they are now."""
    made = _versions(table)
    if not made:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_bucket_paths(table, made[-1]["held"]))


def due(queue: DataFrame, now: str, most: int = 64) -> DataFrame:
    """Work that may be taken up: pending or running, available, of fewer than five attempts, oldest first."""
    ready = queue.where(F.col("status").isin("PENDING", "RUNNING") & (F.col("available_at") <= F.to_timestamp(F.lit(now))) & (F.col("attempts") < 5))
    return ready.orderBy("updated_at", "run_id").limit(most)


def illegal_moves(events: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Moves between a key's successive states that the table doesn't allow."""
    w = Window.partitionBy(key).orderBy(*order)
    moves = events.withColumn("previous", F.lag(state).over(w)).where(F.col("previous").isNotNull())
    legal = F.lit(False)
    for a, bs in allowed.items():
        legal = legal | ((F.col("previous") == a) & F.col(state).isin(*bs))
    return moves.where(~legal & (F.col("previous") != F.col(state)))


def expired(rows: DataFrame, now: str, until: str, pinned: str) -> DataFrame:
    """Rows past their time that aren't pinned."""
    return rows.where(F.col(until).isNotNull() & (F.col(until) < F.to_timestamp(F.lit(now))) & ~F.coalesce(F.col(pinned), F.lit(False)))
