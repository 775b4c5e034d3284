"""Keyed state over several micro-batches and restarts against the batch forms."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import incremental, reports
from quarry.plans.streams import ALLOWED
from quarry.streaming import events as E
from quarry.streaming import keyed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("generation", F.floor("value")).cache()


def replay(spark, table, tmp_path, make, cuts=(0, 150, 151, 600, 10_000)):
    """The stream over slices of the table in order: some together, then, after a restart, the others."""
    rows = table.orderBy("ts", "event_id").collect()
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        some = spark.createDataFrame(rows[a:b], table.schema).repartition(1)
        some.write.mode("append").parquet(folder)
        if n in (1, len(cuts) - 2):
            stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
            E.drain(make(stream, n == len(cuts) - 2), out, state)
    return spark.read.parquet(out)


def same(got, want):
    rows = lambda d: Counter(map(tuple, d.select(*want.columns).collect()))
    return rows(got) == rows(want)


def test_runs_over_batches(spark, table, tmp_path):
    cuts = (0, 150, 151, 600, 10_000)
    end = str(tmp_path / "end")
    schema = table.schema
    spark.createDataFrame([], schema).write.parquet(end)

    def make(stream, last):
        if last:  # the row that ends the replay
            rows = spark.range(1).select(*[(F.lit("9999-01-01") if c == "ts" else F.lit(None)).cast(schema[c].dataType).alias(c) for c in schema.names])
            rows.write.mode("append").parquet(end)
        both = stream.unionByName(spark.readStream.schema(schema).parquet(end))
        return keyed.debounced(both, "user_id", "ts", 86400, 5, 15)

    got = replay(spark, table, tmp_path, make, cuts).where("user_id IS NOT NULL")
    assert same(got, incremental.debounced(table, "user_id", "ts", "event_id", 86400, 5, 15))


def test_fences_over_batches(spark, table, tmp_path):
    got = replay(spark, table, tmp_path, lambda stream, last: keyed.fenced(stream, "user_id", "ts", "event_id", "generation"))
    want = reports.fenced(table.select("event_id", "user_id", "ts", "generation"), "user_id", ["ts", "event_id"], "generation").select("user_id", "event_id", "accepted")
    assert same(got, want) and 0 < want.where("accepted").count() < want.count()


def test_moves_over_batches(spark, table, tmp_path):
    got = replay(spark, table, tmp_path, lambda stream, last: keyed.illegal_moves(stream, "user_id", "ts", "event_id", "event_type", ALLOWED))
    want = E.illegal_moves(table, "user_id", ["ts", "event_id"], "event_type", ALLOWED).select("user_id", "event_id", "previous", "event_type")
    assert same(got, want) and want.count() > 0


def test_expiry_by_timers(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, day)
    batches = [
        [(1, 1, at(1), at(5), False), (2, 2, at(1), at(3), False), (3, 3, at(1), at(4), True), (4, 4, at(1), None, None)],
        [(2, 5, at(2), at(20), False), (5, 6, at(2), at(28), False)],  # 2 is put off
        [(6, 7, at(10), at(12), False)],  # 1 has passed
        [(7, 8, at(25), None, False)],  # 6 and 2 have passed, 5 has not
    ]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, seen = "key int, id int, at timestamp, until timestamp, pinned boolean", []
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(folder)
        E.drain(keyed.expiring(spark.readStream.schema(schema).parquet(folder), "key", "at", "id", "until", "pinned"), out, state)
        seen.append({(r["key"], r["until"].day) for r in spark.read.schema("key int, until timestamp").parquet(out).collect()})
    assert seen == [set(), set(), {(1, 5)}, {(1, 5), (2, 20), (6, 12)}]
