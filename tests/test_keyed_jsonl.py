"""The keyed store: batches, repeats, failures."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.sources.keyed_jsonl import KeyedJsonl, commits

SHAPE = "id long, name string, at timestamp, day date, price decimal(10,2), tags array<string>, size double"


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(KeyedJsonl)
    path = str(tmp_path / "store")

    def put(df, batch, **options):
        df.write.format("keyed_jsonl").options(path=path, key="id", batch=batch, **options).mode("append").save()

    def get(schema=SHAPE):
        return spark.read.format("keyed_jsonl").option("key", "id").schema(schema).load(path)

    return path, put, get


def test_last_batch_wins_and_repeats_change_nothing(spark, store):
    path, put, get = store
    t, d, p = datetime.datetime(2024, 1, 2, 3, 4, 5, 678), datetime.date(2024, 1, 2), decimal.Decimal("1.50")
    rows = [(k, f"né {k}\n", t, d, p, ["a", None], k / 3) for k in range(200)] + [(None, "lone", None, None, None, None, None)] * 2
    put(spark.createDataFrame(rows, SHAPE).repartition(5), "b1", buckets="7")
    put(spark.createDataFrame([(k, "new", None, None, None, [], None) for k in range(150, 250)], SHAPE), "b2", buckets="99")
    want = Counter((r[0], r[1]) for r in rows[:150]) + Counter((k, "new") for k in range(150, 250)) + Counter({(None, "lone"): 2})
    assert Counter((r["id"], r["name"]) for r in get().collect()) == want
    first = get().where("id = 3").first()
    assert tuple(first) == (3, "né 3\n", t, d, p, ["a", None], 1.0)
    before, data = commits(path), set(Path(path, "data").iterdir())
    put(spark.createDataFrame([(1, "again", None, None, None, None, None)], SHAPE), "b2")
    assert commits(path) == before and set(Path(path, "data").iterdir()) == data
    assert [c["buckets"] for c in before] == [7, 7] and get().rdd.getNumPartitions() <= 7
    assert get("id long, other string").where("id = 1").first()["other"] is None


def test_failed_write_leaves_no_row(spark, store):
    path, put, get = store
    put(spark.createDataFrame([(1, "kept")], "id long, name string"), "b1")
    bad = spark.range(2, 1000, 1, 4).select("id", F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("name"))
    with pytest.raises(Exception, match="lost"):
        put(bad, "b2")
    assert [c["batch"] for c in commits(path)] == ["b1"]
    assert [tuple(r) for r in get("id long, name string").collect()] == [(1, "kept")]
    put(spark.range(2, 5).select("id", F.lit("x").alias("name")), "b2")
    assert sorted(r["id"] for r in get("id long, name string").collect()) == [1, 2, 3, 4]


def test_staged_files_are_no_rows_and_bad_lines_are_named(spark, store):
    path, put, get = store
    assert get("id long, name string").count() == 0
    put(spark.createDataFrame([(1, "kept")], "id long, name string"), "b1")
    Path(path, "data", "00000-lost.jsonl").write_text('{"id": 9, "name": "lost"}\n')
    assert [r["id"] for r in get("id long, name string").collect()] == [1]
    with pytest.raises(Exception, match="mode append"):
        spark.range(1).write.format("keyed_jsonl").options(path=path, key="id").mode("overwrite").save()
    name = commits(path)[0]["files"][0][1]
    Path(path, "data", name).write_text("{broken\n")
    with pytest.raises(Exception, match=name):
        get("id long, name string").collect()
