"""Small helpers shared by the operators: tables, scratch space, id ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BITS = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names.

    Where the setting is missing on one machine (tests) a temporary folder is
    made and set, so that later calls share it; on a cluster it must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared scratch space and read it back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_ranges(df: DataFrame, column: str, count: int, out: str = "bucket") -> DataFrame:
    """Add an int column numbering `count` ranges of an integer id, ascending.

    The bounds are approximate quantiles of the id alone, so only that column is
    read; they are `count` numbers whatever the size of the table. Rows without
    an id go to range -1, before all others. Equal ids share a range.
    """
    shares = [i / count for i in range(1, count)] or [0.5]
    row = df.select(F.percentile_approx(F.col(column).cast("long"), shares, 100 * len(shares) + 1000).alias("q")).first()
    bounds = sorted({float(x) for x in (row["q"] or [])})
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    made = Bucketizer(splits=splits, inputCol=f"__{out}_id", outputCol=f"__{out}", handleInvalid="keep").transform(
        df.withColumn(f"__{out}_id", F.col(column).cast("double"))
    )
    number = F.when(F.col(column).isNull(), -1).otherwise(F.col(f"__{out}").cast("int"))
    return made.withColumn(out, number).drop(f"__{out}_id", f"__{out}")


def code_points(column):
    return F.length(F.coalesce(column, F.lit("")))


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Bitmap of hashed keys: at most bits / 32768 rows of 1024 words."""
    at = F.pmod(key, F.lit(bits))
    maps = (
        keys.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("map_no"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    )
    word = lambda i: F.conv(F.hex(F.substring(F.col("map"), i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    signed = lambda i: F.pmod(word(i) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return maps.select("map_no", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: signed(i).cast("int")).alias("words"))


def in_bitmap(rows: DataFrame, key: Column, marks: DataFrame, bits: int) -> DataFrame:
    """Rows whose key's bit is set. The bitmap's size is bounded, so it is sent to every task."""
    at = F.pmod(key, F.lit(bits))
    place = F.bitmap_bit_position(at)
    bit = (F.lit(24) - (F.shiftright(place, 3) % 4) * 8 + place % 8).cast("int")
    joined = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("map_no"))
    return joined.where(F.getbit(F.get("words", F.shiftright(place, 5).cast("int")), bit) == 1).drop("words", "map_no")


def having(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose hashed key is among the stored keys, and some of the others.

    By two bitmaps that every task holds: 32 bits a key (one in 1,000 of the others passes), fewer where they would
    take more than 32 MB each, eight at least (one in 64 passes); or as a join when the keys are more.
    """
    count = keys.count()
    if 8 * count > MAX_BITS:
        return rows.join(keys.distinct().hint("merge"), key, "left_semi")
    bits = min(MAX_BITS, 1 << max(20, (32 * count - 1).bit_length()))
    for k in (F.col(key), F.xxhash64(key)):
        rows = in_bitmap(rows, k, stored(bitmap(keys, k, bits), "bitmap"), bits)
    return rows
