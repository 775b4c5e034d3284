"""Tables written to a keyed store in batches and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import scratch
from ..sources.keyed_jsonl import KeyedJsonl
from .registry import Tables, query


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 5 = 2 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey % 5 = 2 THEN 1 ELSE 0 END AS version
FROM customer WHERE c_nationkey % 5 <> 4 UNION ALL SELECT c_custkey, 'new', 1 FROM customer WHERE c_nationkey % 5 = 4 AND c_custkey % 2 = 0""")
def keyed_store(t: Tables) -> DataFrame:
    """Customers in two batches: the second changes some and adds some; it is written twice, which changes nothing."""
    t.spark.dataSource.register(KeyedJsonl)
    path, nation = scratch(t.spark, "keyed-store"), F.col("c_nationkey") % 5
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), nation.alias("n"))
    first = rows.where("n <> 4").select("c_custkey", "segment", F.lit(0).alias("version"))
    changed = rows.where("n = 2").select("c_custkey", F.concat(F.upper("segment"), F.lit("!")).alias("segment"), F.lit(1).alias("version"))
    added = rows.where("n = 4 AND c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("segment"), F.lit(1).alias("version"))
    for batch, some in (("first", first), ("second", changed.unionByName(added)), ("second", added.withColumn("segment", F.lit("again")))):
        some.write.format("keyed_jsonl").option("path", path).option("key", "c_custkey").option("batch", batch).mode("append").save()
    return t.spark.read.format("keyed_jsonl").option("key", "c_custkey").schema("c_custkey long, segment string, version int").load(path)
