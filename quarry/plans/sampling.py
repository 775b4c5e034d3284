"""Balanced samples and seeded intervals; sequential by definition, so tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import sampling as S
from .registry import Tables, query


@query()
def coverage_sample(t: Tables) -> DataFrame:
    """A sample of 200 documents that covers languages, sources, lengths and labels as they occur."""
    docs = t.documents.where("doc_id IS NOT NULL").join(t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    rows = docs.select("doc_id", "lang", "source", F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).alias("size"), "quality", "toxic")
    return S.coverage_sample(rows, "doc_id", ["lang", "source", "size", "quality", "toxic"], 200)


@query()
def seeded_interval(t: Tables) -> DataFrame:
    """The mean quality of labelled documents with its interval over 1,000 rounds."""
    return S.seeded_interval(t.labels, "doc_id", "quality")


@query()
def seeded_topic_interval(t: Tables) -> DataFrame:
    """Interval of the users' values against ten, users resampled whole."""
    return S.seeded_topic_interval(t.events.select("user_id", (F.col("value") - 10).alias("delta")), "user_id", "delta")


@query()
def metric_report(t: Tables) -> DataFrame:
    """Quality and toxicity of the labelled documents: overall with intervals, and by language and source."""
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    out = None
    for n, metric in enumerate(("quality", "toxic")):
        whole = S.seeded_interval(rows, "doc_id", metric, seed=20260910 + n).select(
            F.lit(metric).alias("metric"), F.lit("all").alias("dimension"), F.lit("all").alias("slice"), "n", "mean", "low", "high")
        none = F.lit(None).cast("double")
        parts = A.slices(rows, ["lang", "source"], metric).select(F.lit(metric).alias("metric"), "dimension", "slice", "n", "mean", none.alias("low"), none.alias("high"))
        out = whole.unionByName(parts) if out is None else out.unionByName(whole).unionByName(parts)
    return out
