"""Distributions, bands, dashboards, agreement and other aggregates over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import scoring as S
from ..operators import windows as W
from .registry import Tables, query


@query("""
SELECT CASE WHEN coalesce(trim(lang), '') = '' THEN 'unspecified' ELSE lang END AS label, count(*) AS n,
  round_even(100.0 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 1) AS pct FROM documents GROUP BY 1""")
def distribution_pct(t: Tables) -> DataFrame:
    return A.distribution(t.documents, F.col("lang"))


@query("""
WITH v AS (SELECT o_orderpriority AS unit, coalesce((low + high) / 2, low, high) AS v FROM (
  SELECT o_orderpriority, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS low, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.5::DOUBLE END AS high FROM orders))
SELECT unit, count(*) AS n, round(min(v), 4) AS low, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median,
  round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS high FROM v WHERE v IS NOT NULL GROUP BY unit""")
def percentile_bands(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1.5).alias("b"))
    out = A.bands(rows, "o_orderpriority", "a", "b")
    return out.withColumns({c: F.round(c, 4) for c in ("low", "p25", "median", "p75", "high")})


@query("""
WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, n, v[greatest(0, floor(n * 0.95)::BIGINT - 1) + 1] AS p_floor, v[ceil(n * 0.95)::BIGINT] AS p_ceil FROM s""")
def discrete_p95(t: Tables) -> DataFrame:
    return A.discrete_percentile(t.events, "event_type", "value")


@query("""
SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('view', 'click')) AS open,
  CAST(sum(greatest(CAST(json_extract_string(props, '$.k') AS BIGINT) - 50, 0)) AS BIGINT) AS retries, round(avg(value), 2) AS mean_value,
  round(quantile_cont(value, 0.5), 4) AS median_value, count(DISTINCT user_id) AS users FROM events""")
def dashboard_snapshot(t: Tables) -> DataFrame:
    e, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    sums = t.events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(e == "error").alias("failed"), F.count_if(e.isin("view", "click")).alias("open"),
        F.sum(F.greatest(k - 50, F.lit(0))).alias("retries"), F.round(F.avg("value"), 2).alias("mean_value"),
        F.countDistinct("user_id").alias("users"),
    )
    middle = A.quantiles(t.events.select(F.lit(0).alias("all"), "value"), ["all"], "value", {"median_value": 0.5})
    return sums.join(F.broadcast(middle.select(F.round("median_value", 4).alias("median_value"))), F.lit(True), "left")


@query("""
WITH c AS (SELECT user_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 95 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS cost FROM events)
SELECT user_id, count(*) AS runs, CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN CAST(sum(cost) AS DOUBLE) END AS cost FROM c GROUP BY 1""")
def null_poisoned_cost(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select("user_id", F.when(k < 95, k).alias("cost"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), A.total_or_null("cost").cast("double").alias("cost"))


@query("""
SELECT l_suppkey, round(sum(l_extendedprice * greatest(0.1, l_quantity * l_discount)) / sum(greatest(0.1, l_quantity * l_discount)), 4) AS weighted_mean FROM lineitem GROUP BY 1""")
def weighted_mean(t: Tables) -> DataFrame:
    out = A.weighted_mean(t.lineitem, "l_suppkey", F.col("l_extendedprice"), F.col("l_quantity") * F.col("l_discount"))
    return out.withColumn("weighted_mean", F.round("weighted_mean", 4))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events)
SELECT user_id, round(sum(value / r) / sum(1.0::DOUBLE / r), 6) AS rr_mean FROM r WHERE r <= 3 GROUP BY 1""")
def rr_weighted_top3(t: Tables) -> DataFrame:
    return A.reciprocal_top(t.events, "user_id", "value", "event_id").withColumn("rr_mean", F.round("rr_mean", 6))


@query("""
WITH u AS (SELECT 'lang' AS dimension, lang AS slice, n_chars FROM documents UNION ALL SELECT 'source', source, n_chars FROM documents)
SELECT dimension, slice, count(n_chars) AS n, round(avg(n_chars), 4) AS mean FROM u GROUP BY 1, 2""")
def slice_means(t: Tables) -> DataFrame:
    return A.slices(t.documents, ["lang", "source"], "n_chars").withColumn("mean", F.round("mean", 4))


@query("""
WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
n AS (SELECT sum(c) AS n FROM c), ra AS (SELECT a, sum(c) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(c) AS nb FROM c GROUP BY 1),
e AS (SELECT sum(CASE WHEN a = b THEN na * nb ELSE 0 END) AS same, sum((a - b) ** 2 * na * nb) AS far FROM ra, rb),
s AS (SELECT sum(CASE WHEN a = b THEN c ELSE 0 END) AS hit, sum((a - b) ** 2 * c) AS off FROM c)
SELECT n::BIGINT AS n, round(hit / n, 6) AS agreement, round((hit / n - same / (n * n)) / (1 - same / (n * n)), 6) AS kappa, round(1 - off * n / far, 6) AS weighted_kappa FROM n, e, s""")
def agreement_kappa(t: Tables) -> DataFrame:
    out = A.agreement(t.labels, "quality", "toxic")
    return out.withColumns({c: F.round(c, 6) for c in ("agreement", "kappa", "weighted_kappa")})


@query("SELECT doc_id, quality, toxic FROM labels WHERE abs(quality - toxic) >= 1 AND quality = 1")
def annotation_conflicts(t: Tables) -> DataFrame:
    return t.labels.where((F.abs(F.col("quality") - F.col("toxic")) >= 1) & (F.col("quality") == 1)).select("doc_id", "quality", "toxic")


@query("""
WITH s AS (SELECT quality = 1 AS t, d.n_chars >= 1500 AS p FROM labels JOIN documents d USING (doc_id)),
c AS (SELECT count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM s)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate FROM c""")
def binary_metrics(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = A.binary_scores(joined, F.col("quality") == 1, F.col("n_chars") >= 1500)
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return A.bootstrap(joined, "source", "quality", 500)


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents),
n AS (SELECT count(*) AS total FROM documents)
SELECT term, count(*) AS n, round_even(100.0 * count(*) / total::DOUBLE, 1) AS pct, min(doc_id) AS first_id FROM w, n GROUP BY term, total ORDER BY n DESC, term LIMIT 50""")
def term_demand(t: Tables) -> DataFrame:
    from ..functions.text import ascii_tokens

    words = t.documents.select("doc_id", F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    total = t.documents.agg(F.count(F.lit(1)).alias("total"))
    top = counts.orderBy(F.desc("n"), "term").limit(50)
    return top.crossJoin(F.broadcast(total)).select("term", "n", F.bround(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), "first_id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, line, unnest([CASE WHEN contains(lower(line), 'license') THEN 'license' END, CASE WHEN contains(lower(line), 'token') THEN 'secret' END,
  CASE WHEN contains(lower(line), '@') THEN 'contact' END]) AS theme FROM l)
SELECT theme, count(DISTINCT doc_id) AS documents, count(*) AS lines FROM h WHERE theme IS NOT NULL GROUP BY 1""")
def themes(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    low = F.lower("line")
    found = F.array_compact(F.array(F.when(low.contains("license"), "license"), F.when(low.contains("token"), "secret"), F.when(low.contains("@"), "contact")))
    return lines.select("doc_id", F.explode(found).alias("theme")).groupBy("theme").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("lines"))


@query("""
WITH s AS (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r1 FROM documents),
a AS (SELECT *, row_number() OVER (ORDER BY abs(hash_key), doc_id) AS r2 FROM (SELECT *, n_chars % 97 AS hash_key FROM s WHERE r1 <= 100)),
b AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r3 FROM a WHERE r2 <= 30)
SELECT 1 AS stage_no, 'length' AS stage, doc_id, n_chars::DOUBLE AS score, r1 <= 100 AS selected FROM s
UNION ALL SELECT 2, 'spread', doc_id, 0.0::DOUBLE - hash_key, r2 <= 30 FROM a UNION ALL SELECT 3, 'age', doc_id, 0.0::DOUBLE - doc_id, r3 <= 10 FROM b""")
def cascade_trace(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("length"), (0 - F.col("n_chars") % 97).cast("double").alias("spread"), (0 - F.col("doc_id")).cast("double").alias("age"))
    _, trace = S.cascade(rows, "doc_id", [("length", "length", 100), ("spread", "spread", 30), ("age", "age", 10)])
    return trace


@query("""
WITH s AS (SELECT *, ('0x' || substr(md5(source), 1, 8))::BIGINT % 100 AS spot FROM documents)
SELECT doc_id, CASE WHEN spot < 60 THEN 'train' WHEN spot < 80 THEN 'dev' ELSE 'test' END AS split FROM s""")
def grouped_split(t: Tables) -> DataFrame:
    return W.grouped_split(t.documents, "source").select("doc_id", "split")


@query("""
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 3""")
def stratified_quota(t: Tables) -> DataFrame:
    return W.stratified(t.documents, ["lang", "source"], "doc_id", 3).select("doc_id", "lang", "source")


@query("""
WITH r AS (SELECT l_orderkey, l_returnflag, l_quantity >= 20 AS met, CASE l_returnflag WHEN 'R' THEN 'ANY_OF' WHEN 'A' THEN 'ALL_OF' ELSE 'AT_LEAST_N' END AS relation FROM lineitem)
SELECT l_orderkey, l_returnflag, count(*) AS members, count(*) FILTER (met) AS met,
  count(*) FILTER (met) >= CASE min(relation) WHEN 'ALL_OF' THEN count(*) WHEN 'ANY_OF' THEN 1 ELSE 2 END AS satisfied FROM r GROUP BY 1, 2""")
def requirement_groups(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = t.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_quantity") >= 20).alias("met"), F.when(flag == "R", "ANY_OF").when(flag == "A", "ALL_OF").otherwise("AT_LEAST_N").alias("relation"),
                             F.lit(2).cast("long").alias("at_least"), F.col("l_quantity").alias("importance"), F.col("l_discount").alias("specificity"), F.col("l_partkey").alias("name"))
    return S.resolve_groups(rows, ["l_orderkey", "l_returnflag"]).drop("representative")


@query("""
WITH x AS (SELECT c_custkey, least(100.0, greatest(20.0, 100.0 * (c_custkey % 9) / 5)) AS e, CASE WHEN c_nationkey >= 12 THEN 100.0 WHEN c_nationkey = 11 THEN 45.0 ELSE 0.0 END AS d,
  CASE WHEN c_acctbal > 0 THEN 100.0 END AS p FROM customer)
SELECT c_custkey, round(((e * 0.15 + d * 0.10 + CASE WHEN p IS NULL THEN 0 ELSE p * 0.10 END) / (0.25 + CASE WHEN p IS NULL THEN 0 ELSE 0.10 END))::DOUBLE, 6) AS score FROM x""")
def weighted_scores(t: Tables) -> DataFrame:
    parts = {"experience": S.experience_score(F.col("c_custkey") % 9, F.lit(5)), "education": S.education_score(F.col("c_nationkey"), F.lit(12)),
             "preference": F.when(F.col("c_acctbal") > 0, 100.0)}
    return t.customer.select("c_custkey", F.round(S.final_score(parts), 6).alias("score"))


@query("""
WITH f AS (SELECT l_suppkey, lower(l_returnflag || l_linenumber) AS term, max(CASE WHEN l_linestatus = 'F' THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1, 2),
o AS (SELECT count(*) AS owners FROM supplier),
c AS (SELECT term, count(*) AS n, count(*) FILTER (r = 2) AS required, count(*) FILTER (r = 1) AS preferred FROM f GROUP BY 1)
SELECT term, n, required, preferred, CASE WHEN required / owners >= 0.5 THEN 'core' WHEN 100.0 * n / owners >= 25 THEN 'high_frequency' WHEN preferred > required THEN 'bonus' ELSE 'emerging' END AS category FROM c, o""")
def term_categories(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "F", "required").when(F.col("l_quantity") > 25, "preferred").otherwise("inferred")
    facts = t.lineitem.select("l_suppkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("term"), kind.alias("kind"))
    return A.term_categories(facts, "l_suppkey", "term", "kind", t.supplier.count())


@query("""
WITH c AS (SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' ELSE 'other' END AS role, p_brand AS title, count(*) AS c FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY c DESC, title) AS r FROM c)
SELECT role, CAST(sum(c) AS BIGINT) AS n, string_agg(title, ',' ORDER BY r) FILTER (r <= 5) AS titles FROM r GROUP BY role""")
def role_clusters(t: Tables) -> DataFrame:
    from ..functions.parse import ordered_rules

    out = A.clusters(t.part, ordered_rules(F.col("p_type"), [("steel", "steel"), ("brass", "brass")], "other"), "p_brand")
    return out.withColumn("titles", F.array_join("titles", ","))


@query("""
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, round_even(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 1) AS pct FROM orders GROUP BY 1""")
def annotation_progress(t: Tables) -> DataFrame:
    return A.progress(t.orders, "o_orderpriority", "o_orderstatus", ("F",))


@query("SELECT count(DISTINCT user_id) AS ids, CAST(max(ts) AS VARCHAR) AS max_ts, CAST(max(event_id) AS VARCHAR) AS max_event_id FROM events")
def data_watermark(t: Tables) -> DataFrame:
    return A.watermark(t.events, "user_id", "ts", "event_id")


@query("""
WITH a AS (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars < 1500 GROUP BY 1, 2), b AS (SELECT source, lang, count(*) AS m FROM documents WHERE n_chars >= 500 GROUP BY 1, 2)
SELECT source, CAST(sum(least(n, m)) AS BIGINT) AS shared FROM a JOIN b USING (source, lang) GROUP BY 1""")
def multiset_overlap(t: Tables) -> DataFrame:
    from ..operators.joins import multiset_overlap as shared

    return shared(t.documents.where("n_chars < 1500"), t.documents.where("n_chars >= 500"), "source", "lang")


@query("""
WITH d AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS q, count(*)::DOUBLE AS latency FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, round(avg(q), 4) AS mean_quality, round(min(latency), 4) AS best_latency, count(*) AS configs FROM d GROUP BY 1""")
def ablation_summary(t: Tables) -> DataFrame:
    d = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("q"), F.count(F.lit(1)).cast("double").alias("latency"))
    return d.groupBy("c_mktsegment").agg(F.round(F.avg("q"), 4).alias("mean_quality"), F.round(F.min("latency"), 4).alias("best_latency"), F.count(F.lit(1)).alias("configs"))
