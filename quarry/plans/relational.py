"""Scans, filters, joins, set operations and versions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import filters as P
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import windows as W
from ..operators.storage import scratch
from ..streaming import events as E
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"


@query("""
SELECT doc_id, source, lang, n_chars FROM documents
WHERE (text ILIKE '%tion%' OR source ILIKE '%tion%') AND lang IN ('en', 'fr')
ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def paged_search(t: Tables) -> DataFrame:
    found = t.documents.where(P.conjunction(P.any_contains(["text", "source"], "tion"), F.col("lang").isin("en", "fr"), None))
    return P.page(found, [F.desc("n_chars"), F.asc("doc_id")], 2, 20).select("doc_id", "source", "lang", "n_chars")


@query("""
SELECT count(*) AS total, count(DISTINCT source) AS sources FROM documents WHERE text ILIKE '%tion%' AND lang = 'en'""")
def paged_total(t: Tables) -> DataFrame:
    return t.documents.where(P.any_contains(["text"], "tion") & (F.col("lang") == "en")).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("source").alias("sources"))


@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') LIKE '1%' AND props ILIKE '%k%'""")
def json_predicate(t: Tables) -> DataFrame:
    k = P.json_text("props", "$.k")
    return t.events.where(k.like("1%") & F.col("props").ilike("%k%")).select("event_id", "event_type", k.cast("long").alias("k"))


_BOUNDS = """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS low,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 1.5 END AS high FROM orders)"""


def _bounds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("low"),
                           F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 1.5).alias("high"))


@query(_BOUNDS + " SELECT o_orderkey FROM b WHERE coalesce(high, low) >= 100000 AND coalesce(low, high) <= 200000")
def nullable_range_strict(t: Tables) -> DataFrame:
    return _bounds(t).where(P.overlaps_strictly("low", "high", 100000, 200000)).select("o_orderkey")


@query(_BOUNDS + " SELECT o_orderkey FROM b WHERE (high IS NULL OR high >= 100000) AND (low IS NULL OR low <= 200000)")
def nullable_range_tolerant(t: Tables) -> DataFrame:
    return _bounds(t).where(P.overlaps_tolerantly("low", "high", 100000, 200000)).select("o_orderkey")


@query("""
WITH r AS (SELECT doc_id, list_filter([CASE WHEN source IN ('src3') THEN 'blocked_owner' END,
  CASE WHEN contains(lower(text), 'idiot') THEN 'excluded:idiot' END, CASE WHEN contains(lower(text), 'clown') THEN 'excluded:clown' END,
  CASE WHEN NOT contains(lower(text), 'the') THEN 'missing:the' END], lambda x: x IS NOT NULL) AS a FROM documents)
SELECT doc_id, len(a) = 0 AS passed, array_to_string(a, ',') AS reasons FROM r""")
def rule_filter_reasons(t: Tables) -> DataFrame:
    rule = P.rule_filter("text", "source", ["src3"], ["idiot", "clown"], ["the"])
    return t.documents.select("doc_id", rule.alias("r")).select("doc_id", "r.passed", F.array_join("r.reasons", ",").alias("reasons"))


@query(f"""
WITH last AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id),
aged AS (SELECT user_id, CAST(floor(date_diff('second', seen, TIMESTAMP '{NOW}') / 86400.0) AS BIGINT) AS days, seen FROM last)
SELECT user_id, days, CASE WHEN days >= 30 THEN 'expired' WHEN days >= 14 THEN 'possibly_expired' ELSE 'active' END AS lifecycle,
  seen >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY AS fresh FROM aged""")
def freshness_lifecycle(t: Tables) -> DataFrame:
    from ..functions.parse import lifecycle

    last = t.events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("seen"))
    days = F.floor((F.unix_timestamp(F.to_timestamp(F.lit(NOW))) - F.unix_timestamp("seen")) / 86400.0).cast("long")
    return last.select("user_id", days.alias("days"), lifecycle(days).alias("lifecycle"), P.fresh("seen", NOW).alias("fresh"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:sk-[a-z0-9_-]{12,}|(?:api[_-]?key|password)\s*[:=]\s*[^\s,}"]+|身份证(?:号|号码)?\s*[:：=]\s*\d{6,})') OR strlen(text) > 4000000""")
def sensitive_rows(t: Tables) -> DataFrame:
    return t.documents.where(P.sensitive("text")).select("doc_id")


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE value >= 10 GROUP BY event_type")
def status_facets(t: Tables) -> DataFrame:
    return A.facets(t.events, "event_type", F.col("value") >= 10).withColumnRenamed("event_type", "label")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) FILTER (o_totalprice >= 100000) AS customers FROM orders GROUP BY 1")
def distinct_threshold(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct(F.when(F.col("o_totalprice") >= 100000, F.col("o_custkey"))).alias("customers"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors,
  count(DISTINCT event_type) AS kinds, CAST(max(ts) AS VARCHAR) AS last_ts FROM events GROUP BY user_id""")
def conditional_sums(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count_if(e == "purchase").alias("purchases"), F.count_if(e == "error").alias("errors"), F.countDistinct(e).alias("kinds"),
                                           F.max("ts").cast("string").alias("last_ts"))


@query("""
SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F')""")
def all_terminal_semi_anti(t: Tables) -> DataFrame:
    return J.all_done(t.orders.select(F.col("o_orderkey")), t.lineitem, "o_orderkey", "l_orderkey", F.col("l_linestatus") != "F")


@query("""
SELECT o_orderkey, coalesce((SELECT bool_or(l_returnflag = 'R') FROM lineitem WHERE l_orderkey = o_orderkey), false) AS returned FROM orders""")
def correlated_flag(t: Tables) -> DataFrame:
    return J.flagged(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R", "returned")


@query("""
SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers, round(coalesce(sum(c.c_acctbal), 0), 2) AS balance
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0
GROUP BY 1, 2""")
def outer_join_on_predicate(t: Tables) -> DataFrame:
    known = t.customer.where("c_acctbal > 0")
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))


@query("""
SELECT c.c_custkey, coalesce(d.n, 0)::BIGINT AS documents, coalesce(d.ok, 0)::BIGINT AS compatible,
  CASE WHEN coalesce(d.n, 0) = 0 THEN 'not_built' WHEN d.ok = d.n THEN 'ready' WHEN d.ok > 0 THEN 'partial' ELSE 'needs_update' END AS status
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority <> '1-URGENT') AS ok FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) d
ON d.o_custkey = c.c_custkey""")
def index_health(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return I.health(t.customer.select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "1-URGENT")


@query("""
SELECT l.doc_id, d.source, d.doc_id IS NULL AS missing FROM (SELECT doc_id + CASE WHEN toxic = 1 THEN 100000000 ELSE 0 END AS doc_id FROM labels) l
LEFT JOIN documents d USING (doc_id)""")
def ordered_lookup_missing(t: Tables) -> DataFrame:
    asked = t.labels.select((F.col("doc_id") + F.when(F.col("toxic") == 1, 100000000).otherwise(0)).alias("doc_id"))
    return J.ordered_lookup(asked, t.documents.select("doc_id", "source"), "doc_id")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id""".replace("max((ts, event_id))[2]", "arg_max(event_id, (ts, event_id))"))
def latest_per_key(t: Tables) -> DataFrame:
    return J.latest(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


@query("""
SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS version_number,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders""")
def scd_versions(t: Tables) -> DataFrame:
    return W.versions(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version_number", "is_current")


@query("""
SELECT o_custkey, o_orderkey, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def topn_per_parent(t: Tables) -> DataFrame:
    kept, _ = W.top_per_parent(t.orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return kept.select("o_custkey", "o_orderkey", "rank")


_RUNS = """WITH a AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'click' GROUP BY 1)"""


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    mean = lambda k: t.events.where(F.col("event_type") == k).groupBy("user_id").agg(F.avg("value").alias("m"))
    return mean("view"), mean("click")


@query(_RUNS + " SELECT a.user_id, round(a.m - b.m, 6) AS m_delta FROM a JOIN b USING (user_id)")
def metric_delta(t: Tables) -> DataFrame:
    a, b = _runs(t)
    return J.delta(a, b, "user_id", ["m"]).withColumn("m_delta", F.round("m_delta", 6))


@query(_RUNS + """ SELECT count(*) FILTER (a.m - b.m > 1e-9) AS wins, count(*) FILTER (abs(a.m - b.m) <= 1e-9) AS ties,
  count(*) FILTER (a.m - b.m < -1e-9) AS losses, round(avg(a.m - b.m), 6) AS mean_delta FROM a JOIN b USING (user_id)""")
def paired_wins(t: Tables) -> DataFrame:
    a, b = _runs(t)
    return J.paired(a, b, "user_id", "m").withColumn("mean_delta", F.round("mean_delta", 6))


@query("""
WITH p AS (SELECT p_brand, p_type, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1, 2)
SELECT p_brand, p_type FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.size >= p.size AND q.price <= p.price AND (q.size > p.size OR q.price < p.price))""")
def pareto_frontier(t: Tables) -> DataFrame:
    p = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    return A.frontier(p.withColumn("k", F.concat_ws("|", "p_brand", "p_type")), "k", ["size"], ["price"]).select("p_brand", "p_type")


@query("""
WITH m AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id, event_id, previous, event_type FROM m WHERE previous IS NOT NULL AND previous <> event_type AND NOT (
  (previous = 'signup' AND event_type IN ('view', 'click')) OR (previous = 'view' AND event_type IN ('click', 'purchase', 'error'))
  OR (previous = 'click' AND event_type IN ('view', 'purchase', 'error')) OR (previous = 'purchase' AND event_type IN ('view')) OR (previous = 'error' AND event_type IN ('view', 'click')))""")
def illegal_transitions(t: Tables) -> DataFrame:
    allowed = {"signup": ("view", "click"), "view": ("click", "purchase", "error"), "click": ("view", "purchase", "error"), "purchase": ("view",), "error": ("view", "click")}
    return E.illegal_moves(t.events, "user_id", ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id", "previous", "event_type")


@query("""
SELECT user_id, event_type, CAST(min(ts) AS VARCHAR) AS first_linked_at, CAST(max(ts) AS VARCHAR) AS last_linked_at,
  arg_max(props, (ts, props)) AS props, count(*) AS n FROM events GROUP BY 1, 2""")
def link_upsert_merge(t: Tables) -> DataFrame:
    out = I.merged_links(t.events, ["user_id", "event_type"], "ts", "props")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_linked_at", "last_linked_at")})


@query("""
WITH have AS (SELECT user_id, count(*) AS n, 1 AS generation FROM events WHERE event_type = 'signup' GROUP BY 1),
inc AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, coalesce(i.n, h.n) AS n, CASE WHEN h.user_id IS NULL THEN 1 WHEN i.user_id IS NOT NULL THEN h.generation + 1 ELSE h.generation END AS generation
FROM have h FULL JOIN inc i USING (user_id)""".replace("h.user_id IS NULL", "h.n IS NULL").replace("i.user_id IS NOT NULL", "i.n IS NOT NULL"))
def keyed_upsert(t: Tables) -> DataFrame:
    have = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("generation", F.lit(1))
    return I.upsert(have, t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), ["user_id"])


@query("""
WITH s AS (SELECT DISTINCT source, md5(text) AS h FROM documents WHERE lang = 'en')
SELECT DISTINCT d.source, md5(d.text) AS h FROM documents d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source = d.source AND s.h = md5(d.text))""")
def snapshot_insert(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return I.new_snapshots(rows.where("lang = 'en'"), rows, ["source", "h"]).select("source", "h")


@query("""
WITH one AS (SELECT source, md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2) SELECT doc_id, source FROM one""")
def exact_dedup(t: Tables) -> DataFrame:
    return D.first_by(t.documents.select("doc_id", "source", "text"), [F.col("source"), F.md5("text")], ["doc_id"]).select("doc_id", "source")


@query("""
WITH f AS (SELECT doc_id, sha256(lang || '|' || regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS fp FROM documents),
g AS (SELECT fp, count(*) AS n, min(doc_id) AS first_id FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT fp AS fingerprint, n, first_id FROM g""")
def fingerprint_groups(t: Tables) -> DataFrame:
    from ..functions.text import fingerprint

    fp = fingerprint(F.col("lang"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""))
    fp = F.coalesce(fp, F.sha2(F.concat(F.col("lang"), F.lit("|")), 256))
    return A.duplicate_groups(t.documents, fp, "doc_id")


@query("""
WITH e AS (SELECT c_custkey, c_mktsegment, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, coalesce(array_to_string(k, ','), '') AS orders FROM e""")
def eager_children(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey")
    out = J.with_children(t.customer.select("c_custkey"), o, "c_custkey", "o_custkey", "kids", ["o_orderkey"])
    return out.select("c_custkey", F.array_join(F.transform("kids", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("""
WITH d AS (SELECT doc_id, md5(text) AS content_hash FROM documents), i AS (
  SELECT doc_id, CASE WHEN source = 'src5' THEN 'old' ELSE md5(text) END AS content_hash, CASE WHEN source = 'src7' THEN 'v1' ELSE 'v2' END AS version FROM documents WHERE lang <> 'fr')
SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN 'no_document' WHEN i.content_hash <> d.content_hash THEN 'content_hash' ELSE 'version' END AS reason
FROM d LEFT JOIN i USING (doc_id) WHERE i.doc_id IS NULL OR i.content_hash <> d.content_hash OR i.version <> 'v2'""")
def needs_index(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("content_hash"))
    i = d.where("lang <> 'fr'").select("doc_id", F.when(F.col("source") == "src5", "old").otherwise(F.col("content_hash")).alias("content_hash"),
                                       F.when(F.col("source") == "src7", "v1").otherwise("v2").alias("version"))
    return I.needs_index(d, i, "doc_id", {"version": "v2"}).select("doc_id", "reason")


@query("""
WITH c AS (SELECT source, md5(text) AS h FROM documents), cache AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE lang = 'en')
SELECT count(*) FILTER (h IN (SELECT h FROM cache)) AS reused, count(DISTINCT h) FILTER (h NOT IN (SELECT h FROM cache)) AS to_embed FROM c""")
def embedding_reuse(t: Tables) -> DataFrame:
    chunks = t.documents.select("doc_id", "lang", F.md5("text").alias("h"))
    cache = chunks.where("lang = 'en'").select("h", F.array(F.lit(1.0)).alias("vector"))
    hit, need = I.reuse_embeddings(chunks, cache, ["h"])
    return hit.agg(F.count(F.lit(1)).alias("reused")).crossJoin(need.agg(F.count(F.lit(1)).alias("to_embed")))


@query("""
WITH o AS (SELECT doc_id, md5(text) AS h, lang FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, md5(text) AS h, CASE WHEN source = 'src6' THEN 'xx' ELSE lang END AS lang FROM documents)
SELECT n.doc_id, n.lang FROM n LEFT JOIN o USING (doc_id) WHERE o.doc_id IS NULL OR o.h <> n.h OR o.lang IS DISTINCT FROM n.lang""")
def change_set(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("h"), "lang", "source")
    new = rows.withColumn("lang", F.when(F.col("source") == "src6", "xx").otherwise(F.col("lang")))
    return I.changed(rows.where("lang <> 'fr'"), new, "doc_id", ["h", "lang"]).select("doc_id", "lang")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_tail_dedup(t: Tables) -> DataFrame:
    """The events table as a file stream, drained into Parquet; each event once."""
    base = scratch(t.spark, "tail")
    stream = E.tail(t.spark, f"{t.folder}/events.parquet*", t.events.schema, "event_id", "ts", "400 days")
    E.drain(stream.select("event_id", "user_id", "event_type"), f"{base}/out", f"{base}/state")
    return t.spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{base}/out")
