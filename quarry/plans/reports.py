"""Market reports, evidence, comparisons, checks and resumption over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import postings as P
from ..operators import reports as R
from .registry import Tables, query


@query("""
WITH s AS (SELECT p_partkey, p_size, CASE WHEN contains(lower(p_name), 'cold widget') THEN 16.0 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])cold widget($|[^a-z0-9])') THEN 16.5 WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])cold widget($|[^a-z0-9])') THEN 11 ELSE 0 END
  + CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])widget($|[^a-z0-9])') THEN 9 WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])widget($|[^a-z0-9])') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])cold($|[^a-z0-9])') THEN 6 WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])cold($|[^a-z0-9])') THEN 4 ELSE 0 END AS relevance FROM part)
SELECT p_partkey, p_size, relevance::DOUBLE AS relevance FROM s WHERE relevance >= 2 ORDER BY relevance DESC, p_size DESC, p_partkey LIMIT 100""")
def market_report(t: Tables) -> DataFrame:
    """The hundred most relevant parts for a query."""
    return R.market_report(t.part, "p_name", "p_type", "p_brand", "p_size", "p_partkey", "cold widget").select("p_partkey", "p_size", "relevance")


@query("""
WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
n AS (SELECT user_id, list(event_type ORDER BY r) FILTER (r <= 10) AS a FROM c GROUP BY 1),
p AS (SELECT user_id, CASE WHEN len(a) > 4 THEN a[5:] ELSE a END AS b, a FROM n)
SELECT user_id, '1-2' AS weeks, array_to_string(a[1:3], ',') AS names FROM p
UNION ALL SELECT user_id, '3-5', array_to_string(list_concat(a[1:4], b[1:2]), ',') FROM p
UNION ALL SELECT user_id, '6-8', array_to_string(b[1:4], ',') FROM p
UNION ALL SELECT user_id, '9-10', array_to_string(a[9:10], ',') FROM p
UNION ALL SELECT user_id, '11-12', array_to_string(a[1:4], ',') FROM p""")
def learning_roadmap(t: Tables) -> DataFrame:
    """Each user's most frequent event types dealt to five phases."""
    phases = R.ranked_names(t.events, "user_id", "event_type").select("user_id", F.explode(R.roadmap(F.col("names"))).alias("p"))
    return phases.select("user_id", "p.weeks", F.array_join("p.names", ",").alias("names"))


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority IN ('1-URGENT', '2-HIGH') AS from_fallback FROM orders WHERE o_orderstatus = 'F'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority IN ('1-URGENT', '2-HIGH'), o_orderdate DESC, o_orderkey DESC) = 1""")
def reusable_result(t: Tables) -> DataFrame:
    fallback = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return R.reusable(t.orders, "o_custkey", F.col("o_orderstatus") == "F", fallback, "o_orderdate", "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS updated_at, count(*) OVER (PARTITION BY l_orderkey) AS tasks FROM lineitem""")
def ordered_children(t: Tables) -> DataFrame:
    return R.ordered_children(t.lineitem, "l_orderkey", "l_shipdate", "l_linenumber")


@query("""
SELECT user_id, event_type, min(event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type)::INTEGER AS place FROM events GROUP BY 1, 2""")
def first_seen(t: Tables) -> DataFrame:
    return R.first_seen(t.events, "user_id", "event_type", "event_id")


@query(r"""
WITH n AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lower(coalesce(text, '')) AS a, lower(coalesce(lag(text) OVER w, '')) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)),
m AS (SELECT *, list_distinct(regexp_extract_all(a, '[a-z][a-z0-9+#.\-]+|[一-鿿]{2,}')) AS x, list_distinct(regexp_extract_all(b, '[a-z][a-z0-9+#.\-]+|[一-鿿]{2,}')) AS y FROM n)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'UNRELATED' WHEN a = b THEN 'SAME' WHEN len(y) > 0 AND list_has_all(x, y) AND len(x) > len(y) THEN 'EXTENDS'
  WHEN regexp_matches(a, '正在|学完|已经|优先|只考虑') OR regexp_matches(b, '正在|学完|已经|优先|只考虑') THEN 'UPDATES' ELSE 'CONFLICTS' END AS relation FROM m""")
def note_relations(t: Tables) -> DataFrame:
    """Each turn against the turn of the same role before it."""
    back = R.Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(back).alias("old"), F.lag("role").over(back).isNotNull().alias("same"))
    return rows.select("conv_id", "turn", R.relation(F.col("text"), F.col("old"), F.col("same")).alias("relation"))


@query(r"""
WITH h AS (SELECT doc_id, text, regexp_extract(text, 'th[a-z]*and[a-z]*') AS hit FROM documents)
SELECT doc_id, substring(text, greatest(1, instr(text, hit) - 70), instr(text, hit) + length(hit) + 100 - greatest(1, instr(text, hit) - 70)) AS evidence FROM h WHERE hit <> ''""")
def evidence_windows(t: Tables) -> DataFrame:
    """What is around the first match of a pattern in each document."""
    return t.documents.select("doc_id", R.evidence_window(F.col("text"), "th[a-z]*and[a-z]*").alias("evidence")).where("evidence IS NOT NULL")


@query(r"""
WITH l AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
b AS (SELECT *, regexp_replace(lower(lines[1]), '[^\p{L}\p{N}_+#]+', '', 'g') AS head, regexp_replace(lower(lines[-1]), '[^\p{L}\p{N}_+#]+', '', 'g') AS tail FROM l)
SELECT conv_id, turn, len(list_distinct(list_filter(lines, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_+#]+', '', 'g') <> '' AND
  NOT ((length(head) >= 6 AND contains(head, regexp_replace(lower(x), '[^\p{L}\p{N}_+#]+', '', 'g'))) OR (length(tail) >= 6 AND contains(tail, regexp_replace(lower(x), '[^\p{L}\p{N}_+#]+', '', 'g')))))))::INTEGER AS uncovered FROM b""")
def uncovered_lines(t: Tables) -> DataFrame:
    """Lines of each turn that its first and last line don't hold."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    ends = F.array(F.element_at(lines, 1), F.element_at(lines, -1))
    return t.conversations.select("conv_id", "turn", F.size(R.uncovered_lines(F.col("text"), ends)).alias("uncovered"))


@query("""
WITH g AS (SELECT event_id, user_id, ts, floor(value)::BIGINT AS generation FROM events)
SELECT event_id, coalesce(generation >= max(generation) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM g""")
def fenced_writes(t: Tables) -> DataFrame:
    """Writes of a generation that a later one has not overtaken."""
    rows = t.events.select("event_id", "user_id", "ts", F.floor("value").alias("generation"))
    return R.fenced(rows, "user_id", ["ts", "event_id"], "generation").select("event_id", "accepted")


@query("""
WITH c AS (SELECT l_orderkey AS o_orderkey, bool_and(l_linestatus = 'F') AS done, count(*) AS tried FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(tried, 0) AS tried FROM orders LEFT JOIN c USING (o_orderkey) WHERE NOT coalesce(done, false) AND coalesce(tried, 0) < 5""")
def pending_items(t: Tables) -> DataFrame:
    """Orders to take up again: some line open, tried fewer than five times."""
    known = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("done"), F.count(F.lit(1)).alias("tried"))
    return R.pending(t.orders.select("o_orderkey"), known, "o_orderkey").select("o_orderkey", F.coalesce("tried", F.lit(0)).alias("tried"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter(['that', 'with', 'from', 'which'], lambda v: contains(lower(coalesce(text, '')), v)), ',') AS named FROM conversations""")
def named_values(t: Tables) -> DataFrame:
    named = R.named_in(F.col("text"), ["that", "with", "from", "which"])
    return t.conversations.select("conv_id", "turn", F.array_join(named, ",").alias("named"))


@query("""
WITH d AS (SELECT len(embedding) AS d, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY n DESC, d DESC LIMIT 1),
r AS (SELECT label, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> (SELECT d FROM d) THEN 'dimensions'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' END AS reason FROM embeddings)
SELECT label, coalesce(reason, 'usable') AS reason, count(*) AS n FROM r GROUP BY 1, 2""")
def vector_guard(t: Tables) -> DataFrame:
    """Vectors that can be searched, and why the others can't, by label; the most frequent length is the table's."""
    sizes = t.embeddings.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return R.guarded(t.embeddings, "embedding", usual or 0).groupBy("label", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_linenumber) AS last, sum(l_extendedprice) AS s, min(l_shipdate) AS d FROM lineitem GROUP BY 1)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(n > 0, false) THEN 'found' END, CASE WHEN NOT coalesce(n = last, false) THEN 'count' END,
  CASE WHEN NOT coalesce(d >= o_orderdate, false) THEN 'dates' END, CASE WHEN NOT coalesce(s >= o_totalprice, false) THEN 'total' END], lambda x: x IS NOT NULL), ',') AS failed FROM orders LEFT JOIN l USING (o_orderkey)""")
def consistency_checks(t: Tables) -> DataFrame:
    """What doesn't hold between an order and its lines."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"), F.sum("l_extendedprice").alias("s"), F.min("l_shipdate").alias("d"))
    checks = {"found": F.col("n") > 0, "count": F.col("n") == F.col("last"), "dates": F.col("d") >= F.col("o_orderdate"), "total": F.col("s") >= F.col("o_totalprice")}
    return R.consistent(t.orders.join(lines, "o_orderkey", "left"), checks).select("o_orderkey", F.array_join("failed", ",").alias("failed"))


@query("""
WITH h AS (SELECT l_partkey, l_suppkey, 0.65 * max(l_discount) + 0.35 * max(l_tax) AS score FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) AS rank FROM h) WHERE rank <= 4""")
def evidence_hits(t: Tables) -> DataFrame:
    return R.evidence_hits(t.lineitem, "l_partkey", "l_suppkey", "l_discount", "l_tax")


@query("""
WITH g AS (SELECT l_returnflag, l_linestatus, l_linenumber % 2 AS part, l_quantity - 10 AS relevant, l_discount, l_tax, l_extendedprice AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, part, count(*) FILTER (relevant > 0) AS answerable, count(*) FILTER (NOT coalesce(relevant > 0, false)) AS unanswerable,
  round(avg(l_discount) FILTER (relevant > 0), 6) AS l_discount, round(avg(l_tax) FILTER (relevant > 0), 6) AS l_tax, round(median(v), 4) AS p50,
  list_sort(list(v))[1 + greatest(0, least(count(*) - 1, floor(count(*) * 0.95::DOUBLE)::BIGINT - 1))] AS p95 FROM g GROUP BY 1, 2, 3""")
def config_summary(t: Tables) -> DataFrame:
    """Means and latencies of each combination of three settings."""
    rows = t.lineitem.withColumn("part", F.col("l_linenumber") % 2).withColumn("relevant", F.col("l_quantity") - 10)
    out = R.config_summary(rows, ["l_returnflag", "l_linestatus", "part"], "relevant", ["l_discount", "l_tax"], "l_extendedprice")
    return out.withColumns({"l_discount": F.round("l_discount", 6), "l_tax": F.round("l_tax", 6), "p50": F.round("p50", 4)})


@query(r"""
SELECT p_partkey FROM part WHERE list_has_all(regexp_extract_all(lower(coalesce(p_name, '')), '[\p{L}\p{N}]+'), ['widget', 'cold']) OR list_has_all(regexp_extract_all(lower(coalesce(p_type, '')), '[\p{L}\p{N}]+'), ['widget', 'cold'])
  OR contains(lower(coalesce(p_name, '')), 'widget cold') OR contains(lower(coalesce(p_type, '')), 'widget cold') OR contains(lower(coalesce(p_name, '')), 'promo') OR contains(lower(coalesce(p_type, '')), 'promo')""")
def full_text_match(t: Tables) -> DataFrame:
    """Parts that hold all words of a query, or one of its expansions."""
    return t.part.where(R.text_match([F.col("p_name"), F.col("p_type")], "widget cold", ("promo",))).select("p_partkey")


@query(r"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber::VARCHAR || '-' || (l_linenumber + 2)::VARCHAR || '年' AS x,
  CASE l_returnflag WHEN 'R' THEN '硕士优先，本科及以上' WHEN 'A' THEN '大专以上，本科优先' ELSE '学历不限' END AS e, (l_linenumber * 4)::VARCHAR || '-' || (l_linenumber * 5)::VARCHAR || 'K·' || (11 + l_linenumber)::VARCHAR || '薪' AS p FROM lineitem),
n AS (SELECT *, CAST(regexp_extract(x, '^(\d+)-', 1) AS INT) AS low, CAST(regexp_extract(x, '-(\d+)年', 1) AS INT) AS high FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN low >= 5 THEN '5年以上' WHEN low >= 3 THEN '3-5年' WHEN high <= 1 THEN '1年以内' ELSE '1-3年' END AS record_x,
  CASE WHEN high <= 1 THEN '1年以内' WHEN high <= 3 THEN '1-3年' WHEN high <= 5 THEN '3-5年' ELSE '5年以上' END AS market_x, x AS corpus_x,
  CASE WHEN e LIKE '%不限%' THEN '学历不限' WHEN e LIKE '%硕士%' THEN '硕士' WHEN e LIKE '%本科%' THEN '本科' ELSE '大专' END AS record_e,
  CASE WHEN e LIKE '%不限%' THEN '学历不限' WHEN e LIKE '%硕士%' THEN '硕士及以上' WHEN e LIKE '%本科%' THEN '本科及以上' ELSE '大专及以上' END AS search_e,
  CASE WHEN e LIKE '%不限%' THEN '学历不限' WHEN e LIKE '硕士%' THEN '硕士及以上' ELSE '大专及以上' END AS market_e,
  1000 * CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT) AS minimum, 1000 * CAST(regexp_extract(p, '-(\d+)K', 1) AS BIGINT) AS maximum, CAST(regexp_extract(p, '(\d+)薪', 1) AS INTEGER) AS months FROM n""")
def posting_labels(t: Tables) -> DataFrame:
    """Labels of schooling, experience and pay texts that are made from line items."""
    n = F.col("l_linenumber")
    x = F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit("年"))
    e = F.when(F.col("l_returnflag") == "R", "硕士优先，本科及以上").when(F.col("l_returnflag") == "A", "大专以上，本科优先").otherwise("学历不限")
    p = P.platform_pay(F.concat((n * 4).cast("string"), F.lit("-"), (n * 5).cast("string"), F.lit("K·"), (n + 11).cast("string"), F.lit("薪")))
    return t.lineitem.withColumn("pay", p).select(
        "l_orderkey", "l_linenumber", P.record_experience(x).alias("record_x"), P.market_experience(x).alias("market_x"), P.corpus_experience(x, F.lit("")).alias("corpus_x"),
        P.record_education(e).alias("record_e"), P.search_education(e).alias("search_e"), P.market_education(e).alias("market_e"), "pay.minimum", "pay.maximum", "pay.months")
