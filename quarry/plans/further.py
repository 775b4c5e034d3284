"""Search from text to hits and statistics, and the smaller scores and upkeep forms, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import scoring as S
from ..operators import windows as W
from ..operators.storage import stored
from ..sources import records
from . import documents as D
from .registry import Tables, query

_POOL = D._FUSED[: D._FUSED.rindex("SELECT item_id, doc_id, fused, final, rank::INTEGER")]


def _pool(t: Tables) -> DataFrame:
    """All fused hits of the two channels, ranked again."""
    found = D._channels(t, 20)
    hits = found["overlap"].select("item_id", "doc_id", F.col("rank").alias("full_rank"), F.col("score").alias("lexical")).join(
        found["bm25"].select("item_id", "doc_id", F.col("rank").alias("vector_rank"), F.least(F.lit(1.0), F.col("score") / 20.0).alias("semantic")), ["item_id", "doc_id"], "full")
    weight = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.94).otherwise(0.45)
    rows = hits.join(t.documents.select("doc_id", "source", weight.alias("section")), "doc_id").withColumn("title", F.coalesce("lexical", F.lit(0.0)))
    return R.reranked(rows, "item_id", "doc_id", "hybrid", 40).drop("rank")


_DIVERSE = _POOL + """,
y AS (SELECT z2.*, d.source, row_number() OVER (PARTITION BY item_id, d.source ORDER BY final DESC, fused DESC, doc_id) AS g FROM z2 JOIN documents d USING (doc_id)),
top8 AS (SELECT item_id, doc_id, source, final, row_number() OVER (PARTITION BY item_id ORDER BY g, final DESC, fused DESC, doc_id) AS rank FROM y WHERE g <= 2)"""


@query(_DIVERSE + " SELECT item_id, doc_id, source, final, rank::INTEGER AS rank FROM top8 WHERE rank <= 8")
def search_hits(t: Tables) -> DataFrame:
    """One call from the items' texts to hits: two channels, fused, ranked again, at most two of a source."""
    return W.diverse(_pool(t), "item_id", "source", [F.desc("final"), F.desc("fused"), F.asc("doc_id")], 2, 8).select("item_id", "doc_id", "source", "final", "rank")


@query(_DIVERSE + """,
m AS (SELECT item_id, doc_id FROM o JOIN (SELECT DISTINCT item_id FROM q) USING (item_id) WHERE score >= 0.5 UNION SELECT item_id, doc_id FROM top8 WHERE rank <= 8)
SELECT item_id, count(*) AS sample_count, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, max(doc_id) AS data_as_of,
  CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'insufficient' END AS confidence FROM m JOIN documents USING (doc_id) GROUP BY 1""")
def search_statistics(t: Tables) -> DataFrame:
    """What each search rests on: documents with half of its terms and its hits, counted over sources and languages."""
    hits = R.term_scores(t.documents, t.benchmark)
    matched = hits.where(F.round(F.col("shared") / F.col("terms"), 6) >= 0.5).select("item_id", "doc_id")
    both = matched.unionByName(search_hits(t).select("item_id", "doc_id")).distinct().join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    out = both.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.max("doc_id").alias("data_as_of"))
    return out.withColumn("confidence", A.sample_confidence(F.col("sample_count")))


_HITS = D._BM25 + D._OVERLAP + """,
u AS (SELECT item_id, doc_id, rank, score, 'bm25' AS channel FROM top WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank, score, 'overlap' FROM otop WHERE rank <= 20)"""


def _hits(t: Tables) -> DataFrame:
    found = D._channels(t, 20)
    return found["bm25"].withColumn("channel", F.lit("bm25")).unionByName(found["overlap"].withColumn("channel", F.lit("overlap")))


@query(_HITS + """
SELECT item_id, doc_id, max(score) FILTER (channel = 'bm25') AS bm25_score, max(score) FILTER (channel = 'overlap') AS overlap_score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM u GROUP BY 1, 2""")
def merged_hits(t: Tables) -> DataFrame:
    """Hits of two channels merged: the greatest score of each, and the channels."""
    return R.merge_hits(_hits(t), ["item_id", "doc_id"], ["bm25", "overlap"]).withColumn("channels", F.array_join("channels", ","))


@query(_HITS + """,
s2 AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, count(DISTINCT channel) AS matched FROM u GROUP BY 1, 2),
f AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY item_id) AS fused FROM s2)
SELECT item_id, doc_id, round(fused, 6) AS fused, matched, round(least(1.0::DOUBLE, 0.44 * fused + 0.22 * coalesce(o.score, 0) + 0.2 * coalesce(o.score, 0) + 0.09 * 0.5 + 0.05 * least(1.0::DOUBLE, matched / 2.0)), 6) AS score
FROM f LEFT JOIN o USING (item_id, doc_id)""")
def multi_query_rerank(t: Tables) -> DataFrame:
    """Hits found by several ways, summed by reciprocal rank and ranked by the local rule."""
    hits = stored(_hits(t), "channel-hits")
    share = R.term_scores(t.documents, t.benchmark).select("item_id", "doc_id", F.round(F.col("shared") / F.col("terms"), 6).alias("share"))
    out = R.multi_query(hits, "item_id", "doc_id", "channel").join(share, ["item_id", "doc_id"], "left")
    own = F.coalesce("share", F.lit(0.0))
    score = R.local_rerank(F.col("fused"), own, own, F.lit(0.5), F.col("matched"))
    return out.select("item_id", "doc_id", F.round("fused", 6).alias("fused"), "matched", F.round(score, 6).alias("score"))


@query(D._BM25 + """,
p AS (SELECT item_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, lower(trim(b.text)) AS phrase, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS c,
  regexp_extract_all(lower(string_split(d.text, chr(10))[1]), '[a-z0-9]+') AS h, lower(string_split(d.text, chr(10))[1]) AS title, regexp_extract_all(lower(source), '[a-z0-9]+') AS s, lower(d.text) AS low
  FROM top JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 20)
SELECT item_id, doc_id, round(least(1.0::DOUBLE, (0.55 * len(list_intersect(list_distinct(c), q)) + 0.3 * len(list_intersect(list_distinct(h), q)) + 0.15 * len(list_intersect(list_distinct(s), q))) / greatest(len(q), 1)::DOUBLE
  + CASE WHEN phrase = '' THEN 0 WHEN contains(title, phrase) THEN 0.35 WHEN contains(low, phrase) THEN 0.15 ELSE 0 END), 6) AS score FROM p""")
def lexical_scores(t: Tables) -> DataFrame:
    """The lexical score of each item's twenty best documents: the first line stands for the title, the source for the company."""
    top = R.bm25(t.documents, t.benchmark, 20).select("item_id", "doc_id")
    rows = top.join(t.benchmark.select("item_id", F.col("text").alias("query")), "item_id").join(t.documents.select("doc_id", "source", "text"), "doc_id")
    score = R.lexical_score(F.col("query"), F.split("text", "\n", 2)[0], F.col("text"), F.col("source"))
    return rows.select("item_id", "doc_id", F.round(score, 6).alias("score"))


@query("""
WITH c AS (SELECT conv_id, least(1.0::DOUBLE, count(*) / 8.0) AS coverage, avg((length(text) % 100) / 100.0::DOUBLE) AS quality, least(1.0::DOUBLE, count(DISTINCT role) / 2.0) AS diversity, count(*) FILTER (turn % 7 = 6) AS conflicts FROM conversations GROUP BY 1)
SELECT conv_id, round(0.72 * coverage + 0.16 * quality + 0.12 * diversity, 6) AS score, 0.72 * coverage + 0.16 * quality + 0.12 * diversity >= 0.65 AND coverage >= 0.42 AND conflicts = 0 AS sufficient FROM c""")
def evidence_sufficiency(t: Tables) -> DataFrame:
    """Whether a conversation's turns are evidence enough."""
    rows = t.conversations.withColumn("v", (F.length("text") % 100) / 100.0)
    got = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.count(F.lit(1)) / 8.0).alias("coverage"), F.avg("v").alias("mean"),
        F.least(F.lit(1.0), F.countDistinct("role") / 2.0).alias("diversity"), F.count_if(F.col("turn") % 7 == 6).alias("conflicts"))
    # From eight turns on, the score is above the bound by coverage alone. Below, it may be the bound to the last digit: values are added by turn.
    few = rows.join(got.where("n < 8").select("conv_id"), "conv_id").where("v IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "v"))).alias("turns"))
    few = few.select("conv_id", (F.aggregate("turns", F.lit(0.0), lambda s, x: s + x["v"]) / F.size("turns")).alias("ordered"))
    got = got.join(few, "conv_id", "left").withColumn("quality", F.coalesce("ordered", "mean"))
    told = R.sufficiency(*[F.col(c) for c in ("coverage", "quality", "diversity", "conflicts")])
    return got.select("conv_id", told.alias("t")).select("conv_id", F.round("t.score", 6).alias("score"), "t.sufficient")


@query("""
WITH l AS (SELECT l_orderkey, avg(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END::DOUBLE) AS f, avg((l_linestatus = 'F')::INT) AS c, bool_or(l_discount > 0.08) AS should, bool_or(l_tax > 0.07) AS did FROM lineitem GROUP BY 1)
SELECT round(avg(f), 6) AS faithfulness, round(avg(c), 6) AS citation_coverage, round(avg((should = did)::INT), 6) AS refusal_accuracy FROM l""")
def answer_report(t: Tables) -> DataFrame:
    """Line items as the claims of an order's answer: support by flag, cited by status."""
    support = F.when(F.col("l_returnflag") == "R", "supported").when(F.col("l_returnflag") == "A", "partial").otherwise("none")
    answers = t.lineitem.groupBy("l_orderkey").agg(  # bounded: an order has a few lines
        F.collect_list(F.struct(support.alias("support"), (F.col("l_linestatus") == "F").alias("cited"))).alias("claims"),
        F.bool_or(F.col("l_discount") > 0.08).alias("should_refuse"), F.bool_or(F.col("l_tax") > 0.07).alias("did_refuse"))
    out = M.answer_metrics(answers)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
p AS (SELECT a.doc_id, a.w AS a, b.w AS b, len(list_intersect(a.w, b.w)) AS n FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE n / sqrt((len(a) * len(b))::DOUBLE) END, 6) AS cosine, round(n / greatest(least(len(a), len(b)), 1)::DOUBLE, 6) AS smaller,
  round(n / greatest(len(a) + len(b) - n, 1)::DOUBLE, 6) AS jaccard FROM p""")
def set_similarities(t: Tables) -> DataFrame:
    """Neighbouring documents by their words: cosine of sets, share of the smaller one, Jaccard."""
    words = t.documents.select("doc_id", F.array_distinct(X.ascii_tokens(F.col("text"))).alias("a"))
    both = words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    a, b = F.col("a"), F.col("b")
    return both.select("doc_id", F.round(X.set_cosine(a, b), 6).alias("cosine"), F.round(X.min_overlap(a, b), 6).alias("smaller"), F.round(X.jaccard(a, b), 6).alias("jaccard"))


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN 100.0 ELSE 30.0 END::DOUBLE AS place, CASE WHEN c_acctbal < 0 THEN NULL ELSE least(100.0, c_acctbal / 97.0::DOUBLE) END::DOUBLE AS pay FROM customer),
p AS (SELECT *, CASE WHEN place IS NULL AND pay IS NULL THEN 100.0 ELSE (coalesce(place, 0) + coalesce(pay, 0)) / ((place IS NOT NULL)::INT + (pay IS NOT NULL)::INT) END AS score FROM s)
SELECT c_custkey, round(score::DOUBLE, 6) AS preference, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'possible' ELSE 'weak' END AS recommendation,
  round(least(1.0::DOUBLE, 0.7 * score / 100 + CASE WHEN place IS NOT NULL THEN 0.2 ELSE 0 END + 0.1), 6) AS capability FROM p""")
def preference_bands(t: Tables) -> DataFrame:
    """Preferences of customers (place 100 or 30, pay), their mean over what applies, its band, and the capability that it gives."""
    place = F.when(F.col("c_nationkey") % 3 == 1, 100.0).when(F.col("c_nationkey") % 3 == 2, 30.0)
    pay = F.when(F.col("c_acctbal") >= 0, F.least(F.lit(100.0), F.col("c_acctbal") / 97.0))
    rows = t.customer.select("c_custkey", place.alias("place"), S.preference_score(place, pay).alias("score"))
    return rows.select(
        "c_custkey", F.round("score", 6).alias("preference"), S.recommendation(F.col("score")).alias("recommendation"),
        F.round(S.capability(F.col("score") / 100, F.col("place").isNotNull()), 6).alias("capability"))


@query("""
WITH d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS w FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE 100.0 * len(list_intersect(q, w)) / len(q)::DOUBLE END, 6) AS coverage FROM d""")
def coverage_share(t: Tables) -> DataFrame:
    """The share of an item's words that the document of its number has."""
    rows = t.benchmark.select("item_id", F.array_distinct(X.ascii_tokens(F.col("text"))).alias("q")).join(
        t.documents.select(F.col("doc_id").alias("item_id"), X.ascii_tokens(F.col("text")).alias("w")), "item_id")
    return rows.select("item_id", F.round(A.coverage(F.array_intersect("q", "w"), F.array_except("q", "w")), 6).alias("coverage"))


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, CASE event_type WHEN 'click' THEN 'short' WHEN 'purchase' THEN 'long' END) AS kind FROM events""")
def default_filled(t: Tables) -> DataFrame:
    """A missing kind filled by the event's type."""
    rows = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    return P.filled(rows, "kind", "event_type", {"click": "short", "purchase": "long"}).select("event_id", "kind")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE + 1 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2""")
def replaced_rows(t: Tables) -> DataFrame:
    """Every third order's lines replaced: those that come in stand for all of the order."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"))
    return I.replaced(rows, rows.where("l_orderkey % 3 = 0 AND l_linenumber <= 2").withColumn("quantity", F.col("quantity") + 1), "l_orderkey")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def newest_rows(t: Tables) -> DataFrame:
    """The latest event of each user and type."""
    return I.newest(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("""
WITH a AS (SELECT user_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id FROM events WHERE event_type = 'purchase')
SELECT 'clicks' AS platform, count(*) AS rows, count(DISTINCT user_id) AS keys FROM a UNION ALL SELECT 'purchases', count(*), count(DISTINCT user_id) FROM b""")
def source_health(t: Tables) -> DataFrame:
    """Rows and keys of each of two sources that are read together."""
    of = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", F.col("value").alias(kind))
    return records.union_sources({"clicks": of("click"), "purchases": of("purchase")}, ["user_id"])[1]


@query("""
SELECT doc_id FROM documents WHERE lang <> 'de' AND source = 'src3' AND NOT (n_chars < 500) AND (n_chars % 1000) / 1000.0::DOUBLE >= 0.35""")
def valid_rows(t: Tables) -> DataFrame:
    """Rows that are active, of the wanted version, not past their time, and good enough."""
    late = F.when(F.col("n_chars") < 500, "2023-01-01").otherwise("2025-01-01").cast("timestamp")
    rows = t.documents.withColumns({"active": F.col("lang") != "de", "expires": late, "quality": (F.col("n_chars") % 1000) / 1000.0})
    return rows.where(P.valid("active", "source", "src3", "expires", "2024-06-01 00:00:00", "quality")).select("doc_id")
