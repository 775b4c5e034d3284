"""Requirement matching, evaluation, duplicates and incremental upkeep over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import evaluation as E
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import matching as Q
from ..operators import windows as W
from .registry import Tables, query

#: Line items stand for requirements of their order: the type by line number, the status by quantity and flag.
_REQUIREMENTS = """
WITH e AS (SELECT l_orderkey, CASE l_linenumber % 5 WHEN 1 THEN 'must_have_skill' WHEN 2 THEN 'preferred_skill' WHEN 3 THEN 'experience' WHEN 4 THEN 'education' ELSE 'direction' END AS type,
  CASE WHEN l_quantity < 15 THEN 'missing' WHEN l_quantity < 20 THEN 'unknown' ELSE 'matched' END AS status, CASE WHEN l_quantity < 15 THEN 0 WHEN l_quantity < 20 THEN 50 ELSE 100 END::DOUBLE AS score,
  1 + l_discount * 10 AS importance, 0.5 + l_tax AS specificity, l_returnflag = 'R' AS hard, l_returnflag = 'A' AS critical, CASE WHEN l_returnflag = 'N' THEN 6.0 ELSE 0.0 END::DOUBLE AS deduction,
  0.5 + l_discount AS extraction_confidence, l_linestatus = 'F' AS grouped, (l_orderkey % 700)::BIGINT AS chars FROM lineitem)"""


def _requirements(t: Tables) -> DataFrame:
    n, q, flag = F.col("l_linenumber") % 5, F.col("l_quantity"), F.col("l_returnflag")
    kind = F.when(n == 1, "must_have_skill").when(n == 2, "preferred_skill").when(n == 3, "experience").when(n == 4, "education").otherwise("direction")
    return t.lineitem.select(
        "l_orderkey", kind.alias("type"), F.when(q < 15, "missing").when(q < 20, "unknown").otherwise("matched").alias("status"),
        F.when(q < 15, 0.0).when(q < 20, 50.0).otherwise(100.0).alias("score"), (1 + F.col("l_discount") * 10).alias("importance"), (0.5 + F.col("l_tax")).alias("specificity"),
        (flag == "R").alias("hard"), (flag == "A").alias("critical"), F.when(flag == "N", 6.0).otherwise(0.0).alias("deduction"),
        (0.5 + F.col("l_discount")).alias("extraction_confidence"), (F.col("l_linestatus") == "F").alias("grouped"), (F.col("l_orderkey") % 700).alias("chars"))


@query(_REQUIREMENTS + """,
w AS (SELECT *, greatest(0.1::DOUBLE, importance * specificity) AS w FROM e),
c AS (SELECT l_orderkey,
  coalesce(round(sum(score * w) FILTER (type = 'direction') / sum(w) FILTER (type = 'direction'), 2), 50) AS direction,
  CASE WHEN count(*) FILTER (type = 'must_have_skill') = 0 THEN 45 ELSE coalesce(round(sum(score * w) FILTER (type = 'must_have_skill' AND status = 'matched') / sum(w) FILTER (type = 'must_have_skill' AND status = 'matched'), 2), 0) END AS must_have,
  coalesce(round(sum(score * w) FILTER (type = 'preferred_skill') / sum(w) FILTER (type = 'preferred_skill'), 2), 50) AS preferred,
  coalesce(round(sum(score * w) FILTER (type = 'experience') / sum(w) FILTER (type = 'experience'), 2), 55) AS experience,
  coalesce(round(sum(score * w) FILTER (type = 'education') / sum(w) FILTER (type = 'education'), 2), 55) AS education,
  coalesce(sum(deduction) FILTER (type = 'must_have_skill' AND status = 'missing'), 0) AS deduction,
  coalesce(bool_or(type = 'direction' AND status = 'missing'), false) AS d, coalesce(bool_or(type = 'must_have_skill' AND status = 'missing' AND critical), false) AS k,
  coalesce(bool_or(type = 'education' AND status = 'missing' AND hard), false) AS ed, coalesce(bool_or(type = 'experience' AND status = 'missing' AND hard), false) AS ex
  FROM w GROUP BY 1),
b AS (SELECT *, 0.2 * CASE WHEN d THEN 100 ELSE direction END + 0.45 * must_have + 0.1 * preferred + 0.15 * CASE WHEN ex THEN 100 ELSE experience END + 0.1 * CASE WHEN ed THEN 100 ELSE education END AS base FROM c)
SELECT l_orderkey, direction::DOUBLE AS direction, must_have::DOUBLE AS must_have, preferred::DOUBLE AS preferred, experience::DOUBLE AS experience, education::DOUBLE AS education, round(base::DOUBLE, 4) AS base, deduction::DOUBLE AS deduction,
  round(greatest(0, least(100, base - deduction, CASE WHEN d THEN 35 ELSE 100 END, CASE WHEN k THEN 50 ELSE 100 END, CASE WHEN ed THEN 40 ELSE 100 END, CASE WHEN ex THEN 55 ELSE 100 END))::DOUBLE, 4) AS final,
  NOT (d OR k OR ed OR ex) AS hard_passed, (CASE WHEN deduction > 0 THEN 1 ELSE 0 END + d::INT + k::INT + ed::INT + ex::INT)::INTEGER AS entries FROM b""")
def quick_scores(t: Tables) -> DataFrame:
    return Q.quick_scores(_requirements(t), "l_orderkey", digits=4).withColumn("entries", F.size("ledger")).drop("ledger")


@query(_REQUIREMENTS + """,
a AS (SELECT l_orderkey, max(chars) AS chars, count(*) FILTER (type <> 'direction') AS real, count(*) FILTER (type = 'must_have_skill') AS must, avg(extraction_confidence) AS x,
  avg(CASE WHEN grouped THEN 0.95 ELSE 0.65 END::DOUBLE) FILTER (type <> 'direction') AS logic, avg((status = 'matched')::INT) FILTER (type IN ('must_have_skill', 'preferred_skill')) AS cover, avg((status = 'unknown')::INT) AS u FROM e GROUP BY 1),
s AS (SELECT *, CASE WHEN real = 0 OR chars < 40 THEN 'INSUFFICIENT_DATA' WHEN chars < 120 OR must = 0 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS status,
  0.25 * least(1, chars / 500.0::DOUBLE) + 0.25 * x + 0.2 * coalesce(logic, 0) + 0.2 * coalesce(cover, 0) + 0.1 * (1 - u) AS v FROM a)
SELECT l_orderkey, status, round(least(v, CASE status WHEN 'PARTIAL' THEN 0.74 WHEN 'INSUFFICIENT_DATA' THEN 0.35 ELSE 1 END)::DOUBLE, 6) AS confidence FROM s""")
def score_reliability(t: Tables) -> DataFrame:
    return Q.reliability(_requirements(t), "l_orderkey", "chars", digits=6)


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, l_linenumber, ['s' || (l_partkey % 4), 's' || (l_suppkey % 7)] AS wanted, CASE WHEN l_returnflag = 'R' THEN 'ANY_OF' WHEN l_returnflag = 'A' THEN 'ALL_OF' ELSE 'AT_LEAST_N' END AS relation FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT *, ['s' || (o_custkey % 3), 's' || (o_custkey % 5), 's3'] AS have FROM r),
n AS (SELECT *, len(list_distinct(list_intersect(wanted, have))) AS n, CASE relation WHEN 'ANY_OF' THEN 1 WHEN 'AT_LEAST_N' THEN 1 ELSE 2 END AS need FROM h)
SELECT o_orderkey, l_linenumber, CASE WHEN n >= need THEN 'matched' ELSE 'missing' END AS status, CASE WHEN n >= need THEN 100.0 ELSE 100.0 * least(1.0, n / need::DOUBLE) END::DOUBLE AS score FROM n""")
def requirement_evaluation(t: Tables) -> DataFrame:
    part = lambda c, n: F.concat(F.lit("s"), (F.col(c) % n).cast("string"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "o_custkey", "l_linenumber", F.lit("must_have_skill").alias("type"), F.array(part("l_partkey", 4), part("l_suppkey", 7)).alias("wanted"),
        F.when(F.col("l_returnflag") == "R", "ANY_OF").when(F.col("l_returnflag") == "A", "ALL_OF").otherwise("AT_LEAST_N").alias("relation"),
        F.lit(1).alias("at_least"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("minimum"))
    have = F.struct(F.array(part("o_custkey", 3), part("o_custkey", 5), F.lit("s3")).alias("skills"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("years"))
    return Q.evaluated(rows, have).select("o_orderkey", "l_linenumber", "status", F.col("score").cast("double").alias("score"))


@query("""
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def score_cache_misses(t: Tables) -> DataFrame:
    """Orders that have to be scored: those whose key no cached row (a returned line) has."""
    cached = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.uncached(t.orders.select("o_orderkey", "o_custkey"), cached, ["o_orderkey"])


@query("""
WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_totalprice)) / 5000 AS score FROM orders GROUP BY 1), a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'),
j AS (SELECT c_custkey AS o_custkey, score, a.o_custkey IS NOT NULL AS active FROM customer c LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN a ON a.o_custkey = c_custkey),
s AS (SELECT *, coalesce(score, -1) >= 70 AND NOT active AS selected, (score IS NULL)::INT + active::INT + coalesce(score < 50, false)::INT AS warnings FROM j)
SELECT o_custkey, round(score, 4) AS score, active, selected, warnings::INTEGER AS warnings FROM s ORDER BY selected DESC, coalesce(score, -1) DESC, o_custkey LIMIT 50""")
def result_cards(t: Tables) -> DataFrame:
    """Customers as cards: the latest order's price as score, open orders as activity."""
    scores = t.orders.select("o_custkey", F.col("o_orderdate").alias("scored_at"), (F.col("o_totalprice") / 5000).alias("score"))
    active = t.orders.where("o_orderstatus = 'P'").select("o_custkey")
    out = Q.cards(t.customer.select(F.col("c_custkey").alias("o_custkey")), scores, active, "o_custkey", 50)
    return out.withColumns({"score": F.round("score", 4), "warnings": F.size("warnings")})


@query()
def fuzzy_duplicates(t: Tables) -> DataFrame:
    """Parts of one brand whose names are alike."""
    return Q.fuzzy_pairs(t.part, "p_partkey", "p_brand", ["p_name", "p_type"])


@query("""
WITH k AS (SELECT lang || '|' || sha256(coalesce(text, '')) AS k FROM documents), g AS (SELECT k, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS possible_duplicates, count(*) FILTER (n > 1) AS groups FROM g""")
def possible_duplicates(t: Tables) -> DataFrame:
    return A.possible_duplicates(t.documents, F.concat("lang", F.lit("|"), F.sha2(F.coalesce("text", F.lit("")), 256)))


@query("""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events)
SELECT user_id, count(*) AS n, max(ts) AS last_updated, string_agg(event_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 5) AS newest FROM r GROUP BY 1""")
def newest_groups(t: Tables) -> DataFrame:
    out = A.newest_groups(t.events, "user_id", "event_id", "ts", 5)
    return out.withColumn("newest", F.array_join(F.transform("newest", lambda x: x.cast("string")), ","))


@query("""
WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'market' WHEN 'click' THEN 'comparison' WHEN 'purchase' THEN 'lookup' ELSE 'chat' END AS intent, value >= 10 AS fresh FROM events)
SELECT intent, count(*) FILTER (fresh) AS samples, count(*) FILTER (NOT coalesce(fresh, false)) AS stale, CASE intent WHEN 'market' THEN 5 WHEN 'comparison' THEN 3 WHEN 'lookup' THEN 1 ELSE 0 END::INTEGER AS floor,
  count(*) FILTER (fresh) >= CASE intent WHEN 'market' THEN 5 WHEN 'comparison' THEN 3 WHEN 'lookup' THEN 1 ELSE 0 END AS enough FROM e GROUP BY 1""")
def evidence_floor(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    intent = F.when(kind == "view", "market").when(kind == "click", "comparison").when(kind == "purchase", "lookup").otherwise("chat")
    return A.evidence_floor(t.events.select(intent.alias("intent"), "value"), "intent", F.col("value") >= 10)


#: Turns stand for tool calls: the role is the tool, the number of characters its argument.
_CALLS = """
WITH x AS (SELECT conv_id, turn, role AS name, (len(text) % 3)::VARCHAR AS arg, len(text) AS chars FROM conversations),
w AS (SELECT * FROM x WHERE turn % 3 = 0), nw AS (SELECT conv_id, name, count(*) AS a FROM w GROUP BY 1, 2), nx AS (SELECT conv_id, name, count(*) AS b FROM x GROUP BY 1, 2),
m AS (SELECT conv_id, sum(least(a, b)) AS names FROM nw JOIN nx USING (conv_id, name) GROUP BY 1),
c AS (SELECT conv_id, count(*) AS calls, count(*) FILTER (chars % 10 = 0) AS bad, count(*) FILTER (chars % 7 = 0) AS failed, CAST(sum(chars) AS BIGINT) AS tokens FROM x GROUP BY 1),
d AS (SELECT conv_id, count(*) AS repeats FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, name, arg ORDER BY turn) AS r FROM x) WHERE r > 1 GROUP BY 1),
e AS (SELECT conv_id, count(*) AS expected FROM w GROUP BY 1)
SELECT conv_id, round(coalesce(names, 0) / calls::DOUBLE, 6) AS selection_precision, round(CASE WHEN coalesce(expected, 0) = 0 THEN 1 ELSE coalesce(names, 0) / expected::DOUBLE END, 6) AS selection_recall,
  round((calls - bad) / calls::DOUBLE, 6) AS schema_valid_rate, round(coalesce(repeats, 0) / calls::DOUBLE, 6) AS duplicate_rate, round((calls - failed) / calls::DOUBLE, 6) AS success_rate,
  calls AS tool_calls, tokens FROM c LEFT JOIN m USING (conv_id) LEFT JOIN d USING (conv_id) LEFT JOIN e USING (conv_id)"""


def _tool_cases(t: Tables) -> DataFrame:
    rows = t.conversations.select(
        "conv_id", F.col("turn").cast("int").alias("position"), F.col("role").alias("name"), F.create_map(F.lit("size"), (F.length("text") % 3).cast("string")).alias("arguments"), F.length("text").cast("long").alias("chars"))
    expected = rows.where("position % 3 = 0").select("conv_id", "position", "name", "arguments", F.lit(True).alias("required"), F.lit(False).alias("forbidden"))
    no = F.lit(False)
    calls = rows.select("conv_id", "position", "name", "arguments", F.when(F.col("chars") % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (F.col("chars") % 10 != 0).alias("schema_valid"),
                        F.lit(True).alias("semantically_valid"), no.alias("duplicate"), no.alias("unnecessary"), F.lit(None).cast("string").alias("retry_of"), F.col("chars").alias("tokens"), F.lit(0.5).alias("cost"))
    return E.tool_case_metrics(rows.select("conv_id", F.lit(True).alias("completed")).distinct(), expected, calls, "conv_id")


@query(_CALLS)
def tool_case_metrics(t: Tables) -> DataFrame:
    columns = ["selection_precision", "selection_recall", "schema_valid_rate", "duplicate_rate", "success_rate"]
    return _tool_cases(t).select("conv_id", *[F.round(c, 6).alias(c) for c in columns], "tool_calls", "tokens")


@query(f"SELECT count(*) AS cases, round(avg(selection_precision), 4) AS selection_precision, round(avg(success_rate), 4) AS success_rate, round(avg(duplicate_rate), 4) AS duplicate_rate FROM ({_CALLS})")
def tool_metrics_overall(t: Tables) -> DataFrame:
    out = E.over_cases(_tool_cases(t), ["selection_precision", "success_rate", "duplicate_rate"], [])
    return out.select("cases", *[F.round(c, 4).alias(c) for c in ("selection_precision", "success_rate", "duplicate_rate")])


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
c AS (SELECT doc_id, list_slice(t, 1, 8) AS wanted, list_slice(t, 5, 12) AS got, list_slice(t, 1, 2) AS stale FROM w),
m AS (SELECT *, list_slice(got, 1, 5) AS top FROM c),
h AS (SELECT *, len(list_intersect(top, wanted)) AS hits, list_min(list_filter(list_transform(top, lambda x, i: CASE WHEN list_contains(wanted, x) THEN i END), lambda x: x IS NOT NULL)) AS first FROM m)
SELECT doc_id AS case_id, round(CASE WHEN len(got) = 0 THEN (len(wanted) = 0)::INT ELSE len(list_intersect(wanted, got)) / len(got)::DOUBLE END::DOUBLE, 6) AS candidate_precision,
  round(CASE WHEN len(wanted) = 0 THEN 1 ELSE hits / len(wanted)::DOUBLE END::DOUBLE, 6) AS recall_at_k, round(coalesce(1.0::DOUBLE / first, (len(wanted) = 0)::INT)::DOUBLE, 6) AS mrr,
  round(CASE WHEN len(top) = 0 THEN 0 ELSE len(list_intersect(top, stale)) / len(top)::DOUBLE END::DOUBLE, 6) AS stale_rate FROM h""")
def memory_case_metrics(t: Tables) -> DataFrame:
    words = F.array_distinct(T.ascii_tokens(F.col("text")))
    rows = t.documents.select(F.col("doc_id").alias("case_id"), words.alias("t")).select(
        "case_id", F.slice("t", 1, 8).alias("expected"), F.slice("t", 5, 8).alias("extracted"), F.slice("t", 1, 8).alias("wanted"), F.slice("t", 5, 8).alias("retrieved"), F.slice("t", 1, 2).alias("stale"))
    yes = F.transform("extracted", lambda x: F.lit(True))
    rows = rows.select("*", yes.alias("quotes_ok"), yes.alias("supported"), F.array().cast("array<string>").alias("foreign"), F.lit(False).alias("reject"), F.lit(False).alias("saved"))
    return E.memory_case_metrics(rows).select("case_id", *[F.round(c, 6).alias(c) for c in ("candidate_precision", "recall_at_k", "mrr", "stale_rate")])


@query("""
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS observed FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)""")
def gold_with_defaults(t: Tables) -> DataFrame:
    seen = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.lit(True).alias("observed"))
    return E.with_defaults(t.documents.select("doc_id"), seen, "doc_id", {"quality": F.lit(0), "toxic": F.lit(0), "observed": F.lit(False)})


@query("""
WITH d AS (SELECT event_type, CASE WHEN value >= 20 THEN 'allow' WHEN value >= 5 THEN 'confirm' ELSE 'deny' END AS expected, CASE WHEN user_id % 5 = 0 THEN 'deny' WHEN value >= 15 THEN 'allow' ELSE 'confirm' END AS said FROM events)
SELECT event_type, count(*) AS n, round(avg((expected = said)::INT), 6) AS accuracy, round(avg((said = 'allow')::INT) FILTER (expected <> 'allow'), 6) AS wrongly_allowed, round(avg((said <> 'allow')::INT) FILTER (expected = 'allow'), 6) AS wrongly_refused
FROM d GROUP BY 1""")
def verdict_rates(t: Tables) -> DataFrame:
    v = F.col("value")
    rows = t.events.select("event_type", F.when(v >= 20, "allow").when(v >= 5, "confirm").otherwise("deny").alias("expected"),
                           F.when(F.col("user_id") % 5 == 0, "deny").when(v >= 15, "allow").otherwise("confirm").alias("said"))
    return E.verdict_rates(rows, "event_type", "expected", "said").withColumns({c: F.round(c, 6) for c in ("accuracy", "wrongly_allowed", "wrongly_refused")})


@query()
def paired_bootstrap(t: Tables) -> DataFrame:
    """Interval of the difference between a user's values and the mean of all, users resampled whole."""
    return E.paired_bootstrap(t.events.select("user_id", (F.col("value") - 10).alias("delta")), "user_id", "delta", 200)


@query()
def deficit_split(t: Tables) -> DataFrame:
    """Sources to splits, the largest first, each to the split that lacks most; tested against a loop."""
    return W.deficit_split(t.documents.select("doc_id", "source"), "source")


@query("""
WITH u AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, (n * 2)::BIGINT AS fresh_n FROM u WHERE n IS DISTINCT FROM n * 2""")
def changed_only(t: Tables) -> DataFrame:
    """A refresh in one pass: only the rows whose value changes."""
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return I.refreshed(rows, {"n": F.col("n") * 2}).select("user_id", "n", "fresh_n")


@query("""
SELECT event_id, CASE WHEN regexp_matches(props, '^\\{"k": [0-9]+\\}$') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN NOT coalesce(regexp_matches(props, '^\\{"k": [0-9]+\\}$'), false) THEN 'unreadable' END AS error FROM events""")
def with_errors(t: Tables) -> DataFrame:
    """A value or an error for each row; a bad row never stops the batch."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return I.with_error(t.events.select("event_id", "props"), "k", k, "unreadable").select("event_id", "k", "error")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0 THEN 'deleted' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0 THEN o_orderstatus END AS previous FROM orders""")
def soft_delete(t: Tables) -> DataFrame:
    """Every tenth order deleted, every twentieth restored to what it was."""
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("previous"))
    gone = I.soft_deleted(rows, F.col("o_orderkey") % 10 == 0)
    return I.restored(gone, F.col("o_orderkey") % 20 == 0)


@query("""
SELECT doc_id, 'v' || replace(coalesce(source, ''), 'src', 'S') AS decoded FROM documents""")
def nested_decode(t: Tables) -> DataFrame:
    """Strings decoded wherever they are in nested JSON; keys and numbers stay."""
    nested = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("v"), F.coalesce("source", F.lit(""))).alias("src_key"))).alias("a")))
    out = I.decoded_strings(nested, lambda s: F.replace(s, F.lit("src"), F.lit("S")))
    return t.documents.select("doc_id", F.get_json_object(out, "$.a[0].src_key").alias("decoded"))


@query("""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k, n_chars FROM documents WHERE text IS NOT NULL)
SELECT min(doc_id) AS doc_id, count(*) AS merged FROM k GROUP BY k""")
def normal_form_merge(t: Tables) -> DataFrame:
    """Texts of one normal form become one, with how many there were."""
    return D.merged(t.documents.where("text IS NOT NULL"), D.normal_key(F.col("text")), "doc_id").select("doc_id", "merged")


@query("""
WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role, md5(coalesce(text, '')) ORDER BY turn) AS r FROM conversations)
SELECT conv_id, turn, r > 1 AS repeated FROM s""")
def repeated_calls(t: Tables) -> DataFrame:
    signature = [F.col("role"), F.md5(F.coalesce("text", F.lit("")))]
    return D.repeated(t.conversations, "conv_id", signature, ["turn"]).select("conv_id", "turn", "repeated")


@query("""
WITH f AS (SELECT user_id, lower(event_type) AS name, max(CASE WHEN value >= 30 THEN 3 WHEN value >= 10 THEN 2 ELSE 1 END) AS p FROM events GROUP BY 1, 2)
SELECT user_id, name, CASE p WHEN 3 THEN 'required' WHEN 2 THEN 'preferred' ELSE 'inferred' END AS kind FROM f""")
def skill_facts(t: Tables) -> DataFrame:
    v = F.col("value")
    kind = F.when(v >= 30, "required").when(v >= 10, "preferred").otherwise("inferred")
    return D.strongest(t.events.select("user_id", T.skill_name(F.col("event_type")).alias("name"), kind.alias("kind")), ["user_id", "name"], "kind")


@query("""
WITH a AS (SELECT conv_id, list(DISTINCT role) AS have FROM conversations WHERE turn < 2 GROUP BY 1), b AS (SELECT conv_id, list(DISTINCT role) AS want FROM conversations GROUP BY 1)
SELECT conv_id, len(list_intersect(want, have))::INTEGER AS covered, len(list_filter(want, lambda x: NOT list_contains(have, x)))::INTEGER AS missing, len(want)::INTEGER AS either FROM a JOIN b USING (conv_id)""")
def covered_and_missing(t: Tables) -> DataFrame:
    have = t.conversations.where("turn < 2").groupBy("conv_id").agg(F.collect_set("role").alias("have"))
    want = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("want"))
    c, m = F.array_intersect("want", "have"), F.array_except("want", "have")
    return have.join(want, "conv_id").select("conv_id", F.size(c).alias("covered"), F.size(m).alias("missing"), F.size(F.array_union("have", "want")).alias("either"))


@query("""
SELECT p_partkey, p_name, r::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 100) DESC, lower(p_name), p_partkey::VARCHAR) AS r FROM part) WHERE r <= 10""")
def tie_broken_order(t: Tables) -> DataFrame:
    """By score, then name without regard to case, then id as text."""
    order: list[Column] = [F.desc(F.round(F.col("p_retailprice") / 100)), F.asc(F.lower("p_name")), F.asc(F.col("p_partkey").cast("string"))]
    return J.top_k(t.part, "p_brand", order, 10).select("p_partkey", "p_name", F.col("rank").alias("place"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR date_diff('second', before, ts) > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, run::BIGINT AS run, count(*) AS items, least(max(ts) + INTERVAL 5 SECOND, greatest(min(ts) + INTERVAL 15 SECOND, max(ts))) AS due FROM b GROUP BY 1, 2""")
def debounced_runs(t: Tables) -> DataFrame:
    """Events of a user gathered to runs while the gap stays within a day; due five seconds after the last, at most fifteen after the first."""
    return I.debounced(t.events, "user_id", "ts", "event_id", gap=86400, wait=5, most=15)
