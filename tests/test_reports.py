"""Postings, questions, relations and reports on small rows."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import postings as P
from quarry.operators import reports as R
from quarry.operators import scoring as S


def values(spark, f, *rows):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k int, a string, b string" if isinstance(rows[0], tuple) else "k int, a string")
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[0] for r in df.orderBy("k").select(f(*cols).alias("v")).collect()]


@pytest.mark.parametrize("f, text, want", [
    (P.record_education, [None, "Master or PhD", "高中", "学历不限", "自定"], ["", "博士", "中专/高中", "学历不限", "自定"]),
    (P.search_education, [None, "硕士优先，本科及以上", "专科", "x" * 40], ["未注明", "硕士及以上", "大专及以上", "x" * 30]),
    (P.market_education, [None, "本科及以上，硕士优先", "无要求"], ["未注明", "本科及以上", "学历不限"]),
    (P.corpus_education, [None, "研究生", "不限", "abc"], ["unknown", "硕士", "不限", "其他"]),
    (P.record_experience, [None, "应届", "3-5年", "1年", "10年以上", "熟悉"], ["", "应届/经验不限", "3-5年", "1年以内", "5年以上", ""]),
    (P.market_experience, [None, "3-5年", "1年", "有相关经验优先", "8年"], ["未注明", "3-5年", "1年以内", "相关项目经验优先", "5年以上"]),
])
def test_labels(spark, f, text, want):
    assert values(spark, f, *text) == want


def test_corpus_experience(spark):
    assert values(spark, P.corpus_experience, (None, None), ("", "3 - 5 年"), ("2年", ""), ("面议", "")) == ["unknown", "3-5年", "2年以上", "面议"]


def test_pay(spark):
    got = values(spark, P.platform_pay, "15-25K·14薪", "1万-2万", "200-300元/天", "面议·13薪", None, "8k")
    assert [tuple(x) for x in got] == [(15000, 25000, 14), (10000, 20000, None), (200, 300, None), (None, None, 13), (None, None, None), (8000, 8000, None)]
    got = values(spark, P.posted_pay, "Salary: $90-120k a year", "我们给 15-25元/天", "15-25", None)
    assert [tuple(x) for x in got] == [(90, 120, "USD"), (15, 25, "CNY"), (None, None, "CNY"), (None, None, "CNY")]


@pytest.mark.parametrize(("f", "most"), [(P.platform_pay, 12), (P.record_experience, 4), (P.market_experience, 2)])
def test_patterns_are_matched_once(spark, f, most):
    """What several rules use stands in the plan once."""
    plan = spark.createDataFrame([("1-3年",)], "t string").select(f(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") <= most


def test_questions(spark):
    assert values(spark, P.intent, "前端和后端哪个适合我", "简历缺什么", "怎么学 Go", "行业趋势", None) == ["role_comparison", "resume_gap", "learning_roadmap", "market_research", "general_career_chat"]
    assert values(spark, P.capabilities, "查询最新岗位", "招聘", None) == [["job_search", "realtime_information"], [], []]
    assert [tuple(x) for x in values(spark, P.text_filters, "上海的本科实习, Remote", None)] == [(["上海", "远程"], "本科", "实习"), ([], None, None)]
    got = values(spark, P.criteria, "北京 LLM 岗位 80分以上 前20个", "find jobs Java in town, score 300", None)
    assert [tuple(x) for x in got] == [(80.0, 20, ["北京"], ["LLM"]), (100.0, 10, [], ["Java", "in", "town"]), (70.0, 10, [], [])]
    got = values(spark, P.question, "Go 和 Rust 的区别", "什么是索引", "薪资和学历", None)
    assert [tuple(x) for x in got] == [(["comparison_dimensions"], "comparison", "complex"), (["overview"], "concept_explanation", "simple"), (["salary", "education"], "multi_hop", "complex"), (["overview"], "fact_lookup", "simple")]
    assert values(spark, P.level, ("Senior dev", "lead"), (None, "实习"), (None, None)) == ["Senior", "Intern", "Mid-level"]


def test_relations(spark):
    f = lambda a, b: R.relation(a, b, F.lit(True))
    rows = [("I like Go", "i like go"), ("I like Go and Rust", "like go"), ("正在 学 Go now", "java"), ("likes Go", "likes Rust"), (None, None)]
    assert values(spark, f, *rows) == ["SAME", "EXTENDS", "UPDATES", "CONFLICTS", "SAME"]
    assert values(spark, lambda a, b: R.relation(a, b, F.lit(None).cast("boolean")), ("a", "a")) == ["UNRELATED"]


def test_relevance(spark):
    f = lambda a, b: S.market_relevance(a, b, F.lit(None).cast("string"), "go data")
    assert values(spark, f, ("Go Data lead", None), ("algo", "go"), (None, None)) == [16 + 3 * 3.5 + 3 * 2 + 3 * 1, 2.0, 0.0]


def test_evidence_and_lines(spark):
    assert values(spark, lambda a: R.evidence_window(a, "b+", 2, 1), "xxaabbcd", "b", "aa", None) == ["aabbc", "b", None, None]
    assert values(spark, lambda a: R.uncovered_lines(a, F.array(F.lit("the first line"))), "The First, line\n\nother\nother", None) == [["other"], []]


def test_roadmap_of_few_names(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k int, name string")
    got = R.ranked_names(df, "k", "name").select("k", F.transform(R.roadmap(F.col("names")), lambda p: F.array_join(p["names"], "")).alias("p")).collect()
    assert [tuple(r) for r in got] == [(1, ["ab", "abab", "ab", "", "ab"])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, t string, n long")
    assert R.fenced(none, "k", ["n"], "n").count() == R.first_seen(none, "k", "t", "n").count() == R.guarded(none.select(F.array("n").alias("v")), "v", 1).count() == 0
