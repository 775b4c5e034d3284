"""Parsers of postings and of free-text questions, each with the labels of its own use; they are not interchangeable.

All take null as an empty text and are column expressions without Python workers. What several rules use is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def has(text: Column, *words: str) -> Column:
    """Whether a text holds one of the words."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def first_rule(rules: list[tuple[Column, str]], other: Column) -> Column:
    """The name of the first rule that holds."""
    out = F.when(*rules[0])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise(other)


# Words and labels of schooling and experience in the four uses.


def record_education(value: Column) -> Column:
    """The label of a stored record: the highest level named; other texts as they are."""

    def named(raw: Column, low: Column) -> Column:
        return first_rule([
            (raw == "", ""), (has(raw, "不限", "无要求", "不作要求"), "学历不限"), (has(low, "博士", "phd"), "博士"), (has(low, "硕士", "研究生", "master"), "硕士"),
            (has(low, "本科", "学士", "bachelor"), "本科"), (has(low, "大专", "专科", "associate"), "大专"), (has(low, "中专", "高中", "technical secondary"), "中专/高中"),
        ], raw)

    return let(_text(value), lambda raw: let(F.lower(raw), lambda low: named(raw, low)))


def search_education(value: Column) -> Column:
    """The label that search shows: the highest level named, or more."""
    raw = _text(value)
    return first_rule([
        (raw == "", "未注明"), (has(raw, "不限", "无要求"), "学历不限"), (has(raw, "博士"), "博士及以上"), (has(raw, "硕士"), "硕士及以上"),
        (has(raw, "本科"), "本科及以上"), (has(raw, "大专", "专科"), "大专及以上"),
    ], F.substring(raw, 1, 30))


def market_education(value: Column) -> Column:
    """The label of market reports: the level whose word comes first."""
    words = [("博士", "博士"), ("硕士", "硕士及以上"), ("本科", "本科及以上"), ("大专", "大专及以上"), ("专科", "大专及以上")]

    def named(raw: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(has(raw, w), F.struct(F.instr(raw, F.lit(w)).alias("at"), F.lit(name).alias("name"))) for w, name in words]))
        return first_rule([(raw == "", "未注明"), (has(raw, "不限", "无要求"), "学历不限")], F.coalesce(F.array_min(found)["name"], F.substring(raw, 1, 30)))

    return let(_text(value), named)


def corpus_education(value: Column) -> Column:
    """The label of evaluation corpora."""
    raw = _text(value)
    return first_rule([
        (raw == "", "unknown"), (has(raw, "博士"), "博士"), (has(raw, "硕士", "研究生"), "硕士"), (has(raw, "本科", "学士"), "本科"),
        (has(raw, "大专", "专科"), "大专"), (has(raw, "不限"), "不限"),
    ], F.lit("其他"))


def _numbers(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), group), lambda x: x.try_cast("long"))


def record_experience(value: Column) -> Column:
    """The label of a stored record, by the bounds of the ranges named, else by the largest number of years."""
    ranges = r"(\d{1,2})\s*(?:-|~|～|至|到)\s*(\d{1,2})\s*年"

    def by_years(raw: Column) -> Column:
        lows, highs = _numbers(raw, ranges), _numbers(raw, ranges, 2)
        single = F.array_max(_numbers(raw, r"(?<!\d)(\d{1,2})\s*(?:\+|年以上|年)"))
        years = F.struct(F.coalesce(F.array_min(lows), single).alias("low"), F.coalesce(F.array_max(highs), single).alias("high"))
        return let(years, lambda y: first_rule([(y["low"].isNull(), ""), (y["low"] >= 5, "5年以上"), (y["low"] >= 3, "3-5年"), (y["high"] <= 1, "1年以内")], F.lit("1-3年")))

    return let(F.lower(_text(value)), lambda raw: F.when(has(raw, "不限", "无经验", "无需经验", "应届", "在校"), "应届/经验不限").otherwise(by_years(raw)))


def market_experience(value: Column) -> Column:
    """The label of market reports, by the smallest and largest number of years."""

    def by_years(raw: Column) -> Column:
        wished = has(raw, "经验") & has(raw, "优先", "具备", "拥有", "丰富")
        return let(_numbers(raw, r"(\d+)\s*年"), lambda y: first_rule([
            (F.array_max(y) <= 1, "1年以内"), (F.array_min(y) <= 3, "1-3年"), (F.array_min(y) <= 5, "3-5年"), (F.array_min(y) > 5, "5年以上"), (wished, "相关项目经验优先"),
        ], F.lit("未注明")))

    return let(F.lower(_text(value)), lambda raw: F.when(has(raw, "不限", "无经验", "应届", "在校", "实习"), "应届/经验不限").otherwise(by_years(raw)))


def corpus_experience(value: Column, text: Column) -> Column:
    """The label of evaluation corpora: a range or a least number of years, from the field or else the text."""
    raw = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    both = F.concat(raw, F.lit(" "), F.coalesce(text, F.lit("")))
    ranged, single = r"(\d+)\s*[-~至]\s*(\d+)\s*年", r"(\d+)\s*年(?:以上)?"
    return (
        F.when(has(both, "经验不限", "无经验", "应届", "在校"), "不限/应届")
        .when(both.rlike(ranged), F.concat(F.regexp_extract(both, ranged, 1), F.lit("-"), F.regexp_extract(both, ranged, 2), F.lit("年")))
        .when(both.rlike(single), F.concat(F.regexp_extract(both, single, 1), F.lit("年以上"))).when(raw != "", raw).otherwise("unknown")
    )


_NUMBER = r"(\d+(?:\.\d+)?)"


def platform_pay(value: Column) -> Column:
    """struct(minimum, maximum, months) of a platform's pay text; day rates stay as they are, a bound takes the other's scale."""
    one = _NUMBER + r"\s*([Kk千万])?"
    pair = one + r"\s*(?:-|~|至|—|–)\s*" + one
    filled = lambda c: F.when(c != "", c)

    def amount(number: Column, scale: Column) -> Column:
        factor = F.when(F.lower(scale).isin("k", "千"), 1000).when(scale == "万", 10000).otherwise(1)
        return F.bround(filled(number).cast("double") * factor).cast("long")

    def parsed(raw: Column) -> Column:
        groups = lambda pattern, *names: F.struct(*[F.regexp_extract(raw, pattern, k).alias(name) for k, name in enumerate(names, 1)])
        single = let(groups(one, "low", "low_scale"), lambda s: F.struct(s["low"].alias("low"), s["low_scale"].alias("low_scale"), s["low"].alias("high"), s["low_scale"].alias("high_scale")))
        found = F.when(~raw.rlike("(?i)面议|negotiable|面谈"), F.when(raw.rlike(pair), groups(pair, "low", "low_scale", "high", "high_scale")).otherwise(single))
        return let(F.struct(found.alias("f"), F.regexp_extract(raw, r"(\d{1,2})\s*薪", 1).alias("months")), lambda x: F.struct(
            amount(x["f"]["low"], F.coalesce(filled(x["f"]["low_scale"]), filled(x["f"]["high_scale"]))).alias("minimum"),
            amount(x["f"]["high"], F.coalesce(filled(x["f"]["high_scale"]), filled(x["f"]["low_scale"]))).alias("maximum"),
            filled(x["months"]).cast("int").alias("months")))

    return let(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), parsed)


def posted_pay(text: Column) -> Column:
    """struct(minimum, maximum, currency) of the pay that a posting's text names: a labelled range, else one with a unit; unscaled."""
    span = r"[$¥￥]?\s*(\d{1,3}(?:\.\d+)?)\s*[kK千萬万]?\s*[-–~至到]\s*(\d{1,3}(?:\.\d+)?)\s*[kK千萬万]?"
    labelled = r"(?i)(?:薪资|salary|月薪|日薪|时薪|compensation)\s*[:：]?[^\n\d$¥￥]{0,10}" + span
    generic = "(?i)" + span + r"\s*(?:元(?:/月|/天|/小时)?|块|/月|/天|/小时|薪|USD|CNY)"
    raw = F.coalesce(text, F.lit(""))
    named, other = raw.rlike(labelled), raw.rlike(generic)
    bound = lambda k: F.bround(F.when(named, F.regexp_extract(raw, labelled, k)).when(other, F.regexp_extract(raw, generic, k)).try_cast("double")).cast("long")
    match = F.upper(F.when(named, F.regexp_extract(raw, labelled, 0)).otherwise(F.regexp_extract(raw, generic, 0)))
    return F.struct(bound(1).alias("minimum"), bound(2).alias("maximum"), F.when(has(match, "$", "USD"), "USD").otherwise("CNY").alias("currency"))


def level(title: Column, text: Column) -> Column:
    """Intern, Junior, Senior, Lead, Manager by the first whose word occurs; else Mid-level."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    return first_rule([
        (has(low, "intern", "实习"), "Intern"), (has(low, "junior", "初级"), "Junior"), (has(low, "senior", "高级"), "Senior"),
        (has(low, "lead", "负责人"), "Lead"), (has(low, "manager", "经理"), "Manager"),
    ], F.lit("Mid-level"))


# Words of intents, capabilities, cities and questions.


def intent(text: Column, has_context: Column | None = None, topic: Column | None = None) -> Column:
    """What a message asks for; `topic`: whether it names a known subject."""
    low, no = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    return first_rule([
        (has(low, "对比", "比较", "区别", "哪个更适合", "vs") | (has(low, "哪个") & has(low, "适合")), "role_comparison"),
        (has(low, "简历", "差距", "缺什么", "还需要", "匹配度"), "resume_gap"),
        (has(low, "30天", "60天", "90天", "学习计划", "学习路线", "学习建议", "学习规划", "怎么学", "我想学", "想学", "入门", "从零学"), "learning_roadmap"),
        (has(low, "薪资", "工资", "收入", "待遇"), "salary_analysis"), (has(low, "技能", "技术栈", "要求什么", "需要掌握"), "skill_analysis"),
        (has(low, "岗位", "职位", "招聘", "推荐", "适合投"), "job_recommendation"),
        ((no if has_context is None else has_context) & has(low, "继续", "还有", "那", "除此之外"), "follow_up"),
        (has(low, "行业", "市场", "普遍", "通常", "趋势", "需求"), "market_research"), (no if topic is None else topic, "skill_analysis"),
    ], F.lit("general_career_chat"))


def capabilities(goal: Column) -> Column:
    """What a goal needs tools for; empty if it needs none."""
    text = F.coalesce(goal, F.lit(""))
    signal = has(text, *"搜索 查询 检索 查找 岗位 职位 简历 投递 排名 计算 统计 最新 今天 实时 导入 创建 删除 修改 发送 文件 目录 项目文件 代码库 仓库 调用工具".split())
    found = [
        (has(text, "岗位", "职位", "投递", "招聘"), "job_search"), (has(text, "简历", "匹配", "排名"), "resume_matching"), (has(text, "我的简历", "个人资料", "私有数据"), "private_data_read"),
        (has(text, "最新", "今天", "实时"), "realtime_information"), (has(text, "文件", "目录", "项目文件", "代码库", "仓库"), "project_file_access"),
        (has(text, "计算", "求和", "百分比", "统计"), "computation"), (has(text, "投递", "发送", "删除", "修改", "创建"), "external_side_effect"),
    ]
    return F.array_compact(F.array(*[F.when(signal & test, name) for test, name in found]))


def text_filters(text: Column) -> Column:
    """struct(cities, education, job_type) that a message names."""
    raw = F.coalesce(text, F.lit(""))
    cities = [F.when(has(raw, c), c) for c in "北京 上海 深圳 杭州 广州 成都 武汉 南京".split()]
    cities.append(F.when(has(raw, "远程") | has(F.lower(raw), "remote"), "远程"))
    none = F.lit(None).cast("string")
    return F.struct(
        F.array_compact(F.array(*cities)).alias("cities"), first_rule([(has(raw, w), w) for w in ("博士", "硕士", "本科", "大专")], none).alias("education"),
        first_rule([(has(raw, "实习", "校招"), "实习"), (has(raw, "社招", "全职"), "全职")], none).alias("job_type"),
    )


def criteria(goal: Column) -> Column:
    """struct(min_score, max_jobs, cities, keywords) of a goal: 70 and 10 unless it says so."""
    raw, low = F.coalesce(goal, F.lit("")), F.lower(F.coalesce(goal, F.lit("")))
    score = r"(?i)(?:匹配度|分数|score)\s*[:：]?\s*(\d{1,3})\s*分?\s*(?:以上|起)?|(\d{1,3})\s*分\s*(?:以上|起)"
    least = F.coalesce(*[F.nullif(F.regexp_extract(raw, score, k), F.lit("")) for k in (1, 2)]).cast("double")
    most = F.nullif(F.regexp_extract(raw, r"(?i)(?:最多|前|Top)\s*(\d{1,3})\s*(?:个|条)?", 1), F.lit("")).cast("int")
    named = lambda words: F.array_compact(F.array(*[F.when(has(low, w.lower()), w) for w in words]))
    known = named(["AI Agent", "LLM", "RAG", "Backend", "Frontend", "Engineer", "Data", "DevOps", "实习"])
    words = F.filter(F.regexp_extract_all(raw, F.lit(r"([A-Za-z][A-Za-z0-9+#.\-]+)"), 1), lambda w: ~F.lower(w).isin("help", "find", "jobs", "job", "score", "top"))
    return F.struct(
        F.least(F.lit(100.0), F.coalesce(least, F.lit(70.0))).alias("min_score"), F.least(F.lit(100), F.coalesce(most, F.lit(10))).alias("max_jobs"),
        named("北京 上海 深圳 杭州 广州 Remote 远程".split()).alias("cities"),
        F.when(F.size(known) > 0, known).otherwise(F.array_distinct(F.slice(words, 1, 10))).alias("keywords"),
    )


def question(text: Column) -> Column:
    """struct(required, question_type, complexity) of a question."""
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low = F.lower(raw)
    comparison = has(low, "对比", "比较", "区别", " vs ")
    steps = has(raw, "怎么学", "如何学", "学习路线", "学习方向", "准备", "入门", "提升")
    asked = F.array_distinct(F.array_compact(F.array(
        F.when(has(raw, "薪资", "工资", "待遇", "收入"), "salary"), F.when(has(raw, "学历", "本科", "硕士", "博士"), "education"), F.when(has(raw, "经验", "年限", "应届"), "experience"),
        F.when(has(low, "技能", "技术栈", "掌握", "能力", "skill"), "skills"), F.when(has(raw, "职责", "工作内容", "做什么", "任务"), "responsibilities"),
        F.when(steps, "skills"), F.when(steps, "responsibilities"), F.when(steps, "learning_path"), F.when(comparison, "comparison_dimensions"))))
    required = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("overview")))
    kind = first_rule([
        (comparison, "comparison"), (has(raw, "最近", "最新", "今年", "趋势", "当前"), "time_sensitive"), (has(raw, "比例", "分布", "平均", "多少岗位", "市场"), "aggregation"), (steps, "procedural"),
        (has(raw, "总结", "概括", "归纳"), "summary"), ((F.size(asked) >= 2) | has(raw, "以及", "同时", "并且"), "multi_hop"), (has(raw, "什么是", "原理", "为什么"), "concept_explanation"),
        (has(raw, "某个岗位", "这份岗位", "职位详情"), "document_lookup"),
    ], F.lit("fact_lookup"))
    hard = kind.isin("comparison", "multi_hop") | (F.size(required) >= 4)
    return F.struct(
        required.alias("required"), kind.alias("question_type"),
        F.when(hard, "complex").when(kind.isin("procedural", "aggregation", "summary", "time_sensitive"), "medium").otherwise("simple").alias("complexity"),
    )
