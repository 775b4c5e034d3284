"""Rule parsers of job-like records: pay, schooling, experience, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _amount(digits: Column, scale: Column) -> Column:
    factor = F.when(F.lower(scale).isin("k", "千"), 1000).when(scale.isin("万", "萬"), 10000).otherwise(1)
    return F.when(digits != "", F.bround(digits.cast("double") * factor).cast("int"))


def pay_unit(text: Column) -> Column:
    """cny_hour, cny_day, cny_year or cny_month, by the first word for a span of time."""
    word = F.lower(F.regexp_extract(text, r"(?i)(小时|时薪|hour|hr|天|日薪|day|月|月薪|年|year|hourly|daily)", 1))
    return (
        F.when(word.isin("小时", "时薪", "hour", "hr", "hourly"), "cny_hour").when(word.isin("天", "日薪", "day", "daily"), "cny_day")
        .when(word.isin("年", "year") | text.rlike(r"万/年|万每年"), "cny_year").otherwise("cny_month")
    )


def pay(text: Column) -> Column:
    """struct(raw, minimum, maximum, unit, currency, months, confidence, status) of a pay text."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    number, scale = r"(\d{1,3}(?:\.\d+)?)", r"\s*([kK千萬万])?"
    pattern = number + scale + r"\s*[-–—~～至到]\s*" + number + scale
    low, low_scale, high, high_scale = [F.regexp_extract(raw, pattern, k) for k in (1, 2, 3, 4)]
    one, one_scale = F.regexp_extract(raw, number + scale, 1), F.regexp_extract(raw, number + scale, 2)
    ranged = low != ""
    # The lower bound takes over the scale of the upper one.
    minimum = F.when(ranged, _amount(low, F.when(low_scale == "", high_scale).otherwise(low_scale))).otherwise(_amount(one, one_scale))
    maximum = F.when(ranged, _amount(high, high_scale)).otherwise(_amount(one, one_scale))
    months = F.regexp_extract(raw, r"(?:·|\s)(\d{1,2})\s*薪", 1)
    status = F.when(raw == "", "unknown").when(raw.rlike("(?i)面议|negotiable|面谈"), "negotiable").when(minimum.isNotNull(), "parsed").otherwise("unparsed")
    good = status == "parsed"
    return F.struct(
        raw.alias("raw"), F.when(good, minimum).alias("minimum"), F.when(good, maximum).alias("maximum"), F.when(good, pay_unit(raw)).otherwise("").alias("unit"),
        F.lit("CNY").alias("currency"), F.when(status.isin("parsed", "unparsed") & (months != ""), months.cast("int")).alias("months"),
        F.when(good, 0.95).when(status == "negotiable", 1.0).otherwise(0.0).alias("confidence"), status.alias("status"),
    )


#: Words of schooling levels, from the highest.
SCHOOLING = (("博士", "doctorate", 5), ("phd", "doctorate", 5), ("硕士", "master", 4), ("研究生", "master", 4), ("master", "master", 4),
             ("本科", "bachelor", 3), ("学士", "bachelor", 3), ("bachelor", "bachelor", 3), ("大专", "college", 2), ("专科", "college", 2),
             ("高中", "school", 1), ("中专", "school", 1), ("不限", "any", 0))


def schooling(text: Column) -> Column:
    """The level whose word comes first in the text."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[
        F.when(F.instr(low, F.lit(w)) > 0, F.struct(F.instr(low, F.lit(w)).alias("at"), F.lit(-level).alias("rank"), F.lit(name).alias("name")))
        for w, name, level in SCHOOLING
    ]))
    return F.when(F.size(found) > 0, F.array_min(found)["name"])


def schooling_level(text: Column) -> Column:
    """The highest level named, 0 to 5."""
    low, out = F.lower(text), None
    for word, _, level in SCHOOLING:
        test = low.contains(word)
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(F.lit(0))


def years_required(text: Column) -> Column:
    """The smallest number of years asked for; 0 for none at all."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d{1,2})\s*(?:-\s*\d{1,2}\s*)?(?:年|years?)"), 1)
    least = F.array_min(F.transform(numbers, lambda x: x.cast("int")))
    return F.when(text.rlike("(?i)不限|应届|entry"), 0).otherwise(least)


#: Cities that a space alone parts from a district.
_CITIES = "北京|上海|深圳|广州|武汉|成都|杭州|南京|西安|.+市"


def place(text: Column) -> Column:
    """struct(raw, city, district, normalized) of a place: parts between ·|｜，,/ or, of a known city and a district, a space."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(raw, r"[·|｜，,/]"), F.trim), lambda x: x != "")
    spaced = rf"^({_CITIES})\s+(.+(?:区|县))$"
    one = (F.size(parts) == 1) & raw.rlike(spaced)
    city = F.when(one, F.regexp_extract(raw, spaced, 1)).otherwise(F.coalesce(F.get(parts, F.lit(0)), raw))
    district = F.when(one, F.regexp_extract(raw, spaced, 2)).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.struct(raw.alias("raw"), city.alias("city"), district.alias("district"), raw.alias("normalized"))


#: Words and labels of employment types.
EMPLOYMENT = ((("实习", "intern"), "实习"), (("兼职", "part-time", "part time"), "兼职"), (("全职", "full-time", "full time"), "全职"))


def employment(text: Column) -> Column:
    """The label of the first type named; other texts as they are."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    for words, name in EMPLOYMENT:
        said = F.lit(False)
        for w in words:
            said = said | F.contains(F.lower(raw), F.lit(w))
        out = F.coalesce(out, F.when(said, name))
    return F.coalesce(out, raw)


#: Families of roles and the words that tell them, the first that is found.
ROLE_FAMILIES = (
    ("AI/LLM", ("agent", "rag", "llm", "大模型", "智能体", "nlp")), ("AI算法", ("算法", "机器学习", "深度学习", "计算机视觉", "推荐")), ("机器人", ("机器人", "ros", "控制算法", "运动规划")),
    ("后端开发", ("后端", "backend", "server", "服务端")), ("前端开发", ("前端", "frontend", "react", "vue")), ("数据", ("数据分析", "数据工程", "数仓", "data")),
    ("测试", ("测试", "qa", "质量保障")), ("产品", ("产品经理", "产品运营", "product")), ("运维/DevOps", ("运维", "devops", "sre")),
)


def role_family(text: Column) -> Column:
    """The first family of which a text has a word anywhere, else 其他."""
    return ordered_rules(text, [("|".join(words), name) for name, words in ROLE_FAMILIES], "其他")


def ordered_rules(text: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for pattern, name in rules:
        test = F.lower(text).rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(other)) if other is not None else out


def chinese_number(text: Column) -> Column:
    """Numerals up to ninety-nine as a whole number."""
    digit = F.create_map(*[F.lit(x) for k, c in enumerate("零一二三四五六七八九") for x in (c, k)], F.lit("两"), F.lit(2))
    tens, ones = F.regexp_extract(text, "^(.?)十", 1), F.regexp_extract(text, "十(.?)$", 1)
    with_ten = F.when(tens == "", 1).otherwise(digit[tens]) * 10 + F.when(ones == "", 0).otherwise(digit[ones])
    return F.when(text.contains("十"), with_ten).otherwise(digit[text])


def lifecycle(age_days: Column) -> Column:
    """active, possibly_expired from 14 days (or unknown age), expired from 30."""
    return F.when(age_days.isNull(), "possibly_expired").when(age_days >= 30, "expired").when(age_days >= 14, "possibly_expired").otherwise("active")
