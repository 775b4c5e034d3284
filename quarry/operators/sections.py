"""Sections of postings by their headings, and what the sections ask for.

A heading is told by one line; which section a line is in is the last heading above it, a window over the lines of a text.
What a section asks for are expressions over a text's lines, gathered by section: bounded by the text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# Headings of sections, patterns of lines, and how many items are kept.
ALIASES = {
    "requirements": (
        "requirements", "qualifications", "what you bring", "任职要求", "岗位要求", "职位要求", "资格要求", "任职资格", "任职条件", "招聘要求", "招聘条件", "岗位资格", "职位资格",
        "我们对你的要求", "你需要具备",
    ),
    "preferred": ("preferred qualifications", "nice to have", "bonus points", "加分项", "优先条件", "加分条件"),
    "responsibilities": (
        "responsibilities", "what you will do", "what you will work on", "you will work on", "岗位职责", "主要职责", "工作职责", "工作内容", "工作职责与内容", "职位职责",
        "你将参与的工作", "你将负责的工作", "主要工作", "你需要参与", "预期需求", "工作任务", "工作内容与职责",
    ),
    "summary": ("summary", "about the role", "职位简介", "岗位简介", "职位描述", "岗位描述", "岗位定位", "岗位简介与职责", "实习职位特点"),
    "skills": ("skills", "technical skills", "技能要求", "技术栈", "核心技能"),
    "benefits": ("benefits", "what we offer", "你将获得", "我们为你提供", "福利待遇", "岗位福利", "实习收获", "公司福利", "岗位的重要性", "岗位价值", "为什么加入我们", "加入我们"),
}
EDUCATION = r"(?i)bachelor|master|phd|degree|本科|硕士|博士|研究生|学士|大专|专科|中专|高中|学历不限|学历不作要求|education"
EXPERIENCE = r"(?i)\d+\s*(?:\+|至|-|~)?\s*(?:years?|年)|经验不限|无经验|无需经验|工作经验|项目经验|相关经验|经验要求|经验|experience"
DUTY_STARTS = (
    "(?i)^(?:负责|参与|协助|开发|设计|构建|搭建|维护|完成|推动|跟进|探索|研究|实现|支持|分析|优化|制定|对接|开展|承担|沉淀|整理|收集|执行|进行|帮助|配合|协同|撰写|"
    "build|develop|design|implement|maintain|support|own|drive|work on)"
)
ABILITY_STARTS = (
    "(?i)^(?:本科|硕士|博士|研究生|大专|专科|学历|经验|熟悉|掌握|了解|具备|有|能够|能|可以|会|精通|熟练|接受|愿意|热爱|对|正在就读|在读|应届|每周|可连续|可长期|英语|专业|"
    "工作认真|学习|逻辑|沟通|自驱|实习生)"
)
MOST = {"responsibilities": 12, "qualifications": 16, "preferred_qualifications": 12, "benefits": 12}
_NUMERAL = "一二三四五六七八九十"
_SITES = r"(?:智联招聘|牛客网)\s*$"
#: Inside a class: what is taken off around a heading.
_AROUND = r"\s#\-—_=~*•·:：;；【】\[\]（）()"
#: Radicals that pages show in place of the characters that look the same.
_RADICALS = {chr(k): unicodedata.normalize("NFKC", chr(k)) for k in range(0x2E80, 0x3000) if len(unicodedata.normalize("NFKC", chr(k))) == 1 and unicodedata.normalize("NFKC", chr(k)) != chr(k)}


def posting_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line of the lines that hold something: radicals as characters, white space as one space, no site names at ends."""
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(whole.rlike(r"[\x{2e80}-\x{2fff}]"), F.translate(whole, "".join(_RADICALS), "".join(_RADICALS.values()))).otherwise(whole)
    plain = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"[\x{200b}-\x{200d}\x{feff}]", "")
    cut = F.transform(F.split(plain, r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"[ \t\x{a0}]+", " ")), _SITES, "")))
    return docs.select(key, F.posexplode(F.filter(cut, lambda x: x != "")).alias("line_no", "line"))


def heading_type(line: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The section that a heading names, alone or before a separator; body for another one numbered in Chinese; else null."""
    major = rf"^[{_NUMERAL}百]+\s*[、．.]\s*"
    # What any heading begins with, told before the line is cleaned: few lines do.
    every = "|".join(w for words in (aliases or ALIASES).values() for w in words).replace(" ", r"\s+")
    may = F.lower(line).rlike(rf"^(?:[{_AROUND}{_NUMERAL}百0-9、．.]*(?:{every})(?:$|[{_AROUND}|｜/\x{{85}}\x{{2028}}\x{{2029}}])|[\s#]*[{_NUMERAL}百])")
    bare = F.trim(F.regexp_replace(line, r"^\s{0,3}#{1,6}\s*", ""))

    def named(bare: Column) -> Column:
        core = F.regexp_replace(bare, rf"^(?:[{_NUMERAL}百]+|\d{{1,2}})\s*[、．.]\s*", "")
        core = F.regexp_replace(core, rf"^[（(]\s*[{_NUMERAL}百]+\s*[）)]\s*", "")
        core = F.regexp_replace(core, r"^[\s\-—_=~*•·]+|[\s\-—_=~*•·]+$", "")
        core = F.regexp_replace(F.lower(F.regexp_replace(core, r"^[ #:：;；【】\[\]（）()]+|[ #:：;；【】\[\]（）()]+$", "")), r"\s+", " ")
        found = let(core, lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{'|'.join(words)})(?:$|[ :：|｜\\-—/\\[【(（])"), name) for name, words in (aliases or ALIASES).items()]))
        return F.coalesce(found, F.when(bare.rlike(major), "body"))

    return F.when(may, let(bare, named))


def split_heading(line: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(heading, content): the section that a line names in brackets, between rules, as a whole or before a colon, and
    what follows; a null heading for other lines."""
    bracket, ruled = r"^\s*[【\[（(]\s*([^】\]）)]{1,40})\s*[】\]）)]\s*(.*)$", r"^\s*[-—_=~]{2,}\s*(.+?)\s*[-—_=~]{2,}\s*(.*)$"
    colon = r"^[【\[（(]?([^】\]）):：]{2,20})[】\]）)]?[：:]\s*(.+)$"
    of = lambda pattern: F.when(line.rlike(pattern), heading_type(F.regexp_extract(line, pattern, 1), aliases))
    rest = lambda pattern: F.trim(F.regexp_extract(line, pattern, 2))
    tried = F.struct(of(bracket).alias("a"), of(ruled).alias("b"), heading_type(line, aliases).alias("c"), of(colon).alias("d"))
    return let(tried, lambda t: F.struct(
        F.coalesce(t["a"], t["b"], t["c"], t["d"]).alias("heading"),
        F.when(t["a"].isNotNull(), F.regexp_replace(rest(bracket), "^[ ：:]+", "")).when(t["b"].isNotNull(), rest(ruled)).when(t["c"].isNotNull(), "").when(t["d"].isNotNull(), rest(colon))
        .otherwise(line).alias("content")))


def posting_sections(docs: DataFrame, key: str, text: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """key, section, line_no, line of every line that isn't a heading, and of what follows a heading on its line.

    Before the first heading all is body. Null and empty texts have no rows; keys must be unique.
    """
    cut = posting_lines(docs, key, text).withColumn("h", split_heading(F.col("line"), aliases))
    above = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("section", F.coalesce(F.last("h.heading", ignorenulls=True).over(above), F.lit("body")))
    return marked.where("h.content <> ''").select(key, "section", "line_no", F.col("h.content").alias("line"))


def _clean(line: Column) -> Column:
    bare = F.regexp_replace(line, rf"^\s*(?:[-•*·]|\(?\d{{1,2}}[.)、，,）]|[{_NUMERAL}]+[、.])\s*", "")
    return F.regexp_replace(bare, r"^[ \-—]+|[ \-—]+$", "")


def _label(line: Column) -> Column:
    return F.trim(line).rlike(r"^[^。；;，,]{2,24}[：:]$")


def _items(lines: Column) -> Column:
    """The items of lines, cut before numbers: longer than four characters and no mere labels, each once."""
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, rf"(?<![A-Za-z0-9])(?=\s*(?:\d{{1,2}}\s*[.)、，,）]|[{_NUMERAL}]+\s*[、.]))")))
    cleaned = F.transform(F.filter(F.transform(cut, F.trim), lambda x: x != ""), _clean)
    return F.array_distinct(F.filter(cleaned, lambda x: (F.length(x) > 4) & ~_label(x)))


def _inferred(lines: Column, start: str, numbered: bool = False) -> Column:
    test = rf"^\s*(?:\d{{1,2}}\s*[.)、，,）]|[{_NUMERAL}]+\s*[、.])"
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), _clean(x).alias("clean")))
    kept = F.filter(both, lambda x: (F.length(x["clean"]) > 4) & ~_label(x["clean"]) & (x["clean"].rlike(start) | (x["line"].rlike(test) if numbered else F.lit(False))))
    return F.array_distinct(F.transform(kept, lambda x: x["clean"]))


def posting_requirements(sections: DataFrame, key: str) -> DataFrame:
    """key, education, experience (the first line that tells them, or ''), responsibilities, qualifications,
    preferred_qualifications, benefits of posting_sections' rows. Lines of body and summary that begin like duties or
    abilities count where their sections say nothing."""
    names = ("requirements", "preferred", "responsibilities", "summary", "benefits", "body")
    gathered = sections.groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("line_no", "line")))).alias(s) for s in names])
    lines = gathered.select(key, *[F.transform(s, lambda x: x["line"]).alias(s) for s in names])
    described = F.concat("body", "summary")
    made = lines.withColumns({"__described": described, "__duties": _items(F.col("responsibilities"))})
    made = made.withColumn("__able", _inferred(F.col("__described"), ABILITY_STARTS))
    all_ = F.concat("requirements", "__able", "__described")
    first = lambda pattern: F.coalesce(F.get(F.filter(F.transform(all_, _clean), lambda x: x.rlike(pattern) & ~_label(x)), F.lit(0)), F.lit(""))
    told = _inferred(F.when(F.size("__duties") > 0, F.col("body")).otherwise(F.col("__described")), DUTY_STARTS, True)
    parts = {
        "responsibilities": F.concat("__duties", told), "qualifications": F.concat(_items(F.col("requirements")), F.col("__able")),
        "preferred_qualifications": _items(F.col("preferred")), "benefits": _items(F.col("benefits")),
    }
    return made.select(key, first(EDUCATION).alias("education"), first(EXPERIENCE).alias("experience"), *[F.slice(F.array_distinct(c), 1, MOST[n]).alias(n) for n, c in parts.items()])
