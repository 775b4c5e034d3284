"""Sections and requirements of postings, against rows and a line-by-line reading."""

import re

from pyspark.sql import functions as F

from quarry.operators import sections as Y
from quarry.plans.extraction import HEADS

FOLDER = "/root/testdata/sf0.001"
POSTING = """我们是一家公司
## 你将参与的工作
1. 负责模型训练与部署
2、参与数据平台建设；
【任职要求】 本科及以上学历
- 熟悉 Python，三年以上经验
• 掌握 SQL
核心技能：Spark
——加分项——
有开源项目
四、岗位故事
热爱技术的团队 牛客网
Benefits / perks
五险一金，弹性工作
（二）工作内容与职责
desi⼤gn systems
"""


def test_posting(spark):
    df = spark.createDataFrame([(1, POSTING), (2, None), (3, "经验不限\n负责前端开发与维护\n1) 撰写技术文档等\n要求：\n熟悉 React 框架的使用"), (4, "")], "id int, text string")
    got = {}
    for r in sorted(Y.posting_sections(df, "id", "text").collect(), key=lambda r: (r["id"], r["line_no"])):
        got.setdefault((r["id"], r["section"]), []).append(r["line"])
    assert got == {
        (1, "body"): ["我们是一家公司", "热爱技术的团队"],
        (1, "responsibilities"): ["1. 负责模型训练与部署", "2、参与数据平台建设；", "desi大gn systems"],
        (1, "requirements"): ["本科及以上学历", "- 熟悉 Python，三年以上经验", "• 掌握 SQL"], (1, "preferred"): ["有开源项目"], (1, "benefits"): ["五险一金，弹性工作"],
        (3, "body"): ["经验不限", "负责前端开发与维护", "1) 撰写技术文档等", "要求：", "熟悉 React 框架的使用"],
    }
    told = {r["id"]: r for r in Y.posting_requirements(Y.posting_sections(df, "id", "text"), "id").collect()}
    one, three = told[1], told[3]
    assert (one["education"], one["experience"]) == ("本科及以上学历", "熟悉 Python，三年以上经验")
    assert one["responsibilities"] == ["负责模型训练与部署", "参与数据平台建设；", "desi大gn systems"]
    assert one["qualifications"] == ["本科及以上学历", "熟悉 Python，三年以上经验", "掌握 SQL", "热爱技术的团队"]
    assert one["preferred_qualifications"] == ["有开源项目"] and one["benefits"] == ["五险一金，弹性工作"]
    assert (three["education"], three["experience"]) == ("", "经验不限")
    assert three["responsibilities"] == ["负责前端开发与维护", "撰写技术文档等"] and three["qualifications"] == ["熟悉 React 框架的使用"]


def test_headings(spark):
    lines = {
        "Requirements": "requirements", "### What you bring:": "requirements", "3. 任职资格": "requirements", "【加分项】": None, "核心技能 | 必看": "skills", "要求很高": None,
        "岗位职责描述如下": None, "（一）岗位价值": "benefits", "五、其他": "body", "5、其他": None, "": None, "== 技术栈 ==": "skills", "SUMMARY - role": "summary",
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r[0]: r[1] for r in df.select("line", Y.heading_type(F.col("line"))).collect()}
    assert got == lines | {"【加分项】": "preferred"}


def test_sections_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("text IS NOT NULL")
    got = {(r["doc_id"], r["line_no"]): (r["section"], r["line"]) for r in Y.posting_sections(docs, "doc_id", "text", HEADS).collect()}
    want = {}
    for d in docs.select("doc_id", "text").collect():
        section = "body"
        lines = [re.sub(r"[ \t\xa0]+", " ", x).strip(" ") for x in d["text"].split("\n")]
        for n, line in enumerate(x for x in lines if x):
            core = re.sub(r"\s+", " ", re.sub(r"^[\s\-—_=~*•·]+|[\s\-—_=~*•·]+$", "", line).strip(" #:：;；【】[]（）()").lower())
            named = next((s for s, words in HEADS.items() if any(core == w or (core.startswith(w) and core[len(w)] in " :|-/[(") for w in words)), None)
            if named:
                section = named
            else:
                want[d["doc_id"], n] = (section, line)
    assert len({s for s, _ in want.values()}) > 3 and got == want


def test_headings_are_told_before_lines_are_cleaned(spark):
    """Only lines that begin like a heading are cleaned, and none is missed for what is around it."""
    bare = ["the", "THE end", "a", "nice to have", "what  you\tbring"]
    odd = [f"{x}{w}{y}" for w in bare for x in ("", " ## ", "二、", "12.", "（三） ", "** - ", "【") for y in ("", " ***", "】：", " - ", "：x", "|x", "/x", "\u2028***")]
    other = ["them", "an end", "x the", "", "百.", "# 十 、 x", "一 the"]
    aliases = {"one": ("the", "a"), "two": ("nice to have", "what you bring")}
    df = spark.createDataFrame([(x,) for x in [*odd, *other]], "line string").select("line", Y.heading_type(F.col("line"), aliases).alias("h"))
    got = {r["line"]: r["h"] for r in df.collect()}
    assert all(got[x] in ("one", "two") for x in odd if x[-1] != "】") and [got[x] for x in other] == [None, None, None, None, "body", "body", None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("regexp_replace")
