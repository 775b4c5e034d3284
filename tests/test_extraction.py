"""Terms, skills and requirements against plain patterns."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import extraction as K
from quarry.operators import matching as Q
from quarry.plans import extraction as plan
from quarry.plans import registry


def pattern(w):
    if w == "C":
        return r"(?<![A-Za-z0-9+#])C(?![A-Za-z0-9+#])"
    return rf"(?<![A-Za-z0-9]){re.escape(w)}(?![A-Za-z0-9])" if re.fullmatch(r"[A-Za-z0-9+.# -]+", w) else re.escape(w)


def plain_spans(text, lexicon):
    out = set()
    for term, wordings in lexicon.terms:
        for w in wordings:
            at = re.compile(f"(?=({pattern(w)}))", re.I)
            out |= {(m.start(), m.start() + len(w), term) for m in at.finditer(text or "")}
    return sorted(out, key=lambda m: (m[0], -m[1], m[2]))


def plain_longest(matches):
    out = []
    for m in matches:
        if all(m[0] >= o[1] or m[:2] == o[:2] for o in out):
            out.append(m)
    return out


ODD = [None, "", "C", "C/C++ and C#", "c语言 C＋＋", "SpringBoot, Spring boot; spring", "React和Vue3", "GOLANG go Go1 1go", "İstanbul Python İ C", "Node.js/nodejs", "大模型与多智能体"]


def test_spans_equal_plain_patterns(spark):
    rng = random.Random(9)
    lexicon = K.skill_lexicon()
    words = [w for _, ws in lexicon.terms for w in ws] + ["and", "的", "+", "#", "x", "C", "C++"]
    texts = ODD + ["".join(rng.choice(words) + rng.choice(["", " ", "/", "、", ", ", "3"]) for _ in range(rng.randint(1, 40))).swapcase() for _ in range(150)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, "Python", "y")], "id long, text string, term string")
    got = Counter(map(tuple, K.spans(df, ["id"], "text", lexicon, longest=False).collect()))
    want = [(k, t) for k, t in enumerate(texts)] + [(0, "Python")]
    assert got == Counter((k, term, a, b) for k, t in want for a, b, term in plain_spans(t, lexicon))
    longest = Counter(map(tuple, K.spans(df, ["id"], "text", lexicon).collect()))
    assert longest == Counter((k, term, a, b) for k, t in want for a, b, term in plain_longest(plain_spans(t, lexicon)))
    assert K.spans(df, ["id"], "text", K.Lexicon(())).count() == 0 and K.spans(df.limit(0), ["id"], "text", lexicon).count() == 0


def test_skills_by_section(spark):
    rows = [
        (1, "requirements", "熟悉 Python 和 C/C++"), (1, "preferred", "Docker, python, Spring Boot; Spring"), (1, "body", "We use Rust"), (1, "requirements", None),
        (2, "body", "Java 后端, C语言"), (2, "preferred", "Kubernetes"), (2, "summary", "Redis"), (3, "requirements", ""), (3, "body", "Go"), (None, "body", "SQL"),
    ]
    df = spark.createDataFrame(rows, "id long, section string, line string")
    got = {(r["id"], r["skill"]): (r["type"], r["importance"]) for r in K.skills(df, "id").collect()}
    must, nice = ("required", 0.7), ("preferred", 0.4)
    assert got == {
        (1, "Python"): must, (1, "C++"): must, (1, "Docker"): nice, (1, "Spring Boot"): nice,
        (2, "Java"): must, (2, "C"): must, (2, "Kubernetes"): nice, (3, "Go"): must, (None, "SQL"): must,
    }


def test_requirements_and_groups_end_to_end(spark):
    text = "负责平台开发\n必须精通 Python；熟悉 React 或 Vue\n至少两种：MySQL、Redis、Kafka 等数据库\nDocker 优先\n了解 Rust; 核心要求 SQL 要求"
    docs = spark.createDataFrame([(1, text), (2, "Java"), (3, None)], "id long, text string")
    found = [("Python", "required"), ("React", "required"), ("Vue", "required"), ("MySQL", "required"), ("Redis", "required"), ("Kafka", "required"), ("Docker", "required"), ("Rust", "required"), ("SQL", "required")]
    listed = spark.createDataFrame([(1, s, t, 0.7) for s, t in found] + [(2, "Go", "preferred", 0.4), (3, "AI", "required", 0.7)], "id long, skill string, type string, importance double")
    asked = K.requirements(docs, "id", "text", listed)
    got = {(r["id"], r["skill"]): r for r in asked.collect()}
    kind = {k: (r["type"], r["relation"], r["at_least"], tuple(r["wanted"])) for k, r in got.items()}
    store = ("Kafka", "MySQL", "Redis")
    assert kind == {
        (1, "Python"): ("must_have_skill", "ALL_OF", 1, ("Python",)), (1, "React"): ("must_have_skill", "ANY_OF", 1, ("React", "Vue")),
        (1, "Vue"): ("must_have_skill", "ANY_OF", 1, ("React", "Vue")), (1, "MySQL"): ("must_have_skill", "AT_LEAST_N", 2, store),
        (1, "Redis"): ("must_have_skill", "AT_LEAST_N", 2, store), (1, "Kafka"): ("must_have_skill", "AT_LEAST_N", 2, store),
        (1, "Docker"): ("preferred_skill", "ALL_OF", 1, ("Docker",)), (1, "Rust"): ("context_skill", "ALL_OF", 1, ("Rust",)),
        (1, "SQL"): ("must_have_skill", "AT_LEAST_N", 2, store),  # "MySQL" is the first unit that has the name
        (2, "Go"): ("preferred_skill", "ALL_OF", 1, ("Go",)), (3, "AI"): ("must_have_skill", "ALL_OF", 1, ("AI",)),
    }
    assert got[1, "Python"]["critical"] and got[1, "Redis"]["group_id"] == got[1, "MySQL"]["group_id"] and got[2, "Go"]["unit_no"] is None
    assert got[3, "AI"]["specificity"] == 0.35 and not got[1, "Docker"]["hard"]
    none = lambda k: F.lit(None).cast(k)
    have = F.struct(F.array(F.lit("Python"), F.lit("Vue"), F.lit("Redis")).alias("skills"), none("string").alias("direction"), none("int").alias("level"), none("double").alias("years"))
    rows = Q.evaluated(asked.where("id = 1").withColumns({"level": none("int"), "minimum": none("double")}), have).withColumn("deduction", F.lit(0.0))
    status = {r["skill"]: r["status"] for r in rows.collect()}
    assert status == status | {"Python": "matched", "React": "matched", "Vue": "matched", "Redis": "missing", "Docker": "missing"}
    score = Q.quick_scores(rows, "id").first()
    assert score["must_have"] == 100.0 and score["preferred"] == 0.0 and score["final"] <= 100.0


def plain_evidence(text, lexicon):
    pieces = [u for u in (p.strip(" -•\t") for p in re.split(r"[\r\n]+", re.sub("([。！？；;])", r"\1\n", text or ""))) if u]
    first = {}
    for term, _ in lexicon.terms:
        name = K.fold(term)
        words = [w for w in re.split(r"[,，/、\s]+", name) if len(w) >= 2]
        at = [n for n, u in enumerate(pieces) if name in K.fold(u)] or [n for n, u in enumerate(pieces) if any(w in K.fold(u) for w in words)]
        if at:
            first.setdefault(at[0], set()).add(term)
    return {(n, pieces[n], tuple(sorted(terms)), tuple(sorted({t for _, _, t in plain_spans(pieces[n], lexicon)}))) for n, terms in first.items()}


def test_evidence_equals_plain_search(spark):
    rng = random.Random(5)
    lexicon = K.skill_lexicon()
    words = ["Machine", "learning", "machine Learning", "Tool", "Spring Boot", "springboot", "boot", "C", "C++", "Vue", "ROS 2", "Claude Code", "code", "的", "大模型", "-", "•"]
    odd = [None, "", "İ Python İ C", "\n\r;；", " -•\t", "Vue -\u2028", "- Go -\x85;C", "；。C;\r\nC++。。Go"]
    texts = odd + ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", "\r\n", "；", "。", ";", "/"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in K.evidence(df, "id", "text", lexicon).collect():
        got.setdefault(r["id"], []).append((r["unit_no"], r["unit"], tuple(sorted(r["skills"])), tuple(r["offered"])))
    assert {k: set(v) for k, v in got.items()} == {k: want for k, t in enumerate(texts) if (want := plain_evidence(t, lexicon))}
    assert sum(map(len, got.values())) == sum(len(set(v)) for v in got.values())
    assert K.evidence(df, "id", "text", K.Lexicon(())).count() == 0


def test_cues_are_what_their_patterns_find(spark):
    rng = random.Random(6)
    bits = sorted({w for ws in K.CUES.values() for w in ws}) + ["核心", "目前", "使用", "具备", "门", "两", "框架", "have", "-", " to ", "ct", "种", "至少 3 ", "x", "有机会"]
    texts = ["", *bits] + ["".join(rng.choice(bits) for _ in range(rng.randint(2, 6))) for _ in range(600)]
    df = spark.createDataFrame([(t.upper() if k % 2 else t,) for k, t in enumerate(texts)], "unit string").withColumn("low", F.lower("unit"))
    unit, low = F.col("unit"), F.col("low")
    both = df.select(*[F.array(K.cue(unit, low, p), unit.rlike(p)) for p in K.CUES]).collect()
    assert all(a == b for r in both for a, b in r)
    assert all({r[k][0] for r in both} == {True, False} for k in range(len(K.CUES)))


def test_requirements_read_a_text_once_and_shuffle_no_texts(spark):
    docs = spark.createDataFrame([(1, "Python or Vue")], "id long, text string")
    listed = spark.createDataFrame([(1, "Python", "required", 0.7)], "id long, skill string, type string, importance double")
    asked = K.requirements(docs, "id", "text", listed).select("id", "skill", "type", "relation", "wanted", "unit_no")
    plan = asked._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("MapInArrow") == 1
    moved = re.findall(r"Exchange hashpartitioning.*\n.*?(\[.*)", plan.executedPlan().toString())
    assert moved and not any(re.search(r"\b(unit|low|text)#", m) for m in moved)


def test_posting_scores_shuffle_no_texts(spark):
    plan = registry.QUERIES["posting_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "split(text" not in plan  # the last line is taken without cutting the others


@pytest.mark.parametrize("name", ["asked_requirements", "posting_scores"])
def test_odd_postings_equal_sql(spark, tmp_path, name):
    rng = random.Random(8)
    words = ["distributed", "Systems", "PROGRAMMING", "teaching", "subsystems", "要求", "必须", "了解", "NICE  to have", "preferred", "must-have", "任意两门", "等语言", "或", "/", "至少 2 种", "-", "•", "x"]
    texts = [None, "", "\n", "systems", "systems\n", "\r\n;；", "- systems/teaching -\u2028;\nteaching", "a\nsystems 或 teaching\nb\n\nsystems\nTeaching SYSTEMS"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\r\n", "；", "。", ";"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    con = duckdb.connect()
    for table, rows in (("documents", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), ("benchmark", spark.createDataFrame([(0, "Distributed systems, programming & teaching")], "item_id long, text string"))):
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    plain = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert len(want) > 50 and plain(got.collect()) == plain(want)


@pytest.mark.parametrize("name", ["asked_requirements", "posting_scores"])
def test_odd_postings_equal_sql_with_a_lexicon_in_parts(spark, tmp_path, monkeypatch, name):
    """alternatives of one unit are one group, whichever parts of the lexicon have them."""
    monkeypatch.setattr(plan, "MOST", 1)
    assert len(plan.lexicons(registry.Tables(spark, "/root/testdata/sf0.001"))) > 1
    test_odd_postings_equal_sql(spark, tmp_path, name)


def test_evidence_of_parts_is_that_of_the_whole(spark):
    """F3, F4."""
    terms = K.skill_lexicon().terms
    parts = [K.Lexicon(terms[k::3], frozenset({"C"})) for k in range(3)]
    texts = [None, "", "Go或Vue\nRust/Go/SQL", "Python；C/C++、Spring Boot, springboot\n大模型 LLM; Vue/React/Go", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = lambda *lexicons: sorted((r["id"], r["unit_no"], r["unit"], sorted(r["skills"]), r["offered"]) for r in K.evidence(df, "id", "text", *lexicons).collect())
    assert rows(*parts) == rows(K.skill_lexicon()) and len(rows(*parts)) > 4


def test_directions(spark):
    rows = {"BD经理": "sales", "Senior Developer": "engineering", "算法工程师": "algorithm", "UX lead": "design", "luxury": "unknown", "": "unknown", None: "unknown", "产品经理（运营）": "operations"}
    df = spark.createDataFrame([(k,) for k in rows], "title string")
    assert {r[0]: r[1] for r in df.select("title", K.direction(F.col("title"))).collect()} == rows
