"""Operators whose rules the tables' texts don't reach."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.functions import parse as P
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import aggregates as A
from quarry.operators import dedup as D
from quarry.operators import etl as X
from quarry.operators import filters as C
from quarry.operators import incremental as I
from quarry.operators import joins as J
from quarry.operators import metrics as M
from quarry.operators import retrieval as R
from quarry.operators import scoring as S
from quarry.operators import matching as Q
from quarry.operators import windows as W
from quarry.plans import registry
from quarry.sources import records
from quarry.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pay(spark):
    pay = lambda s: one(spark, P.pay(F.lit(s)))
    r = pay("15-25K·14薪")
    assert (r["minimum"], r["maximum"], r["months"], r["unit"]) == (15000, 25000, 14, "cny_month")
    r = pay("150-200元/天")
    assert (r["minimum"], r["maximum"], r["unit"]) == (150, 200, "cny_day")
    assert pay("50-80元/小时")["unit"] == "cny_hour"
    assert pay("面议")["status"] == "negotiable" and pay("")["status"] == "unknown"
    assert pay("1-2万")["minimum"] == 10000 and pay("1-2萬")["maximum"] == 20000
    r = pay("20-40K")
    assert (r["months"], r["confidence"], r["status"], r["currency"]) == (None, 0.95, "parsed", "CNY")
    assert pay("薪资面谈")["confidence"] == 1.0 and pay("看能力")["status"] == "unparsed" and pay("看能力")["unit"] == ""
    assert (pay("30万/年")["unit"], pay("30万/年")["minimum"], pay("200/day")["unit"]) == ("cny_year", 300000, "cny_day")


def test_approximate_tokens(spark):
    count = lambda s: one(spark, T.approx_tokens(F.lit(s)))
    assert [count(s) for s in ("", "数据库 SQL", "c++/node.js", "né!", "a_b-c d")] == [0, 4, 7, 2, 4]
    assert one(spark, T.plain_digits(F.lit("\ue032\ue035-\ue031K"))) == "14-0K"
    assert one(spark, T.skill_name(F.lit("  Spring_Boot -- 3. "))) == "spring boot 3"


def test_places_levels_years(spark):
    places = {x: tuple(one(spark, P.place(F.lit(x)))) for x in ("武汉 洪山区", "武汉市 洪山区", "北京·海淀·中关村", "New York", "上海 张江", "", None)}
    assert places == {
        "武汉 洪山区": ("武汉 洪山区", "武汉", "洪山区", "武汉 洪山区"), "武汉市 洪山区": ("武汉市 洪山区", "武汉市", "洪山区", "武汉市 洪山区"),
        "北京·海淀·中关村": ("北京·海淀·中关村", "北京", "海淀", "北京·海淀·中关村"), "New York": ("New York", "New York", "", "New York"),
        "上海 张江": ("上海 张江", "上海 张江", "", "上海 张江"), "": ("", "", "", ""), None: ("", "", "", "")}
    assert one(spark, P.schooling(F.lit("本科及以上，硕士优先"))) == "bachelor"
    assert one(spark, P.schooling_level(F.lit("本科及以上，硕士优先"))) == 4
    assert [one(spark, P.role_family(F.lit(x))) for x in ("RAG 工程师", "数据分析师", "Cook")] == ["AI/LLM", "数据", "其他"]
    assert one(spark, P.years_required(F.lit("经验不限"))) == 0
    assert [one(spark, P.employment(F.lit(x))) for x in ("Intern", "part time", "全职", " 合同工 ", None)] == ["实习", "兼职", "全职", "合同工", ""]
    assert [one(spark, P.chinese_number(F.lit(s))) for s in ("三", "十二", "二十五", "两")] == [3, 12, 25, 2]
    assert [one(spark, P.lifecycle(F.lit(d))) for d in (1, 20, 40, None)] == ["active", "possibly_expired", "expired", "possibly_expired"]


def test_text(spark):
    assert one(spark, T.grams(F.lit("数据库 SQL"))) == ["sql", "zh2:数据", "zh2:据库", "zh3:数据库"]
    assert one(spark, T.bounded_contains(F.lit("uses go daily"), "go")) and not one(spark, T.bounded_contains(F.lit("mongodb"), "go"))
    assert [one(spark, T.clean_title(F.lit(x))) for x in ("[急招]  Data   Engineer", "【招聘中】后端 - ", "实习招聘|前端")] == ["Data Engineer", "后端", "前端"]
    assert S.query_terms("Python 后端工程师") == ["python 后端工程师", "python", "后端工程师", "后端", "工程", "程师", "端工"]
    assert one(spark, T.fingerprint(F.lit("a"), F.lit(" "))) is None
    assert one(spark, T.canonical_url(F.lit("HTTPS://A.Example/p/?q=1#x"))) == "https://a.example/p"
    assert one(spark, T.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert abs(one(spark, V.sigmoid(F.lit(100.0))) - 1) < 1e-9
    assert one(spark, X.normal_form(F.lit("ａ"))) == "a"


def test_html_and_sections(spark):
    rows = {
        "<script>x()</script><div>A&amp;B</div><button>Apply</button>\r\n": "A&B\nApply", "<p>立即沟通</p><p>A</p><div> · </div>登录": "A", None: "", "plain​ text⁠ here": "plain text here",
        "a<br/>b<svg><p>no</p></svg>c<!-- <p>x</p> -->d": "a\nbcd", "&lt;b&gt;bold&lt;/b&gt; 1 < 2 &amp;amp; 3": "bold 1 < 2 & 3", "<a title='x>y'>in</a><noscript>never closed": "in",
        "<pre>kept</pre><h5>same</h5>line": "keptsameline", "BOSS直聘 \n • 负责 \t 开发": "• 负责 开发",
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id int, html string")
    got = {r["id"]: r for r in X.clean_html(df, "html", "text").collect()}
    assert [got[k]["text"] for k in range(len(rows))] == list(rows.values())
    assert got[1]["text_removed"] == ["立即沟通", "登录"] and got[2]["text_warnings"] == ["clean_text_empty", "description_too_short"]
    odd = spark.createDataFrame([(1, "�" + "x" * 50)], "id int, html string")
    assert X.clean_html(odd, "html", "text").first()["text_warnings"] == ["unmapped_private_or_replacement_character"]
    text = "intro\n岗位职责：\n1. build\n- test；写文档；\n【任职要求】\nsql\n三、福利待遇：五险一金\n加分项|加分项\nNice to have: Rust\n负责。 2、上线"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = {(r["section"], r["item_index"]): (r["item"], r["line_index"]) for r in X.split_sections(df, "id", "text").collect()}
    assert got == {
        ("other", 0): ("intro", 0), ("responsibilities", 0): ("build", 2), ("responsibilities", 1): ("test；", 3), ("responsibilities", 2): ("写文档；", 3), ("requirements", 0): ("sql", 5),
        ("benefits", 0): ("五险一金", 6), ("preferred", 0): ("Rust", 8), ("preferred", 1): ("负责。", 9), ("preferred", 2): ("上线", 9)}


def test_chunks():
    text = "\n".join(f"line {k} " + "word " * 20 for k in range(30))
    made = X.chunk_one(text, 400, 80, 30)
    assert all(len(c) <= 400 and n <= 80 for _, c, n in made)
    assert {line.strip() for line in text.split("\n")} == {x for _, c, _ in made for x in c.split("\n")}
    assert X.chunk_one("", 10, 10, 1) == []


def test_pipeline_record(spark):
    html = "<p>岗位职责：</p><li>1. 负责 Python 与 Spark 平台的开发和维护</li><p>任职要求</p><li>熟悉 SQL，三年以上经验</li><li>Go 优先</li><p>" + "We build useful data systems together. " * 2 + "</p>"
    rows = [("a", "1", "[急招] Ｄata Engineer", "10-20K", "武汉 洪山区", html, "Acme", "本科", "3-5年", "全职"), ("a", "2", None, None, None, None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "source string, source_job_id string, raw_title string, raw_salary string, raw_location string, description_html string,"
                                      " company_name string, education string, experience string, employment_type string")
    got = {r["source_job_id"]: r for r in X.process(raw).collect()}
    r = got["1"]
    assert (r["title"], r["salary"]["maximum"], r["education"], r["experience"], r["employment_type"]) == ("Data Engineer", 20000, "本科", "3-5年", "全职")
    assert r["responsibilities"] == ["负责 Python 与 Spark 平台的开发和维护"] and r["requirements"][:2] == ["熟悉 SQL，三年以上经验", "Go 优先"]
    assert [(s["name"], r["clean_description"][s["start_char"] : s["end_char"]]) for s in r["skills"]] == [(x, x) for x in ("Go", "Python", "SQL", "Spark")]
    assert (r["quality"]["score"], r["quality"]["level"], r["warnings"]) == (1.0, "high", [])
    empty = got["2"]
    assert empty["quality"]["score"] == 0.03 and empty["quality"]["level"] == "low" and empty["skills"] == [] and empty["requirements"] == []
    assert empty["warnings"] == ["clean_text_empty", "description_too_short", "missing_company", "missing_location", "missing_education", "missing_experience"]


def test_evidence_and_skills(spark):
    e = one(spark, X.evidence(F.lit("We use Spark here"), F.lit("spark")))
    assert (e["start_char"], e["end_char"], e["valid"]) == (7, 12, True)
    assert not one(spark, X.evidence(F.lit("nothing"), F.lit("spark")))["valid"]
    items = spark.createDataFrame([(1, "body", "likes spark"), (1, "requirements", "Spark and SQL")], "id int, section string, item string")
    got = {(r["skill"], r["importance"]) for r in X.skills(items, "id", "section", "item", {"spark": (), "sql": ("mysql",)}).collect()}
    assert got == {("spark", "required"), ("sql", "required")}


def test_filters(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 3, None), (3, None, None), (4, 9, 12)], "id int, low int, high int")
    assert [r["id"] for r in df.where(C.overlaps_strictly("low", "high", 4, 8)).orderBy("id").collect()] == [1]
    assert [r["id"] for r in df.where(C.overlaps_tolerantly("low", "high", 4, 8)).orderBy("id").collect()] == [1, 2, 3]
    assert C.synonyms(["intern"], {"internship": ["intern", "实习"]}) == ["intern", "internship", "实习"]
    keys = spark.createDataFrame([("skill.sql",), ("skills",)], "k string")
    assert keys.where(C.key_matches("k", "skill.*")).count() == 1


def test_greedy_matches(spark):
    shape = "case_id int, position int, name string, arguments map<string,string>"
    want = spark.createDataFrame([(1, 0, "find", {"a": "1"}), (1, 1, "find", {"a": "2"}), (1, 2, "open", {})], shape)
    seen = spark.createDataFrame([(1, 0, "find", {"a": "2", "b": "x"}), (1, 1, "find", {"a": "9"})], shape)
    got = {r["expected_position"]: (r["observed_position"], r["exact"]) for r in J.greedy_matches(want, seen, "case_id").collect()}
    assert got == {0: (1, False), 1: (0, True), 2: (None, False)}
    m = M.tool_metrics(J.greedy_matches(want, seen, "case_id"), seen, "case_id").first()
    assert (m["expected"], m["matched"], m["exact"]) == (3, 2, 1)


def test_windows(spark):
    df = spark.createDataFrame([("q", "a", 1, 9.0), ("q", "a", 2, 8.0), ("q", "b", 3, 7.0), ("q", "a", 4, 6.0)], "q string, co string, id int, s double")
    got = [r["id"] for r in W.two_pass(df, "q", "co", "id", "s", 3).orderBy("rank").collect()]
    assert got == [1, 3, 2]
    items = F.array(*[F.struct(F.lit(c).alias("c")) for c in (5, 7, 4)])
    assert [x["c"] for x in one(spark, W.within_budget(items, "c", 10))] == [5, 4]
    split = W.grouped_split(spark.range(1000).withColumn("g", F.col("id") % 50), "g")
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_two_pass_sees_every_company(spark, tmp_path):
    rows = [("en", "hot", k, 10_000 - k) for k in range(400)] + [("en", f"s{k % 12}", 1000 + k, 500 - k) for k in range(60)]
    spark.createDataFrame(rows, "lang string, source string, doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["two_pass_diversity"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["source"] for r in got] == ["hot", *[f"s{k}" for k in range(9)]]
    # Items that many companies share, against the greedy choice over all rows.
    rng = random.Random(4)
    for companies, items in ((4, 3), (6, 40), (60, 4), (3, 500)):
        rows = [(rng.randrange(companies), rng.randrange(items), rng.randrange(50)) for _ in range(600)]
        want, used, times = [], Counter(), Counter()
        for cap in (1, 2):
            for at, (c, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1], r[0]))):
                if len(want) < 10 and at not in {x[0] for x in want} and used[c] < cap and times[i] < 2:
                    want.append((at, c, i))
                    used[c] += 1
                    times[i] += 1
        df = spark.createDataFrame([("q", *r) for r in rows], "q string, co long, id long, s long")
        got = [(r["co"], r["id"]) for r in W.two_pass(df, "q", "co", "id", "s").orderBy("rank").collect()]
        assert got == [x[1:] for x in want]


def test_metrics(spark):
    ranks = spark.createDataFrame([("c", "x", 1), ("c", "y", 2), ("c", "x", 3), ("d", "z", 1)], "case_id string, id string, rank int")
    judged = spark.createDataFrame([("c", "y", 2), ("c", "w", 1), ("d", "z", 0)], "case_id string, id string, grade int")
    m = {r["case_id"]: r for r in M.ranking_metrics(ranks, judged, "case_id", "id", 5).collect()}
    assert m["c"]["mrr"] == 0.5 and m["c"]["recall"] == 0.5 and abs(m["c"]["precision"] - 0.2) < 1e-9
    assert m["d"]["ndcg"] is None
    cases = spark.createDataFrame([("a", "t", "dev"), ("b", "t", "test"), ("a", "u", "dev")], "case_id string, topic string, split string")
    bad = M.label_violations(cases, spark.createDataFrame([("a", "q", 5)], "case_id string, id string, grade int"), spark.createDataFrame([("x",)], "id string"))
    assert {r["kind"] for r in bad.collect()} == {"repeated_case", "split_leak", "foreign_judgment", "bad_grade"}


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    r = A.bootstrap(df, "t", "v", 200).first()
    assert r["low"] < r["mean"] < r["high"]


def test_dedup_and_incremental(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "p", "k"), (3, "q", "k"), (4, "r", None)], "id int, a string, b string")
    assert sorted(r["id"] for r in D.cascade(df, [F.col("a"), F.col("b")], ["id"]).collect()) == [1, 3, 4]
    have = spark.createDataFrame([(1, "x", 1)], "k int, v string, generation int")
    got = {r["k"]: (r["v"], r["generation"]) for r in I.upsert(have, spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string"), ["k"]).collect()}
    assert got == {1: ("y", 2), 2: ("z", 1)}


def test_scores(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, S.skill_score(arr("a"), arr("a", "b"), arr("c"))) == 40.0
    assert one(spark, S.skill_score(arr("a"), arr(), arr())) == 50.0
    assert one(spark, S.education_score(F.lit(3), F.lit(4))) == 45.0
    assert one(spark, S.final_score({"skill": F.lit(80.0), "llm": F.lit(None).cast("double")})) == 80.0
    assert one(spark, S.capped(F.lit(90.0), [(F.lit(True), 35)])) == 35.0
    assert one(spark, R.numbers_grounded(F.lit("3 of 12"), F.lit("12 rows"))) == ["3"]


def test_simhash_pairs(spark):
    base = " ".join(f"w{k}" for k in range(400))
    df = spark.createDataFrame([(1, base), (2, base + " extra"), (3, " ".join(f"z{k}" for k in range(400))), (4, None)], "id int, t string")
    got = [(r["first_id"], r["second_id"]) for r in J.simhash_pairs(df, "id", "t").collect()]
    assert got == [(1, 2)]


def test_nearest_of_many_queries(spark):
    """More queries than one block or the earlier limit of 10,000, ties, and vectors without a cosine."""
    point = F.pmod(F.col("id") * 37, F.lit(360)).cast("double") * 0.0174532925
    rows = spark.range(30).select("id", F.array(F.cos(point), F.sin(point)).alias("vector"))
    odd = spark.createDataFrame([(100, None), (101, [0.0, 0.0]), (102, [1.0]), (103, [1.0, None])], "id long, vector array<double>")
    table = rows.unionByName(odd).unionByName(rows.where("id = 3").withColumn("id", F.lit(50).cast("long")))
    many = spark.range(400).withColumnRenamed("id", "n")
    queries = table.crossJoin(F.broadcast(many)).select((F.col("id") + 1000 * F.col("n")).alias("query_id"), "vector")
    assert queries.count() > 10_000
    q = queries.select("query_id", F.col("vector").alias("v"))
    want = table.crossJoin(q).where("query_id <> id").select("query_id", "id", F.round(V.cosine(F.col("v"), F.col("vector")), 6).alias("score"))
    want = J.top_k(want, "query_id", [F.desc("score"), F.asc("id")], 3)
    rows_of = lambda df: sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=lambda r: r[:2])
    assert rows_of(J.nearest(queries, table, 3)) == rows_of(want)
    small = queries.where("query_id < 1000")
    assert rows_of(J.nearest(small, table, 34, 7, 5)) == rows_of(J.nearest(small, table, 34))
    assert J.nearest(queries.limit(0), table, 3).count() == 0 and J.nearest(small, table.limit(0), 3).count() == 0


def test_simhash_pairs_keep_copies(spark):
    base, alone = " ".join(f"w{k}" for k in range(400)), " ".join(f"z{k}" for k in range(400))
    rows = [(1, base), (2, base + " extra"), (3, base.upper() + "!"), (4, base + " é"), (None, base)] + [(k, alone) for k in range(10, 60)] + [(10, alone)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = sorted((r["first_id"], r["second_id"], r["copy"]) for r in J.simhash_pairs(df, "id", "t").collect())
    assert got == [(1, 2, False), (1, 3, True), (1, 4, True)] + [(10, k, True) for k in range(11, 60)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿héllo".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in records.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("héllo", None), "b.pdf": (None, "unsupported")}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nbroken\n')
    rows = records.json_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()
    assert sorted((r["a"] or 0) for r in rows) == [0, 1]
    pages = spark.createDataFrame([(1, "http://h/", '<div class="job card"><a href="/x">Title <b>one</b></a></div><p>no</p>')], "page_id int, url string, html string")
    assert [tuple(r) for r in records.cards(pages, "job").collect()] == [(1, 0, "http://h/x", "Title one")]
    df = spark.range(10)
    assert records.manifest(df).first() == records.manifest(df.orderBy(F.desc("id"))).first()


def test_stream_upserts(spark, tmp_path):
    src, table, state, shape = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state"), "k int, v string, at int"
    stored = lambda: {r["k"]: r["v"] for r in E.upserted(spark, table, shape).collect()}
    assert stored() == {}
    want = {}
    for n in range(5):
        rows = [(1, "a", 1), (1, "b", 2), (2, "c", 1)] if n == 0 else [(k, f"{n}", n + 10) for k in range(n, 40, 7)] + [(1, "late", 0)]
        spark.createDataFrame(rows, shape).repartition(1).write.mode("append").parquet(src)
        E.upserts(spark.readStream.schema(shape).parquet(src), table, ["k"], "at", state, buckets=8)
        want |= {1: "b", 2: "c"} if n == 0 else {k: f"{n}" for k in range(n, 40, 7)}
        assert stored() == want
    assert len(list((tmp_path / "table/versions").iterdir())) == 2
    held = {v for x in E._versions(table) for v in x["held"].items()}
    assert {(p.name.split("=")[1], int(p.parent.name)) for p in (tmp_path / "table/data").glob("*/__bucket=*")} == held


def test_dictionaries_and_conflicts(spark):
    df = spark.createDataFrame([(1, "MySQL and Postgres"), (2, None), (3, "plain")], "id int, t string")
    got = {(r["id"], r["canonical"]) for r in J.substring_hits(df, "id", "t", {"sql": (), "postgres": ("pg",)}).collect()}
    assert got == {(1, "sql"), (1, "postgres")}
    claims = spark.createDataFrame([("t", 1, ["pay", "is", "high"], ["3"]), ("t", 2, ["pay", "is", "low"], ["5"]), ("t", 3, ["other"], ["9"]), ("u", 4, ["pay", "is", "high"], ["7"])],
                                   "topic string, id int, w array<string>, n array<string>")
    assert [(r["first_id"], r["second_id"]) for r in J.conflicts(claims, "topic", "id", "w", "n").collect()] == [(1, 2)]


def test_queue_and_expiry(spark):
    shape = "run_id int, status string, attempts int, available_at timestamp, updated_at timestamp"
    t = lambda s: __import__("datetime").datetime.fromisoformat(s)
    rows = [(1, "PENDING", 0, t("2024-01-01"), t("2024-01-02")), (2, "DONE", 0, t("2024-01-01"), t("2024-01-01")), (3, "RUNNING", 5, t("2024-01-01"), t("2024-01-01")),
            (4, "PENDING", 1, t("2024-03-01"), t("2024-01-01")), (5, "RUNNING", 4, t("2024-01-01"), t("2024-01-01"))]
    assert [r["run_id"] for r in E.due(spark.createDataFrame(rows, shape), "2024-02-01 00:00:00").collect()] == [5, 1]
    held = spark.createDataFrame([(1, t("2024-01-01"), False), (2, t("2024-01-01"), True), (3, None, None)], "id int, until timestamp, pinned boolean")
    assert [r["id"] for r in E.expired(held, "2024-02-01 00:00:00", "until", "pinned").collect()] == [1]


def test_deficit_split(spark):
    sizes = {"a": 50, "b": 20, "c": 10, "d": 10, "e": 5, "f": 5}
    df = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "g string, k int")
    got = {r["g"]: r["split"] for r in W.deficit_split(df, "g").distinct().select("g", "split").distinct().collect()}
    assert got == {"a": "train", "b": "dev", "c": "test", "d": "test", "e": "train", "f": "train"}


def test_fuzzy_pairs(spark):
    rows = [(1, "Acme", "Senior Data Engineer", "Berlin"), (2, "acme", "Senior Data Engineers", "Berlin"), (3, "Acme", "Cook", "Berlin"),
            (4, "Other", "Senior Data Engineer", "Berlin"), (5, "Acme", "Senior Data Engineer", "Berlin"), (6, None, "Senior Data Engineer", "Berlin")]
    df = spark.createDataFrame(rows, "id int, company string, title string, place string")
    got = sorted((r["first_id"], r["second_id"]) for r in Q.fuzzy_pairs(df, "id", "company", ["title", "place"]).collect())
    assert got == [(1, 2), (1, 5)]


def test_ranks_and_frontier(spark):
    rng = random.Random(3)
    values = [(g, rng.choice([1.0, 2.5, rng.random() * 100])) for g in "ab" for _ in range(501)]
    df = spark.createDataFrame([*values, ("c", 7.0), ("a", None)], "g string, v double")
    got = {r["g"]: r for r in A.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "top": 1.0}).collect()}
    for g in "ab":
        mine = sorted(v for x, v in values if x == g)
        assert got[g]["n"] == 501 and got[g]["q1"] == mine[125] and got[g]["q2"] == mine[250] and got[g]["top"] == mine[-1]
    assert (got["c"]["q1"], got["c"]["n"]) == (7.0, 1)
    points = [(k, float(rng.randrange(30)), float(rng.randrange(30))) for k in range(400)]
    want = {k for k, x, y in points if not any(a >= x and b <= y and (a > x or b < y) for _, a, b in points)}
    df = spark.createDataFrame([*points, (1000, None, 0.0)], "k int, x double, y double")
    assert {r["k"] for r in A.frontier(df, "k", ["x"], ["y"], block=7).collect()} == want


def test_upsert_takes_one_row_of_a_key(spark):
    have = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "id int, v string, generation int")
    new = spark.createDataFrame([(1, "y", 10), (1, "x", 20), (3, "z", 5), (3, "w", 5)], "id int, v string, at int")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(I.upsert(have, new, ["id"], at="at")) == [(1, "x", 4), (2, "b", 1), (3, "z", 1)]
    assert rows(I.upsert(have, new.drop("at"), ["id"])) == [(1, "y", 4), (2, "b", 1), (3, "z", 1)]


def test_references_that_nothing_ends(spark):
    """with `closed`, a reference that neither a semicolon nor the text ends is text."""
    df = spark.createDataFrame([(1, "<h1>a &amp</h1><p>b &amp;amp; &#65; &copy; &copyx; &lt"), (2, None)], "id int, html string")
    got = {r["id"]: r["text"] for r in X.clean_html(df, "html", "text", closed=True).collect()}
    assert got == {1: "a &amp\nb & A © &copyx; <", 2: ""}
    assert X.clean_html(df, "html", "text").first()["text"].startswith("a &\n")


def test_chunks_are_sent_as_they_are_made(spark):
    """F8: a batch of texts is not held as one frame of chunks."""
    df = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("some words of a line\n"), 500).alias("text"))
    parts, seen = X.HELD_CHARS, []
    X.HELD_CHARS = 20_000
    try:
        rows = X.chunks(df, "id", "text").collect()
    finally:
        X.HELD_CHARS = parts
    want = X.chunk_one("some words of a line\n" * 500, 1400, 160, 16)
    seen = [(r["chunk_index"], r["content"], r["token_count"]) for r in rows if r["id"] == 299]
    assert seen == want and len(rows) == 300 * len(want)
