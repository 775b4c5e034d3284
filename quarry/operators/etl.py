"""Record clean-up: HTML to text, sections, chunks, evidence, quality, the whole chain."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import parse as P
from ..functions import postings as S
from ..functions import text as T
from ..functions.text import let
from . import extraction as K


# Tags that end a line, tags without text, and lines that are no part of a posting.
BLOCK_TAGS = ("br", "div", "p", "li", "section", "article", "h1", "h2", "h3", "h4", "tr")
SILENT_TAGS = ("script", "style", "svg", "noscript", "iframe", "template")
NOISE = (
    "立即沟通|在线沟通|收藏|举报|分享|扫码分享|查看更多|展开|收起",
    "登录|注册|下载app|打开app|关注我们|职位收藏成功",
    "boss直聘|智联招聘|前程无忧|牛客网",
)
#: White space of any script, and the line ends among it.
_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


@F.pandas_udf(StringType())
def _unescaped(raw: pd.Series) -> pd.Series:
    return raw.map(unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*))(?:;|\Z)")


def _closed(m: re.Match) -> str:
    name = m[1]
    known = name is None or name + ";" in html5 and (m[0].endswith(";") or name in html5)
    return unescape(m[0]) if known else m[0]


@F.pandas_udf(StringType())
def _unescaped_closed(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: _CLOSED.sub(_closed, x), na_action="ignore")


def unescaped(text: Column, closed: bool = False) -> Column:
    """Character references decoded, through Arrow: Spark has no function for it. (A test for ampersands before would compute the text twice.)

    closed: only those that a semicolon, or the text, ends; others are text.
    """
    return (_unescaped_closed if closed else _unescaped)(text)


def without_markup(html: Column) -> Column:
    """A line end for each tag that ends a line, nothing for other tags and comments, nor for what silent tags hold."""
    silent, block = "|".join(SILENT_TAGS), "|".join(BLOCK_TAGS)
    for pattern, by in (
        (r"(?s)<!--.*?(?:-->|$)", ""), (rf"(?i)<(?:{silent})(?:\s{_INSIDE})?/>", ""), (rf"(?is)<({silent})(?:[\s/]{_INSIDE})?>.*?</\1\s*>", ""),
        (rf"(?is)<(?:{silent})(?:[\s/]{_INSIDE})?>.*$", ""), (rf"(?i)</?(?:{block})(?:[\s/]{_INSIDE})?>", "\n"),
        (rf"</?[A-Za-z]{_INSIDE}>", ""), (r"<[!?/][^>]*>", ""),
    ):
        html = F.regexp_replace(html, pattern, by)
    return html


def clean_html(df: DataFrame, column: str, into: str, closed: bool = False) -> DataFrame:
    """df with `into`, the readable text of an HTML or plain column, `into`_removed, its lines that are noise (each once), and
    `into`_warnings: clean_text_empty, description_too_short (under 40 characters), unmapped_private_or_replacement_character.

    Null counts as empty. References are decoded before tags are read, and again in what is left (closed: see `unescaped`).
    """
    raw = unescaped(F.coalesce(F.col(column), F.lit("")), closed)
    bare = df.withColumn("__raw", F.regexp_replace(raw, r"\r\n?", "\n")).withColumn("__bare", unescaped(without_markup(F.col("__raw")), closed))
    text = F.regexp_replace(F.regexp_replace("__bare", r"[\x{200b}-\x{200f}\x{feff}\x{2060}]", ""), r"[ \t\x{a0}]+", " ")
    noise = "(?i)^(?:" + "|".join(NOISE) + rf"){_SPACE}*$"
    core = lambda x: F.regexp_replace(x, r"^[ \t•·\-—]+|[ \t•·\-—]+$", "")
    lines = F.transform(F.split(text, _LINE_END), lambda x: F.struct(stripped(x).alias("line"), core(x).alias("core")))
    split = bare.withColumn("__lines", F.filter(lines, lambda x: x["core"] != ""))
    kept = F.transform(F.filter("__lines", lambda x: ~x["core"].rlike(noise)), lambda x: x["line"])
    out = split.withColumns({into: F.array_join(kept, "\n"), f"{into}_removed": F.array_distinct(F.transform(F.filter("__lines", lambda x: x["core"].rlike(noise)), lambda x: x["core"]))})
    warnings = F.array_compact(F.array(
        F.when(F.col(into) == "", "clean_text_empty"), F.when(F.length(into) < 40, "description_too_short"),
        F.when(F.col(into).rlike(r"[\x{fffd}\x{e000}-\x{f8ff}]"), "unmapped_private_or_replacement_character")))
    return out.withColumn(f"{into}_warnings", warnings).drop("__raw", "__bare", "__lines")


def normal_form(column: Column) -> Column:
    """NFKC, which Spark has no function for."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc(column)


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


#: Headings of sections.
HEADINGS = {
    "responsibilities": ("岗位职责", "工作职责", "职位职责", "工作内容", "主要职责", "你将负责"),
    "requirements": ("任职要求", "任职条件", "职位要求", "岗位要求", "资格要求", "岗位资格", "招聘条件"),
    "preferred": ("加分项", "优先条件", "加分条件", "优先资格", "nice to have", "bonus points"),
    "benefits": ("福利待遇", "岗位福利", "公司福利", "你将获得", "福利"),
    "summary": ("职位简介", "岗位简介", "职位描述", "岗位描述", "岗位概览", "about the role"),
}
_NUMERAL = "一二三四五六七八九十百"


def heading_of(line: Column) -> Column:
    """The section that a heading line names, alone or before a space, colon or bar; else null."""
    bare = F.trim(F.regexp_replace(line, r"^\s{0,3}#{1,6}\s*", ""))
    bare = F.regexp_replace(bare, rf"^(?:[{_NUMERAL}]+|\d{{1,2}})\s*[、.．)]\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[【\[（(]\s*", ""), r"\s*[】\]）)]$", "")
    bare = F.regexp_replace(F.lower(F.regexp_replace(bare, r"^[ ：:|\-—]+|[ ：:|\-—]+$", "")), r"\s+", " ")
    return let(bare, lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{'|'.join(words)})(?:$|[ :：|｜])"), name) for name, words in HEADINGS.items()]))


def split_sections(docs: DataFrame, key: str, text: str, other: str = "other") -> DataFrame:
    """key, section, item_index, item, line_index: list items under the heading above them (`other` before the first).

    What follows a heading on its line, after a colon or bar, is an item of its section, unless it names the same one. Lines
    are cut after ； and before numbered items, never at commas; bullets and numbers go.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|" + _LINE_END)).alias("line_index", "line"))
    lines = lines.withColumn("line", stripped(F.col("line"))).where("line <> ''").withColumn("h", heading_of(F.col("line")))
    above = Window.partitionBy(key).orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.coalesce(F.last("h", ignorenulls=True).over(above), F.lit(other)))
    rest = F.when(F.col("line").rlike("[：:|｜]"), F.regexp_replace("line", r"^.*?[：:|｜]\s*", "")).otherwise("")
    inline = F.when((rest != "") & ~heading_of(rest).eqNullSafe(F.col("h")), F.array(rest)).otherwise(F.array().cast("array<string>"))
    cut = F.split("line", rf"(?<=；)|(?<=[。！？])\s+(?=[{_NUMERAL}\d]+[、.)])")
    bullet = rf"^\s*(?:[-*•·]|\d{{1,2}}[、.)]|[{_NUMERAL}]+[、.])\s*"
    items = F.transform(cut, lambda x: stripped(F.regexp_replace(x, bullet, "")))
    found = named.select(key, "section", "line_index", F.posexplode(F.when(F.col("h").isNotNull(), inline).otherwise(items)).alias("n", "item")).where("item <> ''")
    index = F.row_number().over(Window.partitionBy(key, "section").orderBy("line_index", "n")) - 1
    return found.select(key, "section", index.alias("item_index"), "item", "line_index")


_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")


class _Line:
    """A line whose parts' tokens are counted from places found once: a quarter of a word's letters, rounded up, one for a mark."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.before = [0, *accumulate(-(-(b - a) // 4) for a, b in spans)]

    def tokens(self, a: int, b: int) -> int:
        """Of text[a:b]; a word that the edges cut counts by what is inside."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if i >= j:
            return 0
        out = self.before[j] - self.before[i]
        for k in {i, j - 1}:
            low, high = max(self.starts[k], a), min(self.ends[k], b)
            out += -(-(high - low) // 4) - (self.before[k + 1] - self.before[k])
        return out

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        while a < b and self.text[a].isspace():
            a += 1
        while b > a and self.text[b - 1].isspace():
            b -= 1
        return a, b


def chunk_one(text: str, chars: int, tokens: int, overlap: int) -> list[tuple[int, str, int]]:
    """Lines packed in order into chunks below both limits, the last lines repeated up to `overlap` tokens."""
    units: list[tuple[str, int]] = []
    for line in text.split("\n"):
        whole = _Line(line)
        a, b = whole.trimmed(0, len(line))
        while a < b:
            n = whole.tokens(a, b)
            if b - a <= chars and n <= tokens:
                units.append((line[a:b], n))
                break
            cut = min((b - a) // 2, chars)  # halved until it fits
            space = line.rfind(" ", a, a + cut + 1) - a
            cut = space if space > 0 else max(cut, 1)
            c, d = whole.trimmed(a, a + cut)
            if c < d:
                units.append((line[c:d], whole.tokens(c, d)))
            a, b = whole.trimmed(a + cut, b)
    out, now, size, length, fresh = [], [], 0, 0, 0
    for unit in units:
        u, n = unit
        if fresh and (size + n > tokens or length + len(now) + len(u) > chars):
            out.append(now)
            back, held = [], 0
            for x in reversed(now):
                if held + x[1] > overlap:
                    break
                back.insert(0, x)
                held += x[1]
            now, size, length, fresh = back, held, sum(len(x) for x, _ in back), 0
            if size + n > tokens or length + len(now) + len(u) > chars:
                now, size, length = [], 0, 0
        now.append(unit)
        size, length, fresh = size + n, length + len(u), fresh + 1
    if fresh:
        out.append(now)
    return [(k, "\n".join(u for u, _ in c), sum(n for _, n in c)) for k, c in enumerate(out)]


#: Characters of chunks that a task of `chunks` sends at once.
HELD_CHARS = 1 << 20


def chunks(docs: DataFrame, key: str, text: str, chars: int = 1400, tokens: int = 160, overlap: int = 16) -> DataFrame:
    """key, chunk_index, content, token_count of every document's chunks."""
    made = StructType([StructField(key, docs.schema[key].dataType), StructField("chunk_index", IntegerType()), StructField("content", StringType()), StructField("token_count", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(keys: pa.Array, at: list[int], found: list[tuple[int, str, int]]) -> pa.RecordBatch:
            number, content, size = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(number, pa.int32()), pa.array(content, pa.string()), pa.array(size, pa.int64())], names=made.names)

        for batch in batches:
            at, found, held = [], [], 0
            for k in range(batch.num_rows):  # a text at a time: what a task holds doesn't grow with the batch
                some = chunk_one(batch.column(1)[k].as_py() or "", chars, tokens, overlap)
                at += [k] * len(some)
                found += some
                held += sum(len(c) for _, c, _ in some)
                if held > HELD_CHARS:
                    yield sent(batch.column(0), at, found)
                    at, found, held = [], [], 0
            if found:
                yield sent(batch.column(0), at, found)

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, made)


def evidence(text: Column, term: Column, around: int = 20) -> Column:
    """struct(start_char, end_char, evidence_text, valid) of a term's first place."""
    at = F.instr(F.lower(text), F.lower(term))
    start, end = F.greatest(at - 1 - around, F.lit(0)), F.least(at - 1 + F.length(term) + around, F.length(text))
    return F.struct(
        F.when(at > 0, at - 1).alias("start_char"), F.when(at > 0, at - 1 + F.length(term)).alias("end_char"),
        F.when(at > 0, F.substring(text, start + 1, end - start)).otherwise("").alias("evidence_text"), (at > 0).alias("valid"),
    )


#: Weights of the checks of a record's quality.
QUALITY = {"title": 0.08, "description": 0.18, "company": 0.08, "location": 0.08, "salary": 0.10, "education": 0.08, "experience": 0.08,
           "responsibilities": 0.12, "requirements": 0.12, "skills": 0.05, "evidence": 0.03}


def record_quality(checks: dict[str, Column]) -> Column:
    """struct(score, level, failed) of the checks of a record; all eleven are asked for."""
    missing = QUALITY.keys() - checks.keys()
    if missing:
        raise ValueError(f"no check given for {sorted(missing)}")
    score = F.lit(0.0)
    for name, weight in QUALITY.items():
        score = score + F.when(checks[name], weight).otherwise(0.0)
    score = F.round(score, 3)
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(checks[n], F.lit(False)), n) for n in QUALITY]))
    level = F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low")
    return F.struct(score.alias("score"), level.alias("level"), failed.alias("failed"))


def skills(docs: DataFrame, key: str, section: str, item: str, lexicon: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, skill, importance: lexicon terms with their aliases, required before preferred before inferred."""
    rank = F.when(F.col(section) == "requirements", 3).when(F.col(section) == "preferred", 2).otherwise(1)
    found = F.array_compact(F.array(*[
        F.when(_any([T.bounded_contains(F.col(item), a) for a in (name, *aliases)]), F.lit(name)) for name, aliases in lexicon.items()
    ]))
    rows = docs.select(key, rank.alias("r"), F.explode(found).alias("skill"))
    top = rows.groupBy(key, "skill").agg(F.max("r").alias("r"))
    return top.select(key, "skill", F.when(F.col("r") == 3, "required").when(F.col("r") == 2, "preferred").otherwise("inferred").alias("importance"))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def process(raw: DataFrame, key: str = "source_job_id") -> DataFrame:
    """Raw records (source, source_job_id, raw_title, raw_salary, raw_location, description_html, company_name, education,
    experience, employment_type), one for each key, to canonical rows: parsed fields, sections, skills with evidence, quality,
    warnings and a hash of the content."""
    fields = ("raw_title", "raw_salary", "raw_location", "education", "experience", "employment_type")
    plain = raw.withColumns({f"__{f}": F.trim(normal_form(F.coalesce(F.col(f), F.lit("")))) for f in fields})
    cleaned = clean_html(plain, "description_html", "clean_description")
    out = cleaned.select(
        "source", key, T.clean_title(F.col("__raw_title")).alias("title"), F.trim(F.coalesce("company_name", F.lit(""))).alias("company"), P.pay(F.col("__raw_salary")).alias("salary"),
        P.place(F.col("__raw_location")).alias("location"), S.record_education(F.col("__education")).alias("education"), S.record_experience(F.col("__experience")).alias("experience"),
        P.employment(F.col("__employment_type")).alias("employment_type"), "clean_description", F.col("clean_description_warnings").alias("text_warnings"),
    )
    out = out.withColumn("role_family", P.role_family(F.concat_ws(" ", "title", "clean_description")))
    # Bounded: the items of one text.
    items = split_sections(out, key, "clean_description")
    sections = items.groupBy(key).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("item_index", "item")))).alias(f"__{s}") for s in ("responsibilities", "requirements", "preferred", "benefits")])
    found = K.spans(out.select(key, "clean_description"), [key], "clean_description", K.skill_lexicon(), longest=False)
    first = found.groupBy(key, F.col("term").alias("name")).agg(F.min(F.struct("start", "end")).alias("at"))
    skills_ = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", F.col("at.start").alias("start_char"), F.col("at.end").alias("end_char")))).alias("skills"))
    joined = out.join(sections, key, "left").join(skills_, key, "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumns({s: F.coalesce(F.transform(f"__{s}", lambda x: x["item"]), none) for s in ("responsibilities", "requirements", "preferred", "benefits")})
    joined = joined.drop("__responsibilities", "__requirements", "__preferred", "__benefits").withColumn("skills", F.coalesce("skills", F.array().cast(joined.schema["skills"].dataType)))
    joined = joined.withColumn("content_hash", T.content_hash("title", "clean_description", "salary", "education", "experience"))
    checks = {
        "title": F.col("title") != "", "description": F.length("clean_description") >= 80, "company": F.col("company") != "", "location": F.col("location.normalized") != "",
        "salary": F.col("salary.status").isin("parsed", "negotiable"), "education": F.col("education") != "", "experience": F.col("experience") != "",
        "responsibilities": F.size("responsibilities") > 0, "requirements": F.size("requirements") > 0, "skills": F.size("skills") > 0, "evidence": F.lit(True),  # every skill has its place
    }
    gone = {"company": "company", "location": "location.normalized", "education": "education", "experience": "experience"}
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", f"missing_{n}") for n, c in gone.items()]))
    return joined.withColumn("quality", record_quality(checks)).withColumn("warnings", F.concat("text_warnings", missing)).drop("text_warnings")
