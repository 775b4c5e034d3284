"""Terms of a lexicon in texts, and the skills and requirements that postings ask for.

A lexicon of any size is one automaton of all its wordings (Aho-Corasick): a text is read once, whatever the number of
terms. The automaton is sent once and run over Arrow batches; only what it finds is shuffled, as (text, line, term) rows
that are few and need no order. Requirements are told by units of a text: where a text is read, its units that are a skill's
evidence are told and their cues read; they alone, without their words, meet the listed skills. A lexicon may come in
parts, each an automaton of its own: results are those of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.postings import has
from .storage import stored

# Skills, their further wordings, and words of requirements.
SKILLS = tuple("""
Python|FastAPI|Django|Flask|Java|Spring Boot|MyBatis|Go|Golang|Rust|JavaScript|TypeScript|React|Next.js|Vue|Node.js|HTML|CSS|SQL|PostgreSQL|MySQL|Redis|MongoDB
Docker|Kubernetes|AWS|Azure|GCP|Terraform|Git|Linux|Kafka|RabbitMQ|Spark|Airflow|Machine Learning|Deep Learning|NLP|LLM|RAG|Agent|LangChain|LlamaIndex|Dify|PyTorch
TensorFlow|scikit-learn|Pandas|Figma|Product Management|自动化测试|C|C++|C#|Spring|OpenCV|NumPy|PaddlePaddle|ONNX Runtime|vLLM|Llama.cpp|AOSP|Android|ROS|ROS2|Electron
MCP|Prompt|Function Calling|Tool Use|Cursor|Claude Code|Codex|OpenClaw|AutoGen|Isaac Gym|Isaac Lab|MuJoCo|Genesis|PPO|Actor-Critic|Behavior Cloning|Whole Body Control
Motion Tracking|Motion Retargeting|Sim2Real|SMPL|DeepMimic|Jacobian|Locomotion|IK|QP|GMR|OmniH2O|HOVER|BeyondMimic|Humanoid-Gym|GR00T|ProtoMotions|Unitree
""".strip().replace("\n", "|").split("|"))
WORDINGS = {
    "Spring Boot": ("SpringBoot", "Spring Boot"), "MyBatis": ("MyBatis", "MyBatisPlus", "MyBatis-Plus"), "Node.js": ("Node.js", "Nodejs"), "Next.js": ("Next.js", "Nextjs"),
    "scikit-learn": ("scikit-learn", "sklearn"), "LangChain": ("LangChain", "Langchain"), "LlamaIndex": ("LlamaIndex", "Llama Index"), "C++": ("C++", "C／C++", "C/C++"),
    "C": ("C", "C语言", "C 语言"), "OpenCV": ("OpenCV", "opencv"), "NumPy": ("NumPy", "Numpy"), "ONNX Runtime": ("ONNX Runtime", "ONNXRuntime"),
    "Llama.cpp": ("Llama.cpp", "llama.cpp"), "ROS2": ("ROS2", "ROS 2"), "MCP": ("MCP", "MCP协议", "MCP 协议"), "LLM": ("LLM", "大语言模型", "大模型"),
    "Agent": ("Agent", "智能体", "多智能体"), "RAG": ("RAG", "向量检索"), "Prompt": ("Prompt", "提示词", "提示工程"), "Function Calling": ("Function Calling", "函数调用"),
    "Tool Use": ("Tool Use", "工具调用"), "Spring": ("Spring",),
}
#: A skill that isn't listed where the other is.
COVERED = {"C": "C++", "Spring": "Spring Boot"}
#: Sections that say what is required, and weights by type.
REQUIRED_SECTIONS = ("requirements", "skills", "responsibilities")
IMPORTANCE = {"required": 0.7, "preferred": 0.4}
#: Cues of a line.
CRITICAL = r"(?i)核心要求|关键要求|硬性|不可缺少|必须(?:具备|精通)|不可替代"
MUST = r"(?i)必须|要求|精通|熟练掌握|必备|must(?:[- ]have)?|required"
PREFERRED = r"(?i)优先|加分|更佳|最好|有则更好|nice\s+to\s+have|preferred"
CONTEXT = r"(?i)了解|参与|接触|有机会参与|团队(?:目前)?使用|技术栈包括|负责"
ALTERNATIVE = r"/|或|之一|任一|任意.{0,2}门|等(?:框架|技术|语言|工具|数据库|组件)"
AT_LEAST = r"至少\s*([一二两三四五六七八九\d]+)\s*(?:种|项|个)"
#: Words of which a line in lower case has one if it matches the pattern: they are looked for first, which takes a fraction of the time.
CUES = {
    CRITICAL: ("要求", "硬性", "不可缺少", "必须", "不可替代"), MUST: ("必须", "要求", "精通", "熟练掌握", "必备", "must", "required"),
    PREFERRED: ("优先", "加分", "更佳", "最好", "有则更好", "nice", "preferred"), CONTEXT: ("了解", "参与", "接触", "团队", "技术栈包括", "负责"),
    ALTERNATIVE: ("/", "或", "之一", "任一", "任意", "等"), AT_LEAST: ("至少",),
}
NUMBERS = "一二两三四五六七八九", "1223456789"
GENERIC = ("ai", "artificial intelligence", "ai agent", "agent", "prompt", "人工智能")

_PLAIN = re.compile(r"[A-Za-z0-9+.# -]+")


@dataclass(frozen=True)
class Lexicon:
    """Terms with their wordings. A wording of ASCII letters, digits, +.#- and spaces stands alone: no ASCII letter or digit
    beside it; `tight` ones have no + or # beside them either. Others match anywhere. Case doesn't count."""

    terms: tuple[tuple[str, tuple[str, ...]], ...]
    tight: frozenset[str] = frozenset()

    @classmethod
    def of(cls, terms: dict[str, tuple[str, ...]] | list[str], tight: tuple[str, ...] = ()) -> Lexicon:
        pairs = terms.items() if isinstance(terms, dict) else ((t, (t,)) for t in terms)
        return cls(tuple((t, tuple(w)) for t, w in pairs), frozenset(tight))

    def automaton(self):
        """Lower-case wordings, each with [(term, bounded, tight)]."""
        made: dict[str, list] = {}
        for term, wordings in self.terms:
            for w in wordings:
                if w:
                    entry = (term, bool(_PLAIN.fullmatch(w)), w in self.tight)
                    held = made.setdefault(fold(w), [])
                    if entry not in held:
                        held.append(entry)
        out = ahocorasick.Automaton()
        for w, found in made.items():
            out.add_word(w, (len(w), found))
        if made:
            out.make_automaton()
        return out if made else None


def skill_lexicon() -> Lexicon:
    return Lexicon.of({s: WORDINGS.get(s, (s,)) for s in SKILLS}, tight=("C",))


def fold(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _alone(text: str, start: int, end: int, tight: bool) -> bool:
    for c in (text[start - 1] if start else " ", text[end] if end < len(text) else " "):
        if c.isascii() and c.isalnum() or tight and c in "+#":
            return False
    return True


def found_in(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, term) of every match, by place, longest first."""
    if automaton is None or not text:
        return []
    low, out = fold(text), []
    for last, (size, entries) in automaton.iter(low):
        start = last + 1 - size
        out += [(start, last + 1, term) for term, bounded, tight in entries if not bounded or _alone(low, start, last + 1, tight)]
    return sorted(set(out), key=lambda m: (m[0], -m[1], m[2]))


def leftmost_longest(matches: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The matches without those that overlap an earlier or, from the same place, a longer one."""
    out, end = [], 0
    for m in matches:
        if m[0] >= end or (out and m[:2] == out[-1][:2]):
            out.append(m)
            end = max(end, m[1])
    return out


def spans(docs: DataFrame, keys: list[str], text: str, lexicon: Lexicon, longest: bool = True) -> DataFrame:
    """keys, term, start, end (from 0, the end after the last character) of the lexicon's terms in every text.

    longest: without matches that overlap an earlier or longer one (terms that share a wording all stay). Null and empty
    texts and an empty lexicon give no rows; rows that repeat are each read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = [docs.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for batch in batches:
            rows, terms, starts, ends = [], [], [], []
            for n, value in enumerate(batch.column(len(keys)).to_pylist()):
                matches = found_in(value or "", automaton)
                for start, end, term in leftmost_longest(matches) if longest else matches:
                    rows.append(n)
                    terms.append(term)
                    starts.append(start)
                    ends.append(end)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=[*keys, "term", "start", "end"])

    made = T.StructType([*kept, T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, made)


def skills(lines: DataFrame, key: str, lexicon: Lexicon | None = None, covered: dict[str, str] | None = None) -> DataFrame:
    """key, skill, type (required, preferred), importance of lines(key, section, line).

    A skill is required if a line of requirements, skills or responsibilities has it (of the body, where a text has none of
    these sections), else preferred if a preferred one has it. `covered` skills go where the skill that covers them is found.
    """
    lexicon = lexicon or skill_lexicon()
    covered = COVERED if covered is None else covered
    section = F.col("section")
    explicit = section.isin(*REQUIRED_SECTIONS)
    kinds = lines.where(explicit & (F.length("line") > 0)).select(F.col(key).alias("__key")).distinct()
    found = spans(lines.select(key, "section", "line"), [key, "section"], "line", lexicon, longest=False)
    got = found.groupBy(key, F.col("term").alias("skill")).agg(
        F.bool_or(explicit).alias("explicit"), F.bool_or(section == "body").alias("body"), F.bool_or(section == "preferred").alias("preferred"))
    got = got.join(kinds, F.col(key).eqNullSafe(F.col("__key")), "left")
    required = F.when(F.col("__key").isNotNull(), F.col("explicit")).otherwise(F.col("explicit") | F.col("body"))
    got = got.withColumn("type", F.when(required, "required").when(F.col("preferred"), "preferred")).where("type IS NOT NULL")
    got = got.select(key, "skill", "type", F.when(F.col("type") == "required", IMPORTANCE["required"]).otherwise(IMPORTANCE["preferred"]).alias("importance"))
    for less, more in covered.items():
        better = got.where(F.col("skill") == more).select(F.col(key).alias("__key"))
        got = got.join(better, (F.col("skill") == less) & F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return got


def units(text: Column) -> Column:
    """The units of a text: lines cut after 。！？；; as well, without blanks, bullets and dashes at the ends."""
    cut = F.coalesce(text, F.lit(""))
    for mark in "。！？；;":
        cut = F.replace(cut, F.lit(mark), F.lit(mark + "\n"))
    return F.filter(F.transform(F.split(cut, r"[\r\n]+"), lambda u: F.btrim(u, F.lit(" -•\t"))), lambda u: u != "")


def cue(unit: Column, low: Column, pattern: str) -> Column:
    """Whether a unit, which is `low` in lower case, has one of the CUES."""
    return has(low, *CUES[pattern]) & unit.rlike(pattern)


def _number(text: Column) -> Column:
    digits = F.translate(text, *NUMBERS)
    return F.coalesce(digits.try_cast("int"), F.lit(1))


def requirements(docs: DataFrame, key: str, text: str, listed: DataFrame, *parts: Lexicon) -> DataFrame:
    """What each text asks of the skills listed for it: a row for each type and skill.

    docs(key, text) with unique keys, listed(key, skill, type, importance) as `skills` gives it. The evidence of a skill is the
    first unit that has its name, else one that has a word of it. Its cues decide the type (must_have_skill, preferred_skill,
    context_skill) and whether it is critical; a unit that offers alternatives makes those of its listed skills one group:
    relation (ALL_OF, ANY_OF, AT_LEAST_N), at_least, members. A skill without evidence keeps the listed type, alone.
    """
    told = evidence(docs, key, text, *(parts or (skill_lexicon(),))).withColumn("low", F.lower("unit"))
    unit, low = F.col("unit"), F.col("low")
    number = F.when(has(low, *CUES[AT_LEAST]), F.regexp_extract(unit, AT_LEAST, 1)).otherwise("")
    cues = told.select(
        key, "unit_no", "skills", "low", "offered", number.alias("number"),
        *[cue(unit, low, p).alias(c) for c, p in (("crit", CRITICAL), ("must", MUST), ("pref", PREFERRED), ("ctx", CONTEXT), ("alternative", ALTERNATIVE))])
    # Only units that offer alternatives keep their words and terms.
    offers = (F.col("number") != "") | F.col("alternative")
    cues = cues.select(
        key, "unit_no", "skills", "crit", "must", "pref", "ctx", F.when(F.col("number") != "", _number(F.col("number"))).otherwise(1).alias("number"),
        F.when(offers, F.col("low")).alias("low"), F.when(offers, F.col("offered")).alias("offered"))
    names = listed.groupBy(key).agg(F.collect_set("skill").alias("names"))
    met = cues.join(names, key).withColumn("members", F.when(F.col("offered").isNotNull(), F.sort_array(F.array_intersect("offered", "names"))))
    several = F.coalesce(F.size("members"), F.lit(0)) >= 2
    digest = F.substring(F.sha1(F.concat(F.col("low"), F.lit("|"), F.array_join("members", "|"))), 1, 12)
    met = met.select(
        key, "unit_no", F.explode("skills").alias("skill"), "crit", "must", "pref", "ctx", several.alias("grouped"), F.when(several, F.col("members")).alias("members"),
        F.when(several, F.greatest(F.lit(1), F.least("number", F.size("members")))).otherwise(1).alias("least"), F.when(several, digest).alias("digest"))
    out = listed.join(met, [key, "skill"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = F.when(F.col("type") == "preferred", "preferred_skill").otherwise("must_have_skill")
    kind = F.when(yes("pref"), "preferred_skill").when(yes("ctx") & ~yes("must"), "context_skill").otherwise(base)
    grouped, least = yes("grouped"), F.coalesce("least", F.lit(1))
    alone = F.regexp_replace(F.lower("skill"), r"[^a-z0-9+#]", "")
    return out.select(
        key, "skill", kind.alias("type"), (kind == "must_have_skill").alias("hard"), ((kind == "must_have_skill") & yes("crit")).alias("critical"), "importance",
        F.when(F.lower("skill").isin(*GENERIC), 0.35).otherwise(0.9).alias("specificity"),
        F.when(~grouped, "ALL_OF").when(least > 1, "AT_LEAST_N").otherwise("ANY_OF").alias("relation"), least.alias("at_least"),
        F.when(grouped, F.col("members")).otherwise(F.array("skill")).alias("wanted"),
        F.when(grouped, F.concat(F.lit("skill-group:"), F.col("digest"))).otherwise(F.concat(F.lit("skill:"), alone)).alias("group_id"), "unit_no",
    )


def evidence(docs: DataFrame, key: str, text: str, *parts: Lexicon) -> DataFrame:
    """key, unit_no, unit, skills, offered: the units of each text that are the evidence of terms, which `skills` names.

    A term's evidence is the first unit that has its name, else the first that has a word of it, anywhere in it; `offered` are
    the terms that the unit has as `spans` finds them, of all parts of the lexicon (a term is in one part, a key in one row).
    """
    found = [_evidence(docs, key, text, lexicon) for lexicon in parts]
    if len(found) == 1:
        return found[0]
    # A unit that is the evidence of one part's terms has terms of the others as well: they are looked for in all units told.
    at = [key, "unit_no"]
    told = stored(_all(found).groupBy(*at).agg(F.first("unit").alias("unit"), F.flatten(F.collect_list("skills")).alias("skills")), "evidence")
    terms = _all([spans(told, at, "unit", lexicon, longest=False).select(*at, "term") for lexicon in parts])
    offered = terms.groupBy(*at).agg(F.sort_array(F.collect_set("term")).alias("offered"))
    return told.join(offered, at, "left").select(*at, "unit", "skills", F.coalesce("offered", F.array().cast("array<string>")).alias("offered"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _evidence(docs: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """evidence() of one part of a lexicon, with the terms of that part."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _evidence_automaton(sent.value)
        for batch in batches:
            rows, numbers, texts, skills, offered = [], [], [], [], []
            for n, value in enumerate(batch.column(1)):
                pieces = value.as_py()
                first, has_terms = _first_units(pieces, automaton)
                for unit_no in sorted(first):
                    rows.append(n)
                    numbers.append(unit_no)
                    texts.append(pieces[unit_no])
                    skills.append(first[unit_no])
                    offered.append(sorted(has_terms.get(unit_no, ())))
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(skills, words), pa.array(offered, words)],
                names=[key, "unit_no", "unit", "skills", "offered"])

    words = T.ArrayType(T.StringType())
    made = T.StructType([docs.schema[key], *[T.StructField(c, t) for c, t in (("unit_no", T.IntegerType()), ("unit", T.StringType()), ("skills", words), ("offered", words))]])
    return docs.select(key, units(F.col(text).cast("string")).alias("units")).mapInArrow(run, made)


def _evidence_automaton(lexicon: Lexicon):
    """Lower-case wordings with (length, {term: 0 for its name, 1 for a word of it}, [(term, bounded, tight)])."""
    made: dict[str, tuple] = {}
    of = lambda w: made.setdefault(w, (len(w), {}, []))
    for term, wordings in lexicon.terms:
        name = fold(term)
        for w in [w for w in re.split(r"[,，/、\s]+", name) if len(w) >= 2]:
            of(w)[1].setdefault(term, 1)
        of(name)[1][term] = 0
        for w in wordings:
            entry = (term, bool(_PLAIN.fullmatch(w)), w in lexicon.tight)
            if entry not in (held := of(fold(w))[2]):
                held.append(entry)
    made.pop("", None)
    out = ahocorasick.Automaton()
    for w, (size, named, exact) in made.items():
        out.add_word(w, (size, list(named.items()), exact))
    if made:
        out.make_automaton()
    return out if made else None


def _first_units(pieces: list[str], automaton) -> tuple[dict[int, list[str]], dict[int, set[str]]]:
    """The terms whose evidence each unit is, and the terms that each unit has."""
    best: dict[str, tuple[int, int]] = {}
    held: dict[int, set[str]] = {}
    for n, piece in enumerate(pieces if automaton else ()):
        low = fold(piece)
        for last, (size, named, exact) in automaton.iter(low):
            for term, kind in named:
                at = best.get(term)
                if at is None or kind < at[0]:
                    best[term] = (kind, n)
            for term, bounded, tight in exact:
                if not bounded or _alone(low, last + 1 - size, last + 1, tight):
                    held.setdefault(n, set()).add(term)
    first: dict[int, list[str]] = {}
    for term, (_, n) in best.items():
        first.setdefault(n, []).append(term)
    return first, held


# Directions of a title and the words that tell them, the first that is found.
DIRECTIONS = (
    ("sales", ("销售", "商务", "bd", "客户经理", "account executive", "business development")),
    ("content", ("编剧", "文案", "编辑", "内容创作", "短剧", "writer", "content creator")),
    ("operations", ("运营", "用户增长", "增长", "训练师", "community", "operation")),
    ("product", ("产品经理", "产品实习", "产品助理", "产品工程师", "product manager", "产品策划")),
    ("teaching", ("讲师", "教师", "授课", "课程老师", "trainer", "instructor")),
    ("design", ("设计师", "视觉设计", "交互设计", "ui/ux", "ux", "designer")),
    ("algorithm", ("算法", "模型训练", "机器学习", "深度学习", "computer vision", "nlp", "research scientist")),
    ("data", ("数据分析", "数据科学", "data analyst", "data scientist", "商业分析")),
    ("engineering", ("工程师", "开发", "研发", "后端", "前端", "全栈", "软件", "developer", "engineer")),
)


def direction(title: Column) -> Column:
    """The first direction of which a title has a word, else 'unknown'."""
    low, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(None).cast("string")
    for name, words in DIRECTIONS:
        said = F.lit(False)
        for w in words:
            # Up to three letters stand alone, among letters; longer words are found anywhere.
            short = w.isascii() and w.isalpha() and len(w) <= 3
            said = said | (low.rlike(rf"(?<![a-z]){w}(?![a-z])") if short else low.contains(w))
        out = F.coalesce(out, F.when(said, name))
    return F.coalesce(out, F.lit("unknown"))
