"""Lexicon terms, skills and requirements of documents read as postings, up to their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extraction as K
from ..operators import matching as Q
from ..operators import sections as Y
from ..operators.storage import stored
from . import matching
from .registry import ORACLES, Tables, query

#: The lexicon: words of `benchmark` of that many letters or digits.
LETTERS = 7
#: Terms of a lexicon that are held at once.
MOST = 100_000


def lexicons(t: Tables, letters: int = LETTERS) -> list[K.Lexicon]:
    """The words of the benchmark items, in lexicons of a bounded size (parts of one: no result depends on how many)."""
    words = t.benchmark.select(F.explode(X.ascii_tokens(F.col("text"))).alias("w")).where(F.length("w") >= letters).distinct()
    blocks = max(1, -(-words.count() // MOST))
    dealt = words.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)))
    return [K.Lexicon.of(sorted(r["w"] for r in dealt.where(F.col("block") == b).select("w").collect())) for b in range(blocks)]


_WORDS = f"""
WITH lexicon AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) WHERE length(w) >= {LETTERS})"""


@query(_WORDS + """
SELECT doc_id, w AS term, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) JOIN lexicon USING (w) GROUP BY ALL""")
def lexicon_hits(t: Tables) -> DataFrame:
    """How often each document has each word of the benchmark items."""
    out = None
    for lexicon in lexicons(t):
        some = K.spans(t.documents, ["doc_id"], "text", lexicon).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("hits"))
        out = some if out is None else out.unionByName(some)
    return out


#: Sections by the number of a line in fives; documents with an odd id have no section that says what is required.
_LISTED = _WORDS + """,
lines AS (SELECT doc_id, line, CASE n % 5 WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'requirements' ELSE 'summary' END WHEN 2 THEN 'preferred' ELSE 'body' END AS section
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
explicit AS (SELECT DISTINCT doc_id FROM lines WHERE section = 'requirements' AND length(line) > 0),
met AS (SELECT doc_id, w AS skill, bool_or(section = 'requirements') AS r, bool_or(section = 'body') AS b, bool_or(section = 'preferred') AS p
  FROM (SELECT doc_id, section, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM lines) JOIN lexicon USING (w) GROUP BY ALL),
typed AS (SELECT doc_id, skill, CASE WHEN r OR (b AND e.doc_id IS NULL) THEN 'required' WHEN p THEN 'preferred' END AS type FROM met LEFT JOIN explicit e USING (doc_id)),
listed AS (SELECT doc_id, skill, type, CASE type WHEN 'required' THEN 0.7 ELSE 0.4 END::DOUBLE AS importance FROM typed WHERE type IS NOT NULL)"""


def _listed(t: Tables, lexicon: K.Lexicon) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    required = F.when(F.col("doc_id") % 2 == 0, "requirements").otherwise("summary")
    section = F.when(F.col("n") % 5 == 1, required).when(F.col("n") % 5 == 2, "preferred").otherwise("body")
    return K.skills(lines.withColumn("section", section), "doc_id", lexicon, {})


@query(_LISTED + " SELECT * FROM listed")
def listed_skills(t: Tables) -> DataFrame:
    """Skills of each document by section."""
    out = None
    for lexicon in lexicons(t):
        some = _listed(t, lexicon)
        out = some if out is None else out.unionByName(some)
    return out


_ASKED = _LISTED + r""",
pieces AS (SELECT doc_id, trim(u, ' -•' || chr(9)) AS unit, n FROM (
  SELECT doc_id, unnest(x) AS u, generate_subscripts(x, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([。！？；;])', '\1' || chr(10), 'g'), '[\r\n]+') AS x FROM documents))),
units AS (SELECT doc_id, unit, lower(unit) AS low, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS unit_no FROM pieces WHERE unit <> ''),
firsts AS (SELECT doc_id, skill, min(unit_no) AS unit_no FROM listed JOIN units USING (doc_id) WHERE contains(low, skill) GROUP BY ALL),
here AS (SELECT l.*, unit_no, unit, low FROM listed l LEFT JOIN firsts USING (doc_id, skill) LEFT JOIN units USING (doc_id, unit_no)),
said AS (SELECT DISTINCT doc_id, unit_no, w AS skill FROM (SELECT doc_id, unit_no, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS w FROM units SEMI JOIN firsts USING (doc_id, unit_no)) JOIN lexicon USING (w)),
members AS (SELECT doc_id, unit_no, list(skill ORDER BY skill) AS members FROM said JOIN (SELECT doc_id, skill FROM listed) USING (doc_id, skill) GROUP BY ALL),
cued AS (SELECT h.*, members, coalesce(regexp_matches(unit, '/|或|之一|任一|任意.{0,2}门|等(?:框架|技术|语言|工具|数据库|组件)'), false) AND coalesce(len(members), 0) >= 2 AS grouped,
  coalesce(regexp_matches(unit, '(?i)优先|加分|更佳|最好|有则更好|nice\s+to\s+have|preferred'), false) AS pref, coalesce(regexp_matches(unit, '(?i)必须|要求|精通|熟练掌握|必备|must(?:[- ]have)?|required'), false) AS must,
  coalesce(regexp_matches(unit, '(?i)了解|参与|接触|有机会参与|团队(?:目前)?使用|技术栈包括|负责'), false) AS ctx FROM here h LEFT JOIN members USING (doc_id, unit_no)),
asked AS (SELECT doc_id, skill, CASE WHEN pref THEN 'preferred_skill' WHEN ctx AND NOT must THEN 'context_skill' WHEN type = 'preferred' THEN 'preferred_skill' ELSE 'must_have_skill' END AS type,
  importance, CASE WHEN grouped THEN 'ANY_OF' ELSE 'ALL_OF' END AS relation, CASE WHEN grouped THEN members ELSE [skill] END AS wanted, unit_no FROM cued)"""


def _asked(t: Tables) -> DataFrame:
    parts = lexicons(t)
    listed = [stored(_listed(t, lexicon), "listed") for lexicon in parts]
    return K.requirements(t.documents, "doc_id", "text", reduce(DataFrame.unionByName, listed), *parts)


@query(_ASKED + " SELECT doc_id, skill, type, importance, relation, len(wanted)::INTEGER AS members, unit_no::INTEGER AS unit_no FROM asked")
def asked_requirements(t: Tables) -> DataFrame:
    """What each document asks of its skills, with the unit that says so and the alternatives it offers."""
    return _asked(t).select("doc_id", "skill", "type", "importance", "relation", F.size("wanted").alias("members"), "unit_no")


_SCORES = ORACLES["quick_scores"].removeprefix(matching._REQUIREMENTS).replace("l_orderkey", "doc_id")


@query(_ASKED + """,
have AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[-1]), '[a-z0-9]+')) AS skills FROM documents),
n AS (SELECT a.*, len(list_intersect(wanted, skills)) AS n FROM asked a JOIN have USING (doc_id)),
e AS (SELECT doc_id, type, CASE WHEN n >= CASE relation WHEN 'ANY_OF' THEN 1 ELSE len(wanted) END THEN 'matched' ELSE 'missing' END AS status,
  100.0 * least(1.0, n / len(wanted)::DOUBLE) AS part, importance, 0.9 AS specificity, type = 'must_have_skill' AS hard, false AS critical,
  CASE WHEN type = 'must_have_skill' THEN 6.0 ELSE 0.0 END::DOUBLE AS deduction FROM n),
e2 AS (SELECT * EXCLUDE (part), CASE WHEN status = 'matched' THEN 100.0 ELSE part END::DOUBLE AS score FROM e)""" + _SCORES.replace("FROM e)", "FROM e2)"))
def posting_scores(t: Tables) -> DataFrame:
    """From text to score: skills, requirements, evaluation against the words of the document's last line, quick score."""
    none = lambda kind: F.lit(None).cast(kind)
    words = F.array_distinct(X.ascii_tokens(F.substring_index("text", "\n", -1)))
    have = t.documents.select("doc_id", F.struct(words.alias("skills"), none("string").alias("direction"), none("int").alias("level"), none("double").alias("years")).alias("have"))
    rows = _asked(t).withColumns({"level": none("int"), "minimum": none("double")}).join(have, "doc_id")
    known = Q.evaluated(rows, F.col("have")).withColumn("deduction", F.when(F.col("type") == "must_have_skill", 6.0).otherwise(0.0))
    return Q.quick_scores(known, "doc_id", digits=4).withColumn("entries", F.size("ledger")).drop("ledger")


#: Words that head a section in the documents, at the start of a line.
HEADS = {"requirements": ("the", "la", "le"), "responsibilities": ("in", "en"), "preferred": ("de",), "summary": ("a",), "benefits": ("of",)}


@query()
def posting_sections(t: Tables) -> DataFrame:
    """Lines of each document by the section that the last line beginning with a heading word opens."""
    return Y.posting_sections(t.documents.where("doc_id IS NOT NULL"), "doc_id", "text", HEADS).select("doc_id", "section", "line_no", F.md5("line").alias("line_md5"))


@query()
def posting_requirements(t: Tables) -> DataFrame:
    """What the sections of each document ask for."""
    return Y.posting_requirements(Y.posting_sections(t.documents.where("doc_id IS NOT NULL"), "doc_id", "text", HEADS), "doc_id")
