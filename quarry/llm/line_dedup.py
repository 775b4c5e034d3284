"""Near-duplicate lines removed across documents by a deletion-neighbourhood join.

A line goes if an earlier line (by doc_id, then line number) has the same words,
or, where both have at least `MIN_WORDS` words, words within one insertion,
deletion or substitution. Lines without words stay.

Method, in DataFrame functions only:
1. Every line has two 64-bit hashes of its words; the earliest place of each is a
   grouped minimum, so a line with any number of copies is one row a task.
2. Two lines within the bound share their first or their last floor((L - 1) / 2)
   words, L being the longer one's length. Lines that share neither with another
   line can't have a neighbour. What is shared is kept as a bitmap, sized by its count
   (hash collisions only add candidates), which every task tests its lines against;
   past the largest bitmap it is a join.
3. Each candidate emits its variants within the bound as hashed keys: the line
   without its i-th word, once with i (two such lines differ by a substitution) and
   once as a plain line (to meet a line that is one word shorter). All members of a
   key's group are neighbours of each other, or of the one plain line, so the
   earliest neighbour is again a grouped minimum and no pairs are made.
4. The pair of each line and its earliest neighbour is verified word by word. Where
   it fails (hashes collided) all members of that key are compared with the line.
5. Documents are written again without the lines that go.

The hashes of variants come from running sums, so a line of n words costs n steps.

Where doc_ids repeat or several are null, rows are told apart by a number of their own:
a place is still (doc_id, line number), so lines of two such rows at the same place don't
drop each other, a line that one of them has at a later place goes, and what a row loses
is always its own line.

Edge cases: null text stays null with no lines; a text whose lines all go becomes
empty; rows that repeat a doc_id with one text keep the same lines; a null doc_id sorts
first; white space only separates words; an empty table gives an empty result;
other columns are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import having, stored

MIN_WORDS = 8
_FIRST = -(1 << 63)
_MASK = (1 << 40) - 1
_RUN = 256


def words_in(line: Column) -> Column:
    return F.array_remove(F.split(line, r"[\t-\r ]+"), "")


def place_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_FIRST))


def halves(w: Column) -> Column:
    """Hashes of the first and last words that a neighbour shares: for L = n and L = n + 1."""
    n = F.size(w)
    out = []
    for longer in (n, n + 1):
        h = F.floor((longer - 1) / 2).cast("int")
        out += [F.xxhash64(longer, F.lit(0), F.slice(w, 1, h)), F.xxhash64(longer, F.lit(1), F.slice(w, n - h + 1, h))]
    return F.array(*out)


def running(values: Column) -> Column:
    """Sums of all values before each place, and after the last; runs of _RUN keep it linear."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(values) / _RUN).cast("int")),
        lambda r: F.slice(values, r * _RUN + 1, _RUN),
    )

    def sums(items: Column, start: Column) -> Column:
        def step(acc, x):
            return F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a"))

        return F.aggregate(items, F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("a")), step)

    def total(r: Column) -> Column:
        return F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + x)

    heads = sums(F.transform(runs, total), F.lit(0).cast("bigint"))["a"]
    return F.flatten(F.transform(F.arrays_zip(runs.alias("r"), heads.alias("h")), lambda z: sums(z["r"], z["h"])["a"]))


def variants(lines: DataFrame) -> DataFrame:
    """key, role of every variant of lines(words, ...): s without word i, p plain, d one word shorter."""
    w = F.col("words")
    keyed = lines.withColumn("n", F.size(w)).withColumn(
        "here", F.transform(w, lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit(_MASK)))
    ).withColumn(
        "moved", F.transform(w, lambda x, i: F.xxhash64(x, i - 1).bitwiseAND(F.lit(_MASK)))
    )
    keyed = keyed.withColumn("total", F.aggregate("here", F.lit(0).cast("bigint"), lambda s, x: s + x))
    keyed = keyed.withColumn("all_moved", F.aggregate("moved", F.lit(0).cast("bigint"), lambda s, x: s + x))
    keyed = keyed.withColumn("before", running(F.col("here"))).withColumn("before_moved", running(F.col("moved")))

    def key(n: Column, i: Column, hashed: Column) -> Column:
        return F.xxhash64(n, i, hashed)

    places = F.sequence(F.lit(0), F.col("n") - 1)
    same = F.transform(places, lambda i: F.struct(
        key(F.col("n"), i, F.col("total") - F.get("here", i)).alias("key"), F.lit("s").alias("role")))
    shorter = F.transform(places, lambda i: F.struct(
        key(F.col("n") - 1, F.lit(-1), F.get("before", i) + F.col("all_moved") - F.get("before_moved", i) - F.get("moved", i)).alias("key"),
        F.lit("d").alias("role")))
    plain = F.array(F.struct(key(F.col("n"), F.lit(-1), F.col("total")).alias("key"), F.lit("p").alias("role")))
    kept = [c for c in lines.columns if c != "words"]
    return keyed.select(*kept, F.inline(F.concat(plain, same, shorter)))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word lists are within one insertion, deletion or substitution."""
    n, m = F.size(a), F.size(b)
    same = F.transform(F.sequence(F.lit(0), F.least(n, m)), lambda i: F.get(a, i).eqNullSafe(F.get(b, i)))
    k = F.coalesce(F.array_position(same, False), F.lit(0)).cast("int")  # first difference, from 1; 0 for none
    rest = lambda x, skip: F.slice(x, k + skip, F.size(x) + 1)
    return (
        (k == 0)
        | ((n == m) & (rest(a, 1) == rest(b, 1)))
        | ((n == m + 1) & (rest(a, 1) == rest(b, 0)))
        | ((m == n + 1) & (rest(a, 0) == rest(b, 1)))
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, number, row of all columns; whether ids are shared): the number is the id, or the row's own where ids are shared."""
    base = docs.select(place_id(docs).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = base.groupBy("id").count().where("count > 1").limit(1).count() > 0
    if not shared:
        return base.withColumn("number", F.col("id")), False
    return stored(base.withColumn("number", F.monotonically_increasing_id()), "numbered"), True


def lines_of(base: DataFrame) -> DataFrame:
    """id, number, line_no, line of every line."""
    return base.select("id", "number", F.posexplode(F.split("row.text", "\n", -1)).alias("line_no", "line"))


def hashed_lines(base: DataFrame) -> DataFrame:
    """id, number, line_no, h1, h2 of every line with words, and the halves of the longer ones."""
    hashed = lines_of(base).select(
        "id", "number", "line_no",
        F.inline(F.transform(F.array(words_in(F.col("line"))), lambda w: F.struct(
            F.size(w).alias("n"), F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2"),
            F.when(F.size(w) >= MIN_WORDS, halves(w)).alias("halves")))),
    )
    return stored(hashed.where("n > 0").drop("n"), "lines")


def first_places(lines: DataFrame) -> DataFrame:
    """h1, h2, at (id, line_no), copies, halves of every distinct line."""
    first = lines.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "line_no", "halves")).alias("least"), F.count(F.lit(1)).alias("copies")
    )
    at = F.struct("least.id", "least.line_no")
    return stored(first.select("h1", "h2", at.alias("at"), "copies", F.col("least.halves").alias("halves")), "distinct-lines")


def near_lines(base: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, line_no, h1 of first occurrences that have an earlier near neighbour."""
    listed = firsts.select("at", "h1", F.explode("halves").alias("half"))
    shared = (
        listed.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where(F.col("low") != F.col("high"))
    )
    shared = stored(shared.select("half"), "shared-halves")
    place = F.xxhash64("id", "line_no")
    wanted = having(listed, "half", shared).select("at", "h1").distinct().select("at.id", "at.line_no", "at", "h1")
    wanted = stored(wanted.withColumn("place", place), "wanted-places")
    # The words of these lines: other lines are passed over before they are split.
    met_lines = having(lines_of(base).withColumn("place", place), "place", wanted.select("place")).select("id", "line_no", "line")
    # Rows that share an id may have several lines at a place: the hash tells them apart.
    at = F.struct("id", "line_no", "h1").alias("at")
    candidates = met_lines.join(wanted.drop("at"), ["id", "line_no"]).select(at, "h1", words_in(F.col("line")).alias("words"))
    candidates = stored(candidates.where(F.xxhash64("words") == F.col("h1")).dropDuplicates(["at"]), "near-candidates")

    keyed = stored(variants(candidates), "variants")
    met = (
        keyed.select("key", "h1").groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where(F.col("low") != F.col("high"))
    )
    met = stored(met.select("key"), "met-keys")
    meeting = stored(having(keyed.select("key", "role", "at"), "key", met), "meeting-variants")
    first = meeting.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"first_{r}") for r in ("s", "p", "d")]
    )
    other = F.when(F.col("role") == "s", F.col("first_s")).when(F.col("role") == "p", F.col("first_d")).otherwise(F.col("first_p"))
    before = F.struct("earlier.id", "earlier.line_no") < F.struct("at.id", "at.line_no")
    pairs = meeting.join(first, "key").select("key", "role", "at", other.alias("earlier")).where(before)
    ours = candidates.select("at", F.col("words").alias("own"))
    theirs = candidates.select(F.col("at").alias("earlier"), F.col("words").alias("near"))
    checked = pairs.join(ours, "at").join(theirs, "earlier").withColumn("good", within_one(F.col("own"), F.col("near")))
    checked = stored(checked.select("key", "role", "at", "own", "good"), "verified")
    found = checked.where("good").select("at")
    # Colliding hashes: all members of the key against the lines that were matched wrongly.
    doubtful = checked.where(~F.col("good")).select("key", "at", "own")
    again = (
        doubtful.join(meeting.select("key", F.col("at").alias("earlier")), "key")
        .where(before)
        .join(theirs, "earlier").where(within_one(F.col("own"), F.col("near")))
    )
    return found.unionByName(again.select("at")).distinct().select("at.id", "at.line_no", "at.h1")


def repeated_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """number, line_no of all later occurrences of a line's words."""
    keys = ["h1", "h2"]
    again = firsts.where("copies > 1").select(*keys, "at", "copies")
    # Lines with more copies than a hundred-thousandth of all lines (so fewer than 100,000 of
    # them) are sent to every task, so that their copies stay where they are.
    many = max(1000, lines.count() // 100_000)
    hot = again.where(F.col("copies") > many)
    rows = lines.select("id", "number", "line_no", *keys)
    met = rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(again.where(F.col("copies") <= many), keys)
    )
    return met.where(F.struct("id", "line_no") > F.col("at")).select("number", "line_no")


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents without their near-duplicate lines, all columns, and the numbers of all and of dropped lines
    under the names given (in place of columns of these names)."""
    base, shared = numbered(docs)
    lines = hashed_lines(base)
    firsts = first_places(lines)
    near = near_lines(base, firsts)
    near = lines.join(near, ["id", "line_no", "h1"], "left_semi").select("number", "line_no") if shared else near.select(F.col("id").alias("number"), "line_no")
    gone = repeated_lines(lines, firsts).unionByName(near)
    drops = gone.groupBy("number").agg(F.collect_set("line_no").alias("drops"))
    joined = base.select("number", "row").join(drops, "number", "left")
    lines = F.split("row.text", "\n", -1)
    none = F.array().cast("array<int>")
    kept = F.transform(
        F.array(F.struct(lines.alias("l"), F.coalesce("drops", none).alias("d"))),
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["d"]), lambda i: F.get(x["l"], i)), "\n"),
    )[0]
    text = F.when(F.col("drops").isNull(), F.col("row.text")).otherwise(kept)
    made = {n_lines: F.coalesce(F.size(lines), F.lit(0)).cast("long"), n_dropped: F.coalesce(F.size("drops"), F.lit(0)).cast("long")}
    carried = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in made]
    return joined.select(*carried, *[c.alias(name) for name, c in made.items()])


#: The same rows from SQL: the words of lines joined as they are, no hashes.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\t-\r ]+'), lambda x: x <> '') AS w FROM split),
firsts AS (SELECT w, min((doc_id, line_no)) AS spot FROM worded WHERE len(w) > 0 GROUP BY w),
long_lines AS (SELECT w, spot, len(w) AS n FROM firsts WHERE len(w) >= 8),
places AS (SELECT w, spot, n, unnest(range(1, n + 1)) AS i FROM long_lines),
holes AS (SELECT spot, n, i, list_concat(w[1:i-1], w[i+1:n]) AS rest FROM places),
substituted AS (
  SELECT spot FROM (SELECT spot, min(spot) OVER (PARTITION BY n, i, rest) AS first FROM holes) WHERE first < spot),
lengthened AS (
  SELECT h.spot AS more, l.spot AS less FROM holes h JOIN long_lines l ON l.w = h.rest),
near AS (
  SELECT spot FROM substituted UNION
  SELECT more FROM lengthened WHERE less < more UNION
  SELECT less FROM lengthened WHERE more < less),
judged AS (
  SELECT d.doc_id, d.line_no, d.line,
         len(d.w) > 0 AND ((d.doc_id, d.line_no) > f.spot OR n.spot IS NOT NULL) AS gone
  FROM worded d LEFT JOIN firsts f ON f.w = d.w LEFT JOIN near n ON n.spot = (d.doc_id, d.line_no)),
built AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, b.text, coalesce(b.n_lines, 0)::BIGINT AS n_lines, coalesce(b.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN built b USING (doc_id)
"""
