"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1)


def squeeze(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def clean_title(title: Column) -> Column:
    """A title without the tags that it is urgent or hiring, white space runs as one space, bars and dashes at the ends off."""
    bare = F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"[【\[]?(?:急招|招聘中|实习招聘)[】\]]?", "")
    return F.regexp_replace(bare, r"^[ \-—|｜]+|[ \-—|｜]+$", "")


def dedup_key(text: Column) -> Column:
    """Lower-cased letters, digits and CJK characters alone."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9一-龥]", "")


def fingerprint_part(text: Column) -> Column:
    """Lower-cased word characters alone, of any script."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]", "")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |; null when one of them is blank."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(p), F.lit("")) == "" for p in parts])
    return F.when(~blank, F.sha2(F.concat_ws("|", *parts), 256))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; no query, fragment or closing slash."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(head == "", F.lit(None)).otherwise(F.regexp_replace(F.concat(head, rest), r"/+$", ""))


def approx_tokens(text: Column) -> Column:
    """One per CJK character, a quarter of the characters (rounded up) per ASCII word, one per other mark."""
    cjk = F.size(F.regexp_extract_all(text, F.lit(r"([\x{3400}-\x{9fff}])"), 1))
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_+#.\-/]+)"), 1)
    latin = F.aggregate(words, F.lit(0), lambda s, w: s + F.ceil(F.length(w) / 4).cast("int"))
    marks = F.size(F.regexp_extract_all(text, F.lit(r"([^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}])"), 1))
    return (cjk + latin + marks).cast("long")


def plain_digits(text: Column, first: int = 0xE031) -> Column:
    """Digits that a private-use font shows, as digits."""
    return F.translate(text, "".join(chr(first + k) for k in range(10)), "0123456789")


def skill_name(text: Column) -> Column:
    """A skill's name in lower case, runs of white space, - and _ as one space, marks at the ends off."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_\-]+", " "), r"^[\s.,;:!?·、，。；：]+|[\s.,;:!?·、，。；：]+$", "")


def bounded_contains(text: Column, term: str) -> Column:
    """Whether an ASCII term stands alone (no letter or digit beside it), or another term occurs at all."""
    if term.isascii():
        quoted = "".join(c if c.isalnum() else "\\" + c for c in term.lower())
        return F.lower(text).rlike(rf"(?<![a-z0-9]){quoted}(?![a-z0-9])")
    return F.lower(text).contains(term.lower())


def grams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Mixed tokens: ASCII words, and runs of CJK characters cut into n-grams marked zhN:."""
    runs = F.regexp_extract_all(text, F.lit(r"([一-鿿]+)"), 1)

    def cut(n: int) -> Column:
        def of_run(r: Column) -> Column:
            places = F.sequence(F.lit(1), F.length(r) - n + 1)
            made = F.transform(places, lambda i: F.concat(F.lit(f"zh{n}:"), F.substring(r, i, F.lit(n))))
            return F.when(F.length(r) >= n, made).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(runs, of_run))

    return F.concat(ascii_tokens(text), *[cut(n) for n in sizes])


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap(a: Column, query: Column) -> Column:
    """Share of the query's distinct items that `a` holds."""
    return F.size(F.array_intersect(a, query)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def set_cosine(a: Column, b: Column) -> Column:
    n, m = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((n == 0) | (m == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt((n * m).cast("double")))


def min_overlap(a: Column, b: Column) -> Column:
    """Shared items over the smaller set's size."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def simhash(items: DataFrame, key: str, token: str, into: str = "simhash", bits: int = 64) -> DataFrame:
    """64-bit SimHash of each key's token rows: every token votes on every bit by its hash; ties set the bit.

    One partial sum per bit, so a key's tokens may be spread over any number of tasks.
    """
    hashed = items.select(key, F.xxhash64(token).alias("__h"))
    votes = hashed.groupBy(key).agg(*[F.sum(2 * F.getbit("__h", F.lit(b)).cast("int") - 1).alias(f"__v{b}") for b in range(bits)])
    value = F.lit(0).cast("bigint")
    for b in range(bits):
        bit = -(1 << 63) if b == 63 else 1 << b
        value = value.bitwiseOR(F.when(F.col(f"__v{b}") >= 0, F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return votes.select(key, value.alias(into))


#: Every sixteenth bit: a number holds four counts of up to 65,535.
_LANES = np.uint64(0x0001000100010001)


def simhashes(hashes: pd.Series) -> np.ndarray:
    """64-bit SimHash of each row's token hashes, as `simhash` gives it; 0 without tokens."""
    sizes = np.array([0 if h is None else len(h) for h in hashes], np.int64)
    out = np.zeros(len(sizes), np.uint64)
    for low in range(0, len(sizes), 256):
        some = np.flatnonzero((sizes[low : low + 256] > 0) & (sizes[low : low + 256] < 65_536)) + low
        if len(some):
            flat = np.concatenate([np.asarray(hashes.iloc[k], np.int64) for k in some]).view(np.uint64)
            starts, half = np.cumsum(sizes[some]) - sizes[some], (sizes[some] + 1) // 2
            for b in range(16):
                ones = np.add.reduceat((flat >> np.uint64(b)) & _LANES, starts)
                for at in range(b, 64, 16):
                    set_ = ((ones >> np.uint64(at - b)) & np.uint64(0xFFFF)).astype(np.int64) >= half
                    out[some] |= set_.astype(np.uint64) << np.uint64(at)
    for k in np.flatnonzero(sizes >= 65_536):
        flat = np.asarray(hashes.iloc[k], np.int64).view(np.uint64)
        for b in range(64):
            set_ = int(((flat >> np.uint64(b)) & np.uint64(1)).sum()) * 2 >= len(flat)
            out[k] |= np.uint64(set_) << np.uint64(b)
    return out.view(np.int64)


@F.pandas_udf(LongType())
def simhash_of(hashes: pd.Series) -> pd.Series:
    """`simhashes` of a column."""
    return pd.Series(simhashes(hashes))


@F.pandas_udf(StructType([StructField("tokens", ArrayType(LongType())), StructField("sign", LongType())]))
def signed_set(hashes: pd.Series) -> pd.DataFrame:
    """Each row's distinct token hashes in order, and their SimHash: made together, so that the text is read once."""
    tokens = pd.Series([np.unique(np.asarray(h, np.int64)) for h in hashes], dtype=object)
    return pd.DataFrame({"tokens": tokens, "sign": simhashes(tokens)})


def claim_key(text: Column) -> Column:
    """A claim without marks of lists and emphasis: lower-case letters, digits, + # . and CJK alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[#*_`>\-•·]+", " "), r"[^a-z0-9\x{3400}-\x{9fff}+#.]+", "")


def claim_tokens(text: Column) -> Column:
    """Distinct words of two characters or more, with + # . _ / - inside, and pairs of neighbouring CJK characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9+#._/-]*)"), 1), lambda w: F.length(w) > 1)
    runs = F.filter(F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{9fff}]+)"), 1), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


_SPLIT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b in b"+#._/-" else 32 for b in range(256))
_NO_KEY = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122 or b in b"+."))
_CJK = re.compile("[\u3400-\u9fff]+")
_NO_CJK_KEY = re.compile("[^a-z0-9\u3400-\u9fff+.]+")
#: Words whose hashes a worker remembers.
_WORDS_HELD = 1 << 19
_hashes: dict[bytes, int] = {}


def claim_parts(text: str | None) -> tuple[bytes, set[bytes]]:
    """What claim_key (null: empty) and claim_tokens give, in UTF-8."""
    low = (text or "").lower()
    raw = low.encode()
    words = {w for piece in raw.translate(_SPLIT).split() if len(w := piece.lstrip(b"+#._/-")) > 1}
    runs = [] if len(raw) == len(low) else _CJK.findall(low)
    if not runs:
        return raw.translate(None, _NO_KEY), words
    words.update(run[k : k + 2].encode() for run in runs for k in range(len(run) - 1))
    return _NO_CJK_KEY.sub("", low).encode(), words


def _hash(words: list[bytes]) -> list[int]:
    """64 bits of each word."""
    if len(_hashes) > _WORDS_HELD:
        _hashes.clear()
    out = []
    for w in words:
        if (h := _hashes.get(w)) is None:
            h = _hashes[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits mixed, one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(StructType([StructField("key", StringType()), StructField("tokens", ArrayType(LongType())), StructField("sign", LongType())]))
def claim_sets(scope: pd.Series, claims: pd.Series) -> pd.DataFrame:
    """Within a scope: 128 bits of each claim's key, its tokens' hashes and their parity (firstcome.parity), in one reading."""
    keys, found, sizes, salts = [], [], np.zeros(len(claims), np.int64), []
    for n, (within, text) in enumerate(zip(scope, claims, strict=True)):
        mark = b"\x1e" if within is None else b"\x1f" + within.encode()
        key, words = claim_parts(text)
        keys.append(blake2b(mark + (b"" if text is None else b"\x1f" + key), digest_size=16).hexdigest())
        found += _hash(words)
        sizes[n] = len(words)
        salts.append(mark)
    salt = np.array(_hash(salts), np.uint64)
    flat = mixed(np.array(found, np.uint64) ^ np.repeat(salt, sizes)).view(np.int64)
    sign, some = np.zeros(len(sizes), np.int64), sizes > 0
    if len(flat):
        sign[some] = np.bitwise_xor.reduceat(np.int64(1) << (flat & 63), (np.cumsum(sizes) - sizes)[some])
    return pd.DataFrame({"key": keys, "tokens": pd.Series(np.split(flat, np.cumsum(sizes))[:-1], dtype=object), "sign": sign})


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding to the nearest, ties to the even digit."""
    return F.bround(value, digits)


def content_hash(*values: Column) -> Column:
    """SHA-256 over the JSON of the values in the order given; name them to have the names in it."""
    return F.sha2(F.to_json(F.struct(*values)), 256)
