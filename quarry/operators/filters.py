"""Predicates and filters. Each is a Column or a DataFrame transform; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_contains(columns: list[str], term: str) -> Column:
    """Case-insensitive substring in any of the columns; % and _ in the term keep their meaning."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{term}%") for c in columns])


def json_text(column: str, path: str) -> Column:
    return F.get_json_object(F.col(column), path)


def conjunction(*conditions: Column | None) -> Column:
    """All conditions that are given; true if none is."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def overlaps_strictly(low: str, high: str, floor: float | None = None, ceiling: float | None = None) -> Column:
    """An interval with optional ends meets [floor, ceiling]; rows with no end at all fail."""
    return conjunction(
        None if floor is None else F.coalesce(F.col(high), F.col(low)) >= floor,
        None if ceiling is None else F.coalesce(F.col(low), F.col(high)) <= ceiling,
    )


def overlaps_tolerantly(low: str, high: str, floor: float | None = None, ceiling: float | None = None) -> Column:
    """As above, but an open end passes."""
    return conjunction(
        None if floor is None else F.col(high).isNull() | (F.col(high) >= floor),
        None if ceiling is None else F.col(low).isNull() | (F.col(low) <= ceiling),
    )


def valid(active: str, version: str, wanted: str, expires: str, now: str, quality: str, least: float = 0.35) -> Column:
    """Active, of the wanted version, not expired, and of sufficient or unknown quality."""
    return (
        F.col(active) & (F.col(version) == wanted)
        & (F.col(expires).isNull() | (F.col(expires) > F.to_timestamp(F.lit(now))))
        & (F.col(quality).isNull() | (F.col(quality) >= least))
    )


def rule_filter(text: str, owner: str, blocked: list[str], excluded: list[str], required: list[str]) -> Column:
    """struct(passed, reasons): blocked owners, any excluded word, every required word."""
    low = F.lower(F.col(text))
    reasons = F.array_compact(F.array(
        F.when(F.col(owner).isin(blocked), "blocked_owner"),
        *[F.when(low.contains(w), f"excluded:{w}") for w in excluded],
        *[F.when(~low.contains(w), f"missing:{w}") for w in required],
    ))
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def fresh(column: str, now: str, days: int = 3) -> Column:
    return F.col(column) >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS")


def key_matches(column: str, pattern: str) -> Column:
    """prefix.* or an exact key."""
    return F.col(column).startswith(pattern[:-1]) if pattern.endswith(".*") else F.col(column) == pattern


def synonyms(values: list[str], table: dict[str, list[str]]) -> list[str]:
    """The values and all spellings of their groups."""
    groups = {w: [k, *v] for k, v in table.items() for w in (k, *v)}
    return sorted({x for v in values for x in groups.get(v, [v])})


#: What must never be stored.
SENSITIVE = (
    r"(?i)(?:sk-[a-z0-9_-]{12,}|(?:api[_-]?key|password)\s*[:=]\s*[^\s,}\"]+|身份证(?:号|号码)?\s*[:：=]\s*\d{6,})"
)


def sensitive(column: str, most_bytes: int = 4_000_000) -> Column:
    return F.col(column).rlike(SENSITIVE) | (F.octet_length(F.col(column)) > most_bytes)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table; the feature is the limit."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def filled(df: DataFrame, column: str, by: str, defaults: dict[str, str]) -> DataFrame:
    """Nulls of a column filled by another column's value."""
    cases = F.lit(None)
    for k, v in defaults.items():
        cases = F.when(F.col(by) == k, v) if k == next(iter(defaults)) else cases.when(F.col(by) == k, v)
    return df.withColumn(column, F.coalesce(F.col(column), cases))
