"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import inverted
from .joins import top_k


def term_scores(docs: DataFrame, queries: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """item_id, doc_id, bm25, shared, terms of every document that has a term of a query; with k, of those that may be among its k best.

    docs(doc_id, text), queries(item_id, text). One pass over the texts, in which terms that no query has are dropped before
    anything is counted; the counts are written in blocks, and searched block by block.
    """
    return inverted.hits(inverted.build(docs, wanted=inverted.wanted_terms(queries)), queries, k, k1, b)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top k documents of each query by BM25."""
    scored = term_scores(docs, queries, k).select("item_id", "doc_id", F.col("bm25").alias("score"))
    return top_k(scored, "item_id", [F.desc("score"), F.asc("doc_id")], k)


def reranked(hits: DataFrame, query: str, id_: str, mode: str, k: int, sparse: float = 0.55, dense: float = 0.45, rrf_k: int = 60) -> DataFrame:
    """Hits of two channels fused by mode and ranked by the final score, k of each query.

    hits(query, id, full_rank, vector_rank, lexical, semantic, title, section); what a channel doesn't have is null.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    part = lambda rank, w: F.coalesce(F.lit(w / (sparse + dense)) / (rrf_k + F.col(rank)), F.lit(0.0))
    scored = hits.withColumn("rrf", part("full_rank", sparse) + part("vector_rank", dense))
    best = scored.groupBy(query).agg(F.max("rrf").alias("best"))
    scored = scored.join(best, query).withColumn("fused", F.least(F.lit(1.0), fuse(mode, F.col("rrf") / F.col("best"), none("lexical"), none("semantic"))))
    scored = scored.withColumn("final", F.round(F.least(F.lit(1.0), final_score(F.col("fused"), none("title"), F.coalesce("section", F.lit(0.5)))), 6)).withColumn("fused", F.round("fused", 6))
    return top_k(scored.drop("best"), query, [F.desc("final"), F.desc("fused"), F.asc(id_)], k)


def section_weights(query: Column, weights: dict[str, float], intents: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> dict[str, Column]:
    """A weight for each section: raised for those that the query's cues ask for, lowered for others, as given without a cue.

    intents: (cues, sections).
    """
    low = F.lower(query)
    said = {k: F.lit(False) for k in range(len(intents))}
    for k, (cues, _) in enumerate(intents):
        for c in cues:
            said[k] = said[k] | low.contains(c)
    some, out = F.lit(False), {}
    for k in said:
        some = some | said[k]
    for name, w in weights.items():
        asked = F.lit(False)
        for k, (_, sections) in enumerate(intents):
            if name in sections:
                asked = asked | said[k]
        lowered = 0.48 if name == "source_context" else max(0.3, w * 0.68)
        out[name] = F.when(~some, w).when(asked, max(0.92, min(1.0, w + 0.16))).otherwise(lowered)
    return out


def expanded_terms(query: Column, aliases: dict[str, str], concepts: list[tuple[str, tuple[str, ...]]], stop: tuple[str, ...] = (), most: int = 20) -> Column:
    """A query's search terms: aliases (longest first) with their canonical names, else its own tokens; then what concepts add.

    concepts: (pattern of the cue, further terms).
    """
    low = F.lower(F.regexp_replace(F.trim(query), r"\s+", " "))
    empty = F.array().cast("array<string>")
    found = [F.when(T.bounded_contains(low, a), F.array(F.lit(a), F.lit(aliases[a].lower()))).otherwise(empty) for a in sorted(aliases, key=lambda x: (-len(x), x))]
    named = F.concat(*found) if found else empty
    tokens = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9+#._/-]*)"), 1), lambda x: F.length(x) > 1)
    more = [F.when(low.rlike(cue), F.array(*[F.lit(x) for x in terms])).otherwise(empty) for cue, terms in concepts]
    all_ = F.concat(F.when(F.size(named) > 0, named).otherwise(tokens), *more)
    kept = F.filter(F.transform(all_, F.trim), lambda x: (F.length(x) >= 2) & ~x.isin(*stop) if stop else F.length(x) >= 2)
    return F.slice(F.array_distinct(kept), 1, most)


def multi_query(hits: DataFrame, query: str, id_: str, sub: str, k: int = 60) -> DataFrame:
    """Hits of several sub-queries summed by reciprocal rank: fused (of the query's best) and how many sub-queries found it."""
    summed = hits.groupBy(query, id_).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.countDistinct(sub).alias("matched"))
    best = summed.groupBy(query).agg(F.max("rrf").alias("best"))
    return summed.join(best, query).select(query, id_, (F.col("rrf") / F.col("best")).alias("fused"), "matched")


def local_rerank(fused: Column, score: Column, lexical: Column, section: Column, matched: Column) -> Column:
    return F.least(F.lit(1.0), 0.44 * fused + 0.22 * score + 0.2 * lexical + 0.09 * section + 0.05 * F.least(F.lit(1.0), matched / 2))


def lexical_score(query: Column, title: Column, content: Column, company: Column) -> Column:
    """.55 content + .30 title + .15 company overlap of tokens, with a bonus for the whole phrase, at most 1."""
    q = F.array_distinct(T.ascii_tokens(query))
    phrase = F.lower(F.trim(query))
    bonus = F.when(F.lower(title).contains(phrase), 0.35).when(F.lower(content).contains(phrase), 0.15).otherwise(0.0)
    score = 0.55 * T.overlap(T.ascii_tokens(content), q) + 0.30 * T.overlap(T.ascii_tokens(title), q) + 0.15 * T.overlap(T.ascii_tokens(company), q)
    return F.least(F.lit(1.0), score + F.when(phrase == "", 0.0).otherwise(bonus))


def fuse(mode: str, rrf: Column, lexical: Column, semantic: Column) -> Column:
    """Fused score by mode."""
    if mode == "full_text":
        return 0.8 * lexical + 0.2 * rrf
    if mode == "vector":
        return 0.82 * semantic + 0.18 * rrf
    return 0.48 * rrf + 0.27 * lexical + 0.25 * semantic


def final_score(fused: Column, title: Column, section: Column) -> Column:
    return 0.78 * fused + 0.14 * title + 0.08 * section


def merge_hits(hits: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Union of channels' hits: greatest score of each channel and the set of channels."""
    return hits.groupBy(*by).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("score"))).alias(f"{c}_score") for c in channels],
        F.array_sort(F.collect_set("channel")).alias("channels"),
    )


def candidate_pool(channels: dict[str, DataFrame], query: str, id_: str, size: int = 30, k: int = 60) -> DataFrame:
    """Fused pool of several ranked channels with each candidate's ranks by channel."""
    parts = None
    for name, d in channels.items():
        p = d.select(query, id_, "rank", F.lit(name).alias("channel"))
        parts = p if parts is None else parts.unionByName(p)
    fused = parts.groupBy(query, id_).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "channel", F.col("rank").cast("string")))), ",").alias("ranks"),
    )
    return top_k(fused.withColumn("rrf", F.round("rrf", 9)), query, [F.desc("rrf"), F.asc(id_)], size)


def memory_score(lexical: Column, semantic: Column, recency: Column, confidence: Column, confirmed: Column, pinned: Column) -> Column:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return 0.42 * lexical + 0.36 * semantic + 0.10 * recency + 0.08 * confidence + 0.04 * flag(confirmed) + 0.06 * flag(pinned)


def numbers_grounded(answer: Column, evidence: Column) -> Column:
    """Numbers in an answer that its evidence doesn't have."""
    pattern = F.lit(r"(\d+(?:\.\d+)?)")
    return F.array_except(F.regexp_extract_all(answer, pattern, 1), F.regexp_extract_all(evidence, pattern, 1))


def sufficiency(coverage: Column, quality: Column, diversity: Column, conflicts: Column) -> Column:
    """struct(score, sufficient) of a query's evidence."""
    score = 0.72 * coverage + 0.16 * quality + 0.12 * diversity
    return F.struct(score.alias("score"), ((score >= 0.65) & (coverage >= 0.42) & (conflicts == 0)).alias("sufficient"))
