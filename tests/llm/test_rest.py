"""Vectors, archives, mixing and the pipeline."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import fixity, neural_index, pfair
from quarry.llm.common import id_ranges, scratch

SHAPE = "vec_id long, embedding array<float>, part string"


def brute(rows, query, k):
    q = np.array(rows[query], float)
    found = sorted((float(np.sqrt(((np.array(v, np.float32).astype(float) - q) ** 2).sum())), i) for i, v in rows.items() if i != query)
    return [(i, d) for d, i in found[:k]]


def test_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 16))
    rows = {k: (centres[k % 20] + 0.3 * rng.normal(0, 1, 16)).astype(np.float32).tolist() for k in range(1500)}
    rows |= {k: rows[0] for k in range(1500, 1900)}  # a group of copies
    odd = [(5000, None, ""), (5001, [0.0] * 16, ""), (5002, [float("nan")] * 16, ""), (5003, [None] + [1.0] * 15, ""), (5004, [1.0], ""), (None, rows[0], "")]
    df = spark.createDataFrame([(k, v, "clash") for k, v in rows.items()] + odd, SHAPE)
    got = neural_index.search(df, df.where(F.col("vec_id") % 100 == 0), parts=8, probes=5, sample=600, block=100).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [k for k in rows if k % 100 == 0]
    assert set(found) == set(queries)
    hit = 0
    for q in queries:
        want = brute(rows, q, 10)
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        hit += len({i for i, _ in want} & {i for _, i, _ in mine})
        for _, i, score in mine:
            assert math.isclose(score, float(np.sqrt(((np.array(rows[i], float) - np.array(rows[q], float)) ** 2).sum())), abs_tol=1e-12)
    assert hit >= 0.9 * 10 * len(queries)
    assert [i for _, i, _ in sorted(found[0])] == list(range(1500, 1510))
    asked = df.where("vec_id IN (0, 100, 5004)")
    twice = neural_index.search(df, asked.unionByName(asked), parts=8, probes=5, sample=600, block=100)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in twice.collect()) == sorted((q, r, i) for q in (0, 100) for r, i, _ in found[q])
    few = df.where("vec_id < 4")
    assert neural_index.search(few, few.where("vec_id = 0")).count() == 3
    assert neural_index.search(df.limit(0), df.limit(0)).count() == 0


def test_search_recall_at_production_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r["vec_id"]: list(r["embedding"]) for r in df.collect() if r["embedding"] is not None}
    got = neural_index.search(df, df.where(F.col("vec_id") % 100 == 0)).collect()
    queries = {r["query_id"] for r in got}
    hit = sum(len({i for i, _ in brute(rows, q, 10)} & {r["vec_id"] for r in got if r["query_id"] == q}) for q in queries)
    assert len(queries) >= 15 and hit >= 9 * len(queries)


def test_probes_follow_the_data_and_huge_vectors_count(spark):
    rng = np.random.default_rng(2)
    noise, centres = rng.normal(0, 1, (3000, 24)), rng.normal(0, 1, (40, 24))
    close = centres[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(0, 1, (3000, 24))
    for x, few in ((noise, False), (close, True)):
        router = neural_index.fit(x, 16)
        many = router.best(x[:300])[1]
        assert (many.mean() < 4) if few else (many.mean() > 8)
        near = [set(np.argsort(neural_index.distances(x, x[q]))[1:11]) for q in range(300)]
        place = router.best(x, 1)[0]
        parts = np.split(router.best(x[:300])[0], np.cumsum(many)[:-1])
        assert sum(len({i for i in near[q] if place[i] in set(parts[q])}) for q in range(300)) >= 0.9 * 3000
    assert [neural_index.parts_for(n) for n in (0, 50_000, 10**6, 4 * 10**6, 10**12)] == [16, 16, 32, 32, 64]
    rows = {0: [1.0, 2.0], 100: [1e200, 1.0], 3: [1e200, 5.0], 4: [-1e200, 1.0], 5: [1e-200, 0.0]}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neural_index.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [i for _, i, _ in sorted(got[100])] == [3, 0, 5, 4] and [i for _, i, _ in sorted(got[0])] == [5, 3, 4, 100]
    assert {i: d for _, i, d in got[100]} == {3: 4.0, 0: 1e200, 5: 1e200, 4: 2e200}


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (800, 8))
    part = neural_index.balanced_parts(x, neural_index.neighbour_graph(x, 5), 8, rng)
    assert np.bincount(part, minlength=8).max() <= 110


def test_schedule_keeps_windows_and_deviation(spark):
    rng = random.Random(6)
    rows = [(k, None if k % 50 == 0 else f"s{min(rng.randrange(12), 5)}", "clash") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"s0": 5.0, "s1": 3.0, "s2": 1.0, "s3": 1.0, "s4": 1.0, "s5": 2.0, "": 0.5}
    got = pfair.schedule(df, weights, block=4).toPandas()
    blocks = got.drop_duplicates(["source", "block"]).sort_values("slot")
    assert blocks["slot"].tolist() == list(range(len(blocks)))
    assert (blocks["slot"] >= blocks["release"]).all() and (blocks["slot"] < blocks["deadline"]).all()
    shares = pfair.whole_shares(weights)
    first = blocks[blocks["phase"] == 0]
    given = dict.fromkeys(shares, 0)
    for n, s in enumerate(first["source"], 1):
        given[s] += 1
        assert all(abs(given[x] - n * shares[x] / sum(shares.values())) < 1 for x in shares)
    assert len(got) == 3000
    for s, g in got.sort_values("doc_id").groupby("source"):
        assert (g["block"] * 4 + g["place"]).tolist() == list(range(len(g))), s


def test_schedule_follows_the_given_weights():
    """Over many blocks, measured against the weights themselves, also one of less than a two-thousandth."""
    for weights in ({"a": 2.0, "b": 1.0}, {"a": 1.0, "b": 3.0**0.5, "c": 0.1, "d": 1e-4, "e": 7.0}):
        total = sum(map(Fraction, weights.values()))
        share = [float(Fraction(w) / total) for w in weights.values()]
        plan = pfair.phases(dict.fromkeys(weights, 50_000), pfair.whole_shares(weights))[0]
        placed = [[] for _ in weights]
        for at in range(len(plan.given) - 1):
            for k, (first, slots, release, deadline) in enumerate(plan.segment(at).values()):
                assert first == len(placed[k]) and (release <= slots).all() and (slots < deadline).all()
                placed[k] += slots.tolist()
        n = sum(map(len, placed))
        assert n > 60_000 and sorted(x for p in placed for x in p) == list(range(n))
        for k, p in enumerate(placed):
            given = np.cumsum(np.bincount(p, minlength=n))
            assert np.abs(given - np.arange(1, n + 1) * share[k]).max() < 1 + 1e-9


def test_schedule_odd_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "doc_id long, source string")
    assert pfair.schedule(df, {"a": 1.0}).where("slot IS NULL").count() == 2
    assert pfair.mix(df, {"a": 1.0}).count() == 2
    assert pfair.schedule(df.limit(0)).count() == 0


def test_audit_finds_what_was_damaged(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.concat(F.lit("<p>x"), "id"), 20).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))
    one, two = scratch(spark, "a"), scratch(spark, "b")
    index = fixity.write_archives(pages, one, 4)
    assert index.count() == 301
    fixity.rotted_copy(index, one, two, F.coalesce(F.col("page_id").isin(3, 77, 250), F.lit(False)), F.col("file_no") == 2)
    got = {(r["page_id"], r["kind"]) for r in fixity.audit(index, one, two, fanout=4).collect()}
    last = index.where("file_no = 2").orderBy(F.desc("record_no")).first()["page_id"]
    assert got == {(k, "changed") for k in (3, 77, 250) if k != last} | {(last, "missing")}
    assert fixity.audit(index, one, one).count() == 0
    # Only what lies below nodes that differ is read: sound levels under a sound root are never opened.
    sound, same = fixity.tree(fixity.leaves(index, one), 4), fixity.tree(fixity.leaves(index, one), 4)
    same.levels[0] = None
    assert len(sound.levels) > 3
    sound.levels[:-1] = [None] * (len(sound.levels) - 1)
    assert fixity.differing(index, sound, same, 4).count() == 0
    # A leaf that one tree lacks is found too.
    whole, short = fixity.tree(fixity.leaves(index, one), 4), fixity.tree(fixity.leaves(index, one).where("NOT (file_no = 1 AND record_no = 3)"), 4)
    assert [(r["file_no"], r["record_no"], r["kind"]) for r in fixity.differing(index, whole, short, 4).collect()] == [(1, 3, "missing")]
    odd = [(1, "u", "x" * 300_000, "clash"), (1, "u", "x" * 300_000, "clash"), (None, None, None, None)]
    odd = spark.createDataFrame(odd, "page_id long, url string, html string, digest string")
    twice = fixity.write_archives(odd, scratch(spark, "d"), 2)
    assert twice.count() == 3
    none = fixity.write_archives(pages.limit(0), scratch(spark, "c"), 1)
    assert fixity.audit(none, one, two).count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([(k % 7,) for k in range(50)] + [(None,)], "doc_id long")
    got = id_ranges(df, "doc_id", 4)
    spans = got.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("bucket").collect()
    assert spans[0]["bucket"] == -1
    assert all(x["b"] < y["a"] for x, y in zip(spans[1:], spans[2:]))


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["gone", "__id", "__drops", "id", "row", "n_lines", "component_id", "from", "drops", "key"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    wide = wide.unionByName(wide.where("doc_id = 3")).unionByName(wide.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    plain = wide.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        assert out.where(" OR ".join(f"`{n}` <> {k}" for k, n in enumerate(names))).count() == 0, name
        assert sorted(out.select(*docs.columns).collect(), key=str) == sorted(stage(spark, plain, str(tmp_path)).collect(), key=str), name
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "a", 0), (10_002, "", None, None, 0), (10_003, "!!! 123", "en", "a", 7)], docs.schema)
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not {10_001, 10_002, 10_003} & seen[0] and len(seen[0]) >= 0.95 * docs.count()
    for before, after in zip(seen, seen[1:], strict=False):
        assert after <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == seen[-1]
