"""The index in blocks against scores added up one by one."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted, retrieval, storage


def plain(docs, items, k1=1.2, b=0.75):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    counted = [(d, Counter(words(t))) for d, t in docs]
    n, mean = len(counted), sum(c.total() for _, c in counted) / max(len(counted), 1)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        for d, c in counted:
            met = [w for w in terms if w in c]
            if met:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * c.total() / mean)) for w in met)
                out.append((item, d, s, len(met), len(terms)))
    return out


def tables(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(40))) for _ in range(90)]
    texts += [None, "", "...", "W1, w2; É w3", "w1 " * 3000, texts[3], texts[3], "K İ"]
    docs = [(k, t) for k, t in enumerate(texts)]
    items = [(k, texts[k * 3]) for k in range(12)] + [(3, "w59 w1"), (50, None), (51, "unseen"), (52, "w1 W1 w2"), (None, "w5 k")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, ids string").repartition(3)
    return docs, items, frame, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, terms int")


@pytest.mark.parametrize("block_docs,block_postings,only,queries", [(4096, 1 << 20, True, 4096), (5, 1 << 20, False, 3), (64, 40, True, 1)])
def test_hits(spark, monkeypatch, block_docs, block_postings, only, queries):
    monkeypatch.setattr(inverted, "BLOCK_QUERIES", queries)
    docs, items, frame, asked = tables(spark)
    index = inverted.build(frame, wanted=inverted.wanted_terms(asked) if only else None, block_docs=block_docs, block_postings=block_postings)
    got = {(r["item_id"], r["doc_id"]): (r["bm25"], r["shared"], r["terms"]) for r in inverted.hits(index, asked).collect()}
    want = {(i, d): (s, n, m) for i, d, s, n, m in plain(docs, items)}
    assert got.keys() == want.keys()
    assert all(abs(got[x][0] - want[x][0]) < 2e-6 and got[x][1:] == want[x][1:] for x in want)
    some = inverted.hits(index, asked, 4).collect()
    assert len(some) < len(got) and all(got[r["item_id"], r["doc_id"]] == (r["bm25"], r["shared"], r["terms"]) for r in some)
    best = lambda rows: {i: sorted((-s, d) for j, d, s in rows if j == i)[:4] for i in {r[0] for r in rows}}
    assert best([(r["item_id"], r["doc_id"], r["bm25"]) for r in some]) == best([(i, d, v[0]) for (i, d), v in got.items()])


def test_empty_tables_and_many_terms(spark):
    docs, items, frame, asked = tables(spark)
    assert retrieval.bm25(frame.limit(0), asked).count() == 0
    assert retrieval.bm25(frame, asked.limit(0)).count() == 0
    assert inverted.wanted_terms(asked, most=3) is None
    top = retrieval.bm25(frame, asked, 2).collect()
    assert {r["rank"] for r in top} == {1, 2} and max(Counter(r["item_id"] for r in top).values()) == 2


def test_large_rows_come_alone(spark, monkeypatch):
    """A worker gets few texts and one block at a time, whatever the table's size, and blocks don't end where a batch does."""
    monkeypatch.setattr(inverted, "TEXTS", 2)
    docs = spark.createDataFrame([(k, f"w{k} all") for k in range(10)], "doc_id long, text string").coalesce(1)
    index = inverted.build(docs, block_docs=3)
    assert sorted(len(r["ids"]) for r in index.blocks.collect()) == [1, 3, 3, 3]

    def batch_sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = index.blocks.coalesce(1).select(F.size("ids").alias("n"))
    with storage.batches_of(spark, 1):
        assert [r[0] for r in rows.mapInArrow(batch_sizes, "n int").collect()] == [1] * 4
    assert spark.conf.get(name) == before and [r[0] for r in rows.mapInArrow(batch_sizes, "n int").collect()] == [4]
    asked = spark.createDataFrame([(1, "all w3")], "item_id long, text string")
    found = inverted.hits(index, asked)
    assert found.inputFiles() and {r["doc_id"]: r["shared"] for r in found.collect()} == {k: 1 + (k == 3) for k in range(10)}
