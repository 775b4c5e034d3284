"""Vector codes, the table of distinct words and the treap search against plain versions."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import queries, treap, vector_codes, word_table
from quarry.llm.wordids import default_vocabulary

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, code string"


def plain_codes(rows, width, parts=8, entries=16, rounds=6):
    """rows: (id, vector) of the kept ones. Codes, errors and codebooks in Python integers, part by part."""
    size = width // parts
    ints = [(i, [math.floor(4096 * x) for x in v] + [0] * (width - len(v))) for i, v in rows]
    books = [[v[p * size : (p + 1) * size] for _, v in sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for p in range(parts)]

    def nearest(p, v):
        part = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [(nearest(p, v)[1], v[p * size : (p + 1) * size]) for _, v in ints]
            for e in range(len(books[p])):
                mine = [v for k, v in chosen if k == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, "".join(f"{nearest(p, v)[1]:02x}" for p in range(parts)), sum(nearest(p, v)[0] for p in range(parts))) for i, v in ints]
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), k % 3 if k % 5 else None, "clash") for k in range(120)]
    rows += [(k, rows[7][1], 1, "") for k in range(500, 560)] + [(7, rows[8][1], 1, ""), (7, rows[7][1], 1, ""), (None, rows[3][1], None, None)]
    rows += [(600, [0.5] * 11, 2, ""), (601, [9.5] * 16, 2, ""), (602, [], 0, "")]
    odd = [(900, None, 1, ""), (901, [float("nan")] * 16, 1, ""), (902, [None] + [0.1] * 15, 1, ""), (903, [float("inf")] + [0.1] * 15, 1, "")]
    df = spark.createDataFrame(rows + odd, VECTORS)
    codes = vector_codes.learn(df)
    got = vector_codes.with_group_error(vector_codes.encode(codes, df), "label")
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    want, digest = plain_codes([(i, v) for i, v, _, _ in rows], 16)
    got = got.collect()
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in got) == Counter(want)
    assert codes.digest() == digest
    sums = Counter()
    for (_, _, label, _), (_, _, error) in zip(rows, want, strict=True):
        sums[label] += error
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_few_none_and_huge_vectors(spark):
    few = spark.createDataFrame([(2, [1e30, -1e30, 0.1], 0, ""), (1, [0.0, 0.2, -0.1], 0, "")], VECTORS)
    got = {r["vec_id"]: r for r in vector_codes.encode(vector_codes.learn(few), few).collect()}
    assert {k: (r["code"], r["error"]) for k, r in got.items()} == {1: ("00" * 8, 0), 2: ("010101" + "00" * 5, 0)}
    far = vector_codes.learn(few, entries=1, rounds=0)
    assert {r["vec_id"]: r["error"] for r in vector_codes.encode(far, few).collect()}[2] > 1 << 54
    assert vector_codes.learn(few.limit(0)) is None
    assert vector_codes.learn(few.withColumn("embedding", F.lit(None).cast("array<float>"))) is None


TEXTS = [
    "", None, "   \n\t ", "Hello, World... <|endoftext|>! it's x'. don't. 12,5 <|ENDOFTEXT|> a<|startoftext|>b, 中文。😀!", "Ȧİ H̱ T̈, École. école: näive İstanbul ΣΣ. K µm, ǅ,",
    "a\u0000b, ẍ, ,̈ a,̈ ..., !? a!? ﷺ 한국어, 한", "x" * 50_000 + ".", "\u0085a\u0085,b   c d​e", "the cat " * 20_000, "the cat. The CAT, the cat", "the cat. The CAT, the cat",
    "".join(chr(k) for k in range(1, 0x600)), " ".join(chr(k) + "," for k in range(0x21, 0x400)), "'s 're x's, y'll. '", "a.b,c;d. e.. f.,",
]


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_words_give_the_ids_of_the_library(spark, block_bytes):
    rows = [(k if k != 4 else None, t, "clash", "other") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, words string")
    coded = word_table.encode(df, block_bytes=block_bytes)
    assert coded.columns == ["doc_id", "words", "ids"]
    got = Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in word_table.decode(coded).collect())
    library = word_table._tokenizer(default_vocabulary())
    want = Counter()
    for k, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert word_table.decode(word_table.encode(df.limit(0))).count() == 0


def test_each_distinct_word_is_encoded_once(spark, tmp_path):
    """The library is asked for a word in one task alone, and only once there, whatever the number of blocks and parts."""
    df = spark.createDataFrame([(b, f"one, two three word{b % 7} " * 3) for b in range(60)], "id long, text string")
    blocks = word_table.in_blocks(df, "text", 100)
    assert blocks.count() > 20
    dealt = word_table.deal_words(blocks, 5)
    seen = [(r["part"], w) for r in dealt.collect() for w in set(zstandard.ZstdDecompressor().decompress(r["words"]).split(b"\n"))]
    assert {w for _, w in seen} - {b""} == {b"one", b",", b"two", b"three", *(b"word%d" % k for k in range(7))}
    assert len(set(seen)) == len({w for _, w in seen}) < len(seen)
    asked = []

    class Library:
        def encode_batch_fast(self, words, add_special_tokens):
            asked.extend(words)
            return real.encode_batch_fast(words, add_special_tokens=add_special_tokens)

    real, kept = word_table._tokenizer(default_vocabulary()), word_table._tokenizer
    word_table._tokenizer = lambda path: Library()
    try:
        rows = [pa.RecordBatch.from_pylist([{k: r[k] for k in ("part", "block", "places", "words")}]) for r in dealt.collect()]

        class Dealt:
            def mapInArrow(self, run, schema):
                return list(run(iter(rows)))

        assert word_table.encode_words(Dealt(), default_vocabulary())
    finally:
        word_table._tokenizer = kept
    assert len(asked) == len(set(asked)) and len(set(asked) - {""}) == 11


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [320, -1, 10**6, 320, 49407]), (2, []), (3, None)], "id long, ids array<int>")
    library = word_table._tokenizer(default_vocabulary())
    piece = library.id_to_token(320)
    assert {r["id"]: r["text"] for r in word_table.decode(df).collect()} == {1: f"{piece} {piece} <|endoftext|>", 2: "", 3: None}


def test_query_of_words_on_whole_table(spark):
    got = {r["doc_id"]: r for r in queries.op12_word_table(spark, FOLDER).collect()}
    library = word_table._tokenizer(default_vocabulary())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_treaps_hold_and_find_every_cell():
    rng = np.random.default_rng(0)
    for _ in range(60):
        high, wide = rng.integers(1, 60, 2)
        n = int(rng.integers(1, high * wide + 1))
        cells = rng.choice(high * wide, n, replace=False)
        rows, columns, values = cells // wide, cells % wide, rng.integers(1, 8, n)
        made = treap.Treap.of(rows, columns, values, int(max(high, wide) - 1).bit_length())
        packed = made.packed()
        again = treap.Treap.unpacked(**packed)
        assert len(made.masks) == n and sum(packed["levels"]) == n
        assert all((getattr(made, f) == getattr(again, f)).all() for f in ("masks", "values", "rows", "columns", "first"))
        assert sorted(zip(again.rows, again.columns, again.values, strict=True)) == sorted(zip(rows, columns, values, strict=True))
        grid = np.zeros((high, wide), np.int64)
        grid[rows, columns] = values
        asked = rng.choice(high, min(high, int(rng.integers(1, 9))), replace=False)
        weights = rng.integers(1, 5, len(asked))
        scores = weights @ grid[asked]
        want = sorted((-s, c) for c, s in enumerate(scores.tolist()) if s > 0)
        for k, least in ((10, 1), (3, 1), (10, int(scores.max()) if scores.max() else 1)):
            assert treap.best_columns(again, asked, weights, k, least, 4) == [(-s, c) for s, c in want if -s >= least][:k]


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 10 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_docs,shard_postings,block_items", [(1 << 14, 1 << 22, 1024), (16, 1 << 22, 3), (64, 50, 1024)])
def test_search_of_odd_tables(spark, shard_docs, shard_postings, block_items):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{int(k)}" for k in rng.integers(0, 60, 80)] + ["É", "中文", "x y", "a\u0085b"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(150)]
    texts += [None, "", " .,;!", "ONE one-One_one", texts[3], texts[3], texts[3], "w1 " * 5000, "É é", "\x00w2\x7fw3"]
    docs = [(k if k % 17 else None, t) for k, t in enumerate(texts)] + [(5, texts[9]), (5, texts[10])]
    items = [(k, t) for k, t in enumerate(texts[:12])] + [(3, texts[3]), (3, "w5"), (None, "w1 w2 One"), (77, None), (78, "unseen"), (79, " w1, W1 é 中文 ")]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, score string")
    index = treap.build(frame, shard_docs, shard_postings)
    got = treap.search(index, asked, block_items=block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(docs, items, 10))
    assert treap.search(treap.build(frame.limit(0)), asked).count() == 0
    assert treap.search(index, asked.limit(0)).count() == 0


def test_treap_writers_hold_few_shards(spark, monkeypatch):
    """shards are written as they come, not 100 of them at once, and no batch of many goes to a worker after search() ends."""
    monkeypatch.setattr(treap, "GROUP_BYTES", 1)
    docs = spark.createDataFrame([(k, f"a b{k % 7} c{k}") for k in range(60)], "doc_id long, text string").coalesce(1)
    index = treap.build(docs, 4, 1000)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")) for f in index.shards.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == sum(f.metadata.num_row_groups for f in files) == 15
    found = treap.search(index, spark.createDataFrame([(1, "b3 a")], "item_id long, text string"))
    assert any("/best-" in f for f in found.inputFiles()) and found.count() == 10


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_treap"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert df.columns == columns
    assert Counter(map(tuple, df.collect())) == Counter(want.fetchall())
