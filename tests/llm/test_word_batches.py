"""Ids of a block are sent in several batches."""

from quarry.llm import word_table
from quarry.llm.wordids import default_vocabulary


def test_a_block_of_many_words_is_sent_in_parts(spark):
    """op12: no batch holds the ids of a whole block."""
    size = word_table.OUT_WORDS
    texts = ["one two, " * (size // 4 + 7), None, "", "x " * (size + 3), "Three.", "four five " * (size // 3), "six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["ids"] for r in word_table.encode(df).collect()}
    library = word_table._tokenizer(default_vocabulary())
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
