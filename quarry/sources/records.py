"""Sources and sinks: text files, JSON lines, page cards, payload adapters, manifests."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """path, text, error of .txt and .md files: UTF-8 with or without a mark at its start."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(~kind.isin("txt", "md"), "unsupported").when(F.col("length") > most_bytes, "too_large").when(F.expr("substring(content, 1, 4) = X'25504446'"), "not_text")
    return raw.select("path", F.when(error.isNull(), F.regexp_replace(text, "^﻿", "")).alias("text"), error.alias("error"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, broken ones kept in _error."""
    return spark.read.schema(f"{schema}, _error string").option("columnNameOfCorruptRecord", "_error").json(path)


def first_json(payload: Column, *paths: str) -> Column:
    """The first path of a JSON payload that holds something."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


def adapted(rows: DataFrame, payload: str, fields: dict[str, tuple[str, ...]], source: str) -> DataFrame:
    """A neutral record from a source's payload: each field from the first of its paths."""
    return rows.select(F.lit(source).alias("source"), *[first_json(F.col(payload), *paths).alias(name) for name, paths in fields.items()])


def union_sources(sources: dict[str, DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources, one for each key; health by source)."""
    out = None
    for name, d in sources.items():
        d = d.withColumn("platform", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.dropDuplicates(key), out.groupBy("platform").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*key).alias("keys"))


class _Cards(HTMLParser):
    def __init__(self, word: str, base: str):
        super().__init__(convert_charrefs=True)
        self.word, self.base, self.depth, self.cards, self.now = word, base, 0, [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.now is not None:
            self.depth += tag not in ("br", "img", "hr", "input", "meta", "link")
            if tag == "a" and not self.now["url"]:
                self.now["url"] = urljoin(self.base, a.get("href") or "")
        elif self.word in (a.get("class") or "").split():
            self.now, self.depth = {"url": urljoin(self.base, a["href"]) if tag == "a" and a.get("href") else "", "text": []}, 1

    def handle_endtag(self, tag):
        if self.now is not None and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1
            if self.depth <= 0:
                self.cards.append(self.now)
                self.now = None

    def handle_data(self, data):
        if self.now is not None and data.strip():
            self.now["text"].append(" ".join(data.split()))


def cards(pages: DataFrame, word: str) -> DataFrame:
    """page_id, card_no, link, title of the elements of a class, by a table function over each page."""

    @F.udtf(returnType="card_no int, link string, title string")
    class Cards:
        def eval(self, html: str, base: str):
            parser = _Cards(word, base or "")
            parser.feed(html or "")
            for k, c in enumerate(parser.cards):
                yield k, c["url"], " ".join(c["text"])

    spark = pages.sparkSession
    spark.udtf.register("page_cards", Cards)
    pages.createOrReplaceTempView("__pages")
    return spark.sql("SELECT p.page_id, c.* FROM __pages p, LATERAL page_cards(p.html, p.url) c")


def canonical_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def manifest(df: DataFrame) -> DataFrame:
    """rows and a digest of a table that doesn't depend on its order: hashes of rows, summed by their parts."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    sums = df.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"p{k}").alias(f"s{k}") for k in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("string") for k in range(8)]), 256).alias("digest"))


def frozen(docs: DataFrame, key: str, text: str, least: int = 120) -> DataFrame:
    """Squeezed texts of at least `least` characters, one for each content hash."""
    squeezed = docs.select(key, F.trim(F.regexp_replace(F.col(text), r"\s+", " ")).alias("content")).where(F.length("content") >= least)
    hashed = squeezed.withColumn("content_sha256", F.sha2("content", 256))
    return hashed.groupBy("content_sha256").agg(F.min(F.struct(key, "content")).alias("r")).select("r.*", "content_sha256")
