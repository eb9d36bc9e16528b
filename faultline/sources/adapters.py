"""Adapters from the tables at hand to the page schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import normalize_title, strip


#: Bytes a core may read as they lie. A smaller table is dealt to all cores: it may lie in one row group,
#: which one task reads. A larger one is never shuffled for this.
CORE_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some columns of it, in enough partitions to keep all cores busy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1_000_000 < size < cores * CORE_BYTES else df


def corpus_pages(documents: DataFrame) -> DataFrame:
    """Pages of documents: lines become paragraphs, a section opens before every fourth line."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    head = lambda i: F.when((i > 0) & (i % 4 == 0), F.concat(F.lit("== Section "), F.floor(i / 4).cast("string"), F.lit(" ==\n\n"))).otherwise("")
    raw = F.array_join(F.transform(lines, lambda line, i: F.concat(head(i), line)), "\n\n")
    return documents.select(
        F.col("doc_id").cast("long").alias("page_id"),
        F.lit(1).cast("long").alias("revision_id"),
        F.array_join(F.slice(F.split(F.get(lines, F.lit(0)), " "), 1, 3), " ").alias("page_title"),
        F.array("source").alias("categories"),
        F.col("lang").alias("category_group"),
        raw.alias("raw_text"),
        F.lit(False).alias("is_redirect"),
        F.lit(None).cast("string").alias("redirect_target"),
        F.lit(False).alias("is_disambiguation"),
    )


def web_pages(pages: DataFrame) -> DataFrame:
    """Pages of html: headings become section headers, paragraphs stay, other markup goes."""
    drop = r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>|<div class=\"ad\">.*?</div>"
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), drop, " ")
    text = F.regexp_replace(text, r"(?is)<h1[^>]*>(.*?)</h1\s*>", "\n\n== $1 ==\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?p\b[^>]*>", "\n\n"), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select(
        F.col("page_id").cast("long"),
        F.lit(1).cast("long").alias("revision_id"),
        title.alias("page_title"),
        F.array().cast("array<string>").alias("categories"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1).alias("category_group"),
        strip(text).alias("raw_text"),
        F.lit(False).alias("is_redirect"),
        F.lit(None).cast("string").alias("redirect_target"),
        F.lit(False).alias("is_disambiguation"),
    )


def title_key(title: Column) -> Column:
    return normalize_title(F.coalesce(title, F.lit("")))
