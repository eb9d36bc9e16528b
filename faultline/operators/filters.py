"""Page filters in two phases: cheap predicates on the raw page, then those that need it cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import Filtering
from faultline.functions.text import paragraph_repeat_ratio, prose_ratio, strip
from faultline.operators.clean import clean_pages, settled


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    """The names of the checks that hold, in order."""
    named = F.array(*(F.when(check, name) for check, name in checks))
    return F.filter(named, lambda r: r.isNotNull())


def raw_reasons(cfg: Filtering = Filtering(), raw: Column | None = None) -> Column:
    raw = F.col("raw_text") if raw is None else raw
    title, off = F.coalesce(F.col("page_title"), F.lit("")), F.lit(False)
    listed = strip(title).rlike(r"(?iU)^(list of|lists of|index of|outline of)\b")
    return _reasons([
        (F.col("is_redirect") if cfg.exclude_redirects else off, "redirect"),
        (F.col("is_disambiguation") | title.rlike(r"(?i)\(disambiguation\)$") if cfg.exclude_disambiguation else off, "disambiguation"),
        (listed if cfg.exclude_lists else off, "list_page"),
        (title.rlike(r"(?iU)\btimeline\b") if cfg.exclude_timelines else off, "timeline_page"),
        (F.length(F.coalesce(raw, F.lit(""))) < cfg.min_page_chars, "too_short"),
    ])


def decide_pages(pages: DataFrame, cfg: Filtering = Filtering()) -> DataFrame:
    """Every page once, cleaned, with ``rejection_reasons`` (empty if it is accepted), prose_ratio and
    paragraph_repeat_ratio. A page that phase one rejects is not cleaned: its text, sections and ratios
    are null and ``char_count`` is that of its raw text. One scan, no shuffle."""
    raw = F.col("_raw_text")
    first = pages.withColumnRenamed("raw_text", "_raw_text").withColumn("_early", raw_reasons(cfg, raw))
    first = settled(first, "_early")
    early = F.size("_early") > 0
    cleaned = clean_pages(first.withColumn("raw_text", F.when(~early, F.coalesce(raw, F.lit("")))))
    cleaned = cleaned.withColumns({
        "prose_ratio": F.when(~early, prose_ratio(F.col("cleaned_text"))),
        "paragraph_repeat_ratio": F.when(~early, paragraph_repeat_ratio(F.col("cleaned_text"))),
        "char_count": F.when(early, F.length(F.coalesce(raw, F.lit("")))).otherwise(F.col("char_count")),
    })
    late = _reasons([
        (F.col("char_count") < cfg.min_page_chars, "too_short_after_clean"),
        (F.col("section_count") < cfg.min_sections, "insufficient_sections"),
        (F.col("prose_ratio") < cfg.min_prose_ratio, "low_prose_ratio"),
        (F.col("paragraph_repeat_ratio") > cfg.max_paragraph_repeat_ratio, "high_repeat_ratio"),
    ])
    for name in ("cleaned_text", "sections", "section_count"):
        cleaned = cleaned.withColumn(name, F.when(~early, F.col(name)))
    cleaned = settled(cleaned, "prose_ratio", "paragraph_repeat_ratio")
    cleaned = cleaned.withColumn("rejection_reasons", F.when(early, F.col("_early")).otherwise(late))
    return settled(cleaned, "rejection_reasons").drop("raw_text", "_early").withColumnRenamed("_raw_text", "raw_text")


REJECTED = ["page_id", "page_title", "category_group", "rejection_reasons", "char_count", "prose_ratio", "paragraph_repeat_ratio"]


def split_decided(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of decided pages; hold them in a table first if both are read."""
    good = F.size("rejection_reasons") == 0
    return decided.where(good), decided.where(~good).select(*REJECTED)


def filter_pages(pages: DataFrame, cfg: Filtering = Filtering()) -> tuple[DataFrame, DataFrame]:
    return split_decided(decide_pages(pages, cfg))


def reason_counts(rejected: DataFrame, *by: str) -> DataFrame:
    """Pages by rejection reason (a page counts for each of its reasons)."""
    return rejected.select(*by, F.explode("rejection_reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))
