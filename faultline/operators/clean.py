"""Sections of a page: parse, clean, parse again. Spark expressions; a page stays one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import SPACE, normalize_whitespace, should_drop_section, strip, strip_citations

#: A header line: two to six equals signs on both sides of a title.
HEADER = rf"(?md)^(={{2,6}})[{SPACE}]*(.+?)[{SPACE}]*\1[{SPACE}]*$"
SECTION = "struct<section_index:int,section_title:string,section_path:array<string>,level:int,char_start:int,char_end:int,text:string>"


def with_sections(pages: DataFrame, text: str, out: str = "sections") -> DataFrame:
    """Add ``out``, the sections of column ``text``, in order; blank text has none.

    Headers and bodies are found once each, before the fold: an expression that is not compiled, as a fold is
    not, evaluates what it names anew for each mention. They are zipped into one array that the fold runs
    over: a lambda that named them as columns would have them extracted anew for every section.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = settled(pages.withColumns({"_heads": F.regexp_extract_all(t, F.lit(HEADER), F.lit(0)), "_bodies": F.split(t, HEADER, -1)}), "_heads", "_bodies")
    inside = lambda group: F.transform("_heads", lambda h: F.regexp_extract(h, HEADER, group))
    parts = F.arrays_zip(F.col("_heads").alias("head"), inside(1).alias("mark"), inside(2).alias("title"), F.slice("_bodies", F.lit(2), F.size("_bodies")).alias("body"))
    lead = F.get("_bodies", F.lit(0))
    # The fold keeps the offset, the stack of open sections and the sections so far.
    stack_type, out_type = "array<struct<level:int,title:string>>", f"array<{SECTION}>"
    start = F.struct(
        F.length(lead).alias("at"),
        F.array().cast(stack_type).alias("stack"),
        F.when(strip(lead) == "", F.array().cast(out_type)).otherwise(F.array(_lead(lead, F.lit("Lead"))).cast(out_type)).alias("found"),
    )

    def step(acc: Column, p: Column) -> Column:
        level, title = F.length(p["mark"]), strip(p["title"])
        stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < level), F.array(F.struct(level.alias("level"), title.alias("title"))))
        end = acc["at"] + F.length(p["head"]) + F.length(p["body"])
        section = F.struct(
            F.size(acc["found"]).alias("section_index"), title.alias("section_title"), F.transform(stack, lambda s: s["title"]).alias("section_path"),
            level.alias("level"), acc["at"].alias("char_start"), end.alias("char_end"), strip(p["body"]).alias("text"),
        )
        return F.struct(end.alias("at"), stack.cast(stack_type).alias("stack"), F.concat(acc["found"], F.array(section).cast(out_type)).alias("found"))

    return rows.withColumn(out, F.aggregate(parts, start, step, lambda acc: acc["found"])).drop("_heads", "_bodies")


def _lead(body: Column, title: Column) -> Column:
    return F.struct(F.lit(0).alias("section_index"), title.alias("section_title"), F.array(title).alias("section_path"), F.lit(1).alias("level"), F.lit(0).alias("char_start"), F.length(body).alias("char_end"), strip(body).alias("text"))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed once. A filter on a computed column is pushed below the
    projection that computes it, with the whole expression copied for each use; it cannot pass a generator."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_s")).select(*rest, "_s.*")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Add cleaned_text, sections, section_count, char_count: without reference sections, citations and
    empty sections; offsets are those of the cleaned text."""
    df = with_sections(pages, "raw_text", "_raw")
    bodies = F.transform(F.filter("_raw", lambda s: ~should_drop_section(s["section_title"])), lambda s: s.withField("text", normalize_whitespace(strip_citations(s["text"]))))
    mark = lambda s: F.repeat(F.lit("="), F.greatest(s["level"], F.lit(2)))
    part = lambda s: F.when(s["section_title"] == "Lead", s["text"]).otherwise(F.concat(mark(s), F.lit(" "), s["section_title"], F.lit(" "), mark(s), F.lit("\n"), s["text"]))
    df = df.withColumn("_kept", F.filter(bodies, lambda s: s["text"] != ""))
    df = df.withColumn("cleaned_text", normalize_whitespace(F.array_join(F.transform("_kept", part), "\n\n"))).drop("_raw", "_kept")
    df = with_sections(df, "cleaned_text", "_found")
    df = df.withColumn("sections", F.filter("_found", lambda s: ~should_drop_section(s["section_title"]) & (strip(s["text"]) != ""))).drop("_found")
    df = settled(df, "cleaned_text", "sections")
    return df.withColumns({"section_count": F.size("sections"), "char_count": F.length("cleaned_text")})
