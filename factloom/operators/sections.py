"""Structure of annual reports from their lines: sections, header fields, and the text that enriches a source.

A line's section is the last heading before it. Lines fall into blocks; the last heading of a block is carried to the next one
over the blocks alone, and inside a block over its lines, so a huge report is many small sorts instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Headings, report year, auditor, unit notes by preference, the title before the first heading, and limits of what enriches a source.
HEADING = "^(第[一二三四五六七八九十]+节|[一二三四五六七八九十]+、)\\s*(.+)$"
YEAR, AUDITOR = "(20\\d{2})\\s*年(?:度|报)", "审计机构[：:]\\s*(.+)"
UNITS = ("单位[：:]\\s*万元", "单位[：:]\\s*亿元", "单位[：:]\\s*元")
BODY, MOST_SECTIONS, MOST_CHARS, MOST_TABLES = "正文", 12, 4000, 6
PARSED, UNKNOWN = "\n\n# 财报结构化解析\n报告年度：", "未知"
BLOCK = 4096


def report_lines(reports: DataFrame, by: str, text_col: str) -> DataFrame:
    """(by, line_no, line) of whole texts."""
    return reports.select(by, F.posexplode(F.split(F.col(text_col), "\r\n|[\n\r]")).alias("line_no", "line"))


def _carried(rows: DataFrame, by: str, value: Column, block: int) -> Column:
    """The last non-null `value` (an ordered struct that starts with line_no) at or before each line; rows have `_last` of earlier blocks."""
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(by, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(inside, F.col("_last"))


def section_lines(lines: DataFrame, by: str = "report_id", block: int = BLOCK) -> DataFrame:
    """(by, start, title, line_no, line): each line but headings with its section; `start` is the heading's line, -1 before the first."""
    clean = strip(F.col("line"))
    found = F.when(clean.rlike(HEADING), F.struct(F.col("line_no").cast("long").alias("start"), strip(F.regexp_extract(clean, HEADING, 2)).alias("title")))
    rows = lines.withColumns({"_block": F.floor(F.col("line_no") / block), "_head": found})
    ends = rows.groupBy(by, "_block").agg(F.max("_head").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(by, "_block", before.alias("_last"))
    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(BODY).alias("title"))
    placed = rows.join(ends, [by, "_block"]).withColumn("_own", F.coalesce(_carried(rows, by, F.col("_head"), block), none))
    return placed.where("_head IS NULL").select(by, "_own.start", "_own.title", "line_no", "line")


def section_texts(lines: DataFrame, by: str = "report_id", most: int | None = None, chars: int | None = None, block: int = BLOCK) -> DataFrame:
    """(by, section_no, title, content) of sections with lines; the first `most` of a report, the first `chars` characters of each.

    Lines that start beyond `chars` are left out by a running length of two levels before any section is put together; one that
    starts just there stays, as the line break before it is the last character.
    """
    rows = section_lines(lines, by, block)
    firsts = rows.groupBy(by, "start", "title").agg(F.count(F.lit(1)).alias("n_lines"))
    numbered = firsts.withColumn("section_no", F.row_number().over(Window.partitionBy(by).orderBy("start")))
    if most is not None:
        numbered = numbered.where(F.col("section_no") <= most)
    rows = rows.join(numbered.select(by, "start", "section_no"), [by, "start"])
    if chars is not None:
        rows = rows.withColumn("_block", F.floor(F.col("line_no") / block))
        size = F.length("line") + 1
        sums = rows.groupBy(by, "start", "_block").agg(F.sum(size).alias("_sum"))
        upto = F.coalesce(F.sum("_sum").over(Window.partitionBy(by, "start").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.coalesce(F.sum(size).over(Window.partitionBy(by, "start", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(sums.select(by, "start", "_block", upto.alias("_upto")), [by, "start", "_block"]).withColumn("_at", F.col("_upto") + inside).where(F.col("_at") <= chars)
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    content = F.array_join(F.transform(listed, lambda x: F.coalesce(x["line"], F.lit(""))), "\n")
    return rows.groupBy(by, "section_no", "title").agg((content if chars is None else F.substring(content, 1, chars)).alias("content"))


def report_header(reports: DataFrame, by: str, text_col: str) -> DataFrame:
    """(by, year, auditor, unit_note): the first of each in the whole text, null where there is none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = lambda pattern, group: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))
    return reports.select(by, first(YEAR, 1).alias("year"), strip(first(AUDITOR, 1)).alias("auditor"), F.coalesce(*[first(u, 0) for u in UNITS]).alias("unit_note"))


def enriched_text(sources: DataFrame, by: str, raw_col: str, parsed_col: str, tables: DataFrame | None = None) -> DataFrame:
    """(by, text): the raw text followed by what a parsed report adds: year, unit, first sections and first Markdown tables.

    Sources without a parsed text keep their raw one. `tables`: (by, table_no, markdown).
    """
    parsed = sources.where(F.col(parsed_col).isNotNull())
    texts = section_texts(report_lines(parsed, by, parsed_col), by, MOST_SECTIONS, MOST_CHARS)
    part = F.struct("section_no", F.concat(F.lit("\n## "), F.col("title"), F.lit("\n"), F.col("content")).alias("part"))
    listed = texts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]).alias("sections"))
    met = sources.join(report_header(parsed, by, parsed_col), by, "left").join(listed, by, "left")
    none = F.array().cast("array<string>")
    shown = none
    if tables is not None:
        first = tables.where(F.col("markdown") != "").withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("table_no"))).where(F.col("r") <= MOST_TABLES)
        met = met.join(first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("\n"), F.col("markdown")).alias("part")))), lambda x: x["part"]).alias("tables")), by, "left")
        shown = F.coalesce("tables", none)
    head = F.array_compact(F.array(F.coalesce(F.col(raw_col), F.lit("")), F.concat(F.lit(PARSED), F.coalesce("year", F.lit(UNKNOWN))), F.col("unit_note")))
    whole = F.array_join(F.concat(head, F.coalesce("sections", none), shown), "\n")
    return met.select(by, F.when(F.col(parsed_col).isNull(), F.col(raw_col)).otherwise(whole).alias("text"))
