"""Text expressions: Unicode stripping, white space, tokens, chunk windows, Markdown tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: word pattern of queries, chunks and reranking (runs of ideographs, or of ASCII letters and digits).
TOKEN = "[一-鿿]{2,}|[a-zA-Z0-9]{2,}"


def strip(c: Column) -> Column:
    """Unicode strip at both ends; Spark's trim knows only U+0020."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of Unicode white space to one space, ends stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_lines(c: Column) -> Column:
    """White space collapsed in each line, blank lines dropped."""
    lines = F.transform(F.split(c, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def chunk_windows(c: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_index, char_start, char_end, text>>: fixed windows that stop at the first one to reach the end."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("needs size >= 1 and 0 <= overlap < size")
    step = size - overlap
    none = F.array().cast("array<struct<chunk_index:int,char_start:int,char_end:int,text:string>>")

    def spans(text: Column) -> Column:
        # the text is cut once into blocks of a step; a chunk joins the few blocks that it covers, so long texts stay linear
        blocks, n = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), F.length(text)
        last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")

        def chunk(i: Column, parts: Column) -> Column:
            own = F.substring(F.array_join(F.slice(parts, i + 1, F.lit(-(-size // step))), ""), 1, size)
            return F.struct(i.alias("chunk_index"), (i * step).alias("char_start"), F.least(i * step + size, n).alias("char_end"), own.alias("text"))

        return F.when(n > 0, bind(blocks, lambda parts: F.transform(F.sequence(F.lit(0), last), lambda i: chunk(i, parts)))).otherwise(none)

    return bind(strip(F.coalesce(c, F.lit(""))), spans)


def markdown_table(rows: Column) -> Column:
    """Markdown of array<array<string>>: header, rule, rows padded or cut to the header's width; nulls are empty."""
    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))

    width = F.size(rows[0])
    fitted = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), fitted), "\n")).otherwise("")
