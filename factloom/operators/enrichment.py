"""Enrichment of source texts: tables appended, sections marked and prioritised, entities and consistency by rule."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Entity and consistency patterns.
ORGANISATION, MONEY, DATE = "[一-鿿]{2,20}(?:股份|集团|公司|科技|有限)", r"(?:20\d{2}年)?\s*[\d,.]+\s*(?:亿元|万元|元|%|亿股)", r"20\d{2}年"
NEGATIONS, POSITIVES = ("没有", "未", "不", "下降", "减少", "亏损"), ("增长", "上升", "增加", "盈利", "提高")


def stages(df: DataFrame, steps: list[tuple[Callable[[DataFrame], bool], Callable[[DataFrame], DataFrame]]], failed: list[str] | None = None) -> DataFrame:
    """Apply each step whose condition on the schema holds, in order.

    With `failed` a step whose plan can't be built is left out and its error noted there; without, the error is raised.
    """
    for supported, step in steps:
        if not supported(df):
            continue
        try:
            df = df.transform(step)
        except Exception as e:
            if failed is None:
                raise
            failed.append(f"{type(e).__name__}: {e}"[:300])
    return df


def append_tables(raw: Column, tables: Column, year: Column, unit: Column, most: int = 6) -> Column:
    """Text followed by its year, unit note and first tables as numbered Markdown sections; as it is without tables."""
    if most <= 0:
        return raw
    listed = F.array_join(F.transform(F.slice(tables, 1, most), lambda t, i: F.concat(F.lit("\n## 表格 "), (i + 1).cast("string"), F.lit("\n"), t)), "\n")
    parts = F.concat_ws("\n", raw, F.concat(F.lit("报告年度："), F.coalesce(year, F.lit("未知"))), unit, F.lit("\n\n# 结构化表格"), listed)
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, parts).otherwise(raw)


def mark_sections(text: Column, parsed: Column) -> Column:
    """Section marks before each section's body; bodies that the text lacks are appended with their mark."""

    def mark(text: str, parsed: list[dict]) -> str:
        for s in parsed if parsed is not None else []:
            title, body = s["title"] or "", s["content"] or ""
            if not body.strip():
                continue
            note = f"\n\n<!-- SECTION: {title} -->\n"
            at = text.find(body[:120])
            if at < 0:
                text += note + body
            elif note not in text:
                text = text[:at] + note + text[at:]
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([mark(t, x) for t, x in zip(texts, lists, strict=True)])

    return run(F.coalesce(text, F.lit("")), parsed)


def prioritized(text: Column, weights: dict[str, float], most: int, least: int = 200, lead: int = 800, ratio: int = 5) -> Column:
    """Long texts as their start and their best-scored heading sections, greedily until the first that doesn't fit."""

    def pick(text: str) -> str:
        if len(text) <= most:
            return text
        starts = [m.start() for m in re.finditer(r"(?m)^#{1,3}\s+.+?\s*$", text)]
        if not starts:
            return text[:most]
        spans = list(zip(starts, [*starts[1:], len(text)], strict=True))
        def score(span: tuple[int, int]) -> float:
            hits = ((w, text.count(k, *span)) for k, w in weights.items())
            return sum(w * (1 + 0.1 * min(n, 5)) for w, n in hits if n) + 0.1 * (span[0] == 0)
        out = [text[: max(lead, most // ratio)]]
        used = len(out[0])
        for s, e in sorted(spans, key=score, reverse=True):
            part = text[max(s, used) : e] if s and e > used else ""
            if not part:
                continue
            if used + len(part) > most:
                if most - used > least:
                    out.append(part[: most - used])
                break
            out.append(part)
            used += len(part)
        return "\n\n".join(out)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(pick)

    return run(F.coalesce(text, F.lit("")))


def entities(text: Column) -> Column:
    """array<struct<label, text>> by rule: organisations, amounts, years, each in text order."""
    def labelled(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(found, lambda x: F.struct(F.lit(label).alias("label"), x.alias("text")))

    return F.concat(labelled("ORG", ORGANISATION), labelled("MONEY", MONEY), labelled("DATE", DATE))


def consistency(a: Column, b: Column) -> Column:
    """contradiction if number sets or polarities differ, entailment if equal, else neutral."""
    def numbers(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\d,.]+"), F.lit(0))))

    def any_of(c: Column, words: tuple[str, ...]) -> Column:
        return c.rlike("|".join(words))

    x, y = numbers(a), numbers(b)
    clash = (any_of(a, NEGATIONS) & any_of(b, POSITIVES)) | (any_of(a, POSITIVES) & any_of(b, NEGATIONS))
    return F.when((F.size(x) > 0) & (F.size(y) > 0) & (x != y), "contradiction").when(clash, "contradiction").when(strip(a) == strip(b), "entailment").otherwise("neutral")
