"""Order-dependent chunkers, as vectorised functions that give array<struct> to explode.

Both run on whole texts in one map, without a shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators from the strongest to the weakest.
RECURSIVE_SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ")
SECTION_SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ")
SECTION_MARK = re.compile(r"\n\n<!-- SECTION: (.+?) -->\n")
DEFAULT_SECTION = "正文"
SLACK = 200


def check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("needs size >= 1 and 0 <= overlap < size")


def recursive_pieces(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Greedy merging of a separator's parts while they fit; what doesn't fit goes to the next separator."""
    if len(text) <= size:
        return [text] if text else []
    if level >= len(RECURSIVE_SEPARATORS):
        step = max(1, size - overlap)
        return [text[at : at + size] for at in range(0, len(text), step)]
    mark, out, held = RECURSIVE_SEPARATORS[level], [], ""
    for part in [*text.split(mark), None]:
        joined = None if part is None else held + mark + part if held else part
        if joined is not None and (not held or len(joined) <= size):
            held = joined
            continue
        if held:
            out += recursive_pieces(held, size, overlap, level + 1)
        held = part or ""
    return out


def recursive_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(index, start, end, text); starts are found forward, from `overlap` before the chunk before."""
    text, out, cursor = (text or "").strip(), [], 0
    for i, piece in enumerate(recursive_pieces(text, size, overlap)):
        at = text.find(piece, max(0, cursor - overlap))
        at = cursor if at < 0 else at
        cursor = at + len(piece)
        out.append((i, at, cursor, piece))
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) at section marks; text before the first mark has the default title."""
    parts = SECTION_MARK.split(text)
    if len(parts) == 1:
        return [(DEFAULT_SECTION, text)]
    pairs = [(DEFAULT_SECTION, parts[0]), *zip(parts[1::2], parts[2::2], strict=True)]
    return [(t.strip() or DEFAULT_SECTION, b.strip()) for t, b in pairs if b.strip()]


def section_chunks(text: str, size: int, overlap: int, least: int = 400) -> list[tuple[int, str, str]]:
    """(index, section, text): short sections join the next, long ones are cut at separators near `size`.

    The cut always advances by one character at least, also where the overlap exceeds the cut.
    """
    joined: list[tuple[str, str]] = []
    short: tuple[str, str] | None = None
    for title, body in sections((text or "").strip()):
        if short:
            title, body, long = short[0], f"{short[1]}\n\n{body}", len(body) >= least
        else:
            long = len(body) >= least
        short = None if long else (title, body)
        if long:
            joined.append((title, body))
    if short and short[1]:
        joined.append(short)
    out = []
    for title, body in joined:
        while len(body) > size:
            spots = ((body.rfind(s, max(0, size - SLACK), size + SLACK), s) for s in SECTION_SEPARATORS)
            cut = next((at + len(s) for at, s in spots if at > 0), size)
            out.append((title, body[:cut].strip()))
            body = body[max(1, cut - overlap) :]
        if body.strip():
            out.append((title, body.strip()))
    return [(i, t, b) for i, (t, b) in enumerate(out)]


def recursive(c: Column, size: int = 1600, overlap: int = 300) -> Column:
    check(size, overlap)

    @F.pandas_udf("array<struct<chunk_index:int,char_start:int,char_end:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("chunk_index", "char_start", "char_end", "text")
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in recursive_chunks(t, size, overlap)])

    return run(F.coalesce(c, F.lit("")))


def section_aware(c: Column, size: int = 1600, overlap: int = 300, least: int = 400) -> Column:
    check(size, overlap)
    if least < 1:
        raise ValueError("needs least >= 1")

    @F.pandas_udf("array<struct<chunk_index:int,section:string,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("chunk_index", "section", "text")
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in section_chunks(t, size, overlap, least)])

    return run(F.coalesce(c, F.lit("")))


def chunk(c: Column, strategy: str = "section_aware", size: int = 1600, overlap: int = 300) -> Column:
    """Dispatch by strategy at plan-build time."""
    from factloom.functions.text import chunk_windows

    known = {"fixed_window": chunk_windows, "recursive": recursive, "section_aware": section_aware}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}")
    return known[strategy](c, size, overlap)
