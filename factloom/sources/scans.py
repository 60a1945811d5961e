"""Scans: local documents with front matter, manifests, readable text of pages; and multi-provider union."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import normalize_lines, strip
from factloom.functions.values import LAYERS, host_in, host_of, layer_priority
from factloom.operators.numbering import numbered

#: Boundaries and unread elements of readable text.
BREAKS = frozenset("p br li tr h1 h2 h3".split())
UNREAD = frozenset("script style noscript".split())
#: Types of sources.
SOURCE_TYPES = ("annual_report", "announcement", "official_pdf", "official_disclosure_page", "news", "official_website", "government", "patent", "hiring", "other")


def local_documents(spark: SparkSession, root: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, raw) of every text file below `root`, one row each, ordered by nothing: sort by path where order matters."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(map of keys to values, body); without a closed `---` block the map is empty and the text is the body."""
    head = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    block = F.regexp_extract(raw, head, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    # values may hold further colons, so each line is cut once
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last), F.regexp_replace(raw, head, "")


def coerced(meta: Column) -> dict[str, Column]:
    """Typed fields: unknown types are other, times without a zone are UTC, scores are clamped to 0..1 with 0.8 as default."""
    score = F.try_element_at(meta, F.lit("credibility_score")).try_cast("double")
    kind = F.lower(F.try_element_at(meta, F.lit("source_type")))
    return {
        "title": F.try_element_at(meta, F.lit("title")),
        "url": F.try_element_at(meta, F.lit("url")),
        "source_type": F.when(kind.isin(*SOURCE_TYPES), kind).otherwise("other"),
        "published_at": F.try_to_timestamp(F.try_element_at(meta, F.lit("published_at"))),
        "credibility_score": F.when(score.isNull() | F.isnan(score) | F.abs(score).isin(float("inf")), 0.8).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))),
    }


def parsed_documents(files: DataFrame) -> DataFrame:
    meta, body = front_matter(F.col("raw"))
    staged = files.select("path", meta.alias("meta"), strip(body).alias("raw_content"))
    return staged.select("path", "raw_content", *[c.alias(n) for n, c in coerced(F.col("meta")).items()])


def manifest(spark: SparkSession, path: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a JSON manifest, a list or {"sources": [...]}, whose host is allowed (exactly or as a subdomain)."""
    raw = spark.read.json(path, multiLine=True)
    rows = raw.select(F.explode("sources").alias("s")).select("s.*") if "sources" in raw.columns else raw
    for name, kind in (("title", "string"), ("source_type", "string"), ("credibility_score", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("credibility_score", F.coalesce(F.col("credibility_score").cast("double"), F.lit(0.82)))
    return rows.where(host_in(host_of(F.col("url")), allowed)) if allowed else rows


class _Readable(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.unread = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.unread += tag in UNREAD
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.unread -= tag in UNREAD and self.unread > 0
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.parts.append(data)


def readable_html(c: Column) -> Column:
    """Visible text of a page with line ends at block boundaries."""

    def read(html: str) -> str:
        parser = _Readable()
        parser.feed(html)
        parser.close()
        return "".join(parser.parts)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(read)

    return normalize_lines(run(F.coalesce(c, F.lit(""))))


def source_key(url: Column, title: Column, content: Column) -> Column:
    """Identity of a source: its URL, else its title and content length."""
    cleaned = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return F.when(cleaned != "", cleaned).otherwise(F.concat_ws(":", F.coalesce(title, F.lit("")), F.length(F.coalesce(content, F.lit(""))).cast("string")))


def union_providers(providers: list[DataFrame]) -> DataFrame:
    """All providers' (url, title, content, layer, credibility, pos), the first of each source key by provider and position.

    The minimum per key is a grouped minimum with map-side combining, so a URL that every provider returns doesn't skew.
    """
    parts = [p.select("url", "title", "content", "layer", "credibility", F.lit(i).alias("provider"), "pos") for i, p in enumerate(providers)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("key", source_key(F.col("url"), F.col("title"), F.col("content")))
    firsts = rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), F.struct("provider", "pos")).alias("x"))
    return firsts.select("key", "x.*").withColumn("priority", layer_priority(F.col("layer")))


def focus_windows(c: Column, words: tuple[str, ...], most: int = 20_000, head: int = 3000, before: int = 2600, after: int = 5200) -> Column:
    """Long texts cut to their head and to windows round keywords in priority order, until the budget is used."""

    def focus(text: str) -> str:
        if len(text) <= most:
            return text
        spans, used = [(0, min(head, len(text)))], min(head, len(text))
        for w in words:
            at = text.find(w)
            while at >= 0 and used < most:
                s, e = max(0, at - before), min(len(text), at + after)
                if not any(s < y and x < e for x, y in spans):
                    e = min(e, s + most - used)
                    spans.append((s, e))
                    used += e - s
                at = text.find(w, max(e, at + len(w)))
        return "\n\n".join(text[s:e].strip() for s, e in sorted(spans))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(focus)

    return run(F.coalesce(c, F.lit("")))


def ranked_announcements(catalog: DataFrame, years: tuple[int, ...] = (), strict: bool = False, top: int | None = None) -> DataFrame:
    """Primary annual and half-year reports of a catalog (url, title, published), one per URL, in the order they are read; the first `top` of them."""
    title = F.col("title")
    rows = catalog.where(title.rlike("年度报告|半年度报告") & ~title.rlike("摘要|英文|取消|更正"))
    rows = rows.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), F.struct("published", "title")).alias("x")).select("url", "x.*")
    year = F.regexp_extract(title, r"(20\d{2})", 1).try_cast("int")
    if years and strict:
        rows = rows.where(year.isNull() | year.isin(*years))
    preferred = F.coalesce(year.isin(*years), F.lit(False)) if years else F.lit(False)
    order = [F.desc(preferred), F.contains(title, F.lit("半年度")).asc(), F.desc("published"), F.asc("url")]
    if top is not None:
        rows = rows.orderBy(*order).limit(top)  # each task keeps its own top rows
    return numbered(rows, order, "rank")


LAYER_NAMES = tuple(LAYERS)


#: Pages of no use, and words that evidence about a company has.
BLOCKED = ("考试题", "试卷", "题库", "培训", "课程", "论文下载", "问卷", "问答社区", "面试题", "interview")
EVIDENCE = (
    "年报", "年度报告", "半年报", "季报", "研发", "研发费用", "研发投入", "营收", "营业收入", "净利润", "经营风险", "风险因素", "财务", "业绩", "公告", "投资者关系", "监管", "交易所", "企业信息", "企业信用", "工商",
    "经营范围", "法定代表人", "注册资本", "成立日期", "统一社会信用代码", "公司简介", "公司介绍", "主营", "主要业务", "业务板块", "产品", "服务",
)


def references(raw: Column) -> Column:
    """Flat array of {title, url, content, type} from a search response's JSON, nested or not."""
    item = "struct<title:string,url:string,content:string,type:string>"
    parsed = F.from_json(raw, f"struct<references:array<{item}>,search_results:array<{item}>>")
    none = F.array().cast(f"array<{item}>")
    return F.concat(F.coalesce(parsed["references"], none), F.coalesce(parsed["search_results"], none))


def relevant(company: str, title: Column, url: Column, content: Column) -> Column:
    """Names the company and holds evidence words (which official hosts needn't), and isn't a blocked kind of page."""
    from factloom.functions.values import AUTHORITATIVE

    # compatibility forms matter for full-width letters and digits only; translate covers them without Python
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    text = F.lower(F.translate(F.concat_ws("\n", title, url, F.substring(content, 1, 2000)), wide, narrow))
    name = company.translate(str.maketrans(wide, narrow)).lower()
    compact = "".join(c for c in name if c.isalnum())
    named = F.contains(text, F.lit(name)) | F.contains(F.regexp_replace(text, r"(?U)[\W_]+", ""), F.lit(compact)) if compact else F.lit(False)
    evident = text.rlike("|".join(EVIDENCE)) | host_in(host_of(url), AUTHORITATIVE)
    return ~text.rlike("|".join(BLOCKED)) & named & evident


#: Titles, paths and figures of the made sources.
MOCK_SCORE = 0.61
MOCK = (
    ("非真实年度报告", "placeholder-annual-report", "2024-04-25", "MOCK演示指标：2024年营收为100亿元，2024年净利润为10亿元，2024年研发投入为5亿元；"),
    ("非真实公告", "placeholder-announcement", "2024-08-02", "MOCK演示指标：2024年营收为120亿元，2024年净利润为8亿元。"),
    ("非真实新闻", "placeholder-news", "2025-01-10", "MOCK演示指标：2024年研发投入为5亿元。"),
)


def mock_sources(companies: DataFrame, name: str = "company") -> DataFrame:
    """Three made sources per company, for runs without a network; their texts hold the figures alone, not the notices round them."""
    c = F.col(name)
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.concat(F.lit("[MOCK 演示占位] "), c, F.lit(f" - {title}")).alias("title"), F.concat(F.lit("mock://local/"), c, F.lit(f"/{path}")).alias("url"),
            F.lit("other").alias("source_type"), F.lit(day).cast("date").alias("published_at"), F.lit(text).alias("raw_content"), F.lit(MOCK_SCORE).alias("credibility"),
        )
        for i, (title, path, day, text) in enumerate(MOCK)
    ])
    return companies.select(name, F.explode(rows).alias("s")).select(name, "s.*")


def merged_text(snippet: Column, body: Column) -> Column:
    """A reference's text: its body, after the snippet where the body doesn't hold it."""
    s, b = normalize_lines(F.coalesce(snippet, F.lit(""))), normalize_lines(F.coalesce(body, F.lit("")))
    return F.when((s != "") & (b != "") & ~F.contains(b, s), F.concat(s, F.lit("\n\n"), b)).when(b != "", b).otherwise(s)


def sources_of_references(refs: DataFrame, company: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(title, url, source_type, layer, credibility, raw_content, fetched, pos) of (title, url, content, body, type, pos), best first by `rank`.

    The first of each URL counts; other hosts than the allowed ones and irrelevant texts go. Without a title: a fixed one.
    """
    from factloom.functions.values import credibility, source_layer, source_type

    rows = refs.where("coalesce(url, '') <> ''").withColumn("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("百度 AI 搜索引用"))
    rows = rows.where(host_in(host_of(F.col("url")), allowed)) if allowed else rows
    one = rows.groupBy("url").agg(F.min_by(F.struct("title", "content", "body", "type", "pos"), "pos").alias("x")).select("url", "x.*")
    one = one.withColumn("raw_content", merged_text(F.col("content"), F.col("body")))
    one = one.where(F.col("raw_content") != "").where(relevant(company, F.col("title"), F.col("url"), F.col("raw_content")))
    return one.select(
        "title", "url", source_type(F.col("title"), F.col("url"), F.col("type")).alias("source_type"), source_layer(F.col("title"), F.col("url")).alias("layer"),
        credibility(F.col("title"), F.col("url")).alias("credibility"), "raw_content", (F.coalesce("body", F.lit("")) != "").alias("fetched"), "pos",
    )


def company_code(companies: DataFrame, asked: str) -> DataFrame:
    """(code, name, exchange) of the listed company meant: code or name equal, else a name that holds the words or lies in them."""
    name = F.col("name")
    fit = F.when((F.col("code") == asked) | (name == asked), 0).when(F.contains(name, F.lit(asked)) | F.contains(F.lit(asked), name), 1)
    exchange = F.when(F.substring("code", 1, 1).isin("6", "9"), "sse").when(F.substring("code", 1, 1).isin("4", "8"), "bse").otherwise("szse")
    return companies.withColumn("fit", fit).where("fit IS NOT NULL").orderBy("fit", "code").limit(1).select("code", "name", exchange.alias("exchange"))
