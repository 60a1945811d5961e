"""Question understanding, fact selection, grounding and citations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.text import strip
from factloom.operators.numbering import numbered

#: Metric families as (id, base metrics, words of questions, words of claims, preferred metric).
FAMILIES = (
    ("rd", ("r&d", "rd", "r_and_d", "research_development", "R&D_expenditure", "R&D_total_spending"), ("研发", "r&d", "rd", "research", "研发费用", "研发投入"), ("研发", "研究开发", "研发费用", "研发投入"), "R&D_total_spending"),
    ("profit", ("profit", "net_profit", "net_profit_parent", "net_profit_deducted"), ("利润", "净利润", "归母", "profit"), ("利润", "净利润", "归母", "扣非"), "net_profit_parent"),
    ("revenue", ("revenue", "operating_revenue", "sales_revenue"), ("收入", "营收", "营业收入", "revenue"), ("收入", "营收", "营业收入"), "revenue"),
    ("revenue_structure", ("revenue_segment", "segment_revenue"), ("收入结构", "营收结构", "分业务", "业务结构", "收入构成"), ("收入结构", "分业务", "分产品", "构成"), "revenue_segment"),
    ("capacity", ("production_capacity", "production_volume", "sales_volume", "capacity"), ("产能", "扩张", "产量", "销量", "capacity", "production"), ("产能", "产量", "销量", "交付量"), "production_capacity"),
    ("business", ("business", "industry", "operation_scope"), ("主要业务", "主营业务", "业务板块", "业务范围", "具体业务", "经营范围", "产品服务", "business"), ("主营", "业务", "经营范围", "产品", "服务"), "business"),
    ("risk", ("risk", "uncertainty"), ("风险", "不确定", "risk"), ("风险", "不确定", "波动"), "risk"),
)
#: Terms that no excerpt may hold, and their replacement.
FORBIDDEN = ("买入", "卖出", "加仓", "减仓", "目标价", "收益承诺", "个股推荐", "适合你购买")
REDACTION = "【已移除】"
CHINESE_DIGITS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def families(question: Column) -> Column:
    """Ids of the families that a question names; revenue structure suppresses revenue."""
    text = F.lower(F.coalesce(question, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(text, F.lit(w.lower())) for w in words], F.lit(False)), F.lit(name)) for name, _, words, _, _ in FAMILIES]))
    return F.when(F.array_contains(found, "revenue_structure"), F.array_remove(found, "revenue")).otherwise(found)


def in_families(metric: Column, claim: Column, wanted: Column) -> Column:
    """Whether a fact belongs to one of the wanted families; none wanted: always."""
    m, c = F.lower(F.coalesce(metric, F.lit(""))), F.lower(F.coalesce(claim, F.lit("")))
    out = F.size(wanted) == 0
    for name, bases, _, words, _ in FAMILIES:
        named = F.lit(False)
        for w in (*bases, *words):
            named = named | F.contains(m, F.lit(w.lower())) | F.contains(c, F.lit(w.lower()))
        out = out | (F.array_contains(wanted, name) & named)
    return out


@dataclass(frozen=True)
class TimeScope:
    """Explicit years, a window of recent years, and whether other years are excluded."""

    years: tuple[int, ...]
    window: int | None
    strict: bool

    def preferred(self, as_of: int) -> tuple[int, ...]:
        """Explicit years, else the last completed years."""
        return self.years or tuple(range(as_of - 1, as_of - 1 - (self.window or 0), -1))


#: Phrases for one year, for this year, of exclusion, of comparison, and of exclusion beside a window of one year.
ONE_YEAR = "近一年|过去一年|过去1年|最近一年|上年|去年|当期|本报告期|最新(?:一期|财报|年报)|今年|本年度|当年"
ONLY, COMPARING = "仅|只要|仅限|只看|专门|单独|不要其他年份", "对比|比较|变化|趋势|逐年|历年|各年|多年"
NOT_MANY = "不要.*(?:多年|历年)"


def time_scope(question: str) -> TimeScope | None:
    """Scope of a question, or None if it names no time. Years that a question names exclude others unless it compares or names over two."""
    text = question.replace(" ", "")
    years = tuple(dict.fromkeys(int(y) for y in re.findall(r"20\d{2}", text)))
    counted = re.search(r"近(\d{1,2})年", text) or re.search(f"近([{''.join(CHINESE_DIGITS)}])年", text)
    window = None
    if counted:
        window = CHINESE_DIGITS.get(counted[1]) or int(counted[1])
    elif re.search(ONE_YEAR, text):
        window = 1
    if window is None and not years:
        return None
    named = 0 < len(years) <= 2 and not re.search(COMPARING, text)
    window = window and min(10, max(1, window))
    return TimeScope(years, window, named or bool(re.search(ONLY, text)) or (window == 1 and bool(re.search(NOT_MANY, text))))


def valid_scope(window: object, years: object, strict: object) -> TimeScope | None:
    """Scope that a model inferred: the window held to 1..10, years to 1990..2100, anything else dropped."""
    def number(x: object) -> int | None:
        try:
            return int(x)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return None

    span = number(window)
    good = tuple(dict.fromkeys(y for y in map(number, years if isinstance(years, list) else []) if y is not None and 1990 <= y <= 2100))
    return None if span is None and not good else TimeScope(good, None if span is None else min(10, max(1, span)), bool(strict))


def scope_of_answer(text: str) -> TimeScope | None:
    """Scope that a model wrote as a JSON object, in a Markdown fence or not; None where it isn't one."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip())) if text.strip().startswith("```") else text.strip()
    try:
        told = json.loads(body)
    except ValueError:
        return None
    return valid_scope(told.get("window_years"), told.get("explicit_years"), told.get("strict")) if isinstance(told, dict) else None


def lookback_years(scope: TimeScope | None, default: int = 4) -> int:
    """How many years back a search goes: the window and one more, or as many as reach the default."""
    return default if scope is None or scope.window is None else max(scope.window + 1, 2)


def in_scope(period: Column, years: tuple[int, ...]) -> Column:
    """Whether a period lies in the years; a period without a year always does."""
    year = F.regexp_extract(F.coalesce(period, F.lit("")), r"(20\d{2})", 1).try_cast("int")
    return year.isNull() | year.isin(*years) if years else F.lit(True)


def scope_rank(period: Column, years: tuple[int, ...]) -> Column:
    """Sort key: in-scope periods first, then the newest."""
    year = F.coalesce(F.regexp_extract(period, r"(20\d{2})", 1).try_cast("int"), F.lit(0))
    return F.struct(F.when(year.isin(*years), 0).otherwise(1).alias("outside"), (-year).alias("age"))


#: Order of families in answers.
FAMILY_ORDER = ("rd", "revenue", "profit", "revenue_segment", "capacity", "business")


def metric_family(metric: Column) -> Column:
    """Family that a metric's own name puts it in."""
    m = F.lower(F.coalesce(metric, F.lit("")))
    return F.when(F.startswith(m, F.lit("r&d")), "rd").when(F.contains(m, F.lit("profit")), "profit").when(F.startswith(m, F.lit("revenue_segment")), "revenue_segment").when(m == "", "unknown").otherwise(m)


def family_rank(metric: Column, claim: Column, wanted: Column) -> Column:
    """Place of a fact's family among the wanted ones: its own place, 2 if it only touches one, else 9; 5 if none is wanted."""
    own = metric_family(metric)
    rank = F.when(F.size(wanted) == 0, 5)
    for i, name in enumerate(FAMILY_ORDER):
        rank = rank.when(F.array_contains(wanted, name) & F.startswith(own, F.lit(name.split("_")[0])), i)
    return rank.when(in_families(metric, claim, wanted), 2).otherwise(9)


def preferred_only(facts: DataFrame, by: str, wanted: Column) -> DataFrame:
    """Facts (metric_name) without those that a better metric of their family makes needless, per `by`.

    Total revenue drops segments where revenue but no structure is wanted; a family's preferred metric drops its others.
    One grouped aggregate per `by` says which preferred metrics are there.
    """
    rows = facts.withColumn("wanted", wanted).withColumn("own", metric_family(F.col("metric_name")))
    preferred = {f[0]: f[4] for f in FAMILIES}
    here = rows.groupBy(by).agg(F.collect_set(F.when(F.col("metric_name").isin(*preferred.values()) | (F.col("own") == "revenue"), F.col("metric_name"))).alias("here"))
    plain = F.array_contains("wanted", "revenue") & ~F.array_contains("wanted", "revenue_structure")
    segment = plain & F.array_contains("here", "revenue") & (F.col("own") == "revenue_segment")
    beaten = F.lit(False)
    for name, best in preferred.items():
        beaten = beaten | ((F.col("own") == name) & F.array_contains("wanted", name) & F.array_contains("here", best) & (F.coalesce("metric_name", F.lit("")) != best))
    return rows.join(here, by).where(~segment & ~beaten).drop("wanted", "own", "here")


def conflicted_fallback(verified: DataFrame, conflicted: DataFrame, by: str, wanted: Column, strict: Column) -> DataFrame:
    """Verified facts, and for strict questions without any the conflicted ones of a wanted family, marked as such."""
    first = verified.withColumn("conflicted", F.lit(False))
    fits = conflicted.where(strict & (F.size(wanted) > 0) & in_families(F.col("metric_name"), F.col("claim"), wanted))
    return first.unionByName(fits.join(verified.select(by).distinct(), by, "left_anti").withColumn("conflicted", F.lit(True)))


def rank_verified(facts: DataFrame, by: str) -> DataFrame:
    """Facts (disclosure_kind, published_at, confidence, pos) of each `by` in report order: kind of disclosure, newest, surest."""
    kind = F.coalesce(V.lookup(F.col("disclosure_kind"), {"annual": 0, "semi_annual": 1, "interim": 2, "media": 3}), F.lit(2))
    order = [kind.asc(), F.desc(F.coalesce(F.unix_timestamp("published_at"), F.lit(0))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("pos")]
    return numbered(facts, order, "rank", [by])


def quality(period: Column, value: Column, confidence: Column) -> Column:
    """Facts with a year first, then by normalised size and confidence."""
    _, number, _ = V.value_parts(value)
    return 1e9 * period.rlike(r"20\d{2}").cast("int") + F.coalesce(number.cast("double"), V.digits_number(value), F.lit(0.0)) + F.coalesce(confidence, F.lit(0.0))


def one_per_period(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per key (family and period): model facts first, then quality, ties by position.

    A grouped minimum, so it combines before the shuffle and a hot key stays one row per task.
    """
    order = F.struct((F.col("confidence") < 1.0).alias("a"), (-F.col("quality")).alias("b"), F.col("pos").alias("c"))
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def time_filter(facts: DataFrame, by: str, years: tuple[int, ...], strict: bool, trend: bool = False, window: int | None = None) -> DataFrame:
    """Facts of the preferred years, per `by`; facts without a year count as in them. A group without any keeps all its facts.

    Strict scopes, scopes of one year, and trends over several keep only those; others keep the first other fact (by `pos`)
    besides. No preferred years: all facts. What a group has comes from one aggregate per group.
    """
    if not years:
        return facts
    rows = facts.withColumn("in_scope", in_scope(F.col("period"), years))
    g = rows.groupBy(by).agg(F.bool_or("in_scope").alias("any_in"), F.min(F.when(~F.col("in_scope"), F.col("pos"))).alias("spare"))
    met = rows.join(g, by)
    alone = strict or window == 1 or (trend and (window or 0) > 1)
    beside = F.lit(False) if alone else F.coalesce(F.col("pos") == F.col("spare"), F.lit(False))
    return met.where(F.col("in_scope") | ~F.col("any_in") | beside).drop("any_in", "spare", "in_scope")


def rank_answers(facts: DataFrame, by: str, years: tuple[int, ...], top: int = 8, wanted: Column | None = None) -> DataFrame:
    """Top facts per question: in-scope years, newest, family (where `wanted` names some), model facts, quality."""
    year = F.coalesce(F.regexp_extract("period", r"(20\d{2})", 1).try_cast("int"), F.lit(0))
    order = [F.when(year.isin(*years), 0).otherwise(1), F.desc(year), *([] if wanted is None else [family_rank(F.col("metric_name"), F.col("claim"), wanted)]), F.when(F.col("confidence") >= 1.0, 0).otherwise(1), F.desc("quality"), F.asc("pos")]
    return facts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def missing_years(facts: DataFrame, by: str, years: tuple[int, ...]) -> DataFrame:
    """Preferred years without a fact."""
    year = F.regexp_extract("period", r"(20\d{2})", 1).try_cast("int")
    have = facts.groupBy(by).agg(F.collect_set(F.when(year.isin(*years), year)).alias("have"))
    return have.select(by, F.array_sort(F.array_except(F.array(*map(F.lit, years)), F.col("have"))).alias("missing"))


def redact(c: Column) -> Column:
    for term in FORBIDDEN:
        c = F.replace(c, F.lit(term), F.lit(REDACTION))
    return c


def truncated(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


#: The parts of a grounded section.
SECTION_TITLE, LAST_LINE = "证据摘录", "以上摘自原始披露片段，是否采纳须结合上文核对结果判断。"
NO_EVIDENCE = ("围绕问题“", "”，当前检索结果证据不足，还不够支撑细化结论。建议补充公开披露正文、公告或年报后再检索。")
NONE_SHOWN = ("围绕问题“", "”，当前未选入可展示的证据摘录。")
FIRST_LINE = ("与问题「", "」相关的公开资料摘录如下（供回查，不构成结论）：")


def excerpt(text: Column, snippet: int = 300) -> Column:
    """A text on one line, cut with `...`, redacted."""
    line = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return redact(F.when(F.length(line) > snippet, F.concat(F.substring(line, 1, snippet), F.lit("..."))).otherwise(line))


def grounded(evidence: DataFrame, by: str, top: int = 3, snippet: int = 300) -> DataFrame:
    """(by, rank, ..., excerpt): best evidence by layer, credibility and score, ties by `pos`, with its excerpt instead of its text."""
    order = [F.desc(V.layer_priority(F.col("layer"))), F.desc(F.coalesce("credibility", F.lit(0.0))), F.desc("score"), F.asc("pos")]
    ranked = evidence.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.withColumn("excerpt", excerpt(F.col("text"), snippet)).drop("text")


def grounded_sections(questions: DataFrame, evidence: DataFrame, by: str, top: int = 3, snippet: int = 300) -> DataFrame:
    """(by, title, content, citations) of questions (by, query) over evidence (by, source_id, chunk_id, source_title, url, layer, credibility, score, pos, text).

    Numbered excerpts and one citation for each (source, chunk), in order. Without evidence the section says so and cites
    nothing. A blank question, or a forbidden term anywhere in the finished text, fails the job.
    """
    picked = grounded(evidence, by, top, snippet)
    line = F.concat(F.col("rank").cast("string"), F.lit(". 《"), F.coalesce("source_title", F.lit("")), F.lit("》："), F.col("excerpt"))
    cited = F.struct("rank", line.alias("line"), F.struct("source_id", "chunk_id", "url", F.col("source_title").alias("title")).alias("citation"))
    lists = picked.groupBy(by).agg(F.array_sort(F.collect_list(cited)).alias("_items"))
    some = evidence.select(by).distinct().withColumn("_any", F.lit(True))
    met = questions.select(by, strip(F.col("query")).alias("_q")).join(lists, by, "left").join(some, by, "left")
    wrap = lambda parts: F.concat(F.lit(parts[0]), F.col("_q"), F.lit(parts[1]))
    shown = F.array_join(F.concat(F.array(wrap(FIRST_LINE), F.lit("")), F.transform("_items", lambda x: x["line"]), F.array(F.lit(""), F.lit(LAST_LINE))), "\n")
    content = F.when(F.col("_any").isNull(), wrap(NO_EVIDENCE)).when(F.col("_items").isNull(), wrap(NONE_SHOWN)).otherwise(shown)
    bad = F.greatest(*[F.contains(content, F.lit(t)) for t in FORBIDDEN])
    checked = F.when(F.coalesce(F.col("_q"), F.lit("")) == "", F.raise_error(F.lit("a question may not be blank"))).when(bad, F.raise_error(F.lit("a grounded section holds a forbidden term"))).otherwise(content)
    keyed = F.transform(F.coalesce("_items", F.array().cast(lists.schema["_items"].dataType)), lambda x: x["citation"])
    pair = lambda c: F.struct(c["source_id"], c["chunk_id"])
    first = F.filter(keyed, lambda c, i: F.array_position(F.transform(keyed, pair), pair(c)) == i + 1)
    return met.select(by, F.lit(SECTION_TITLE).alias("title"), checked.alias("content"), first.alias("citations"))


#: Lines about the task itself, claims of outside sources, and openings that are cut.
META_LINES = ("根据您(的)?(要求|提供)", "请注意", "由于您提供", "(?i)INSUFFICIENT|VERIFIED|CONFLICTED", r"(?i)status\s*=", "以下(是|为).{0,12}(分析|观察)", "无法(得出|形成).{0,8}可靠结论", "建议以.{0,20}(为准|查阅)")
EXTERNAL_CLAIM = "（来源[：:]|来源[：:][^）]{0,40}年?报|据.{0,8}年?报|巨潮|上交所|港交所"
LEADS = "^(?:根据您的要求|基于当前报告)[，,]"


def risk_lines(df: DataFrame, id_col: str, text_col: str, most: int = 5, limit: int = 220, least: int = 12) -> DataFrame:
    """(id, rank, line): lines freed of Markdown, long enough, cut, the first of each 48-character start, at most `most` a text."""
    lines = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("pos", "raw"))
    c = strip(F.col("raw"))
    for pattern in (r"^#{1,4}\s+", r"^[-*•]\s*", r"^\d+[.、．]\s*"):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\*{1,2}([^*]+)\*{1,2}", "$1"), r"^[ \-*\t]+|[ \-*\t]+$", "")
    line = F.col("line")
    useful = ~line.rlike("|".join(META_LINES)) & (~line.rlike(EXTERNAL_CLAIM) | F.contains(line, F.lit("引用")))
    kept = lines.select(id_col, "pos", c.alias("line")).where(F.length("line") >= least).where(useful)
    kept = kept.withColumn("line", strip(F.regexp_replace("line", LEADS, ""))).select(id_col, "pos", truncated(F.col("line"), limit).alias("line"))
    firsts = kept.groupBy(id_col, F.substring("line", 1, 48).alias("start")).agg(F.min(F.struct("pos", "line")).alias("x")).select(id_col, "x.pos", "x.line")
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("rank") <= most).select(id_col, "rank", "line")


def merge_citations(lists: list[DataFrame], by: str) -> DataFrame:
    """Ordered union of citation lists (by, source_id, chunk_id, pos), the first of each (source, chunk)."""
    rows = None
    for i, part in enumerate(lists):
        part = part.select(by, "source_id", "chunk_id", F.struct(F.lit(i).alias("l"), F.col("pos").alias("p")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy(by, "source_id", "chunk_id").agg(F.min("at").alias("at"))
    return numbered(one, [F.asc("at"), F.asc("source_id"), F.asc("chunk_id")], "pos", [by]).drop("at")


def fact_citations(facts: DataFrame, sources: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(by, source_id, chunk_id, pos, url, title): each fact's (source, chunk) once, in order; facts whose source or chunk is gone cite nothing."""
    one = facts.groupBy(by, "source_id", "chunk_id").agg(F.min("pos").alias("pos"))
    met = one.join(chunks.select(by, "chunk_id").distinct(), [by, "chunk_id"], "left_semi")
    return met.join(sources.select(by, "source_id", "url", "title"), [by, "source_id"]).select(by, "source_id", "chunk_id", "pos", "url", "title")


def number_citations(citations: DataFrame, by: str) -> DataFrame:
    """Citations with a number each; citations of one URL share the number of the first."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("source_id"))
    rows = citations.withColumn("key", key)
    first = rows.groupBy(by, "key").agg(F.min("pos").alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("first")))
    return rows.join(numbered.select(by, "key", "number"), [by, "key"]).drop("key")


def status_buckets(facts: DataFrame, results: DataFrame) -> DataFrame:
    """Facts with their verdict; those without one are insufficient."""
    return facts.join(results.select("fact_id", "status"), "fact_id", "left").withColumn("status", F.coalesce("status", F.lit("insufficient")))
