"""Scalar normalisation of metrics, values, sources and periods; the lookup values stand here in plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Metric aliases and the metrics that keep a dimension.
ALIASES = {
    "r&d_expenditure": "R&D_expenditure", "r_and_d": "R&D_expenditure", "rd": "R&D_expenditure", "rd_expense": "R&D_expenditure",
    "research_expense": "R&D_expenditure", "research_expenditure": "R&D_expenditure", "研发费用": "R&D_expenditure",
    "r&d_total_spending": "R&D_total_spending", "rd_total": "R&D_total_spending", "rd_spending": "R&D_total_spending",
    "研发投入": "R&D_total_spending", "研发投入合计": "R&D_total_spending", "rev": "revenue", "operating_revenue": "revenue",
    "营业收入": "revenue", "营收": "revenue", "np": "net_profit", "净利润": "net_profit", "parent_net_profit": "net_profit_parent",
    "归母净利润": "net_profit_parent", "deducted_net_profit": "net_profit_deducted", "扣非净利润": "net_profit_deducted", "扣非归母净利润": "net_profit_deducted",
}
DIMENSIONAL = ("revenue_segment", "production_capacity", "production_volume", "sales_volume")
#: Units as (kind, factor, base unit).
UNITS = {
    "元": ("money", 1, "yuan"), "千元": ("money", 1000, "yuan"), "万元": ("money", 10000, "yuan"), "亿元": ("money", 100000000, "yuan"),
    "万": ("money", 10000, "yuan"), "亿": ("money", 100000000, "yuan"), "辆": ("vehicle", 1, "vehicle"), "万辆": ("vehicle", 10000, "vehicle"),
    "台": ("unit", 1, "unit"), "万台": ("unit", 10000, "unit"), "吨": ("ton", 1, "ton"), "万吨": ("ton", 10000, "ton"),
    "mwh": ("energy", 1, "MWh"), "gwh": ("energy", 1000, "MWh"), "%": ("ratio", 1, "percent"),
}
MONEY_METRICS = ("R&D_expenditure", "R&D_total_spending", "revenue", "revenue_segment", "net_profit", "net_profit_parent", "net_profit_deducted")
VOLUME_METRICS = ("production_capacity", "production_volume", "sales_volume")
VOLUME_KINDS = ("vehicle", "unit", "ton", "energy")
LEAST_MONEY = 100_000_000
#: Number followed by a unit.
VALUE = r"(?i)([-+]?\d[\d,]*(?:\.\d+)?)\s*(亿元|万元|千元|万辆|万台|万吨|GWh|MWh|元|亿|万|%|辆|台|吨)"
#: Authority thresholds and source layers.
HIGH_AUTHORITY, LOW_AUTHORITY = 0.85, 0.6
LAYERS = {"official_pdf": 4, "official_disclosure_page": 4, "official_entry_page": 3, "third_party_background": 1}
AUTHORITATIVE = ("hkexnews.hk", "hkex.com.hk", "sse.com.cn", "szse.cn", "cninfo.com.cn", "gov.cn")
LOW_DOMAINS = ("baijiahao.baidu.com", "zhihu.com", "xueqiu.com", "mp.weixin.qq.com", "wjx.cn", "11467.com")
REGISTRY_DOMAINS = ("aiqicha.baidu.com", "qcc.com", "tianyancha.com", "gsxt.gov.cn")


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, default)


def metric_key(metric: Column) -> Column:
    """Comparable metric: aliased base, and the dimension where the metric keeps one."""
    base, dimension = F.substring_index(metric, ":", 1), F.regexp_extract(metric, "^[^:]*:(?s)(.*)$", 1)
    key = F.regexp_replace(F.translate(F.lower(strip(base)), " -", "__"), "_+", "_")
    known = lookup(key, ALIASES, strip(base))
    cleaned = F.translate(F.regexp_replace(F.lower(dimension), r"(?U)\s+", ""), "（）", "()")
    keeps = known.isin(*DIMENSIONAL) & F.contains(metric, F.lit(":")) & (dimension != "")
    return F.when(F.coalesce(metric, F.lit("")) == "", "").when(keeps, F.concat(known, F.lit(":"), cleaned)).otherwise(known)


def value_parts(value: Column) -> tuple[Column, Column, Column]:
    """(kind, decimal(38,6) in the base unit, base unit); nulls when no number with a unit is found."""
    text = F.replace(value, F.lit(" "), F.lit(""))
    number = F.replace(F.regexp_extract(text, VALUE, 1), F.lit(","), F.lit("")).try_cast("decimal(20,6)")
    unit = F.lower(F.regexp_extract(text, VALUE, 2))
    kind = lookup(unit, {k: v[0] for k, v in UNITS.items()})
    factor = lookup(unit, {k: v[1] for k, v in UNITS.items()}).cast("decimal(12,0)")
    return F.when(number.isNotNull(), kind), (number * factor).cast("decimal(38,6)"), lookup(unit, {k: v[2] for k, v in UNITS.items()})


def plain(number: Column) -> Column:
    """Decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def value_key(value: Column) -> Column:
    kind, number, unit = value_parts(value)
    raw = strip(F.lower(F.regexp_replace(value, "[ ,]", "")))
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(kind.isNotNull(), F.concat_ws(":", kind, plain(number), unit)).otherwise(raw)


def digits_number(value: Column) -> Column:
    """Digits and the first dot only, as a double (a sign is dropped); null without digits."""
    kept = F.regexp_replace(value, r"[^0-9.]", "")
    once = F.concat(F.regexp_extract(kept, r"^([0-9]*\.?)", 1), F.replace(F.regexp_replace(kept, r"^[0-9]*\.?", ""), F.lit("."), F.lit("")))
    return once.try_cast("double")


def implausible(metric: Column, value: Column) -> Column:
    """Percentages of money, units of another kind, and money below a listed company's size."""
    base = F.substring_index(F.coalesce(metric, F.lit("")), ":", 1)
    text = strip(F.coalesce(value, F.lit("")))
    kind, number, _ = value_parts(text)
    money, volume = base.isin(*MONEY_METRICS), base.isin(*VOLUME_METRICS)
    wrong = (money & (kind != "money")) | (volume & ~kind.isin(*VOLUME_KINDS))
    return F.coalesce(F.when(F.endswith(text, F.lit("%")), money).when(kind.isNull(), F.lit(False)).when(wrong, F.lit(True)).otherwise(money & (number < LEAST_MONEY)), F.lit(False))


def authority(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= HIGH_AUTHORITY, "high").when(score < LOW_AUTHORITY, "low").otherwise("medium")


def layer_priority(layer: Column) -> Column:
    return lookup(layer, LAYERS, F.lit(2))


def official_body(layer: Column) -> Column:
    return F.coalesce(layer.isin("official_pdf", "official_disclosure_page"), F.lit(False))


def host_in(host: Column, domains: tuple[str, ...]) -> Column:
    """Exact or subdomain match."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return F.coalesce(out, F.lit(False))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def credibility(title: Column, url: Column) -> Column:
    host = host_of(url)
    text = F.lower(F.concat_ws(" ", title, host))
    return (
        F.when(host_in(host, AUTHORITATIVE), 0.96)
        .when(host_in(host, LOW_DOMAINS), 0.46)
        .when(host_in(host, REGISTRY_DOMAINS), 0.72)
        .when(text.rlike(r"官网|official|investor|ir\.|investor-relations"), 0.84)
        .when(text.rlike("年报|年度报告|交易所|监管披露|公告"), 0.78)
        .otherwise(0.68)
    )


def source_type(title: Column, url: Column, raw: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, url, F.coalesce(raw, F.lit(""))))
    return (
        F.when(text.rlike("annual|年报|年度报告"), "annual_report")
        .when(text.rlike("公告|announcement|disclosure"), "announcement")
        .when(text.rlike("gov|政府|监管"), "government")
        .when(text.rlike("招聘|hiring|job|career"), "hiring")
        .when(host_in(host_of(url), REGISTRY_DOMAINS), "other")
        .when(text.rlike("news|新闻") | (raw == "web"), "news")
        .otherwise("other")
    )


def source_layer(title: Column, url: Column) -> Column:
    official = host_in(host_of(url), AUTHORITATIVE)
    pdf = F.contains(F.lower(F.concat_ws(" ", title, url)), F.lit("pdf"))
    return F.when(official & pdf, "official_pdf").when(official, "official_disclosure_page").otherwise("third_party_background")


def disclosure_kind(title: Column, kind: Column) -> Column:
    """In this order: a half-year report's title that holds the words of an annual one counts as annual."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(text.rlike("年度报告|年报|annual"), "annual")
        .when(text.rlike("半年度|半年报|semi"), "semi_annual")
        .when(text.rlike("季度|一季报|三季报|临时"), "interim")
        .when(kind.isin("news", "other"), "media")
        .otherwise("interim")
    )
