"""Compliance screening: lexicon scan, decision by category, and its application to texts. Built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Categories with their action and keywords, in the order in which they are tried.
LEXICON = (
    ("buy_sell_advice", "refuse", ("买入", "卖出", "要不要买", "能不能买", "能买吗", "建议买入", "建议卖出", "值得买", "值得卖", "抄底", "逃顶", "梭哈", "满仓", "清仓", "should i buy", "buy now", "sell now", "buy", "sell")),
    ("target_price", "rewrite", ("目标价", "目标股价", "合理价位", "估值区间", "target price", "target_price", "price target")),
    ("return_promise", "rewrite", ("收益承诺", "稳赚", "稳赚不赔", "保本保息", "翻倍", "十倍股", "年化收益", "预期收益", "expected return", "收益预测", "保证收益")),
    ("stock_recommendation", "refuse", ("个股推荐", "推荐哪只", "推荐股票", "强烈推荐", "首选标的", "核心标的", "必买", "龙头首选")),
    ("position_guidance", "refuse", ("加仓", "减仓", "持仓指导", "仓位", "建仓", "止盈", "止损", "调仓", "重仓", "轻仓")),
    ("personalized_investment_advice", "refuse", ("适合我买吗", "个性化投资建议", "适合你购买", "我该不该买", "帮我选股票", "这只股票能买吗", "现在可以入场吗", "给我配置方案")),
)
REMOVED = "【已移除违规表达】"
NOTICE = "\n\n合规提示：本系统不提供证券投资导向结论。可继续提供基于公开资料的经营情况与风险信息分析。"
BLOCKED = "当前请求涉及投资建议或个性化投融导向信息，已按合规策略拒绝。你可以继续询问：经营风险、财务变化、信息披露一致性、供应链稳定性等公开信息问题。"
#: Signs of an answer that left its report, and words of the engine that a reader shouldn't see.
SUSPICIOUS = ("常规公开信息", "过往公开披露内容", "不来自您提到的特定报告", "无法验证其时效性和完整性", "请提供报告名称或来源", "当前请求涉及投资建议")
DENIALS = r"报告(?:中)?没有|报告未包含|并未包含|没有包含|(?i:does\s+not\s+contain)|(?i:not\s+included)|(?i:\bno\s+data\b)"
ENGINE_WORDS = ("核心发现", "证据缺口", "验证状态", "可追溯来源", "verified", "conflicted", "insufficient")

Lexicon = tuple[tuple[str, str, tuple[str, ...]], ...]


def has_keyword(lowered: Column, keyword: str) -> Column:
    """Single ASCII words match whole, everything else as a substring."""
    if keyword.isascii() and keyword.isalpha():
        return lowered.rlike(rf"(?U)\b{re.escape(keyword.lower())}\b")
    return F.contains(lowered, F.lit(keyword.lower()))


def hits(c: Column, lexicon: Lexicon = LEXICON) -> Column:
    """array<struct<category, action, keyword>>: the first keyword of each category that the text holds, embedded images aside."""
    lowered = F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)!\[[^\]]*\]\(data:[^)]+\)", ""))
    found = []
    for category, action, keywords in lexicon:
        first = None
        for k in keywords:
            first = F.when(has_keyword(lowered, k), k) if first is None else first.when(has_keyword(lowered, k), k)
        found.append(F.when(first.isNotNull(), F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"), first.alias("keyword"))))
    return F.array_compact(F.array(*found))


def action(found: Column) -> Column:
    """refuse before rewrite before allow."""
    return F.when(F.exists(found, lambda h: h["action"] == "refuse"), "refuse").when(F.size(found) > 0, "rewrite").otherwise("allow")


def applied(c: Column, found: Column) -> Column:
    """The text as it may be shown: blocked as a whole, freed of the recorded phrases (in their own case) with a notice, or as it is."""
    rewritten = F.concat(F.aggregate(found, c, lambda text, h: F.replace(text, h["keyword"], F.lit(REMOVED))), F.lit(NOTICE))
    return F.when(action(found) == "refuse", BLOCKED).when(action(found) == "rewrite", rewritten).otherwise(c)


def ungrounded(c: Column) -> Column:
    """Answers with a suspicious phrase, a denial, or two or more of the engine's own words, in their own case."""
    text = F.coalesce(c, F.lit(""))
    odd = F.lit(False)
    for p in SUSPICIOUS:
        odd = odd | F.contains(text, F.lit(p))
    words = sum((F.contains(text, F.lit(w)).cast("int") for w in ENGINE_WORDS), F.lit(0))
    return odd | text.rlike(DENIALS) | (words >= 2)
