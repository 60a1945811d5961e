"""Whole reports from a task's facts, citations and differences: sections in a fixed order, limits with notices, escaped export.

Every line of a report is a row (task, section, place); the rows of a task meet once, where its text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.functions.values import lookup
from factloom.operators.numbering import numbered
from factloom.operators.report import VERDICT_LABELS
from factloom.operators.selection import families, risk_lines

#: How many of each kind are shown, lines of the report, and names of metrics.
CORE, CONTEXT, GROUPS, VALUES, CONFLICTED, OUTDATED, REJECTED, SOURCES = 10, 6, 6, 4, 4, 3, 3, 30
DISCLAIMER = "> 本报告仅依据本次采集的公开资料整理，不构成投资建议。"
NO_CORE = "- 暂未找到与该问题直接对应的可核对数据，建议查看文末来源或调整问题措辞。"
CLASH_ALONE = "- 不同来源说法不一致，且缺少可采信主事实；建议补充年报/半年报全文后重新查询。"
CLASH = "- 不同来源说法不一致，部分指标存在口径差异，建议以年报合并报表原文为最终依据。"
NO_RISK, NO_SOURCE, NO_NOTE = "- 暂未发现需要特别关注的风险点。", "- 当前没有可引用来源。", "- 暂无需要单独说明的核对异常。"
NO_FACTS = "- 已采集公开资料来源，但尚未抽出足以支撑结论的结构化事实。"
NO_RD = "- 问题涉及研发，但本次没有抽取到研发费用/投入类可核对数字。"
NO_REASON, OLD, OUT = "同一指标同一期间存在不同取值。", "来源或期间过时，未纳入主结论。", "已排除。"
LAST = "本报告基于公开资料生成，只用于信息研究，不构成投资建议。"
METRICS = {
    "r&d_expenditure": "研发费用", "r&d_total_spending": "研发投入合计", "revenue": "营业收入", "revenue_segment": "分业务收入", "net_profit": "净利润", "net_profit_parent": "归母净利润",
    "net_profit_deducted": "扣非净利润", "production_capacity": "产能", "production_volume": "产量", "sales_volume": "销量",
}


def notice(label: str, limit: int) -> str:
    return f"- 仅展示前 {limit} 条{label}；完整明细可在证据面板或 API 中查看。"


def readable(claim: Column) -> Column:
    """A claim without its closing source note and the mark of an unknown period."""
    return strip(F.replace(F.regexp_replace(F.coalesce(claim, F.lit("")), r"（来源\s*\d+[^）]*）\s*$", ""), F.lit("期间未识别："), F.lit("")))


def citation_numbers(citations: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(items, refs): sources (by, number, title, url) once per URL, in order, and (by, source_id, chunk_id, ref) for each cited chunk."""
    rows = citations.withColumn("_url", strip(F.coalesce("url", F.lit(""))))
    rows = rows.withColumn("_key", F.when(F.col("_url") == "", F.concat(F.lit("\0"), F.col("pos").cast("string"))).otherwise(F.col("_url")))
    first = rows.groupBy(by, "_key").agg(F.min_by(F.struct("title", "_url"), "pos").alias("x"), F.min("pos").alias("pos"))
    items = numbered(first, [F.asc("pos")], "number", [by])
    refs = rows.join(items.select(by, "_key", "number"), [by, "_key"]).groupBy(by, "source_id", "chunk_id").agg(F.max_by("number", "pos").alias("ref"))
    return items.select(by, "number", "x.title", F.col("x._url").alias("url")), refs


def rendered(tasks: DataFrame, facts: DataFrame, citations: DataFrame, ambiguities: DataFrame, by: str = "task_id") -> DataFrame:
    """(by, title, content) of tasks (by, company, question, summary, risk_analysis).

    facts: (by, fact_id, source_id, chunk_id, claim, metric_name, status, reason, part, pos), `part` core, context or null;
    citations: (by, pos, source_id, chunk_id, title, url); ambiguities: (by, pos, metric, period, claims).
    """
    items, refs = citation_numbers(citations, by)
    placed = facts.join(refs, [by, "source_id", "chunk_id"], "left")
    of = lambda column, values: F.count_if(F.coalesce(F.col(column).isin(*values), F.lit(False)))
    counts = facts.groupBy(by).agg(
        of("part", ["core"]).alias("n_core"), of("part", ["context"]).alias("n_context"), *[of("status", [s]).alias(f"n_{s}") for s in VERDICT_LABELS],
        F.bool_or((F.col("status") == "verified") & (F.contains(F.lower(F.coalesce("metric_name", F.lit(""))), F.lit("r&d")) | F.contains(F.coalesce("claim", F.lit("")), F.lit("研发")))).alias("has_rd"),
    )
    names = ["n_core", "n_context", *[f"n_{s}" for s in VERDICT_LABELS]]
    cited = citations.groupBy(by).agg(F.count(F.lit(1)).alias("n_cited"))
    differing = ambiguities.groupBy(by).agg(F.count(F.lit(1)).alias("n_groups"))
    base = tasks.join(counts, by, "left").join(cited, by, "left").join(differing, by, "left").fillna(0, [*names, "n_cited", "n_groups"]).withColumn("has_rd", F.coalesce("has_rd", F.lit(False)))

    def lines(df: DataFrame, section: int, text: Column | str, when: Column | None = None, place: Column | int = 0) -> DataFrame:
        df = df if when is None else df.where(when)
        at = place if isinstance(place, Column) else F.lit(place)
        return df.select(by, F.lit(section).alias("section"), at.cast("long").alias("place"), (text if isinstance(text, Column) else F.lit(text)).alias("line"))

    def first(df: DataFrame, most: int) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("n") <= most)

    label = F.when(~F.coalesce(F.col("status").isin("verified", "insufficient"), F.lit(True)), lookup(F.col("status"), VERDICT_LABELS, F.lit(VERDICT_LABELS["insufficient"])))
    notes = F.array_compact(F.array(label, F.concat(F.lit("来源 "), F.col("ref").cast("string"))))
    fact_line = F.concat(F.lit("- "), "claim", F.when(F.size(notes) > 0, F.concat(F.lit("（"), F.array_join(notes, "；"), F.lit("）"))).otherwise(""))
    of_part = lambda part, most: first(placed.where(F.col("part") == part), most)
    of_status = lambda status, most: first(placed.where(F.col("status") == status), most)

    # without a summary the first core facts tell it, else the first verified ones, else that nothing was found
    told = facts.withColumn("_rank", F.when(F.col("part") == "core", 0).when(F.col("status") == "verified", 1)).where("_rank IS NOT NULL")
    told = told.join(told.groupBy(by).agg(F.min("_rank").alias("_best")), by).where("_rank = _best")
    told = first(told, 3).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", readable(F.col("claim")).alias("c")))), lambda x: x["c"]), "；").alias("told"))
    base = base.join(told, by, "left")
    nothing = F.concat(F.lit("本次采集的公开资料中，暂未找到可直接回答「"), "question", F.lit("」的"), "company", F.lit("数据。"))
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.concat("company", F.lit("："), "told", F.lit("。")), nothing)

    head = F.concat(F.lit("# "), "company", F.lit(" 公开信息研究报告\n\n**研究问题**："), "question", F.lit(f"\n\n{DISCLAIMER}\n\n## 总结\n"), summary, F.lit("\n\n## 核心发现"))
    removed, n = F.col("n_outdated") + F.col("n_rejected"), lambda s: F.col(f"n_{s}").cast("string")
    checked = F.concat(
        F.lit("- 数据核对：已采信 "), n("verified"), F.lit(" 条，口径差异 "), n("conflicted"), F.lit(" 条，证据不足 "), n("insufficient"), F.lit(" 条"),
        F.when(removed > 0, F.concat(F.lit("，已排除 "), removed.cast("string"), F.lit(" 条"))).otherwise(""), F.lit("。"),
    )
    total = sum((F.col(f"n_{s}") for s in VERDICT_LABELS), F.lit(0))
    values = F.array_join(F.transform(F.slice("claims", 1, VALUES), readable), "；")
    named, base_metric = F.col("period"), F.substring_index("metric", ":", 1)
    difference = F.concat(F.lit("  - "), lookup(base_metric, METRICS, base_metric), F.lit("（"), F.when(named == "unknown_period", "期间未识别").otherwise(named), F.lit("）："), values)
    clash = F.concat(F.lit("- "), "claim", F.lit("："), F.coalesce("reason", F.lit(NO_REASON)), F.coalesce(F.concat(F.lit(" 来源 "), F.col("ref").cast("string")), F.lit("")))
    wants_rd = F.array_contains(families(F.col("question")), "rd") & ~F.col("has_rd")
    risks = risk_lines(tasks.where("risk_analysis IS NOT NULL"), by, "risk_analysis")
    parts = [
        lines(base, 0, head),
        lines(base, 1, NO_CORE, F.col("n_core") == 0),
        lines(of_part("core", CORE), 1, fact_line, place=F.col("n")),
        lines(base, 2, notice("核心发现", CORE), F.col("n_core") > CORE),
        lines(base, 3, "\n## 补充背景", F.col("n_context") > 0),
        lines(of_part("context", CONTEXT), 4, fact_line, place=F.col("n")),
        lines(base, 5, notice("补充背景", CONTEXT), F.col("n_context") > CONTEXT),
        lines(base, 6, "\n## 风险观察"),
        lines(base, 7, F.when(F.col("n_verified") == 0, CLASH_ALONE).otherwise(CLASH), F.col("n_conflicted") > 0),
        lines(risks, 8, F.concat(F.lit("- "), "line"), place=F.col("rank")),
        lines(base.join(risks.select(by).distinct(), by, "left_anti"), 8, NO_RISK, F.col("n_conflicted") == 0),
        lines(base, 9, "\n## 公开资料来源"),
        lines(items, 10, F.concat(F.lit("- ["), F.col("number").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("："), F.when(F.col("url") == "", "无可打开 URL").otherwise(F.col("url"))), place=F.col("number")),
        lines(base, 10, NO_SOURCE, F.col("n_cited") == 0),
        lines(base, 11, notice("来源", SOURCES), F.col("n_cited") > SOURCES),
        lines(base, 12, "\n## 附录"),
        lines(base, 13, F.when(total > 0, checked).otherwise(NO_FACTS), (total > 0) | (F.col("n_cited") > 0)),
        lines(base, 14, "- 口径差异说明：", F.col("n_groups") > 0),
        lines(first(ambiguities, GROUPS), 15, difference, place=F.col("n")),
        lines(base, 16, notice("口径差异", GROUPS), F.col("n_groups") > GROUPS),
        lines(base, 17, NO_RD, wants_rd),
        lines(of_status("conflicted", CONFLICTED), 18, clash, place=F.col("n")),
        lines(base, 19, notice("冲突条目", CONFLICTED), F.col("n_conflicted") > CONFLICTED),
        lines(of_status("outdated", OUTDATED), 20, F.concat(F.lit("- "), "claim", F.lit(f"：{OLD}")), place=F.col("n")),
        lines(of_status("rejected", REJECTED), 21, F.concat(F.lit("- "), "claim", F.lit(f"：{OUT}")), place=F.col("n")),
        lines(base, 22, NO_NOTE, (total == 0) & (F.col("n_cited") == 0) & (F.col("n_groups") == 0) & ~wants_rd),
        lines(base, 23, F.lit(f"\n## 免责声明\n{LAST}")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    listed = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    text = rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("content"))
    return tasks.select(by, F.concat("company", F.lit(" - 企业公开信息研究报告")).alias("title")).join(text, by)


def exported_markdown(title: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), content, F.lit("\n"))


def escaped(c: Column) -> Column:
    """Text that HTML shows as it is."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def exported_html(title: Column, content: Column) -> Column:
    """A page with the report as it is laid out; nothing in it is read as HTML."""
    return F.concat(F.lit("<html><head><meta charset='utf-8'><title>"), escaped(title), F.lit("</title></head><body><pre>"), escaped(content), F.lit("</pre></body></html>"))
