"""Answer paragraphs, report text, and what is read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip

#: Words that make a question a trend or a list, and those that ask for the whole picture.
TREND_WORDS, LIST_WORDS, OVERVIEW_WORDS = "对比|比较|变化|趋势|逐年|历年|各年|多年|同比|环比", "有哪些|列举|分别|构成|结构", "概况|概览|全面|整体|综合|各方面"
MOST_DIRECT, MOST_TREND, MOST_CHART = 4, 5, 6
INCOMPLETE = "相关指标在材料中表述不完整，需结合来源原文核对。"


def answer_mode(question: Column, families: Column) -> Column:
    return F.when(question.rlike(TREND_WORDS), "trend").when(question.rlike(LIST_WORDS) & (F.size(families) > 0), "list").otherwise("direct")


def strict_metrics(question: Column, families: Column) -> Column:
    return (F.size(families) > 0) & ~question.rlike(OVERVIEW_WORDS)


def clean_claim(claim: Column) -> Column:
    """A claim without its closing source and divergence notes."""
    c = strip(F.coalesce(claim, F.lit("")))
    c = F.regexp_replace(c, r"（来源\s*\d+[^）]*）\s*$", "")
    return strip(F.regexp_replace(c, r"（[^）]*口径不一致[^）]*）\s*$", ""))


def sentence(parts: Column) -> Column:
    """Clauses joined into one sentence."""
    body = F.array_join(parts, "；")
    return F.when(F.size(parts) == 0, INCOMPLETE).when(F.endswith(body, F.lit("。")), body).otherwise(F.concat(body, F.lit("。")))


def compose(ranked: DataFrame, by: str, most: int = 8) -> DataFrame:
    """(by, direct, trend): paragraphs of ranked facts (claim, period, rank). At most `most` ranked facts a group are read."""
    year = F.coalesce(F.regexp_extract(F.coalesce("period", F.lit("")), r"(20\d{2})", 1).try_cast("int"), F.lit(0))
    rows = ranked.where(F.col("rank") <= most).select(by, "rank", year.alias("year"), clean_claim(F.col("claim")).alias("claim")).where("claim <> ''")
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "claim"))).alias("d"), F.array_sort(F.collect_list(F.struct("year", "rank", "claim"))).alias("t"))
    direct = sentence(F.slice(F.transform("d", lambda x: x["claim"]), 1, MOST_DIRECT))
    years = F.array_distinct(F.filter(F.transform("t", lambda x: x["year"]), lambda y: y > 0))
    span = F.array_join(F.transform(years, lambda y: y.cast("string")), " → ")
    told = F.concat(F.lit("从已核对条目看，"), span, F.lit(" 年间相关数据为："), sentence(F.slice(F.transform("t", lambda x: x["claim"]), 1, MOST_TREND)))
    return g.select(by, direct.alias("direct"), F.when(F.size(years) >= 2, told).otherwise(direct).alias("trend"))


#: What an answer without facts says, what many differences add, and how many are many.
NO_DATA = ("本次采集的公开资料中，暂未找到可直接回答「", "」的", "数据。")
NARROW = "可尝试将问题收窄到具体年份和指标（例如「2024年研发费用」），或点击文末来源链接核对年报原文。"
DIFFERENCES, MANY_DIFFERENCES = "注：部分指标在不同来源中存在口径差异，建议以年报合并报表为准。", 8


def composed_answers(questions: DataFrame, ranked: DataFrame, by: str) -> DataFrame:
    """(by, answer) of questions (by, company, question, mode, gap_notes, n_conflicted) over ranked facts (by, claim, period, rank).

    The paragraph of the mode (a trend needs two facts), gap notes that it doesn't hold yet, and a note where many facts
    differ. Without facts: that nothing was found, with the gaps or advice to narrow the question.
    """
    counts = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("_facts"))
    met = questions.join(compose(ranked, by), by, "left").join(counts, by, "left")
    notes = F.coalesce("gap_notes", F.array().cast("array<string>"))
    nothing = F.concat(F.lit(NO_DATA[0]), "question", F.lit(NO_DATA[1]), "company", F.lit(NO_DATA[2]), F.when(F.size(notes) > 0, F.array_join(notes, "；")).otherwise(NARROW))
    body = F.when((F.col("mode") == "trend") & (F.col("_facts") >= 2), F.col("trend")).otherwise(F.coalesce("direct", F.lit(INCOMPLETE)))
    text = F.concat(F.lit("针对「"), "question", F.lit("」，"), "company", F.lit("："), body)
    told = F.aggregate(notes, text, lambda t, n: F.when(F.contains(t, n), t).otherwise(F.concat(t, n, F.when(F.endswith(n, F.lit("。")), "").otherwise("。"))))
    told = F.when((F.coalesce("n_conflicted", F.lit(0)) >= MANY_DIFFERENCES) & ~F.contains(told, F.lit("口径差异")), F.concat(told, F.lit(DIFFERENCES))).otherwise(told)
    return met.select(by, F.when(F.col("_facts").isNull(), nothing).otherwise(told).alias("answer"))


def chart_payload(facts: DataFrame, by: str) -> DataFrame:
    """(by, labels, numbers): the first facts about revenue or profit, else about anything, whose value has digits."""
    from factloom.functions.values import digits_number

    money = F.lower(F.coalesce("metric_name", F.lit(""))).rlike("revenue|profit")
    rows = facts.withColumn("money", money)
    some = rows.groupBy(by).agg(F.bool_or("money").alias("some"))
    from pyspark.sql import Window

    kept = rows.join(some, by).where("money OR NOT some").withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("n") <= MOST_CHART)
    kept = kept.withColumn("number", digits_number(F.col("value"))).where("number IS NOT NULL AND coalesce(period, '') <> ''")
    g = kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "period", "number"))).alias("x"))
    return g.select(by, F.transform("x", lambda r: r["period"]).alias("labels"), F.transform("x", lambda r: r["number"]).alias("numbers"))


def markdown_report(title: Column, parts: list[tuple[str, Column]]) -> Column:
    """Sections in the order given; an empty section is left out."""
    blocks = [F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), body)) for name, body in parts]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *blocks)


def report_section(markdown: Column, name: str) -> Column:
    """Body of a section up to the next heading of its level; empty if there is none."""
    return strip(F.regexp_extract(F.concat(markdown, F.lit("\n## ")), rf"(?s)(?:^|\n)## {name}[ \t]*\n(.*?)\n## ", 1))


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def risk_summary(counts: dict[str, Column], claims: Column) -> Column:
    """Deterministic summary: facts per status and the first claims."""
    told = F.concat_ws("，", *[F.concat(F.lit(f"{k} "), v.cast("string"), F.lit(" 条")) for k, v in counts.items()])
    return F.concat(F.lit("校验状态："), told, F.lit("。\n"), numbered(F.slice(claims, 1, 5)))


#: Strength of a task's evidence with what it allows, labels of verdicts, and headings of reports.
STRENGTHS = (
    ("较高", "已经拿到官方披露正文或官方 PDF，可以支撑后续事实核验。"),
    ("中等", "目前只有官方入口，缺少具体披露正文；财务和经营结论仍需补证。"),
    ("偏低", "高权威来源不足，现有材料更适合作线索，不适合作确定结论。"),
)
VERDICT_LABELS = {"verified": "已核对", "conflicted": "口径不一致", "insufficient": "线索待补证", "outdated": "信息偏旧", "rejected": "已排除"}


def evidence_strength(official_body: Column, high: Column) -> Column:
    """struct<strength, limitation> from the numbers of official texts and of sources of high authority."""
    level = [F.struct(F.lit(a).alias("strength"), F.lit(b).alias("limitation")) for a, b in STRENGTHS]
    return F.when(official_body > 0, level[0]).when(high > 0, level[1]).otherwise(level[2])


def source_summary(sources: DataFrame, by: str) -> DataFrame:
    """(by, strength, official_body, entry_page, background, low, summary) of sources (layer, credibility)."""
    from factloom.functions.values import authority, official_body

    layer, level = F.col("layer"), authority(F.col("credibility"))
    entry = F.coalesce(layer == "official_entry_page", F.lit(False))
    counts = {"official_body": official_body(layer), "entry_page": entry, "background": ~official_body(layer) & ~entry, "low": level == "low", "high": level == "high"}
    g = sources.groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn("s", evidence_strength(F.col("official_body"), F.col("high")))
    lines = (("本次证据强度：", F.col("s.strength"), "。"), ("官方/监管/交易所正文：", F.col("official_body"), " 条。"), ("官方入口但不是正文：", F.col("entry_page"), " 条。"), ("第三方背景材料：", F.col("background"), " 条。"), ("低可信来源：", F.col("low"), " 条。"), ("解读：", F.col("s.limitation"), ""))
    text = F.concat_ws("\n", F.lit("## 来源质量摘要"), *[F.concat(F.lit(f"- {a}"), v.cast("string"), F.lit(b)) for a, v, b in lines])
    return g.select(by, "s.strength", "official_body", "entry_page", "background", "low", text.alias("summary"))


def audit_section(decisions: DataFrame, by: str) -> DataFrame:
    """(by, audit): the appendix of a task's decisions (pos, message, status_counts map), with counts by the name of the status."""
    from factloom.functions.values import lookup

    pairs = F.array_sort(F.transform(F.map_entries("status_counts"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("n"))))
    counts = F.array_join(F.transform(pairs, lambda p: F.concat(lookup(p["k"], VERDICT_LABELS, F.lit(VERDICT_LABELS["insufficient"])), F.lit(" "), p["n"].cast("string"), F.lit(" 条"))), "；")
    line = F.concat(F.lit("- "), "message", F.when(F.size("status_counts") > 0, F.concat(F.lit("\n- 校验统计："), counts)).otherwise(""))
    g = decisions.select(by, F.struct("pos", line.alias("line")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = "\n\n## 附录：处理记录\n\n以下记录用于解释为什么某些内容没有形成结论。"
    return g.select(by, F.concat_ws("\n", F.lit(head), F.transform("x", lambda x: x["line"])).alias("audit"))
