"""Follow-up chat over a report: guards, context, prompt, and the chain of fallbacks, as columns over a batch of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.operators import compliance as C
from factloom.operators.model_output import cut
from factloom.operators.report import report_section

#: The refusal of advice, words of an advising tone, and limits of a follow-up.
REFUSAL = "当前问题涉及投资建议或个性化投融导向，已按合规策略拒绝。系统仅支持基于公开资料的经营与风险分析。请改写为：财务变化、研发投入、信息披露、供应链与经营风险等中性问题。"
TONE = ("强烈建议", "必买", "稳赚", "目标价", "买入时机", "卖出时机", "推荐配置")
MOST_CITATIONS, BRIEF, FALLBACK_BRIEF, HOT, KEPT = 8, 1200, 220, 6, 20


def refused(question: Column, lexicon: C.Lexicon = C.LEXICON) -> Column:
    """The refusal of a question that asks for advice, else null; milder findings pass."""
    return F.when(C.action(C.hits(question, lexicon)) == "refuse", REFUSAL)


def tone(text: Column, lexicon: C.Lexicon = C.LEXICON) -> Column:
    """blocked, rewritable or passed."""
    action = C.action(C.hits(text, lexicon))
    advising = F.lit(False)
    for w in TONE:
        advising = advising | F.contains(F.lower(text), F.lit(w))
    return F.when(action == "refuse", "blocked").when((action == "rewrite") | advising, "rewritable").otherwise("passed")


def followup_context(facts: DataFrame, ambiguities: DataFrame, citations: DataFrame, by: str) -> DataFrame:
    """(by, facts_json, ambiguities_json, citations): ranked facts (pos, metric_name, period, value, status) and options as JSON, the first citations (pos, title, url) as lines."""
    f = facts.groupBy(by).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "metric_name", "period", "value", "status"))), lambda x: x.dropFields("pos"))).alias("facts_json"))
    a = ambiguities.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct("metric_name", "period", "options")))).alias("ambiguities_json"))
    first = citations.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("n") <= MOST_CITATIONS)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "title", F.coalesce(F.concat(F.lit(" "), "url"), F.lit("")))
    c = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x")).select(by, F.transform("x", lambda x: x["line"]).alias("citations"))
    out = f.join(a, by, "full").join(c, by, "full")
    return out.select(by, F.coalesce("facts_json", F.lit("[]")).alias("facts_json"), F.coalesce("ambiguities_json", F.lit("[]")).alias("ambiguities_json"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))


def followup_prompt(company: Column, message: Column, report: Column, context: dict[str, Column], rules: str, limit: int = BRIEF) -> Column:
    """Prompt of a follow-up: rules, question, the report's summary (else its text) cut to `limit`, facts, options and citations."""
    summary = report_section(report, "总结")
    brief = cut(F.when(summary != "", summary).otherwise(F.replace(strip(report), F.lit("\n"), F.lit(" "))), limit)
    parts = [F.lit(rules), F.concat(F.lit("企业："), company), F.concat(F.lit("用户追问："), message), brief, context["facts_json"], context["ambiguities_json"], F.array_join(context["citations"], "\n")]
    return F.concat_ws("\n", *parts)


def followup_answer(company: Column, message: Column, report: Column, model: Column, composed: Column) -> Column:
    """The model's answer, else the one composed from facts, else the report's summary, else its beginning."""
    summary, text = report_section(report, "总结"), F.replace(strip(report), F.lit("\n"), F.lit(" "))
    told = F.concat(F.lit("关于「"), message, F.lit("」：" ), summary, F.lit(" 更完整的条目与来源见当前报告正文。"))
    brief = F.concat(F.lit("关于「"), message, F.lit("」，根据当前「"), company, F.lit("」研究报告："), cut(text, FALLBACK_BRIEF), F.lit(" 若需某一年份或具体指标，可在报告中查看「核心发现」与对应来源。"))
    return F.coalesce(model, F.nullif(composed, F.lit("")), F.when(summary != "", told), brief)


def chat(messages: DataFrame, answer: Column, fallback: Column, lexicon: C.Lexicon = C.LEXICON) -> DataFrame:
    """Messages (text) with `reply` and `outcome`: refused, allow, rewrite or refuse by the output guard, or fallback where an answer left its report."""
    no = refused(F.col("text"), lexicon)
    rows = messages.withColumns({"no": no, "said": answer, "instead": fallback}).withColumn("bad", C.ungrounded(F.col("said")))
    rows = rows.withColumn("said", F.when(F.col("bad"), F.col("instead")).otherwise(F.col("said"))).withColumn("found", C.hits(F.col("said"), lexicon))
    outcome = F.when(F.col("no").isNotNull(), "refused").when(C.action(F.col("found")) != "allow", C.action(F.col("found"))).when(F.col("bad"), "fallback").otherwise("allow")
    reply = F.coalesce("no", C.applied(F.col("said"), F.col("found")))
    return rows.withColumns({"reply": reply, "outcome": outcome}).drop("no", "said", "instead", "bad", "found")


def memory_context(messages: DataFrame, memories: DataFrame, session: str, order: str, user: str) -> tuple[DataFrame, DataFrame]:
    """(session, hot) of the last messages (role, text) in order, and (user, layer, pos, memory_key, value) of the newest active memories per layer."""
    last = messages.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("n") <= HOT)
    hot = last.groupBy(session).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.concat_ws(": ", "role", "text").alias("line")))).alias("x"))
    place = F.row_number().over(Window.partitionBy(user, "layer").orderBy(F.desc("updated_at"), "memory_key"))
    kept = memories.where("is_active AND layer IN ('warm', 'cold')").withColumn("pos", place).where(F.col("pos") <= KEPT)
    return hot.select(session, F.transform("x", lambda x: x["line"]).alias("hot")), kept.select(user, "layer", "pos", "memory_key", "value")
