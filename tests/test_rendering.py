"""Reports against golden text and against a line-by-line version."""

import html

from pyspark.sql import functions as F

from factloom.operators import rendering as N

TASKS = "task_id string, company string, question string, summary string, risk_analysis string"
FACTS = "task_id string, fact_id string, source_id string, chunk_id string, claim string, metric_name string, status string, reason string, part string, pos int"
CITED = "task_id string, pos int, source_id string, chunk_id string, title string, url string"
DIFFER = "task_id string, pos int, metric string, period string, claims array<string>"


def reports(spark, tasks, facts, cited, differ):
    got = N.rendered(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(facts, FACTS), spark.createDataFrame(cited, CITED), spark.createDataFrame(differ, DIFFER))
    return {r["task_id"]: r for r in got.collect()}


def test_an_empty_task_says_what_is_missing(spark):
    got = reports(spark, [("e", "甲", "营收如何", None, None), ("r", "乙", "研发投入", "", " ")], [], [("r", 0, "s", "c", "T", " ")], [])
    assert got["e"]["title"] == "甲 - 企业公开信息研究报告"
    assert got["e"]["content"] == (
        "# 甲 公开信息研究报告\n\n**研究问题**：营收如何\n\n> 本报告仅依据本次采集的公开资料整理，不构成投资建议。\n\n## 总结\n本次采集的公开资料中，暂未找到可直接回答「营收如何」的甲数据。\n\n## 核心发现\n"
        "- 暂未找到与该问题直接对应的可核对数据，建议查看文末来源或调整问题措辞。\n\n## 风险观察\n- 暂未发现需要特别关注的风险点。\n\n## 公开资料来源\n- 当前没有可引用来源。\n\n## 附录\n- 暂无需要单独说明的核对异常。\n\n"
        "## 免责声明\n本报告基于公开资料生成，只用于信息研究，不构成投资建议。"
    )
    assert "- [1] T：无可打开 URL\n" in got["r"]["content"]
    assert got["r"]["content"].split("## 附录\n")[1].startswith("- 已采集公开资料来源，但尚未抽出足以支撑结论的结构化事实。\n- 问题涉及研发，但本次没有抽取到研发费用/投入类可核对数字。\n\n")


def test_a_full_report(spark):
    facts = [("t", f"f{i}", "s1" if i % 2 else "s2", "c1", f"事实{i}", "revenue", "verified" if i else "conflicted", None, "core", i) for i in range(12)]
    facts += [("t", f"g{i}", "s9", "c9", f"背景{i}（来源 3）", "x", "insufficient", None, "context", i) for i in range(7)]
    facts += [("t", f"h{i}", "s1", "c1", f"冲突{i}", "x", "conflicted", "两值" if i == 0 else None, None, 20 + i) for i in range(4)]
    facts += [("t", f"o{i}", "s1", "c1", f"旧{i}", "x", "outdated", None, None, i) for i in range(4)] + [("t", "z", "s1", "c1", "错", "x", "rejected", None, None, 0)]
    cited = [("t", 0, "s1", "c1", "年报", "http://a"), ("t", 1, "s2", "c1", "同一", " http://a "), ("t", 2, "s3", "c1", "无链", None), ("t", 3, "s2", "c1", "半年报", "http://b")]
    differ = [("t", i, "revenue_segment:储能" if i else "other", "unknown_period" if i else "2024", ["a（来源 1）", "期间未识别：b", "c", "d", "e"]) for i in range(8)]
    text = reports(spark, [("t", "甲", "收入", None, "# 风险\n- 原材料价格可能上涨并影响毛利水平\n")], facts, cited, differ)["t"]["content"]
    want = ["## 总结", "甲：事实0；事实1；事实2。", "", "## 核心发现", "- 事实0（口径不一致；来源 3）", "- 事实1（来源 1）"]
    assert text.split("\n")[6:12] == want
    core = text.split("## 核心发现\n")[1].split("\n\n")[0].split("\n")
    assert len(core) == 11 and core[-1] == "- 仅展示前 10 条核心发现；完整明细可在证据面板或 API 中查看。"
    context = text.split("## 补充背景\n")[1].split("\n\n")[0].split("\n")
    assert context[0] == "- 背景0（来源 3）" and len(context) == 7 and "前 6 条补充背景" in context[-1]
    assert text.split("## 风险观察\n")[1].split("\n\n")[0].split("\n") == [N.CLASH, "- 原材料价格可能上涨并影响毛利水平"]
    assert text.split("## 公开资料来源\n")[1].split("\n\n")[0].split("\n") == ["- [1] 年报：http://a", "- [2] 无链：无可打开 URL", "- [3] 半年报：http://b"]
    notes = text.split("## 附录\n")[1].split("\n\n")[0].split("\n")
    assert notes == [
        "- 数据核对：已采信 11 条，口径差异 5 条，证据不足 7 条，已排除 5 条。", "- 口径差异说明：", "  - other（2024）：a；b；c；d", *["  - 分业务收入（期间未识别）：a；b；c；d"] * 5, N.notice("口径差异", 6),
        "- 事实0：同一指标同一期间存在不同取值。 来源 3", "- 冲突0：两值 来源 1", "- 冲突1：同一指标同一期间存在不同取值。 来源 1", "- 冲突2：同一指标同一期间存在不同取值。 来源 1", N.notice("冲突条目", 4),
        *[f"- 旧{i}：来源或期间过时，未纳入主结论。" for i in range(3)], "- 错：已排除。",
    ]


def test_only_conflicts_and_verified_facts_without_core(spark):
    facts = [("a", "f", "s", "c", "甲乙", None, "conflicted", None, None, 0), ("b", "f", "s", "c", "研发费用 5亿元（来源 2）", None, "verified", None, None, 0)]
    got = reports(spark, [("a", "A", "研发", None, None), ("b", "B", "研发", None, None)], facts, [], [])
    assert N.CLASH_ALONE in got["a"]["content"] and N.NO_RISK not in got["a"]["content"] and N.NO_RD in got["a"]["content"]
    assert "B：研发费用 5亿元。" in got["b"]["content"] and N.NO_RD not in got["b"]["content"]


def test_exports(spark):
    title, body = "<b>&\"'", "</pre><script>x</script> & 'y'"
    row = spark.createDataFrame([(title, body)], "t string, b string").select(N.exported_html(F.col("t"), F.col("b")).alias("h"), N.exported_markdown(F.col("t"), F.col("b")).alias("m")).first()
    assert row["h"] == f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><pre>{html.escape(body)}</pre></body></html>"
    assert row["m"] == f"# {title}\n\n{body}\n"
