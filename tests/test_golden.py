"""Golden rows of extraction, time scope, selection, model answers and settings, written by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import chat as H
from factloom.operators import extraction as X
from factloom.operators import model_output as O
from factloom.operators import search as S
from factloom.operators import selection as A
from factloom.operators import tasks as K
from factloom.functions import text as T
from factloom.sources import scans


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024年营业总收入411.87亿元，归母净利润51.53亿元，研发费用3.14亿元。", {("revenue", "411.87亿元", "2024"), ("net_profit_parent", "51.53亿元", "2024"), ("R&D_expenditure", "3.14亿元", "2024")}),
        ("2024年，样例股份研发投入超200亿元；2025年半年报显示研发投入309亿元。", {("R&D_total_spending", "200亿元", "2024"), ("R&D_total_spending", "309亿元", "2025")}),
        ("2024年营业收入约人民币634亿元", {("revenue", "634亿元", "2024")}),
        ("2024年营收超过100亿元", {("revenue", "100亿元", "2024")}),
        ("2024年净利润实现5亿元", {("net_profit", "5亿元", "2024")}),
        ("2024年公司累计投入研发费用30亿元", set()),
    ],
)
def test_rules(text, expected):
    assert {(m, v, p) for m, v, p, _, _ in X.extract(text)} == expected


def test_batches_keep_texts_apart():
    table = "单位：万元\n项目 2024年 2023年\n营业收入 500,000 400,000\n"
    bare = "营业收入 700,000 600,000\n"
    assert X.extract_all([table, bare, None, table]) == [X.extract(table), X.extract(bare), [], X.extract(table)]
    assert [f[:3] for f in X.extract(table)] == [("revenue", "500000万元", "2024"), ("revenue", "400000万元", "2023")] and X.extract(bare) == []


@pytest.mark.parametrize(
    ("question", "years", "window", "strict"),
    [
        ("近一年的利润", (), 1, False), ("过去一年净利润", (), 1, False), ("过去1年净利润", (), 1, False), ("去年利润", (), 1, False), ("上年利润", (), 1, False), ("本报告期营收", (), 1, False), ("最新年报", (), 1, False),
        ("近三年研发投入", (), 3, False), ("最近12年", (), 10, False), ("仅看近一年净利润", (), 1, True), ("2024年净利润是多少", (2024,), None, True), ("2023与2024年净利润对比", (2023, 2024), None, False),
        ("2021、2022、2023年营收", (2021, 2022, 2023), None, False), ("2021、2022、2023年营收，不要其他年份", (2021, 2022, 2023), None, True),
    ],
)
def test_time_scopes(question, years, window, strict):
    assert A.time_scope(question) == A.TimeScope(years, window, strict)


def test_model_scopes():
    assert A.valid_scope("30", ["2024", 1800, "x", 2024], 1) == A.TimeScope((2024,), 10, True)
    assert A.valid_scope(None, "2024", True) is None
    assert A.lookback_years(None) == 4 and A.lookback_years(A.TimeScope((), 1, False)) == 2


def test_model_answers(spark):
    got = spark.createDataFrame([("二零二五年",), ("2023年度",), ("上半年",), (None,)], "p string").select(O.model_period(F.col("p")).alias("p")).collect()
    assert [r.p for r in got] == ["2025", "2023", "上半年", None]
    facts = '{"facts": [{"claim": "a", "metric_name": "营收", "value": "1", "period": "2024年", "source_id": "s", "chunk_id": "c", "confidence": 0.7}, {"claim": "b", "source_id": "s", "chunk_id": "other"}]}'
    answers = spark.createDataFrame([(1, facts), (2, "no json"), (3, None)], "task long, answer string")
    chunks = spark.createDataFrame([(1, "s", "c"), (2, "s", "c")], "task long, source_id string, chunk_id string")
    assert [(r.metric_name, r.period, r.confidence) for r in O.parsed_facts(answers, chunks, "task").collect()] == [("revenue", "2024", 1.0)]
    assert [(r.metric_name, r.period, r.confidence) for r in O.parsed_facts(answers, chunks, "task", normalised=False).collect()] == [("营收", "2024年", 0.7)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(['data: {"choices":[{"delta":{"content":"ab"}}]}', ": ping", 'data: {"choices":[{"delta":{"content":"c"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"z"}}]}'])], "task long, n int, line string")
    assert [r.text for r in O.streamed_text(lines, "task", "n", "line").collect()] == ["abc"]


def test_followups(spark):
    report = "# r\n\n## 总结\n营收增长。\n\n## 附录\nx"
    rows = spark.createDataFrame([("模型", "", report), (None, "组合", report), (None, "", report), (None, "", "正文\n" + "长" * 300)], "model string, composed string, report string")
    said = [r.a for r in rows.select(H.followup_answer(F.lit("甲"), F.lit("问"), F.col("report"), F.col("model"), F.col("composed")).alias("a")).collect()]
    assert said[:3] == ["模型", "组合", "关于「问」：营收增长。 更完整的条目与来源见当前报告正文。"] and "长..." in said[3]
    assert spark.range(1).select(O.cut(F.lit("abc"), 2), O.cut(F.lit("abc"), 0)).first()[:] == ("ab...", "")
    tones = spark.createDataFrame([("可以买入",), ("稳赚",), ("强烈建议关注",), ("营收",)], "t string").select(H.tone(F.col("t")).alias("t")).collect()
    assert [r.t for r in tones] == ["blocked", "rewritable", "rewritable", "passed"]


def test_family_rank_and_risk_lines(spark):
    facts = spark.createDataFrame([("revenue", "营收", 1), ("R&D_expenditure", "研发", 2), ("x", "y", 3)], "metric_name string, claim string, pos int")
    wanted = F.array(F.lit("rd"), F.lit("revenue"))
    assert [r.k for r in facts.orderBy("pos").select(A.family_rank(F.col("metric_name"), F.col("claim"), wanted).alias("k")).collect()] == [1, 0, 9]
    text = "请注意以下内容仅供参考使用。\n据公司年报显示研发投入持续增长。\n根据您的要求，略\n供应链集中度较高带来经营风险。"
    got = A.risk_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    assert [r.line for r in got] == ["供应链集中度较高带来经营风险。"]


def test_focus_windows(spark):
    text = "a" * 100 + "KEY" + "b" * 100 + "the" + "c" * 100
    got = spark.createDataFrame([("short",), (text,), (None,)], "t string").select(scans.focus_windows(F.col("t"), ("KEY", "the"), most=80, head=20, before=5, after=20).alias("f")).collect()
    assert [r.f for r in got] == ["short", "a" * 20 + "\n\n" + "a" * 5 + "KEY" + "b" * 17 + "\n\n" + "b" * 5 + "the" + "c" * 17, ""]


def test_chunks_of_long_texts_are_linear(spark):
    text = "".join(chr(0x4E00 + i % 500) if i % 7 else "😀" for i in range(200_000))
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(T.chunk_windows(F.col("t"), 400, 300)).alias("c")).select("c.*").collect()
    assert len(got) == 1997 and all(r.text == text[r.char_start : r.char_end] for r in got)


def test_bm25_scans_documents_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = S.bm25(docs, spark.createDataFrame([(1, "the")], "item_id long, text string"), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{sf_dir}/documents.parquet") == 0 and "NestedLoop" not in plan


def test_settings():
    s = K.Settings({"key": "", "top": 3}, keys_needed={"remote": "key"})
    s.override("top", 5)
    assert s.effective("top") == 5 and s.provider("mock") == "mock"
    with pytest.raises(ValueError, match="needs"):
        s.provider("remote")
