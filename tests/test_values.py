"""Values of operators that no query covers."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from factloom.operators import chat, enrichment, evaluation, extraction, memory, model_output, report
from factloom.sources import scans


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sources_that_facts_may_come_from(spark):
    df = spark.createDataFrame([("a", "official_entry_page", 0.9), ("b", "official_pdf", 0.1), ("c", None, None), ("d", "official_pdf", 0.96)], "id string, layer string, credibility double")
    assert rows(extraction.eligible(df), "id") == [("c",), ("d",)]


def test_audit_section(spark):
    df = spark.createDataFrame([("t", 2, "second", {}), ("t", 1, "first", {"verified": 2, "conflicted": 1, "odd": 3})], "task string, pos int, message string, status_counts map<string,int>")
    text = report.audit_section(df, "task").first()["audit"]
    assert text == "\n\n## 附录：处理记录\n\n以下记录用于解释为什么某些内容没有形成结论。\n- first\n- 校验统计：口径不一致 1 条；线索待补证 3 条；已核对 2 条\n- second"


def test_followup_context_and_prompt(spark):
    facts = spark.createDataFrame([("t", 2, "profit", "2024", "1亿元", "verified"), ("t", 1, "revenue", "2024", None, "conflicted")], "task string, pos int, metric_name string, period string, value string, status string")
    options = spark.createDataFrame([("u", "revenue", "2024", ["a", "b"])], "task string, metric_name string, period string, options array<string>")
    cited = spark.createDataFrame([("t", i, f"T{i}", None if i else "http://x") for i in range(10)], "task string, pos int, title string, url string")
    got = {r["task"]: r for r in chat.followup_context(facts, options, cited, "task").collect()}
    assert got["t"]["facts_json"].startswith('[{"metric_name":"revenue"') and '"value":"1亿元"' in got["t"]["facts_json"] and got["t"]["ambiguities_json"] == "[]"
    assert got["t"]["citations"] == ["[1] T0 http://x", *[f"[{i + 1}] T{i}" for i in range(1, 8)]]
    assert got["u"]["facts_json"] == "[]" and got["u"]["citations"] == [] and '"options":["a","b"]' in got["u"]["ambiguities_json"]
    df = spark.createDataFrame([("甲", "多少?", "# x\n## 总结\n" + "长" * 30 + "\n## y\nz")], "c string, m string, r string")
    context = {"facts_json": F.lit("[1]"), "ambiguities_json": F.lit("[]"), "citations": F.array(F.lit("[1] T"))}
    prompt = df.select(chat.followup_prompt(F.col("c"), F.col("m"), F.col("r"), context, "规则", 10).alias("p")).first()["p"]
    assert prompt == "规则\n企业：甲\n用户追问：多少?\n" + "长" * 10 + "...\n[1]\n[]\n[1] T"


def test_prompts_made_facts_and_merging(spark):
    chunks = spark.createDataFrame([("t", "s", f"c{i:02}", f" text {i} ", i) for i in range(40)], "task string, source_id string, chunk_id string, text string, pos int")
    prompt = model_output.extraction_prompt(chunks, "task", "Extract.").first()["prompt"].split("\n")
    assert prompt[0] == "Extract." and prompt[1] == "[s/c00] text 0" and len(prompt) == 1 + model_output.PROMPT_CHUNKS
    made = model_output.mock_facts(chunks.where("pos < 2"), F.lit("甲"), "task")
    assert rows(made, "chunk_id", "claim", "confidence") == [("c00", "甲 公开资料片段#1提到研发与经营风险信息", 0.75), ("c01", "甲 公开资料片段#2提到研发与经营风险信息", 0.75)]
    best = model_output.ranked_chunks(chunks, "task", F.col("pos") % 7, ("TEXT 1", "text 3"), most=3)
    assert rows(best, "rank", "chunk_id") == [(1, "c13"), (2, "c34"), (3, "c12")]
    kind = "source_id string, metric_name string, period string, value string, by string"
    rules, model = spark.createDataFrame([("s", "m", "p", "1", "rule")], kind), spark.createDataFrame([("s", "m", "p", "1", "model"), ("s", "m", "p", "2", "model")], kind)
    assert rows(model_output.merged_facts(rules, model), "value", "by") == [("1", "rule"), ("2", "model")]


def test_company_codes(spark):
    df = spark.createDataFrame([("600000", "浦发银行"), ("000001", "平安银行"), ("830000", "银行科技"), ("300750", "宁德时代")], "code string, name string")
    code = lambda asked: rows(scans.company_code(df, asked), "code", "exchange")
    assert code("宁德时代") == [("300750", "szse")] and code("600000") == [("600000", "sse")] and code("银行") == [("000001", "szse")]
    assert code("银行科技股份有限公司") == [("830000", "bse")] and code("无此公司") == []


def test_summaries_and_shares(spark):
    one = spark.range(1).select(report.risk_summary({"已核对": F.lit(2), "口径不一致": F.lit(0)}, F.array(*[F.lit(f"c{i}") for i in range(7)])).alias("s")).first()["s"]
    assert one == "校验状态：已核对 2 条，口径不一致 0 条。\n1. c0\n2. c1\n3. c2\n4. c3\n5. c4"
    fused = spark.createDataFrame([("q", "a", 1), ("q", "b", 11), ("r", "c", 11), ("x", "a", 1)], "query string, item string, rank int")
    wanted = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("s", "d")], "query string, item string")
    assert evaluation.hit_rate(fused, wanted, "query", "item").first()[0] == 0.333333
    done = spark.createDataFrame([("## A\n## B", ["## A", "## B"]), ("## A", ["## B"]), ("", [])], "content string, required array<string>")
    assert evaluation.section_completeness(done).first()[0] == 0.666667


def test_memory_operations_by_rule(spark):
    df = spark.createDataFrame([("关注现金流，简洁",), ("请简洁",), ("你好",), (None,)], "t string").select(memory.extracted_operation(F.col("t")).alias("o"))
    assert [tuple(r["o"]) for r in df.collect()] == [("ADD", "risk_focus", "focus", "现金流风险"), ("ADD", "user_preference", "report_style", "简洁"), ("NOOP", None, None, None), ("NOOP", None, None, None)]


def test_stages_apply_where_they_are_supported(spark):
    steps = [(lambda df: "missing" in df.columns, lambda df: df.drop("id")), (lambda df: "id" in df.columns, lambda df: df.withColumn("x", F.col("id") + 1)), (lambda df: "x" in df.columns, lambda df: df.select("x"))]
    assert enrichment.stages(spark.range(1), steps).collect()[0].asDict() == {"x": 1}
    broken, failed = [(lambda df: True, lambda df: df.select("nowhere")), *steps], []
    assert enrichment.stages(spark.range(1), broken, failed).collect()[0].asDict() == {"x": 1} and len(failed) == 1
    with pytest.raises(AnalysisException):
        enrichment.stages(spark.range(1), broken)


def test_scopes_that_a_model_wrote():
    from factloom.operators.selection import TimeScope, scope_of_answer

    assert scope_of_answer('```json\n{"window_years": 3, "explicit_years": [2023, "x", 1800], "strict": true}\n```') == TimeScope((2023,), 3, True)
    assert scope_of_answer(' {"window_years": "20"} ') == TimeScope((), 10, False)
    assert scope_of_answer("```\nno\n```") is None and scope_of_answer("[1]") is None and scope_of_answer("{}") is None and scope_of_answer("") is None


def test_citations_of_facts(spark):
    from factloom.operators.selection import fact_citations

    facts = spark.createDataFrame([("t", "s1", "c1", 3), ("t", "s1", "c1", 1), ("t", "s2", "c2", 0), ("t", "gone", "c1", 2), ("t", "s1", "gone", 4)], "task string, source_id string, chunk_id string, pos int")
    sources = spark.createDataFrame([("t", "s1", "u", "T"), ("t", "s2", None, "S"), ("x", "gone", "u", "X")], "task string, source_id string, url string, title string")
    chunks = spark.createDataFrame([("t", "c1"), ("t", "c2")], "task string, chunk_id string")
    assert rows(fact_citations(facts, sources, chunks, "task"), "pos", "source_id", "chunk_id", "title") == [(0, "s2", "c2", "S"), (1, "s1", "c1", "T")]


def test_answers_with_and_without_facts(spark):
    asked = spark.createDataFrame(
        [("a", "甲", "营收", "direct", [], 0), ("b", "甲", "营收", "trend", ["缺 2022 年", "已有。"], 8), ("c", "乙", "研发", "direct", [], 9), ("d", "乙", "研发", "direct", ["缺 2021 年", "缺 2022 年"], 0), ("e", "甲", "营收", "trend", None, 7)],
        "q string, company string, question string, mode string, gap_notes array<string>, n_conflicted int",
    )
    ranked = spark.createDataFrame([("a", "2024年营收1亿元", "2024", 1), ("b", "2024年营收2亿元", "2024", 1), ("b", "2023年营收1亿元", "2023", 2), ("e", "2024年营收1亿元", "2024", 1)], "q string, claim string, period string, rank int")
    got = {r["q"]: r["answer"] for r in report.composed_answers(asked, ranked, "q").collect()}
    assert got["a"] == got["e"] == "针对「营收」，甲：2024年营收1亿元。"
    assert got["b"] == "针对「营收」，甲：从已核对条目看，2023 → 2024 年间相关数据为：2023年营收1亿元；2024年营收2亿元。缺 2022 年。已有。" + report.DIFFERENCES
    assert got["c"] == "本次采集的公开资料中，暂未找到可直接回答「研发」的乙数据。" + report.NARROW
    assert got["d"] == "本次采集的公开资料中，暂未找到可直接回答「研发」的乙数据。缺 2021 年；缺 2022 年"


def test_purge_hides_a_task_in_every_output(spark, tmp_path):
    from factloom.operators.tasks import mock_embedding_id
    from factloom.sources.commits import VersionedTable
    from factloom.sources.tables import purge

    tables = {n: VersionedTable(spark, f"file://{tmp_path}/{n}", "id string, task_id string", "id") for n in ("sources", "reports", "other")}
    for t in tables.values():
        t.upsert(spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], t.schema))
    old = tables["sources"].read(1)
    assert list(purge(tables, "a")) == ["reports", "sources"]
    assert [rows(t.read(), "id") for t in tables.values()] == [[("2",), ("3",)], [("2",), ("3",)], [("1",), ("2",), ("3",)]] and old.count() == 3
    assert spark.range(1).select(mock_embedding_id(F.lit(" x ")).alias("i")).first()["i"] == "mock-emb-v1-dim8-2d711642b726"
