"""Rows that hold in the studied semantics, written by hand: time filters and scopes, bad answers, grounded sections, report structure."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import compliance as C
from factloom.operators import sections as R
from factloom.operators import selection as A


def kept(spark, periods, **how):
    rows = [("c", p, i) for i, p in enumerate(periods)]
    got = A.time_filter(spark.createDataFrame(rows, "company string, period string, pos int"), "company", (2024, 2023), **{"strict": False, **how}).collect()
    return [r["period"] for r in sorted(got, key=lambda r: r["pos"])]


@pytest.mark.parametrize("how", [{}, {"strict": True}, {"trend": True, "window": 3}, {"window": 1}])
def test_nothing_in_the_window_keeps_all(spark, how):
    assert kept(spark, ["2019", "2018", "2017"], **how) == ["2019", "2018", "2017"]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({"strict": True}, ["2024", "unknown", None]),
        ({"window": 1}, ["2024", "unknown", None]),
        ({"trend": True, "window": 3}, ["2024", "unknown", None]),
        ({"trend": True}, ["2018", "2024", "unknown", None]),
        ({}, ["2018", "2024", "unknown", None]),
    ],
)
def test_facts_without_a_year_count_as_inside_and_the_first_other_stays(spark, how, want):
    assert kept(spark, ["2018", "2024", "unknown", None, "2019"], **how) == want


def test_no_preferred_years_keep_all(spark):
    rows = spark.createDataFrame([("c", "2019", 1)], "company string, period string, pos int")
    assert A.time_filter(rows, "company", (), strict=True).count() == 1


@pytest.mark.parametrize(
    ("question", "years", "window", "strict"),
    [
        ("近一年的利润", (), 1, False), ("近一年利润", (), 1, False), ("过去一年净利润", (), 1, False), ("去年利润", (), 1, False), ("近三年研发投入", (), 3, False),
        ("仅看近一年净利润", (), 1, True), ("2024年净利润是多少", (2024,), None, True), ("2023与2024年净利润对比", (2023, 2024), None, False),
        ("近一年营收，不要历年数据", (), 1, True), ("近三年营收，不要历年数据", (), 3, False), ("近一年，不要看多年", (), 1, True), ("2022、2023和2024年", (2022, 2023, 2024), None, False),
    ],
)
def test_scopes(question, years, window, strict):
    assert A.time_scope(question) == A.TimeScope(years, window, strict)


def test_scope_helpers(spark):
    assert A.time_scope("公司主要业务是什么") is None and A.TimeScope((), 1, False).preferred(2026) == (2025,)
    row = spark.range(1).select((A.scope_rank(F.lit("2025"), (2025,)) < A.scope_rank(F.lit("2022"), (2025,))).alias("before")).first()
    assert row["before"]


@pytest.mark.parametrize(
    ("answer", "bad"),
    [
        ("Verified, but insufficient", False), ("verified, but insufficient", True), ("CONFLICTED and INSUFFICIENT", False), ("核心发现如下", False), ("核心发现与证据缺口", True), ("报告中没有该数据", True),
        ("it DOES  NOT contain", True), ("no database", False), ("", False), (None, False), ("属于常规公开信息", True),
    ],
)
def test_bad_answers(spark, answer, bad):
    assert spark.createDataFrame([(answer,)], "t string").select(C.ungrounded(F.col("t")).alias("bad")).first()["bad"] is bad


EVIDENCE = "q string, source_id string, chunk_id string, source_title string, url string, layer string, credibility double, score double, pos int, text string"


def test_grounded_sections(spark):
    rows = [
        ("a", "s1", "c1", "甲", "u1", "blog", 0.9, 0.9, 0, "  first\nline  "), ("a", "s2", "c2", "乙", None, "official_pdf", None, 0.1, 1, "x" * 301), ("a", "s1", "c1", "甲", "u1", "blog", 0.9, 0.9, 2, "建议买入 now"),
        ("a", "s3", "c3", "丙", None, "blog", 0.1, 0.9, 3, "never shown"),
    ]
    asked = spark.createDataFrame([("a", " 研发? "), ("b", "产能")], "q string, query string")
    got = {r["q"]: r for r in A.grounded_sections(asked, spark.createDataFrame(rows, EVIDENCE), "q").collect()}
    assert got["a"]["content"].split("\n") == ["与问题「研发?」相关的公开资料摘录如下（供回查，不构成结论）：", "", f"1. 《乙》：{'x' * 300}...", "2. 《甲》：first line", "3. 《甲》：建议【已移除】 now", "", "以上摘自原始披露片段，是否采纳须结合上文核对结果判断。"]
    assert [(c["source_id"], c["chunk_id"]) for c in got["a"]["citations"]] == [("s2", "c2"), ("s1", "c1")]
    assert "证据不足" in got["b"]["content"] and got["b"]["citations"] == []
    none = A.grounded_sections(asked, spark.createDataFrame(rows, EVIDENCE), "q", top=0).where("q = 'a'").first()
    assert none["content"] == "围绕问题“研发?”，当前未选入可展示的证据摘录。"


@pytest.mark.parametrize(("query", "title"), [("  ", "甲"), ("该买入吗", "甲"), ("产能", "目标价上调")])
def test_grounded_sections_fail_closed(spark, query, title):
    asked = spark.createDataFrame([("a", query)], "q string, query string")
    rows = spark.createDataFrame([("a", "s", "c", title, None, "blog", 0.5, 0.5, 0, "text")], EVIDENCE)
    with pytest.raises(Exception, match="blank|forbidden"):
        A.grounded_sections(asked, rows, "q").collect()


def by_loop(text):
    """Sections, line by line."""
    out, title, held = [], "正文", []
    for line in text.split("\n"):
        m = re.match(R.HEADING, line.strip())
        if m:
            if held:
                out.append((title, "\n".join(held)))
            title, held = m[2].strip(), []
        else:
            held.append(line)
    return out + ([(title, "\n".join(held))] if held else [])


REPORT = "前言\n\n第一节 总览\n营收 2024 年\n 二、 风险 \n第三节\n第四节 空\n第五节 长\n" + "\n".join(f"行{i}" for i in range(60)) + "\n十一、末\n"


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_sections_equal_a_loop_over_lines(spark, block):
    texts = {"a": REPORT, "b": "", "c": "第一节 只有标题", "d": "\n".join(f"第{'一二三四五六七八九十'[i % 10]}节 标题{i}\n内容{i}" for i in range(30))}
    lines = R.report_lines(spark.createDataFrame(list(texts.items()), "report_id string, text string"), "report_id", "text")
    got = {}
    for r in sorted(R.section_texts(lines, block=block).collect(), key=lambda r: r["section_no"]):
        got.setdefault(r["report_id"], []).append((r["title"], r["content"]))
    assert got == {k: s for k, t in texts.items() if (s := by_loop(t))}
    short = {}
    for r in sorted(R.section_texts(lines, most=12, chars=40, block=block).collect(), key=lambda r: r["section_no"]):
        short.setdefault(r["report_id"], []).append((r["title"], r["content"]))
    assert short == {k: [(t, c[:40]) for t, c in v[:12]] for k, v in got.items()}


@pytest.mark.parametrize("block", [1, 4096])
def test_sections_cut_at_a_line_break_keep_it(spark, block):
    text = "第一节 总览\nabc\n\nde\n第二节 长\n\nf"
    lines = R.report_lines(spark.createDataFrame([("a", text)], "report_id string, text string"), "report_id", "text").cache()
    for chars in (4, 5):
        got = [(r["title"], r["content"]) for r in R.section_texts(lines, chars=chars, block=block).orderBy("section_no").collect()]
        assert got == [(t, c[:chars]) for t, c in by_loop(text)]


def test_report_headers(spark):
    rows = [(1, "2023年末 2024 年度报告 单位：元 单位: 万元\n审计机构： 某某所 \n"), (2, "2024年"), (3, None), (4, "2022年报\n单位：  亿元")]
    got = {r["id"]: (r["year"], r["auditor"], r["unit_note"]) for r in R.report_header(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert got == {1: ("2024", "某某所", "单位: 万元"), 2: (None, None, None), 3: (None, None, None), 4: ("2022", None, "单位：  亿元")}


def test_enriched_sources(spark):
    rows = [("a", "raw", "2024年报\n第一节 总览\n内容"), ("b", "raw b", None), ("c", None, "")]
    tables = [("a", i, "" if i == 2 else f"| t{i} |") for i in range(9)]
    got = {r["id"]: r["text"] for r in R.enriched_text(spark.createDataFrame(rows, "id string, raw string, parsed string"), "id", "raw", "parsed", spark.createDataFrame(tables, "id string, table_no int, markdown string")).collect()}
    want = "\n".join(["raw", "\n\n# 财报结构化解析\n报告年度：2024", "\n## 正文\n2024年报", "\n## 总览\n内容", *(f"\n| t{i} |" for i in (0, 1, 3, 4, 5, 6))])
    assert got["a"] == want and got["b"] == "raw b" and got["c"].startswith("\n\n\n# 财报结构化解析\n报告年度：未知")
