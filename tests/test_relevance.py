"""Facts that answer a question, and extraction that stops early, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import ranked as X
from factloom.operators import relevance as V

FACTS = "q string, fact_id string, metric_name string, claim string, period string, value string, confidence double, pos int"
YEAR = 2026


def one(spark, question, facts):
    rows = [("q", i, m, c, p, v, 0.9, n) for n, (i, m, c, p, v) in enumerate(facts)]
    got = V.relevant_facts(spark.createDataFrame([("q", question)], "q string, question string"), spark.createDataFrame(rows, FACTS), "q", YEAR).collect()
    return {part: [r["fact_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["part"] == part] for part in ("core", "supporting")}


REV, SEG, NP, RD = ("rev", "revenue", "营业收入", "2024", "100亿元"), ("seg", "revenue_segment:储能", "储能收入", "2024", "10亿元"), ("np", "net_profit_parent", "归母净利润", "2024", "20亿元"), ("rd", "R&D_expenditure", "研发费用", "2024", "5亿元")


@pytest.mark.parametrize(
    ("question", "facts", "core", "supporting"),
    [
        ("研发投入如何", [REV, RD], ["rd"], ["rev"]),
        ("收入结构", [SEG, NP], ["seg"], ["np"]),
        ("营业收入和净利润", [SEG, NP, REV], ["rev", "np"], ["seg"]),
        ("公司怎么样", [NP, REV], ["np", "rev"], []),
        ("收入利润", [("rev_small", "revenue", "c", "2024", "1亿元"), ("rev_large", "revenue", "c", "2024", "2亿元"), NP, ("rev_old", "revenue", "c", "2023", "9亿元"), ("rev_no", "revenue", "c", None, "99亿元")], ["rev_large", "np", "rev_old"], []),
        ("近三年净利润", [(f"p{y}", "net_profit", "c", str(y), "1亿元") for y in (2026, 2025, 2024, 2023, 2022)], ["p2025", "p2024", "p2023"], []),
        ("近 2 年净利润", [("a", "net_profit", "c", "2025", "1亿元"), ("b", "net_profit", "c", "2026", "1亿元")], ["b", "a"], []),
        ("产能扩张", [("cap", "production_capacity:电池", "c", "2024", "1GWh"), ("sales", "sales_volume", "c", "2024", "1万辆"), REV], ["cap", "sales"], ["rev"]),
        ("主营业务", [("industry", "industry", "c", None, "x"), ("scope", "operation_scope", "c", None, "x"), ("date", "established", "c", None, "x")], ["industry", "scope"], ["date"]),
    ],
)
def test_core_and_supporting_facts(spark, question, facts, core, supporting):
    assert one(spark, question, facts) == {"core": core, "supporting": supporting}


def plain(question, facts):
    """The same, fact by fact."""
    q = question.lower()
    wanted = {n for n, words in V.INTENTS.items() if any(w in q for w in words)}
    if "revenue_structure" in wanted:
        wanted.discard("revenue")
    if not wanted:
        return [f[1] for f in facts], []

    def score(f):
        m, c = (f[2] or "").lower(), f[3].lower()
        s = 2 * ("revenue" in wanted and (m == "revenue" or "营业收入" in c))
        for name, worth, starts, inside, words in V.POINTS:
            fits = any(m.startswith(x) for x in starts) or any(x in m for x in inside) or any(x in c for x in words)
            s += worth * (name in wanted and fits)
        return s

    def year(f):
        m = re.search(r"20\d{2}", f[4] or "")
        return int(m[0]) if m else 0

    def fam(f):
        m = (f[2] or "").lower()
        if m == "revenue" or not m:
            return m or "unknown"
        if "profit" in m:
            return "profit"
        return "rd" if m.startswith("r&d") else "revenue_segment" if m.startswith("revenue_segment") else m.split(":")[0] if m.startswith(V.CAPACITY + V.BUSINESS) else m

    def quality(f):
        m = re.search(r"\d+(?:\.\d+)?", (f[5] or "").replace(",", ""))
        factor = next((by for u, by in V.FACTORS if u in (f[5] or "")), 1)
        return 1e9 * (year(f) > 0) + (float(m[0]) * factor if m else 0) + (f[6] or 0)

    best = {}
    for f in facts:
        if score(f) >= 2:
            k = (fam(f), f[4] or "unknown_period")
            if k not in best or quality(f) > quality(best[k]):
                best[k] = f
    known = {fam(f) for f in best.values() if year(f)}
    left = [f for f in best.values() if year(f) or fam(f) not in known]
    place = lambda f: next((i for i, (n, ms) in enumerate(V.PLACES) if n in wanted and fam(f) in ms), 9)
    left.sort(key=lambda f: (-year(f), place(f), -quality(f)))
    w = re.search(r"近(\d{1,2})年", question)
    if w:
        n = max(1, min(int(w[1]), 10))
        done = [f for f in left if 0 < year(f) < YEAR]
        latest = sorted({year(f) for f in done}, reverse=True)[:n]
        if done and len(latest) >= min(n, 2):
            left = [f for f in done if year(f) in latest]
    return [f[1] for f in left], [f[1] for f in facts if score(f) < 2]


def test_against_a_loop_over_facts(spark):
    r = random.Random(8)
    questions = {f"q{i}": r.choice(["近3年收入", "净利润和研发", "收入结构", "产能", "风险", "主营业务和收入", "怎么样", "近1年利润"]) for i in range(20)}
    facts = []
    for n in range(600):
        metric = r.choice(["revenue", "net_profit", "R&D_total_spending", "revenue_segment:a", "production_capacity:b", "industry", None, "other"])
        facts.append((r.choice(list(questions)), f"f{n}", metric, r.choice(["c", "营业收入", "风险 波动", "产品"]), r.choice(["2026", "2025", "2024年", "2023", "", None, "x"]), r.choice(["1亿元", "3,000万元", "2", None]), r.choice([0.5, 1.0, None]), n))
    got = V.relevant_facts(spark.createDataFrame(list(questions.items()), "q string, question string"), spark.createDataFrame(facts, FACTS), "q", YEAR).collect()
    for q, question in questions.items():
        parts = tuple([r["fact_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["q"] == q and r["part"] == part] for part in ("core", "supporting"))
        assert parts == plain(question, [f for f in facts if f[0] == q]), question


def test_extraction_stops_where_a_sequence_would(spark):
    r = random.Random(9)
    wanted = {f"t{i}": (["profit"], True) if i % 3 else ([], False) for i in range(12)} | {"none": (["rd"], True)}
    chunks = []
    for t in wanted:
        for n in range(0 if t == "none" else r.randint(1, 16)):
            text = r.choice(["利润 fact:net_profit", "收入 fact:revenue", "费用", "nothing fact:net_profit"])
            chunks.append((t, f"{t}-{n}", text, [r.choice([0.1, 0.5, 0.9]), 0.3], n))
    groups = spark.createDataFrame([(t, [1.0, 0.0], f, s) for t, (f, s) in wanted.items()], "task_id string, vector array<double>, wanted array<string>, strict boolean")
    table = spark.createDataFrame(chunks, "task_id string, chunk_id string, text string, vector array<double>, pos int")
    calls = []

    def extract(df):
        calls.append(1)
        metric = F.regexp_extract("text", "fact:(.+)", 1)
        return df.select("task_id", "chunk_id", metric.alias("metric_name"), F.lit("").alias("claim")).where("metric_name <> ''")

    facts, attempts = X.ranked_extraction(groups, table, extract)
    want, found = {}, set()
    for t, (families, strict) in wanted.items():
        ranked = sorted((c for c in chunks if c[0] == t and re.search(X.FINANCIAL, c[2])), key=lambda c: (-c[3][0] / (c[3][0] ** 2 + 0.09) ** 0.5, c[4]))[:10]
        want[t] = (0, False)
        for i, c in enumerate(ranked, 1):
            got = c[2].partition("fact:")[2]
            want[t] = (i, bool(got) and (got == "net_profit" or not (strict and families)))
            if got:
                found.add((t, c[1], got))
            if want[t][1]:
                break
    assert {r["task_id"]: (r["attempts"], r["matched"]) for r in attempts.collect()} == want
    assert {(r["task_id"], r["chunk_id"], r["metric_name"]) for r in facts.collect()} == found
    assert len(calls) == max(n for n, _ in want.values())
