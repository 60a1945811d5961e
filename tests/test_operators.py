"""Golden rows, edge cases and properties of single operators."""

import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V
from factloom.operators import chunking as K
from factloom.operators import compliance as C
from factloom.operators import extraction as X
from factloom.operators import memory as M
from factloom.operators import search as S
from factloom.operators import selection as A
from factloom.sources import scans


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(values[n], float) else 'long' if isinstance(values[n], int) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("value", "key"),
    [("1,234.50 万元", "money:12345000:yuan"), ("12亿", "money:1200000000:yuan"), ("3.0GWh", "energy:3000:MWh"), ("3 mwh", "energy:3:MWh"), ("12.50%", "ratio:12.5:percent"), ("5万辆", "vehicle:50000:vehicle"), (" Sta, ble", "stable"), ("", ""), (None, "")],
)
def test_value_key(spark, value, key):
    assert one(spark, V.value_key(F.col("v")), v=value) == key


@pytest.mark.parametrize(
    ("name", "key"),
    [("研发费用", "R&D_expenditure"), (" Research-Expense ", "R&D_expenditure"), ("revenue_segment: 储能（A） ", "revenue_segment:储能(a)"), ("revenue:x", "revenue"), ("net_profit", "net_profit"), ("Odd Name", "Odd Name"), (None, "")],
)
def test_metric_key(spark, name, key):
    assert one(spark, V.metric_key(F.col("v")), v=name) == key


def test_digits_number(spark):
    for value, expected in (("-5", 5.0), ("1.2.3", 1.23), ("abc", None), ("1,000元", 1000.0)):
        assert one(spark, V.digits_number(F.col("v")), v=value) == expected


def test_strip_is_unicode(spark):
    assert one(spark, T.strip(F.col("v")), v="　\t a b  \n") == "a b"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。 \n，", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_cover_the_text(text, size, overlap):
    chunks = K.recursive_chunks(text, size, overlap)
    assert all(len(c[3]) <= size for c in chunks)
    stripped = text.strip()
    assert all(c[3] in stripped for c in chunks)
    letters = [c for c in stripped if c in "ab"]
    if overlap == 0:
        assert [c for part in chunks for c in part[3] if c in "ab"] == letters


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。 \n", max_size=900), st.integers(1, 80), st.integers(0, 79))
def test_section_chunks_end(text, size, overlap):
    chunks = K.section_chunks(text, size, min(overlap, size - 1), 10)
    assert len(chunks) <= 2 * len(text) + 1


def test_sections_are_merged_and_named():
    text = "intro\n\n<!-- SECTION: One -->\n" + "a" * 500 + "\n\n<!-- SECTION: Two -->\nshort"
    assert [(t, len(b)) for _, t, b in K.section_chunks(text, 1600, 300)] == [("正文", 507), ("Two", 5)]
    assert K.section_chunks("<!-- SECTION: One -->\nx", 10, 0, 1)[0][1] == "正文"  # a mark at the start isn't one


@pytest.mark.parametrize("bad", [(0, 0), (10, 10), (10, -1)])
def test_chunk_arguments(bad):
    for f in (T.chunk_windows, K.recursive, K.section_aware):
        with pytest.raises(ValueError):
            f(F.lit("x"), *bad)


def test_hash_embedding(spark):
    vector = one(spark, S.hash_embedding(F.col("v"), 16), v="Ab ab")
    expected = [0.0] * 16
    for f in ("ab", "ab", "ab_ab"):
        d = hashlib.blake2b(f.encode(), digest_size=8).digest()
        expected[int.from_bytes(d[:4], "big") % 16] += (1 if d[4] % 2 == 0 else -1) * (1 + len(f) / 12)
    norm = math.sqrt(sum(x * x for x in expected))
    assert vector == [round(x / norm, 6) for x in expected]
    assert one(spark, S.hash_embedding(F.col("v")), v="  ") is None
    with pytest.raises(ValueError):
        S.hash_embedding(F.lit("x"), 4)


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in S.knn(df, [2.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert S.knn(df, [1.0, 0.0], 0).count() == 0 and S.knn(df.limit(0), [1.0, 0.0], 3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        df.select(S.checked_dimension(F.col("embedding"), 3)).collect()


def test_fusion_is_invariant_under_row_order(spark):
    rows = [("q", 1, "a", 1), ("q", 1, "b", 2), ("q", 2, "b", 1), ("q", 2, "c", 2)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        results.append([r.doc for r in S.fuse(spark.createDataFrame(rows, "query string, list_no int, doc string, rank int"), "query", "doc").orderBy("rank").collect()])
    assert results == [["b", "a", "c"]] * 3


def test_bm25_ranks_unmatched_documents_last(spark):
    docs = spark.createDataFrame([(1, "zz yy"), (2, "aa bb aa"), (3, None)], "doc_id long, text string")
    got = S.bm25(docs, spark.createDataFrame([(7, "aa")], "item_id long, text string"), 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 3] and got[0].score > 0 and got[1].score == 0


TABLE = "单位：万元\n项目 2024年 2023年\n营业收入合计 500,000.00 400,000.00\n归母净利润 60,000.00 50,000.00\n研发费用 12% 11%\n"


def test_table_extraction():
    facts = X.extract(TABLE)
    assert {(m, v, p) for m, v, p, _, _ in facts} == {("revenue", "500000.00万元", "2024"), ("revenue", "400000.00万元", "2023"), ("net_profit_parent", "60000.00万元", "2024"), ("net_profit_parent", "50000.00万元", "2023")}
    assert {f[2] for f in X.extract(TABLE, frozenset({2023}))} == {"2023"}


def test_wide_rows_need_one_header_year():
    row = "乘用车 30万辆 20万辆 18万辆 50亿元\n"
    head = "产能状况 快报产量 快报销量\n"
    assert [f[0] for f in X.extract("2024年\n" + head + row)] == ["production_capacity:乘用车", "production_volume:乘用车", "sales_volume:乘用车", "revenue_segment:乘用车"]
    assert not [f for f in X.extract("2024年 2023年\n" + head + row) if f[4] == 0.74]


def test_rules_take_spans_once():
    facts = X.extract("2024年，公司归母净利润为5亿元，营业收入达120亿，研发投入占比3%。")
    assert {(m, v, p) for m, v, p, _, _ in facts} == {("net_profit_parent", "5亿元", "2024"), ("revenue", "120亿元", "2024")}
    assert X.extract("净利润为5万元") == []  # below a listed company's size


def test_time_scope():
    assert A.time_scope("仅看2023年") == A.TimeScope((2023,), None, True)
    assert A.time_scope("近三年营收变化趋势").preferred(2024) == (2023, 2022, 2021)
    assert A.time_scope("最近 20 年").window == 10 and A.time_scope("今年").window == 1
    assert A.time_scope("公司怎么样") is None


def test_compliance_golden(spark):
    for text, action in (("这只股票能买吗", "refuse"), ("目标价是多少", "rewrite"), ("经营风险分析", "allow"), ("Buyers resell", "allow"), ("should I buy it", "refuse"), ("![x](data:image/png;base64,buy)", "allow"), (None, "allow")):
        assert one(spark, C.action(C.hits(F.col("v"))), v=text) == action
    shown = one(spark, C.applied(F.col("v"), C.hits(F.col("v"))), v="目标价 10，稳赚")
    assert shown.startswith(f"{C.REMOVED} 10，{C.REMOVED}") and shown.endswith(C.NOTICE)


def test_memory_fold_golden(spark):
    ops = [("u", "ADD", "a", 0.5, 1), ("u", "UPDATE", "", 0.6, 2), ("u", "NOOP", "z", 0.9, 3), ("v", "ADD", "a", 0.5, 1), ("v", "DELETE", "", 0.5, 2), ("w", "DELETE", "", 0.1, 1), ("w", "UPDATE", "n", 0.2, 2), ("x", "ADD", "a", 0.1, 1), ("x", "ADD", "", 0.2, 2)]
    got = M.fold(spark.createDataFrame(ops, "user string, op string, value string, confidence double, pos int"), ["user"])
    assert {tuple(r)[:3] for r in got.collect()} == {("u", "a", 0.6), ("w", "n", 0.2), ("x", "", 0.2)}


def test_operation_violations(spark):
    assert one(spark, M.violations(F.lit("ADD"), F.lit("t"), F.lit(""), F.lit(None).cast("string"), F.lit("r")), v="") == ["key", "value"]
    assert one(spark, M.violations(F.lit("NOOP"), *[F.lit(None).cast("string")] * 4), v="") == []


def test_front_matter_and_local_scan(spark, tmp_path):
    (tmp_path / "acme").mkdir()
    (tmp_path / "acme/a.md").write_text('---\ntitle: "T: one"\nurl: http://x/y\ncredibility_score: 3\npublished_at: 2024-01-02\n---\nBody\ntext', encoding="utf-8")
    (tmp_path / "acme/b.txt").write_text("no front matter", encoding="utf-8")
    (tmp_path / "acme/c.pdf").write_text("ignored", encoding="utf-8")
    got = scans.parsed_documents(scans.local_documents(spark, str(tmp_path))).orderBy("path").collect()
    assert [(r.title, r.url, r.source_type, r.credibility_score, r.raw_content) for r in got] == [("T: one", "http://x/y", "other", 1.0, "Body\ntext"), (None, None, "other", 0.8, "no front matter")]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"sources": [{"url": "https://www.sse.com.cn/a"}, {"url": "https://evil-sse.com.cn/b"}, {"url": "https://sse.com.cn/c"}]}', encoding="utf-8")
    got = scans.manifest(spark, str(path), ("sse.com.cn",))
    assert [(r.url, r.credibility_score) for r in got.orderBy("url").collect()] == [("https://sse.com.cn/c", 0.82), ("https://www.sse.com.cn/a", 0.82)]


def test_readable_html(spark):
    html = "<html><script>x<b></script><p>One  two<br>three</p><noscript>n<p>o</p></noscript><li>four</li>&amp;</html>"
    assert one(spark, scans.readable_html(F.col("v")), v=html) == "One two\nthree\nfour\n&"


def test_verdicts_do_not_depend_on_row_order(spark, sf_dir):
    from factloom.operators import verification as Y
    from factloom.plans import facts as P

    facts = Y.enrich(P.facts(spark, sf_dir), P.sources(spark))
    one_way = {tuple(r) for r in Y.verify(facts, P.AS_OF).select("fact_id", "status", "reason_code").collect()}
    other = {tuple(r) for r in Y.verify(facts.orderBy(F.rand(3)), P.AS_OF).select("fact_id", "status", "reason_code").collect()}
    assert one_way == other
    assert {"verified", "conflicted", "outdated", "rejected"} <= {s for _, s, _ in one_way}


def test_search_plan_is_pushed_down(spark, sf_dir):
    from factloom.plans import registry

    plan = registry.queries()["cosine_topk_filtered"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan
