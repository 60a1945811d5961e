"""Odd tables through every pipeline stage, broken pages, index order and reopening, targets of the mix."""

import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import html_extract, mixing, simhash, substring
from factloom.llm.queries import op9_mix

from test_llm import ODD, SCHEMA, empty, odd, plain, prose, split  # noqa: F401

CLASHING = ("size", "copies", "rows", "_rows", "_n", "_copy", "fp", "kind", "part", "x0", "digest", "own", "label", "stay", "times", "repeats", "of", "before", "extra", "length")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_hand_clashing_columns_through(spark, plain, name):  # noqa: F811
    stage = dict(corpus_pipeline.STAGES)[name]
    odd_names = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    want, got = stage(spark, plain, ""), stage(spark, odd_names, "")
    if name != "pack":
        assert got.columns == odd_names.columns
        assert all(r[c] is None if r.doc_id is None else r[c] == f"{c}-{r.doc_id}" for r in got.collect() for c in CLASHING)
    rows = [Counter(map(tuple, df.select(*want.columns).drop("sequence_id", "offset").collect())) for df in (want, got)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("html", ["<a" * 400_000, "<!" * 400_000, '<a "x>" ' * 100_000, '<p class="' * 80_000, "<!--" * 200_000, "<a" * 400_000 + ">", "<div>" * 150_000, "<ul><li>" * 60_000 + "</x>" * 60_000])
def test_broken_pages_take_linear_time(html):
    start = time.perf_counter()
    html_extract.blocks(html)
    assert time.perf_counter() - start < 8


def test_quotes_and_nesting():
    found = html_extract.blocks('<div title="a > b"><p>one</p></div><p class=\'x\'>two < three<b>bold</b><p>four <a href="y">link</a>')
    assert [t for _, t, _ in found] == ["one", "two < threebold", "four link"]
    deep = html_extract.blocks("<div>" * 1000 + "<p>text</p>" + "</div>" * 1000 + "<p>after</p>")
    assert [t for _, t, _ in deep] == ["text", "after"] and len(deep[0][0]) <= html_extract.DEPTH


def test_index_refuses_earlier_ids(spark):
    index = substring.FingerprintIndex(spark, fan_in=2)
    rows = [(i, prose(40, i)) for i in range(10)]
    substring.remove_repeats(spark.createDataFrame(rows[5:], "doc_id long, text string"), 1, index=index).collect()
    with pytest.raises(ValueError, match="after the indexed"):
        substring.remove_repeats(spark.createDataFrame(rows[:5], "doc_id long, text string"), 1, index=index)


def test_levels_grow_with_the_logarithm(spark, tmp_path):
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=2)
    for i in range(5):
        index.add(spark.createDataFrame([(i, prose(40, i))], "doc_id long, text string"))
    assert sorted(r.level for r in index.runs) == [0, 2]
    again = substring.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_in=2)
    assert (again.runs, again.buckets, again.parts, again.last) == (index.runs, index.buckets, index.parts, 4)


def test_targets_are_met_to_the_shortest_document(spark):
    rows = [(i, prose(5 + (i * 37) % 400, i), "en", f"s{i % 5}", 1) for i in range(400)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, target, least = defaultdict(int), {}, defaultdict(lambda: 10**9)
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.repeats <= 3
        if r.size and r.repeats == r.target // r.source_size:
            least[r.source] = min(least[r.source], r.size)
    assert all(0 <= target[s] - taken[s] < min(least[s], 10**9) or target[s] == taken[s] for s in target)


def test_targets_on_the_fixtures(spark):
    got = op9_mix(spark, "/root/testdata/sf0.01").groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= max(5, 0.01 * r.target) for r in got)


def test_odd_distances_are_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.close_links(spark.createDataFrame([(1,), (2,)], "fp long"), distance=3)
