"""The expiring cache against a plain one."""

import random

from factloom.sources.cache import ResultCache


def test_hits_expiry_and_eviction_equal_a_plain_cache(spark, tmp_path):
    cache = ResultCache(spark, f"file://{tmp_path}/cache", ttl_seconds=25, budget_bytes=60)
    r, held = random.Random(4), {}
    rows = lambda d: spark.createDataFrame(list(d), "key string, value string")
    for step in range(7):
        now = 10.0 * step
        batch = {f"k{r.randrange(14)}": "x" * r.randrange(1, 15) for _ in range(r.randrange(0, 7))}
        cache.put(rows(batch.items()), now)
        held |= {k: (v, now) for k, v in batch.items()}
        used, kept = 0, {}
        for k, (v, at) in sorted(held.items(), key=lambda x: (-x[1][1], x[0])):
            used += len(v)
            if at > now - 25 and used <= 60:
                kept[k] = (v, at)
            elif at <= now - 25:
                used -= len(v)
        held = kept
        keys = [(f"k{i}", None) for i in range(14)]
        for later in (now, now + 16):
            want = {(k, v) for k, (v, at) in held.items() if at > later - 25}
            assert {tuple(x) for x in cache.get(rows(keys), later).collect()} == want
            assert cache.missing(rows(keys), later).count() == 14 - len(want)
    before = {tuple(x) for x in cache.get(rows(keys), now).collect()}
    old = cache.table.snapshot()
    reader = cache.table.read(old)
    cache.put(rows([("big", "y" * 61)]), now + 1)  # one entry over the budget goes at once, with all that is older
    cache.compact()
    assert cache.table.read().count() == 0 and {(x["key"], x["value"]) for x in reader.collect()} == before


def test_nulls_and_empty_puts(spark, tmp_path):
    cache = ResultCache(spark, f"file://{tmp_path}/cache", 5, 10)
    cache.put(spark.createDataFrame([(None, "x"), ("a", None), ("b", "1"), ("b", "2")], "key string, value string"), 1)
    assert {tuple(x) for x in cache.table.read().select("key", "value").collect()} == {("a", None), ("b", "2")}
    cache.put(spark.createDataFrame([], "key string, value string"), 9)
    assert cache.table.read().count() == 0
