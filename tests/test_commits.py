"""The versioned table: one winner per number, snapshots, refused dimensions."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from factloom.sources.commits import CommitLog, Refused, VersionedTable, claim


def test_a_number_is_created_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, {})
    with ThreadPoolExecutor(12) as pool:
        assert sum(pool.map(lambda i: log.create(1, {"by": i}), range(12))) == 1
        # every change builds on the version before it, so none is lost
        list(pool.map(lambda i: log.commit(lambda v, m: {"all": [*m.get("all", []), i]}), range(12)))
    version, manifest = log.latest()
    assert version == 13 and sorted(manifest["all"]) == list(range(12))


def test_of_many_claimers_one_wins(spark, tmp_path):
    tasks = VersionedTable(spark, f"file://{tmp_path}/tasks", "task_id string, status string", "task_id")
    tasks.upsert(spark.createDataFrame([("a", "created"), ("b", "failed"), ("c", "done")], tasks.schema))
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda i: claim(tasks, "a"), range(6)))
    assert sum(won) == 1
    assert claim(tasks, "b") and not claim(tasks, "c") and not claim(tasks, "none")
    assert {tuple(r) for r in tasks.read().collect()} == {("a", "running"), ("b", "running"), ("c", "done")}


def test_upserts_and_deletes_are_snapshots(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id long, v string", "id")
    rows = lambda *r: spark.createDataFrame(list(r), t.schema)
    seen = lambda at=None: {tuple(r) for r in t.read(at).collect()}
    one = t.upsert(rows((1, "a"), (2, "b"), (3, None)))
    two = t.upsert(rows((2, "B"), (4, "d")))
    three = t.delete(rows((1, ""), (9, "")))
    four = t.upsert(rows((1, "again")))
    assert (one, two, three, four) == (1, 2, 3, 4)
    assert seen(1) == {(1, "a"), (2, "b"), (3, None)} and seen(2) == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    assert seen(3) == seen(2) - {(1, "a")} and seen() == seen(3) | {(1, "again")}
    before, parts = seen(), {p for p, _ in t.snapshot().parts}
    assert t.compact() == 5 and seen() == before and seen(2) == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    assert len(t.snapshot().parts) == 1 and parts.isdisjoint({p for p, _ in t.snapshot().parts})
    with pytest.raises(Refused, match="unique"):
        t.upsert(rows((7, "x"), (7, "y")))
    with pytest.raises(Refused, match="unique"):
        t.upsert(rows((None, "x")))
    assert t.snapshot().version == 5


def test_the_dimension_is_locked_until_the_store_is_empty(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/v", "id string, vector array<float>", "id", "vector")
    make = lambda n, *ids: spark.createDataFrame([(i, [0.5] * n) for i in ids], t.schema)
    t.upsert(make(3, "a", "b"))
    with pytest.raises(Refused, match="dimension 3, not 4"):
        t.upsert(make(4, "c"))
    with pytest.raises(Refused, match="3 and 4"):
        t.upsert(make(3, "c").unionByName(make(4, "d")))
    assert t.read().count() == 2
    t.delete(make(3, "a"))
    with pytest.raises(Refused):
        t.upsert(make(4, "c"))
    t.delete(make(3, "b"))
    t.upsert(make(4, "c"))
    assert t.snapshot().facts == {"dimension": 4} and [r["id"] for r in t.read().collect()] == ["c"]
