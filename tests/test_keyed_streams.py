"""Keyed streams: order across micro-batches and restarts, and keys that leave the store."""

import random
import time

import pytest

from factloom.operators.memory import fold
from factloom.streaming.keyed import STORE, current_memories, fold_memories, number_events, use_state_store

OPS = "user_id long, memory_type string, key string, op string, value string, confidence double, pos long"
EVENTS = "task_id long, ts long, event_id long, event_type string"


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield use_state_store(spark)
    for name in STORE:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, make, schema, tmp_path, rows):
    """One more run over what is new since the last one; (progress of the state store)."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))

    def keep(batch, number):
        batch.write.mode("append").parquet(out)

    query = stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_operations_fold_across_micro_batches_as_in_batch(store, tmp_path):
    r = random.Random(6)
    ops = [(r.randrange(3), r.choice(["style", "risk"]), r.choice("ab"), r.choice(["ADD", "UPDATE", "UPDATE", "DELETE", "NOOP"]), r.choice(["", "x", "y", None]), r.choice([0.5, 0.9]), i) for i in range(120)]
    for at in range(0, 120, 40):
        part = ops[at : at + 40]
        r.shuffle(part)
        run(store, fold_memories, OPS, tmp_path, part)
    got = current_memories(store.read.parquet(str(tmp_path / "out")))
    want = fold(store.createDataFrame(ops, OPS), ["user_id", "memory_type", "key"])
    rows = lambda df: {(x["user_id"], x["memory_type"], x["key"], x["value"], x["confidence"], x["pos"]) for x in df.collect()}
    assert rows(got) == rows(want) and len(rows(got)) > 4


def test_event_numbers_go_on_after_a_restart_and_idle_tasks_leave(store, tmp_path):
    make = lambda s: number_events(s, idle_seconds=2, keep=3)
    run(store, make, EVENTS, tmp_path, [(t, 10 - i, 100 * t + i, "step") for t in range(20) for i in range(5)])
    held = run(store, make, EVENTS, tmp_path, [(1, 20, 190, "step"), (2, 21, 291, "step"), (1, 22, 0, "resume")])
    got = [tuple(r) for r in store.read.parquet(str(tmp_path / "out")).collect()]
    new = sorted(r for r in got if not r[3])
    assert [(s, e) for t, s, e, _ in new if t == 1] == [(1, 104), (2, 103), (3, 102), (4, 101), (5, 100), (6, 190)]
    assert len(new) == 102 and sorted(r[1:3] for r in got if r[3]) == [(4, 101), (5, 100), (6, 190)]
    time.sleep(3)
    run(store, make, EVENTS, tmp_path, [(500, 30, 900, "step")])
    after = run(store, make, EVENTS, tmp_path, [(501, 31, 901, "step")])
    assert after < held / 3
    run(store, make, EVENTS, tmp_path, [(7, 40, 777, "step")])
    assert (7, 1, 777, False) in {tuple(r) for r in store.read.parquet(str(tmp_path / "out")).collect()}
