"""The stateful trigger against the batch one, over several micro-batches and a restart."""

from factloom.operators.memory import triggers
from factloom.streaming.memory import message_triggers


def test_stream_fires_as_batch_does(spark, sf_dir, tmp_path):
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    source = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (messages.where("turn < 3"), messages.where("turn >= 3")):
            part.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(messages.schema).parquet(source)
            query = message_triggers(stream).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
            query.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.conv_id, r.latest_count) for r in spark.read.parquet(out).collect()}
    assert got == {(r.conv_id, r.latest_count) for r in triggers(messages).collect()}
