"""Turns of a stream whose rows come in any order within the lateness."""

import datetime
import random

from pyspark.sql import functions as F

from threadloom.operators import sessions
from threadloom.streaming import live


def test_shuffled_batches_give_the_batch_operator_s_turns(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), start + datetime.timedelta(seconds=30 * (k // 2)), k, rng.choice(["me", "me", "other"])) for k in range(300)]
    schema = "conv_id string, time timestamp, seq long, sender string"
    order = sorted(range(300), key=lambda k: k + rng.uniform(0, 60))  # at most 15 minutes late
    for b in range(6):
        spark.createDataFrame([rows[k] for k in order[b * 50 : b * 50 + 50]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{b}")
    spark.createDataFrame([("end", start + datetime.timedelta(days=30), 999, "me")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b9")
    out = []
    for b in (0, 1, 2, 3, 4, 5, 9):  # one after another, going on from the checkpoint each time
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b[0-{b}]")
        q = live.ordered_turns(stream, "30 minutes", "1 day").writeStream.foreachBatch(lambda d, k: out.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = spark.createDataFrame(rows, schema).withColumn("position", F.col("seq"))
    want = sessions.turns(batch).groupBy("conv_id", "turn").agg(F.first("sender").alias("sender"), F.count("*").cast("int").alias("n"), F.min("time").alias("a"), F.max("time").alias("z"))
    assert sorted((r.conv_id, r.first_time, r.last_time, r.sender, r.n_messages) for r in out) == sorted((r.conv_id, r.a, r.z, r.sender, r.n) for r in want.collect())
