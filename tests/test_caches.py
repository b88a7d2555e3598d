"""Caches with age: the object, the replay of a log, and the replay of a stream."""

import random

from pyspark.sql import functions as F

from quarry.operators import cache


def test_order_of_use_and_age():
    c = cache.AgingCache(2, 10)
    assert c.put("a", 1, 0) is None and c.put("b", 2, 1) is None
    assert c.get("a", 2) == 1 and c.put("c", 3, 3) == "b"  # a was used after b
    assert c.get("b", 4) is None and c.get("a", 9.9) == 1
    assert c.get("a", 10) is None and len(c.entries) == 1  # a look-up lengthens no life
    assert c.put("c", 4, 11) is None and c.get("c", 20) == 4  # put again, it lives anew
    assert c.put("d", 5, 20) is None and c.put("e", 6, 21) is None  # c goes of age just then, and nothing needs to make room
    assert c.get("c", 21) is None and c.put("f", 7, 22) == "d"


def test_restored_as_it_was_left():
    c, rng, t = cache.AgingCache(5, 7), random.Random(4), 0.0
    for _ in range(300):
        t += rng.random() * 2
        key = rng.randrange(9)
        other = cache.AgingCache(5, 7).restore([(k, v, end) for k, (v, end) in c.entries.items()])
        assert c.get(key, t) == other.get(key, t) and c.put(key, t, t) == other.put(key, t, t) and c.entries == other.entries


def brute(rows, size, seconds):
    """A list of (key, end) in order of use, by shard, written apart from the library."""
    held, out = {}, {}
    for request, shard, key, t in sorted(rows, key=lambda r: (r[3], r[0])):
        own = [(k, e) for k, e in held.get(shard, []) if e > t]
        old = [x for x in own if x[0] == key]
        gone = own[0][0] if not old and len(own) == size else None
        own = [x for x in own if x[0] != key][1 if gone is not None else 0 :]
        held[shard] = own + (old or [(key, t + seconds)])
        out[request] = (bool(old), gone)
    return out


def log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, shard long, key string, t double").withColumn("ts", F.col("t").cast("timestamp"))


def test_replay_over_pauses_and_a_hot_shard(spark):
    rng, rows, t = random.Random(7), [], 1_700_000_000.0
    for i in range(3000):
        t += rng.choice([1.0, 5.0, 20.0]) if rng.random() < 0.98 else rng.choice([60.0, 59.0, 500.0])  # a pause of just the life as well
        rows.append((i, 0 if rng.random() < 0.6 else rng.randrange(1, 5), f"k{rng.randrange(12)}", t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {r.request_id: (r.hit, r.evicted) for r in cache.replay(log(spark, rows), size=4, seconds=60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute(rows, 4, 60) and any(h for h, _ in found.values()) and any(g for _, g in found.values())


def test_replay_of_odd_rows(spark):
    rows = [(1, None, "a", 0.0), (2, None, "a", 5.0), (3, 1, None, 5.0), (4, 1, None, 6.0), (5, 1, "a", None), (6, 1, "b", 6.0), (6, 1, "b", 6.0)]
    found = sorted((r.request_id, r.hit) for r in cache.replay(log(spark, rows), size=1, seconds=60).collect())
    assert found == [(1, False), (2, True), (3, False), (4, True), (6, False), (6, True)]
    assert cache.replay(log(spark, []), size=1).count() == 0


def test_stream_agrees_with_the_log(spark, tmp_path):
    rng, rows, t = random.Random(9), [], 1_700_000_000.0
    for i in range(400):
        t += rng.random() * 40
        rows.append((i, rng.randrange(2), f"k{rng.randrange(8)}", t))
    for a in range(0, 400, 100):  # four batches, in order of time
        log(spark, rows[a : a + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, shard long, key string, t double, ts timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    q = cache.replay_stream(stream, size=3, seconds=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {r.request_id: (r.hit, r.evicted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == brute(rows, 3, 100)
