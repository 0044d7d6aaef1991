import random

from lectern.functions.session import fresh_path
from lectern.streaming import ordered

ROW = "session string, seq long, ts timestamp, text string, is_final boolean"


def _rows():
    return [(f"s{k % 5}", k // 5, 1704067200 + (k // 5) * 5, f"text {k}", k % 3 == 0) for k in range(200)]


def _run(spark, source, path, checkpoint, once=None):
    stream = spark.readStream.schema("session string, seq long, at long, text string, is_final boolean").option("maxFilesPerTrigger", 1).parquet(source)
    stream = stream.selectExpr("session", "seq", "timestamp_seconds(at) ts", "text", "is_final")
    out = ordered.in_order(stream, "30 seconds", quiet_ms=60_000)

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:05d}")

    query = out.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _write(spark, source, rows):
    spark.createDataFrame(rows, "session string, seq long, at long, text string, is_final boolean").coalesce(1).write.mode("append").parquet(source)


def test_shuffled_delivery_with_repeats_and_a_restart(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_rocksdb(spark)
    try:
        rows = _rows()
        rng = random.Random(2)
        # rows arrive up to 20 seconds out of order, some twice
        sent = sorted(rows + rng.sample(rows, 60), key=lambda r: r[2] + rng.random() * 20)
        source, path, checkpoint = fresh_path(spark, "asr"), fresh_path(spark, "out"), fresh_path(spark, "checkpoint")
        for at in range(0, 130, 65):
            _write(spark, source, sent[at : at + 65])
        _run(spark, source, path, checkpoint)  # the first query ends; another goes on from its checkpoint
        for at in range(130, len(sent), 65):
            _write(spark, source, sent[at : at + 65])
        _write(spark, source, [("end", 1, 1704067200 + 10_000, "", True)])  # moves the watermark past all
        query = _run(spark, source, path, checkpoint)
        got = spark.read.parquet(path).where("session <> 'end'").orderBy("batch").collect()
        for s in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == s]
            seen = [r for r in got if r.session == s]
            assert [r.seq for r in sorted(seen, key=lambda r: (r.batch, r.seq))] == sorted(r[1] for r in mine)
            by_batch = [max(r.seq for r in seen if r.batch == b) for b in sorted({r.batch for r in seen})]
            assert by_batch == sorted(by_batch)
            assert {(r.seq, r.text, r.is_final) for r in seen} == {(r[1], r[3], r[4]) for r in mine}
        state = query.recentProgress[-1]["stateOperators"][0]
        assert state["numRowsTotal"] <= 4  # quiet sessions are gone; only the last one is held
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
