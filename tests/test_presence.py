"""The presence stream over batches that come one after the other, in runs that each go on from the checkpoint."""

from pyspark.sql import functions as F

from quartier.streaming.presence import presence, ready


#: Times near 1970 are behind the first watermark.
BASE = 1_000_000


def test_presence(spark, tmp_path):
    source, found = str(tmp_path / "in"), []
    batches = [[("a", 0), ("b", 10), (None, 5), ("c", None)], [("a", 200), ("a", 100), ("c", 700)], [("b", 20), ("d", 701), ("c", 690)], [("z", 2000)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ready(spark)
    try:
        for rows in batches:
            spark.createDataFrame(rows, "user string, t long").select("user", F.timestamp_seconds(F.col("t") + BASE).alias("at")).coalesce(1).write.mode("append").parquet(source)
            seen: list = []
            stream = spark.readStream.schema("user string, at timestamp").parquet(source)
            changes = presence(stream, "user", "at", "60 seconds").writeStream.outputMode("update")
            query = changes.foreachBatch(lambda df, i, seen=seen: seen.extend((r.user, int(r.last.timestamp()) - BASE, r.present) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert query.awaitTermination(120) and query.exception() is None
            found.append(sorted(seen))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # the watermark, 60 seconds behind the newest row, moves after the rows of a run
    assert found[0] == [("a", 0, True), ("b", 10, True)]
    assert found[1] == [("a", 200, False), ("a", 200, True), ("b", 10, False), ("c", 700, True)]
    # b is too late, c's row is older than what is known
    assert found[2] == [("d", 701, True)]
    assert found[3] == [("c", 700, False), ("d", 701, False), ("z", 2000, True)]
