"""Every address query against its SQL, and the stream upsert against a batch."""

import os
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from quartier.plans import addresses, labels, master, places, scoring  # these register their queries  # noqa: F401
from quartier.plans.queries import ORACLES, QUERIES
from quartier.streaming.upsert import current, latest_by_user, present, windowed_counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v[i]:.6g}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    sql = duck.execute(ORACLES[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, sql.fetchall())


def test_stream_upsert(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest_by_user(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.user_id: r.event_id for r in current(spark, str(tmp_path / "out")).collect()}
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        want[r.user_id] = r.event_id
    assert got == want


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value")
    assert windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_fuzzy_ratio(spark, sf_dir):
    got = {r.p_partkey: r.ratio for r in QUERIES["fuzzy_ratio"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        assert got[r.p_partkey] == pytest.approx(SequenceMatcher(None, r.p_name, f"{r.p_type} {r.p_brand}").ratio(), abs=1e-6)


def test_windowed_counts_leave_late_rows_out(spark, tmp_path):
    """Rows that come after the watermark has passed their window don't count, later batches of open windows do."""
    schema = "ts timestamp, event_type string, value double"
    batches = [[("2024-01-01 10:00:00", "a", 1.0)], [("2024-01-05 10:00:00", "a", 2.0), ("2024-01-05 11:00:00", "a", 3.0)], [("2024-01-05 09:00:00", "a", 1.0)], [("2024-01-01 11:00:00", "a", 50.0), ("2024-01-05 12:00:00", "a", 4.0)], [("2024-01-20 00:00:00", "a", 9.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "ts string, event_type string, value double").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for f in (tmp_path / "in" / f"{i}").glob("*.parquet"):  # files are taken in the order of their times
            os.utime(f, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    found = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = windowed_counts(source).writeStream.outputMode("append").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r.window.start)[:10]: (r.n, r.total) for r in found} == {"2024-01-01": (1, 1.0), "2024-01-05": (4, 10.0)}


def test_present(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:09:00"), (2, "2024-01-01 00:01:00"), (3, "2024-01-01 00:11:00"), (4, None)]
    seen = spark.createDataFrame(rows, "user int, at string").selectExpr("user", "cast(at AS timestamp) AS at")
    assert present(seen, "user", "at", F.lit("2024-01-01 00:10:00").cast("timestamp")).first().n_present == 1
