"""Queries over both lanes on events made for one case each, against their SQL."""

import datetime as dt
import time

import pytest
from compare import rows, views
from pyspark.sql import functions as F

from ledgerlens.functions import search
from ledgerlens.plans import catalog, lanes, lives  # noqa: F401

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def only_events(spark, tmp_path):
    def write(*events):
        at = dt.datetime(2024, 1, 2, 3, 4, 5)
        made = [(i, at + dt.timedelta(hours=i), user, kind, 1.5, f'{{"k": {k}}}') for i, (user, kind, k) in enumerate(events)]
        spark.createDataFrame(made, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return write


def same_as_sql(spark, sf, name):
    con = views(sf)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)
    return got


def test_relocation_of_a_session_that_only_its_mode_shows(spark, only_events):
    # User 696 has no session of its own (696 % 17 is 16), shows modes (696 % 3 is 0) and is relocated (696 % 29 is 0).
    sf = only_events((696, "signup", 20), (696, "signup", 21), (696, "click", 30), (58, "signup", 40), (58, "view", 1))
    got = same_as_sql(spark, sf, "transcript_sessions")
    assert dict(zip(got["session_id"], got["cwd"], strict=True))["sess_696"] == "/moved/696"
    same_as_sql(spark, sf, "transcript_counts")


def test_fragment_of_a_text_full_of_matches(spark):
    """Each token is looked at a fixed number of times: 4,000 matches in one text are no square."""
    text = " ".join(f"the w{k}" for k in range(4000)) + " the and end"
    start = time.monotonic()
    found = spark.createDataFrame([(text,), ("none",), (None,)], "text string").select(search.fragment("text", "the and").alias("f")).collect()
    assert time.monotonic() - start < 20
    assert found[0]["f"] == "…\x01the\x02 w3996 \x01the\x02 w3997 \x01the\x02 w3998 \x01the\x02 w3999 \x01the\x02 \x01and\x02…"
    assert found[1]["f"] is found[2]["f"] is None


def test_no_file_of_a_stream_holds_a_half_of_the_table(spark):
    rows_ = spark.range(8000).withColumn("body", F.repeat(F.lit("x"), 50))
    stream = lives._parts(rows_, "id")
    found = lives._run(stream.select("id", F.col("_metadata.file_name").alias("file")))
    of = {r["file"]: (r["n"], r["batches"]) for r in found.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("batches")).collect()}
    assert sum(n for n, _ in of.values()) == 8000
    assert max(n for n, _ in of.values()) < 1500
    assert found.select("batch").distinct().count() == 2


def test_records_of_one_file_are_the_work_of_many_tasks(spark, tmp_path):
    made = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 1500).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props"),
    )
    made.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sizes = [r["count"] for r in lanes._base(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000
    assert max(sizes) < 30_000


def test_wanted_lines_are_all_that_are_made(spark, small):
    for made in (lanes.transcript, lanes.telemetry_calls):
        every, parts = made(spark, small).collect(), []
        for k in range(2):
            own = lambda n: F.pmod(F.xxhash64(n), F.lit(2)) == k  # noqa: B023,E731
            part = made(spark, small, own)
            assert part.filter(~own(F.col("id"))).count() == 0
            parts += part.collect()
        assert sorted(map(str, parts)) == sorted(map(str, every)) and every
