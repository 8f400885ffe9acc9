"""Streams over landing folders."""

import json

from pyspark.sql import functions as F

from ledgerlens.operators import rules
from ledgerlens.sources import ingest
from ledgerlens.streaming import live

STORE = "id long, lane string, source_ref string, source_offset long, content_sha256 string, ingested_at long, body string, chain_sha256 string"


def run(stream, path, function):
    q = stream.writeStream.foreachBatch(function).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()


def test_appends_are_idempotent(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    spark.createDataFrame([], STORE).write.parquet(store)
    (landing / "a.jsonl").write_text('{"a":1}\n{"a":2}\n\n')
    write = live.appending(store, "transcript", lambda: 5)
    run(live.transcript_stream(spark, str(landing)), str(tmp_path / "c1"), write)
    (landing / "b.jsonl").write_text('{"a":2}\n{"a":3}\n')
    run(live.transcript_stream(spark, str(landing)), str(tmp_path / "c1"), write)
    run(live.transcript_stream(spark, str(landing)), str(tmp_path / "c2"), write)  # everything again
    got = spark.read.parquet(store)
    assert got.count() == 3 and sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_telemetry_stream_and_dedup(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    record = {"attributes": [], "eventName": "x"}
    (landing / "a.json").write_text(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record, record]}]}]}) + "\n")
    q = live.deduplicated(live.telemetry_stream(spark, str(landing))).writeStream.format("memory").queryName("otlp_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("otlp_rows").count() == 1


def test_observed_metrics(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.jsonl").write_text('{"a":1}\nnope\n')
    rows = live.observed(live.transcript_stream(spark, str(landing)), "ingest")
    q = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p.observedMetrics["ingest"] for p in q.recentProgress if "ingest" in p.observedMetrics]
    assert sum(m["records"] for m in seen) == 2 and sum(m["unparsable"] for m in seen) == 1


def test_merge_and_histogram_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "id long, tool_use_id string, bit int, called_at long, success boolean, decision string, input_json string, input_summary string, target_path string"
    none = (None, None, None)
    spark.createDataFrame([(1, "t", 1, 0, True, None, *none), (2, "t", 2, None, None, "accept", *none), (3, "u", 2, 3_700_000, False, "reject", *none)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = live.merged_stream(stream).writeStream.format("memory").queryName("merged").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["tool_use_id"]: (r["provenance"], r["success"], r["decision"]) for r in spark.table("merged").collect()}
    assert got == {"t": (3, True, "accept"), "u": (2, False, "reject")}
    q = live.histogram_stream(stream.filter("called_at IS NOT NULL")).writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("hist").collect()) == [(0, 1, 0, 0), (3_600_000, 1, 1, 1)]


def test_alert_sink_touched_and_carried(spark, tmp_path):
    from test_operators import frame

    enriched, calls = frame(spark, [{"decision": "reject"}, {"tool_name": "Read", "target_path": "/x/.env"}, {}])
    for batch in (0, 1, 1):  # the second one is replayed
        live.alerting(str(tmp_path / "alerts"), rules.load_rules())(enriched.filter(f"(row_seq = 1) = ({batch} = 0)"), batch)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2
    assert live.touched(calls.filter("row_seq = 1"), calls, "tool_use_id").count() == 1
    before = spark.createDataFrame([("s", "plan")], "session_id string, mode string")
    seen = spark.createDataFrame([(1, "s", "default"), (2, "z", "auto")], "id long, session_id string, mode string")
    assert sorted(tuple(r) for r in live.carried_modes(seen, before).collect()) == [("s", "default"), ("z", "auto")]


def test_ingest_replays_to_the_same_rows(spark, tmp_path):
    landing, path, seen = tmp_path / "in", str(tmp_path / "store"), []
    landing.mkdir()
    ingest.create(spark, path)
    write = ingest.ingesting(path, "transcript", lambda: 5, lambda rows, i: seen.append((i, sorted(r["body"] for r in rows.collect()))))
    (landing / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":2}\n')
    run(live.transcript_stream(spark, str(landing)), str(tmp_path / "c"), write)
    batch = spark.createDataFrame([("f", '{"a":2}'), ("f", '{"a":3}'), ("g", '{"a":3}')], "source_ref string, body string")
    before = None
    for _ in range(2):
        write(batch, 1)
        rows = sorted((r["id"], r["body"]) for r in ingest.stored(spark, path).collect())
        assert before in (None, rows)
        before = rows
    assert [b for _, b in before] == ['{"a":1}', '{"a":2}', '{"a":3}'] and [i for i, _ in before] == [1, 2, 3]
    assert seen[-1] == seen[-2] == (1, ['{"a":3}'])
    plan = ingest.digests(spark, path, ["ab", "cd"])._jdf.queryExecution().toString()
    assert "prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ingest.ingest(batch.limit(0), path, "otlp", 6, 2).count() == 0
