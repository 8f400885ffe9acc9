"""Records of both lanes to derived tables."""

import json

from pyspark.sql import functions as F

from ledgerlens.functions import normalize as N
from ledgerlens.functions import redact
from ledgerlens.operators import chain
from ledgerlens.operators import merge as M
from ledgerlens.plans import backfill, projection
from ledgerlens.sources import evidence, telemetry, transcripts


def line(kind, **more):
    return json.dumps({"type": kind, "sessionId": "s1", **more})


def use(id_, name, input_, ts="2026-01-01T00:00:01Z", **more):
    content = [{"type": "text", "text": "x"}, {"type": "tool_use", "id": id_, "name": name, "input": input_}]
    return line("assistant", uuid=f"u-{id_}", timestamp=ts, message={"role": "assistant", "content": content}, **more)


def result(id_, value, is_error=None, **more):
    block = {"type": "tool_result", "tool_use_id": id_} | ({} if is_error is None else {"is_error": is_error})
    return line("user", timestamp="2026-01-01T00:00:02Z", message={"role": "user", "content": [block]}, toolUseResult=value, **more)


PATCH = [{"oldStart": 1, "oldLines": 2, "newStart": 1, "newLines": 2, "lines": [" a", "-b", "+c", "+d"]}]
TRANSCRIPT = [
    line("permission-mode", permissionMode="default"),
    line("user", permissionMode="plan", cwd="/w", gitBranch="main", message={"role": "user", "content": "hi"}),
    use("t1", "Bash", {"command": "  ls  "}, cwd="/w"),
    result("t1", {"stdout": "out", "stderr": "", "interrupted": False}),
    use("t2", "Read", {"file_path": "/w/a", "notebook_path": "/n"}),
    result("t2", "Error: ENOENT no such file here"),
    use("t3", "Edit", {"file_path": "/w/a"}),
    result("t3", {"filePath": "/w/a", "structuredPatch": PATCH}),
    use("t4", "mcp__srv__do_it", {"n": 5}),
    result("t4", [{"type": "text", "text": "T"}, {"type": "image", "source": {"media_type": "image/png", "data": "abcd"}}, "bare"], is_error=False),
    use("t5", "Agent", {"description": "look", "prompt": "p", "subagent_type": "Explore"}),
    result("t5", {"agentId": "a1", "content": [{"type": "text", "text": "done"}]}),
    use("t6", "Brand-New", {"path": "/p"}, agentId="a1", isSidechain=True),
    use("t7", "Bash", {"command": "x"}, agentId="a1", isSidechain=True),
    result("t7", {"interrupted": True, "stdout": "o", "data": "Z" * 2000}),
    line("relocated", relocatedCwd="/moved"),
    line("strange"),
    "not json",
    "[1]",
]


def attr(key, **value):
    return {"key": key, "value": value}


def log(name, ts, *attributes):
    return {"attributes": [attr("event.name", stringValue=name), attr("session.id", stringValue="s1"), *attributes], "timeUnixNano": str(ts), "body": {"stringValue": f"claude_code.{name}"}}


OTLP = [
    log("tool_result", 1_767_225_601_500_000_000, attr("tool_use_id", stringValue="t1"), attr("tool_name", stringValue="Bash"), attr("success", stringValue="true"), attr("duration_ms", intValue="12"), attr("tool_input", stringValue='{"command":"cut off"}')),
    log("tool_decision", 1_767_225_602_000_000_000, attr("tool_use_id", stringValue="t9"), attr("tool_name", stringValue="Bash"), attr("decision", stringValue="reject"), attr("source", stringValue="user_reject"), attr("tool_parameters", stringValue='{"full_command":"rm -rf /"}')),
    log("api_request", 0, attr("request_id", stringValue="r1"), attr("cost_usd", doubleValue=0.25), attr("input_tokens", stringValue="7")),
    log("api_request", 0, attr("request_id", stringValue="r1"), attr("cost_usd_micros", intValue="9"), attr("input_tokens", intValue="8")),
    log("user_prompt", 0, attr("prompt.id", stringValue="p1"), attr("prompt_length", intValue="3")),
    log("hook_registered", 0),
]


def store(spark, transcript=TRANSCRIPT, otlp=OTLP):
    rows = [(i + 1, "transcript", "/logs/s1.jsonl", i, b) for i, b in enumerate(transcript)]
    rows += [(i + 1001, "otlp", "otlp", None, json.dumps(b)) for i, b in enumerate(otlp)]
    df = spark.createDataFrame(rows, "id long, lane string, source_ref string, source_offset long, body string")
    return df.withColumn("content_sha256", F.sha2(F.col("body"), 256)).withColumn("ingested_at", F.lit(1)).withColumn("chain_sha256", F.lit(None).cast("string"))


def calls(tables):
    return {r["tool_use_id"]: r for r in tables["tool_call"].collect()}


def test_both_lanes(spark):
    t = projection.project(store(spark))
    c = calls(t)
    assert c["t1"]["input_summary"] == "ls" and c["t1"]["provenance"] == 3 and c["t1"]["duration_ms"] == 12 and c["t1"]["decision"] == "accept"
    assert c["t1"]["success"] is True and c["t1"]["result_text"] == "out\n" and c["t1"]["permission_mode"] == "plan"
    assert json.loads(c["t1"]["input_json"]) == {"command": "  ls  "}
    assert c["t2"]["success"] is False and c["t2"]["target_path"] == "/w/a"
    assert c["t4"]["tool_kind"] == "mcp" and (c["t4"]["mcp_server"], c["t4"]["mcp_tool"]) == ("srv", "do_it")
    assert c["t4"]["result_text"] == "T\n[image/png, 4 bytes]\nbare\n" and c["t4"]["success"] is True and c["t4"]["input_summary"] == '{"n":5}'
    assert c["t5"]["input_summary"] == "look" and c["t5"]["target_path"] == "Explore"
    assert c["t6"]["agent_name"] == "Explore" and c["t6"]["target_path"] == "/p" and c["t6"]["is_sidechain"] is True
    assert c["t7"]["success"] is False and "elided: 2000 bytes" in c["t7"]["result_json"]
    assert c["t9"]["provenance"] == 2 and c["t9"]["success"] is False and c["t9"]["input_summary"] == "rm -rf /" and c["t9"]["decision_source"] == "user_reject"
    (s,) = t["session"].collect()
    assert s["cwd"] == s["project_path"] == "/moved" and s["git_branch"] == "main"
    (f,) = t["file_change"].collect()
    assert (f["file_path"], f["lines_added"], f["lines_removed"]) == ("/w/a", 2, 1)
    (r,) = t["api_request"].collect()
    assert r["cost_usd_micros"] == 9 and r["input_tokens"] == 7
    (p,) = t["prompt"].collect()
    assert p["prompt_length"] == 3
    modes = [(r["from_mode"], r["to_mode"]) for r in t["permission_mode_change"].orderBy("id").collect()]
    assert modes == [(None, "default"), ("default", "plan")]


def test_counters(spark):
    r = projection.transcript_counters(store(spark)).first()
    assert (r["records"], r["tool_uses"], r["tool_results"], r["unparsable"]) == (17, 7, 6, 2)
    assert r["unknown_records"] == 2  # the strange record, and the user turn without a result


def test_rebuilding_and_lane_order_change_nothing(spark):
    rows = store(spark)
    a = sorted(map(str, projection.project(rows)["session"].collect()))
    b = sorted(map(str, projection.project(rows.repartition(5))["session"].collect()))
    assert a == b
    one = {k: (v["provenance"], v["input_summary"], v["decision"]) for k, v in calls(projection.project(rows)).items()}
    swapped = rows.withColumn("id", F.when(F.col("lane") == "otlp", F.col("id") - 5000).otherwise(F.col("id")))
    two = {k: (v["provenance"], v["input_summary"], v["decision"]) for k, v in calls(projection.project(swapped)).items()}
    assert one == two


def test_large_results_become_references(spark):
    big = [use("b", "Bash", {"command": "y"}), result("b", {"stdout": "x" * 70_000})]
    c = calls(projection.project(store(spark, big, [])))["b"]
    assert c["result_json"].startswith('{"$evidence":{"bytes":') and c["result_size"] > 65_536 and len(c["result_text"]) == 70_001


def test_redacted_projection(spark):
    patterns, bad = redact.load_patterns('[[pattern]]\nid = "broken"\nregex = "("\n')
    assert bad == ["broken"]
    secret = "AKIA" + "A" * 16
    rows = store(spark, [use("k", "Bash", {"command": f"echo {secret}"}), result("k", {"stdout": secret})], [])
    c = calls(projection.project(rows, patterns))["k"]
    assert secret not in str(c) and "[redacted: aws-access-key-id]" in c["result_text"]
    assert secret in rows.first()["body"]


def test_files_lines_offsets_and_resume(spark, tmp_path):
    root = tmp_path / "projects"
    for name in ("-work-a", "-work-b"):
        (root / name).mkdir(parents=True)
    (root / "-work-a" / "x.jsonl").write_bytes('{"é":1}\n\n  \r\n{"b":2}\r\n{"tail"'.encode() )
    (root / "-work-b" / "y.jsonl").write_bytes(b'\xff{}\n')
    (root / "-work-b" / "z.txt").write_text("no\n")
    every = transcripts.files(spark, str(root))
    assert every.count() == 2
    got = [(r["source_offset"], r["body"]) for r in transcripts.lines(every).orderBy("source_ref", "source_offset").collect()]
    assert got == [(0, '{"é":1}'), (14, '{"b":2}'), (0, "�{}")]
    kept = transcripts.files(spark, str(root), ("/work/b",))
    assert kept.count() == 1 and kept.select(transcripts.project_hint(F.col("project"))).first()[0] == "/work/a"
    stored = spark.createDataFrame([("transcript", r["source_ref"], 14) for r in kept.collect()], "lane string, source_ref string, source_offset long")
    assert [r["source_offset"] for r in transcripts.resume(transcripts.lines(kept), kept, stored).collect()] == [14]
    shrunk = stored.withColumn("source_offset", F.lit(10_000))
    assert transcripts.resume(transcripts.lines(kept), kept, shrunk).count() == 2


def test_evidence_append_is_idempotent(spark):
    empty = spark.createDataFrame([], "id long, lane string, source_ref string, source_offset long, content_sha256 string, ingested_at long, body string, chain_sha256 string")
    rows = spark.createDataFrame([("b", 0, "x"), ("a", 5, "x"), ("a", 9, "y"), ("a", 1, "z")], "source_ref string, source_offset long, body string")
    added = evidence.append(empty, rows, "transcript", 3)
    assert [(r["id"], r["source_ref"], r["body"]) for r in added.orderBy("id").collect()] == [(1, "a", "z"), (2, "a", "x"), (3, "a", "y")]
    assert evidence.append(added, rows, "transcript", 4).count() == 0
    report = evidence.ingest_report(rows, added).first()
    assert (report["files"], report["lines"], report["stored"], report["duplicates"]) == (2, 4, 3, 1)
    assert [r["id"] for r in evidence.scan(added, after=1).collect()] == [2, 3]


def test_telemetry_requests(spark, tmp_path):
    body = {"resourceLogs": [{"scopeLogs": [{"logRecords": OTLP[:2]}, {"logRecords": OTLP[2:3]}]}]}
    (tmp_path / "batch.json").write_text(json.dumps(body) + "\nnot json\n")
    found = telemetry.records(telemetry.requests(spark, str(tmp_path)))
    assert found.count() == 3 and all("attributes" in json.loads(r["body"]) for r in found.collect())


def test_source_record(spark):
    found = evidence.source_record(store(spark), "u-t3", "t3").first()
    assert '"Edit"' in found["body"]


def test_backfill_and_rebuild(spark, tmp_path):
    root, store_at = tmp_path / "projects", str(tmp_path / "store")
    (root / "-w").mkdir(parents=True)
    (root / "-w" / "s.jsonl").write_text("\n".join(TRANSCRIPT[:6]) + "\n" + TRANSCRIPT[0] + "\n")
    first = backfill.backfill(spark, str(root), store_at, 1, create=True).first()
    assert (first["files"], first["lines"], first["stored"], first["duplicates"]) == (1, 7, 6, 1)
    assert backfill.backfill(spark, str(root), store_at, 2).first()["stored"] == 0
    with (root / "-w" / "s.jsonl").open("a") as f:
        f.write(TRANSCRIPT[6] + "\n")
    assert backfill.backfill(spark, str(root), store_at, 3).first()["stored"] == 1
    kept = spark.read.parquet(store_at)
    none = spark.createDataFrame([], "chain_before string")
    assert kept.count() == 7 and chain.verify(kept, none).count() == 0 and chain.heads(kept).first()["unsealed"] == 0
    backfill.rebuild(spark, store_at, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/tool_call")).count() == 3


def test_calls_are_completed_by_narrow_rows(spark):
    """Names and modes come back as facts: the same calls as by joins with all columns."""
    again = use("t7", "Bash", {"command": "x"}, agentId="a1", isSidechain=True, attributionAgent="other")
    more = [again, use("n1", "Bash", {"command": "y"}, agentId="a2", attributionAgent="first"), use("n2", "Bash", {"command": "y"}, agentId="a3")]
    more += [t.replace('"s1"', '"s2"') for t in (use("m1", "Bash", {}, ts="none"), use("m2", "Bash", {}), use("m3", "Bash", {}, ts="2026-01-01T00:00:09Z"), line("permission-mode", permissionMode="late", timestamp="2026-01-01T00:00:05Z"))]
    bodies = [("transcript", t) for t in [*TRANSCRIPT, *more]] + [("otlp", json.dumps(r)) for r in OTLP]
    rows = spark.createDataFrame([(i, lane, lane, body) for i, (lane, body) in enumerate(bodies, 1)], "id long, lane string, source_ref string, body string")
    facts = projection.facts_of(rows)
    uses, results = facts["use"], facts["result"]
    changes = M.mode_changes(facts["mode"]).unionByName(facts["told_mode"])
    types = M.agent_types(
        uses.filter("tool_kind = 'agent'").select("id", "tool_use_id", "subagent_type"), results.select("tool_use_id", F.col("spawned_agent").alias("agent_id")),
        uses.select("id", "agent_id", F.col("agent_name").alias("agent_type")),
    )
    merged = M.merge_lanes(M.union_facts(uses.drop("subagent_type"), M.mode_at_use(facts["mode"], uses), results.drop("spawned_agent"), facts["asked"]))
    want = M.inherit_modes(M.name_agents(merged, types), changes)
    got = projection.tables_of(facts)["tool_call"]
    assert set(got.columns) == set(want.columns)
    listed = lambda df: sorted(str([r[c] for c in sorted(want.columns)]) for r in df.collect())
    assert listed(got) == listed(want)
    modes = {r["tool_use_id"]: r["permission_mode"] for r in got.collect()}
    assert modes["m1"] == modes["m2"] == modes["m3"] == "late"


def test_lines_that_are_objects(spark):
    """The line's first character and its parse tell what its kind as a variant would."""
    lines = ["{}", " {}", "\t{}", "\n\r {}", "\x0b{}", "\xa0{}", "﻿{}", "{}x", "[1]", "null", "", " ", '{"a":1,"a":2}', "/*c*/{}", "{'a':1}", '{"a":1', "5", '"{"', None]
    rows = spark.createDataFrame([(i, "transcript", "f", t) for i, t in enumerate(lines)], "id long, lane string, source_ref string, body string")
    kind = N.variant_kind(F.try_parse_json("body")).startswith("OBJECT")
    want = {r["id"]: r["good"] for r in rows.select("id", kind.alias("good")).collect()}
    assert {r["id"]: r["parsable"] for r in projection.envelopes(rows).collect()} == want


def test_only_results_with_long_data_go_to_python(spark):
    whole = {"t1": {"stdout": "x"}, "t2": {"data": "Z" * 2000}, "t3": {"data": "short"}, "t4": {"stdout": "y" * 2000}}
    bodies = [result(k, v) for k, v in whole.items()]
    bodies.append(result("t5", {"data": "Z" * 2000}).replace('"data"', '"d\\u0061ta"'))
    rows = spark.createDataFrame([(i, "transcript", "f", t) for i, t in enumerate(bodies)], "id long, lane string, source_ref string, body string")
    assert {r["ref"]["tool_use_id"] for r in projection.envelopes(rows).filter("elidable").collect()} == {"t2", "t5"}
    got = {r["tool_use_id"]: r["result_json"] for r in projection.facts_of(rows)["result"].collect()}
    assert got["t1"] == '{"stdout":"x"}' and got["t3"] == '{"data":"short"}' and got["t4"] == json.dumps(whole["t4"], separators=(",", ":"))
    assert got["t2"] == got["t5"] == '{"data":"[elided: 2000 bytes of base64]"}'
