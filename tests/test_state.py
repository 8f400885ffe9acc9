"""Carried state in any order of arrival, with restarts, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import merge as M
from ledgerlens.streaming import live, state

CALLS = "id long, tool_use_id string, bit int, session_id string, agent_id string, called_at long, permission_mode string, agent_name string"
MARKS = state.MESSAGE
MODES = ["default", "plan", "auto"]


def made(seed):
    rng = random.Random(seed)
    facts, modes, told, moved, types = [], [], [], [], []
    for k in range(1, 60):
        call, session = f"t{rng.randrange(14)}", rng.choice(["s0", "s1", None])
        facts.append((k, call, rng.choice([1, 2]), session, rng.choice(["a0", None]), rng.choice([None, rng.randrange(50)]), rng.choice([None, None, None, "plan"]), rng.choice([None, f"n{k % 3}"])))
        if k % 3 == 0:
            modes.append((k, rng.choice(["s0", "s1"]), rng.choice(MODES), rng.randrange(50)))
        if k % 11 == 0:
            told.append((1000 + k, rng.choice(["s0", "s1"]), rng.choice(MODES), rng.randrange(50)))
        if k % 13 == 0:
            moved.append((k, "s1", f"/m{k}"))
    if seed % 2:
        types.append((7, "a0", "explorer"))
    return facts, modes, told, moved, types


def marks_of(spark, modes, told, moved, types):
    return (
        state.seen_modes(spark.createDataFrame(modes, "id long, session_id string, mode string, ts long"))
        .unionByName(state.told_changes(spark.createDataFrame(told, "id long, session_id string, to_mode string, ts long")))
        .unionByName(state.relocations(spark.createDataFrame(moved, "id long, session_id string, relocated_cwd string")))
        .unionByName(state.agent_types(spark.createDataFrame(types, "id long, agent_id string, agent_type string")))
    )


def batch(spark, facts, modes, told, moved, types):
    df = spark.createDataFrame(facts, CALLS).withColumns({c: F.lit(None).cast("string") for c in M.INPUTS})
    calls = M.merge_lanes(df)
    seen = spark.createDataFrame(modes, "id long, session_id string, mode string, ts long").withColumn("trigger", F.lit(""))
    changes = M.mode_changes(seen).unionByName(spark.createDataFrame(told, "id long, session_id string, to_mode string, ts long").withColumns({"from_mode": F.lit(None).cast("string"), "trigger": F.lit("")}))
    named = M.name_agents(calls, spark.createDataFrame(types, "id long, agent_id string, agent_type string").groupBy("agent_id").agg(F.max_by("agent_type", "id").alias("agent_type")))
    out = {("permission_mode", r["tool_use_id"]): r["permission_mode"] for r in M.inherit_modes(calls, changes).collect() if r["session_id"]}
    out |= {("agent_name", r["tool_use_id"]): r["agent_name"] for r in named.collect() if r["agent_id"]}
    return out | {("cwd", s): max(m for m in moved if m[1] == s)[2] for s in {m[1] for m in moved}}


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*state.ROCKSDB)
    yield
    spark.conf.unset(state.ROCKSDB[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_with_restarts(spark, rocksdb, tmp_path, seed):
    facts, *marks = made(seed)
    want = batch(spark, facts, *marks)
    rows = [("f", r) for r in facts] + [("m", tuple(r)) for r in marks_of(spark, *marks).collect()]
    random.Random(seed).shuffle(rows)
    rows += rows[:20]  # some arrive twice
    for name, schema in (("f", CALLS), ("m", MARKS)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    for n, part in enumerate((rows[:30], rows[30:31], rows[31:])):  # a restart after each part
        for name, schema in (("f", CALLS), ("m", MARKS)):
            spark.createDataFrame([r for k, r in part if k == name], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = state.carried(spark.readStream.schema(CALLS).parquet(str(tmp_path / "f")), spark.readStream.schema(MARKS).parquet(str(tmp_path / "m")))
        keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        got[r["field"], r["key"]] = r["value"]
    assert {k: v for k, v in got.items() if k in want} == want


def test_modes_by_touched_sessions(spark, tmp_path):
    """Stored messages and touched sessions, in any order and with a replay, against the batch operators."""
    rng = random.Random(5)
    facts = [(k, f"t{rng.randrange(20)}", rng.choice(["s0", "s1", "s2", None]), rng.choice([None, rng.randrange(50)]), rng.choice([None, None, "plan"])) for k in range(1, 60)]
    marks = [(k, rng.choice(["s0", "s1", None]), rng.choice(MODES), rng.choice([None, rng.randrange(50)])) for k in range(100, 130)]
    df = spark.createDataFrame([(k, t, 1, s, None, at, mode, None) for k, t, s, at, mode in facts], CALLS).withColumns({c: F.lit(None).cast("string") for c in M.INPUTS})
    seen = spark.createDataFrame(marks, "id long, session_id string, mode string, ts long").withColumn("trigger", F.lit(""))
    want = {r["tool_use_id"]: r["permission_mode"] for r in M.inherit_modes(M.merge_lanes(df), M.mode_changes(seen)).collect() if r["session_id"]}
    rows = [("call", k, s, t, at, mode) for k, t, s, at, mode in facts] + [("seen", k, s, None, at, mode) for k, s, mode, at in marks]
    rng.shuffle(rows)
    write = live.answering_modes(spark, str(tmp_path / "store"), str(tmp_path / "out"))
    for n, part in ((0, rows[:40]), (1, rows[40:41]), (2, rows[41:]), (2, rows[41:])):  # the last one is replayed
        write(spark.createDataFrame(part, live.MODE_MESSAGE), n)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
        got[r["tool_use_id"]] = r["permission_mode"]
    assert {k: got[k] for k in want} == want
    touched = {r["tool_use_id"] for r in spark.read.parquet(str(tmp_path / "out")).filter("batch = 1").collect()}
    assert len(touched) < 20


def test_initial_state(spark, rocksdb, tmp_path):
    """What batch jobs know decides for the rows that stream in."""
    known = marks_of(spark, [(1, "s0", "plan", 5)], [], [], [(2, "a0", "explorer")])
    spark.createDataFrame([(9, "t", 1, "s0", "a0", 7, None, None)], CALLS).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([], MARKS).write.parquet(str(tmp_path / "m"))
    stream = state.carried(spark.readStream.schema(CALLS).parquet(str(tmp_path / "f")), spark.readStream.schema(MARKS).parquet(str(tmp_path / "m")), known_marks=known)
    q = stream.writeStream.format("memory").queryName("known").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("known").collect()} == {("permission_mode", "t", "plan"), ("agent_name", "t", "explorer")}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2], [2, 3, 1, 0]])
def test_merged_stream_equals_the_batch_merge(spark, tmp_path, order):
    schema = "id long, tool_use_id string, bit int, tool_name string, success boolean, input_summary string, target_path string, input_json string, decision string"
    facts = [
        (1, "t", 2, "Bash", True, "telemetry first", "/a", None, "accept"), (2, "t", 2, None, None, "telemetry later", "/b", None, None),
        (3, "t", 1, "Bash", None, "transcript", None, None, None), (4, "t", 1, None, False, "transcript later", None, None, None),
    ]
    want = M.merge_lanes(spark.createDataFrame(facts, schema))
    for k in order:
        spark.createDataFrame([facts[k]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        name = f"merged_{'_'.join(map(str, order))}_{k}"
        stream = live.merged_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table(name).select(want.columns).collect() == want.collect()
