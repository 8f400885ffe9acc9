"""Tables kept in step by batches, against all tables derived at once."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_projection import OTLP, TRANSCRIPT, line, result, use

from ledgerlens.plans import projection, reproject
from ledgerlens.sources import snapshots

EVIDENCE = "id long, lane string, source_ref string, body string"
TABLES = ("session", "tool_call", "file_change", "api_request", "prompt", "permission_mode_change")


def of_session(text, name):
    return text.replace('"sessionId": "s1"', f'"sessionId": "{name}"')


def some_evidence():
    bodies = [("transcript", t) for t in TRANSCRIPT] + [("otlp", json.dumps(r)) for r in OTLP]
    for k in range(2, 5):
        own = [line("permission-mode", permissionMode=f"m{k}"), use(f"c{k}", "Bash", {"command": "ls"}), result(f"c{k}", {"stdout": "x"})]
        bodies += [("transcript", of_session(t, f"s{k}")) for t in own]
    # An agent spawned in one session answers in another; a call told by two sessions; records without a session.
    bodies.append(("transcript", of_session(use("far", "Bash", {"command": "y"}, agentId="a1"), "s2")))
    bodies.append(("transcript", of_session(result("c3", {"stdout": "again"}), "s4")))
    for t in (use("alone", "Bash", {"command": "z"}), line("permission-mode", permissionMode="lost")):
        bodies.append(("transcript", t.replace('"sessionId": "s1", ', "")))
    for r in OTLP[:3]:
        rest = [a for a in r["attributes"] if a["key"] not in ("session.id", "tool_use_id")]
        bodies.append(("otlp", json.dumps(r | {"attributes": rest})))
    return [(i, lane, lane, body) for i, (lane, body) in enumerate(bodies, 1)]


def listed(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_any_split_equals_deriving_all(spark, tmp_path):
    every = some_evidence()
    rng = random.Random(0)
    batches = [[], [], []]
    for row in every:
        batches[rng.randrange(3)].append(row)
    path = str(tmp_path / "kept")
    reproject.create(spark, path, 4)
    for k, rows in enumerate(batches):
        reproject.apply(spark.createDataFrame(rows, EVIDENCE), path, str(k))
    whole = projection.project(spark.createDataFrame(every, EVIDENCE))
    want = {t: listed(whole[t]) for t in TABLES}
    assert all(want.values())
    assert {t: listed(reproject.read(spark, path, t)) for t in TABLES} == want
    reproject.apply(spark.createDataFrame(batches[1], EVIDENCE), path, "1")
    assert {t: listed(reproject.read(spark, path, t)) for t in TABLES} == want


def test_only_what_is_touched_is_rewritten(spark, tmp_path):
    path = str(tmp_path / "kept")
    reproject.create(spark, path, 16)
    at = lambda k, kind: (k, "transcript", f"f{k}", of_session(kind, f"s{k % 20}"))
    first = [at(k, use(f"t{k}", "Bash", {"command": "ls"})) for k in range(20)]
    before = reproject.apply(spark.createDataFrame(first, EVIDENCE), path, "0")
    kept = spark.createDataFrame([], EVIDENCE)
    assert reproject.apply(kept, path, "none")["version"] == before["version"]
    after = reproject.apply(spark.createDataFrame([(27, "transcript", "f", of_session(result("t7", {"stdout": "o"}), "s7"))], EVIDENCE), path, "1")
    owner = spark.createDataFrame([("s7", 0)], "session_id string, id long").select(reproject.owner_of(("event", "id")).alias("owner"))
    part = owner.select(F.pmod(F.xxhash64("owner"), F.lit(16))).first()[0]
    for table, folders in after["folders"].items():
        moved = {p for p in folders if folders[p] != before["folders"][table].get(p)}
        assert moved <= {str(part)}, table
    assert after["folders"]["projected_tool_call"] != before["folders"]["projected_tool_call"]
    calls = {r["tool_use_id"]: r["result_text"] for r in reproject.read(spark, path, "tool_call").collect()}
    assert calls["t7"] == "o\n" or calls["t7"] == "o"
    assert len(calls) == 20 and sum(v is not None for v in calls.values()) == 1


def test_an_interrupted_batch_is_unseen_until_it_is_replayed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kept")
    reproject.create(spark, path, 4)
    rows = spark.createDataFrame([(1, "transcript", "f", use("t1", "Bash", {"command": "ls"}))], EVIDENCE)
    real = snapshots._commit

    def fails(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(snapshots, "_commit", fails)
    with pytest.raises(RuntimeError):
        reproject.apply(rows, path, "0")
    monkeypatch.setattr(snapshots, "_commit", real)
    assert reproject.read(spark, path, "tool_call").count() == 0
    reproject.apply(rows, path, "0")
    assert reproject.read(spark, path, "tool_call").count() == 1


def test_a_batch_that_touches_most_owners_derives_all(spark, tmp_path, monkeypatch):
    """No search for what belongs together and no join of the facts with owners; the tables are the same."""

    def fails(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(reproject, "touched", fails)
    every, path = some_evidence(), str(tmp_path / "kept")
    reproject.create(spark, path, 4)
    for k in range(2):
        reproject.apply(spark.createDataFrame([r for i, r in enumerate(every) if i % 2 == k], EVIDENCE), path, str(k))
    whole = projection.project(spark.createDataFrame(every, EVIDENCE))
    assert {t: listed(reproject.read(spark, path, t)) for t in TABLES} == {t: listed(whole[t]) for t in TABLES}


def test_facts_of_one_session_are_written_by_several_tasks(spark, tmp_path):
    path, key = str(tmp_path / "kept"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.createDataFrame([(k, "transcript", "f", use(f"t{k}", "Bash", {"command": f"ls {hash((k, 'x'))}"})) for k in range(4000)], EVIDENCE).repartition(8)
    reproject.create(spark, path, 4)
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        reproject.apply(rows, path, "0")
    finally:
        spark.conf.set(key, before)
    stored = spark.read.parquet(f"{path}/facts/use")
    assert stored.select("part").distinct().count() == 1 and stored.select("tool_use_id").distinct().count() == stored.count() == 4000
    assert len(stored.inputFiles()) > 2
    assert reproject.read(spark, path, "tool_call").count() == 4000


def test_records_are_not_kept_once_their_facts_are(spark, tmp_path):
    path, shared = str(tmp_path / "kept"), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    reproject.create(spark, path, 4)
    before = set(os.listdir(shared))
    reproject.apply(spark.createDataFrame(some_evidence(), EVIDENCE), path, "0")
    assert not [n for n in set(os.listdir(shared)) - before if n.startswith(("projection-records", "projection-events"))]


def test_any_split_equals_deriving_all_by_search(spark, tmp_path, monkeypatch):
    """The same where no batch counts as touching most: what belongs together is searched for."""
    monkeypatch.setattr(reproject, "MOST", 2)
    every, path = some_evidence(), str(tmp_path / "kept")
    reproject.create(spark, path, 4)
    for k in range(2):
        reproject.apply(spark.createDataFrame([r for i, r in enumerate(every) if random.Random(i).randrange(2) == k], EVIDENCE), path, str(k))
    whole = projection.project(spark.createDataFrame(every, EVIDENCE))
    assert {t: listed(reproject.read(spark, path, t)) for t in TABLES} == {t: listed(whole[t]) for t in TABLES}
