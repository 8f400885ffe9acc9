"""Chain segments, the rule ledger and snapshots, against the whole-table operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import merge, retention, rule_ledger, rules, segments
from ledgerlens.plans import testviews as tv
from ledgerlens.sources import snapshots

RAW = "id long, lane string, source_ref string, source_offset long, content_sha256 string, ingested_at long, body string"


def raw(spark, n):
    return spark.createDataFrame([(i, "transcript", "hot" if i % 5 else f"s{i}", i, f"c{i}", i, "b") for i in range(1, n) if i % 7], RAW)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [3, 9, 200])
def test_segments_tree_and_proofs(spark, n):
    size, fan = 10, 3
    rows = raw(spark, n)
    by = {}
    for r in rows.orderBy("id").collect():
        digest = sha(f"{r['lane']}\n{r['source_ref']}\n{r['source_offset']}\n{r['ingested_at']}\n{r['content_sha256']}")
        by[r["id"] // size] = sha(f"{by.get(r['id'] // size, segments.START)}\n{digest}")
    level, want = by, []
    while True:
        want.append(level)
        if max(level) == 0:
            break
        up = {}
        for k in sorted(level):
            up.setdefault(k // fan, []).append(f"{k}:{level[k]}")
        level = {k: sha("\n".join(v)) for k, v in up.items()}
    nodes = segments.tree(rows, size, fan)
    assert {(r["level"], r["number"]): r["digest"] for r in nodes.collect()} == {(k, m): d for k, lv in enumerate(want) for m, d in lv.items()}
    top = want[-1][0]
    assert segments.root(nodes).first()["root"] == top and segments.head_matches(nodes, top).first()["matches"]
    ids = rows.select("id")
    own = ids.withColumn("number", (F.col("id") / size).cast("long")).join(segments.heads(rows, size).select("number", "head"), "number")
    proof = segments.proofs(nodes, ids, size, fan)
    assert {r["proved"] for r in segments.proved(proof, own, F.lit(top), fan).collect()} == {True}
    edited = rows.withColumn("content_sha256", F.when(F.col("id") == 2, "x").otherwise(F.col("content_sha256")))
    assert [r["number"] for r in segments.changed(segments.tree(edited, size, fan), nodes).collect()] == [0]
    bad = ids.withColumn("number", (F.col("id") / size).cast("long")).join(segments.heads(edited, size).select("number", "head"), "number")
    assert {r["id"] for r in segments.proved(proof, bad, F.lit(top), fan).filter("NOT proved").collect()} == {r["id"] for r in rows.filter(f"id < {size}").collect()}


def test_no_evidence(spark):
    assert segments.root(segments.tree(raw(spark, 1))).count() == 0


def whole(calls, sessions, changes, some):
    out = rules.matched_rules(rules.enriched(calls, sessions, changes), some).select(F.explode("rule_ids").alias("rule_id"), "tool_use_id")
    return sorted(map(tuple, out.collect()))


def test_rules_in_steps(spark, small, tmp_path):
    calls = tv.calls(spark, small)
    sessions, changes = tv.sessions_of(calls), merge.mode_changes(tv.mode_records(spark, small))
    some, path = rules.load_rules(), str(tmp_path / "ledger")
    rule_ledger.create(spark, path)
    top = calls.agg(F.max("row_seq")).first()[0]
    looked = [rule_ledger.run(calls, sessions, changes, some, path, upto) for upto in (top // 2, top, top)]
    assert looked[0] > 0 and looked[1] > 0 and looked[2] == 0
    now = lambda: sorted((r["rule_id"], r["tool_use_id"]) for r in rule_ledger.matches(spark, path).collect())
    assert now() == whole(calls, sessions, changes, some)
    before = now()
    assert rule_ledger.run(calls, sessions, changes, some[:3], path, top) == 0 and now() == before


def test_purge_swaps_a_snapshot(spark, small, tmp_path):
    root = str(tmp_path / "snap")
    calls = tv.calls(spark, small)
    tables = {
        "session": tv.sessions_of(calls), "tool_call": calls, "raw_event": tv.raw_events(spark, small).withColumn("chain_sha256", F.lit(None).cast("string")),
        "file_change": calls.filter("target_path IS NOT NULL").select("tool_use_id", F.col("target_path").alias("path")),
    }
    snapshots.create(spark, root, tables, 8)
    one = tables["session"].filter("project_path IS NOT NULL").orderBy("session_id").first()["session_id"]
    scope = retention.Scope(session_id=one)
    want = retention.purge(tables, scope, 5)
    before = snapshots.current(spark, root)
    after = snapshots.purge(spark, root, scope, 5)
    for name in tables:
        cols = tables[name].columns
        assert sorted(map(repr, snapshots.read(spark, root, name).select(cols).collect())) == sorted(map(repr, want[name].select(cols).collect()))
    moved = [p for p, f in after["folders"]["session"].items() if before["folders"]["session"].get(p) != f]
    assert len(moved) <= 1 and snapshots.read(spark, root, "deletion").count() == 1  # one session, one part
    assert snapshots.purge(spark, root, scope, 6)["version"] == after["version"]  # nothing is left to go
    # A change that stopped before its manifest is never seen, and is cleared.
    snapshots._write(tables["session"].limit(1), root, 99, "session", 8)
    assert snapshots.current(spark, root)["version"] == after["version"]
    assert snapshots.clear(spark, root) and snapshots.read(spark, root, "tool_call").count() == want["tool_call"].count()


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    """Most of the evidence has one source: its part is split, and a purge still finds all of it."""
    rows = spark.range(0, 40_000, numPartitions=8).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("s"), F.col("id") % 700)).otherwise("otlp").alias("source_ref"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(1 << 19))
    try:
        snapshots.create(spark, str(tmp_path), {"raw_event": rows}, 4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    read = snapshots.read(spark, str(tmp_path), "raw_event")
    assert read.count() == read.distinct().count() == 40_000 and read.exceptAll(rows).count() == 0
    files = [f.split("part=")[1].split("/")[0] for f in read.inputFiles()]
    assert max(map(files.count, files)) > 2
