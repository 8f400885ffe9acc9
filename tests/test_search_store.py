"""The saved index against a rebuild."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import search
from ledgerlens.functions import search_store as store

WORDS = ["alpha", "beta", "gamma", "alphabet", "Bêta", "delta-force", "x1"]
ROWS = "doc long, title string, body string"
QUERIES = ["alpha", "alpha be", "delta-force", "gamma alp", "be", "zz", "x1 delta-fo", ""]


def rows(rng, ids):
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6)))
    return {i: (i, text(), text() if rng.random() < 0.9 else None) for i in ids}


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("limit", [500, 1])
def test_changes_equal_a_rebuild(spark, monkeypatch, limit):
    monkeypatch.setattr(store, "PREFIX_TOKENS", limit)
    rng, name = random.Random(limit), f"idx{limit}"
    frame = lambda d: spark.createDataFrame(list(d.values()), ROWS)
    now = rows(rng, range(40))
    store.create(frame(now), name, "doc", ("title", "body"), 4)

    def check():
        index = search.inverted_index(frame(now), "doc", ("title", "body"))
        for q in QUERIES:
            assert ids(store.find(spark, name, q)) == ids(search.search_index(index, q)), q

    for version in (1, 2):
        changed = rows(rng, rng.sample(range(60), 15))
        deleted = [i for i in rng.sample(range(60), 6) if i not in changed]
        gone = spark.createDataFrame([(i,) for i in deleted], "doc long")
        for _ in range(version):  # the second one runs twice
            store.change(name, frame(changed), "doc", ("title", "body"), version, gone, 4)
        now = {i: r for i, r in (now | changed).items() if i not in deleted}
        check() if version == 2 else None
    before = store.generation(spark, name)
    store.compact(spark, name, 4)
    assert store.generation(spark, name) == before + 1
    check()


def test_a_search_reads_its_buckets(spark):
    store.create(spark.createDataFrame([(k, f"word{k}", "same") for k in range(50)], ROWS), "pruned", "doc", ("title", "body"), 16)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell
    plan = store.find(spark, "pruned", "word7 word8")._jdf.queryExecution().toString()
    read = [int(n) for n in re.findall(r"SelectedBucketsCount: (\d+) out of 16", plan)]
    assert set(read) <= {1, 2, 16} and 2 * read.count(16) <= len(read)  # tombstones are read whole, postings by their tokens
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    with pytest.raises(ValueError, match="no index"):
        store.generation(spark, "nowhere")


def test_a_frequent_token_is_written_by_several_tasks(spark):
    name, key = f"hot_{uuid.uuid4().hex}", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 18))
    try:
        rows = spark.range(0, 4_000, numPartitions=8).select("id", F.concat(F.lit("the " * 20), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
        store.create(rows, name, "id", ("text",), 4)
    finally:
        spark.conf.set(key, before)
    held = spark.table(store._table(name, 0, "postings"))
    assert held.filter("token = 'the'").select(F.input_file_name()).distinct().count() > 1
    assert store.find(spark, name, "the").count() == 4_000
