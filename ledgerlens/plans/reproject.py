"""The derived tables kept in step with the evidence: a batch is parsed once, and only what it touches is derived again.

Facts of records are stored as they come. Every fact has an owner: its session, or itself where it names none. Owners that
share a call, an agent, a request or a prompt belong together, since their rows are merged or named by one another; a batch
touches the owners that belong together with its own. All facts of these are merged again by the same operators that
derive everything, and the parts of the tables that hold their rows are replaced by a new version (see ``snapshots``).
So the evidence may come in any split and any order, and a batch may be replayed. Where a batch touches most owners, all are
derived again, which needs no search for what belongs together and no join of facts with owners.

Facts and links lie in parts by hash and by batch: a batch reads the parts of what it touches, and of the links two columns
of hashes. The driver gets numbers of parts and counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.redact import Pattern
from ..schemas import RAW_EVENT
from ..sources import snapshots
from ..staging import materialize, release
from .projection import facts_of, tables_of

PARTS = 64
#: From this share of the owners on, all are derived again.
MOST = 0.5
#: What facts are linked by, and what stands for the owner of a fact without a session.
LINKS = {
    "use": (("call", "tool_use_id"), ("agent", "agent_id")),
    "result": (("call", "tool_use_id"), ("agent", "agent_id"), ("agent", "spawned_agent")),
    "asked": (("call", "tool_use_id"),),
    "change": (("call", "tool_use_id"),),
    "request": (("request", "request_id"),),
    "prompt": (("prompt", "prompt_id"),),
}
OWN = {k: v[0] for k, v in LINKS.items()} | {k: ("event", "id") for k in ("session", "mode", "told_mode")}
TABLE_OWN = {
    "session": ("event", "session_id"), "tool_call": ("call", "tool_use_id"), "api_request": ("request", "request_id"),
    "prompt": ("prompt", "prompt_id"), "permission_mode_change": ("event", "id"),
}
LINK = "owner long, key long, part int, batch string"


def _named(kind: str, column: str) -> Column:
    """A key's hash. Rows without the key are merged into one row, so they belong together."""
    return F.xxhash64(F.lit(kind), F.coalesce(F.col(column).cast("string"), F.lit("")))


def owner_of(own: tuple[str, str]) -> Column:
    return F.when(F.col("session_id").isNotNull(), _named("session", "session_id")).otherwise(_named(*own))


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _links(facts: dict[str, DataFrame]) -> DataFrame:
    """(owner, key) of all facts. An agent that is not named links nothing."""
    each = [
        df.select("owner", F.when(F.lit(kind != "agent") | F.col(c).isNotNull(), _named(kind, c)).alias("key"))
        for name, df in facts.items() for kind, c in LINKS.get(name, ())
    ]
    return reduce(DataFrame.unionByName, each).filter("key IS NOT NULL").distinct()


def _overwrite(df: DataFrame, path: str) -> None:
    # A part may hold most of a table: a large one is written by several tasks, as in ``snapshots``.
    df.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)


def _read(spark: SparkSession, path: str, schema: str | StructType, parts: list[int]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("part").isin(*parts) if parts else F.lit(False))


def _held(df: DataFrame, column: Column) -> list[int]:
    return [r[0] for r in df.select(column).distinct().collect()]


def _stored(df: DataFrame) -> StructType:
    return StructType(list(df.schema.fields)).add("owner", "long").add("part", "integer").add("batch", "string")


def _owners(spark: SparkSession, path: str, schemas: dict[str, StructType], parts: int, batch: str) -> tuple[int, int]:
    """About how many owners the batch and all facts have; none if there are none."""
    own = [_read(spark, f"{path}/facts/{k}", s, list(range(parts))).select("owner", "batch") for k, s in schemas.items()]
    here = F.when(F.col("batch") == batch, F.col("owner"))
    return tuple(reduce(DataFrame.unionByName, own).agg(F.approx_count_distinct(here), F.approx_count_distinct("owner")).first())


def create(spark: SparkSession, path: str, parts: int = PARTS) -> None:
    """An empty projection at ``path``."""
    facts = facts_of(spark.createDataFrame([], RAW_EVENT))
    for name, df in facts.items():
        spark.createDataFrame([], _stored(df)).write.parquet(f"{path}/facts/{name}")
    for name in ("by_owner", "by_key"):
        spark.createDataFrame([], LINK).write.parquet(f"{path}/{name}")
    empty = {f"projected_{k}": spark.createDataFrame([], StructType(list(df.schema.fields)).add("owner", "long")) for k, df in tables_of(facts).items()}
    snapshots.create(spark, f"{path}/tables", empty, parts)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A derived table as the newest version has it."""
    return snapshots.read(spark, f"{path}/tables", f"projected_{table}").drop("owner")


def touched(spark: SparkSession, path: str, owners: DataFrame, parts: int) -> DataFrame:
    """(owner) of all that belong together with ``owners``: steps from owners to keys and back, each from the new ones only,
    until none is new. Two steps find those of a batch whose keys are its own sessions'."""
    every = new = materialize(owners.distinct(), "reproject-owners")
    while True:
        own = _read(spark, f"{path}/by_owner", LINK, _held(new, _part("owner", parts)))
        keys = materialize(own.join(new, "owner", "left_semi").select("key").distinct(), "reproject-keys")
        other = _read(spark, f"{path}/by_key", LINK, _held(keys, _part("key", parts)))
        new = materialize(other.join(keys, "key", "left_semi").select("owner").distinct().join(every, "owner", "left_anti"), "reproject-owners")
        if new.isEmpty():
            return every
        every = materialize(every.unionByName(new), "reproject-owners")


def apply(evidence: DataFrame, path: str, batch: str, patterns: list[Pattern] | None = None) -> dict:
    """Takes a batch of the evidence in and gives the manifest of the new version. A replay under the same name changes
    nothing; an empty batch makes no version. One writer at a time: a second one fails when it names its version."""
    spark = evidence.sparkSession
    manifest = snapshots.current(spark, f"{path}/tables")
    parts = manifest["parts"]
    fresh = facts_of(evidence, patterns)
    schemas = {k: _stored(df) for k, df in fresh.items()}
    for name, df in fresh.items():
        owned = df.withColumn("owner", owner_of(OWN[name]))
        _overwrite(owned.withColumn("part", _part("owner", parts)).withColumn("batch", F.lit(batch)), f"{path}/facts/{name}")
    facts = {k: _read(spark, f"{path}/facts/{k}", s, list(range(parts))).filter(F.col("batch") == batch) for k, s in schemas.items()}
    links = materialize(_links(facts).withColumn("batch", F.lit(batch)), "reproject-links")
    _overwrite(links.withColumn("part", _part("owner", parts)), f"{path}/by_owner")
    _overwrite(links.withColumn("part", _part("key", parts)), f"{path}/by_key")
    release(links)
    # Both lanes' records, which the modes are read from, were for the facts.
    release(fresh["mode"])
    release(fresh["told_mode"])
    here, known = _owners(spark, path, schemas, parts, batch)
    if not here:
        return manifest
    owners = None
    if here < MOST * known:
        owners = touched(spark, path, reduce(DataFrame.unionByName, [df.select("owner") for df in facts.values()]), parts)
        owners = owners if owners.count() < MOST * known else None
    held = list(range(parts)) if owners is None else _held(owners, _part("owner", parts))
    every = {k: _read(spark, f"{path}/facts/{k}", s, held) for k, s in schemas.items()}
    if owners is not None:
        every = {k: df.join(owners, "owner", "left_semi") for k, df in every.items()}
    # Derived tables say whose they are by their own session; a changed file by its fact's.
    plain = {k: df.drop("owner", "part", "batch") for k, df in every.items()}
    derived = {k: df.withColumn("owner", owner_of(TABLE_OWN[k])) for k, df in tables_of(plain).items() if k != "file_change"}
    derived["file_change"] = every["change"].drop("session_id", "part", "batch")
    changed = {}
    for name, df in derived.items():
        table = f"projected_{name}"
        old = snapshots.read(spark, f"{path}/tables", table, set(held), manifest)
        rows = df.select(*old.columns)
        changed[table] = rows if owners is None else old.join(owners, "owner", "left_anti").unionByName(rows), set(held)
    return snapshots.replace(spark, f"{path}/tables", manifest, changed)


def applying(path: str, patterns: list[Pattern] | None = None):
    """What ``ingest.ingesting`` calls after each batch: the rows that the batch holds go into the tables."""

    def run(held: DataFrame, batch_id: int) -> None:
        apply(held, path, str(batch_id), patterns)

    return run
