"""Versioned tables: parts by a key's hash, and a manifest that says which folder holds each part.

A change writes only the parts that it touches, below a folder of the new version, and then one manifest that names these and,
for all other parts, the folders they are in already. Readers take the newest manifest, which Spark's committer makes
visible as a whole: a change that stops halfway is never seen, and its folder is cleared later.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retention

PARTS = 16
#: What a table is dealt by.
KEYS = {"session": "session_id", "tool_call": "session_id", "permission_mode_change": "session_id", "api_request": "session_id", "prompt": "session_id", "raw_event": "source_ref", "file_change": "tool_use_id"}
#: Tables kept in step with the evidence have a column that says whose they are.
KEYS |= {f"projected_{t}": "owner" for t in ("session", "tool_call", "file_change", "api_request", "prompt", "permission_mode_change")}


def part_of(table: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(KEYS.get(table, "id")), F.lit(parts)).cast("int")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(version, body) of the finished versions."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(f"{root}/manifests")
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/manifests/(\d+)/", 1).cast("long")
    return rows.select(version.alias("version"), F.col("value").alias("body"))


def current(spark: SparkSession, root: str) -> dict:
    """The newest manifest: version, parts, schemas and folders of each table's parts."""
    row = manifests(spark, root).orderBy(F.desc("version")).first()
    return json.loads(row["body"])


def _commit(spark: SparkSession, root: str, manifest: dict) -> None:
    one = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    one.coalesce(1).write.text(f"{root}/manifests/{manifest['version']}")  # fails if another writer was first


def _write(df: DataFrame, root: str, version: int, table: str, parts: int) -> dict[str, str]:
    folder = f"{root}/data/{version}/{table}"
    # One key may hold most of a table: a part that is large is written by several tasks, of the session's advisory size each.
    df.withColumn("part", part_of(table, parts)).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder)
    held = [r["part"] for r in df.sparkSession.read.schema("part int").parquet(folder).select("part").distinct().collect()]
    return {str(p): f"{folder}/part={p}" for p in held}


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], parts: int = PARTS) -> None:
    folders = {name: _write(df, root, 0, name, parts) for name, df in tables.items()}
    schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
    _commit(spark, root, {"version": 0, "parts": parts, "folders": folders, "schemas": schemas})


def read(spark: SparkSession, root: str, table: str, only: set[int] | None = None, manifest: dict | None = None) -> DataFrame:
    """A table of the newest version, or of the manifest given; ``only`` some of its parts."""
    from pyspark.sql.types import StructType

    manifest = manifest or current(spark, root)
    schema = StructType.fromJson(manifest["schemas"][table])
    paths = [f for p, f in manifest["folders"][table].items() if only is None or int(p) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(spark: SparkSession, root: str, manifest: dict, changed: dict[str, tuple[DataFrame, set[int]]]) -> dict:
    """changed: table -> (rows of its touched parts, these parts). Writes them, then the next version's manifest."""
    version = manifest["version"] + 1
    folders = {name: dict(of) for name, of in manifest["folders"].items()}
    schemas = dict(manifest["schemas"])
    for name, (df, touched) in changed.items():
        kept = {p: f for p, f in folders.get(name, {}).items() if int(p) not in touched}
        schemas.setdefault(name, df.schema.jsonValue())
        folders[name] = kept | (_write(df, root, version, name, manifest["parts"]) if touched else {})
    after = manifest | {"version": version, "folders": folders, "schemas": schemas}
    _commit(spark, root, after)
    return after


def purge(spark: SparkSession, root: str, scope: retention.Scope, now: int) -> dict:
    """Removes what the scope covers and appends the deletion's row; rewrites only parts that hold rows which go. At most
    ``parts`` numbers for each table come to the driver. A scope that covers nothing makes no version."""
    manifest = current(spark, root)
    tables = {name: read(spark, root, name, manifest=manifest) for name in manifest["folders"] if name != "deletion"}
    after = retention.purge(tables, scope, now)
    changed = {}
    for name, df in tables.items():
        key = {"raw_event": ["id"], "file_change": ["tool_use_id"]}.get(name, ["session_id"])
        left = after[name].select(*key).distinct()
        lost = df.join(left, [df[k].eqNullSafe(left[k]) for k in key], "left_anti")
        touched = {r["part"] for r in lost.select(part_of(name, manifest["parts"]).alias("part")).distinct().collect()}
        if touched:
            rows = after[name].filter(part_of(name, manifest["parts"]).isin(*touched))
            changed[name] = rows.select(*df.columns), touched
    if not changed:
        return manifest
    past = read(spark, root, "deletion", manifest=manifest) if "deletion" in manifest["folders"] else after["deletion"].limit(0)
    ledger = past.unionByName(after["deletion"])
    return replace(spark, root, manifest, changed | {"deletion": (ledger, set(range(manifest["parts"])))})


def clear(spark: SparkSession, root: str) -> list[str]:
    """Removes data folders that the newest manifest does not name: those of older versions and of changes that stopped."""
    manifest = current(spark, root)
    used = {f for of in manifest["folders"].values() for f in of.values()}
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for version in files.listStatus(top):
        for table in files.listStatus(version.getPath()):
            for part in files.listStatus(table.getPath()):
                path = part.getPath().toString()
                if part.isDirectory() and not any(path.endswith(u.split("://")[-1].removeprefix("file:")) for u in used):
                    files.delete(part.getPath(), True)
                    gone.append(path)
    return gone
