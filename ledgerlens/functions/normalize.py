"""From transcript records to facts, as Columns over variants. A field counts only if it has the type it should have."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_SUMMARY = 500
INLINE_BINARY = 1024
INLINE_RESULT = 65_536
#: Keys of an unknown tool's arguments that say most, in order.
LIKELY = ("command", "file_path", "path", "url", "query", "pattern", "description", "prompt")
PATH_LIKE = ("file_path", "path", "url")
RESULT_TEXT_KEYS = ("stdout", "stderr", "content", "text", "result", "codeText", "query")


def variant_kind(v: Column) -> Column:
    """``STRING``, ``BOOLEAN``, ``BIGINT``, ``ARRAY<...>``, ``OBJECT<...>`` or ``VOID``."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def string_at(v: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(variant_kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def bool_at(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.when(variant_kind(at) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def timestamp_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def truncated(text: Column, most: int = MOST_SUMMARY) -> Column:
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    cut = lambda c: F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)
    return F.get(F.transform(F.array(clean), cut), F.lit(0))  # the text is computed once


def tool_kind(name: Column) -> Column:
    return (
        F.when(name.startswith("mcp__"), "mcp")
        .when(name.isin("Agent", "Task"), "agent")
        .when(name == "Skill", "skill")
        .when(name.isNotNull(), "builtin")
    )


def mcp_server(name: Column) -> Column:
    return F.when(name.startswith("mcp__"), F.substring_index(F.substring(name, 6, 1 << 20), "__", 1))


def mcp_tool(name: Column) -> Column:
    return F.nullif(F.when(name.startswith("mcp__"), F.regexp_extract(name, r"(?s)^mcp__.*?__(.*)$", 1)), F.lit(""))


def _generic_text(v: Column) -> Column:
    found = F.coalesce(*[string_at(v, f"$.{k}") for k in LIKELY])
    whole = F.when(variant_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(variant_kind(v) != "VOID", F.to_json(v))
    return F.coalesce(found, whole)


def generic_summary(v: Column) -> Column:
    """The first likely key that is a string; a bare string itself; else the JSON; null for null."""
    return truncated(_generic_text(v))


def generic_target(v: Column) -> Column:
    """The likely key's value where that key is a place."""
    out = None
    for k in LIKELY:
        here = string_at(v, f"$.{k}")
        value = here if k in PATH_LIKE else F.lit(None).cast("string")
        out = F.when(here.isNotNull(), value) if out is None else out.when(here.isNotNull(), value)
    return out


def _by_tool(tool: Column, cases: dict[tuple[str, ...], Column], other: Column) -> Column:
    out = None
    for names, value in cases.items():
        out = F.when(tool.isin(*names), value) if out is None else out.when(tool.isin(*names), value)
    return out.otherwise(other)


def input_summary(tool: Column, v: Column) -> Column:
    s = lambda *keys: F.coalesce(*[string_at(v, f"$.{k}") for k in keys])
    cases = {
        ("Bash",): s("command"),
        ("Read", "Write", "NotebookEdit"): s("file_path", "notebook_path"),
        ("Edit",): s("file_path"),
        ("WebFetch",): s("url"),
        ("WebSearch",): s("query"),
        ("Glob", "Grep"): s("pattern"),
        ("Agent", "Task"): s("description", "prompt"),
        ("Skill",): s("skill", "command"),
    }
    return truncated(_by_tool(tool, cases, _generic_text(v)))


def target_path(tool: Column, v: Column) -> Column:
    s = lambda *keys: F.coalesce(*[string_at(v, f"$.{k}") for k in keys])
    none = F.lit(None).cast("string")
    cases = {
        ("Bash", "WebSearch"): none,
        ("Read", "Write", "NotebookEdit"): s("file_path", "notebook_path"),
        ("Edit",): s("file_path"),
        ("WebFetch",): s("url"),
        ("Glob", "Grep"): s("path"),
        ("Agent", "Task"): s("subagent_type"),
        ("Skill",): s("skill"),
    }
    return _by_tool(tool, cases, generic_target(v))


# --- content blocks and results

_BLOCKS = "array<variant>"


def blocks_of(v: Column) -> Column:
    """A variant array as array<variant>; null for anything else, since nothing else can be cast to one."""
    return F.try_variant_get(v, "$", _BLOCKS)


def tool_uses(records: DataFrame, content: str = "content") -> DataFrame:
    """One row for each block of type tool_use with an id and a name: adds use_id, use_name, use_input (variant)."""
    each = records.withColumn("block", F.explode(blocks_of(F.col(content))))
    b = F.col("block")
    out = each.select(
        *records.columns,
        string_at(b, "$.type").alias("block_type"),
        string_at(b, "$.id").alias("use_id"),
        string_at(b, "$.name").alias("use_name"),
        F.try_variant_get(b, "$.input", "variant").alias("use_input"),
    )
    return out.filter("block_type = 'tool_use' AND use_id IS NOT NULL AND use_name IS NOT NULL").drop("block_type")


def result_reference(content: Column) -> Column:
    """struct(tool_use_id, is_error) of the first block that names a call."""
    found = F.transform(
        blocks_of(content), lambda b: F.struct(string_at(b, "$.tool_use_id").alias("tool_use_id"), bool_at(b, "$.is_error").alias("is_error"))
    )
    return F.get(F.filter(found, lambda x: x["tool_use_id"].isNotNull()), F.lit(0))


def blocks_text(v: Column) -> Column:
    """The text of content blocks; images as ``[media, N bytes]``."""

    def one(b: Column) -> Column:
        kind = string_at(b, "$.type")
        media = F.coalesce(string_at(b, "$.source.media_type"), F.lit("image"))
        size = F.coalesce(F.octet_length(string_at(b, "$.source.data")), F.lit(0)).cast("string")
        bare = F.when(variant_kind(b) == "STRING", F.concat(F.try_variant_get(b, "$", "string"), F.lit("\n")))
        return F.coalesce(
            F.when(kind == "text", F.concat(string_at(b, "$.text"), F.lit("\n")))
            .when(kind == "image", F.concat(F.lit("["), media, F.lit(", "), size, F.lit(" bytes]\n")))
            .otherwise(bare),
            F.lit(""),
        )

    return F.coalesce(F.array_join(F.transform(blocks_of(v), one), ""), F.lit(""))


def error_type(text: Column) -> Column:
    """The message's first three words, without ``Error: ``."""
    rest = F.when(text.startswith("Error: "), F.substring(text, 8, 1 << 30)).otherwise(text)
    first = F.regexp_replace(F.substring_index(rest, "\n", 1), r"^\s+|\s+$", "")
    words = F.filter(F.split(first, r"\s+"), lambda w: w != "")
    return F.left(F.array_join(F.slice(words, 1, 3), " "), F.lit(64))


def result_text(v: Column, kind: Column | None = None) -> Column:
    """``kind`` may be a column that has the variant's kind already: it takes a schema of the whole value."""
    kind = variant_kind(v) if kind is None else kind
    parts = F.filter(F.array(*[string_at(v, f"$.{k}") for k in RESULT_TEXT_KEYS]), lambda x: F.coalesce(x, F.lit("")) != "")
    lines = F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("\n"))), "")
    whole = F.concat(lines, F.coalesce(string_at(v, "$.file.content"), F.lit("")), blocks_text(F.try_variant_get(v, "$.content", "variant")))
    return (
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY"), blocks_text(v))
        .when(kind.startswith("OBJECT"), whole)
        .otherwise("")
    )


def result_success(v: Column, is_error: Column, kind: Column | None = None) -> Column:
    kind = variant_kind(v) if kind is None else kind
    interrupted = F.coalesce(bool_at(v, "$.interrupted"), F.lit(False))
    own = F.when(kind == "STRING", F.lit(False)).when(kind.startswith("OBJECT"), ~interrupted)
    return F.when(is_error, F.lit(False)).when(~is_error & own.isNull(), F.lit(True)).otherwise(own)


def result_error(v: Column, is_error: Column) -> Column:
    kind = variant_kind(v)
    own = F.when(kind == "STRING", error_type(F.try_variant_get(v, "$", "string"))).when(
        kind.startswith("OBJECT") & F.coalesce(bool_at(v, "$.interrupted"), F.lit(False)), "Interrupted"
    )
    return F.coalesce(own, F.when(is_error, error_type(result_text(v))))


@F.pandas_udf(T.StringType())
def _elide(texts: pd.Series) -> pd.Series:
    def walk(value: object, key: str | None = None) -> object:
        if isinstance(value, list):
            return [walk(x) for x in value]
        if isinstance(value, dict):
            return {k: walk(x, k) for k, x in value.items()}
        if key == "data" and isinstance(value, str) and len(value.encode()) > INLINE_BINARY:
            return f"[elided: {len(value.encode())} bytes of base64]"
        return value

    return texts.map(lambda t: t if t is None else json.dumps(walk(json.loads(t)), ensure_ascii=False, separators=(",", ":")))


def elidable(text: Column) -> Column:
    """Whether JSON may hold a long string under ``data``."""
    return (F.octet_length(text) > INLINE_BINARY) & text.contains('"data"')


def elided(text: Column) -> Column:
    """JSON with long strings under ``data`` described; rows that can't hold one go to the UDF as nulls."""
    return F.coalesce(_elide(F.when(elidable(text), text)), text)


def by_reference(text: Column) -> Column:
    """Bodies over INLINE_RESULT bytes as a reference to the evidence, which has them."""
    size = F.octet_length(text)
    # Fixed value: the layout of a reference to the evidence.
    mark = F.format_string('{"$evidence":{"bytes":%d,"reason":"larger than 65536 bytes"}}', size)
    return F.when(size > INLINE_RESULT, mark).otherwise(text)


def file_changes(results: DataFrame, id_col: str = "tool_use_id", result_col: str = "result") -> DataFrame:
    """(tool_use_id, file_path, lines_added, lines_removed, patch_json): one row for each result that names its file."""
    v = F.col(result_col)
    patch = F.try_variant_get(v, "$.structuredPatch", "variant")
    lines = F.flatten(F.transform(blocks_of(patch), lambda h: F.coalesce(blocks_of(F.try_variant_get(h, "$.lines", "variant")), F.array().cast(_BLOCKS))))
    counted = lambda sign: F.coalesce(F.size(F.filter(lines, lambda x: F.startswith(string_at(x, "$"), F.lit(sign)))), F.lit(0)).cast("long")
    named = results.withColumn("file_path", string_at(v, "$.filePath")).filter("file_path IS NOT NULL")  # only objects have a key
    return named.select(
        F.col(id_col).alias("tool_use_id"),
        "file_path",
        F.greatest(counted("+"), F.lit(0)).alias("lines_added"),
        F.greatest(counted("-"), F.lit(0)).alias("lines_removed"),
        F.when(variant_kind(patch).startswith("ARRAY"), F.to_json(patch)).alias("patch_json"),
    )


PATCH = "array<struct<oldStart: long, oldLines: long, newStart: long, newLines: long, lines: array<string>>>"


def patch_lines(changes: DataFrame) -> DataFrame:
    """(tool_use_id, file_path, hunk, pos, kind, text, old_line, new_line): a patch's lines with their numbers. ``+`` moves
    the new number on, ``-`` the old one, ``\\`` neither, the rest both. A malformed patch has no lines."""
    hunks = changes.select("tool_use_id", "file_path", F.posexplode(F.from_json("patch_json", PATCH)).alias("hunk", "h")).filter("h.lines IS NOT NULL AND h.oldStart IS NOT NULL AND h.newStart IS NOT NULL")
    signs = lambda lines: F.transform(lines, lambda x: F.left(x, F.lit(1)))
    # Running counts within a hunk's own array: no shuffle.
    step = lambda s, line, still: F.concat(s, F.array(F.element_at(s, -1) + F.when(line.isin(*still), 0).otherwise(1)))
    start = lambda c: F.array(F.col(c).cast("long"))
    numbered = (
        hunks.withColumn("olds", F.aggregate(signs(F.col("h.lines")), start("h.oldStart"), lambda s, x: step(s, x, ("+", "\\"))))
        .withColumn("news", F.aggregate(signs(F.col("h.lines")), start("h.newStart"), lambda s, x: step(s, x, ("-", "\\"))))
        .select("tool_use_id", "file_path", "hunk", F.posexplode(F.arrays_zip(F.col("h.lines").alias("line"), "olds", "news")).alias("pos", "x"))
        .filter("x.line IS NOT NULL")
    )
    sign = F.left("x.line", F.lit(1))
    return numbered.select(
        "tool_use_id", "file_path", "hunk", "pos",
        F.when(sign == "+", "added").when(sign == "-", "removed").when(sign == "\\", "note").otherwise("same").alias("kind"),
        F.substring("x.line", 2, 1 << 30).alias("text"),
        F.when(~sign.isin("+", "\\"), F.col("x.olds")).alias("old_line"),
        F.when(~sign.isin("-", "\\"), F.col("x.news")).alias("new_line"),
    )
