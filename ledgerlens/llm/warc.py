"""Content-addressed web archive.

Payload bytes are stored once, in a Parquet table keyed by SHA-256 whose rows are told apart by the bytes themselves.
The records' headers are stored exactly and apart, as gzipped text of WARC header blocks. Original records are built
again by joining both on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of a hex string of 40 digits (a SHA-1): five hex digits are four base32 characters."""
    out = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(hexed, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def payload_sha1(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


CONTROLS = [*range(32), 127]
#: A line of our own that says that a record's target is percent-encoded.
ESCAPED = "WARC-X-Target-Escaped"
# Fixed value: the profile of revisits to an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def needs_escape(text: Column) -> Column:
    """Whether a header line cannot hold the text: control characters, or blanks at its ends."""
    return text.rlike(r"[\x00-\x1F\x7F]|^ | $")


def escaped(text: Column) -> Column:
    """Control characters, blanks and ``%`` percent-encoded; unescaped() undoes it."""
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for code in [*CONTROLS, 32]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def unescaped(text: Column) -> Column:
    for code in [*CONTROLS, 32]:
        text = F.replace(text, F.lit(f"%{code:02X}"), F.lit(chr(code)))
    return F.replace(text, F.lit("%25"), F.lit("%"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: Column | None = None
) -> None:
    """Write ``path``/payloads and ``path``/headers: one record for each row of ``pages``. ``date``: a timestamp Column of
    ``pages`` for WARC-Date, the time of writing if it is not given or null.

    Of records with equal payloads that with the largest id is a response, the others revisit it; rows that repeat
    that id are all responses. A null payload counts as empty and null ids as the smallest; a null URL has no
    WARC-Target-URI line. Other columns are ignored; an empty table gives an empty archive.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.date_format(F.coalesce(F.current_timestamp() if date is None else date, F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ssX").alias("date"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Grouping on the payload as well makes the digest verified: two payloads with one digest would be two rows.
    stored = rows.groupBy("digest", "payload").agg(F.max("id").alias("response_id"), F.count("*").alias("n"))
    stored.write.parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "response_id", "n")
    twice = stored.groupBy("digest").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("two payloads share a SHA-256 digest; the archive cannot be keyed by it")
    kept = rows.select(
        "id",
        "url",
        "date",
        "digest",
        F.octet_length("payload").alias("size"),
        payload_sha1(F.col("payload")).alias("sha1"),
    )
    # One payload may be that of very many pages.
    kept = join_groups(kept, stored, "digest", "n", ["response_id"], ["id", "url"])
    revisit = ~F.col("id").eqNullSafe(F.col("response_id"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    name = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.col("date")),
        F.when(F.col("url").isNull(), "").when(needs_escape(F.col("url")), F.concat(line("WARC-Target-URI", escaped(F.col("url"))), line(ESCAPED, F.lit("yes")))).otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("response_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("size").cast("string")),
    )
    kept.select(header.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, url, record_type, refers_to, declared_digest, digest, size, header, payload), headers and payloads
    joined again. A payload that does not have its digest or size is an error."""
    blocks = spark.read.option("lineSep", END).text(f"{path}/headers").select(F.col("value").alias("header"))
    fields = F.str_to_map(F.regexp_replace("header", r"^[^\r]*\r\n", ""), F.lit("\r\n"), F.lit(": "))
    number = lambda key: F.regexp_extract(F.col("f")[key], r"^<urn:page:(-?\d+)>$", 1)
    records = blocks.withColumn("f", fields).select(
        "header",
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("id"),
        F.when(F.col("f")[ESCAPED].isNotNull(), unescaped(F.col("f")["WARC-Target-URI"])).otherwise(F.col("f")["WARC-Target-URI"]).alias("url"),
        F.to_timestamp(F.col("f")["WARC-Date"], "yyyy-MM-dd'T'HH:mm:ssX").alias("date"),
        F.col("f")["WARC-Type"].alias("record_type"),
        F.nullif(F.coalesce(number("WARC-Refers-To"), F.lit("")), F.lit("")).cast("long").alias("refers_to"),
        F.substring_index(F.col("f")["WARC-Payload-Digest"], ":", -1).alias("declared_digest"),
        F.substring_index(F.col("f")["WARC-Block-Digest"], ":", -1).alias("digest"),
        F.col("f")["Content-Length"].cast("long").alias("size"),
    )
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    whole = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("size"))
    bad = F.raise_error(F.concat(F.lit("a stored payload does not have its digest: "), "digest")).cast("binary")
    return records.join(payloads, "digest").withColumn("payload", F.when(whole, F.col("payload")).otherwise(bad))


def record_bytes(record: DataFrame) -> DataFrame:
    """Adds ``record``: the whole WARC record, header block, payload and closing line ends."""
    gap = F.lit(END).cast("binary")
    return record.withColumn("record", F.concat(F.col("header").cast("binary"), gap, F.col("payload"), gap))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
s AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     ((('0x' || substr(x, 5 * (k // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1), '' ORDER BY k)
   FROM range(32) r(k)) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM s
"""
