"""URL filters by association rules. DataFrame functions and Spark ML only.

FP-growth mines combinations of URL tokens that go with the label ``block``; rules with enough support and confidence
are matched through an inverted index: each rule waits under its rarest token, so a common token such as a top-level
domain pulls in few rules, and the rest of a rule is checked on the spot. Rules are closed: tokens that always occur
together are one item, so the long URL of many pages is one item and not all subsets of its words.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_checked, join_groups, materialize

#: Fixed list: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LABEL = "label=block"
MIN_SUPPORT, MIN_CONFIDENCE = 0.001, 0.6
#: A rule holds for so many labelled rows at least, however few there are, and says more than the label's own share.
LEAST_ROWS, LEAST_LIFT = 5, 1.2
#: A rule has so many items at most. FP-growth mines rows of up to FP_ITEMS items.
RULE_ITEMS, FP_ITEMS = 3, 16
#: A repeated row is handed to FP-growth in blocks of so many.
REPEAT = 1000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels (``h:``), path words (``p:``; numbers as one class) and query keys (``q:``)."""
    words = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("#"), F.char_length(x))).otherwise(x)
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    return F.array_distinct(
        F.concat(
            F.transform(words(host, r"[^.:]+"), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(words(ascii_lower(path), r"[^/._\-]+"), lambda x: F.concat(F.lit("p:"), number(x))),
            F.transform(query, lambda x: F.concat(F.lit("q:"), ascii_lower(x))),
        )
    )


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = None
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        here = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        found = F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, found) if fits is None else fits.when(here, found)
    return fits


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    least_rows: int = LEAST_ROWS,
    rule_items: int = RULE_ITEMS,
    fp_items: int = FP_ITEMS,
) -> DataFrame:
    """labelled(tokens array<string>, block boolean) -> rules (antecedent, key, confidence, support, lift): those that end in
    ``block`` and hold for ``min_support`` of the rows and ``least_rows`` of them. All labelled rows are used.

    Tokens that occur in the same rows, such as those of a URL that many rows repeat, are one item: what holds for one
    of them holds for all, and a rule lists them all. A rule has up to ``rule_items`` items, and goes where one with
    a part of its items has as much confidence. ``key`` is the antecedent's rarest token. FP-growth lists every subset of
    a row's items; where a row has more than ``fp_items`` of them, sets are counted size by size instead, with the
    same rules.
    """
    rows = labelled.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).groupBy("tokens")
    rows = rows.agg(F.count("*").alias("n"), F.count_if("block").alias("bad")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "op10-rows")
    total, bad = rows.agg(F.sum("n"), F.sum("bad")).first()
    least = max(least_rows, math.ceil(min_support * (total or 0) - 1e-6), 1)
    share = (bad or 0) / max(total or 0, 1)
    posted = rows.select("row", "n", "bad", F.explode("tokens").alias("token"))
    # Two 64-bit hashes and three counts say in which rows a token is.
    here = F.struct(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    tokens = posted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), here.alias("here"))
    items = tokens.filter(F.col("bad") >= least).groupBy("n", "bad", "here").agg(F.array_sort(F.collect_set("token")).alias("members"))
    items = items.select(F.col("members")[0].alias("item"), "members", "n", "bad", F.col("here.rows").alias("in_rows"))
    items = materialize(items.withColumn("sure", F.col("n") == F.col("bad")), "op10-items")

    # An item that is always blocked is a rule; no longer set with it is one, so longer sets are of the other items.
    open_items = items.filter(~F.col("sure")).select(F.col("item").alias("token"), "in_rows", "sure")
    held = join_groups(posted, open_items, "token", "in_rows", ["sure"], ["row"])
    baskets = held.groupBy("row", "n", "bad").agg(F.array_sort(F.collect_set("token")).alias("items"))
    baskets = materialize(baskets.filter(F.size("items") > 1), "op10-baskets")
    longest = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    sets = items.select(F.array("item").alias("set"), "n", "bad")
    if longest and rule_items > 1:
        longer = _by_fp_growth(baskets, least) if longest <= fp_items else _by_size(baskets, least, rule_items)
        sets = sets.unionByName(longer.filter(F.size("set").between(2, rule_items)))
    rules = sets.select(
        "set", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(max(total or 0, 1))).alias("support")
    ).withColumn("lift", F.col("confidence") / F.lit(share or 1.0))
    rules = rules.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= LEAST_LIFT))
    rules = _plain_rules(materialize(rules, "op10-mined"), rule_items)
    named = rules.select("*", F.explode("set").alias("item")).join(items.select("item", "members", "n"), "item")
    return named.groupBy("set", "confidence", "support", "lift").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("antecedent"), F.min(F.struct("n", "item"))["item"].alias("key")
    ).select("antecedent", "key", "confidence", "support", "lift")


def _by_fp_growth(baskets: DataFrame, least: int) -> DataFrame:
    """(set, n, bad) of the sets of items with ``least`` blocked rows, among the ``baskets`` (row, n, bad, items)."""
    blocks = F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(REPEAT).cast("long"))
    dealt = baskets.withColumn("start", F.explode(blocks)).repartition("row", "start")
    one = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + REPEAT, F.col("n")) - 1))
    items = dealt.withColumn("k", one).select(
        F.when(F.col("k") < F.col("bad"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items")
    )
    count = max(baskets.agg(F.sum("n")).first()[0] or 0, 1)
    # The small number keeps a count of exactly least in. The conditional trees are dealt out by item.
    model = FPGrowth(
        itemsCol="items", minSupport=min((least - 1e-6) / count, 1.0), minConfidence=0.0,
        numPartitions=int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    ).fit(items)
    # A set's blocked rows are those of the set with the label.
    named = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: x != LABEL)).alias("set"), "items", "freq")
    labelled = F.array_contains("items", LABEL)
    return (
        named.filter(F.size("set") > 0)
        .groupBy("set")
        .agg(F.max(F.when(~labelled, F.col("freq"))).alias("n"), F.max(F.when(labelled, F.col("freq"))).alias("bad"))
        .filter("bad IS NOT NULL")
    )


def _by_size(baskets: DataFrame, least: int, rule_items: int) -> DataFrame:
    """The same sets, up to ``rule_items`` items each: a set is counted where the one without its last item is frequent."""
    found = None
    level = baskets.withColumn("set", F.explode(F.transform("items", lambda x: F.array(x))))
    for size in range(2, rule_items + 1):
        after = F.explode(F.filter("items", lambda x: x > F.element_at("set", -1)))
        level = level.withColumn("last", after).withColumn("set", F.concat("set", F.array("last"))).drop("last")
        counts = level.groupBy("set").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
        counts = materialize(counts, "op10-sets")
        found = counts if found is None else found.unionByName(counts)
        level = join_checked(level, counts.select("set"), ["set"], "left_semi", "op10-frequent")
    return found


def _plain_rules(rules: DataFrame, rule_items: int) -> DataFrame:
    """Without rules that one of a part of their items covers: each rule looks its parts up."""
    if rule_items < 2:
        return rules
    # The parts of a set are the sets of its bits.
    bits = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("set")) - 2).cast("int"))
    part = F.filter("set", lambda x, i: F.getbit("mask", i) == 1)
    parts = rules.filter(F.size("set") > 1).select("set", "confidence", F.explode(bits).alias("mask"))
    parts = parts.select("set", "confidence", part.alias("part"))
    sure = rules.select(F.col("set").alias("part"), F.col("confidence").alias("sure"))
    covered = parts.join(sure, "part").filter(F.col("sure") >= F.col("confidence")).select("set").distinct()
    return rules.join(covered, "set", "left_anti")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, tokens) with distinct urls -> (url, confidence) of those that some rule blocks."""
    posted = urls.select("url", "tokens", F.explode("tokens").alias("key"))
    # A common token has very many URLs: as long as the rules are few they go to the URLs.
    met = join_checked(posted, rules.select("key", "antecedent", "confidence"), ["key"], "inner", "op10-keyed")
    return (
        met.filter(F.forall("antecedent", lambda x: F.array_contains("tokens", x)))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    fixed: tuple = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """One row for each row of ``pages``: (id_col, host, path, rule, verdict, confidence).

    The fixed rules decide where one fits (the longest); elsewhere the mined rules block or allow. A page is labelled
    ``block`` where its id's label has quality 0; null qualities are no labels. A null URL or one without ``://`` has an
    empty host and path and no tokens: it is allowed. Rows that repeat an id are judged alike. Without labelled pages
    nothing is mined. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    known = (
        labels.filter(F.col(quality_col).isNotNull())
        .groupBy(F.col(label_id_col).alias("id"))
        .agg((F.min(quality_col) == 0).alias("block"))
    )
    labelled = rows.join(known, "id").select(tokens_of(host, path, F.col("url")).alias("tokens"), "block")
    rules = materialize(mine(labelled, min_support, min_confidence, least_rows), "op10-rules")
    # Each URL is judged once. The rows of a URL that very many pages have are dealt by id; null URLs have nothing to meet.
    urls = materialize(rows.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n")), "op10-urls")
    blocked = blocked_urls(urls.select("url", tokens_of(host, path, F.col("url")).alias("tokens")), rules)
    told = materialize(urls.join(blocked, "url", "left"), "op10-judged")
    met = join_groups(rows.filter(F.col("url").isNotNull()), told, "url", "n", ["confidence"], ["id"])
    judged = met.unionByName(rows.filter(F.col("url").isNull()).withColumn("confidence", F.lit(None).cast("double")))
    judged = judged.select("id", host.alias("host"), path.alias("path"), "confidence")
    found = judged.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    return found.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
