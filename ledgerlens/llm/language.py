"""Language ID by Bayesian evidence fusion.

Text gives a likelihood for each language (character trigrams, over the whole text). Metadata gives a prior: languages
counted by host, smoothed towards those of the host's address suffix, which are smoothed towards those of the
corpus; and the declared markup language gives a likelihood through a confusion table. All of these counts come from
grouped aggregation over all documents. ``und`` stands for text that no language explains better than chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_checked, materialize, text_batches

#: Trigrams are hashed to so many classes.
CLASSES = 1 << 15
#: The text model has every label of so many documents in the whole table. It is fitted on distinct texts: about so many
#: in all, shared out evenly among the labels, but about LABEL_DOCS of each at least. Everything else counts all documents.
LEAST_DOCS, SAMPLE_DOCS, LABEL_DOCS = 5, 20_000, 200
#: Neighbouring trigrams overlap, so their log-likelihoods are not independent evidence.
TEMPER = 1 / 3
#: Pseudo-counts: of trigram classes, of a host's prior, of a suffix's prior, of the confusion table.
TRIGRAM_COUNT, HOST_COUNT, SUFFIX_COUNT, CONFUSION_COUNT = 0.5, 20.0, 20.0, 1.0
BLOCK = 1 << 16
#: Tables of up to so many hosts or declared values are broadcast.
MOST_BROADCAST = 20_000
UNKNOWN = "und"


def trigram_classes(text: str) -> Iterator[np.ndarray]:
    """Classes of the lower-cased text's trigrams, block by block; what is not a letter is one symbol, and trigrams
    without a letter are left out."""
    text = text.lower()
    for k in range(0, len(text), BLOCK):
        part = text[max(0, k - 2) : k + BLOCK]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = ((code >= 97) & (code <= 122)) | ((code > 0xBF) & (code != 0xD7) & (code != 0xF7))
        code = np.where(letter, code, np.uint64(32))
        if len(code) < 3:
            continue
        mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        yield (mixed >> np.uint64(49))[letter[:-2] | letter[1:-1] | letter[2:]].astype(np.int64)


class TextModel:
    """Log-likelihoods of the trigram classes by language; the last row is ``und``: all classes alike."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = counts + TRIGRAM_COUNT
        known = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.empty((0, CLASSES))
        self.table = np.vstack([known, np.full((1, CLASSES), -np.log(CLASSES))]).astype(np.float32)

    def scores(self, text: str | None) -> list[float]:
        total = np.zeros(len(self.languages))
        for classes in trigram_classes(text or ""):
            total += self.table[:, classes].sum(axis=1, dtype=np.float64)
        return (TEMPER * total).tolist()


def fit_text_model(docs: DataFrame, text: Column, label: Column, sample_docs: int = SAMPLE_DOCS) -> TextModel:
    """Fitted on distinct texts of every label with LEAST_DOCS documents: all of them in tables of up to ``sample_docs``
    labelled documents, beyond that each label's share of ``sample_docs`` (LABEL_DOCS at least), picked by a hash of the
    text."""
    labelled = docs.select(label.alias("label"), text.alias("text")).filter("label IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    often = sorted((r for r in sizes if r["n"] >= LEAST_DOCS), key=lambda r: r["label"])
    languages = [r["label"] for r in often]
    share = max(LABEL_DOCS, sample_docs // max(len(often), 1)) if sum(r["n"] for r in sizes) > sample_docs else float("inf")
    rates = [(r["label"], int(min(1.0, share / max(r["texts"], 1)) * (1 << 30))) for r in often]
    rates = docs.sparkSession.createDataFrame(rates, "label string, below long")
    picked = labelled.join(F.broadcast(rates), "label").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("below"))
    picked = picked.select("label", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(name, np.zeros(CLASSES, np.int64))
                for classes in trigram_classes(body):
                    own += np.bincount(classes, minlength=CLASSES)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                ["label", "class", "n"],
            )

    rows = picked.mapInArrow(count, "label string, class long, n long").groupBy("label", "class").agg(F.sum("n").alias("n"))
    rows = rows.toArrow()
    counts = np.zeros((len(languages), CLASSES))
    place = {x: k for k, x in enumerate(languages)}
    at = np.array([place[x] for x in rows["label"].to_pylist()], np.int64)
    counts[at, rows["class"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    return TextModel(languages, counts)


def suffix_of(host: Column) -> Column:
    """The part after the host's last full stop; empty if there is none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def _scorer(shared) -> object:
    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.scores(t if isinstance(t, str) else None) for t in texts])

    return scores


def _shares(counts: DataFrame, by: list[str], parent: DataFrame, on: list[str], weight: float) -> DataFrame:
    """P(language | by): the group's counts with ``weight`` pseudo-counts shared out as the parent says."""
    each = counts.groupBy(*by, "best").agg(F.sum("n").alias("n"))
    spread = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("got"), F.sum("n").alias("all"))
    joined = spread.join(parent, on) if on else spread.crossJoin(parent)
    share = F.transform_values(
        "up", lambda k, v: (F.coalesce(F.try_element_at("got", k), F.lit(0)) + weight * v) / (F.col("all") + weight)
    )
    return joined.select(*by, share.alias("share"))


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared_col: str = "lang",
    host_col: str = "source",
    model: TextModel | None = None,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """``docs``' columns and language (string), confidence (double), text_language (string), kept (boolean).

    A document is rejected (kept is false) when ``und`` is the most probable, but not where its declared language has too few
    documents for a class (LEAST_DOCS): no class could have explained its text. A null or letterless text has no
    evidence of its own: its metadata decide, and without any its language is the corpus's most frequent. Null
    declarations and hosts are values of their own. Ties go to the language that is first by name. Added columns that clash
    get underscores in front. Without a labelled document every language is ``und`` and all documents with letters are
    rejected.
    """
    text_batches(docs.sparkSession)
    text, declared = F.col(text_col).cast("string"), F.coalesce(F.lower(F.col(declared_col).cast("string")), F.lit(""))
    host = F.coalesce(F.lower(F.col(host_col).cast("string")), F.lit(""))
    model = model or fit_text_model(docs, text, F.lower(F.col(declared_col).cast("string")), sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score, names = _scorer(shared), F.array(*[F.lit(x) for x in model.languages])
    best_of = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    counts = (
        docs.select(host.alias("host"), declared.alias("declared"), score(text).alias("s"))
        .select("host", suffix_of(F.col("host")).alias("suffix"), "declared", best_of(F.col("s")).alias("best"))
        .groupBy("host", "suffix", "declared", "best")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts, "op8-counts")
    even = F.map_from_arrays(names, F.array_repeat(F.lit(1.0 / len(model.languages)), len(model.languages)))
    root = docs.sparkSession.range(1).select(even.alias("up"))
    corpus = _shares(counts.withColumn("all_rows", F.lit(1)), ["all_rows"], root, [], float(len(model.languages)))
    by_suffix = _shares(counts, ["suffix"], corpus.select(F.col("share").alias("up")), [], SUFFIX_COUNT)
    by_host = _shares(counts, ["host", "suffix"], by_suffix.withColumnRenamed("share", "up"), ["suffix"], HOST_COUNT)
    # P(declared | language), for the declared values there are.
    told = counts.groupBy("declared", "best").agg(F.sum("n").alias("n"))
    of_best = told.groupBy("best").agg(F.sum("n").alias("of_best"))
    confusion = (
        told.join(of_best, "best")
        .groupBy("declared")
        .agg(F.map_from_entries(F.collect_list(F.struct("best", F.struct("n", "of_best")))).alias("got"))
    )
    kinds = told.agg(F.count_distinct("declared").alias("kinds"))
    sizes = of_best.agg(F.map_from_entries(F.collect_list(F.struct("best", "of_best"))).alias("sizes"))
    likelihood = F.transform(
        names,
        lambda x: (F.coalesce(F.try_element_at("got", x)["n"], F.lit(0)) + CONFUSION_COUNT)
        / (F.coalesce(F.try_element_at("sizes", x), F.lit(0)) + CONFUSION_COUNT * F.col("kinds")),
    )
    confusion = confusion.crossJoin(kinds).crossJoin(sizes).select("declared", likelihood.alias("told"))

    h, d, s, up, told_at = (fresh(docs, x) for x in ("host_key", "declared_key", "text_scores", "prior", "told"))
    scored = docs.withColumn(h, host).withColumn(d, declared).withColumn(s, score(text))
    by_host = by_host.select(F.col("host").alias(h), F.col("share").alias(up))
    confusion = confusion.select(F.col("declared").alias(d), F.col("told").alias(told_at))
    # A row for each host or declared value, with a number for each language.
    joined = join_checked(scored, by_host, [h], "left", "op8-hosts", MOST_BROADCAST)
    joined = join_checked(joined, confusion, [d], "left", "op8-declared", MOST_BROADCAST)
    logs = F.zip_with(
        F.zip_with(names, told_at, lambda x, t: F.ln(t) + F.ln(F.try_element_at(up, x))), s, lambda a, b: a + b
    )
    fused = fresh(joined, "fused")
    language, confidence, text_language, kept = (fresh(docs, x) for x in ("language", "confidence", "text_language", "kept"))
    most = F.array_max(fused)
    total = F.aggregate(F.transform(fused, lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x)
    return (
        joined.withColumn(fused, logs)
        .withColumn(language, best_of(F.col(fused)))
        .withColumn(confidence, 1.0 / total)
        .withColumn(text_language, best_of(F.col(s)))
        .withColumn(kept, (F.col(language) != UNKNOWN) | ((F.col(d) != "") & ~F.array_contains(names, F.col(d))))
        .select(*docs.columns, language, confidence, text_language, kept)
    )


def keep_known(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that identify() does not reject."""
    found = identify(docs, text_col, declared_col, host_col)
    return found.filter(found[found.columns[len(docs.columns) + 3]]).select(*docs.columns)
