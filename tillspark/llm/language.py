"""Language identification of web pages by Bayesian evidence fusion.

Four witnesses give log-odds for each language: the text (character trigrams, naive Bayes), the language that the markup
declares, the suffix of the address, and the host. Text chances are fitted on labelled documents; how far declared language
and suffix can be trusted is counted on the pages themselves, against what their text says. A host's prior is the mix of
languages among its pages, smoothed towards its domain, which is smoothed towards all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm import tables
from tillspark.llm import text as T
from tillspark.session import materialise

BITS = 16  # of the table of hashed trigrams a language
MOST_LANGUAGES = 500
WEIGHT = 0.1  # of a trigram against independence: neighbours repeat each other
TRUST = 20.0  # pages that a prior of the level above counts as
LEAST_SHARE = 1e-6


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text's byte trigrams, letters in lower case, and where each text's begin."""
    data, offsets = T._bytes(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    low = np.where((low >= 97) | (low == 39), low, 32)
    if len(low) < 3:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]).astype(np.uint64)
    inside = np.ones(len(code), bool)
    ends = offsets[1:]
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    inside &= (low[:-2] != 32) | (low[1:-1] != 32)
    return tables.slot(T.mix(code), BITS)[inside], np.searchsorted(np.flatnonzero(inside), offsets)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and for each the log-chances of hashed trigrams, from all documents whose language is given."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    names = [r[0] for r in known.select(lang).distinct().orderBy(lang).limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    width = 1 << BITS

    def count(batches):
        sums = np.zeros(len(names) * width, np.int64)
        place = {n: k for k, n in enumerate(names)}
        for batch in batches:
            column = batch.column(1)
            for lo, hi in T.chunks(column):
                code, first = _trigrams(column.slice(lo, hi - lo))
                of = np.array([place[x] for x in batch.column(0).slice(lo, hi - lo).to_pylist()])
                sums += np.bincount(np.repeat(of, np.diff(first)) * width + code, minlength=len(sums))
        found = list(tables.cells(sums))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=tables.CELL_SCHEMA)

    counts = tables.gathered(known.mapInArrow(count, "cell int, counts binary"), len(names) * width).reshape(len(names), width)
    return names, np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * width)


# what a page shows outside tags, scripts and styles, and what its markup and address say
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;"
_DECLARED = r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})"""
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, suffix, declared and the visible text; each null where the page doesn't give it."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)), F.lit(""))
    labels = F.split(host, r"\.")
    return pages.select(
        "page_id",
        host.alias("host"),
        F.when(host.isNotNull(), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("domain"),
        F.when(host.isNotNull(), F.element_at(labels, -1)).alias("suffix"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _DECLARED, 1)), F.lit("")).alias("declared"),
        F.regexp_replace(F.coalesce("html", F.lit("")), _HIDDEN, " ").alias("visible"),
    )


def _likelihoods(df: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """``df`` without its last column, the text, and with the log-likelihood of each language instead."""
    shared = df.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("visible")
            for lo, hi in T.chunks(column):
                code, first = _trigrams(column.slice(lo, hi - lo))
                n = np.diff(first)
                sums = np.concatenate([np.zeros((len(names), 1)), np.cumsum(shared.value[:, code], axis=1)], axis=1)
                found = (sums[:, first[1:]] - sums[:, first[:-1]]).T * WEIGHT
                found -= found.max(axis=1, keepdims=True)
                part = batch.slice(lo, hi - lo).drop_columns(["visible"])
                yield T.with_arrow(part, {"n_grams": pa.array(n), "logs": pa.array(found.tolist(), pa.list_(pa.float64()))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "visible")
    return df.mapInArrow(run, f"{schema}, n_grams bigint, logs array<double>")


def _shares(logs):
    """Chances from an array of log weights."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _summed(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """For each key, the pages and the sum of their language shares, as an array."""
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(k)]
    return df.groupBy(*keys).agg(F.count("*").alias("pages"), *sums).select(*keys, "pages", F.array(*(f"s{i}" for i in range(k))).alias("sums"))


def _smoothed(own, pages, above):
    return F.zip_with(own, above, lambda a, b: (a + b * TRUST) / (pages + TRUST))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suffix, lang, confidence, text_lang of every page.

    ``pages`` has page_id, url and html, ``docs`` labelled text (lang, text); other columns are not read. Each witness that a
    page lacks (null or unreadable address, no declared language, no visible text) says nothing. A declared language or suffix
    is as strong as its pages' texts bear it out: its log-odds are those of the languages that it goes with, against all pages,
    smoothed. The page itself counts in its host's prior as one page among the others. Repeated pages are rows of their own;
    ties go to the first language by name. Without labelled documents ``lang`` and ``confidence`` are null.
    """
    names, logs = fit(docs)
    k = len(names)
    if not k:
        nothing = F.lit(None).cast("string")
        return evidence(pages).select("page_id", "host", "declared", "suffix", nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"))
    read = materialise(_likelihoods(evidence(pages), names, logs).withColumn("share", _shares(F.col("logs"))))
    equal = F.array(*[F.lit(1.0 / k)] * k)
    levels = _summed(read, [], k).select(_smoothed(F.col("sums"), F.col("pages"), equal).alias("base"))
    levels = levels.first()["base"] if read.take(1) else [1.0 / k] * k
    base = F.array(*(F.lit(float(x)) for x in levels))

    def lifts(column: str) -> DataFrame:
        """What one value of a witness says: log of its smoothed language shares against all pages."""
        sums = _summed(read.where(F.col(column).isNotNull()), [column], k)
        odds = F.zip_with(_smoothed(F.col("sums"), F.col("pages"), base), base, lambda a, b: F.log(F.greatest(a, F.lit(LEAST_SHARE)) / b))
        return sums.select(F.col(column).alias(f"its_{column}"), odds.alias(f"{column}_odds"))

    domains = _summed(read.where("domain is not null"), ["domain"], k)
    domains = domains.select("domain", _smoothed(F.col("sums"), F.col("pages"), base).alias("above"))
    hosts = _summed(read.where("host is not null"), ["host", "domain"], k).join(domains, "domain")
    hosts = hosts.select(F.col("host").alias("its_host"), _smoothed(F.col("sums"), F.col("pages"), F.col("above")).alias("prior"))
    out = read
    for column, table in (("host", hosts), ("declared", lifts("declared")), ("suffix", lifts("suffix"))):
        out = out.join(table, F.col(column) == F.col(f"its_{column}"), "left")
    none = F.array(*[F.lit(0.0)] * k)
    parts = [
        F.col("logs"),
        F.transform(F.coalesce("prior", base), lambda x: F.log(F.greatest(x, F.lit(LEAST_SHARE)))),
        F.coalesce("declared_odds", none),
        F.coalesce("suffix_odds", none),
    ]
    fused = parts[0]
    for p in parts[1:]:
        fused = F.zip_with(fused, p, lambda a, b: a + b)
    out = out.withColumn("fused", _shares(fused))
    called = F.array(*map(F.lit, names))

    def best(shares):
        return F.element_at(called, F.array_position(shares, F.array_max(shares)).cast("int"))

    return out.select(
        "page_id", "host", "declared", "suffix", best(F.col("fused")).alias("lang"), F.array_max("fused").alias("confidence"),
        F.when(F.col("n_grams") > 0, best(F.col("share"))).alias("text_lang"),
    )
