"""Periodic runs of words in documents, and documents with every run cut down to its first period.

Only stretches whose word n-grams come back soon can hold a run; a suffix tree of each such stretch and one of its reversal
give longest common extensions in constant time, and the roots of all runs are among the longest Lyndon words of the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.suffixtree import suffix_tree
from tillspark.llm.text import EXACT, Words, chunks, mix, windows, words

RUNS = "array<struct<start bigint, length bigint, period bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def gram(least: int, times: int) -> int:
    """Words of an n-gram such that in a run of at least ``least`` words and ``times`` periods each n-gram is met again one
    period on or was met one period before: a run of L words and period q needs L >= 2 * q + gram - 1."""
    return 1 if times < 3 else max(1, (least + 5) // 3)


def stretches(w: Words, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of the parts that may hold runs, with one more word on each side where the text has one.

    Every n-gram of a run has an equal one at most a period away, so a run lies within an unbroken row of such n-grams, and the
    period is at most the ``times``-th part of that row. Rows are shortened by that until nothing changes.
    """
    size = gram(least, times)
    owner = w.owner()
    at = np.flatnonzero(w.left() >= size)
    name = mix(windows(w, size)[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    gap = np.where(same, np.diff(at[order]), np.iinfo(np.int64).max // times)
    near = np.full(len(at), np.iinfo(np.int64).max // times)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    kept = near * times < np.iinfo(np.int64).max // times
    at, near = at[kept], near[kept]
    while len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(at)]
        span = np.repeat(hi - lo + size - 1, hi - lo)
        kept = (span >= least) & (near * times <= span)
        if kept.all():
            for a, b in zip(at[lo].tolist(), (at[hi - 1] + size).tolist()):
                text = int(owner[a])
                yield text, max(a - 1, int(w.first[text])), min(b + 1, int(w.first[text + 1]))
            return
        at, near = at[kept], near[kept]


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller number; the last number is the smallest."""
    out, open_ = [0] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def maximal_runs(names: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the runs among ``names``, by start and period.

    A run's Lyndon root is the longest Lyndon word from its place on, in the order of the letters or in the reverse one (Bannai
    and others, 2017). Each such word is extended to both sides as far as its period holds.
    """
    codes = np.unique(names, return_inverse=True)[1] + 1
    n = len(codes)
    tree = suffix_tree(codes)
    i = np.arange(n)
    ends = [np.array(_next_smaller(x.tolist())[:n], np.int64) for x in (tree.leaf, tree.leaf_reversed)]
    found = np.unique(np.concatenate([i * (n + 1) + end for end in ends]))
    i, end = found // (n + 1), found % (n + 1)
    period = end - i
    after = tree.lce(i, end)
    del tree
    before = suffix_tree(codes[::-1]).lce(n - i, n - end)
    length = before + period + after
    kept = (length >= least) & (length >= times * period)
    return np.unique(np.stack([(i - before)[kept], length[kept], period[kept]], axis=1), axis=0)


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def _searched(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in chunks(texts):
            part = texts.slice(lo, hi - lo)
            w = words(part, EXACT)
            runs: dict[int, list[np.ndarray]] = {}
            for text, a, b in stretches(w, least, times):
                found = maximal_runs(w.hash[a:b], least, times)
                found[:, 0] += a - int(w.first[text])
                runs.setdefault(text, []).append(found)
            rows, collapsed = [], []
            for k, value in enumerate(part.cast(pa.large_binary()).to_pylist()):
                said = (value or b"").split()  # on the ASCII blanks, as the rule of the words has it
                own = np.concatenate(runs.get(k, [np.empty((0, 3), np.int64)]))
                own = own[np.lexsort((own[:, 2], own[:, 0]))]
                if len(own):
                    said = [x for x, stays in zip(said, _kept(len(said), own).tolist()) if stays]
                rows.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                collapsed.append(b" ".join(said))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(w.counts, pa.int64()), pa.array(rows, _RUNS),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and the collapsed text of each row of ``docs``.

    ``docs`` has doc_id and text; other columns are not read. Words are runs without ASCII blanks, compared as they are and
    numbered from 0. A run is a stretch of words that repeats with smallest period q, has at least ``least`` words and ``times``
    periods (2 or more) and that no neighbouring word extends. ``collapsed`` joins by one blank the words that no run contains
    behind its first q. A null or empty text has no words, no runs and an empty collapsed text. Rows are looked at one by one,
    so repeated and null ids are rows like others; nothing is shuffled. No rows give no rows. A stretch of repeating words is
    held by one task with trees of some 400 bytes a word. Words are compared by 64 bits of a hash.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _searched(b, least, times), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where by its id's checksum one text in ten goes on from some word in a repeating group of words.

    With h the CRC-32 of the decimal id and g = floor(h / 10): if h % 10 = 0, the n > 0 words from a = g % n on become the first
    p = 1 + floor((n - a) / (3 + g % 8)) of them, over and over. Other texts, and rows without id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    )
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = chosen.withColumns({"n": n, "a": F.when(n > 0, g % n).cast("int"), "g": g}).withColumn(
        "p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    )
    left = F.col("n") - F.col("a")
    copies = F.ceil(left / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), copies)), F.lit(1), left)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def _stronger(a: Column, b: Column) -> Column:
    """Order of runs: more periods (exactly), then the earlier start, then the shorter period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    first = F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
    return first.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)


def digest(found: DataFrame) -> DataFrame:
    """Per row: how many runs, the one with the most periods, and checksums of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = found.withColumn("best", F.get(F.array_sort("runs", _stronger), F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
