"""Toxicity from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are fitted on labelled rows: bigrams by how often they occur, words and
beginnings of words by their numbers of different left neighbours, each count less a discount for 1, 2 or more that follows
from the counts of counts. No count is dropped; the mass that discounting frees backs off from bigrams to unigrams of the
class, from them to the beginnings of words, and to counts of the whole corpus, which both classes share. How far a word's
ratio of the classes follows its bigram, its unigram or its beginning grows with how often the classes have seen each, so one
sight says little but never nothing. A document's length-normalised log-likelihoods under the two models are compared over the whole text and over its strongest expressions; a logistic curve
fitted on further labelled rows turns both into a score.
"""

from __future__ import annotations

import gc
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import tables
from tillspark.llm import text as T
from tillspark.session import materialise

PER_CLASS = 4000  # labelled documents that fit the counts of a class, and again as many for the curve: bounds the model
HEAD = 4  # bytes of a word's beginning
LEAST_KEPT = 0.05  # of a discount, and of a count after it
HALF_TRUST = 30.0  # sights in both classes from which an expression's own ratio has half of the weight
SHARED = 0.5  # part of the backoff that goes to the shared counts at once
STRONGEST = 2  # expressions compared on their own
CHUNK = 1 << 20  # bytes of text that a task works on at a time
THRESHOLD = 0.3
_START = np.uint64(0xA5A5A5A5A5A5A5A5)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    """Sorted hashes with, for toxic (row 0) and ordinary (row 1): bigram counts and their discounts, bigrams and share left of
    contexts, unigram mass, chance of a beginning against the shared counts; the share left by all unigrams; and the chances of
    words and bigrams by the shared counts. The last place of each is for what is not among the hashes."""

    bigrams: np.ndarray
    bigram_count: np.ndarray
    discounts: np.ndarray
    contexts: np.ndarray
    context_total: np.ndarray
    context_left: np.ndarray
    words: np.ndarray
    word_mass: np.ndarray
    heads: np.ndarray
    head_lift: np.ndarray
    spare: np.ndarray
    shared_word: np.ndarray
    shared_bigram: np.ndarray
    trust: tuple[np.ndarray, ...]  # of words and beginnings


class Fitted:
    """A model that has been sent to the workers once, and the curve over its features."""

    def __init__(self, spark: SparkSession, model: Model):
        self.sent = spark.sparkContext.broadcast(model)
        self.curve = np.zeros(3)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (0 without id)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def _sample(labels: DataFrame, docs: DataFrame, folds: tuple[int, ...], per_class: int) -> DataFrame:
    """doc_id, toxic and text of the same number of labelled documents of each class, chosen by hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & fold().isin(*folds))
    known = materialise(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = min(sizes.get(0, 0), sizes.get(1, 0), per_class)
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # at most 2 * per_class ids


def _before(w: T.Words) -> np.ndarray:
    """The word before each word; the start of a text counts as a word."""
    one = np.empty_like(w.hash)
    one[1:] = w.hash[:-1]
    one[w.first[:-1][w.counts > 0]] = _START
    return one


def _pair(one: np.ndarray, word: np.ndarray) -> np.ndarray:
    return T.mix(one * _PAIR + word)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in T.chunks(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            w = T.words(part.column("text"), T.PLAIN, HEAD)
            one = _before(w)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)[w.owner()]
            columns = [pa.array(toxic), *(pa.array(x.view(np.int64)) for x in (one, w.hash, w.head))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "context", "word", "head"])


def _discounts(seen: dict[int, int]) -> np.ndarray:
    """What counts of 1, 2, and 3 and more lose, which follows from how many counts are 1, 2, 3 and 4."""
    n = [max(1, seen.get(k, 0)) for k in range(1, 5)]
    share = n[0] / (n[0] + 2 * n[1])
    return np.array([min(max(k - (k + 1) * share * n[k] / n[k - 1], LEAST_KEPT), k - LEAST_KEPT) for k in (1, 2, 3)])


def _kept(count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.where(count > 0, count - off[np.clip(count, 1, 3) - 1], 0.0)


def _look(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of codes in sorted keys; the place behind the last for those that aren't there."""
    if not len(keys):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, at, len(keys))


def _counted(docs: DataFrame, *keys: np.ndarray) -> tuple[list[np.ndarray], int]:
    """How often each of the sorted words, bigrams and beginnings occurs in all documents, and how many words these have."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    cuts = np.cumsum([0, *(len(k) + 1 for k in keys)])

    def run(batches):
        counts, every = np.zeros(cuts[-1] + 1, np.int32), 0
        for batch in batches:
            for lo, hi in T.chunks(batch.column(0), CHUNK):
                w = T.words(batch.column(0).slice(lo, hi - lo), T.PLAIN, HEAD)
                one = _before(w)
                for k, codes in enumerate((w.hash, _pair(one, w.hash), w.head)):
                    found, n = np.unique(_look(shared.value[k], codes), return_counts=True)
                    counts[cuts[k] + found] += n.astype(np.int32)
                every += len(w.hash)
        counts[-1] = every
        found = list(tables.cells(counts))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=tables.CELL_SCHEMA)

    counts = tables.gathered(docs.select("text").mapInArrow(run, "cell int, counts binary"), int(cuts[-1]) + 1)
    shared.destroy()  # the counts have been gathered
    return [counts[a : b - 1] for a, b in zip(cuts[:-1], cuts[1:])], int(counts[-1])


def _model(docs: DataFrame, sample: DataFrame) -> Model:
    bigrams = sample.select("toxic", "text").mapInArrow(_bigrams, "toxic int, context bigint, word bigint, head bigint")
    pairs = materialise(bigrams.groupBy("toxic", "context", "word", "head").agg(F.count("*").alias("n")))
    words = materialise(pairs.groupBy("toxic", "word", "head").agg(F.count("*").alias("n")))
    heads = materialise(words.groupBy("toxic", "head").agg(F.sum("n").alias("n")))
    totals = pairs.groupBy("toxic", "context").agg(F.sum("n").alias("total"))

    def few(df: DataFrame) -> dict[int, int]:
        return {r["n"]: r["count"] for r in df.where("n <= 4").groupBy("n").count().collect()}

    def arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
        """Hashes as 64-bit and counts as 32-bit numbers."""
        table = df.select(*columns).toArrow()  # bounded by the sample
        found = [table.column(c).to_numpy() for c in columns]
        del table
        pa.default_memory_pool().release_unused()
        return [x.astype(np.int32) if c in ("n", "total") else x.astype(np.int64, copy=False).view(np.uint64) for c, x in zip(columns, found)]

    def of(df: DataFrame, c: int) -> DataFrame:
        return df.where(F.col("toxic") == c)

    kept = []  # of both classes: hashes, figures and counts of bigrams, contexts, words and beginnings
    for c in (1, 0):
        own, of_heads = of(words, c), of(heads, c)
        ctx, total = arrays(of(totals, c), "context", "total")
        order = np.argsort(ctx)
        single, single_n = arrays(own, "word", "n")
        head, head_n = arrays(of_heads, "head", "n")
        every = own.agg(F.sum("n")).first()[0] or 1
        alone, begun = _kept(single_n, _discounts(few(own))) / every, _kept(head_n, _discounts(few(of_heads))) / every
        kept.append(([None, ctx[order], single, head], [None, total[order], alone, begun], [None, None, single_n, head_n]))
    known = np.unique(np.concatenate([y for x in kept for y in x[0][1:3]]))
    parts, off, left = [], [], []
    for c, (own, values, counts) in zip((1, 0), kept):
        context, word, counts[0] = arrays(of(pairs, c), "context", "word", "n")
        off.append(_discounts(few(of(pairs, c))))
        own[0], at = _pair(context, word), np.searchsorted(own[1], context)
        parts.append([np.searchsorted(known, x).astype(np.int32) for x in (context, word)])
        del context, word
        left.append(1 - np.bincount(at, _kept(counts[0], off[-1]), minlength=len(own[1])) / values[1])
        del at
    bigrams, contexts, vocabulary, beginnings = keys = [np.unique(np.concatenate([x[0][k] for x in kept])) for k in range(4)]
    filled = [np.full((2, len(k) + 1), k is contexts, np.float32) for k in keys[1:]]
    context_left = np.ones_like(filled[0])
    sights = [np.zeros(len(k) + 1, np.float32) for k in keys[2:]]
    most = max((int(x[2][0].max(initial=0)) for x in kept), default=0)
    bigram_count = np.zeros((2, len(bigrams) + 1), np.uint16 if most < 1 << 16 else np.uint32)
    for row, (own, values, counts) in enumerate(kept):
        at = np.searchsorted(bigrams, own[0])
        bigram_count[row, at] = counts[0]
        parts[row].insert(0, at.astype(np.int32))
        for k in (1, 2, 3):
            at = np.searchsorted(keys[k], own[k])
            filled[k - 1][row, at] = values[k]
            if k == 1:
                context_left[row, at] = left[row]
            else:
                sights[k - 2][at] += counts[k]
        own[:] = values[:] = counts[:] = [None] * 4
    del at
    trust = tuple(x / (x + np.float32(HALF_TRUST)) for x in sights)
    (of_words, of_bigrams, of_heads), every = _counted(docs, known, bigrams, beginnings)
    chance = np.append(of_words + 1, 1) / (every + len(known) + 1)
    shared_bigram = np.zeros(len(bigrams) + 1, np.float32)
    for at, context, word in parts:
        shared_bigram[at] = (of_bigrams[at] + chance[word]) / (of_words[context] + 1)
    shared_word = chance[_look(known, np.append(vocabulary, np.uint64(0)))]
    shared_word[-1] = chance[-1]
    spare, spare_heads = (1 - f.sum(axis=1, keepdims=True, dtype=float) for f in filled[1:])
    lift = filled[2] * (every + len(beginnings) + 1) / np.append(of_heads + 1, 1) + spare_heads
    return Model(bigrams, bigram_count, np.array(off), contexts, filled[0], context_left, vocabulary, filled[1], beginnings, lift, spare, shared_word, shared_bigram, trust)


def _features(texts: pa.Array, model: Model) -> np.ndarray:
    """For each text: difference of the log-likelihoods by word, over all words and over the strongest expressions."""
    w = T.words(texts, T.PLAIN, HEAD)
    out = np.zeros((len(texts), 2))
    if not len(w.hash):
        return out
    one = _before(w)
    word, bigram = _look(model.words, w.hash), _look(model.bigrams, _pair(one, w.hash))
    shared = np.where(bigram < len(model.bigrams), model.shared_bigram[bigram], model.shared_word[word])
    head = _look(model.heads, w.head)
    begun = model.spare * model.shared_word[word] * model.head_lift[:, head]
    single = SHARED * shared + (1 - SHARED) * (model.word_mass[:, word] + begun)
    context, seen = _look(model.contexts, one), model.bigram_count[:, bigram].astype(np.int64)
    mass = np.stack([_kept(n, off) for n, off in zip(seen, model.discounts)]) / model.context_total[:, context]
    double = mass + model.context_left[:, context] * single
    ratio, sights = np.zeros(len(w.hash)), seen.sum(axis=0)
    of_words, of_heads = model.trust
    for chance, own in ((SHARED * shared + (1 - SHARED) * begun, of_heads[head]), (single, of_words[word]), (double, sights / (sights + HALF_TRUST))):
        ratio += own * (np.log(chance[0]) - np.log(chance[1]) - ratio)
    some = np.flatnonzero(w.counts > 0)
    out[some, 0] = np.add.reduceat(ratio, w.first[some]) / w.counts[some]
    for i in some.tolist():
        own = ratio[w.first[i] : w.first[i + 1]]
        k = min(STRONGEST, len(own))
        out[i, 1] = np.partition(own, len(own) - k)[len(own) - k :].mean()
    return out


def _curve(x: np.ndarray, y: np.ndarray, shift: float) -> np.ndarray:
    """Ridge logistic regression by Newton's method on standardised features; intercept first, moved by ``shift``."""
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - middle) / spread])
    penalty = np.array([1e-6, *[0.05] * x.shape[1]])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[1:] / spread
    return np.array([beta[0] - (slope * middle).sum() + shift, *slope])


def _scored(df: DataFrame, model: Fitted, column: str, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the features of ``column`` and the score (0.5 before the curve is fitted)."""
    shared, curve = model.sent, model.curve

    def run(batches):
        for batch in batches:
            for lo, hi in T.chunks(batch.column(column), CHUNK):
                part = batch.slice(lo, hi - lo)
                f = _features(part.column(column), shared.value)
                score = 1 / (1 + np.exp(-np.clip(curve[0] + f @ curve[1:], -50, 50)))
                yield T.with_arrow(part, dict(zip(names, map(pa.array, (f[:, 0], f[:, 1], score)))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema + "".join(f", `{n}` double" for n in names))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Fitted:
    """Fit both models and the curve; labels of documents whose fold is 2 are never read.

    ``per_class`` bounds the labelled documents of a class that give class counts (folds 0 and 1) and that fit the curve
    (fold 3); shared counts come from all ``docs``. A document labelled more than once is toxic if one label says so.
    Without documents of both classes the scores are the toxic share of the labels.
    """
    gc.collect()  # lets go of the broadcast of an earlier fit that nothing refers to any more
    model = Fitted(docs.sparkSession, _model(docs, _sample(labels, docs, (0, 1), per_class)))
    rest = _sample(labels, docs, (3,), per_class).select("toxic", "text")
    table = _scored(rest, model, "text", ("mean", "top", "score")).select("toxic", "mean", "top").toArrow()
    y = table.column("toxic").to_numpy().astype(float)
    seen = {r["toxic"]: r["count"] for r in labels.where((fold() != 2) & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    shift = float(np.log((seen.get(1, 0) + 0.5) / (seen.get(0, 0) + 0.5)))
    if len(y):
        model.curve = _curve(np.column_stack([table.column("mean").to_numpy(), table.column("top").to_numpy()]), y, shift)
    else:
        model.curve = np.array([shift, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """doc_id, held_out, score, predicted and the two features of each document of ``docs`` (doc_id, text).

    A null or empty text has features 0. Repeated rows are rows of their own; other columns are not read; no rows give no
    rows. A null doc_id counts as fold 0.
    """
    scored = _scored(docs.select("doc_id", "text"), model, "text", ("mean_ratio", "top_ratio", "score"))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", predicted.alias("predicted"), "mean_ratio", "top_ratio")


def reject(docs: DataFrame, model: Fitted) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score below the threshold.

    Where no labelled rows were left to fit the curve, scores say nothing about a text: then all rows stay, with a warning. A
    null or empty text has features 0. Repeated rows are judged alike; no rows give no rows.
    """
    if not model.curve[1:].any():
        warnings.warn("too few labels to tell toxic documents from others: none is rejected", stacklevel=2)
        return docs
    prefix = T.fresh(docs, "toxic_")
    names = tuple(prefix + x for x in ("mean", "top", "score"))
    return _scored(docs, model, "text", names).where(F.col(names[2]) < THRESHOLD).select(*docs.columns)
