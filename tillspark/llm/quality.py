"""Quality from ordinal cumulative-link regression on hashed text.

P(grade <= j) = sigmoid(threshold_j - w x): one set of weights for all grades and ordered thresholds. x is the relative frequency
of a text's hashed words and byte trigrams, so w x is the mean weight of what the text is made of. The weights are fitted on a
bounded sample of graded documents, dealt into parts that are learnt by themselves and averaged, round after round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm import tables
from tillspark.llm import text as T
from tillspark.llm.toxicity import fold
from tillspark.session import materialise

BITS = 16  # of the hashed features
SAMPLE = 20_000  # graded documents that fit the weights, at most
PARTS = 8
ROUNDS = 4
STEPS = 2  # times that a part goes through its documents in a round
RATE = 2.0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades
    grades: list[int]


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text's words and byte trigrams (A-Z lower-cased, within a word and its blanks), and where they begin."""
    w = T.words(texts, T.SPACED)
    data, offsets = T._bytes(texts)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    code = np.empty(0, np.uint64)
    place = np.empty(0, np.int64)
    if len(low) > 2:
        code = T.mix((low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]) + np.uint64(1 << 40))
        place = np.arange(len(code))
        row = np.searchsorted(offsets, place, "right") - 1
        keep = place + 3 <= offsets[row + 1]
        code, place = code[keep], place[keep]
    every, spot = np.concatenate([code, w.hash]), np.concatenate([place, w.start])
    order = np.argsort(spot, kind="stable")
    return tables.slot(every[order], BITS), np.searchsorted(spot[order], offsets)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _learn(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: np.ndarray, thresholds: np.ndarray, rate: float, seed: int):
    """AdaGrad over one part: the negative log-likelihood of the grade's interval."""
    w, gaps = weights.copy(), np.append(thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-6)))
    seen, seen_gaps = np.full(len(w), 1e-8), np.full(len(gaps), 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(STEPS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            limits = np.cumsum(np.append(gaps[0], np.exp(np.clip(gaps[1:], -20, 20))))
            f = w[at] @ x
            over, under = _sigmoid(limits - f), np.append(_sigmoid(limits - f), 1.0)[y]
            less = over[y - 1] if y else 0.0
            p = max(under - less, 1e-9)
            d_under, d_less = under * (1 - under), less * (1 - less)  # slopes at the two ends of the interval
            slope = (d_under - d_less) / p  # d loss / d f
            g = slope * x
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
            ends = np.zeros(len(limits))
            if y < len(limits):
                ends[y] -= d_under / p
            if y:
                ends[y - 1] += d_less / p
            tail = np.cumsum(ends[::-1])[::-1]  # every gap moves the limits behind it
            g = np.append(tail[0], tail[1:] * np.exp(np.clip(gaps[1:], -20, 20)))
            seen_gaps += g * g
            gaps -= 0.1 * rate * g / np.sqrt(seen_gaps)
    return w, np.cumsum(np.append(gaps[0], np.exp(gaps[1:])))


def _learner(shared, turn: int):
    def learn(table: pa.Table) -> pa.Table:
        m = shared.value
        order = table.column("doc_id").to_numpy().argsort(kind="stable")
        columns = [table.column(c).to_pylist() for c in ("places", "values", "grade")]
        own = [
            (np.frombuffer(columns[0][i], np.int32), np.frombuffer(columns[1][i], np.float32).astype(float), m.grades.index(columns[2][i]))
            for i in order
        ]
        w, limits = _learn([r for r in own if len(r[0])], m.weights, m.thresholds, RATE / (1 + turn), turn)
        return pa.table({"n": pa.array([len(own)]), "weights": pa.array([w.tobytes()], pa.binary()), "limits": pa.array([limits.tobytes()], pa.binary())})

    return learn


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0, 1 or 2 for a document that is neither good nor clean, one of both, or both.

    A document labelled more than once has its lowest grade; a label without doc_id, quality or toxic is left out.
    """
    grade = F.col("quality") + 1 - F.col("toxic")
    known = labels.where(F.col("doc_id").isNotNull() & grade.isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit weights and thresholds on at most ``sample`` graded documents whose fold isn't 2, chosen by hash of the id.

    None where fewer than two grades occur.
    """
    known = grades.where(fold() != 2).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    sizes = {r["grade"]: r["count"] for r in chosen.groupBy("grade").count().collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return None

    def read(batches):
        for batch in batches:
            for lo, hi in T.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                at, first = _features(part.column("text"))
                rows = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    places, n = np.unique(at[a:b], return_counts=True)
                    rows.append((places.astype(np.int32).tobytes(), (n / max(1, b - a)).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("grade"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["doc_id", "grade", "places", "values"],
                )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    rows = texts.mapInArrow(read, "doc_id bigint, grade int, places binary, values binary")
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PARTS)).cast("int")))
    below = np.cumsum([sizes[g] for g in names])[:-1] / sum(sizes.values())
    model = Model(np.zeros(1 << BITS), np.log(below / (1 - below)), names)
    for turn in range(ROUNDS):
        parts = rows.groupBy("part").applyInArrow(_learner(docs.sparkSession.sparkContext.broadcast(model), turn), "n bigint, weights binary, limits binary")
        parts = parts.collect()  # PARTS rows
        share = np.array([p["n"] for p in parts], float) / sum(p["n"] for p in parts)
        model = Model(
            share @ np.array([np.frombuffer(p["weights"]) for p in parts]), share @ np.array([np.frombuffer(p["limits"]) for p in parts]), names
        )
    return model


def rated(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, expected_grade, top_chance (of the highest grade), selected (top_chance of at least a half).

    ``docs`` has doc_id and text; other columns are not read. A null or empty text, or no model, gives the thresholds' own
    chances (null without a model). Repeated rows are rows of their own; no rows give no rows.
    """
    held = (fold() == 2).alias("held_out")
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", held, nothing.alias("expected_grade"), nothing.alias("top_chance"), F.lit(None).cast("boolean").alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        steps = np.diff(np.array(m.grades, float))
        for batch in batches:
            for lo, hi in T.chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                at, first = _features(part.column("text"))
                sums = np.append(0.0, np.cumsum(m.weights[at]))
                f = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)
                above = _sigmoid(f[:, None] - m.thresholds[None, :])
                grade = m.grades[0] + above @ steps
                yield T.with_arrow(part.drop_columns(["text"]), {"expected_grade": pa.array(grade), "top_chance": pa.array(above[:, -1])})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, expected_grade double, top_chance double")
    return out.select("doc_id", held, "expected_grade", "top_chance", (F.col("top_chance") >= 0.5).alias("selected"))
