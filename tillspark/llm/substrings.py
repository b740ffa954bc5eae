"""Substring dedup with a compressed FM-index per shard.

A repeated passage has repeated anchors: of every window of words, the part of eight words with the smallest hash. Anchors that
occur once in the whole corpus are set aside; stretches of windows around the others are dealt to shards by anchor, so that
equal windows meet in one shard, after each task has kept the first of its equal stretches only. A shard builds an FM-index
over its stretches (wavelet matrix, suffixes ordered to the depth of a window) and searches every window of the documents
that stream through it backwards, equal windows once; windows whose interval starts with an earlier place are reported. The documents then drop
the words that reported windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm import tables
from tillspark.llm import text as T
from tillspark.llm.fmindex import FMIndex
from tillspark.session import materialise

WINDOW = 20  # words
ANCHOR = 8  # words
BITS = 26  # of the table that marks repeated anchors, 8 MB: more anchors than that make it let more through
TASK_WORDS = 400_000  # that a task works on
SHARDS = 16  # that they are: small ones stay in the processor's caches
TASK_STRETCHES = 200_000  # stretches that a task keeps before it sends them on
SEARCHED = 100_000  # windows searched at a time
CHUNK = 1 << 20  # bytes of text worked on at a time: a worker holds some hundred times as much in arrays
PACKED = 1 << 18  # anchors that a task packs at a time, at least
LAST = (1 << 63) - 1  # stands for a missing doc_id: last of all
_PACKET = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("doc", "text_hash", "start", "length", "words"))])
_PACKET_SQL = "part int, doc binary, text_hash binary, start binary, length binary, words binary"


def _smallest(x: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest (of equal ones the first) of each ``span`` consecutive numbers, by joining shorter spans."""
    best, place, have = x, np.arange(len(x)), 1
    while have < span:
        by = min(have, span - have)
        right = best[by:] < best[:-by]
        place = np.where(right, place[by:], place[:-by])
        best, have = np.minimum(best[:-by], best[by:]), have + by
    return place


def _stretches(w: T.Words, window: int, anchor: int):
    """Runs of windows that share an anchor: anchor, word at which the run starts, number of windows."""
    none = np.empty(0, np.int64)
    span = window - anchor + 1
    if len(w.hash) < window:
        return none.astype(np.uint64), none, none
    grams = T.windows(w, anchor)
    spot = _smallest(grams[: len(grams) - anchor + 1], span)
    at = np.flatnonzero(w.left()[: len(spot)] >= window)
    if not len(at):
        return none.astype(np.uint64), none, none
    spot = spot[at]
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return grams[spot[first]], at[first], np.diff(np.append(first, len(at)))


def _codes(w: T.Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` words from ``start`` on."""
    up, down = T._power(len(w.hash) + 1)
    sums = np.append(np.uint64(0), np.cumsum(w.hash * up[: len(w.hash)]))
    return T.mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))


def _anchors(batches: Iterator[pa.RecordBatch], parts: int, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The anchors of some documents, packed by part."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate(held) if held else np.empty(0, np.uint64)
        part = (found % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, found[order[cuts[p] : cuts[p + 1]]].tobytes()) for p in np.flatnonzero(np.diff(cuts)).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "anchors"])

    held, count = [], 0
    for batch in batches:
        for lo, hi in T.chunks(batch.column("text"), CHUNK):
            found, _, _ = _stretches(T.words(batch.column("text").slice(lo, hi - lo), T.EXACT), window, anchor)
            held, count = [*held, found], count + len(found)
            if count >= PACKED:
                yield from packed(held)
                held, count = [], 0
    yield from packed(held)


def _repeated(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Flags of the anchors that occur more than once; in cell -1, how often those do."""
    found = [np.frombuffer(x, np.uint64) for b in batches for x in b.column("anchors").to_pylist()]
    if not found:
        return
    codes, counts = np.unique(np.concatenate(found), return_counts=True)
    cells = list(tables.bits_of(tables.slot(codes[counts > 1], bits), bits))
    cells.append((-1, int(counts[counts > 1].sum()).to_bytes(8, "little")))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], pa.int32()), pa.array([x for _, x in cells], pa.binary())], schema=tables.CELL_SCHEMA)


def _sent(batches, flags, parts: int, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Stretches around repeated anchors, packed by part: the first of equal ones with its words, the others without.

    One without words, whose length is negative, is known to repeat an earlier one of this task.
    """
    held: dict[int, tuple] = {}  # hash of the words -> place and words of the first
    out: dict[int, list] = {}

    def flush():
        for part, place in ((x[0], x[1:]) for x in held.values()):
            out.setdefault(part, []).append(place)
        held.clear()
        rows = []
        for part, places in out.items():
            doc, code, start, length, words = zip(*places)
            rows.append((part, np.array(doc, np.int64).tobytes(), np.array(code, np.int64).tobytes(), np.array(start, np.int32).tobytes(), np.array(length, np.int32).tobytes(), b"".join(words)))
        out.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKET)], schema=_PACKET)

    waiting = 0
    for batch in batches:
        for lo, hi in T.chunks(batch.column("text"), CHUNK):
            part_of = batch.slice(lo, hi - lo)
            w = T.words(part_of.column("text"), T.EXACT)
            found, start, length = _stretches(w, window, anchor)
            keep = tables.hit(flags, found)
            found, start, length = found[keep], start[keep], length[keep]
            if not len(found):
                continue
            codes = _codes(w, start, length + window - 1).tolist()
            row = np.searchsorted(w.first, start, "right") - 1
            docs = part_of.column("doc_id").to_numpy(zero_copy_only=False)[row].tolist()
            texts = part_of.column("text_hash").to_numpy(zero_copy_only=False)[row].tolist()
            inside = (start - w.first[row]).tolist()
            part = (found % np.uint64(parts)).astype(np.int64).tolist()
            for k, code in enumerate(codes):
                a, n = int(start[k]), int(length[k])
                new = (part[k], docs[k], texts[k], inside[k], n, w.hash[a : a + n + window - 1].tobytes())
                old = held.get(code)
                if old is None:
                    held[code] = new
                elif old[1] == docs[k] and old[3] == inside[k]:
                    if old[2] != texts[k]:  # another text of the same id has it at the same place: neither is earlier
                        held[hash((code, texts[k]))] = new
                else:
                    if (docs[k], inside[k]) < (old[1], old[3]):
                        held[code], new = new, old
                    out.setdefault(new[0], []).append((*new[1:4], -new[4], b""))
                    waiting += 1
            if len(held) + waiting > TASK_STRETCHES:
                waiting = 0
                yield from flush()
    yield from flush()


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Index the stretches of each shard and report, for each text, the stretches and windows that occur earlier."""
    shards: dict[int, list[list]] = {}
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc", "text_hash", "start", "length", "words"))):
            cols = shards.setdefault(part, [[], [], [], [], []])
            for k, (x, t) in enumerate(zip(row, (np.int64, np.int64, np.int32, np.int32, np.uint64))):
                cols[k].append(np.frombuffer(x, t))
    while shards:
        yield from _found(*(np.concatenate(x) for x in shards.popitem()[1]), window)


def _found(doc, code, start, length, words, window: int) -> Iterator[pa.RecordBatch]:
    known = length < 0
    hits = [(doc[known], code[known], start[known].astype(np.int64), -length[known].astype(np.int64))]
    doc, code, start, length = doc[~known], code[~known], start[~known].astype(np.int64), length[~known].astype(np.int64)
    if len(doc):
        size = length + window - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((start, doc))  # so that the first place in an interval is the earliest
        doc, code, start, length = doc[order], code[order], start[order], length[order]
        size, begin = size[order], begin[order]
        put = np.cumsum(size + 1) - size - 1
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        vocabulary, ids = np.unique(words, return_inverse=True)
        text = np.zeros(int((size + 1).sum()), np.int64)
        text[np.repeat(put, size) + each] = ids[np.repeat(begin, size) + each] + 1
        index = FMIndex(text, window)
        owner = np.repeat(np.arange(len(doc)), length)
        nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = put[owner] + nth
        _, one, which = np.unique(index.ranks[at], return_index=True, return_inverse=True)  # equal windows have one answer
        earliest = np.full(len(one), -1)
        for lo in range(0, len(one), SEARCHED):
            again, low, _ = index.search(text, at[one[lo : lo + SEARCHED]], window)
            earliest[lo + again] = index.suffixes[low]
        earliest = earliest[which]
        again = np.flatnonzero(earliest >= 0)
        own, k, earliest = owner[again], nth[again], earliest[again]
        other = np.searchsorted(put, earliest, "right") - 1
        place = start[other] + earliest - put[other]
        earlier = (doc[other] < doc[own]) | ((doc[other] == doc[own]) & (place < start[own] + k))
        own, k = own[earlier], k[earlier]
        hits.append((doc[own], code[own], start[own] + k, np.ones(len(own), np.int64)))
    doc, code, start, length = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((start, code, doc))
    doc, code, start, length = doc[order], code[order], start[order], length[order]
    if not len(doc):
        return
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    cuts = np.append(np.flatnonzero(new), len(doc)).tolist()
    places = np.stack([start, length], 1).astype(np.int32)
    rows = [places[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(code[new]), pa.array(rows, pa.binary())], names=["hit_doc", "hit_text", "places"])


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """hit_doc, hit_text, places: for each text (id, xxhash64) the windows that start earlier elsewhere, as packed pairs of
    first word and number of windows. ``docs`` has doc_id (not null), text and text_hash."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = docs.select("text").mapInArrow(lambda b: _anchors(b, 4 * least, window, anchor), "part int, anchors binary")
    counted = materialise(anchors.repartition(least, "part").mapInArrow(lambda b: _repeated(b, BITS), "cell int, counts binary"))
    flags = spark.sparkContext.broadcast(tables.gathered_bits(counted.where("cell >= 0"), BITS))
    number = sum(int.from_bytes(r["counts"], "little") for r in counted.where("cell < 0").collect())  # one row a task
    parts = max(least, number * (window + (window - anchor) // 2) // TASK_WORDS + 1)
    sent = docs.mapInArrow(lambda b: _sent(b, flags.value, SHARDS * parts, window, anchor), _PACKET_SQL)
    return sent.repartition(parts, "part").mapInArrow(lambda b: _shard(b, window), "hit_doc bigint, hit_text bigint, places binary")


def _cut(batches: Iterator[pa.RecordBatch], window: int, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in T.chunks(b.column("text"), CHUNK)):
        n_words, n_removed, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            found = (text or "").encode().split()  # bytes split at the ASCII blanks
            n_words.append(len(found))
            if places:
                marks = np.zeros(len(found) + 1, np.int64)
                for start, length in np.concatenate([np.frombuffer(p, np.int32).reshape(-1, 2) for p in places]):
                    marks[start] += 1
                    marks[start + length + window - 1] -= 1
                stay = np.cumsum(marks[:-1]) == 0
                found = [x for x, ok in zip(found, stay.tolist()) if ok]
            n_removed.append(n_words[-1] - len(found))
            kept.append(b" ".join(found))
        columns = (pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()))
        yield T.with_arrow(batch.drop_columns(["text", "places", "hit_doc", "hit_text", "text_hash"]), dict(zip(names, columns)))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document without the words inside any window that starts earlier elsewhere.

    ``docs`` has doc_id and text; other columns are not read. Words are runs without ASCII blanks, compared as they are; a
    window is ``window`` consecutive words of one document; earlier means a smaller doc_id or the same one and an earlier word.
    Windows are judged on the input. ``kept`` joins the words that stay by one blank. A null or empty text has no words; a null
    doc_id comes after all others. Rows that share a doc_id are read as one document at one place: equal words at equal
    positions are not earlier. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    hits = repeats(named.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))), window)
    hits = hits.groupBy("hit_doc", "hit_text").agg(F.collect_list("places").alias("places"))  # of one document's words
    joined = named.join(hits, (F.coalesce("doc_id", F.lit(LAST)) == F.col("hit_doc")) & (F.col("text_hash") == F.col("hit_text")), "left")
    names = ("n_words", "n_removed", "kept")
    return joined.mapInArrow(lambda b: _cut(b, window, names), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
