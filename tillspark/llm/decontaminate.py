"""Benchmark decontamination with suffix arrays over the training texts.

The documents of a chunk of a task form a shard. Its suffix array holds the word positions from which a verbatim match can
start: all words of the shortest window are benchmark words. Every suffix of every benchmark item is binary-searched in it,
and neighbouring hits on one diagonal are joined to the longest verbatim matches with their locations. Documents are neither
shuffled nor cut; benchmark items go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm import text as T

MATCH = pa.list_(
    pa.struct(
        [("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]
    )
)
MATCH_SQL = "array<struct<item_id:string,doc_start:bigint,item_start:bigint,n_words:bigint>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPAN_SQL = "array<struct<start:bigint,end:bigint>>"


@dataclass
class Block:
    """Benchmark suffixes: sorted vocabulary, packed words, length, item and position of each; ids of equal items."""

    vocabulary: np.ndarray
    keys: np.ndarray
    length: np.ndarray
    item: np.ndarray
    position: np.ndarray
    ids: list[list[str]]


def _pack(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike; 0 stands for no word."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


def _gather(codes: np.ndarray, left: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` codes from each position on, 0 from the first missing word or the end of the text on."""
    out = np.zeros((len(at), size), np.uint32)
    alive = np.ones(len(at), bool)
    for k in range(size):
        alive = alive & (left[at] > k)
        part = codes[np.minimum(at + k, max(len(codes) - 1, 0))]
        alive &= part > 0
        out[:, k] = np.where(alive, part, 0)
    return out


def _block(rows: list, size: int) -> Block:
    w = T.words(pa.array([r["text"] for r in rows], pa.string()), T.PLAIN)
    vocabulary = np.unique(w.hash)
    codes = (np.searchsorted(vocabulary, w.hash) + 1).astype(np.uint32)
    ids: dict[bytes, list[str]] = {}
    at, length, item, position = [], [], [], []
    for i, r in enumerate(rows):
        lo, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
        if not n:
            continue
        key = w.hash[lo : lo + n].tobytes()
        if key not in ids:
            ids[key] = []
            starts = np.arange(max(1, n - size + 1))
            at.append(lo + starts)
            length.append(np.full(len(starts), min(n, size)))
            item.append(np.full(len(starts), len(ids) - 1))
            position.append(starts)
        if r["item_id"] is not None:
            ids[key].append(str(r["item_id"]))
    at, length, item, position = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (at, length, item, position))
    left = np.minimum(w.left(), size)
    return Block(vocabulary, _gather(codes, left, at, size), length, item, position, [sorted(set(x)) for x in ids.values()])


def _runs(item, offset, at, length):
    """Join hits that continue each other in the same item: start, end and the item's position of maximal runs."""
    if not len(at):
        return item, offset, at, at
    order = np.lexsort((at, at - offset, item))
    item, offset, at, length = item[order], offset[order], at[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - offset[1:] != at[:-1] - offset[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return item[first], offset[first], at[first], at[last] + length[last]


def _search(w: T.Words, block: Block, size: int):
    """Longest verbatim matches of the block's items in the shard: item, item's word, first and last word (exclusive)."""
    none = np.empty(0, np.int64)
    if not len(w.hash) or not len(block.length):
        return none, none, none, none
    shortest = int(block.length.min())
    found = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    codes = np.where(block.vocabulary[found] == w.hash, found + 1, 0).astype(np.uint32)
    left = w.left()
    ok = (codes > 0).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(ok)])
    at = np.arange(len(codes))
    at = at[left >= shortest]
    at = at[total[at + shortest] - total[at] == shortest]
    if not len(at):
        return none, none, none, none
    suffixes = _pack(_gather(codes, left, at, size))
    order = np.argsort(suffixes, kind="stable")
    array, at = suffixes[order], at[order]  # the shard's suffix array
    low = np.searchsorted(array, _pack(block.keys), "left")
    ceiling = block.keys.copy()
    ceiling[np.arange(size)[None, :] >= block.length[:, None]] = 0xFFFFFFFF
    n = np.searchsorted(array, _pack(ceiling), "right") - low
    which = np.repeat(np.arange(len(n)), n)
    hit = at[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    # equal windows of one item at several of its words give a location each; runs then follow their diagonals
    return _runs(block.item[which], block.position[which], hit, block.length[which])


def _scan(batches: Iterator[pa.RecordBatch], block: Block, column: str, names: tuple, size: int) -> Iterator[pa.RecordBatch]:
    n_words, matches, spans, items = names
    for batch in batches:
        texts = batch.column(column)
        for lo, hi in T.chunks(texts):
            part = batch.slice(lo, hi - lo)
            w = T.words(texts.slice(lo, hi - lo), T.PLAIN)
            item, offset, start, end = _search(w, block, size)
            doc = np.searchsorted(w.first, start, "right") - 1
            found: list[list] = [[] for _ in range(hi - lo)]
            for d, i, o, a, b in zip(doc.tolist(), item.tolist(), offset.tolist(), start.tolist(), end.tolist()):
                found[d].append((i, a - int(w.first[d]), o, b - a))
            rows_m, rows_s, rows_i = [], [], []
            for f in found:
                f.sort(key=lambda x: (x[1], x[0], x[2]))
                rows_m.append([{"item_id": (block.ids[i] or [None])[0], "doc_start": a, "item_start": o, "n_words": n} for i, a, o, n in f])
                merged: list[list[int]] = []
                for _, a, _, n in f:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], a + n)
                    else:
                        merged.append([a, a + n])
                rows_s.append([{"start": a, "end": b} for a, b in merged])
                rows_i.append(sorted({x for i, *_ in f for x in block.ids[i]}))
            yield T.with_arrow(
                part,
                {n_words: pa.array(w.counts, pa.int64()), matches: pa.array(rows_m, MATCH), spans: pa.array(rows_s, SPAN), items: pa.array(rows_i, pa.list_(pa.string()))},
            )


def _blocks(items: DataFrame, block_mb: int) -> Iterator[list]:
    """The benchmark in hash blocks of about ``block_mb``, one at a time on the driver."""
    size = items.select(F.sum(F.octet_length("text") + F.lit(100)).alias("n")).first()["n"] or 0
    n = 1 + int(size) // (block_mb << 20)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("item_id", "text").collect()


def verbatim_matches(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, block_mb: int = 16, prefix: str = ""
) -> DataFrame:
    """``docs`` with its verbatim matches against ``items`` (item_id, text).

    Added columns (behind ``prefix``): ``n_words``; ``matches``, the longest verbatim matches of at least ``window`` words
    with item, start in the document, start in the item and length; ``spans``, the document's words inside any match, merged;
    ``items``, sorted ids of the items that match, as strings. Words are runs of letters, digits and non-ASCII characters,
    A-Z lower-cased. An item of fewer words than ``window`` matches as a whole.

    Items with equal words are one match, named by the smallest id; all their ids are in ``items``. An item without words
    matches nothing; one whose id is null marks spans but is not listed. A null or empty text has no words. Repeated
    documents are rows of their own; other columns pass through. The benchmark is taken in blocks of ``block_mb`` (by the
    hash of the text, so equal items stay together); each further block is one more pass over the rows in the same stage.
    """
    out = docs
    names = tuple(prefix + x for x in ("n_words", "matches", "spans", "items"))
    taken = {c.lower() for c in docs.columns}
    if clash := [n for n in names if n.lower() in taken]:
        raise ValueError(f"columns {clash} exist; choose a prefix")
    collected = []
    for k, rows in enumerate(_blocks(items, block_mb)):
        own = tuple(f"{n}__{k}" for n in names)
        collected.append(own)
        schema = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields
        ) + f", `{own[0]}` bigint, `{own[1]}` {MATCH_SQL}, `{own[2]}` {SPAN_SQL}, `{own[3]}` array<string>"
        shared = docs.sparkSession.sparkContext.broadcast(_block(rows, window))
        out = out.mapInArrow(lambda batches, b=shared, o=own: _scan(batches, b.value, text, o, window), schema)
    if len(collected) == 1:
        return out.withColumnsRenamed(dict(zip(collected[0], names)))
    merged = [F.col(collected[0][0])]
    for j, key in ((1, ("doc_start", "item_start", "item_id", "n_words")), (2, ("start", "end")), (3, None)):
        every = F.flatten(F.array(*(F.col(f"`{c[j]}`") for c in collected)))
        merged.append(F.array_sort(F.array_distinct(every)) if key is None else F.array_sort(every))
    # spans of different blocks may overlap: fold the sorted list
    merged[2] = F.aggregate(
        merged[2],
        F.array().cast(SPAN_SQL),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return out.select(*docs.columns, *(c.alias(n) for c, n in zip(merged, names)))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no window of any item."""
    prefix = T.fresh(docs, "matched_")
    marked = verbatim_matches(docs, items, text, window, prefix=prefix)
    return marked.where(F.size(f"{prefix}spans") == 0).select(*docs.columns)


def digest(marked: DataFrame) -> DataFrame:
    """One row per document: numbers of words, hit words and matching items, and the digest of the items' ids."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
