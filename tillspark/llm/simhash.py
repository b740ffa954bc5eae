"""Near-duplicate documents by SimHash fingerprints that differ in few bits, found in BK-trees of fingerprint shards.

Fingerprints within ``radius`` bits agree on at least one of radius + 1 blocks of bits, so every fingerprint goes to the shards of
its blocks. A shard holds at most ``shard`` fingerprints at every size: larger buckets are cut, and the packed tree of each cut is
sent to all others of its bucket. (A broadcast by Spark would take the fingerprints of all documents through the driver.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.bktree import Forest, joined, near, plant
from tillspark.llm.components import components
from tillspark.llm.text import SPACED, Words, chunks, words
from tillspark.llm.xxh64 import xxh64
from tillspark.session import materialise

SEED = 42
TOGETHER = 1 << 17  # fingerprints of whole shards that a task works on at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EIGHT = np.uint64(0x0101010101010101)

FOUND = "a bigint, b bigint, bucket int, part int, parts int, tree binary"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), ("tree", pa.binary())])


def _shingled(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, lower-cased and each followed by a blank; start, length and text of every shingle in them."""
    long = w.end - w.start
    place = np.cumsum(long + 1) - long - 1
    data = np.full(int(long.sum()) + len(long) + 8, 0x20, np.uint8)
    step = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    data[np.repeat(place, long) + step] = _LOWER[w.data[np.repeat(w.start, long) + step]]
    count = w.counts
    many = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(count)), many)
    start = w.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(start + size, w.first[owner + 1]) - 1
    return data, place[start], place[last] + long[last] - place[start], owner


def simhash(w: Words, size: int = 3) -> np.ndarray:
    """64-bit fingerprint of each text: the bits that are set in more than half of its shingles' hashes; 0 without words.

    Eight bits are counted at once in the eight bytes of a number, over at most 255 hashes; these counts are then added up.
    """
    data, start, long, owner = _shingled(w, size)
    sums = np.zeros((len(w.first) - 1, 64), np.int64)
    if not len(owner):
        return np.zeros(len(sums), np.uint64)
    h = xxh64(data, start, long, SEED)
    text = np.flatnonzero(np.diff(owner, prepend=-1))
    many = np.diff(np.append(text, len(owner)))
    piece = np.flatnonzero((np.arange(len(owner)) - np.repeat(text, many)) % 255 == 0)
    first = np.searchsorted(piece, text)
    for k in range(8):
        counts = np.add.reduceat((h >> np.uint64(k)) & _EIGHT, piece).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums[owner[text], k::8] = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    total = np.zeros(len(sums), np.int64)
    total[owner[text]] = many
    return np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = [simhash(words(texts.slice(lo, hi - lo), SPACED), size) for lo, hi in chunks(texts)]
        prints = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a bigint) of each row of ``docs``, which has doc_id and text; other columns are not read.

    Words are runs without ASCII blanks, A-Z lower-cased; a shingle is ``size`` consecutive words joined by one blank (with fewer
    words, all of them), and counts as often as it occurs. A null or empty text has fingerprint 0.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: _fingerprinted(b, size), "doc_id bigint, fp bigint")


def hexadecimal(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the blocks, more than ``radius`` of them and none over 16 bits."""
    many = max(4, radius + 1)
    cuts = [64 * k // many for k in range(many + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The sorted rows of a task as arrays (bucket, part, parts, fp) of whole shards."""
    held, rows = [], 0

    def cut(last: bool):
        table = [np.concatenate([h[k] for h in held]) for k in range(4)]
        end = len(table[0])
        if not last:
            same = (table[0] == table[0][-1]) & (table[1] == table[1][-1])
            end = int(np.argmax(same))  # the shard that may go on
        return [x[:end] for x in table], [x[end:] for x in table]

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "parts", "fp")])
            rows += batch.num_rows
        if rows >= TOGETHER:
            done, rest = cut(last=False)
            if len(done[0]):
                yield done
            held, rows = [rest], len(rest[0])
    if rows:
        yield cut(last=True)[0]


def _links(values: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link from each number to the first of its group, as signed numbers."""
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked].view(np.int64), values[label[linked]].view(np.int64)


def _within(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Plant a tree a shard and link its own fingerprints; the trees of buckets with several shards go out packed."""
    for bucket, part, parts, fp in _whole(batches):
        value = fp.astype(np.int64).view(np.uint64)
        first = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        forest = plant(value, first)
        root = np.searchsorted(first, np.arange(len(value)), "right") - 1
        label = np.arange(len(value))
        for query, node in near(forest, value, root, radius):
            label = joined(label, query, forest.origin[node])
        a, b = _links(value, label)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), t) for t in _FOUND.types[2:])], schema=_FOUND)
        ends = np.append(first[1:], len(value))
        sent = [(int(bucket[x]), int(part[x]), int(parts[x]), plant(value[x:y], np.zeros(1, np.int64)).pack())
                for x, y in zip(first, ends) if parts[x] > 1]
        if sent:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*sent), _FOUND.types[2:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sent), pa.int64())] * 2 + columns, schema=_FOUND)


def _between(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Link the fingerprints of two shards of a bucket; the two trees of a meeting come one after the other."""
    held = None
    for batch in batches:
        for tree in batch.column("tree").to_pylist():
            if held is None:
                held = tree
                continue
            forest, others = Forest.unpack(held), Forest.unpack(tree).value
            held = None
            n = len(forest.value)
            value, label = np.concatenate([forest.value, others]), np.arange(n + len(others))
            for query, node in near(forest, others, np.zeros(len(others), np.int64), radius):
                label = joined(label, n + query, node)
            a, b = _links(value, label)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = 3, shard: int = 1024) -> DataFrame:
    """a, b: links that connect all fingerprints of ``distinct`` (column fp, no two equal) at most ``radius`` bits apart.

    Not every near pair is given, but within each shard, or two shards of a bucket that meet, a chain of links. Each fingerprint
    goes to one bucket a block of bits, of which there are at most 2**16 a block, so the table of their sizes is small. A bucket
    of n fingerprints has ceil(n / shard) shards, and its trees meet in pairs: n * n / shard * 16 bytes are sent.
    """
    if not 0 <= radius < 32:
        raise ValueError("radius must be from 0 to 31 bits")
    keys = [F.lit(k << 16).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)).cast("int")) for k, (lo, n) in enumerate(_blocks(radius))]
    routed = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = routed.groupBy("bucket").count().where(F.col("count") > shard)
    sizes = sizes.select("bucket", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(sizes), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp", "bucket"), F.col("parts")).cast("int"))
    shards = dealt.select("bucket", "part", "parts", "fp").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "fp")
    found = materialise(shards.mapInArrow(lambda b: _within(b, radius), FOUND))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))
    sent = found.where(F.col("tree").isNotNull()).select("bucket", "part", "tree", other.alias("other"))
    met = sent.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "tree")
    met = met.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "part").select("tree")
    return found.where(F.col("a").isNotNull()).select("a", "b").union(met.mapInArrow(lambda b: _between(b, radius), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, shard: int = 1024) -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs`` (doc_id, text; other columns are not read).

    Two rows link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest doc_id reachable by
    links, the row's own included. Rows without words have fingerprint 0 and link like others. Equal fingerprints are searched
    once, so repeated rows and copies cost nothing more. Null ids take part, but only a component without other ids has a null
    ``component_id``. No rows give no rows.
    """
    prints = materialise(fingerprints(docs, size))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(links(distinct.select("fp"), radius, shard))
    named = distinct.join(reached, distinct["fp"] == reached["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(classes, prints["fp"] == classes["class_fp"]).select("doc_id", "fp", "component_id")
