"""Exact n-gram Jaccard join by skipping through set relations, and the groups that its links form.

Answer level: documents with equal sets are one class. Classes that share their smallest hashed shingle meet in a bucket and
are compared with its first classes, the leaders; those that link to one form its cluster, with a bound on the shingles that
each has beyond the leader. Leaders meet again under further hashes. What a cluster links with is derived from the leader's
overlaps by these differences: only where they leave the answer open are members compared themselves.

Index level: every class lists its prefix (the shingles that any linked set must meet, rarest first). A list of the index
holds one entry a cluster, in blocks ordered by set size; a pair of blocks is skipped when their sizes, or the shingles left
behind their positions, rule out every link. Of the pairs that are left, parities of the shingles tell how much the sets
differ at least; only sets of pairs for which that is not too much are moved. Sets are not kept: a step that needs those of some
classes reads one text of each again, told from the others by flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tillspark.llm import tables
from tillspark.llm import text as T
from tillspark.llm.components import components
from tillspark.session import materialise

SIZE = 5  # words in a shingle
SHARE = (75, 100)  # least intersection by union
BITS = 20  # of the table of shingle frequencies
FILTER_BITS = 23  # of the tables that mark which sets and texts are looked at again
SKETCH_BITS = 1 << 16  # parities of a set at most, else 2 to 4 a shingle
DOUBT_BITS = 26  # of the table that marks documents which may have to go
BLOCK = 32  # entries in a block of an index list
ROUNDS = 4  # hashes under which leaders meet
LEADERS = 8  # that a bucket's classes are compared with
HALL = 128  # members of a component that are compared together where the leaders leave a link open
HOT_BUCKET = 4096  # classes from which a bucket is split by a second hash
SPLIT = 64
PART_ENTRIES = 1_000_000  # index entries that one task works on
PAIRS = 2_000_000  # pairs tested at a time


@dataclass(frozen=True)
class Rule:
    size: int = SIZE
    num: int = SHARE[0]
    den: int = SHARE[1]

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def links(self, both, n1, n2):
        return both * (self.num + self.den) >= self.num * (n1 + n2)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; of fewer words, of all of them as one."""
    w = T.words(texts, T.SPACED)
    grams, out = T.windows(w, size), []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = hi - lo
        if n >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif n:
            alone = T.Words(w.data, w.start[lo:hi], w.end[lo:hi], w.hash[lo:hi], np.array([0, n]))
            out.append(T.windows(alone, n)[:1] ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _pack(s: np.ndarray) -> bytes:
    """The first 48 bits of each hash: by chance alone two sets of a thousand shingles share one in 10**8 such pairs of sets."""
    return np.ascontiguousarray((s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _name(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(T.mix(T.mix(s).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _key(s: np.ndarray, turn: int) -> int:
    """The smallest hash of the set's shingles, another one each turn."""
    return int(T.mix(T.mix(s ^ np.uint64(0x5DEECE66D * (turn + 1))).min(keepdims=True)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        column = batch.column(text)
        for lo, hi in T.chunks(column):
            yield batch.slice(lo, hi - lo), shingle_sets(column.slice(lo, hi - lo), size)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("cell", pa.int32()), ("counts", pa.binary())])


def _signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n, fp and keys of every document, and behind each task's documents its part of the frequency table."""

    def run(batches):
        table = np.zeros(1 << BITS, np.int64)
        for part, sets in _sets(batches, "text", rule.size):
            table += np.bincount(tables.slot(np.concatenate(sets), BITS), minlength=1 << BITS)
            full = [len(s) > 0 for s in sets]
            none = [None] * len(sets)
            yield _rows(
                _SIGNED, part.column("doc_id"), part.column("text_hash"), [len(s) for s in sets], [_name(s) if f else None for s, f in zip(sets, full)],
                [[_key(s, k) for k in range(ROUNDS)] if f else None for s, f in zip(sets, full)], none, none,
            )
        found = list(tables.cells(table))
        none = [None] * len(found)
        yield _rows(_SIGNED, none, none, none, none, none, [k for k, _ in found], [x for _, x in found])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, fp bigint, keys array<bigint>, cell int, counts binary")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.xxhash64("text").alias("text_hash"))


def _texts(classes: DataFrame, key: Column, bitmap: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """Flags of the texts (one a class) of the classes that ``_chosen`` gives for the same tables."""
    shared = classes.sparkSession.sparkContext.broadcast((bitmap, without))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("text_hash").filter(pa.array(_wanted(batch.column("key"), batch.column("fp"), *shared.value)))], names=["text_hash"])

    return tables.marked(classes.select(key.alias("key"), "fp", "text_hash").mapInArrow(run, "text_hash bigint"), FILTER_BITS)


def _wanted(keys: pa.Array, names: pa.Array, bitmap: np.ndarray, without: np.ndarray | None) -> np.ndarray:
    wanted = tables.hit(bitmap, keys.to_numpy(zero_copy_only=False).view(np.uint64))
    if without is not None:
        wanted &= ~tables.hit(without, names.to_numpy(zero_copy_only=False).view(np.uint64))
    return wanted


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles on each of some places: where two sets differ by k shingles, at most k differ."""
    bits = min(max(256, 1 << (2 * len(s) - 1).bit_length()), SKETCH_BITS)
    places = T.mix(s >> np.uint64(16)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=bits) & 1).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """How many parities differ after the longer sketch is folded to the length of the other."""
    a, b = (np.frombuffer(z, np.uint8) for z in sorted((x, y), key=len))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


_SET = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("items", pa.binary())])
_SKETCH = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def _chosen(
    docs: DataFrame, classes: DataFrame, rule: Rule, bitmap: np.ndarray, turn: int | None = None, without: np.ndarray | None = None, sketched: bool = False
) -> DataFrame:
    """fp, key and shingles of the classes whose fp (or key of a turn) the bitmap marks, each once a task; or fp, n and sketch.

    The flags are of hashes, so some more classes come along, and ``without`` keeps some more away than it names. Only texts
    that may have such a set are cut into words.
    """
    texts = _texts(classes, F.col("fp") if turn is None else F.col("keys")[turn], bitmap, without)
    shared = docs.sparkSession.sparkContext.broadcast((texts, bitmap, without))
    schema = _SKETCH if sketched else _SET

    def run(batches):
        seen: set[int] = set()
        texts, *flags = shared.value
        some = (b.filter(pa.array(tables.hit(texts, b.column("text_hash").to_numpy().view(np.uint64)))) for b in batches)
        for _, sets in _sets(some, "text", rule.size):
            sets = [s for s in sets if len(s)]
            names = [_name(s) for s in sets]
            keys = names if turn is None else [_key(s, turn) for s in sets]
            wanted = _wanted(pa.array(keys, pa.int64()), pa.array(names, pa.int64()), *flags)
            rows = []
            for s, name, key, ok in zip(sets, names, keys, wanted):
                if ok and name not in seen:
                    seen.add(name)
                    rows.append((name, len(s), _sketch(s)) if sketched else (name, key, _pack(s)))
            if rows:
                yield _rows(schema, *zip(*rows))

    return _hashed(docs).mapInArrow(run, "fp bigint, n bigint, sketch binary" if sketched else "fp bigint, key bigint, items binary")


def _both(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def _led(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Compare each set with the leaders of its bucket; rows come sorted by bucket, then fp."""
    schema = pa.schema([("fp", pa.int64()), ("leader", pa.int64()), ("extra", pa.int64())])
    bucket = last = None
    leaders: list[tuple[int, np.ndarray]] = []
    for batch in batches:
        out = []
        for key, salt, fp, items in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "fp", "items"))):
            if (key, salt) != bucket:
                bucket, leaders = (key, salt), []
            elif fp == last:
                continue
            last, s = fp, _unpack(items)
            for leader, first in leaders:
                both = _both(first, s)
                if rule.links(both, len(first), len(s)):
                    out.append((fp, leader, len(s) - both))
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((fp, s))
        if out:
            yield _rows(schema, *zip(*out))


def _round(docs: DataFrame, classes: DataFrame, members: DataFrame | None, rule: Rule, turn: int) -> DataFrame:
    """fp, leader, extra: classes not yet members that link to a leader of their bucket, with their shingles beyond it."""
    open_classes = classes if members is None else classes.join(members, "fp", "left_anti")
    sizes = materialise(open_classes.groupBy(F.col("keys")[turn].alias("key")).count().where("count > 1"))
    without = None if members is None else tables.marked(members.select("fp"), FILTER_BITS)
    hot = docs.sparkSession.sparkContext.broadcast(tables.marked(sizes.where(F.col("count") >= HOT_BUCKET).select("key"), FILTER_BITS))

    def salted(batches):
        schema = pa.schema([*_SET, ("salt", pa.int32())])
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            salt = np.where(tables.hit(hot.value, keys), fps % np.uint64(SPLIT), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt)], schema=schema)

    sets = _chosen(docs, classes, rule, tables.marked(sizes.select("key"), FILTER_BITS), turn, without)
    dealt = sets.mapInArrow(salted, "fp bigint, key bigint, items binary, salt int").repartition("key", "salt")
    return dealt.sortWithinPartitions("key", "salt", "fp").mapInArrow(lambda b: _led(b, rule), "fp bigint, leader bigint, extra bigint")


def _clusters(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """fp, leader, extra of the members of clusters after all turns; the differences add up where leaders become members."""
    members = None
    for turn in range(ROUNDS):
        new = materialise(_round(docs, classes, members, rule, turn))
        if members is None:
            members = new
            continue
        moved = new.select(F.col("fp").alias("leader"), F.col("leader").alias("next"), F.col("extra").alias("more"))
        kept = members.join(moved, "leader", "left").select(
            "fp", F.coalesce("next", "leader").alias("leader"), (F.col("extra") + F.coalesce("more", F.lit(0))).alias("extra")
        )
        members = materialise(kept.unionByName(new))
    return members


_PACKET = pa.schema([(c, pa.binary()) for c in ("tokens", "counts", "position", "cluster", "n")])


def _prefixes(docs: DataFrame, rule: Rule, table: np.ndarray) -> DataFrame:
    """fp, n and the prefix of each class, once a task: its rarest shingles by the frequency table, ties by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(table, 0xFFFFFFFF).astype(np.uint32))
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int32()), ("prefix", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, "text", rule.size):
            rows = []
            for s in sets:
                if len(s) and (name := _name(s)) not in seen:
                    seen.add(name)
                    order = np.argsort(shared.value[tables.slot(s, BITS)], kind="stable")
                    rows.append((name, len(s), _pack(s[order[: rule.prefix(len(s))]])))
            if rows:
                yield _rows(schema, *zip(*rows))

    return docs.mapInArrow(run, "fp bigint, n int, prefix binary")


def _short(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _long(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // count}").astype(np.int32)


def _packets(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The index entries of some classes, packed by the part of the index that they belong to."""
    schema = pa.schema([("part", pa.int32()), *_PACKET])
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            rows = batch.slice(lo, 4096)
            prefixes = [_unpack(p) for p in rows.column("prefix").to_pylist()]
            if not prefixes:
                continue
            tokens = np.concatenate(prefixes)
            counts = np.array([len(p) for p in prefixes])
            owner = np.repeat(np.arange(len(prefixes)), counts)
            position = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
            part = (tokens % np.uint64(parts)).astype(np.int64)
            short = ((tokens // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            cluster, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "n"))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[p] : cuts[p + 1]]
                mine, held = np.unique(owner[at], return_counts=True)
                out.append((
                    p, short[at].tobytes(), _short(held), np.minimum(position[at], 0xFFFF).astype(np.uint16).tobytes(),
                    cluster[mine].astype(np.int64).tobytes(), _short(n[mine]),
                ))
            yield _rows(schema, *zip(*out))


def _cross(a, b, sa, sb):
    """Index pairs of segments that start at a and b with lengths sa and sb."""
    n = sa * sb
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[which] + k // sb[which], b[which] + k % sb[which]


def _candidates(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of clusters that a list of the index can't rule out."""
    parts = [[] for _ in range(4)]
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", *(f.name for f in _PACKET)))
        for part, tokens, counts, position, cluster, n in zip(*columns):
            cluster = np.frombuffer(cluster, np.int64)
            counts = _long(counts, len(cluster))
            for k, x in enumerate((
                np.frombuffer(tokens, np.uint32).astype(np.int64) | part << 32, np.repeat(cluster, counts),
                np.repeat(_long(n, len(cluster)), counts), np.frombuffer(position, np.uint16),
            )):
                parts[k].append(x)
    if not parts[0]:
        return
    token, cluster, n, position = (np.concatenate(x) for x in parts)
    del parts
    order = np.argsort(token, kind="stable")
    repeated = np.zeros(len(order), bool)
    same = token[order[1:]] == token[order[:-1]]
    repeated[1:] |= same
    repeated[:-1] |= same
    order = order[repeated]
    order = order[np.lexsort((cluster[order], token[order]))]
    if not len(order):
        return
    token, cluster, n, position = token[order], cluster[order], n[order].astype(np.int64), position[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cluster[1:] != cluster[:-1])
    at = np.flatnonzero(new)
    token, cluster = token[at], cluster[at]
    small, most, rest = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.maximum.reduceat(n - position, at)
    order = np.lexsort((small, token))
    token, cluster, small, most, rest = token[order], cluster[order], small[order], most[order], rest[order]

    def possible(small1, most1, rest1, small2, most2, rest2):
        fits = (small2 * rule.num <= most1 * rule.den) & (small1 * rule.num <= most2 * rule.den)
        return fits & rule.links(np.minimum(rest1, rest2), small1, small2)

    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(first, len(token)))
    blocks = -(-length // BLOCK)
    which = np.repeat(np.arange(len(first)), blocks)
    start = first[which] + BLOCK * (np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    size = np.minimum(BLOCK, first[which] + length[which] - start)
    b_small, b_most, b_rest = np.minimum.reduceat(small, start), np.maximum.reduceat(most, start), np.maximum.reduceat(rest, start)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = np.empty((0, 2), np.int64)
    left, distance = np.arange(len(start)), 0
    left = left[length[which] > 1]
    while len(left):
        right = left + distance
        inside = right < len(start)
        left, right = left[inside], right[inside]
        inside = which[left] == which[right]
        left, right = left[inside], right[inside]
        ok = possible(b_small[left], b_most[left], b_rest[left], b_small[right], b_most[right], b_rest[right])
        l, r = left[ok], right[ok]
        steps = np.append(0, np.cumsum(size[l] * size[r]))
        lo = 0
        while lo < len(l):
            hi = max(lo + 1, int(np.searchsorted(steps, steps[lo] + PAIRS, "right")) - 1)
            i, j = _cross(start[l[lo:hi]], start[r[lo:hi]], size[l[lo:hi]], size[r[lo:hi]])
            keep = i < j
            i, j = i[keep], j[keep]
            keep = possible(small[i], most[i], rest[i], small[j], most[j], rest[j])
            i, j = cluster[i[keep]], cluster[j[keep]]
            held = np.unique(np.concatenate([held, np.stack([np.minimum(i, j), np.maximum(i, j)], 1)]), axis=0)
            if len(held) > PAIRS:
                yield _rows(schema, held[:, 0], held[:, 1])
                held = held[:0]
            lo = hi
        distance += 1
    if len(held):
        yield _rows(schema, held[:, 0], held[:, 1])


def _named(docs: DataFrame, classes: DataFrame, names: DataFrame, rule: Rule, sketched: bool = False) -> DataFrame:
    """fp and shingles (or n and sketch) of the classes named, each once."""
    found = _chosen(docs, classes, rule, tables.marked(names, FILTER_BITS), sketched=sketched)
    found = found.select("fp", *(("n", "sketch") if sketched else ("items",)))
    return found.join(names, "fp", "left_semi").dropDuplicates(["fp"])  # read twice by some, from one exchange


def _close(docs: DataFrame, classes: DataFrame, members: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sketches leave it open that the clusters link: by their leaders, or by what members have beyond them."""
    sketches = _named(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), rule, sketched=True)
    bounds = members.join(classes.select("fp", "n"), "fp").groupBy("leader").agg(F.max("extra").alias("extra"), F.min("n").alias("least"))
    own = sketches.join(bounds, sketches["fp"] == bounds["leader"], "left")
    own = own.select("fp", "n", F.coalesce("extra", F.lit(0)).alias("extra"), F.least("n", "least").alias("least"), "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            differ = np.array([_differing(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())], np.int64)
            n, extra, least = (tuple(batch.column(f"{c}_{s}").to_numpy() for s in "ab") for c in ("n", "extra", "least"))
            ok = rule.links((n[0] + n[1] - differ) // 2 + extra[0] + extra[1], *least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in "ab"], schema=schema)

    side = lambda s: own.select(F.col("fp").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "extra", "least", "sketch")))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _overlaps(docs: DataFrame, classes: DataFrame, members: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """a, b, both, n_a, n_b: the exact size of the intersection of each pair of classes, without pairs that can't matter."""
    pairs = materialise(_close(docs, classes, members, pairs, rule))
    sets = _named(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), rule)
    one = sets.select(F.col("fp").alias("a"), F.col("items").alias("left"))
    two = sets.select(F.col("fp").alias("b"), F.col("items").alias("right"))
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "both", "n_a", "n_b")])

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                x, y = _unpack(x), _unpack(y)
                rows.append((a, b, _both(x, y), len(x), len(y)))
            if rows:
                yield _rows(schema, *zip(*rows))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint, both bigint, n_a bigint, n_b bigint")


def linked(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id (text_hash, group) of every document of ``docs`` (doc_id, text; others are not read).

    Two documents link when their sets of word shingles have intersection by union of at least the rule's share; the component
    is the smallest doc_id reachable by links. Words are split at ASCII blanks, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle; without words (or null) it has none and links with nothing. Repeated rows and ids are rows of
    their own; a null doc_id never names a component unless all its documents have none. No rows give no rows. ``group`` is
    a number of the component, null without words; ``text_hash`` is Spark's xxhash64 of the text.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(_signed(docs, rule))
    rows = signed.where("cell is null").select("doc_id", "text_hash", "n", "fp", "keys")
    table = tables.gathered(signed.where("cell is not null"), 1 << BITS)
    first = (F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = materialise(rows.where("fp is not null").groupBy("fp").agg(*first))
    members = _clusters(docs, classes, rule)

    entries = (classes.agg(F.sum("n")).first()[0] or 0) * (rule.den - rule.num) // rule.den
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(entries // PART_ENTRIES) + 1)
    own = _prefixes(docs, rule, table).join(members, "fp", "left")
    own = own.select("n", "prefix", F.coalesce("leader", "fp").alias("cluster"))
    packed = "part int, tokens binary, counts binary, position binary, cluster binary, n binary"
    packets = own.mapInArrow(lambda b: _packets(b, 2 * parts), packed)
    pairs = packets.repartition(parts, "part").mapInArrow(lambda b: _candidates(b, rule), "a bigint, b bigint")
    met = materialise(_overlaps(docs, classes, members, materialise(pairs.distinct()), rule))

    sure = rule.links(F.col("both"), F.col("n_a"), F.col("n_b"))
    links = met.where(sure).select("a", "b")
    groups = components(links)
    more = _open_links(docs, classes, members, met.where(~sure), groups, rule)
    if more is not None:
        groups = components(links.unionByName(more))
    groups = groups.withColumnRenamed("node", "cluster")
    whole = classes.join(members.select("fp", "leader"), "fp", "left").withColumn("cluster", F.coalesce("leader", "fp"))
    whole = whole.join(groups, "cluster", "left").select("fp", "least", F.coalesce("component", "cluster").alias("group"))
    ids = whole.groupBy("group").agg(F.min("least").alias("component_id"))
    named = whole.join(ids, "group").select("fp", "group", "component_id")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", "group")


def _halls(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Compare the guests of each hall with its hosts; rows come sorted by hall, hosts first. One link a guest is enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    now, hosts, table = None, [], None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("group", "part", "kind", "cluster", "items"))
        for group, part, kind, cluster, items in zip(*columns):
            if (group, part) != now:
                now, hosts, table = (group, part), [], None
            s = _unpack(items)
            if kind == 0:
                hosts.append((cluster, s))
            elif hosts:
                if table is None:
                    sizes = np.array([len(x) for _, x in hosts])
                    table = (np.concatenate([x for _, x in hosts]), np.cumsum(sizes) - sizes, sizes)
                every, first, sizes = table
                inside = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                ok = np.flatnonzero(rule.links(np.add.reduceat(inside.astype(np.int64), first), sizes, len(s)))
                if len(ok):
                    out.append((cluster, hosts[ok[0]][0]))
        if out:
            yield _rows(schema, *zip(*out))


def _open_links(docs, classes, members, apart, groups, rule) -> DataFrame | None:
    """Links (a, b) of clusters whose leaders don't link but some of whose members do; None where no question is open.

    Members of a and b share at most both + extra_a + extra_b shingles. Clusters for which that is enough meet, unless they are
    in one component already: the larger component's classes are hosts, in halls of about HALL, and the classes of the other
    cluster are guests in the halls of the clusters that they may link with. So sets move once a hall, not once a pair.
    """
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
    own = classes.join(members, "fp", "left").select(
        "fp", "n", F.coalesce("leader", "fp").alias("cluster"), F.coalesce("extra", F.lit(0)).alias("extra")
    )
    own = own.join(groups.withColumnRenamed("node", "cluster"), "cluster", "left").withColumn("group", F.coalesce("component", "cluster"))
    own = materialise(own.drop("component"))
    lead = own.groupBy("cluster").agg(F.max("extra").alias("e"), F.min("n").alias("least"), F.first("group").alias("group"))
    lead = lead.join(own.groupBy("group").agg(F.count("*").alias("size")), "group")
    x = apart
    for s in ("a", "b"):
        x = x.join(side(lead, s), x[s] == F.col(f"cluster_{s}"))
    most = F.col("both") + F.col("e_a") + F.col("e_b")
    x = x.where((F.col("group_a") != F.col("group_b")) & (F.col("e_a") + F.col("e_b") > 0))
    x = x.where(rule.links(most, F.least("n_a", "least_a"), F.least("n_b", "least_b")))
    larger = F.struct("size_a", "group_a") > F.struct("size_b", "group_b")
    pick = lambda c: (F.when(larger, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(larger, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    (host, guest), (group, _), (size, _) = pick("cluster"), pick("group"), pick("size")
    part = F.pmod(F.xxhash64(host), F.ceil(size / HALL)).cast("int")
    x = materialise(x.select(group.alias("group"), part.alias("part"), F.ceil(size / HALL).alias("parts"), guest.alias("guest")).distinct())
    if x.isEmpty():
        return None
    halls = x.select("group", "part", "parts").distinct()
    hosts = own.join(halls.withColumnRenamed("group", "its"), (F.col("group") == F.col("its")) & (F.pmod(F.xxhash64("cluster"), "parts") == F.col("part")))
    hosts = hosts.select("group", "part", F.lit(0).alias("kind"), "cluster", "fp")
    guests = own.select("cluster", "fp").join(x.select("group", "part", "guest"), F.col("cluster") == F.col("guest"))
    places = materialise(hosts.unionByName(guests.select("group", "part", F.lit(1).alias("kind"), "cluster", "fp")))
    sets = _named(docs, classes, places.select("fp").distinct(), rule)
    seated = places.join(sets, "fp").select("group", "part", "kind", "cluster", "items")
    seated = seated.repartition("group", "part").sortWithinPartitions("group", "part", "kind")
    return materialise(seated.mapInArrow(lambda b: _halls(b, rule), "a bigint, b bigint").distinct())


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that stay when one document of each component is kept.

    It is the one with the smallest doc_id (null last; of rows that share it, the smallest hash of the text). Documents
    without words all stay. Rows that repeat doc_id and text are one document. Only rows that may have to go (by a table of
    flags) are shuffled with their texts.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    found = materialise(linked(docs, rule).select("doc_id", "text_hash", "group"))
    first = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_hash")
    kept = first.unionByName(found.where(F.col("group").isNull()).select("doc_id", "text_hash")).distinct()
    name, hashed, flag = (T.fresh(docs, x) for x in ("kept_id", "kept_hash", "kept_flag"))
    kept = materialise(kept.toDF(name, hashed))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.col("text_hash") == F.col(hashed))
    pairs = found.groupBy("doc_id", "text_hash").count().join(kept, same, "left")
    doubtful = pairs.where(F.col(hashed).isNull() | (F.col("count") > 1)).select(F.xxhash64("doc_id", "text_hash"))
    flags = docs.sparkSession.sparkContext.broadcast(tables.marked(doubtful, DOUBT_BITS))
    own_id, own_hash = F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))

    def told(batches):
        for batch in batches:
            codes = batch.column(flag).to_numpy().view(np.uint64)
            hits = pa.array(tables.hit(flags.value, codes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], hits], names=batch.schema.names)

    coded = docs.withColumn(flag, F.xxhash64(own_id, own_hash))
    marked = coded.mapInArrow(told, StructType([*docs.schema.fields, StructField(flag, BooleanType())]))
    some = marked.where(flag).join(kept, own_id.eqNullSafe(F.col(name)) & (own_hash == F.col(hashed))).dropDuplicates([name, hashed])
    return marked.where(~F.col(flag)).select(*docs.columns).unionByName(some.select(*docs.columns))
