"""Vectors as short codes: every part of a vector becomes the number of its nearest codebook entry, all in whole numbers.

Codebooks are moved by Lloyd rounds that remember each part's entry and exact distance. Where that entry stayed, only the entries
that moved can be nearer; where it moved, all entries are looked at again. The state of a round is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.session import scratch_path

LARGEST = 1 << 25  # components from here on can't be squared and added up in 64 bits


@dataclass
class Codebooks:
    """``entry[part, k]`` is a whole-number vector; ``scale`` is what components were multiplied by before they were cut."""

    entry: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entry.ravel().tolist())).encode()).hexdigest()


def _whole(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be coded, and their components cut to whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    x = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = np.floor(x * scale)
    fine = (np.isfinite(x) & (np.abs(x) < LARGEST)).all(axis=1)
    fits[fits] = fine
    return fits, x[fine].astype(np.int64)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exactly: in floating point while every sum is a whole number below 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if 4 * most * most * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower one of equally near ones, and its squared distance, given those of the round before."""
    code, distance = code.copy(), distance.copy()
    active, again = np.flatnonzero(moved), moved[code]
    if again.any():
        every = _distances(x[again], entries)
        code[again] = every.argmin(axis=1)
        distance[again] = every.min(axis=1)
    stayed = np.flatnonzero(~again)
    if len(active) and len(stayed):
        some = _distances(x[stayed], entries[active])
        other, least = active[some.argmin(axis=1)], some.min(axis=1)
        nearer = (least < distance[stayed]) | ((least == distance[stayed]) & (other < code[stayed]))
        code[stayed[nearer]], distance[stayed[nearer]] = other[nearer], least[nearer]
    return code, distance


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.array([np.frombuffer(x, kind) for x in column.to_pylist()], kind)


def _round(batches: Iterator[pa.RecordBatch], entry: np.ndarray, moved: np.ndarray | None, scale: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with new codes and distances; last, the sums and counts that the rows of the task give to each entry."""
    parts, entries, width = entry.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    schema = None
    for batch in batches:
        if moved is None:
            fits, x = _whole(batch.column("whole"), parts * width, scale)
            kept = batch.filter(pa.array(fits))
        else:
            kept = batch
            x = _fixed(batch.column("whole"), np.int32).astype(np.int64).reshape(-1, parts * width)
        n = len(x)
        x = x.reshape(n, parts, width)
        code, distance = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
        if n and moved is not None:
            code, distance = _fixed(batch.column("code"), np.uint8), _fixed(batch.column("distance"), np.int64)
        for p in range(parts if n else 0):
            every = np.ones(entries, bool) if moved is None else moved[p]
            own, distance[:, p] = reassign(x[:, p], entry[p], every, code[:, p].astype(np.int64), distance[:, p])
            code[:, p] = own
            chosen = np.zeros((n, entries))
            chosen[np.arange(n), own] = 1
            sums[p] += (chosen.T @ x[:, p].astype(np.float64)).astype(np.int64)
            counts[p] += np.bincount(own, minlength=entries)
        columns = [kept.column("vec_id"), kept.column("grp"), *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype(np.int32), code, distance))]
        schema = pa.schema([(c, v.type) for c, v in zip(names, columns)] + [("place", pa.int32()), ("total", pa.int64())])
        yield pa.RecordBatch.from_arrays(columns + [pa.nulls(n, t) for t in schema.types[5:]], schema=schema)
    totals = np.concatenate([sums.ravel(), counts.ravel()])
    used = np.flatnonzero(totals)
    if schema is not None and len(used):
        columns = [pa.nulls(len(used), t) for t in schema.types[:5]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(used, pa.int32()), pa.array(totals[used])], schema=schema)


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of all entries: as many numbers as the codebooks have, whatever the input."""
    cells = int(np.prod(shape))
    out = np.zeros(cells + shape[0] * shape[1], np.int64)
    for r in state.where(F.col("place").isNotNull()).groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out[:cells].reshape(shape), out[cells:].reshape(shape[:2])


def _dropped(spark: SparkSession, path: str | None) -> None:
    """Free the table of a round that nothing reads any more."""
    if path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, group: str | None = None
) -> tuple[DataFrame, Codebooks]:
    """vec_id, grp (the ``group`` column, else null), code (one byte a part) and error of each vector, and the codebooks.

    ``vectors`` has vec_id and embedding; other columns are not read. Left out are vectors that are null, hold null or non-finite
    components or, multiplied by ``scale``, one of 2**25 or more, and those that have not the most common length among those
    that ``parts`` divides (the shorter of equally common ones). Components are multiplied by ``scale`` and cut downwards to
    whole numbers. The codebook of a part starts as that part of the ``entries`` (up to 256) vectors with the smallest ids (null ids
    last, ties by content; fewer vectors, fewer entries). Each round gives every part its nearest entry (ties: the lower) and replaces every
    entry by the mean of its parts, cut downwards; entries without parts stay. ``error`` adds up the final squared distances.
    Rounds end early once no entry moves. Repeated rows and ids count as rows of their own. No vectors give no rows.

    The driver holds the codebooks and their sums only. Each round reads and writes the rows once, without a shuffle of them.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be from 1 to 256, parts 1 or more, rounds 0 or more")
    spark = vectors.sparkSession
    grp = F.col(group) if group else F.lit(None).cast("int")
    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), grp.alias("grp"), F.col("embedding").cast("array<double>").alias("whole"))
    size = F.size("whole")
    lengths = source.where(F.col("whole").isNotNull()).groupBy(size.alias("size")).count()
    common = lengths.where((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("count"), "size").first()
    dims = common["size"] if common else parts
    kind = source.schema["grp"].dataType
    named = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("grp", kind), T.StructField("whole", T.BinaryType()), T.StructField("code", T.BinaryType()),
         T.StructField("distance", T.BinaryType()), T.StructField("place", T.IntegerType()), T.StructField("total", T.LongType())]
    )

    def cut(batches):
        for batch in batches:
            fits, x = _whole(batch.column("whole"), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(fits)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    first = source.select("vec_id", "whole").mapInArrow(cut, "vec_id bigint, x array<bigint>").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries)
    entry = np.array([r["x"] for r in first.collect()], np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    if not entry.size:
        return spark.createDataFrame([], T.StructType([named["vec_id"], named["grp"], named["code"], T.StructField("error", T.LongType())])), Codebooks(entry, scale)
    state, moved, path = source, None, None
    for r in range(rounds + 1):
        last = path
        path = scratch_path(spark, f"codes-{r}")
        book, step = entry.copy(), moved
        state.mapInArrow(lambda b, book=book, step=step: _round(b, book, step, scale, named.names[:5]), named).write.parquet(path)
        state = spark.read.schema(named).parquet(path)
        _dropped(spark, last)
        if r == rounds:
            break
        sums, counts = _totals(state, entry.shape)
        mean = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], entry)
        moved = (mean != entry).any(axis=2)
        entry = mean
        if not moved.any():
            break
        state = state.where(F.col("place").isNull())

    def closed(batches):
        for batch in batches:
            far = _fixed(batch.column("distance"), np.int64).reshape(-1, parts).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "grp", "code")), pa.array(far, pa.int64())], names=["vec_id", "grp", "code", "error"])

    rows = state.where(F.col("place").isNull()).select("vec_id", "grp", "code", "distance")
    out = T.StructType([named["vec_id"], named["grp"], named["code"], T.StructField("error", T.LongType())])
    return rows.mapInArrow(closed, out), Codebooks(entry, scale)


def restored(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and embedding as the codes give it back: the entries of the parts in a row, divided by the scale."""
    entry = books.entry / books.scale

    def looked_up(batches):
        for batch in batches:
            code = _fixed(batch.column("code"), np.uint8).reshape(-1, len(entry))
            x = entry[np.arange(len(entry)), code].reshape(len(code), -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return coded.select("vec_id", "code").mapInArrow(looked_up, "vec_id bigint, embedding array<double>")


def digest(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Codes as hexadecimal digits, errors, their sum over equal groups (nulls together; null beyond 64 bits), and the codebooks' checksum."""
    totals = coded.groupBy(F.col("grp").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("grp").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
