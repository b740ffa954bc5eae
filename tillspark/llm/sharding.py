"""Sharding by histogram sort: equal bytes in key order.

Documents are ordered by a hash of the text, then a hash of the id. The bytes below candidate boundaries are counted exactly
over all partitions, the candidates between which a splitter lies are spread anew, and so on until every splitter is within
tolerance; then the rows are exchanged once, by range. Equal texts stay in one shard unless their group is larger than what
the tolerance for groups allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.session import materialise

PROBES = 4096  # candidate boundaries between which a splitter is looked for in one round
_TOP = (1 << 60) - 1


def _hash(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 4)


@dataclass
class Bracket:
    """Keys lo..hi that hold the splitter of ``target``; bytes of smaller keys, and up to hi. With ``group``, second keys of the
    rows with that key."""

    target: float
    group: int | None = None
    lo: int = 0
    hi: int = _TOP
    below: int = 0
    upto: int = 0


def _refine(rows: DataFrame, key: str, brackets: list[Bracket], tolerance: float) -> list[Bracket]:
    """Narrow each bracket until its bytes are within tolerance or it is a single key; all of them by one count a round."""
    while todo := sorted({(b.group or 0, b.lo, b.hi) for b in brackets if b.upto == 0 or (b.hi > b.lo and b.upto - b.below > tolerance)}):
        which, cell = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        for k, (group, lo, hi) in enumerate(todo):
            step = (hi - lo) // PROBES + 1
            here = F.col(key).between(lo, hi)
            if key == "second":
                here &= F.col("key") == group
            which = F.when(here, F.lit(k)).otherwise(which)
            cell = F.when(here, F.expr(f"(`{key}` - {lo}) div {step}")).otherwise(cell)
        counted = rows.groupBy(which.alias("which"), cell.alias("cell")).agg(F.sum("size").alias("bytes")).where("which is not null")
        sums: dict[int, dict[int, int]] = {}
        for r in counted.collect():  # at most PROBES rows a splitter
            sums.setdefault(r["which"], {})[r["cell"]] = r["bytes"]
        for b in brackets:
            if (b.group or 0, b.lo, b.hi) not in todo:
                continue
            found = sums[todo.index((b.group or 0, b.lo, b.hi))]
            step, lo, hi, run = (b.hi - b.lo) // PROBES + 1, b.lo, b.hi, b.below
            for c in sorted(found):
                if run + found[c] > b.target or c == max(found):
                    b.lo, b.hi, b.below, b.upto = lo + c * step, min(hi, lo + (c + 1) * step - 1), run, run + found[c]
                    break
                run += found[c]
    return brackets


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, group_tolerance: float = 0.01) -> list[tuple[int, int]]:
    """Boundaries (key, second) of equal bytes; rows from a boundary on belong to the next shard.

    ``rows`` has key, second and size. ``tolerance`` is a part of the mean shard. A boundary falls between two keys if one is
    within ``group_tolerance`` of its place, else inside the group of equal keys, between two values of ``second``.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total or shards < 2:
        return [(_TOP + 1, 0)] * (shards - 1)
    mean = total / shards
    out, inside = [], []
    for b in _refine(rows, "key", [Bracket(mean * i) for i in range(1, shards)], tolerance * mean):
        near, low = min((abs(b.target - b.below), True), (abs(b.upto - b.target), False))
        if near > group_tolerance * mean and b.lo == b.hi:
            inside.append(Bracket(b.target, b.lo, below=b.below))
        else:
            out.append((b.lo, 0) if low else (b.hi + 1, 0))
    for s in _refine(rows, "second", inside, tolerance * mean):
        out.append((s.group, s.lo if s.target - s.below <= s.upto - s.target else s.hi + 1))
    return sorted(out)


def place(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, group_tolerance: float = 0.01) -> DataFrame:
    """Shard and slot of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the shards have nearly equal bytes. ``size`` is the UTF-8 length of the text plus 1; a null text counts as
    empty but its checksum is null. Rows of one shard are numbered from 0 in key order. ``docs`` has doc_id and text; other
    columns are not read. A null doc_id is sorted by its hash like any other; repeated rows are rows of their own and stay
    side by side. With fewer documents than shards some shards are empty; no rows give no rows. ``grown_shard`` is null: the
    law says nothing about a further shard.
    """
    rows = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            _hash("text").alias("key"),
            _hash("doc_id").alias("second"),
        )
    )
    shard = F.lit(0)
    for key, second in splitters(rows, shards, tolerance, group_tolerance):
        shard = shard + F.when((F.col("key") > key) | ((F.col("key") == key) & (F.col("second") >= second)), 1).otherwise(0)
    order = ["shard", "key", "second", "doc_id", "size"]
    ranged = rows.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = materialise(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # one row for each range and shard: as many as there are tasks, and the shards
    starts = sorted_rows.groupBy(part.alias("part"), F.col("shard").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    offset, ahead = {}, {}
    for r in sorted(starts.collect(), key=lambda r: (r["of"], r["part"])):
        offset[r["part"], r["of"]] = (ahead.get(r["of"], 0), r["first"])
        ahead[r["of"]] = ahead.get(r["of"], 0) + r["n"]
    table = docs.sparkSession.createDataFrame([(p, s, a - f) for (p, s), (a, f) in offset.items()], "part bigint, of int, shift bigint")
    return (
        sorted_rows.withColumn("part", part)
        .join(F.broadcast(table.withColumnRenamed("part", "its")), (F.col("part") == F.col("its")) & (F.col("shard") == F.col("of")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("at") + F.col("shift")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
