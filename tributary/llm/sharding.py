"""Sharding by histogram sort: equal bytes for each shard, with one exchange of the rows.

Rows are ordered by (hash of the text, tie key of the row). Splitters for equal bytes are found without
moving rows: every round counts, exactly and in all partitions, the bytes between candidate keys
("probes"), keeps for each splitter the interval that holds its target, and refines only those. A splitter
is done when the bytes below it are within the tolerance of the target, or when its interval is one hash
value, that is one group of equal texts. A group too heavy to stay whole within the tolerance is split by
the same search over the tie keys of its rows. Then the rows are exchanged once.

Law: `bytes`. Equal texts stay in one shard unless they weigh more than the tolerance.

Slots: numbers from 0 without gaps in a shard. Rows of a shard are dealt over lanes, whose number follows the bytes
of a shard so that a task's sort stays the same at any size, by their tie key,
which does not follow the text, so that one text with a third of all rows loads no lane more than others.
A lane's first slot is the sum of the counts of the lanes before it; counts come from one aggregate.

Edge cases: a null text has size 1 and the CRC of no bytes and is in one group with empty texts; null doc_ids and
rows that repeat a doc_id and text are in any order among themselves and all answered. A very long text is one row,
whole, in one shard: shards can differ by as much. With fewer rows than shards some shards stay empty. An empty table
gives no rows. Columns of docs called like the results are replaced by them; others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace

#: Candidate intervals for each splitter and round, a power of two.
PROBE_BITS = 10
#: Share of a shard's target by which a splitter may miss it.
TOLERANCE = 0.002
#: Lanes of a shard at least and at most; between them a lane has about LANE_BYTES.
LANES, LANE_BYTES, MAX_LANES = 64, 256 << 20, 1 << 16
_SPACE = 1 << 64


def _below(value: Column, low: int, width: int, bits: int) -> Column:
    """The probe interval of an unsigned 64-bit key, held in a signed column, within [low, low + width)."""
    shift = max(0, width.bit_length() - 1 - bits)
    signed = low - _SPACE if low >= _SPACE // 2 else low
    return F.shiftrightunsigned(value - F.lit(signed).cast("long"), shift) if shift else value - F.lit(signed).cast("long")


def _inside(value: Column, low: int, width: int) -> Column:
    """value in [low, low + width), an aligned power of two wide, by equality of the leading bits."""
    bits = width.bit_length() - 1
    if bits >= 64:
        return F.lit(True)
    signed = low - _SPACE if low >= _SPACE // 2 else low
    return F.shiftrightunsigned(value, bits) == F.shiftrightunsigned(F.lit(signed).cast("long"), bits)


def find_splitters(rows: DataFrame, key: str, size: str, targets: list[int], base: int, slack: int) -> list[tuple[int, int, int]]:
    """For each target a (key bound, bytes below it, width): width 1 if one key value straddles the target.

    Keys are the column's 64 bits taken as unsigned. base: bytes below all of rows. Each round runs one
    aggregate of at most 2**PROBE_BITS intervals for each open splitter, combined before the exchange.
    """
    open_, done = {i: (0, _SPACE, base) for i in range(len(targets))}, {}
    while open_:
        spans = sorted({(low, width) for low, width, _ in open_.values()})
        which = F.lit(None).cast("int")
        for i, (low, width) in enumerate(spans):
            which = F.when(_inside(F.col(key), low, width), F.lit(i)).otherwise(which)
        probe = F.lit(None).cast("long")
        for i, (low, width) in enumerate(spans):
            probe = F.when(F.col("__span") == i, _below(F.col(key), low, width, PROBE_BITS)).otherwise(probe)
        counted = rows.select(key, size).withColumn("__span", which).where("__span IS NOT NULL").withColumn("__probe", probe)
        found = counted.groupBy("__span", "__probe").agg(F.sum(size).alias("n")).collect()
        by_span: dict[int, list[tuple[int, int]]] = {}
        for r in found:
            by_span.setdefault(r["__span"], []).append((r["__probe"] & (_SPACE - 1), r["n"]))
        still = {}
        for i, (low, width, below) in open_.items():
            step = 1 << max(0, width.bit_length() - 1 - PROBE_BITS)
            at, total = low, below
            for probe_, n in sorted(by_span.get(spans.index((low, width)), [])):
                start = low + probe_ * step
                if total + n > targets[i]:
                    at = start
                    break
                total, at = total + n, start + step
            else:
                done[i] = (at, total, 0)
                continue
            after = total + n
            if targets[i] - total <= slack:
                done[i] = (at, total, 0)
            elif after - targets[i] <= slack:
                done[i] = (at + step, after, 0)
            elif step == 1:
                done[i] = (at, total, 1)
            else:
                still[i] = (at, step, total)
        open_ = still
    return [done[i] for i in range(len(targets))]


def _least(value: Column, bound: int) -> Column:
    """value >= bound, both unsigned."""
    if bound <= 0:
        return F.lit(True)
    if bound >= _SPACE:
        return F.lit(False)
    flip = -(1 << 63)
    return value.bitwiseXOR(F.lit(flip).cast("long")) >= F.lit(bound - (1 << 63)).cast("long")


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes of the text and 1), law, shard and slot."""
    keep = [c for c in docs.columns if c.lower() not in ("size", "law", "shard", "slot")]
    rows = docs.select(
        F.struct(*keep).alias("__row"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__key"),
        F.xxhash64(F.lit("tie"), F.col(id_col).cast("string")).alias("__tie"),
    )
    with Workspace(docs.sparkSession, "sharding") as work:
        return _placed(work, rows, shards, tolerance)


def _placed(work: Workspace, rows: DataFrame, shards: int, tolerance: float) -> DataFrame:
    # Three numbers for each row: all rounds read these, and the texts are read again only when the rows move.
    keys = work.save(rows.select("size", "__key", "__tie"), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slack = int(tolerance * total / shards)
    targets = [total * i // shards for i in range(1, shards)]
    place = F.lit(0)
    bounds = find_splitters(keys, "__key", "size", targets, 0, slack) if total else []
    heavy: dict[tuple[int, int], list[int]] = {}
    for i, (bound, below, width) in enumerate(bounds):
        if width:
            heavy.setdefault((bound, below), []).append(i)
    ties: dict[int, int] = {}
    for (bound, below), which in heavy.items():
        group = keys.where(F.col("__key") == F.lit(bound - _SPACE if bound >= _SPACE // 2 else bound).cast("long"))
        for i, (tie, _, _) in zip(which, find_splitters(group, "__tie", "size", [targets[i] for i in which], below, slack)):
            ties[i] = tie
    for i, (bound, _, width) in enumerate(bounds):
        above = _least(F.col("__key"), bound + width)
        if width:
            above = above | (_least(F.col("__key"), bound) & _least(F.col("__tie"), ties[i]))
        place = place + above.cast("int")
    lanes = min(MAX_LANES, max(LANES, total // shards // LANE_BYTES))
    lane = F.pmod(F.col("__tie"), F.lit(lanes)).cast("int")
    counts = keys.groupBy(place.cast("int").alias("shard"), lane.alias("__lane")).agg(F.count("*").alias("__n"))  # at most shards * MAX_LANES rows of three numbers: bounded, so sent to all
    before = Window.partitionBy("shard").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    firsts = work.save(firsts, "firsts")
    work.drop("keys")
    inside = Window.partitionBy("shard", "__lane").orderBy("__key", "__tie")
    placed = rows.withColumn("shard", place.cast("int")).withColumn("__lane", lane)
    out = placed.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(firsts), ["shard", "__lane"])
    return out.select("__row.*", "size", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__i") - 1).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
