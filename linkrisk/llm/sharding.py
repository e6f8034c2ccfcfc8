"""Sharding [native]: minimax contiguous partition.

Rows with equal texts form one atomic group. Groups lie in the order of their
text's MD5; a shard is a run of whole groups. The smallest capacity for which
greedy filling needs no more than the wanted shards is found by a binary
search over the groups' ends, then the order is cut there.

Scale: only ids, sizes and hashes move. A group's rows are first counted per
(group, salt), so a text that holds a third of all rows never meets in one
task. Prefix sums run per hash bucket; the buckets' totals (a fixed number of
rows) carry the offsets. The search sees the buckets' ends, then only ends inside
narrowing windows around the cuts (a range filter on the stored prefix sums), and
while these hold too many, greedy cuts of a fixed number of capacities a round;
the driver never holds more than a fixed number of ends.

Edge cases: a null text has 0 bytes, CRC 0 and is one group of its own; an empty
text is another group. Repeated rows are rows of one group with slots of their
own. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from linkrisk.llm.base import store

#: Hash buckets of the prefix sums; sub-groups of a group; group ends that the
#: driver may hold at once; capacities tried in a round.
BUCKETS, SALTS, MOST_ENDS, CAPS = 4096, 64, 50_000, 16


def greedy(points: list[tuple[int, int]], cap: int, shards: int, total: int) -> list[tuple[int, int]] | None:
    """Cuts (bytes, rows) of greedy filling when only ``points`` (sorted ends of
    groups) may be cut at; None if ``shards`` shards do not suffice."""
    cuts = [(0, 0)]
    for _ in range(shards):
        at = bisect_right(points, (cuts[-1][0] + cap, float("inf")))
        if not at or points[at - 1][0] <= cuts[-1][0]:
            return None
        cuts.append(points[at - 1])
        if cuts[-1][0] >= total:
            return cuts
    return None


def least_capacity(points: list[tuple[int, int]], lo: int, hi: int, shards: int, total: int) -> int:
    """Binary search of the smallest capacity in [lo, hi] that suffices."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(points, mid, shards, total) else (mid + 1, hi)
    return lo


def exact_cuts(prefix: DataFrame, caps: list[int], shards: int, total: int, largest: int) -> list[list[tuple[int, int]]]:
    """Cuts of greedy filling over all groups, for each capacity (of at least
    ``largest``); one aggregate of a row per cut, for all capacities together.
    Capacities that do not suffice end below ``total``."""
    cuts = [[(0, 0)] for _ in caps]
    for _ in range(shards):
        ends = sorted({min(c[-1][0] + cap, total) for c, cap in zip(cuts, caps) if c[-1][0] < total})
        if not ends:
            break
        # the last group end up to x lies behind x - largest
        near = prefix.filter(F.col("end_bytes").between(ends[0] - largest, ends[-1]))
        last = [F.max(F.when(F.col("end_bytes") <= x, F.col(c))) for x in ends for c in ("end_bytes", "end_rows")]
        found = near.agg(*[m.alias(f"m{i}") for i, m in enumerate(last)]).first()
        at = {x: (found[2 * i], found[2 * i + 1]) for i, x in enumerate(ends)}
        for c, cap in zip(cuts, caps):
            if c[-1][0] < total:
                c.append(at[min(c[-1][0] + cap, total)])
    return cuts


def minimax_cuts(prefix: DataFrame, shards: int, total: int, largest: int) -> list[tuple[int, int]]:
    """Cuts (bytes, rows) for the smallest feasible capacity over all groups.

    The search starts from the ends of the hash buckets, whose answer is an upper
    bound. Cut i of any better answer lies between total - (shards - i) * bound and
    i * bound, and between the cuts i of a capacity that is too small and of one that
    suffices; when few enough ends are left there, all are taken. Otherwise ``CAPS``
    capacities are tried over all groups, which leaves one of ``CAPS`` parts of the
    range: at most log(range) / log(CAPS) + 1 rounds, whatever the ends are."""
    lo = max(-(-total // shards), largest)
    ends = prefix.groupBy("b").agg(F.max(F.struct("end_bytes", "end_rows")).alias("e")).select("e.*").collect()
    points = sorted((r[0], r[1]) for r in ends)
    hi = least_capacity(points, lo, total, shards, total)
    best = greedy(points, hi, shards, total)
    least, most = [0] * (shards + 1), [total] * (shards + 1)  # of cut i, from the capacities tried
    while lo < hi:
        windows = [(max(total - (shards - i) * hi, least[i]), min(i * hi, most[i])) for i in range(1, shards)]
        near = prefix.filter(reduce(lambda a, b: a | b, [F.col("end_bytes").between(*w) for w in windows], F.lit(False)))
        if near.count() <= MOST_ENDS:
            points = sorted({*best[1:], *((r[0], r[1]) for r in near.select("end_bytes", "end_rows").collect())})
            return greedy(points, least_capacity(points, lo, hi, shards, total), shards, total)
        caps = sorted({lo + (hi - lo) * k // CAPS for k in range(CAPS)})
        for cap, cuts in zip(caps, exact_cuts(prefix, caps, shards, total, largest)):
            if cuts[-1][0] >= total:
                hi, best = cap, cuts
                most = [c for c, _ in cuts] + [total] * (shards + 1 - len(cuts))
                break
            lo, least = cap + 1, [c for c, _ in cuts]
    return best


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``df``.

    size: UTF-8 bytes of the text plus 1. slot: gapless from 0 in each shard.
    """
    text = F.col(text_col)
    rows = store(df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("-")).alias("g"),
    ).withColumn("b", F.pmod(F.conv(F.substring("g", 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
     .withColumn("b", F.coalesce("b", F.lit(0)))
     .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "shard-rows")
    parts = store(rows.groupBy("b", "g", "salt", "size").agg(F.count("*").alias("n")), "shard-parts")
    groups = parts.groupBy("b", "g", "size").agg(F.sum("n").alias("n")).withColumn("bytes", F.col("n") * F.col("size"))
    groups = store(groups, "shard-groups")
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    schema = "doc_id {t}, size bigint, text_crc32 bigint, shard int, slot bigint".format(t=rows.schema["doc_id"].dataType.simpleString())
    if total is None:
        return df.sparkSession.createDataFrame([], schema)
    # offsets of the buckets: a fixed number of rows, so one task and a broadcast are safe
    before = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = groups.groupBy("b").agg(F.sum("bytes").alias("bb"), F.sum("n").alias("bn")).select(
        "b", F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    upto = W.partitionBy("b").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    prefix = store(groups.withColumns({"eb": F.sum("bytes").over(upto), "en": F.sum("n").over(upto)})
                   .join(F.broadcast(offsets), "b")
                   .select("b", "g", "n", "bytes", (F.col("eb") + F.col("b0")).alias("end_bytes"),
                           (F.col("en") + F.col("n0")).alias("end_rows")), "shard-prefix")
    cuts = minimax_cuts(prefix, shards, total, largest)
    starts, inner = cuts[:-1], cuts[1:-1]  # where each shard begins; the cuts between shards
    shard = sum((F.when(F.col("end_bytes") - F.col("bytes") >= F.lit(b), 1).otherwise(0) for b, _ in inner), F.lit(0))
    base = F.element_at(F.array(*[F.lit(int(n)).cast("long") for _, n in starts]), F.col("shard") + 1)
    placed = (prefix.withColumn("shard", shard.cast("int"))
              .select("g", "shard", (F.col("end_rows") - F.col("n") - base).alias("slot0")))
    # first slot of each (group, salt): at most SALTS rows a group
    ahead = W.partitionBy("g").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    first = parts.select("g", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    first = first.join(placed, "g").select("g", "salt", "shard", (F.col("slot0") + F.col("ahead")).alias("slot0"))
    own = W.partitionBy("g", "salt").orderBy("doc_id")
    return (rows.withColumn("r", F.row_number().over(own) - 1).join(first, ["g", "salt"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("r")).cast("long").alias("slot")))
