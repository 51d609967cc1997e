"""Mixing sources to target weights by Pfair scheduling.

A source of weight w out of W may place its block k (from 0) from slot floor(k*W/w) on and before slot ceil((k+1)*W/w).
Earliest deadline first meets all these windows, so after every slot each source is less than one block away from
its share. Weights are whole numbers, so the schedule repeats after W slots: one period is laid out here,
and every block finds its slot from it by arithmetic in Spark.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in a block.
BLOCK = 32

#: Without given weights, a source of n documents weighs n ** POWER, in whole parts of about RESOLUTION.
POWER, RESOLUTION = 0.7, 1000

#: Sources a mix may hold, and slots in its longest period: slots of all periods together: what the driver keeps and tasks are sent.
MAX_SOURCES, MAX_PERIOD, MAX_PLACES = 1_000, 100_000, 2_000_000


def period(weights: dict[str, int]) -> list[str]:
    """The source of each of sum(weights) slots: earliest deadline first among released blocks, ties by name."""
    total = sum(weights.values())
    due: list[tuple[int, str, int]] = []
    waiting = [(0, name, 0) for name in weights]
    heapq.heapify(waiting)
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, name, k = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(k + 1) * total // weights[name]), name, k))
        _, name, k = heapq.heappop(due)
        slots.append(name)
        if k + 1 < weights[name]:
            heapq.heappush(waiting, ((k + 1) * total // weights[name], name, k + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """How the mix runs until every block is placed.

    A phase ends when a source has no block left; the others go on at their weights. Returns the rows (source, phase,
    first block, blocks, blocks a period, slots a period, first slot of the phase) and (source, phase, place, slot in the period).
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    spans, places, base, phase = [], [], 0, 0
    while left:
        g = 0
        for s in left:
            g = gcd(g, weights[s])
        shares = {s: weights[s] // g for s in left}
        total = sum(shares.values())
        if total > MAX_PERIOD:
            raise ValueError(f"weights add up to {total} slots, more than {MAX_PERIOD}")
        if len(places) + total > MAX_PLACES:
            raise ValueError(f"all phases together need more than {MAX_PLACES} slots: use fewer sources or rounder weights")
        slots = period(shares)
        at: dict[str, list[int]] = {s: [] for s in left}
        for t, s in enumerate(slots):
            at[s].append(t)
        length = min((left[s] - 1) // shares[s] * total + at[s][(left[s] - 1) % shares[s]] + 1 for s in left)
        for s in list(left):
            n = length // total * shares[s] + sum(t < length % total for t in at[s])
            spans.append((s, phase, done[s], n, shares[s], total, base))
            places.extend((s, phase, k, t) for k, t in enumerate(at[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base, phase = base + length, phase + 1
    return spans, places


def weights_of(counts: dict[str, int]) -> dict[str, int]:
    """Weights by a power below one of the size, so that small sources are heard."""
    scale = RESOLUTION / max(sum(n**POWER for n in counts.values()), 1)
    return {s: max(1, round(n**POWER * scale)) for s, n in counts.items()}


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, int] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """All columns of ``docs`` and mix_source, mix_block (of its source), mix_slot (place of the block in the mix) and mix_row (in the block).

    Every row is placed once; ordering by mix_slot, mix_row gives the mix. Rows of a source go in an order hashed from their
    id (ties by the id); rows that are equal in id and source are interchangeable. A NULL source is the source ''. Sources missing from
    ``weights`` weigh 1, sources without rows are left out. An empty table gives no rows. Columns named like the added ones are replaced.

    Rows are numbered in two steps, inside hash ranges of a source and then over the counts of the ranges, so a source
    with most of the rows is spread over all tasks. The driver holds a count for each source (at most ``MAX_SOURCES``).
    """
    spark = docs.sparkSession
    added = ("mix_source", "mix_block", "mix_slot", "mix_row")
    docs = docs.drop(*added)
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("mix"))
    rows = docs.withColumns({"mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_key": key})
    counts = rows.groupBy("mix_source").count().limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["mix_source"]: r["count"] for r in counts}
    chosen = weights_of(sizes) if weights is None else {s: int(weights.get(s, 1)) for s in sizes}
    if any(w < 1 for w in chosen.values()):
        raise ValueError("weights must be whole and positive")
    spans, places = phases({s: -(-n // block) for s, n in sizes.items()}, chosen)

    # about 2,000 rows a range, and a million ranges at most
    bits = max(0, min(20, (max(sizes.values(), default=1) // 2000).bit_length()))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long"))
    per_range = rows.groupBy("mix_source", "_range").agg(F.count("*").alias("_n"))
    per_range.createOrReplaceTempView("_mix_ranges")
    # two steps again: ranges within a group of 1024, then groups
    before = spark.sql(
        """with g as (select mix_source, _range div 1024 as _group, sum(_n) as n from _mix_ranges group by 1, 2),
           h as (select mix_source, _group, sum(n) over (partition by mix_source order by _group) - n as ahead from g)
           select r.mix_source, r._range,
                  h.ahead + sum(r._n) over (partition by r.mix_source, r._range div 1024 order by r._range) - r._n as _before
           from _mix_ranges r join h on r.mix_source = h.mix_source and r._range div 1024 = h._group"""
    )
    rows.createOrReplaceTempView("_mix_rows")
    numbered = spark.sql(
        f"select *, row_number() over (partition by mix_source, _range order by _key, `{id_col}`) - 1 as _in_range from _mix_rows"
    ).join(before, ["mix_source", "_range"])
    number = F.col("_before") + F.col("_in_range")
    numbered = numbered.withColumns({"mix_block": F.floor(number / F.lit(block)).cast("long"), "mix_row": (number % block).cast("int")})

    span_type = "mix_source string, _phase long, _first long, _blocks long, _share long, _total long, _base long"
    place_type = "_source string, _of long, _place long, _at long"
    spans_df = F.broadcast(spark.createDataFrame(spans, span_type).withColumnRenamed("mix_source", "_from"))
    places_df = F.broadcast(spark.createDataFrame(places, place_type))
    rest = F.col("mix_block") - F.col("_first")
    placed = (
        numbered.join(spans_df, (F.col("mix_source") == F.col("_from")) & (rest >= 0) & (rest < F.col("_blocks")))
        .join(places_df, (F.col("mix_source") == F.col("_source")) & (F.col("_phase") == F.col("_of")) & (rest % F.col("_share") == F.col("_place")))
        .withColumn("mix_slot", F.col("_base") + F.floor(rest / F.col("_share")).cast("long") * F.col("_total") + F.col("_at"))
    )
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *added)
