"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of `block_rows` rows. With weight a of a total H (whole numbers), the source's i-th
block (from 1) is released at slot floor((i-1)H/a) and due at ceil(iH/a); one block runs in a slot, the released
block with the earliest deadline first. No source is ever a whole block ahead of or behind its target share. The
schedule repeats after H slots, so the driver works out one period, not one slot a block. When a source is used up
its phase ends, and the others go on with their weights scaled up: every row is placed exactly once.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.ranks import gapless, unfold

MAX_SOURCES = 500
RESOLUTION = 1_000
NO_SOURCE = "\u0000none"


def period(shares: dict[str, int]) -> list[str]:
    """The source that runs in each of the sum(shares) slots of a period."""
    total = sum(shares.values())
    names = sorted(shares)
    done = dict.fromkeys(names, 0)
    waiting = [(0, k) for k in range(len(names))]
    ready: list[tuple[int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            a = shares[names[k]]
            heapq.heappush(ready, (-(-(done[names[k]] + 1) * total // a), k))
        deadline, k = heapq.heappop(ready)
        assert deadline > slot, "a block missed its deadline"
        name = names[k]
        out.append(name)
        done[name] += 1
        if done[name] < shares[name]:
            heapq.heappush(waiting, (done[name] * total // shares[name], k))
    return out


def shares(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Weights as whole numbers; equal weights become 1 each, others parts of `resolution`, at least 1."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a positive target weight")
    if len(set(weights.values())) == 1:
        return dict.fromkeys(weights, 1)
    total = sum(weights.values())
    return {s: max(1, round(w / total * resolution)) for s, w in weights.items()}


def plan(rows: dict[str, int], parts: dict[str, int], block_rows: int) -> list[tuple]:
    """Phases of the whole schedule: (source, phase, first block, blocks, base slot, base position, period, its slots in the period)."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    first = dict.fromkeys(left, 0)
    out, phase, base, missing = [], 0, 0, 0
    while left:
        active = {s: parts[s] for s in left}
        order = period(active)
        size = len(order)
        slots: dict[str, list[int]] = {s: [] for s in active}
        for i, s in enumerate(order):
            slots[s].append(i)
        rounds = min(left[s] // active[s] for s in active)
        used = {s: rounds * active[s] for s in active}
        length = rounds * size
        if all(left[s] > used[s] for s in active):
            for s in order:
                used[s] += 1
                length += 1
                if used[s] == left[s]:
                    break
        elif rounds:
            # The period in which the source runs out ends at the slot of its last block.
            last = min(slots[s][-1] for s in active if used[s] == left[s])
            for s in order[last + 1 :]:
                used[s] -= 1
                length -= 1
        at = base * block_rows - missing
        for s in active:
            if used[s]:
                out.append((s, phase, first[s], used[s], base, at, size, slots[s]))
            first[s] += used[s]
            left[s] -= used[s]
            if not left[s]:
                missing += first[s] * block_rows - rows[s]
        left = {s: n for s, n in left.items() if n}
        base += length
        phase += 1
    return out


def mix(df: DataFrame, source: str, key: str, text: str | None = None, weights: dict[str, float] | None = None, block_rows: int = 32) -> DataFrame:
    """df with its place in the mixture: block (in its source), phase, slot and position (gapless from 0), all long or int.

    Target weights default to equal ones; a source not named gets weight 1. Weights are rounded to thousandths of their sum, and a smaller
    one counts as a thousandth. A null source counts as one source of its own. Inside a source, rows go in the order of a hash of
    the whole row, of key and text first: a fixed shuffle. Equal rows are counted before the shuffle and unfolded after it, so a row that is a
    third of a table is no hot spot; their positions are interchangeable. Rows that share a key, also a null one, are spread by their
    other columns. A very long text is shuffled with its row: give its hash instead, as the query does. An empty table gives an empty table.
    Only the sources' row counts come to the driver, of at most MAX_SOURCES sources: their schedule has a row for each source and phase,
    125,000 rows and a period of 1,500 slots for each at most. Columns named like a new one are replaced. Maps cannot be columns.
    """
    named = df.drop("block", "phase", "slot", "position")
    names = named.columns
    named = named.withColumn("_lk_source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)))
    counts = {r["_lk_source"]: r["n"] for r in named.groupBy("_lk_source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    target = {s: (weights or {}).get(s, 1.0) for s in counts}
    phases = plan(counts, shares(target) if target else {}, block_rows)
    schedule = df.sparkSession.createDataFrame(phases, "_lk_source string, phase int, _lk_first long, _lk_blocks long, _lk_base long, _lk_rows long, _lk_period long, _lk_slots array<int>")
    whole = named.groupBy(*names, "_lk_source").agg(F.count(F.lit(1)).alias("_lk_copies"))
    spread = F.xxhash64(*[F.col(c) for c in [key, *([text] if text else []), *names]])
    ranked = gapless(whole.withColumn("_lk_spread", spread), ["_lk_source"], F.col("_lk_spread"), ["_lk_spread", *names], copies="_lk_copies", out="_lk_first_rank")
    placed = (
        unfold(ranked, "_lk_copies", "_lk_first_rank", "_lk_rank").withColumn("block", F.floor(F.col("_lk_rank") / block_rows).cast("long"))
        .join(schedule, "_lk_source")
        .where("block >= _lk_first AND block < _lk_first + _lk_blocks")
    )
    index, n = F.col("block") - F.col("_lk_first"), F.size("_lk_slots")
    at = F.floor(index / n).cast("long") * F.col("_lk_period") + F.element_at("_lk_slots", (index % n + 1).cast("int"))
    return (
        placed.withColumn("_lk_at", at)
        .withColumn("slot", F.col("_lk_base") + F.col("_lk_at"))
        .withColumn("position", F.col("_lk_rows") + F.col("_lk_at") * block_rows + F.col("_lk_rank") % block_rows)
        .select(*names, "block", "phase", "slot", "position")
    )
