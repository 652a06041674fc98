"""Histogram sort: splitters found by counting exact bytes below probes, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut

#: Bits of the key that each round of probes resolves; they add up to a whole key.
ROUND_BITS = (12, 13, 13, 13, 13)
#: Probes between two row numbers, where one key alone is heavier than the tolerance.
ROW_PROBES = 4096


def _splitters(rows: DataFrame, first: list, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The n_shards - 1 keys (hash, row number) that cut the bytes evenly.

    `first` is the histogram of the first round. Each splitter starts with the bracket that
    holds its target and narrows it by exact counts until the nearest probe meets the
    tolerance: first along the hash, so that equal keys stay together, and along the
    row number only inside one key that is too heavy.
    """
    total = sum(r["bytes"] for r in first)
    slack = tolerance * total / n_shards
    done: list[tuple[int, int] | None] = [None] * (n_shards - 1)
    open_: dict[int, tuple] = {}

    def choose(k: int, bins: list[tuple[int, int, int]], below: int, kind: str, width: int, key: int | None, bits: int) -> None:
        """bins: (start, bytes, rows) in order. Takes the nearest edge, or opens the bin around the target."""
        target, at = total * (k + 1) / n_shards, below
        for start, size, rows_ in bins:
            if at + size >= target:
                best = min((abs(at - target), start), (abs(at + size - target), start + width))
                if best[0] <= slack or (kind == "row" and width == 1):
                    edge = best[1]
                    done[k] = (edge, 0) if kind == "hash" else (key, edge)
                    open_.pop(k, None)
                else:
                    open_[k] = (kind, start, width, at, key, bits)
                return
            at += size
        done[k] = (2**63, 0)
        open_.pop(k, None)

    bits = ROUND_BITS[0]
    width = 1 << (64 - bits)
    bins = sorted((r["bin"] * width, r["bytes"], r["n"]) for r in first)
    for k in range(n_shards - 1):
        choose(k, bins, 0, "hash", width, None, bits)
    while open_:
        todo = dict(open_)
        brackets = sorted(set(todo.values()))
        which = sub = F.lit(None).cast("long")
        steps = {}
        for b, (kind, start, wide, _, key, used) in enumerate(brackets):
            if kind == "hash" and used < 64:
                more = ROUND_BITS[[sum(ROUND_BITS[: i + 1]) for i in range(len(ROUND_BITS))].index(used) + 1]
                step = wide >> more
                inside = F.col("__h").between(start, start + wide - 1)
                number = F.shiftright(F.col("__h") - F.lit(start), 64 - used - more)
                steps[b] = ("hash", start, step, None, used + more)
            else:
                inside = F.col("__h") == (start if kind == "hash" else key)
                if kind == "hash":
                    ends = rows.where(inside).agg(F.min("__row"), F.max("__row")).first()
                    start, wide, key = ends[0], ends[1] - ends[0] + 1, start
                else:
                    inside = inside & F.col("__row").between(start, start + wide - 1)
                step = max(1, -(-wide // ROW_PROBES))
                number = F.floor((F.col("__row") - F.lit(start)) / F.lit(step)).cast("long")
                steps[b] = ("row", start, step, key, 64)
            which = F.when(inside, F.lit(b)).otherwise(which)
            sub = F.when(inside, number).otherwise(sub)
        counted = rows.select(which.alias("b"), sub.alias("bin"), "__size").where("b is not null").groupBy("b", "bin").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        for k, bracket in todo.items():
            b = brackets.index(bracket)
            kind, start, step, key, used = steps[b]
            bins = sorted((start + r["bin"] * step, r["bytes"], r["n"]) for r in counted if r["b"] == b)
            choose(k, bins, bracket[3], kind, step, key, used)
    return sorted(x for x in done if x is not None)


def histogram_shards(rows: DataFrame, key: Column, size: Column, n_shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """rows with `shard` (0 to n_shards - 1, near equal sums of `size`) and `slot` (0, 1, ... in each shard).

    Rows are ordered by the 64-bit hash of `key`; the law is near-equal bytes, within
    `tolerance` of a shard at each boundary as far as single rows allow. Equal keys share a
    shard unless their group alone is too heavy to be cut beside. The rows are kept once by
    a checkpoint (pass narrow rows), probes count over that, and only bounded histograms
    (at most 4,096 bins, and so many for each open splitter) reach the driver. Ranks come
    from a window over small ranges plus offsets, so no shard is gathered in one task: a
    range with many rows is dealt further by row number. Null sizes count 0; null keys
    form one group; repeated rows each get a slot; an empty table gives an empty result.
    Other columns pass through; columns named `shard` or `slot` are replaced.
    """
    base = cut(rows.withColumns({"__h": F.xxhash64(key), "__size": F.coalesce(size, F.lit(0)).cast("long"), "__row": F.monotonically_increasing_id()}))
    shift = 64 - ROUND_BITS[0]
    base = base.withColumn("__bin", F.shiftright("__h", shift))
    first = base.groupBy(F.col("__bin").alias("bin")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in first)
    most = max(256, 4 * n // len(first)) if first else 256
    cuts = _splitters(base, first, n_shards, tolerance) if first else []
    shard = F.lit(0)
    for h, row in cuts:
        left = F.lit(False) if h >= 2**63 else (F.col("__h") < h) | ((F.col("__h") == h) & (F.col("__row") < row))
        shard = shard + F.when(left, 0).otherwise(1) if h < 2**63 else shard
    hot = {r["bin"]: -(-r["n"] // most) for r in first if r["n"] > most}  # at most n / most of the 4,096 bins
    deal = F.lit(0)
    if hot:
        ways = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv]), F.col("__bin"))
        deal = F.coalesce(F.pmod(F.xxhash64("__row"), ways), F.lit(0)).cast("int")
    placed = base.withColumns({"shard": shard.cast("int"), "__deal": deal})
    ranges = placed.groupBy("shard", "__bin", "__deal").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bin", "__deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("shard", "__bin", "__deal").orderBy("__h", "__row")
    out = placed.join(F.broadcast(starts), ["shard", "__bin", "__deal"])  # bounded: bins, plus the dealt parts of hot ones
    return out.withColumn("slot", (F.row_number().over(within) - 1 + F.col("__start")).cast("long")).drop("__h", "__size", "__row", "__bin", "__deal", "__start")
