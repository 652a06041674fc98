"""Ordered work inside large groups, dealt into blocks so that no group lands in one task."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.tables import cut

#: Positions in a block.
BLOCK = 4096
#: Rows of a block that a rule follows in one task.
BLOCK_ROWS = 1 << 16


def running_total(df: DataFrame, group: list[str], major: str, minor: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """df with `out`: the sum of `value` over earlier rows of the group, in the order (major, minor), the row itself excluded.

    Two levels: rows inside a block of majors, blocks inside the group. Rows are dealt once,
    by their block. `major` is a whole number; null values count 0.
    """
    v = df.withColumn("__rt_v", F.coalesce(value, F.lit(0))).withColumn("__rt_b", F.floor(F.col(major) / block))
    up_to = lambda c, part, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = [*group, "__rt_b"]
    whole = v.groupBy(*part).agg(F.sum("__rt_v").alias("__rt_t")).withColumn("__rt_w", up_to("__rt_t", group, "__rt_b")).drop("__rt_t")
    placed = v.withColumn("__rt_o", up_to("__rt_v", part, major, minor)).join(whole, part)
    return placed.withColumn(out, F.col("__rt_o") + F.col("__rt_w")).drop("__rt_v", "__rt_b", "__rt_o", "__rt_w")


def carried_in_order(df: DataFrame, group: list[str], order: Sequence[Column], of: dict[str, tuple[Callable[[Column], Column], Column]], ranges: str | None = None) -> DataFrame:
    """df with a column for each name of `of`: an aggregate (sum, max ..) of a value over earlier rows of the group in any order, the row itself excluded; null at first.

    Rows are dealt into ranges of (group, order) and written once; values are carried inside
    a range, and a range gets what those before it carry. So a group spreads over as many
    tasks as it has ranges, and only one row for each range is brought together. Where
    `ranges` names a column, it keeps the range of each row; a df that has it is not dealt again.
    """
    values = {f"__co_{k}": v for k, (_, v) in of.items()}
    if ranges in df.columns:
        ranged = df.withColumns(values).withColumn("__co_p", F.col(ranges))
    else:
        ranged = cut(df.withColumns(values).repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__co_p", F.spark_partition_id()))
    up_to = lambda f, v, part, by: f(v).over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy(*group, "__co_p").agg(*[f(F.col(f"__co_{k}")).alias(f"__co_s_{k}") for k, (f, _) in of.items()])
    before = parts.select(*group, "__co_p", *[up_to(f, F.col(f"__co_s_{k}"), group, ["__co_p"]).alias(f"__co_b_{k}") for k, (f, _) in of.items()])
    own = ranged.withColumns({f"__co_o_{k}": up_to(f, F.col(f"__co_{k}"), [*group, "__co_p"], order) for k, (f, _) in of.items()})
    both = own.withColumnRenamed("__co_p", "__co_q").join(
        before.withColumnsRenamed({g: f"__co_g_{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"__co_g_{g}")) for g in group] + [F.col("__co_p") == F.col("__co_q")]
    )
    pair = lambda k, f: F.when(F.col(f"__co_o_{k}").isNull(), F.col(f"__co_b_{k}")).when(F.col(f"__co_b_{k}").isNull(), F.col(f"__co_o_{k}")).otherwise(_both(f, k))
    kept = [F.col("__co_p").alias(ranges)] if ranges and ranges not in df.columns else []
    return both.select(*df.columns, *kept, *[pair(k, f).alias(k) for k, (f, _) in of.items()])


def _both(f, k: str) -> Column:
    """The aggregate of two partial ones."""
    b, o = F.col(f"__co_b_{k}"), F.col(f"__co_o_{k}")
    return b + o if f is F.sum else F.greatest(b, o) if f is F.max else F.least(b, o)


def total_in_order(df: DataFrame, group: list[str], order: Sequence[Column], value: Column, out: str, ranges: str | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over earlier rows of the group in any order, the row itself excluded. Null values count 0."""
    carried = carried_in_order(df, group, order, {out: (F.sum, F.coalesce(value, F.lit(0)))}, ranges)
    return carried.withColumn(out, F.coalesce(out, F.lit(0)))


def with_neighbours(df: DataFrame, group: list[str], position: str, reach: int, add, block: int = BLOCK) -> DataFrame:
    """add(df, partition) where windows over `partition` see `reach` positions on each side.

    Rows near a block's edge are lent to the next block and dropped afterwards, so lags,
    leads and range windows over a group run in as many tasks as it has blocks.
    """
    lent = F.sequence(F.floor((F.col(position) - reach) / block), F.floor((F.col(position) + reach) / block))
    dealt = df.withColumn("__block", F.explode(lent))
    done = add(dealt, [*group, "__block"])
    return done.where(F.col("__block") == F.floor(F.col(position) / block)).drop("__block")


def in_blocks(df: DataFrame, group: list[str], order: list[str], fields: str, replay: Callable, effect: Callable, follow: Callable, block: int | None = None) -> DataFrame:
    """A rule that follows the rows of each group in turn, where what is before a row counts, in many tasks for one group.

    A group of more than `block` rows is dealt into blocks of rows that stand together.
    effect(rows) tells what a block does to any state that may enter it, as something JSON can
    hold; follow(effect, state) is the state after the block (state None: the group's start).
    Only effects pass through one task for each group, a row for a block; so every block
    learns its entry, and replay(rows, state) gives its rows the columns of `fields`. rows
    are a pyarrow table or batch of df's columns in order; replay returns a dict of arrays.
    """
    block = block or BLOCK_ROWS
    columns, names = df.columns, [f.split()[0] for f in fields.split(", ")]
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])
    rows = cut(df)
    long = rows.groupBy(*group).count().where(F.col("count") > block).select(*group)
    dealt = rows.withColumns({"__at": F.lit(0).cast("long"), "__block": F.lit(0).cast("long"), "__entry": F.lit(None).cast("string")})
    if not long.isEmpty():
        long = cut(long)
        ranged = rows.join(long, group, "left_semi").repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
        ranged = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
        big = ranged.withColumn("__block", F.floor(F.col("__at") / block))

        def summary(table: pa.Table) -> pa.Table:
            table = table.sort_by("__at")
            first = table.slice(0, 1).select([*group, "__block"])
            return first.append_column("__effect", pa.array([json.dumps(effect(table))], pa.string()))

        keys = T.StructType([*[df.schema[g] for g in group], T.StructField("__block", T.LongType())])
        effects = big.groupBy(*group, "__block").applyInArrow(summary, T.StructType([*keys.fields, T.StructField("__effect", T.StringType())]))

        def chain(batches):
            last, state = None, None
            for b in batches:
                own = list(zip(*(b.column(g).to_pylist() for g in group)))
                entries = []
                for key, does in zip(own, b.column("__effect").to_pylist()):
                    if key != last:
                        last, state = key, None
                    entries.append(json.dumps(state))
                    state = follow(json.loads(does), state)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*group, "__block")], pa.array(entries, pa.string())], [*group, "__block", "__entry"])

        entries = cut(effects.repartition(*[F.col(g) for g in group]).sortWithinPartitions(*group, "__block").mapInArrow(chain, T.StructType([*keys.fields, T.StructField("__entry", T.StringType())])))
        dealt = dealt.join(long, group, "left_anti").unionByName(big.join(entries, [*group, "__block"]))

    key = [*group, "__block"]

    def work(batches):
        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch

        def followed(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
            made: dict[str, list] = {n: [] for n in names}
            for i, j in zip(starts, [*starts[1:], rows.num_rows]):
                part = rows.slice(i, j - i)
                entry = part.column("__entry")[0].as_py()
                got = replay(part, None if entry is None else json.loads(entry))
                for n in names:
                    made[n].append(got[n])
            return pa.RecordBatch.from_arrays([*[rows.column(c) for c in columns], *[pa.concat_arrays(made[n]) for n in names]], [*columns, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([*held, batch]) if held else batch
            own = list(zip(*(rows.column(c).to_pylist() for c in key)))
            starts = [i for i, k in enumerate(own) if not i or k != own[i - 1]]
            if len(starts) > 1:
                yield followed(rows.slice(0, starts[-1]), starts[:-1])
            held = [rows.slice(starts[-1])]
        if held:
            yield followed(held[0], [0])

    # a task holds the rows of one key: a block at most, or a short group
    sorted_ = dealt.select(*columns, "__at", "__block", "__entry").repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "__at", *order)
    return sorted_.mapInArrow(work, schema)


class Unknown:
    """A name that a block can't know yet: part of a state that enters it."""

    def __init__(self, name: str):
        self.name = name


def _put(state, name, value):
    return tuple(value if x is name else x for x in state)


def symbolic_effect(rows, starts: list[tuple], step: Callable) -> list:
    """What rows do to every state that may enter: [start, partings, state after], as JSON can hold it.

    starts are states (tuples) in which entering names are Unknown; step(state, row, same) is
    the state after a row and compares names by same() only. Where an unknown name is
    compared with a known one, the states part: one goes on with that name, the other with
    another. States that come to the same go on together, so that soon only few are left.
    A parting is [name, value, row]: before that row the name was found to be no other value.
    """
    live: dict[tuple, list] = {}
    for k, start in enumerate(starts):
        live.setdefault(start, []).append((k, ()))

    def advance(state, keys, at, row, out):
        asked = []

        def same(a, b):
            a, b = (b, a) if isinstance(b, Unknown) else (a, b)
            if isinstance(a, Unknown):
                if not isinstance(b, Unknown) and b is not None:
                    asked.append((a, b))
                return a is b
            return a == b

        out.setdefault(step(state, row, same), []).extend(keys)
        for name, value in dict.fromkeys(asked):
            advance(_put(state, name, value), [(k, (*have, (name.name, value, at))) for k, have in keys], at, row, out)

    for at, row in enumerate(rows):
        out: dict[tuple, list] = {}
        for state, keys in live.items():
            advance(state, keys, at, row, out)
        live = out
    return [[k, have, [{"of": x.name} if isinstance(x, Unknown) else x for x in state]] for state, keys in live.items() for k, have in keys]


def after_symbolic(does: list, start: int, values: dict) -> tuple:
    """The state after a block that was entered in starts[start] with these values of its unknown names.

    States part at the first row that tells them apart, so the earliest parting that fits is taken, and so on.
    """
    way: list = []
    while True:
        on = [e[1] for e in does if e[0] == start and len(e[1]) == len(way) + 1 and e[1][: len(way)] == way and values[e[1][-1][0]] == e[1][-1][1]]
        if not on:
            break
        way = min(on, key=lambda have: have[-1][2])
    to = next(e[2] for e in does if e[0] == start and e[1] == way)
    return tuple(values[x["of"]] if isinstance(x, dict) else x for x in to)
