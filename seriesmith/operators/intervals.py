"""Interval labelling: which interval is in force at a time, resolved without pairing rows and intervals.

Intervals are first turned into disjoint segments that name the winning interval. Those of a key are swept in the
order of their starts by a task that holds the open ones in a heap by priority. Keys with too many rows and intervals
for one task are cut instead: each interval is split into aligned power-of-two pieces (at most two per level), pieces
are reduced to their winner, and every point where the answer may change looks its enclosing pieces up: work is linear
in the intervals times the number of levels. The segment starts are then merged into the series and carried forward
with one ordered pass, which stays balanced for a very long series.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seriesmith.operators.ordered import (
    LargeKeys, find_large_keys, join_null_safe, join_one_per_key, ordered_columns, without_large,
)
from seriesmith.session import pin, ship_package

MAX_GRID_POINTS = 4_000_000_000  # of one key
GRID_CHUNK = 4096


def _pieces(df: DataFrame) -> DataFrame:
    """Replace each interval [__low, __high] by the aligned cells (level, cell) that cover it exactly."""
    # Cells of a level that lie inside the interval are first..end-1. The outermost ones whose parent sticks out
    # are kept; all others are covered by a larger cell. No cell is longer than the interval.
    leveled = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__top")))).withColumns({
        "__first": F.expr("shiftright(__low + shiftleft(1L, level) - 1, level)"),
        "__end": F.expr("shiftright(__high + 1, level)"),
    }).filter("__first < __end")
    cells = F.expr("array_compact(array(if((__first & 1) = 1, __first, null), if((__end & 1) = 1, __end - 1, null)))")
    return leveled.withColumn("cell", F.explode(cells)).drop("__low", "__high", "__first", "__end", "__top")


def _sweep(low: list[int], high: list[int], rank: list[int], bounds: list[int]) -> tuple[list[int], list, list[int]]:
    """Points where the winner changes, the winners' rows (None: no interval) and a row of the key each belongs to.

    The rows of a key lie between two ``bounds``, ordered by ``low``; ``rank`` numbers all rows by priority.
    """
    row_of = [0] * len(rank)
    for row, r in enumerate(rank):
        row_of[r] = row
    starts, winners, owners = [], [], []
    for begin, end in zip(bounds, bounds[1:]):
        open_, at, top = [], begin, None  # open intervals by falling priority; those that ended are removed at the top
        while at < end or open_:
            point = low[at] if top is None or (at < end and low[at] <= high[top]) else high[top] + 1
            while at < end and low[at] == point:
                heapq.heappush(open_, -rank[at])
                at += 1
            while open_ and high[row_of[-open_[0]]] < point:
                heapq.heappop(open_)
            now = row_of[-open_[0]] if open_ else None
            if now != top:
                starts.append(point)
                winners.append(now)
                owners.append(begin)
            top = now
    return starts, winners, owners


def _key_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows whose key differs from the row before; NULL equals NULL."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        here, before = column[1:], column[:-1]
        for differs in (pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before))):
            new |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([np.ones(min(1, table.num_rows), bool), new]))


def _swept(valid: DataFrame, keys: list[str], priority: Sequence[str]) -> DataFrame:
    """Segments of keys that a task can hold: one shuffle by key, then one pass over the sorted intervals."""
    names = [f"__p{i}" for i in range(len(priority))]
    flat = valid.select(*keys, "__low", "__high", F.col("__w.v").alias("__v"),
                        *[F.col("__w.p").getField(p).alias(n) for p, n in zip(priority, names)])
    ship_package(valid.sparkSession)

    def found(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts)
        bounds = [*_key_starts(table, keys).tolist(), table.num_rows]
        order = pc.sort_indices(table, [(n, "ascending") for n in names], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        points, winners, owners = _sweep(table.column("__low").to_pylist(), table.column("__high").to_pylist(),
                                         rank.tolist(), bounds)
        who = [table.column(k).combine_chunks().take(pa.array(owners, pa.int64())) for k in keys]
        won = table.column("__v").combine_chunks().take(pa.array(winners, pa.int64()))
        return pa.RecordBatch.from_arrays([*who, pa.array(points, pa.int64()), won], [*keys, "start", "winner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows of keys that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            seam = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cut = int(_key_starts(pa.concat_tables([*seam, part]), keys)[-1]) - len(seam)
            if cut >= 0 and held or cut > 0:
                yield found([*held, part.slice(0, cut)])
                held = []
            held.append(part.slice(max(cut, 0)))
        if held:
            yield found(held)

    fields = flat.schema
    schema = StructType([*[fields[k] for k in keys], StructField("start", LongType()),
                         StructField("winner", fields["__v"].dataType)])
    return flat.repartition(*keys).sortWithinPartitions(*keys, "__low", "__high").mapInArrow(run, schema)


def segments(intervals: DataFrame, keys: Sequence[str], low: str, high: str, priority: Sequence[str],
             payload: Sequence[str], large: LargeKeys | None = None, large_keys: Sequence[str] | None = None) -> DataFrame:
    """Points at which the interval in force changes: keys, start, winner (struct of ``payload`` or NULL).

    Of all intervals [low, high] (both inclusive integers, negative ones too) that cover a point, the one with the
    greatest ``priority`` wins; a NULL is the least, and of equal ones any may win. ``large`` names the keys (of the columns
    ``large_keys``, all ``keys`` if not given) whose intervals no task should hold; it is counted here if not given. Keys,
    priorities and bounds are plain values, no structs.
    """
    keys, by = list(keys), list(large_keys or keys)
    valid = intervals.filter(F.col(low) <= F.col(high)).select(
        *keys, F.col(low).cast("long").alias("__low"), F.col(high).cast("long").alias("__high"),
        F.struct(F.struct(*priority).alias("p"), F.struct(*payload).alias("v")).alias("__w"))
    large = large or find_large_keys(valid, by)
    if large.marks is None:
        return _swept(valid, keys, priority)
    few = _swept(without_large(valid, by, large), keys, priority)
    return few.unionByName(_by_cells(join_null_safe(valid, large.shared(large.marks), by, "left_semi"), keys))


def _by_cells(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of keys of any size. The intervals are pinned, since cells, points and levels are all read off them."""
    valid = pin(intervals.withColumn("__top", F.length(F.bin(F.col("__high") - F.col("__low") + 1)) - 1))
    cells = _pieces(valid).groupBy(*keys, "level", "cell").agg(F.max_by("__w", F.col("__w.p")).alias("__w"))
    # Every point where the answer may change, looked up in the enclosing cell of every size its key has.
    points = valid.select(*keys, F.explode(F.array(F.col("__low"), F.col("__high") + 1)).alias("start")).distinct()
    tops = valid.groupBy(*keys).agg(F.max("__top").alias("__top"))
    lookups = (
        join_one_per_key(points, tops, keys, "inner")
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__top"))))
        .withColumn("cell", F.expr("shiftright(start, level)"))
        .drop("__top")
    )
    covered = (
        join_null_safe(lookups, cells, keys, "inner", ["level", "cell"])
        .groupBy(*keys, "start")
        .agg(F.max_by("__w", F.col("__w.p")).alias("__w"))
    )
    return join_null_safe(points, covered, keys, "left", ["start"]).select(
        *keys, "start", F.col("__w.v").alias("winner"))


def apply_segments(df: DataFrame, keys: Sequence[str], time: str, layers: Mapping[str, DataFrame],
                   large: LargeKeys | None = None) -> DataFrame:
    """Add one struct column per layer: the winner in force at each row's ``time`` (NULL if none).

    All layers are merged in a single ordered pass; rows of the series are all kept.
    """
    columns = df.columns
    names = list(layers)
    # Markers sort before the rows of the same time; the wrapper tells "no winner" from "no marker".
    wrapped = {n: layers[n].select(*keys, F.col("start").alias("__t"), F.struct("winner").alias(f"__{n}"))
               for n in names}
    rows = df.withColumns({"__t": F.col(time).cast("long"), "__row": F.lit(1)})
    merged = rows
    for n in names:
        merged = merged.unionByName(wrapped[n].withColumn("__row", F.lit(0)), allowMissingColumns=True)
    filled = ordered_columns(merged, keys, ["__t", "__row"], last={n: F.col(f"__{n}") for n in names},
                             large=large)
    return filled.filter("__row = 1").select(*columns, *[F.col(f"{n}.winner").alias(n) for n in names])


def _sizes(df: DataFrame, intervals: DataFrame, keys: Sequence[str], max_rows: int | None) -> LargeKeys:
    """Upper bound of rows plus markers per key (an interval gives at most two markers)."""
    both = df.select(*keys, F.lit(1).alias("__w")).unionByName(intervals.select(*keys, F.lit(2).alias("__w")))
    return find_large_keys(both, keys, max_rows, F.col("__w"))


def last_writer(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, low: str, high: str,
                order: Sequence[str], value: str, name: str, max_rows: int | None = None) -> DataFrame:
    """Rows inside an interval get its ``value``; the interval written last (greatest ``order``) wins."""
    large = _sizes(df, intervals, keys, max_rows)
    seg = segments(intervals, keys, low, high, order, [value], large)
    out = apply_segments(df, keys, time, {"__seg": seg}, large)
    return out.withColumn(name, F.col(f"__seg.{value}")).drop("__seg")


def patch_ranges(df: DataFrame, patches: DataFrame, keys: Sequence[str], time: str, features: Sequence[str],
                 feature: str = "feature", low: str = "start", high: str = "end", value: str = "value",
                 order: Sequence[str] = ("patch_order",), max_rows: int | None = None) -> DataFrame:
    """Overwrite features with patch values for inclusive time ranges; the last patch wins."""
    known = patches.filter(F.col(feature).isin(list(features)))
    large = _sizes(df, known, keys, max_rows)
    found = pin(segments(known, [*keys, feature], low, high, order, [value], large, keys))
    layers = {f"__patch_{f}": found.filter(F.col(feature) == f).drop(feature) for f in features}
    out = apply_segments(df, keys, time, layers, large)
    return out.withColumns(
        {f: F.coalesce(F.col(f"__patch_{f}.{value}"), F.col(f)) for f in features}
    ).select(*df.columns)


def incident_rules(incidents: DataFrame, sc: str, ec: str, se: str, ee: str, kind: str, order: str) -> DataFrame:
    """Incidents (seconds of day, 0 = unknown) to rule rows: low, high, label, rule_order.

    Class 1, 2 and 3 share the rules; class 0 (no anomaly) writes nothing.
    """
    c0, c1, e0, e1 = F.col(sc), F.col(ec), F.col(se), F.col(ee)
    no_cause = (c0 == 0) & (c1 == 0)
    open_cause = (c0 == 0) & (c1 != 0)
    no_effect = (e0 == 0) | (e1 == 0)
    known = (c0 != 0) & (c1 != 0) & (e0 != 0) & (e1 != 0)
    rules = [
        (no_cause, e0, e1, 2),
        (no_cause & (F.col(kind) == 3), c0, c1, 1),
        (open_cause, c0, c1, 1),
        (open_cause, e0, e1, 2),
        (no_effect, c0, c1, 1),
        (known, c0, c1, 1),
        (known, e0, c1, 2),
        (known, F.greatest(c1, e0), e1, 3),
    ]
    rows = F.array_compact(F.array(*[
        F.when(cond, F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"),
                              F.lit(label).alias("label"), F.lit(i).alias("rule_order")))
        for i, (cond, lo, hi, label) in enumerate(rules)
    ]))
    rest = [c for c in incidents.columns if c not in {sc, ec, se, ee}]
    return (
        incidents.filter(F.col(kind).isin(1, 2, 3))
        .select(*rest, F.inline(rows))
        .filter(F.col("low") <= F.col("high"))
    )


def drop_incidents(incidents: DataFrame, experiments: DataFrame, keys: Sequence[str], description: str, kind: str,
                   negligible: Sequence[str]) -> DataFrame:
    """Remove negligible incidents; an experiment left without any keeps one placeholder row of class 0."""
    kept = incidents.filter(~F.coalesce(F.trim(F.col(description)).isin(list(negligible)), F.lit(False)))
    return join_null_safe(experiments.select(*keys).distinct(), kept, keys).withColumn(
        kind, F.coalesce(F.col(kind), F.lit(0))
    )


def label_grid(series: DataFrame, keys: Sequence[str], time: str, name: str = "t", step: int = 1,
               max_points: int = MAX_GRID_POINTS) -> DataFrame:
    """Every ``step`` time units from the first to the last time of each key (whole numbers), to be labelled.

    A key's grid is made in chunks that are dealt to all tasks, so neither a row nor a task holds a whole span. A key
    with more than ``max_points`` points ends the query with an error: that is a bad clock value, not a series.
    """
    t = F.col(time).cast("long")
    span = series.groupBy(*keys).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi")).filter("__lo IS NOT NULL")
    points = F.floor((F.col("__hi").cast("decimal(20,0)") - F.col("__lo")) / step).cast("decimal(20,0)") + 1
    text = F.concat(F.lit("time grid of "), F.to_json(F.struct(*keys)), F.lit(" from "), F.col("__lo").cast("string"),
                    F.lit(" to "), F.col("__hi").cast("string"), F.lit(f" has more than {max_points} points"))
    checked = F.when(points > max_points, F.raise_error(text)).otherwise(points).cast("long")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__points") - 1) / GRID_CHUNK).cast("long"))
    dealt = span.withColumn("__points", checked).withColumn("__chunk", F.explode(chunks)).repartition(*keys, "__chunk")
    first, upto = F.col("__chunk") * GRID_CHUNK, F.least(F.col("__points"), (F.col("__chunk") + 1) * GRID_CHUNK) - 1
    return dealt.withColumn("__i", F.explode(F.sequence(first, upto))).select(
        *keys, (F.col("__lo") + F.col("__i") * step).alias(name))


def label_incidents(df: DataFrame, rules: DataFrame, keys: Sequence[str], time: str, order: Sequence[str],
                    name: str = "label", max_rows: int | None = None) -> DataFrame:
    """Per-row label 0-3: label 2 is never overwritten, otherwise the rule written last wins, default 0."""
    ranked = rules.withColumn("__absorbing", (F.col("label") == 2).cast("int"))
    large = _sizes(df, rules, keys, max_rows)
    seg = segments(ranked, keys, "low", "high", ["__absorbing", *order, "rule_order"], ["label"], large)
    out = apply_segments(df, keys, time, {"__seg": seg}, large)
    return out.withColumn(name, F.coalesce(F.col("__seg.label"), F.lit(0))).drop("__seg")
