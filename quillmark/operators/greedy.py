"""Greedy walks through long ordered groups, where what is taken next depends on what was taken last: spans without overlap, weeks that fill up.

Each row's next one, if it were taken, is known from the rows alone: an as-of join. What is taken is what the first row reaches. So a walk is pointers, and no task
holds a group: rows are ranged over partitions and numbered in two steps; in a block of neighbours each row learns where a walk that meets it leaves the block;
pointer doubling over those exits gives the row at which the walk enters each block, in as many rounds as the logarithm of the number of blocks; and each
block is walked from there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

#: Groups of more rows go by pointers; a block of a group, in rows.
CROWD, BLOCK = 2_000, 1 << 16


def crowded(rows: DataFrame, group: list[str], crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of groups up to `crowd` rows, and of the others (None: there are none)."""
    many = rows.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > crowd).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    if many.isEmpty():
        return rows, None
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")


def numbered(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with __pos, from 0 in each group, in order, __part (parts follow each other), and for each of sums the sum up to this row."""
    sums, by = sums or {}, [*group, "__part"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()), "walk-rows")
    local = Window.partitionBy(*by).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    r = ranged.withColumn("__pos", F.row_number().over(local).cast("long") - 1)
    for name, c in sums.items():
        r = r.withColumn(name, F.sum(c).over(upto))
    parts = ranged.groupBy(*by).agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__of_{name}") for name, c in sums.items()))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__to_{c}") for c in ["__rows", *(f"__of_{name}" for name in sums)]))
    r = _by_key(r, parts, by).withColumn("__pos", F.col("__pos") + F.col("__to___rows"))
    for name in sums:
        r = r.withColumn(name, F.col(name) + F.col(f"__to___of_{name}"))
    return r.drop(*(c for c in r.columns if c.startswith("__to_")))


def _by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet; right's own columns are added."""
    r = right.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    return left.join(r, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]).drop(*(f"__k{i}" for i in range(len(keys))))


def first_at_least(rows: DataFrame, group: list[str], value: str, asked: str, out: str) -> DataFrame:
    """rows (numbered, `value` not falling with __pos) with out: the __pos of the group's first row whose value is at least this row's `asked`; null if none is.

    Two steps, as no window holds a group: the group's parts and their largest values tell the part, a window over the part the row.
    """
    ends = rows.groupBy(*group, "__part").agg(F.max(value).alias("most")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__part", "most"))).alias("__ends"))
    found = _by_key(rows, ends, group).withColumn("__to", F.get(F.filter("__ends", lambda x: x["most"] >= F.col(asked)), 0)["__part"]).drop("__ends")
    points = rows.select(*group, F.col("__part").alias("__to"), F.col(value).alias("__v"), F.lit(1).alias("__kind"), F.col("__pos").alias("__hit"))
    asks = found.withColumn("__v", F.col(asked)).withColumn("__kind", F.lit(0))
    both = asks.unionByName(points, allowMissingColumns=True)
    # From the largest value down: a frame that grows costs one step a row.
    order = Window.partitionBy(*group, "__to").orderBy(F.desc("__v"), F.desc("__kind"), F.desc("__hit")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("__hit", ignorenulls=True).over(order)).filter("__kind = 0").withColumn(out, F.when(F.col("__to").isNotNull(), F.col(out))).drop("__v", "__kind", "__hit", "__to")


def walked(rows: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """rows (group, __pos from 0, __next: a larger __pos or null) with __taken, whether the walk from the first row meets it, and __met, how many it has met up to it."""
    rows = written(rows.withColumn("__block", F.floor(F.col("__pos") / block)), "walk-next")
    by = [*group, "__block"]
    exits = written(_in_blocks(rows, by, ["__exit"], _exits), "walk-exits")
    # Only rows at which a walk may enter a block carry pointers from block to block.
    targets = exits.filter("__exit IS NOT NULL").select(*group, F.col("__exit").alias("__pos")).distinct()
    met = written(exits.filter("__pos = 0").select(*group, "__pos"), "walk-met")
    jump = written(_by_key(exits.select(*group, "__pos", "__exit"), targets.unionByName(met).distinct(), [*group, "__pos"]).filter("__exit IS NOT NULL"), "walk-jump")
    while not jump.isEmpty():
        gone = _by_key(met, jump, [*group, "__pos"]).select(*group, F.col("__exit").alias("__pos"))
        met = written(met.unionByName(gone).distinct(), "walk-met")
        onward = jump.select(*group, F.col("__pos").alias("__mid"), F.col("__exit").alias("__far"))
        jump = written(_by_key(jump.withColumn("__mid", F.col("__exit")), onward, [*group, "__mid"]).select(*group, "__pos", F.col("__far").alias("__exit")), "walk-jump")
    entered = met.withColumn("__block", F.floor(F.col("__pos") / block)).groupBy(*by).agg(F.min("__pos").alias("__enter"))
    same = [F.col(c).eqNullSafe(F.col(f"__e{i}")) for i, c in enumerate(by)]
    open_ = rows.join(entered.select(*(F.col(c).alias(f"__e{i}") for i, c in enumerate(by)), "__enter"), same, "left").drop(*(f"__e{i}" for i in range(len(by))))
    taken = written(_in_blocks(open_, by, ["__taken"], _walk), "walk-taken")
    blocks = taken.groupBy(*by).agg(F.sum("__taken").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    upto = Window.partitionBy(*by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = _by_key(taken.withColumn("__own", F.sum("__taken").over(upto)), blocks, by)
    return out.withColumn("__met", F.col("__own") + F.col("__before")).withColumn("__taken", F.col("__taken") == 1).drop("__own", "__before", "__next", "__enter", "__block", "__exit")


def _in_blocks(rows: DataFrame, by: list[str], out: list[str], make: Callable) -> DataFrame:
    """rows with one more column, that make(pos, next, enter) gives for the rows of a block in order."""
    name, has = out[0], "__enter" in rows.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("__pos")
        pos = t.column("__pos").to_numpy()
        nxt = t.column("__next").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        enter = (t.column("__enter")[0].as_py() if len(t) else None) if has else None
        made = make(pos, nxt, enter)
        return t.append_column(name, pa.array(made, pa.int64(), mask=made < 0))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*by).applyInArrow(run, f"{schema}, {name} long")


def _exits(pos: np.ndarray, nxt: np.ndarray, _: int | None) -> np.ndarray:
    """Where a walk that meets each row leaves the block: from the last row back."""
    first, last, out = int(pos[0]), int(pos[-1]), nxt.copy()
    for i in range(len(out) - 1, -1, -1):
        n = int(out[i])
        if 0 <= n <= last:
            out[i] = out[n - first]
    return out


def _walk(pos: np.ndarray, nxt: np.ndarray, enter: int | None) -> np.ndarray:
    out, first, last = np.zeros(len(pos), np.int64), int(pos[0]), int(pos[-1])
    at = -1 if enter is None else int(enter)
    while 0 <= at <= last:
        out[at - first] = 1
        at = int(nxt[at - first])
    return out


def spans_apart(rows: DataFrame, group: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """group, start, end of the spans that a greedy walk keeps: in order of start and end, each that begins at or after the end of the last one kept."""
    spans = rows.select(*group, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    n = first_at_least(numbered(spans, group, [start, end]), group, start, end, "__next")
    later = F.when(F.col("__next").isNotNull(), F.greatest("__next", F.col("__pos") + 1))
    # A span that ends before it begins may be told to go back: it goes to the next row, if there is one.
    n = n.withColumn("__next", later).drop("__part")
    return walked(n, group, block).filter("__taken").select(*group, start, end)


def filled_weeks(rows: DataFrame, hours: str, over: list[str], order: list[str], per_week: float, block: int = BLOCK) -> DataFrame:
    """over, order, hours, week: hours add up, in decimal to nine places, until a week has per_week, then start anew. Null and negative hours count as none."""
    h = F.greatest(F.coalesce(F.col(hours), F.lit(0.0)), F.lit(0.0)).cast("decimal(28,9)")
    told = rows.select(*over, *order, F.col(hours).cast("double").alias(hours))
    n = numbered(told, over, order, {"__sum": h}).withColumn("__sum", F.col("__sum").cast("decimal(38,9)"))
    n = n.withColumn("__asked", (F.col("__sum") - h + F.lit(per_week).cast("decimal(28,9)")).cast("decimal(38,9)"))
    n = first_at_least(n, over, "__sum", "__asked", "__full").withColumn("__next", F.greatest(F.col("__full") + 1, F.col("__pos") + 1)).withColumn("__next", F.when(F.col("__full").isNotNull(), F.col("__next")))
    w = walked(n.drop("__part", "__sum", "__asked", "__full"), over, block)
    return w.select(*over, *order, hours, F.col("__met").cast("int").alias("week"))
