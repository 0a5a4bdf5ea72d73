"""Running numbers and totals that do not need a whole key in one task.

A plain ``row_number() over (partition by key)`` sorts every row of a key in a
single task. Here the ordering is cut into slabs (a coarse prefix of the order):
one cheap aggregate counts each slab, the few slab totals are accumulated per
key, and the window itself runs per (key, slab). A key that holds a third of the
table is therefore spread over as many tasks as it has slabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_offsets(df: DataFrame, keys: list[str], slab: Column, value: Column) -> DataFrame:
    tagged = df.withColumn("_slab", slab)
    totals = tagged.groupBy(*keys, "_slab").agg(F.sum(value).alias("_total"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_slab", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return tagged.join(offsets, [*keys, "_slab"])


def slab_row_number(
    df: DataFrame, keys: list[str], slab: Column, order: list[Column], out: str, start: int = 1
) -> DataFrame:
    """Contiguous numbers from ``start`` per key; ``slab`` ascending must be a prefix of ``order``."""
    within = Window.partitionBy(*keys, "_slab").orderBy(*order)
    return (
        _with_offsets(df, keys, slab, F.lit(1))
        .withColumn(out, F.row_number().over(within) + F.col("_offset") + F.lit(start - 1))
        .drop("_slab", "_offset")
    )


def slab_running_sum(
    df: DataFrame,
    keys: list[str],
    slab: Column,
    order: list[Column],
    value: Column,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running total of ``value`` per key, including or excluding the current row."""
    last = Window.currentRow if inclusive else -1
    within = (
        Window.partitionBy(*keys, "_slab").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    return (
        _with_offsets(df.withColumn("_value", value), keys, slab, F.col("_value"))
        .withColumn(out, F.coalesce(F.sum("_value").over(within), F.lit(0)) + F.col("_offset"))
        .drop("_slab", "_offset", "_value")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key. The rank filter is pruned before the shuffle, so keys stay small."""
    name = out or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if out else kept.drop(name)
