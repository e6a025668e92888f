"""Running values along an order, safe for keys of any size.

A plain ``Window.partitionBy(key).orderBy(...)`` puts all rows of a key into one task, so a key that
holds a third of the table holds a third of the work. Here keys found to be that large have the order axis
cut into slices, and the window runs per (key, slice). What earlier slices contribute comes in as one carry
row per (key, slice), computed from partial aggregates, and takes part in the same window as its first row.
The data are shuffled once, as with the plain window; without large keys the plan is the plain window.

Which keys are cut, and where, decides how even the work is and never what the result is: both come from
a sample and enter the plan as literals, so a task that is run again sees the same cuts.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import estimated_bytes

SLICE_ROWS = 1_000_000          # rows of one key that one task may well sort
MAX_SLICES = 1 << 14
MAX_LARGE_KEYS = 10_000
SAMPLE_BYTES = 4 << 20          # of keys and order column, by Catalyst's estimate
SAMPLE_ROWS_PER_SLICE = 50

_SLICE, _CARRY, _AXIS = "__slice", "__carry", "__axis"


def _axis(df: DataFrame, column: str) -> Column:
    """The order column as a number, so that it can be cut."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, T.StringType):
        return _text_axis(df, column)
    raise TypeError(f"the first order column must be a number, time or text, {column} is {kind.simpleString()}")


def _text_axis(df: DataFrame, column: str) -> Column:
    """The seven bytes behind the prefix all texts share, as a number; texts without it go to the ends."""
    text = F.col(column)
    least, greatest = df.agg(F.min(F.encode(text, "UTF-8")), F.max(F.encode(text, "UTF-8"))).first()
    prefix = os.path.commonprefix([bytes(least or b""), bytes(greatest or b"")])
    shared = F.lit(bytearray(prefix))
    raw = F.encode(text, "UTF-8")
    behind = F.rpad(F.hex(F.substring(raw, len(prefix) + 1, 7)), 14, "0")
    return (F.when(F.substring(raw, 1, len(prefix)) == shared, F.conv(behind, 16, 10).cast("bigint"))
            .when(raw < shared, F.lit(-1).cast("bigint")).when(raw > shared, F.lit(1 << 60).cast("bigint")))


def _quantiles(values: DataFrame, slices: int) -> tuple[int, list]:
    """Rows of ``values`` and the distinct cut points between ``slices`` slices of equal size."""
    steps = [position / slices for position in range(1, slices)]
    row = values.agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile_approx(_AXIS, steps, max(10_000, 10 * slices)).alias("cuts")).first()
    return row["rows"], sorted({cut for cut in row["cuts"] or [] if cut is not None})


def _position(axis: Column, cuts: list) -> Column:
    """How many cuts are not above the value, by binary search; 0 for NULL, which sorts first."""
    suffix = "D" if isinstance(cuts[0], float) else "L"
    literals = F.expr("array(" + ",".join(f"{cut!r}{suffix}" for cut in cuts) + ")")
    powers = [1 << bit for bit in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(power) for power in powers]), F.lit(0),
        lambda at, step: F.when(F.get(literals, at + step - 1) <= axis, at + step).otherwise(at))
    return F.when(axis.isNull(), F.lit(0)).otherwise(found)


class Slicing(NamedTuple):
    """Which keys are cut into slices and where, as columns over any frame with these keys and order."""

    large: Column
    position: Column


def find_slicing(df: DataFrame, keys: list[str], order: str, slices: int | None = None) -> Slicing | None:
    """The slicing for the rows of ``df``, or None where no key is large.

    A key is large when it has more rows than one task should sort, or more than its share of all tasks.
    ``slices`` cuts every key into so many slices instead.
    """
    axis = _axis(df, order)
    if slices is not None:
        cuts = _quantiles(df.select(axis.alias(_AXIS)), slices)[1] if slices > 1 else []
        return Slicing(F.lit(True), _position(axis, cuts)) if cuts else None

    narrow = df.select(*keys, axis.alias(_AXIS))
    parallelism = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large, fraction = [], min(1.0, SAMPLE_BYTES / max(1, estimated_bytes(narrow)))
    while True:
        sample = (narrow.sample(fraction, seed=7) if fraction < 1.0 else narrow).persist()
        try:
            sampled, cuts = _quantiles(sample, parallelism)
            # Catalyst may overestimate a derived frame; a sample that turns out too thin is widened.
            if sampled < SAMPLE_ROWS_PER_SLICE * parallelism and fraction < 1.0:
                fraction = min(1.0, fraction * 16)
                continue
            rows = sampled / fraction
            threshold = max(rows / MAX_LARGE_KEYS, min(SLICE_ROWS, rows / parallelism), SAMPLE_ROWS_PER_SLICE)
            if cuts and rows > threshold:
                # A hash that collides only makes one more key large.
                large = (sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                         .filter(F.col("n") > threshold * fraction)
                         .select(F.xxhash64(*keys, F.lit(0)).alias("h")).collect())
            wanted = min(MAX_SLICES, int(rows // SLICE_ROWS))
            if large and wanted > parallelism:
                cuts = _quantiles(sample, wanted)[1]
            break
        finally:
            sample.unpersist()
    if not large:
        return None
    return Slicing(F.xxhash64(*keys, F.lit(0)).isin([row["h"] for row in large]), _position(axis, cuts))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    slices: int | None = None,
    sample_from: DataFrame | None = None,
) -> DataFrame:
    """Adds running columns to ``df``, per ``keys`` and along ascending ``order``.

    ``rank`` numbers rows from 1, ``sums`` and ``maxima`` run up to and including the row, ``previous``
    holds the value of the row before, ``totals`` are sums over the whole key. ``order`` must be unique
    within a key for a definite result, and ``df`` must give the same rows each time it is read.

    Sampling runs jobs on ``df``. Where it is expensive to compute, give in ``sample_from`` a cheaper frame
    with the keys and the first order column spread alike, such as the table it is derived from.
    """
    sums, maxima, previous, totals = sums or {}, maxima or {}, previous or {}, totals or {}
    added = {
        **({rank: _Running(F.sum, F.lit(1).cast("bigint"))} if rank else {}),
        **{name: _Running(F.sum, value) for name, value in (sums or {}).items()},
        **{name: _Running(F.max, value) for name, value in (maxima or {}).items()},
    }
    befores = {name: F.struct(value.alias("v")) for name, value in (previous or {}).items()}
    totals = totals or {}
    inputs = {**{name: running.value for name, running in added.items()}, **befores, **totals}

    slicing = find_slicing(df if sample_from is None else sample_from, keys, order[0], slices)
    rows = df.withColumns({f"__in_{name}": value for name, value in inputs.items()})
    partition, sorting = list(keys), list(order)
    if slicing is not None:
        rows = rows.withColumn(_SLICE, F.when(slicing.large, slicing.position))
        carry = _carry_rows(rows, keys, order, added, befores, totals)
        # A large key's total comes with its carry rows only.
        rows = rows.withColumns({
            _CARRY: F.lit(1),
            **{f"__in_{name}": F.when(F.col(_SLICE).isNull(), F.col(f"__in_{name}")) for name in totals}})
        rows = rows.unionByName(carry, allowMissingColumns=True)
        partition, sorting = [*keys, _SLICE], [_CARRY, *order]

    inside = Window.partitionBy(*partition).orderBy(*sorting)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        **{name: running.fold(f"__in_{name}").over(upto) for name, running in added.items()},
        **{name: F.lag(f"__in_{name}").over(inside)["v"] for name in befores},
        **{name: F.sum(f"__in_{name}").over(Window.partitionBy(*partition)) for name in totals},
    })
    if slicing is not None:
        rows = rows.filter(F.col(_CARRY) == 1)
    return rows.select(*df.columns, *inputs)


class _Running(NamedTuple):
    """An aggregate that runs over a value and may be split: its fold of folds is its fold."""

    fold: Callable[[str], Column]
    value: Column


def _carry_rows(
    rows: DataFrame, keys: list[str], order: list[str], added: dict[str, _Running], befores: dict[str, Column],
    totals: dict[str, Column],
) -> DataFrame:
    """One row per large key and slice with what the slices before it amount to."""
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = rows.filter(F.col(_SLICE).isNotNull()).groupBy(*keys, _SLICE).agg(
        *[running.fold(f"__in_{name}").alias(f"__in_{name}") for name, running in added.items()],
        *[F.max_by(f"__in_{name}", F.struct(*order)).alias(f"__in_{name}") for name in befores],
        *[F.sum(f"__in_{name}").alias(f"__in_{name}") for name in totals])
    return per_slice.select(
        *keys, _SLICE, F.lit(0).alias(_CARRY),
        *[running.fold(f"__in_{name}").over(earlier).alias(f"__in_{name}") for name, running in added.items()],
        *[F.last(f"__in_{name}").over(earlier).alias(f"__in_{name}") for name in befores],
        *[F.sum(f"__in_{name}").over(Window.partitionBy(*keys)).alias(f"__in_{name}") for name in totals])


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float], slices: int | None = None
) -> DataFrame:
    """Nearest-rank quantiles per key as rows (keys, probability, value).

    Equal values are counted first; their cumulative counts then locate each quantile, so no group is
    held as a whole anywhere.
    """
    present = df.filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordered_scan(
        counted, keys, [value], sums={"__through": F.col("__n")}, totals={"__total": F.col("__n")}, slices=slices,
        sample_from=present)
    hit = F.filter(
        F.array(*[F.lit(float(p)) for p in probabilities]),
        lambda p: F.greatest(F.ceil(p * F.col("__total")), F.lit(1)).between(
            F.col("__through") - F.col("__n") + 1, F.col("__through")))
    return ranked.select(*keys, F.explode(hit).alias("probability"), value)
