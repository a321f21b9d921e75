"""Exploration: filters, grouped aggregates, calendar trends, concentration, outliers, histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from colsight.errors import DatasetError
from colsight.functions.columns import chunks, col, numeric_columns, require_numeric
from colsight.functions.local import local_frame
from colsight.functions.missing import drop_missing, is_missing, nan_to_null, number, numbers
from colsight.functions.shared import kept
from colsight.functions.text import round4
from colsight.operators.profile import QUARTILES, moments
from colsight.operators.quantiles import GROUP_ROWS, column_quantiles, exact_quantiles, grouped_quantiles
from colsight.operators.ranks import in_order, parts_for
from colsight.operators.states import column_states

PERIODS = ("year", "quarter", "month", "week", "day", "hour", "minute")


# Filters ---------------------------------------------------------------------------------------


def between(name: str, low: object | None = None, high: object | None = None) -> Column:
    """Numbers or dates from ``low`` to ``high``, both ends included; either may be open."""
    bounds = [col(name) >= low] if low is not None else []
    bounds += [col(name) <= high] if high is not None else []
    if not bounds:
        raise DatasetError(f"A range on '{name}' needs at least one end.")
    return reduce(lambda a, b: a & b, bounds)


def one_of(name: str, values: Sequence[object]) -> Column:
    """Rows whose value is in a list of categories."""
    if not values:
        raise DatasetError("A category filter needs a value.")
    return col(name).isin(list(values))


def apply_filters(df: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Rows that pass all filters. The conditions stay separate, so each can reach the scan."""
    return reduce(DataFrame.where, filters, df)


def filter_counts(df: DataFrame, filters: Sequence[Column], value: str) -> DataFrame:
    """One row: all rows, rows that pass, and passing rows that hold a value."""
    passes = reduce(lambda a, b: a & b, filters, F.lit(True))
    usable = passes & ~is_missing(value, df.schema[value].dataType)
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(passes).alias("matched_rows"),
        F.count_if(usable).alias("usable_rows"),
    )


# Groups and periods ----------------------------------------------------------------------------


def grouped_aggregate(
    df: DataFrame, by: Sequence[str], value: str, median: bool = True, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(by..., rows, count, sum, mean, median, min, max) per group; rows without a group are left out.

    A result that a group column is called like gets an underscore.
    One aggregate gives everything; medians of groups above ``group_rows`` rows are found by selection.
    """
    require_numeric(df, value)
    by = list(by)
    results = {r: r for r in ("rows", "count", "sum", "mean", *(["median"] if median else []), "min", "max")}
    for r in results:
        while results[r] in by:
            results[r] += "_"
    keys = [f"_k{i}" for i in range(len(by))]
    cells = df.select(*[col(c).alias(k) for c, k in zip(by, keys)], col(value).cast("double").alias("_x"))
    rows = drop_missing(nan_to_null(cells), keys)
    aggregates = [
        F.count("*").alias("_rows"),
        F.count("_x").alias("_count"),
        round4(F.sum("_x")).alias("_sum"),
        round4(F.avg("_x")).alias("_mean"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
    ]
    if median:
        groups = grouped_quantiles(rows, keys, "_x", [0.5], group_rows, aggregates, "_quantiles")
        groups = groups.withColumn("_median", round4(F.col("_quantiles")[0]))
    else:
        groups = rows.groupBy(*keys).agg(*aggregates)
    return groups.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[F.col(f"_{r}").alias(name) for r, name in results.items()])


_MONTHS = {"year": 12, "quarter": 3, "month": 1}
_FIXED = {"week": "7 * int(id)", "day": "int(id)", "hour": "0, int(id)", "minute": "0, 0, int(id)"}


def _naive_start(date: str, period: str) -> Column:
    """The start of a period of a zone-free timestamp; no zone takes part."""
    x = col(date)
    day = x.cast("date")
    if period in ("hour", "minute"):
        minutes = F.minute(x) if period == "minute" else F.lit(0)
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(x), minutes)
    return (day if period == "day" else F.trunc(day, period)).cast("timestamp_ntz")


def _naive_micros(x: Column) -> Column:
    """Microseconds of a zone-free timestamp since the start of 1970."""
    seconds = F.unix_date(x.cast("date")).cast("long") * 86_400 + F.hour(x) * 3_600 + F.minute(x) * 60
    return seconds * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")


def date_trend(df: DataFrame, date: str, value: str, period: str = "day") -> DataFrame:
    """(period_start, count, sum, mean) per calendar period, empty periods included."""
    if period not in PERIODS:
        raise DatasetError(f"Unknown period '{period}'.")
    require_numeric(df, value)
    naive = isinstance(df.schema[date].dataType, T.TimestampNTZType)
    start = _naive_start(date, period) if naive else F.date_trunc(period, col(date))
    rows = df.select(start.alias("start"), number(df, value).alias("x")).where("start IS NOT NULL")
    found = rows.groupBy("start").agg(
        F.count("x").alias("count"), round4(F.sum("x")).alias("sum"), round4(F.avg("x")).alias("mean")
    )
    # Only the first period and the number of periods leave the cluster; the calendar is built anew.
    low, high = F.min("start"), F.max("start")
    whole = "MONTH" if period in _MONTHS else "DAY"
    span = rows.select("start").agg(
        low.cast("string").alias("low"),
        (F.months_between(high.cast("date"), low.cast("date")) if period in _MONTHS else F.date_diff(high, low)).alias(whole),
        (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp")) if not naive else _naive_micros(high) - _naive_micros(low)).alias("micros"),
    ).first()
    if span["low"] is None:
        raise DatasetError(f"Column '{date}' holds no dates.")
    if period in _MONTHS:
        count = round(span[whole]) // _MONTHS[period]
    elif period in ("week", "day"):
        count = span[whole] // (7 if period == "week" else 1)
    else:
        count = span["micros"] // (3_600_000_000 if period == "hour" else 60_000_000)
    step = f"make_ym_interval(0, int(id) * {_MONTHS[period]})" if period in _MONTHS else f"make_dt_interval({_FIXED[period]})"
    kind = "timestamp_ntz" if naive else "timestamp"
    if not naive and period in ("week", "day"):
        # Days of a zone may have 23 or 25 hours: count them as dates.
        calendar = F.expr(f"timestamp(date_add(date'{span['low'][:10]}', int(id) * {7 if period == 'week' else 1}))")
    else:
        calendar = F.expr(f"{kind}'{span['low']}' + {step}")
    periods = df.sparkSession.range(count + 1).select(calendar.alias("start"))
    return periods.join(found, "start", "left").select(
        F.col("start").alias("period_start"), F.coalesce("count", F.lit(0)).alias("count"), "sum", "mean"
    )


def chart_points(trend: DataFrame, points: int = 160) -> DataFrame:
    """At most ``points`` evenly spaced periods of a trend, first and last included."""
    # One row per period of the calendar.
    numbered = trend.select("*", F.row_number().over(Window.orderBy("period_start")).alias("_n"))
    size = F.count("*").over(Window.partitionBy())
    slot = F.floor((F.col("_n") - 1) * (points - 1) / F.greatest(F.col("_size") - 1, F.lit(1)))
    slotted = numbered.withColumn("_size", size).withColumn("_slot", slot)
    first = F.row_number().over(Window.partitionBy("_slot").orderBy("_n"))
    keep = (F.col("_size") <= points) | (F.col("_first") == 1)
    return slotted.withColumn("_first", first).where(keep).drop("_n", "_size", "_slot", "_first")


def time_extremes(trend: DataFrame, measure: str = "mean") -> DataFrame:
    """One row: the periods with the largest and the smallest value; ties go to the earlier period."""
    return trend.where(col(measure).isNotNull()).agg(
        F.min_by("period_start", F.struct(-col(measure), F.col("period_start"))).alias("peak_period"),
        F.max(measure).alias("peak_value"),
        F.min_by("period_start", F.struct(col(measure), F.col("period_start"))).alias("trough_period"),
        F.min(measure).alias("trough_value"),
    )


def date_coverage(df: DataFrame, date: str, bucket_rows: int | None = None) -> DataFrame:
    """One row: different dates or times, first and last, days between, median gap in seconds.

    Different times are sorted by ranges; the gap across two ranges comes from their ends. ``bucket_rows`` sets how many
    rows a range has, unless that makes too many ranges; without it that is left to Spark.
    """
    day_only = isinstance(df.schema[date].dataType, T.DateType)
    if day_only:
        micros = F.unix_date(col(date)) * F.lit(86_400_000_000)
    elif isinstance(df.schema[date].dataType, T.TimestampNTZType):
        micros = _naive_micros(col(date))
    else:
        micros = F.unix_micros(col(date))
    unique = df.select(micros.alias("t")).where("t IS NOT NULL").distinct()
    parts = parts_for(unique.count(), bucket_rows) if bucket_rows else None
    with kept(in_order(unique, ["t"], _gaps, "part int, t bigint, gap bigint", parts), "date-gaps") as gaps:
        # One row per range in this unpartitioned window.
        edges = gaps.groupBy("part").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
        across = edges.select((F.col("low") - F.lag("high").over(Window.orderBy("part"))).alias("gap"))
        observations = edges.agg(F.sum("n")).first()[0]
        if not observations:
            raise DatasetError(f"Column '{date}' holds no dates.")
        spacing = exact_quantiles(gaps.select("gap").unionByName(across), "gap", [0.5])
    first, last = F.min(col(date)), F.max(col(date))
    return df.agg(first.alias("first_date"), last.alias("last_date")).select(
        F.lit(observations).cast("long").alias("unique_observations"),
        "first_date",
        "last_date",
        F.datediff("last_date", "first_date").cast("long").alias("span_days"),
        round4(F.lit(spacing[0] / 1e6 if spacing else None).cast("double")).alias("median_spacing_seconds"),
    )


def _gaps(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """(part, t, gap) of sorted times; the first of a part has no gap."""
    last = None
    for batch in batches:
        t = batch.column(0).to_numpy()
        if not len(t):
            continue
        gap = np.diff(t, prepend=t[:1] if last is None else last)
        mask = np.zeros(len(t), bool)
        mask[0] = last is None
        last = t[-1:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(t), part, np.int32)), batch.column(0), pa.array(gap, pa.int64(), mask=mask)], names=["part", "t", "gap"]
        )


# Categories ------------------------------------------------------------------------------------


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def top_categories(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """(position, name, rank, value, count): the ``k`` most frequent values of each text column."""
    names = text_columns(df) if columns is None else list(columns)
    if not names:
        return local_frame(df.sparkSession, [], "position int, name string, rank int, value string, count long")
    cells = [F.struct(F.lit(i).alias("position"), col(c).cast("string").alias("value")) for i, c in enumerate(names)]
    counts = (
        df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("position", "value").agg(F.count("*").alias("count"))
    )
    # A rank limit is applied before the shuffle: each task sends at most k rows per column.
    order = Window.partitionBy("position").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    labels = F.array(*[F.lit(c) for c in names])
    return ranked.select("position", F.get(labels, F.col("position")).alias("name"), "rank", "value", "count")


def category_concentration(df: DataFrame, name: str, share: float = 0.7) -> DataFrame:
    """One row: how many of the most frequent categories cover ``share`` of the rows.

    Works on the number of categories per frequency: there are at most sqrt(2 * rows) different
    frequencies, however many categories.
    """
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        counts.groupBy("n")
        .agg(F.count("*").alias("size"))
        .select(
            "n",
            F.sum("size").over(everything).alias("category_count"),
            (F.sum("size").over(upto) - F.col("size")).alias("more_frequent"),
            (F.sum(F.col("n") * F.col("size")).over(upto) - F.col("n") * F.col("size")).alias("rows_before"),
            F.sum(F.col("n") * F.col("size")).over(upto).alias("rows_upto"),
            F.sum(F.col("n") * F.col("size")).over(everything).alias("rows"),
        )
        .withColumn("wanted", F.ceil(F.col("rows") * F.lit(share)))
    )
    reached = levels.where("rows_upto >= wanted").orderBy(F.desc("n")).limit(1)
    return reached.withColumn("here", F.ceil((F.col("wanted") - F.col("rows_before")) / F.col("n"))).select(
        F.lit(name).alias("name"),
        "category_count",
        (F.col("more_frequent") + F.col("here")).alias("categories_needed"),
        F.round((F.col("rows_before") + F.col("here") * F.col("n")) * 100.0 / F.col("rows"), 2).alias("covered_pct"),
    )


def category_shares(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """(rank, value, count, share_pct, cumulative_pct) of the ``k`` most frequent categories."""
    present = df.where(col(name).isNotNull())
    counts = present.groupBy(col(name).alias("value")).agg(F.count("*").alias("count"))
    rows = present.agg(F.count("*")).scalar()
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    order = Window.orderBy(F.desc("count"), "value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("rows", rows).select(
        F.row_number().over(order).alias("rank"),
        "value",
        "count",
        F.round(F.col("count") * 100.0 / F.col("rows"), 2).alias("share_pct"),
        F.round(F.sum("count").over(upto) * 100.0 / F.col("rows"), 2).alias("cumulative_pct"),
    )


# Distributions ---------------------------------------------------------------------------------


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, name, low_fence, high_fence, iqr_outliers, z_outliers) of numeric, non-boolean columns.

    Fences lie 1.5 quartile distances outside the quartiles; z uses the population deviation and 3.
    """
    names = columns
    if names is None:
        names = [c for c in numeric_columns(df) if not isinstance(df.schema[c].dataType, T.BooleanType)]
    clean = numbers(df, names)
    state = column_states(clean, names, sketch=True) if names else None
    quartiles = column_quantiles(clean, names, QUARTILES, summaries=state.summaries if state else [])
    stats = {r["name"]: r for r in moments(clean, names, state).collect()}
    frames = []
    for part in chunks([c for c in names if c in quartiles]):
        cells, counts = [], []
        for c in part:
            i, (q1, _, q3) = names.index(c), quartiles[c]
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            n, std = stats[c]["count"], stats[c]["std"] or 0.0
            spread = std * ((n - 1) / n) ** 0.5
            counts.append(F.count_if((col(c) < low) | (col(c) > high)).alias(f"i{i}"))
            counts.append(F.count_if(F.abs(col(c) - F.lit(stats[c]["mean"])) > F.lit(3 * spread)).alias(f"z{i}"))
            cells.append(
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("name"),
                    round4(F.lit(low)).alias("low_fence"),
                    round4(F.lit(high)).alias("high_fence"),
                    F.col(f"i{i}").alias("iqr_outliers"),
                    (F.col(f"z{i}") if spread else F.lit(0).cast("long")).alias("z_outliers"),
                )
            )
        frames.append(clean.agg(*counts).select(F.inline(F.array(*cells))))
    if not frames:
        schema = "position int, name string, low_fence double, high_fence double, iqr_outliers long, z_outliers long"
        return local_frame(df.sparkSession, [], schema)
    return reduce(DataFrame.unionByName, frames)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(position, name, bin, low, high, count): equal-width bins from minimum to maximum, empty ones included."""
    names = numeric_columns(df) if columns is None else list(columns)
    clean = numbers(df, names)
    spans = [r for r in moments(clean, names).collect() if r["count"]]
    cells, grid = [], []
    for r in spans:
        low, high = r["min"], r["max"]
        width = (high - low) / bins
        if not math.isfinite(width):
            raise DatasetError(f"Column '{r['name']}' holds infinite values.")
        x = col(r["name"])
        at = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        at = F.when(x.isNotNull(), at).cast("int")
        cells.append(F.struct(F.lit(r["position"]).alias("position"), at.alias("bin")))
        ends = [low + b * width for b in range(bins)] + [high]
        grid += [(r["position"], r["name"], b, ends[b], ends[b + 1]) for b in range(bins)]
    bounds = local_frame(df.sparkSession, grid, "position int, name string, bin int, low double, high double")
    if not cells:
        return bounds.withColumn("count", F.lit(0).cast("long"))
    counts = clean.select(F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy("position", "bin").agg(F.count("*").alias("count"))
    # bins rows per column on both sides.
    return bounds.join(F.broadcast(counts), ["position", "bin"], "left").select(
        "position", "name", "bin", round4(F.col("low")).alias("low"), round4(F.col("high")).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


# Repeated row hashes up to which whole rows are looked up by broadcast: time only, never the result.
BROADCAST_HASHES = 1_000_000


def duplicate_rows(df: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row: all rows, different rows, and rows equal to an earlier one.

    Two hashes of each row are counted first; only rows whose hashes occur again are compared in full.
    """
    clean = nan_to_null(df)
    cells = [_comparable(f.name, f.dataType) for f in clean.schema.fields]
    hashes = [F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("_h2")]
    counts = clean.select(*hashes).groupBy("_h1", "_h2").agg(F.count("*").alias("_n"))
    again = F.col("_n") > 1
    # Hashes that occur once become one row.
    folded = counts.groupBy(F.when(again, F.col("_h1")).alias("_h1"), F.when(again, F.col("_h2")).alias("_h2"), again.alias("_again")).agg(
        F.sum("_n").alias("_n")
    )
    with kept(folded, "row-hashes") as found:
        sizes = found.groupBy("_again").agg(F.count("*").alias("hashes"), F.sum("_n").alias("rows")).collect()
        rows = sum(r["rows"] for r in sizes)
        distinct = sum(r["rows"] for r in sizes if not r["_again"])
        repeated = sum(r["hashes"] for r in sizes if r["_again"])
        if repeated:
            known = found.where("_again").select("_h1", "_h2")
            known = F.broadcast(known) if repeated <= broadcast_hashes else known
            copies = clean.select(*[c.alias(f"c{k}") for k, c in enumerate(cells)], *hashes).join(known, ["_h1", "_h2"], "left_semi")
            # Equal rows collapse in the tasks before the shuffle.
            distinct += copies.groupBy(*copies.columns).agg(F.count("*")).count()
    return local_frame(df.sparkSession, [(rows, distinct, rows - distinct)], "row_count long, distinct_rows long, duplicate_rows long")


def _comparable(name: str, dtype: T.DataType) -> Column:
    """A column whose equal values have equal hashes: zero without a sign, maps as sorted entries."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col(name) + F.lit(0.0).cast(dtype)
    return F.array_sort(F.map_entries(col(name))) if isinstance(dtype, T.MapType) else col(name)
