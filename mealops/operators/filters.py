"""Column picks, cleaning filters, samples and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import seconds_between
from .joins import numbered


def pick(df: DataFrame, names: list[str] = (), drop: list[str] = (), suffix: str | None = None) -> DataFrame:
    """Columns by name, by inclusive range ``first:last`` and by suffix, minus ``drop``."""
    order = df.columns
    chosen: list[str] = []
    for n in names:
        if ":" in n:
            first, last = (order.index(x) for x in n.split(":"))
            chosen += order[min(first, last):max(first, last) + 1]
        else:
            chosen.append(n)
    if suffix:
        chosen += [c for c in order if c.endswith(suffix)]
    if not names and not suffix:
        chosen = list(order)
    return df.select([c for c in dict.fromkeys(chosen) if c not in drop])


def rename_block(df: DataFrame, mapping: dict[str, str] | None = None, suffix: str | None = None,
                 block: list[str] | None = None) -> DataFrame:
    """Rename by mapping, and append a suffix to a block of columns."""
    out = df.withColumnsRenamed(mapping) if mapping else df
    if suffix:
        out = out.withColumnsRenamed({c: c + suffix for c in (block or out.columns)})
    return out


def null_sentinels(df: DataFrame, sentinels: dict[str, list[str]]) -> DataFrame:
    """Placeholder texts to NULL, per column."""
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c))
                           for c, values in sentinels.items() if c in df.columns})


def valid_orders(df: DataFrame, min_price: float = 0, min_prereq: float = 0,
                 prereq_range: tuple[float, float] | None = None, year: int | None = None,
                 finite: list[str] = ()) -> DataFrame:
    cond = (F.col("price") > min_price) & (F.col("prereq") > min_prereq)
    if prereq_range:
        cond = cond & (F.col("prereq") > prereq_range[0]) & (F.col("prereq") < prereq_range[1])
    if year:
        cond = cond & (F.year("require_tm") == year)
    for c in finite:
        cond = cond & F.col(c).isNotNull() & (F.abs(F.col(c)) != float("inf"))
    return df.filter(cond)


# Bounds of the analysis sample, "name": (low, high, closed low, closed high),
# minutes and cents.
SAMPLE_BOUNDS = {
    "delay": (None, 100, False, False),
    "prereq": (0, 100, False, False),
    "left_m": (None, 240, False, False),
    "price": (0, 15000, False, True),
    "paid": (None, 15000, False, True),
    "rider_income": (None, 1300, False, True),
    "ride": (None, 1500, False, True),
    "dist": (None, 140000, False, True),
    "time": (None, 200, False, True),
    "user_exp": (None, 75, False, False),
    "u_price_avg": (None, 15000, False, False),
    "ow_ratio": (None, 3, False, False),
}

# The older sample (lead in seconds, slack in minutes).
BOUNDS_SECONDS_ERA = {
    "prereq": (2400, 3600, False, False),
    "left_m": (-120, 120, True, False),
    "dist": (None, 140000, False, True),
    "user_exp": (None, 200, False, False),
}


def within_bounds(bounds: dict[str, tuple]) -> Column:
    parts = []
    for name, (lo, hi, closed_lo, closed_hi) in bounds.items():
        c = F.col(name)
        if lo is not None:
            parts.append(c >= lo if closed_lo else c > lo)
        if hi is not None:
            parts.append(c <= hi if closed_hi else c < hi)
    return reduce(lambda a, b: a & b, parts)


def analysis_sample(df: DataFrame, bounds: dict[str, tuple] = SAMPLE_BOUNDS) -> DataFrame:
    """One conjunctive filter; a NULL in a bounded column drops the row."""
    return df.filter(within_bounds(bounds))


# Bounding box of the city.
CITY_BOX = {"lat": (31.1, 31.5), "lon": (121.3, 121.7)}


def null_outside_box(df: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Out-of-box coordinates to NULL; the row stays."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in box.items()})


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=cols or df.columns)


def _first_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows that come first by md5 of ``key|seed``: 65,536 hash ranges are counted, whole
    ranges are kept up to the n-th row and only the range it falls in is cut by rank, so no
    task sorts n rows."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    rows = df.withColumn("_h", digest).withColumn("_range", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a fixed number of ranges
    ranges = (rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))
              .select("_range", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_before")).filter(F.col("_before") < n))
    inside = Window.partitionBy("_range").orderBy("_h", key)
    return (rows.join(ranges, "_range").withColumn("_i", F.row_number().over(inside))
            .filter(F.col("_before") + F.col("_i") <= n).select(df.columns))


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows in hash order of a unique key: repeatable whatever the partitioning."""
    return _first_by_hash(df, key, n, seed)


def sample_entities(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n hash-chosen keys."""
    keys = _first_by_hash(df.select(key).filter(F.col(key).isNotNull()).distinct(), key, n, seed)
    return df.join(keys, key, "left_semi")


def row_slice(df: DataFrame, start: int, stop: int, order_by: str = "id") -> DataFrame:
    """Rows ``start..stop`` (1-based, both included) along a unique column, NULL last."""
    return numbered(df, order_by, "_pos").filter(F.col("_pos").between(start, stop)).drop("_pos")


def on_calendar(df: DataFrame, ts: str, month: int | None = None, day: int | None = None,
                hour: int | None = None, minute: int | None = None, minute_mod: int | None = None,
                max_minute: int | None = None, day_of_year: int | None = None) -> DataFrame:
    c = F.col(ts)
    for part, wanted in ((F.month(c), month), (F.day(c), day), (F.hour(c), hour),
                         (F.minute(c), minute), (F.dayofyear(c), day_of_year)):
        if wanted is not None:
            df = df.filter(part == wanted)
    if max_minute is not None:
        df = df.filter(F.minute(c) <= max_minute)
    return df.filter(F.minute(c) % minute_mod == 0) if minute_mod else df


def close_to_previous(df: DataFrame, ts: str, prev_ts: str, max_min: int = 15,
                      occ: int | None = 2, occ_col: str = "occ") -> DataFrame:
    near = F.abs(seconds_between(prev_ts, ts)) <= max_min * 60
    return df.filter(near if occ is None else near & (F.col(occ_col) == occ))


def cohort_pairs(df: DataFrame, qualifier: Column, by: list[str] = ("user_id", "sup_id")) -> DataFrame:
    """Every row of each (user, store) pair that has a qualifying row."""
    keys = df.filter(qualifier).select(*by).distinct()
    return df.join(keys, list(by), "left_semi")
