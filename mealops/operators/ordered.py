"""Ordered per-key calculations that stay parallel inside one key.

A plain ``Window.partitionBy(key).orderBy(time)`` puts every row of a key in one task, so a
store, rider or user holding a third of the data becomes the whole job. Here a key is cut
into *cells* along its order column (by default the minute of a timestamp):

* fine level: an ordinary window inside each (key, cell), partitioned on the cell;
* coarse level: one pre-aggregated narrow row per cell (sum, last value, …), on which the
  per-key window runs. For a key it holds at most one row per cell of the covered period,
  however many orders the key has;
* the coarse result joins back on the cell. The rows are already partitioned and sorted on
  it by the fine window, so wide rows are shuffled once.

NULL keys form a group of their own: a key travels as a NULL flag and a filled value, so
that plain equality joins it and the join can use the partitioning and sort of the window.

Cells are cut by measured size: where one key has more than ``CELL_ROWS`` rows in one slot
(stamps filled by default, a bulk load), a range partitioning of those rows alone yields cut
positions, and the pieces become cells of their own. Inputs that one task could hold anyway
are not measured.

The input is evaluated twice (the coarse branch reads only the columns it needs), so it
should be a stored table or a cheap projection of one. Independent columns over different
keys are best computed each from that table and joined on the id, not chained.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import stage_shared

CELL_ROWS = 1_000_000  # rows of one key and slot that stay one cell
MEASURED_BYTES = 64 << 20  # smaller inputs are not measured
_SLOT = ["_slot_null", "_slot", "_slot_id"]
_IDS_A_CELL = 65536
_BUCKETS, _CUTS_A_BLOCK = 65536, 64


def minute_slot(ts: str | Column) -> Column:
    return F.date_trunc("minute", F.col(ts) if isinstance(ts, str) else ts)


def id_slot(key: str | Column, width: int = 65536) -> Column:
    """Cells of consecutive whole-number keys."""
    return F.floor((F.col(key) if isinstance(key, str) else key) / width)


def _filled(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        default = F.lit("")
    elif isinstance(kind, T.NumericType):
        default = F.lit(0).cast(kind)
    elif isinstance(kind, T.BooleanType):
        default = F.lit(False)
    else:
        default = F.lit("1970-01-01").cast(kind)
    return F.coalesce(c, default)


def _heavy_cells(narrow: DataFrame, cell: list[str], cell_rows: int) -> DataFrame | None:
    """Cells with more than ``cell_rows`` rows, or None. Rows are counted by a hash of their cell
    first, so that cells are grouped only where one of them may be heavy."""
    hashed = narrow.withColumn("_bucket", F.pmod(F.xxhash64(*cell), F.lit(_BUCKETS)))
    full = [r["_bucket"] for r in hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > cell_rows).select("_bucket").collect()]  # at most _BUCKETS numbers
    if not full:
        return None
    picked = narrow.sparkSession.createDataFrame([(b,) for b in full], "_bucket long")
    heavy = stage_shared(hashed.join(picked, "_bucket", "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
                         .filter(F.col("_n") > cell_rows), "heavy")
    return None if heavy.isEmpty() else heavy


def _cut_heavy(base: DataFrame, cell: list[str], order_by: list[str], among: Column, cell_rows: int) -> DataFrame:
    """Number the pieces of heavy cells in ``_slot_id``."""
    names = [f"_o{i}" for i in range(len(order_by))]
    own = [F.col(c).alias(n) for c, n in zip(order_by, names)]
    narrow = base.filter(among).select(*cell, *own)
    heavy = _heavy_cells(narrow, cell, cell_rows)
    if heavy is None:
        return base
    pieces = 2 * ceil(heavy.agg(F.sum("_n")).first()[0] / cell_rows)
    ranged = (narrow.join(heavy, cell, "left_semi").repartitionByRange(pieces, *cell, *names)
              .groupBy(*cell, F.spark_partition_id().alias("_piece")).agg(F.min(F.struct(*names)).alias("_from")))
    cuts = ranged.groupBy(*cell).agg(F.sort_array(F.collect_list("_from")).alias("_cuts"))
    last = F.floor((F.size("_cuts") - 1) / _CUTS_A_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("_cuts", i * _CUTS_A_BLOCK + 1, _CUTS_A_BLOCK))
    cuts = stage_shared(cuts.select(*cell, blocks.alias("_blocks")), "cuts")

    at = F.struct(*own)
    block = F.size(F.filter("_blocks", lambda b: b[0] <= at)) - 1
    piece = block * _CUTS_A_BLOCK + F.size(F.filter(F.get("_blocks", block), lambda c: c <= at))
    cut = F.when(F.col("_blocks").isNotNull(), piece.cast("long")).otherwise(F.col(_SLOT[2]))
    return base.join(cuts, cell, "left").withColumn(_SLOT[2], cut).drop("_blocks")


def _celled(df: DataFrame, by: list[str], slot: Column, order_by: list[str],
            cell_rows: int | None) -> tuple[DataFrame, list[str]]:
    """Add key and slot columns that are never NULL; returns the names of the keys. Rows
    without a slot are ordered by the last column alone, so whole-number ids cut them further."""
    kinds = {b: df.schema[b].dataType for b in by}
    slot_kind = df.select(slot.alias("s")).schema["s"].dataType
    cols, keys = {}, []
    for i, b in enumerate(by):
        cols[f"_k{i}"] = _filled(F.col(b), kinds[b])
        cols[f"_k{i}_null"] = F.col(b).isNull()
        keys += [f"_k{i}", f"_k{i}_null"]
    cols[_SLOT[0]], cols[_SLOT[1]] = slot.isNull(), _filled(slot, slot_kind)
    cuts = len(order_by) == 2 and isinstance(df.schema[order_by[-1]].dataType, T.IntegralType)
    block = F.floor(F.col(order_by[-1]) / _IDS_A_CELL).cast("long") if cuts else F.lit(0).cast("long")
    # NULL ids come last
    cols[_SLOT[2]] = F.when(slot.isNull(), F.coalesce(block, F.lit((1 << 63) - 1))).otherwise(F.lit(0).cast("long"))
    base = df.withColumns(cols)
    if cell_rows is None:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        if int(str(size)) < MEASURED_BYTES:
            return base, keys
    among = ~F.col(_SLOT[0]) if cuts else F.lit(True)
    return _cut_heavy(base, [*keys, *_SLOT], order_by, among, cell_rows or CELL_ROWS), keys


def ordered(df: DataFrame, by: list[str], order_by: list[str], *, slot: Column | None = None,
            running: Mapping[str, Column] | None = None,
            lags: Mapping[str, Column] | None = None,
            leads: Mapping[str, Column] | None = None,
            carry: Mapping[str, Column] | None = None,
            totals: Mapping[str, Column] | None = None,
            peaks: Mapping[str, str] | None = None, cell_rows: int | None = None) -> DataFrame:
    """Add ordered columns per group of ``by``.

    ``order_by`` sorts ascending, NULL last; only its first column may hold NULLs and the
    list must end in a unique column. ``slot`` must not decrease along the first column.

    running  inclusive running sum (NULL counts as 0)
    lags     value of the previous row, leads value of the next row
    carry    last non-NULL value at or before the row
    totals   sum over the whole group
    peaks    maximum over the group of a ``running`` column

    ``cell_rows`` rows of one group and slot stay one cell; by default ``CELL_ROWS``, measured
    only for inputs beyond ``MEASURED_BYTES`` by the planner's estimate.
    """
    running, lags, leads = dict(running or {}), dict(lags or {}), dict(leads or {})
    carry, totals, peaks = dict(carry or {}), dict(totals or {}), dict(peaks or {})
    slot = minute_slot(order_by[0]) if slot is None else slot

    base, keys = _celled(df, by, slot, order_by, cell_rows)
    cell = [*keys, *_SLOT]
    sort_keys = [F.col(c).asc_nulls_last() for c in order_by]
    fine = W.partitionBy(*cell).orderBy(*sort_keys)
    upto = fine.rowsBetween(W.unboundedPreceding, W.currentRow)
    position = F.struct(*order_by)

    # one narrow row per cell
    per_cell = []
    for name, expr in running.items():
        per_cell.append(F.sum(expr).alias(f"_s_{name}"))
    for name, expr in totals.items():
        per_cell.append(F.sum(expr).alias(f"_t_{name}"))
    for name, expr in lags.items():
        per_cell.append(F.max_by(F.struct(expr.alias("v")), position).alias(f"_l_{name}"))
    for name, expr in leads.items():
        per_cell.append(F.min_by(F.struct(expr.alias("v")), position).alias(f"_f_{name}"))
    for name, expr in carry.items():
        per_cell.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(f"_c_{name}"))

    whole = W.partitionBy(*keys)
    along = whole.orderBy(*_SLOT)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    inside = base.select(
        "*",
        *[F.coalesce(F.sum(e).over(upto), F.lit(0)).alias(f"_w_s_{n}") for n, e in running.items()],
        *[F.lag(F.struct(e.alias("v"))).over(fine).alias(f"_w_l_{n}") for n, e in lags.items()],
        *[F.lead(F.struct(e.alias("v"))).over(fine).alias(f"_w_f_{n}") for n, e in leads.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_w_c_{n}") for n, e in carry.items()])

    per_cell += [F.max(f"_w_s_{r}").alias(f"_p_{n}") for n, r in peaks.items()]
    before_sum = {n: F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in running}
    cells = (inside if peaks else base).groupBy(*cell).agg(*per_cell).select(
        *cell,
        *[before_sum[n].alias(f"_s_{n}") for n in running],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_t_{n}") for n in totals],
        *[F.lag(f"_l_{n}").over(along).alias(f"_l_{n}") for n in lags],
        *[F.lead(f"_f_{n}").over(along).alias(f"_f_{n}") for n in leads],
        *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in carry],
        *[(before_sum[r] + F.col(f"_p_{n}")).alias(f"_p_{n}") for n, r in peaks.items()])
    if peaks:
        cells = cells.withColumns({f"_p_{n}": F.max(f"_p_{n}").over(whole) for n in peaks})

    return inside.join(cells, cell, "left").select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.col(f"_w_s_{n}")).alias(n) for n in running],
        *[F.col(f"_t_{n}").alias(n) for n in totals],
        *[F.coalesce(f"_w_l_{n}", f"_l_{n}")["v"].alias(n) for n in lags],
        *[F.coalesce(f"_w_f_{n}", f"_f_{n}")["v"].alias(n) for n in leads],
        *[F.coalesce(f"_w_c_{n}", f"_c_{n}").alias(n) for n in carry],
        *[F.col(f"_p_{n}").alias(n) for n in peaks])


def ordered_steps(df: DataFrame, by: list[str], order_by: list[str], value: Column,
                  test: Callable[[Column], Column], uses: list[str], *, slot: Column | None = None,
                  flag: str | None = None, count: str | None = None, carry: str | None = None,
                  cell_rows: int | None = None) -> DataFrame:
    """Mark steps between consecutive rows of a group and accumulate them.

    ``test(prev)`` says whether a row starts something new, given the previous row's
    ``value`` (NULL before the first row) and the row's own columns listed in ``uses``.
    Outputs, each optional: ``flag`` the mark itself, ``count`` the marks so far, ``carry``
    the previous-row value at the latest mark. ``cell_rows`` as in :func:`ordered`.
    """
    slot = minute_slot(order_by[0]) if slot is None else slot
    base, keys = _celled(df, by, slot, order_by, cell_rows)
    cell = [*keys, *_SLOT]
    base = base.withColumn("_v", F.struct(value.alias("v")))
    fine = W.partitionBy(*cell).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    upto = fine.rowsBetween(W.unboundedPreceding, W.currentRow)
    position = F.struct(*order_by)
    mark = lambda prev: F.coalesce(test(prev["v"]), F.lit(False))

    # inside a cell every row but the first knows its predecessor
    inside = base.withColumn("_prev", F.lag("_v").over(fine))
    inside = inside.withColumn("_first", F.col("_prev").isNull())
    inside = inside.withColumn("_mark", ~F.col("_first") & mark(F.col("_prev")))

    along = W.partitionBy(*keys).orderBy(*_SLOT)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    per_cell = inside.groupBy(*cell).agg(
        F.count_if("_mark").alias("_inner"), F.max_by("_v", position).alias("_last"),
        F.max_by("_prev", F.when(F.col("_mark"), position)).alias("_held"),
        F.min_by(F.struct(*uses), position).alias("_head"))
    cells = (per_cell.withColumn("_cprev", F.lag("_last").over(along))
             .select(*cell, "_inner", "_held", "_cprev", "_head.*")
             .withColumn("_cmark", mark(F.col("_cprev")))
             .withColumn("_held", F.coalesce("_held", F.when(F.col("_cmark"), F.col("_cprev"))))
             .select(*cell, "_cprev", "_cmark",
                     F.coalesce(F.sum(F.col("_inner") + F.col("_cmark").cast("long")).over(before),
                                F.lit(0)).alias("_before"),
                     F.last("_held", ignorenulls=True).over(before).alias("_cheld")))
    rows = inside.join(cells, cell, "left")
    own = F.when(F.col("_first"), F.col("_cmark")).otherwise(F.col("_mark"))
    outs = []
    if flag:
        outs.append(own.alias(flag))
    if count:
        outs.append((F.col("_before") + F.col("_cmark").cast("long") + F.col("_inside")).alias(count))
        rows = rows.withColumn("_inside", F.sum(F.col("_mark").cast("long")).over(upto))
    if carry:
        rows = rows.withColumn("_kept", F.last(F.when(F.col("_mark"), F.col("_prev")), ignorenulls=True).over(upto))
        outs.append(F.coalesce("_kept", F.when(F.col("_cmark"), F.col("_cprev")), "_cheld")["v"].alias(carry))
    return rows.select(*df.columns, *outs)
