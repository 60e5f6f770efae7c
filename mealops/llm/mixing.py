"""Mixing sources to target weights: weighted fair queueing.

Each source queues its documents in shuffled order, and then once more for the repeats. With a
source's target as its weight, a document's virtual finish time is the source's words up to
and including it divided by the target. All queues are merged by finish time and the merged
queue is cut at the total budget. Where a document crosses its source's target it is split
there, so that the cut falls on the targets and no source is a long document off.

Targets: the budget is ``BUDGET`` times all words, shared by weight; no source gets more than
``REPEATS`` times its words, and what is over is shared anew among the others. With sources
ordered by (limit / weight) that is one running sum.

No window holds a whole source or the whole queue: documents are cut into cells of the shuffle
hash and of virtual time, cells are summed, and offsets of cells come back by join.

Defined results: a NULL or empty text has no words and is taken 0 times; a NULL source is a
source of its own, last in order; repeated rows are documents of their own; without words all
targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_totals
from ..sources.sinks import stage_shared
from .common import WORD

WEIGHTS = (5, 2, 1)
BUDGET, REPEATS = 1.5, 2
_ROWS_A_CELL = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
                   repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(per, [F.col("source").asc_nulls_last()], {}, number="_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight.cast("long")).withColumn("_limit", F.col("source_size") * repeats)
    ranked = stage_shared(ranked.withColumn("_fills", F.col("_limit") / F.col("_w")), "sources")
    totals = ranked.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w"))
    # level at which each source fills up, and what all take at that level
    run = running_totals(ranked, [F.col("_fills"), F.col("source").asc_nulls_last()],
                         {"_limits": F.col("_limit"), "_ws": F.col("_w")})
    run = stage_shared(run.withColumn("_t", totals.select(F.struct("s", "w")).scalar()), "levels")
    goal = F.col("_t.s") * F.lit(budget)
    full = F.col("_limits") + F.col("_fills") * (F.col("_t.w") - F.col("_ws")) <= goal
    open_w = F.col("_t.w") - F.coalesce(F.max(F.when(full, F.col("_ws"))), F.lit(0))
    level = run.groupBy("_t").agg(
        F.when(open_w > 0, (goal - F.coalesce(F.max(F.when(full, F.col("_limits"))), F.lit(0))) / open_w).alias("level"))
    run = run.withColumn("_level", level.select("level").scalar())
    by_weight = F.col("_level") * F.col("_w")
    return run.select("source", "source_size", F.when(full | by_weight.isNull(), F.col("_limit").cast("double"))
                      .otherwise(F.least(by_weight, F.col("_limit").cast("double"))).alias("target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
        repeats: int = REPEATS, seed: str = "mix-") -> DataFrame:
    """(doc_id, fingerprint, source, size, source_size, target, taken) for every row."""
    text = F.coalesce("text", F.lit(""))
    base = stage_shared(docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("fingerprint"), shuffle_key(F.col("doc_id"), seed).alias("_key")), "sizes")
    targets = stage_shared(source_targets(base.select("source", "size"), weights, budget, repeats), "targets")

    # place of every document in its source's queue: cells of the shuffle hash, then inside
    cells = max(1, base.count() // _ROWS_A_CELL)
    cell = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32))
    base = base.withColumn("_cell", cell)
    sums = base.groupBy("source", "_cell").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_src"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    starts = starts.join(targets.withColumnRenamed("source", "_ts"), F.col("_src").eqNullSafe(F.col("_ts"))).drop("_ts")
    inside = Window.partitionBy("source", "_cell").orderBy("_key", "doc_id", "size", "fingerprint")
    queued = (base.withColumn("_i", F.row_number().over(inside))
              .withColumn("_sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .join(starts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_cell") == F.col("_c")))
              .withColumn("_from", F.col("_before") + F.col("_sum") - F.col("size")).drop("_src", "_c", "_before", "_sum"))
    queued = stage_shared(queued, "queue")

    # one entry per copy, split where it crosses the target
    entry = queued.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    entry = entry.withColumn("_from", F.col("_from") + F.col("_turn") * F.col("source_size"))
    whole = F.floor(F.col("target"))
    first = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("_from")))
    entry = entry.withColumn("_part", F.explode(F.array(
        F.struct(first.alias("words"), (F.col("_from") + first).alias("end")),
        F.struct((F.col("size") - first).alias("words"), (F.col("_from") + F.col("size")).alias("end")))))
    entry = entry.filter("_part.words > 0").withColumn("_finish", F.try_divide("_part.end", "target"))
    entry = entry.filter(F.col("_finish").isNotNull())
    # merged by finish time: slices of virtual time hold about equal shares, for queues are
    # shuffled; they go on as far as the queues do, and those behind the budget take nothing
    slices = max(16, 4 * cells)
    entry = entry.withColumn("_slice", F.floor(F.col("_finish") * slices))
    per = entry.groupBy("_slice").agg(F.sum("_part.words").alias("_s"))
    offsets = running_totals(per, [F.col("_slice")], {"_upto": F.col("_s")}).select("_slice", (F.col("_upto") - F.col("_s")).alias("_before"))
    total = targets.agg(F.sum(F.floor("target")).alias("b"))
    offsets = offsets.withColumn("_budget", total.scalar()).filter("_before < _budget")
    line = Window.partitionBy("_slice").orderBy("_finish", F.col("source").asc_nulls_last(), "_key", "doc_id", "_from")
    merged = entry.join(offsets, "_slice").withColumn("_run", F.sum("_part.words").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    got = F.greatest(F.lit(0), F.least(F.col("_part.words"), F.col("_budget") - F.col("_before") - F.col("_run") + F.col("_part.words")))
    place = ["source", "_cell", "_i"]
    taken = merged.groupBy(*place).agg(F.sum(got).alias("taken"))
    taken = taken.select(F.col("source").alias("_src"), F.col("_cell").alias("_c"), F.col("_i").alias("_j"), "taken")
    return (queued.join(taken, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_cell") == F.col("_c")) & (F.col("_i") == F.col("_j")), "left")
            .select("doc_id", "fingerprint", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as the nearest whole number
    to words taken over words. Ids are unique here but for NULL; rows equal in id and text
    are taken alike."""
    share = (mix(docs, **how).filter("size > 0")
             .select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp"),
                     F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies"))
             .groupBy("_id", "_fp").agg(F.max("_copies").alias("_copies")).filter("_copies > 0"))
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"))
    out = row.join(share, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_fp")))
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


ORACLE = r"""WITH b AS (SELECT doc_id, source, md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM b GROUP BY source),
  r AS (SELECT *, source_size * 2 AS lim, source_size * 2 / w::DOUBLE AS fills,
    sum(source_size * 2) OVER o AS lims, sum(w) OVER o AS ws, sum(source_size) OVER () AS st, sum(w) OVER () AS wt
    FROM s WINDOW o AS (ORDER BY source_size * 2 / w::DOUBLE, source NULLS LAST)),
  f AS (SELECT *, lims::DOUBLE + fills * (wt - ws)::DOUBLE <= st::DOUBLE * 1.5e0 AS is_full FROM r),
  l AS (SELECT (any_value(st)::DOUBLE * 1.5e0 - coalesce(max(CASE WHEN is_full THEN lims END), 0)::DOUBLE)
    / nullif(any_value(wt) - coalesce(max(CASE WHEN is_full THEN ws END), 0), 0)::DOUBLE AS level FROM f),
  t AS (SELECT source, source_size, CASE WHEN is_full OR level IS NULL THEN lim::DOUBLE
    ELSE least(level * w, lim::DOUBLE) END AS target FROM f, l),
  q AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) - b.size AS pos
    FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - pos)) + greatest(0, least(size, floor(target) - source_size - pos)) AS BIGINT) AS taken FROM q"""
