"""Nearest-neighbour matching with replacement by a partition tree.

Rows with equal covariates are one profile. A k-d tree fitted on a bounded sample of the side
that is searched cuts space into leaves of about ``LEAF`` profiles; every leaf keeps the exact
box of its profiles. A profile visits leaves in the order of their box's distance, first two,
then sixteen times as many each round, and stops where the next box lies farther than the
nearest profile found: what it never visits cannot hold a nearer one, so the result is exact
in any number of columns. Boxes are cut away for whole parts of the tree before they are
ordered per profile. Distances are taken leaf by leaf inside tasks; a leaf that many profiles
visit is dealt to several, and no pair but the nearest of each leaf becomes a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.sinks import stage_shared

LEAF, MAX_LEAVES, PER_LEAF_SAMPLE = 2_000, 1 << 14, 16
VISITORS, CHUNK = 8_192, 1 << 16
_LANES = 1 << 21  # distances laid out at once
_PART = 64  # rows and leaves that are compared without another cut


@dataclass
class Matched:
    """Profiles of both arms (``_id``, blocks, covariates ``_x``, ``_n`` rows, outcome sum ``_sy``
    and population variance ``_vy``), the matches (``_tid``, ``_cid``, ``_dist``), and how many
    distances were taken."""
    treated: DataFrame
    controls: DataFrame
    links: DataFrame
    pairs: int


# --- tree --------------------------------------------------------------------------------

def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, cut) of every inner node in heap order; larger values go right. A node is cut
    at the median of its widest column; nodes of one point send everything left."""
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    held = {0: points}
    for node in range(len(dims)):
        own = held.pop(node, points[:0])
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(1)
        if spread.max(initial=0) > 0:
            dims[node] = int(spread.argmax())
            v = own[:, dims[node]]
            cuts[node] = min(np.median(v), v[v < v.max()].max())
            right = v > cuts[node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return dims, cuts


def leaf_of(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    rows = np.arange(len(points))
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, dims[node]] > cuts[node])
    return node - len(dims)


def _points(column, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, width)


def _box_distance(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(z), len(low)))
    for k in range(z.shape[1]):
        out += np.maximum(np.maximum(low[None, :, k] - z[:, None, k], z[:, None, k] - high[None, :, k]), 0) ** 2
    return np.sqrt(out)


def _near_pairs(z: np.ndarray, c: np.ndarray, tolerance: float, skip: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(i, j, distance) of every pair as near as the nearest of its row, within ``tolerance``; row
    i leaves out the pair with ``skip[i]`` (-1: none). One matrix product finds the pairs that
    can be such, with room for its rounding; theirs alone are measured coordinate by coordinate."""
    middle = c.mean(axis=0)
    zm, cm = z - middle, c - middle
    zz, cc = (zm * zm).sum(axis=1), (cm * cm).sum(axis=1)
    apart = zm @ (-2 * cm.T)
    apart += zz[:, None]
    apart += cc[None, :]
    if skip is not None:
        rows = np.flatnonzero(skip >= 0)
        apart[rows, skip[rows]] = np.inf
    room = 64 * (z.shape[1] + 8) * np.finfo(float).eps * (zz + cc.max())
    least = apart.min(axis=1)
    reach = (np.sqrt(np.maximum(least, 0) + room) + tolerance) ** 2 + room
    i, j = np.nonzero(apart <= np.where(np.isfinite(least), reach, -np.inf)[:, None])
    if not len(i):
        return i, j, np.zeros(0)
    d = np.zeros(len(i))
    for k in range(z.shape[1]):
        d += (z[i, k] - c[j, k]) ** 2
    d = np.sqrt(d)
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    kept = d <= np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(i)])) + tolerance
    return i[kept], j[kept], d[kept]


def _steps(n: int, width: int) -> list[slice]:
    size = max(1, _LANES // max(width, 1))
    return [slice(at, at + size) for at in range(0, n, size)]


# --- search ------------------------------------------------------------------------------

class _Searched:
    """One side, cut into leaves, that profiles look for neighbours in."""

    def __init__(self, side: DataFrame, blocks: list[str], width: int):
        self.blocks, self.width = blocks, width
        n = side.count()
        leaves = 1
        while leaves < MAX_LEAVES and leaves * LEAF < n:
            leaves *= 2
        sample = np.zeros((0, width))
        if leaves > 1:  # at most PER_LEAF_SAMPLE * MAX_LEAVES points
            got = side.select("_z").orderBy(F.xxhash64("_z"), "_id").limit(PER_LEAF_SAMPLE * leaves).toArrow()
            sample = _points(got.column("_z"), width)
        dims, cuts = self.dims, self.cuts = fit_tree(sample, leaves.bit_length() - 1)

        @F.arrow_udf("int")
        def leaf(z: pa.Array) -> pa.Array:
            return pa.array(leaf_of(_points(z, width), dims, cuts).astype(np.int32))

        self.side = stage_shared(side.select(*blocks, "_id", "_z", leaf("_z").alias("_leaf")), "leaves")
        ends = lambda f: F.array(*[f(F.col("_z")[k]) for k in range(width)])
        self.boxes = stage_shared(self.side.groupBy(*blocks, "_leaf").agg(
            ends(F.min).alias("_low"), ends(F.max).alias("_high"), F.count(F.lit(1)).alias("_held")), "boxes")
        self.pairs = 0

    def _visits(self, seekers: DataFrame, n: int, many: int | None, tolerance: float) -> DataFrame:
        """(blocks, _id, _z, _best, _leaf): the next ``many`` leaves by box distance after the
        ``_seen`` that are visited already, where a nearer neighbour can still be (None: all)."""
        chunks = max(1, -(-n // CHUNK))
        keys = [*self.blocks, "_chunk"]
        mine = seekers.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int"))
        boxes = self.boxes.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        width, kept, dims, cuts = self.width, [*self.blocks, "_id", "_z", "_best"], self.dims, self.cuts

        def order(left: pa.Table, right: pa.Table) -> pa.Table:
            z, best = _points(left.column("_z"), width), left.column("_best").to_numpy()
            seen, leaf = left.column("_seen").to_numpy(), right.column("_leaf").to_numpy()
            low, high = _points(right.column("_low"), width), _points(right.column("_high"), width)
            order_of = np.argsort(leaf, kind="stable")  # one order of equal distances in every round
            leaf, low, high = leaf[order_of], low[order_of], high[order_of]
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            at = leaf_of(z, dims, cuts)
            by_place = np.argsort(at, kind="stable")
            todo = [(by_place, np.arange(len(leaf)), 1)] if len(leaf) else []
            while todo:
                own, near, size = todo.pop()
                # leaves that no row of this part can visit go
                least, most = z[own].min(axis=0), z[own].max(axis=0)
                gap = lambda a, b: np.sqrt((np.maximum(np.maximum(low[near] - a, b - high[near]), 0) ** 2).sum(axis=1))  # noqa: E731, B023
                closest, reach = gap(most, least), (best[own].max() * (1 + 1e-12) + tolerance)
                if many is not None and len(near) > (last := int(seen[own].max()) + many):
                    reach = min(reach, np.partition(gap(least, most), last - 1)[last - 1])
                near = near[closest <= reach * (1 + 1e-9)]
                if not len(near):
                    continue
                if len(own) > _PART and len(near) > _PART and size <= len(dims):
                    # a finer cut of the tree the leaves come from
                    size *= 2
                    part = at[own] * size // (len(dims) + 1)
                    todo += [(x, near, size) for x in np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1)]
                    continue
                for step in _steps(len(own), len(near)):
                    some = own[step]
                    away = _box_distance(z[some], low[near], high[near])
                    rank = np.argsort(away, axis=1, kind="stable")
                    sorted_away = np.take_along_axis(away, rank, 1)
                    # a box distance may be off by rounding
                    ok = sorted_away <= best[some, None] * (1 + 1e-12) + tolerance
                    place = np.arange(len(near))[None, :]
                    ok &= place >= seen[some, None]
                    if many is not None:
                        ok &= place < seen[some, None] + many
                    i, j = np.nonzero(ok)
                    rows.append(some[i])
                    to.append(leaf[near[rank[i, j]]])
            rows, to = np.concatenate(rows), np.concatenate(to)
            return left.select(kept).take(pa.array(rows)).append_column("_leaf", pa.array(to, pa.int32()))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seekers.schema.fields if f.name in kept)
        schema = f"{fields}, _leaf int"
        kept = [f.name for f in seekers.schema.fields if f.name in kept]
        found = mine.groupBy(*keys).cogroup(boxes.groupBy(*keys)).applyInArrow(order, schema)
        return stage_shared(found, "visits")

    def _met(self, visits: DataFrame, work, schema: str) -> DataFrame:
        """``work(visitors, profiles)`` for every leaf and share of its visitors."""
        at = [*self.blocks, "_leaf"]
        per = visits.groupBy(*at).agg(F.count(F.lit(1)).alias("_k"))
        per = stage_shared(per.join(self.boxes.select(*at, "_held"), at)
                           .withColumn("_shares", F.ceil(F.col("_k") / VISITORS).cast("int")), "visited")
        self.pairs += per.agg(F.sum(F.col("_k") * F.col("_held"))).first()[0] or 0
        share = F.pmod(F.xxhash64("_id"), F.col("_shares").cast("long")).cast("int")
        mine = visits.join(per.select(*at, "_shares"), at).withColumn("_share", share).drop("_shares")
        theirs = (self.side.join(per.select(*at, "_shares"), at)
                  .withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
                  .select(*at, "_share", F.col("_id").alias("_cid"), F.col("_z").alias("_cz")))
        keys = [*at, "_share"]
        return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(work, schema)

    def nearest(self, seekers: DataFrame, tolerance: float, others: bool = False) -> DataFrame:
        """(_tid, _cid, _dist): every profile as near as the nearest, within ``tolerance``, for the
        staged ``seekers`` (blocks, _id, _z); ``others`` leaves out a seeker's own id. A seeker
        whose block holds no profile has no row."""
        width = self.width

        def least(left: pa.Table, right: pa.Table) -> pa.Table:
            """The nearest of the leaf, or where none is as near as the best known, its distance alone."""
            z, c = _points(left.column("_z"), width), _points(right.column("_cz"), width)
            own, theirs, best = left.column("_id").to_numpy(), right.column("_cid").to_numpy(), left.column("_best").to_numpy()
            skip = None
            if others and len(theirs):
                by_id = np.argsort(theirs)
                spot = by_id[np.minimum(np.searchsorted(theirs, own, sorter=by_id), len(theirs) - 1)]
                skip = np.where(theirs[spot] == own, spot, -1)
            found, nearest = [], np.full(len(z), np.inf)
            for part in _steps(len(z), len(c)) if len(c) else []:
                i, j, d = _near_pairs(z[part], c, tolerance, None if skip is None else skip[part])
                i = i + part.start
                np.minimum.at(nearest, i, d)
                found.append((i, j, d))
            i, j, d = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            good = nearest <= best + tolerance
            good &= np.isfinite(nearest)
            bad, kept = np.flatnonzero(~good), good[i]
            cid = pa.array(np.r_[theirs[j[kept]], np.zeros(len(bad), np.int64)], pa.int64(), mask=np.arange(kept.sum() + len(bad)) >= kept.sum())
            return pa.table({"_tid": pa.array(np.r_[own[i[kept]], own[bad]]), "_cid": cid,
                             "_dist": pa.array(np.r_[d[kept], nearest[bad]])})

        seekers = seekers.select(*self.blocks, "_id", "_z", *(["_best"] if "_best" in seekers.columns else [F.lit(float("inf")).alias("_best")]))
        state, settled, met, many, n = seekers.withColumn("_seen", F.lit(0)), None, None, 2, seekers.count()
        leaves = self.boxes.select("_leaf").distinct().count()
        while n:
            visits = self._visits(state, n, many, tolerance)
            if visits.isEmpty():
                settled = state if settled is None else settled.unionByName(state)
                break
            round_met = stage_shared(self._met(visits, least, "_tid bigint, _cid bigint, _dist double"), "met")
            met = round_met if met is None else met.unionByName(round_met)
            got = round_met.groupBy(F.col("_tid").alias("_id")).agg(F.min("_dist").alias("_new"))
            state = state.join(got, "_id", "left").withColumn("_best", F.least("_best", "_new"))
            # those without a leaf to visit are settled
            after = stage_shared(state.withColumn("_seen", F.col("_seen") + many).withColumn("_open", F.col("_new").isNotNull()).drop("_new"), "nearest")
            done = after.filter(~F.col("_open")).drop("_open")
            settled = done if settled is None else settled.unionByName(done)
            state, n, many = after.filter("_open").drop("_open"), after.filter("_open").count(), many * 16
            if leaves <= after.agg(F.max("_seen")).first()[0]:
                settled = settled.unionByName(state)
                break
        if met is None:
            return seekers.sparkSession.createDataFrame([], "_tid bigint, _cid bigint, _dist double")
        # every leaf that can hold one as near as the nearest was met by then
        best = settled.select(F.col("_id").alias("_tid"), "_best")
        links = met.filter("_cid IS NOT NULL").join(best, "_tid").filter(F.col("_dist") <= F.col("_best") + tolerance)
        return stage_shared(links.select("_tid", "_cid", "_dist"), "matches")


# --- matching ----------------------------------------------------------------------------

def _profiles(df: DataFrame, blocks: list[str], y: str) -> DataFrame:
    """Rows of equal covariates as one, numbered; written, so the numbers stay."""
    v = F.col(y).cast("double")
    per = df.groupBy(*blocks, "_x", "_z").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_sy"), F.var_pop(v).alias("_vy"))
    return stage_shared(per.withColumn("_id", F.monotonically_increasing_id()), "profiles")


def match(df: DataFrame, y: str, treat: str, xs: list[str], weights: dict[str, float] | None = None,
          blocks: list[str] = (), tolerance: float = 1e-9) -> Matched:
    """The nearest control profiles of each treated profile, ties kept, controls reusable.

    Distance is Euclidean over columns divided by their sample deviation, times an optional
    weight per column; ``blocks`` must agree exactly. Rows with a NULL in any of the columns are
    left out. Profiles without a control in their block have no match."""
    xs, blocks, weights = list(xs), list(blocks), weights or {}
    data = df.select(*blocks, F.col(treat).cast("int").alias("_t"), F.col(y), *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    sd = data.agg(F.struct(*[F.stddev_samp(x).alias(x) for x in xs])).scalar()
    z = lambda x: F.coalesce(F.try_divide(F.col(x), F.col(f"_sd.{x}")), F.lit(0.0)) * (float(weights.get(x, 1.0)) ** 0.5)
    rows = data.withColumn("_sd", sd).select(*blocks, "_t", y, F.array(*xs).alias("_x"), F.array(*[z(x) for x in xs]).alias("_z"))
    rows = stage_shared(rows, "covariates")
    treated = _profiles(rows.filter("_t = 1"), blocks, y)
    controls = _profiles(rows.filter("_t = 0"), blocks, y)
    searched = _Searched(controls, blocks, len(xs))
    links = searched.nearest(treated.select(*blocks, "_id", "_z"), tolerance)
    return Matched(treated, controls, links, searched.pairs)


def shares(m: Matched) -> DataFrame:
    """The matches with the treated profile's rows ``_tn``, the control profile's rows and outcome
    sum (``_cn``, ``_csy``) and ``_w``: the share of one control row in one treated row."""
    t = m.treated.select(F.col("_id").alias("_tid"), F.col("_n").alias("_tn"))
    c = m.controls.select(F.col("_id").alias("_cid"), F.col("_n").alias("_cn"), F.col("_sy").alias("_csy"))
    full = m.links.join(t, "_tid").join(c, "_cid")
    tied = full.groupBy("_tid").agg(F.sum("_cn").alias("_all"))
    return full.join(tied, "_tid").withColumn("_w", 1 / F.col("_all")).drop("_all")


def _effects(m: Matched) -> DataFrame:
    """Treated profiles with the mean outcome ``_y0`` and distance of their matches (NULL: none)."""
    met = shares(m).groupBy("_tid").agg((F.sum("_csy") / F.sum("_cn")).alias("_y0"), F.min("_dist").alias("_dist"))
    return m.treated.join(met.withColumnRenamed("_tid", "_id"), "_id", "left")


def att(m: Matched) -> DataFrame:
    """Average effect on the treated, tied neighbours averaged. One row: ``att, matched,
    unmatched, mean_dist``."""
    hit = F.col("_dist").isNotNull()
    n = F.sum(F.when(hit, F.col("_n")))
    return _effects(m).agg(
        (F.sum(F.when(hit, F.col("_sy") - F.col("_n") * F.col("_y0"))) / n).alias("att"), F.coalesce(n, F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(~hit, F.col("_n"))), F.lit(0)).alias("unmatched"),
        (F.sum(F.col("_dist") * F.col("_n")) / n).alias("mean_dist"))


def _uses(m: Matched) -> DataFrame:
    """(_cid, _uses, _squares): sums over treated rows of a control row's share and its square."""
    return shares(m).groupBy("_cid").agg(F.sum(F.col("_tn") * F.col("_w")).alias("_uses"),
                                         F.sum(F.col("_tn") * F.col("_w") * F.col("_w")).alias("_squares"))


def att_error(m: Matched, blocks: list[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """``att, std_error, t_value, matched``: the error of matching with replacement. Treated rows
    add their squared distance from the effect; a control row used more than once adds its
    conditional variance, taken from the nearest other rows of its own arm (ties averaged),
    times the square of its uses less the sum of their squares."""
    blocks = list(blocks)
    effects = stage_shared(_effects(m).filter("_dist IS NOT NULL").select("_n", "_sy", "_vy", "_y0"), "effects")
    one = effects.agg(F.sum("_n").alias("n"), (F.sum(F.col("_sy") - F.col("_n") * F.col("_y0")) / F.sum("_n")).alias("att"))
    gap = F.col("_sy") / F.col("_n") - F.col("_y0") - F.col("_one.att")
    within = effects.withColumn("_one", one.select(F.struct("n", "att")).scalar()).agg(
        F.sum(F.col("_n") * (F.col("_vy") + gap * gap)).alias("v"), F.max("_one.n").alias("n"), F.max("_one.att").alias("att"))
    used = m.controls.join(_uses(m).withColumnRenamed("_cid", "_id"), "_id")
    used = used.withColumn("_f", F.col("_uses") * F.col("_uses") - F.col("_squares")).filter("_f > 1e-12")
    # copies are neighbours at distance 0
    used = stage_shared(used.withColumn("_best", F.when(F.col("_n") > 1, 0.0).otherwise(float("inf"))), "used")
    width = len(m.controls.select("_z").first()[0]) if not m.controls.isEmpty() else 1
    near = _Searched(m.controls, blocks, width).nearest(used.select(*blocks, "_id", "_z", "_best"), tolerance, others=True)
    c = m.controls.select(F.col("_id").alias("_cid"), F.col("_n").alias("_cn"), F.col("_sy").alias("_csy"))
    near = near.join(c, "_cid").groupBy(F.col("_tid").alias("_id")).agg(F.sum("_cn").alias("_ln"), F.sum("_csy").alias("_ls"))
    own = F.when(F.col("_n") > 1, 1).otherwise(0)
    rows = (used.join(near, "_id", "left").na.fill(0, ["_ln", "_ls"])
            .withColumn("_near", own * (F.col("_n") - 1) + F.col("_ln")).withColumn("_sum", own * F.col("_sy") + F.col("_ls")).filter("_near > 0"))
    # of each row: its outcome less the mean of its N neighbours, the sum A - own of which is theirs
    k, mean = F.col("_near") + own, F.col("_sy") / F.col("_n")
    squares = F.col("_n") * (k * k * F.col("_vy") + F.pow(k * mean - F.col("_sum"), 2)) / (F.col("_near") * F.col("_near"))
    between = rows.agg(F.coalesce(F.sum(F.col("_f") * squares * F.col("_near") / (F.col("_near") + 1)), F.lit(0.0)).alias("v"))
    se = F.sqrt(F.col("v") + between.scalar()) / F.col("n")
    return within.select("att", se.alias("std_error"), F.try_divide(F.col("att"), se).alias("t_value"), F.col("n").alias("matched"))


def matched_rows(m: Matched, xs: list[str]) -> DataFrame:
    """(``_t``, covariates, ``_weight``): matched treated profiles by their rows and used control
    profiles by their rows times uses, for :func:`causal.balance`."""
    treated = m.treated.join(m.links.select(F.col("_tid").alias("_id")).distinct(), "_id", "left_semi").select(
        F.lit(1).alias("_t"), "_x", F.col("_n").cast("double").alias("_weight"))
    controls = m.controls.join(_uses(m).withColumnRenamed("_cid", "_id"), "_id").select(
        F.lit(0).alias("_t"), "_x", (F.col("_uses") * F.col("_n")).alias("_weight"))
    value = lambda i, x: F.col("_x")[i].alias(x)
    return treated.unionAll(controls).select("_t", *[value(i, x) for i, x in enumerate(xs)], "_weight")


def all_rows(m: Matched, xs: list[str]) -> DataFrame:
    """The same for both arms before matching."""
    sides = [side.select(F.lit(t).alias("_t"), *[F.col("_x")[i].alias(x) for i, x in enumerate(xs)], F.col("_n").cast("double").alias("_weight"))
             for t, side in ((1, m.treated), (0, m.controls))]
    return sides[0].unionAll(sides[1])
