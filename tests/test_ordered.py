"""Cell-split ordered calculations against a plain loop, with a hot key and NULLs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mealops.operators.joins import bind_by_position, previous_distinct
from mealops.operators.ordered import _SLOT, _celled, id_slot, minute_slot, ordered, ordered_steps
from mealops.operators.quantiles import exact_quantiles
from mealops.operators.windows import avg_on_hand, rider_month_running, shifts

T0 = dt.datetime(2024, 1, 1, 10)


def rows(seed, n=400):
    """(key, tm, id, v): a third of the rows on key 1, some NULL keys, times and values."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rnd.random() < 0.4 else rnd.choice([2, 3, 4, None])
        tm = None if rnd.random() < 0.05 else T0 + dt.timedelta(seconds=rnd.randrange(900))
        out.append((key, tm, i, None if rnd.random() < 0.1 else rnd.randrange(-5, 9)))
    rnd.shuffle(out)
    return out


def grouped(data):
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(r)
    return {k: sorted(g, key=lambda r: (r[1] is None, r[1] or T0, r[2])) for k, g in groups.items()}


@pytest.mark.parametrize("seed,cell_rows", [(1, None), (2, None), (3, 4), (4, 25)])
def test_running_lag_lead_carry_totals(spark, seed, cell_rows):
    data = rows(seed)
    df = spark.createDataFrame(data, "key int, tm timestamp_ntz, id int, v int").repartition(5)
    v = F.col("v")
    out = ordered(df, ["key"], ["tm", "id"], running={"rank": F.lit(1), "total": v}, lags={"prev": v},
                  leads={"next": v}, carry={"last": v}, totals={"n": F.lit(1)}, peaks={"top": "total"},
                  cell_rows=cell_rows)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(data)
    for g in grouped(data).values():
        run, last, sums = 0, None, np.cumsum([r[3] or 0 for r in g])
        for i, r in enumerate(g):
            run += r[3] or 0
            last = r[3] if r[3] is not None else last
            o = got[r[2]]
            assert (o["rank"], o["total"], o["n"], o["last"]) == (i + 1, run, len(g), last)
            assert o["prev"] == (g[i - 1][3] if i else None)
            assert o["next"] == (g[i + 1][3] if i + 1 < len(g) else None)
            assert o["top"] == max(sums)


@pytest.mark.parametrize("seed,cell_rows", [(4, None), (5, 6)])
def test_steps(spark, seed, cell_rows):
    data = rows(seed)
    df = spark.createDataFrame(data, "key int, tm timestamp_ntz, id int, v int").repartition(5)
    out = ordered_steps(df, ["key"], ["tm", "id"], F.col("v"), lambda prev: F.col("v") - prev > 2, ["v"],
                        flag="flag", count="count", carry="kept", cell_rows=cell_rows)
    got = {r["id"]: r for r in out.collect()}
    for g in grouped(data).values():
        count, kept = 0, None
        for i, r in enumerate(g):
            prev = g[i - 1][3] if i else None
            hit = prev is not None and r[3] is not None and r[3] - prev > 2
            count += hit
            kept = prev if hit else kept
            o = got[r[2]]
            assert (o["flag"], o["count"], o["kept"]) == (hit, count, kept)


@pytest.mark.parametrize("spread", [1, 40])
def test_one_minute_of_one_key_is_cut(spark, spread):
    """9,000 rows of one key at one stamp, or over 40 seconds, beside light cells."""
    data = [(1, T0 + dt.timedelta(seconds=i * 7 % spread), f"{i * 31 % 9000:05d}", i % 11) for i in range(9000)]
    data += [(k, T0 + dt.timedelta(minutes=i), f"x{k}{i}", i) for k in (1, 2, None) for i in range(5)]
    df = spark.createDataFrame(data, "key int, tm timestamp_ntz, id string, v int").repartition(6)
    cells, keys = _celled(df, ["key"], minute_slot("tm"), ["tm", "id"], 200)
    sizes = [r["count"] for r in cells.groupBy(*keys, *_SLOT).count().collect()]
    assert sum(sizes) == len(data) and max(sizes) <= 200 and len(sizes) > 60  # pieces enough for two levels of cuts
    out = ordered(df, ["key"], ["tm", "id"], running={"s": F.col("v")}, lags={"p": F.col("id")}, cell_rows=200)
    got = {(r["key"], r["id"]): (r["s"], r["p"]) for r in out.collect()}
    for key, group in grouped(data).items():
        total, before = 0, None
        for r in group:
            total += r[3]
            assert got[key, r[2]] == (total, before)
            before = r[2]


def test_no_key_and_whole_number_slots(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(7)
    out = ordered(df, [], ["k"], slot=id_slot("k", 100), running={"pos": F.lit(1)})
    assert all(r["pos"] == r["k"] // 7 + 1 for r in out.collect())
    other = spark.range(3).withColumnRenamed("id", "j")
    both = bind_by_position(df, other, "k", "j")
    assert both.count() == df.count()
    assert both.filter("j is not null").orderBy("k").collect() == [(0, 0), (7, 1), (14, 2)]


def test_hot_key_is_split(spark):
    """One key, many minutes: no task of the wide stage holds the whole key."""
    df = spark.range(20000).select(F.lit(1).alias("key"), "id",
                                   (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("tm"))
    out = ordered(df, ["key"], ["tm", "id"], running={"n": F.lit(1)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("n").alias("k"), F.max("n").alias("m"))
        sizes = [r["k"] for r in per.collect()]
        assert len(sizes) > 1 and sum(sizes) == 20000 and max(sizes) < 20000
        assert out.filter(F.col("n") != F.col("id") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_without_a_time_are_split(spark):
    df = spark.range(400000).select(F.lit(1).alias("key"), "id", F.lit(None).cast("timestamp_ntz").alias("tm"))
    out = ordered(df, ["key"], ["tm", "id"], running={"n": F.lit(1)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("n").alias("k"), F.max("n").alias("m")).collect()
        assert sum(r["k"] for r in per) == 400000 and max(r["k"] for r in per) < 400000
        assert out.filter(F.col("n") != F.col("id") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def orders(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        rider = 7 if rnd.random() < 0.4 else rnd.randrange(3)
        read = T0 + dt.timedelta(seconds=rnd.randrange(6 * 3600))
        arrive = read + dt.timedelta(seconds=rnd.randrange(60, 1200))
        finish = arrive + dt.timedelta(seconds=rnd.randrange(-30, 1500))
        out.append((i, rider, rnd.randrange(4), rnd.randrange(3), read, arrive, finish, rnd.randrange(100, 900)))
    return out


SCHEMA = ("id int, rider_id int, user_id int, sup_id int, read_tm timestamp_ntz, arrive_tm timestamp_ntz, "
          "finish_tm timestamp_ntz, rider_income int")


def test_avg_on_hand_equals_overlap(spark):
    data = orders(6)
    got = {r["id"]: r for r in avg_on_hand(spark.createDataFrame(data, SCHEMA)).collect()}
    for r in data:
        a, f = r[5], r[6]
        o = got[r[0]]
        if f <= a:
            assert o["onhand"] is None
            continue
        # an order finished before it arrived takes its span off the rider's load
        area = 0.0
        for s in data:
            if s[1] == r[1]:
                lo, hi, sign = (s[5], s[6], 1) if s[6] >= s[5] else (s[6], s[5], -1)
                area += sign * max(0.0, (min(hi, f) - max(lo, a)).total_seconds())
        assert o["onhandXdur"] == pytest.approx(area / 60)
        assert o["onhand"] == pytest.approx(area / (f - a).total_seconds())


def test_shifts_loop(spark):
    data = orders(7)
    got = {r["id"]: r for r in shifts(spark.createDataFrame(data, SCHEMA), gap_h=0.02).collect()}
    by = {}
    for r in data:
        by.setdefault(r[1], []).append(r)
    for g in by.values():
        g.sort(key=lambda r: (r[4], r[0]))
        n = 0
        for i, r in enumerate(g):
            new = i > 0 and (r[4] - g[i - 1][6]).total_seconds() > 72
            n += new
            assert (got[r[0]]["r_new_shift"], got[r[0]]["r_shift"]) == (new, n)


def test_previous_distinct_loop(spark):
    data = orders(8)
    got = {r["id"]: r for r in previous_distinct(spark.createDataFrame(data, SCHEMA)).collect()}
    for r in data:
        earlier = [s for s in data if s[2] == r[2] and (s[6], s[0]) < (r[6], r[0]) and s[3] != r[3]]
        want = max(earlier, key=lambda s: (s[6], s[0]))[0] if earlier else None
        assert got[r[0]]["alt_id"] == want


def test_rider_month_peak_not_last(spark):
    data = [(1, 5, T0, 400000), (2, 5, T0 + dt.timedelta(hours=1), -200000), (3, 5, T0 + dt.timedelta(days=40), 10)]
    df = spark.createDataFrame(data, "id int, rider_id int, finish_tm timestamp_ntz, rider_income int")
    got = {r["id"]: r for r in rider_month_running(df).collect()}
    assert [got[i]["inc_atm"] for i in (1, 2, 3)] == [400000, 200000, 10]
    assert [got[i]["excel_month"] for i in (1, 2, 3)] == [True, True, False]


def test_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    groups = {"hot": rnd.normal(0, 1e4, 4000), "flat": np.full(500, 7.0), "one": np.array([3.25]),
              "mixed": np.concatenate([rnd.integers(-3, 3, 900), [1e9, -1e9, 0.0]])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("none", None)]
    rnd.shuffle(data)
    df = spark.createDataFrame([(str(a), None if b is None else float(b)) for a, b in data], "g string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p9": 0.9, "p1": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12)
