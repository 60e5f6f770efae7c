"""Small hand-written rows for the rules that are easy to get wrong."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mealops.functions import numeric as num
from mealops.functions import timing as tm
from mealops.functions import weather as wx
from mealops.operators import aggregates as agg
from mealops.operators import filters as flt
from mealops.operators import joins as jn
from mealops.operators import ranking as rk
from mealops.operators import windows as win
from mealops.operators.choice import choice_set
from mealops.operators.enrich import enrich_by_key, enrich_resumable, fetch_missing, fetch_resumable, lookup_ledger
from mealops.plans.choices import store_choices
from mealops.sources.readers import append_frames


def col(df, c):
    return [r[c] for r in df.collect()]


def test_null_keys_match_null_keys(make):
    a = make("k int, tel string, id int", [(1, None, 1), (1, "x", 2), (None, None, 3)])
    b = make("k int, tel string, name string", [(1, None, "A"), (None, None, "N")])
    safe = {r["id"]: r["name"] for r in jn.left_lookup(a, b, ["k", "tel"], null_safe=True).collect()}
    assert safe == {1: "A", 2: None, 3: "N"}
    plain = {r["id"]: r["name"] for r in jn.left_lookup(a, b, ["k", "tel"]).collect()}
    assert plain == {1: None, 2: None, 3: None}


def test_salted_lookup_equals_plain(make):
    a = make("k int, id int", [(i % 2, i) for i in range(50)])
    b = make("k int, name string", [(0, "zero")])
    plain = sorted(jn.left_lookup(a, b, "k").collect())
    assert sorted(jn.left_lookup(a, b, "k", salt=4).collect(), key=str) == sorted(plain, key=str)


def test_slot_at_midnight(make):
    df = make("t timestamp_ntz", [("2024-01-31 23:50:00",), ("2024-01-31 23:44:00",), (None,), ("2024-01-31 09:14:59",)])
    date, slot = tm.rolled_slot("t")
    got = [tuple(map(str, r)) for r in df.select(tm.half_hour_slot("t"), slot, date).collect()]
    assert got == [("24.0", "0.0", "2024-02-01"), ("23.5", "23.5", "2024-01-31"), ("None",) * 3, ("9.0", "9.0", "2024-01-31")]


def test_ratio_without_riders_is_null_and_filtered(make):
    df = make("order_n int, avai_n30 int", [(4, 0), (4, 2), (9, 3)])
    df = df.withColumn("ow_ratio", num.safe_ratio("order_n", "avai_n30"))
    assert col(df, "ow_ratio") == [None, 2.0, 3.0]
    assert flt.analysis_sample(df, {"ow_ratio": (None, 3, False, False)}).count() == 1


def test_strict_min_max_and_censor(make):
    df = make("a double, b double", [(1.0, None), (3.0, 2.0), (-4.0, 9.0)])
    got = df.select(num.pmin_strict("a", "b"), num.pmax_strict("a", "b"), num.censor("b"), num.censor("a")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, 1.0), (2.0, 3.0, 2.0, 3.0), (-4.0, 9.0, 9.0, 0.0)]


def test_rain_elapsed_uses_own_episode(make):
    df = make("place timestamp_ntz, start timestamp_ntz",
              [("2024-01-02 05:00:00", "2024-01-01 23:00:00"), ("2024-01-02 07:00:00", "2024-01-01 23:00:00"),
               ("2024-01-02 07:00:00", None)])
    dur, rdur = tm.rain_elapsed("place", "start")
    assert [tuple(r) for r in df.select(dur, rdur).collect()] == [(6.0, 6.0), (8.0, 1.0), (None, None)]


def test_mean_and_sd_skip_nulls(make):
    df = make("user_id int, price int, rider_income int, place_tm timestamp_ntz, require_tm timestamp_ntz, finish_tm timestamp_ntz",
              [(1, 10, None, "2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 12:10:00"),
               (1, 20, 6, "2024-01-02 10:00:00", "2024-01-02 12:00:00", "2024-01-02 11:50:00"),
               (2, 5, 1, "2024-01-02 10:00:00", "2024-01-02 19:00:00", "2024-01-02 19:00:00")])
    got = {r["user_id"]: r for r in agg.user_profile(df).collect()}
    assert (got[1]["u_rinc_avg"], got[1]["u_delay_avg"], got[1]["u_lunch_avg"]) == (6.0, 0.0, True)
    assert got[2]["u_price_sd"] is None and got[2]["u_span"] == 0.0 and got[2]["u_lunch_avg"] is False


def test_best_match_modes_and_ties(make):
    df = make("sup_id int, from_tel string, from_addr string, from_addr_xms string, adist_long double, match_rule int",
              [(1, None, "a", "p", 0.5, 1), (1, None, "a", "q", 0.2, 0), (1, None, "a", "r", 0.9, 1), (2, "t", "b", "s", None, 1)])
    assert sorted(col(rk.best_match(df), "from_addr_xms")) == ["q", "s"]
    assert sorted(col(rk.best_match(df, mode="as_written"), "from_addr_xms")) == ["p", "r", "s"]


def test_keep_first_null_order_last(make):
    df = make("k int, o int, v string", [(1, None, "x"), (1, 2, "y"), (1, 1, "z"), (None, None, "n")])
    assert sorted(col(rk.keep_first(df, ["k"], ["o", "v"]), "v")) == ["n", "z"]


def test_codes_as_text_and_missing(make):
    df = make("mw string, mw1 string", [("05", None), ("80", "xx"), (None, None), ("61", "10")])
    flags = wx.weather_flags("mw", "mw1")
    got = df.select(flags["haze"], flags["shower"], flags["precipitating"], flags["rain_sl_cnt"], flags["mist"]).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False, False), (False, True, True, False, False),
                                       (False,) * 5, (False, False, True, True, True)]


def test_two_readings_in_a_slot(make):
    orders = make("id int, d date, s double", [(1, "2024-01-01", 9.0)])
    w = make("station int, tm timestamp_ntz, temp int", [(1, "2024-01-01 09:00:00", 5), (1, "2024-01-01 09:10:00", 6)])
    one = jn.join_slot_weather(orders, w, {"hq": 1}, {"p": ("d", "s")})
    assert [(r["id"], r["temp_hqp"]) for r in one.collect()] == [(1, 6)]
    w2 = w.withColumn("tm", F.lit("2024-01-01 09:00:00").cast("timestamp_ntz"))
    assert jn.join_slot_weather(orders, w2, {"hq": 1}, {"p": ("d", "s")}, dedupe=False).count() == 2


def test_tied_event_arrive_before_finish(make):
    df = make("id int, rider_id int, arrive_tm timestamp_ntz, finish_tm timestamp_ntz",
              [(1, 1, "2024-01-01 10:00:00", "2024-01-01 10:10:00"), (2, 1, "2024-01-01 10:10:00", "2024-01-01 10:20:00"),
               (3, 1, None, "2024-01-01 10:15:00")])
    got = [(r["action"], r["id"], r["onhand"]) for r in win.on_hand(df).orderBy("tm", "action", "id").collect()]
    assert got == [("arrive_tm", 1, 1), ("arrive_tm", 2, 2), ("finish_tm", 1, 1), ("finish_tm", 2, 0)]
    total = win.on_hand(df).groupBy("rider_id").agg(F.sum("delta").alias("s")).collect()
    assert total[0]["s"] == 0


def test_daypart_and_flags_for_null(make):
    df = make("slot double, x double", [(None, None), (11.5, 20.0), (20.5, 19.9), (21.0, 0.0)])
    got = [tuple(r) for r in df.select(tm.daypart("slot"), num.threshold_flag("x", 20)).collect()]
    assert got == [("other", None), ("lunch", 1), ("dinner", 0), ("other", 0)]


def test_dead_zone_edges(make):
    df = make("d double", [(-15.0,), (-14.9,), (-5.0,), (0.0,), (None,)])
    assert col(df.select(num.dead_zone("d").alias("z")), "z") == [-5.0, 0.0, 5.0, 10.0, None]


def test_celsius_half_even_and_buckets(make):
    df = make("f double", [(36.5,), (45.5,), (None,)])
    assert col(df.select(num.f_to_c("f").alias("c")), "c") == [2.0, 8.0, None]
    assert col(make("x double", [(-1.0,), (9.99,)]).select(num.floor_bucket("x", 5).alias("b")), "b") == [-5, 5]


def test_histogram_edges(make):
    df = make("x double", [(-2.5,), (2.5,), (2.6,), (0.0,), (None,)])
    got = {r["bin"]: (r["n"], r["density"]) for r in agg.histogram(df, "x", 5, density=True).collect()}
    assert got == {-5.0: (1, 0.05), 0.0: (2, 0.1), 5.0: (1, 0.05)}


def test_ticks_equal_theta_join(make):
    rows = [("2024-01-01", "2024-01-01 09:30:00", "2024-01-01 10:06:00"), ("2024-01-01", "2024-01-01 09:29:59", "2024-01-01 10:05:00"),
            ("2024-01-01", "2024-01-01 22:00:00", "2024-01-02 01:00:00"), ("2024-01-02", "2024-01-02 12:01:00", "2024-01-02 12:02:00")]
    shifts = make("read_date date, begin timestamp_ntz, end timestamp_ntz", rows)
    got = {(str(r["tm"])): r["avai_n30"] for r in jn.active_at_ticks(shifts).collect()}
    assert len(got) == 54
    for t, n in got.items():
        t = pd.Timestamp(t)
        want = sum(pd.Timestamp(d).date() == t.date() and pd.Timestamp(b) < t and t + pd.Timedelta(minutes=5) < pd.Timestamp(e)
                   for d, b, e in rows)
        assert n == want


def test_choice_set_needs_both_sides(make):
    a = make("id int, s int, taste double", [(1, 1, 5.0), (2, 2, None), (3, 3, 1.0)])
    b = make("id int, s int, taste double", [(1, 9, 4.0), (2, 8, 3.0)])
    got = sorted((r["id"], r["s"], r["chosen"]) for r in choice_set(a, b, ["taste"]).collect())
    assert got == [(1, 1, 1), (1, 9, 0)]


def test_single_store_user_has_no_alternative(make):
    o = make("id int, user_id int, sup_id int, from_tel string, from_addr string, price int, rider_income int, place_tm timestamp_ntz, finish_tm timestamp_ntz",
             [(i, 1, 5, None, "r", 10, 1, f"2024-01-0{i} 10:00:00", f"2024-01-0{i} 11:00:00") for i in (1, 2, 3)])
    assert col(jn.previous_distinct(o), "alt_id") == [None] * 3
    # two master rows of the store would make two chosen rows, but no alternative
    stores = make("sup_id int, from_tel string, from_addr string, name string, taste double, envir double, service double, avgexp_lo double, avgexp_up double, tag1 string",
                  [(5, None, "r", "S", 1.0, 1.0, 1.0, 1.0, 2.0, "t"), (5, None, "r", "S", 2.0, 1.0, 1.0, 1.0, 2.0, "t")])
    assert store_choices(o, stores).count() == 0


def test_choice_conflict_counts_missing_side_as_zero(make):
    df = make("id int, chosen int, u double", [(1, 1, -2.0), (2, 1, 1.0), (2, 0, 3.0)])
    assert sorted(r["id"] for r in agg.choice_conflicts(df, "id", "chosen", "u").collect()) == [1, 2]


def test_append_modes(make):
    a, b = make("x int, y int", [(1, 2)]), make("y int", [(3,)])
    assert sorted(append_frames(a, b).collect(), key=str) == [(1, 2), (None, 3)]
    with pytest.raises(Exception):
        append_frames(a, b, strict=True).collect()


def test_pick_ranges_and_rename(make):
    df = make("a int, b int, c_tm int, d int", [(1, 2, 3, 4)])
    assert flt.pick(df, ["b:d"], drop=["d"]).columns == ["b", "c_tm"]
    assert flt.pick(df, ["a"], suffix="_tm").columns == ["a", "c_tm"]
    assert flt.rename_block(df, {"a": "z"}, "_q", ["z", "b"]).columns == ["z_q", "b_q", "c_tm", "d"]


def test_samples_are_repeatable(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 20)
    one = sorted(col(flt.sample_rows(df, 50, 7), "id"))
    assert one == sorted(col(flt.sample_rows(df.repartition(9), 50, 7), "id")) and len(set(one)) == 50
    assert one != sorted(col(flt.sample_rows(df, 50, 8), "id"))
    rows = flt.sample_entities(df, "g", 3, 1)
    assert rows.count() == 150 and rows.select("g").distinct().count() == 3


def test_regimes_count_flips(make):
    flags = [False, False, True, True, False, True]
    df = make("s int, tm timestamp_ntz, wet boolean", [(0, f"2024-01-01 0{i}:00:00", f) for i, f in enumerate(flags)])
    out = win.episode_start(win.regimes(df, "s", "tm", "wet", "r"), "s", "tm", "r", "wet", "begin").orderBy("tm")
    assert col(out, "r") == [1, 1, 2, 2, 3, 4]
    assert [None if b is None else b.hour for b in col(out, "begin")] == [None, None, 2, 2, None, 5]


def test_gap_to_next_and_prior_purchases(make):
    df = make("id int, rider_id int, user_id int, sup_id int, finish_tm timestamp_ntz",
              [(1, 1, 1, 1, "2024-01-01 10:00:00"), (2, 1, 1, 1, "2024-01-01 10:30:00"), (3, 1, 1, 2, "2024-01-01 15:00:00")])
    assert [(r["id"], r["next_gap"]) for r in win.gap_to_next(df).collect()] == [(1, 1800)]
    got = {r["id"]: (r["ss"], r["ss_b4"]) for r in win.prior_purchases(df).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 0)}


def test_enrichment_failures_cache_and_nulls(make, tmp_path):
    log = str(tmp_path / "calls")
    df = make("id int, k string", [(1, "a"), (2, "b"), (3, "bad"), (4, None), (5, "a"), (6, "known")])
    result = T.StructType([T.StructField("n", T.LongType())])

    def fetch(batch):
        if (batch["k"] == "bad").any():
            raise RuntimeError("no answer")
        with open(log, "a") as f:
            f.writelines(k + "\n" for k in batch["k"])
        return pd.DataFrame({"n": batch["k"].str.len()})

    cache = make("k string, n bigint", [("known", 99)])
    out = enrich_by_key(df, ["k"], fetch, result, cache=cache, max_parallel=1)
    assert sorted((r["id"], r["n"]) for r in out.collect()) == [(1, 1), (2, 1), (3, None), (4, None), (5, 1), (6, 99)]
    assert sorted(open(log).read().split()) == ["a", "b"]
    assert fetch_missing(df, ["k"], fetch, result, cache=cache).count() == 3


def test_a_broken_lookup_repeats_no_finished_batch(make, spark, tmp_path):
    store, calls, broken = str(tmp_path / "store"), str(tmp_path / "calls"), tmp_path / "broken"
    result = T.StructType([T.StructField("n", T.LongType())])
    df = make("id int, k string", [(i, f"key{i % 60}") for i in range(120)] + [(200, None), (201, "bad")])

    def fetch(batch):
        if broken.exists() and len(batch) > 1 and len(open(calls).read().split()) > 20:
            import os
            os._exit(1)  # the worker is lost, not just one answer
        if (batch["k"] == "bad").any():
            raise RuntimeError("no such road")
        with open(calls, "a") as f:
            f.writelines(k + "\n" for k in batch["k"])
        return pd.DataFrame({"n": batch["k"].str[3:].astype("int64")})

    open(calls, "w").close()
    broken.touch()
    with pytest.raises(Exception):
        fetch_resumable(df, ["k"], fetch, result, store, batches=6, max_parallel=1)
    before = open(calls).read().split()
    finished = lookup_ledger(spark, store).agg(F.sum("asked"), F.sum("failed")).first()
    assert finished[0] - finished[1] == len(before) and 20 < len(before) < 60
    broken.unlink()
    out = enrich_resumable(df, ["k"], fetch, result, store, batches=6, max_parallel=1).collect()
    asked = open(calls).read().split()
    assert sorted(asked) == sorted(f"key{i}" for i in range(60))  # each key once over both runs
    got = {r["id"]: (r["n"], r["error"]) for r in out}
    assert len(out) == 122 and got[7] == (7, None) and got[67] == (7, None)
    assert got[200] == (None, None) and got[201] == (None, "RuntimeError: no such road")

    def mended(batch):
        return pd.DataFrame({"n": [-1] * len(batch)})

    again = fetch_resumable(df, ["k"], mended, result, store).filter("k = 'bad'").first()
    assert (again["n"], again["error"]) == (None, "RuntimeError: no such road")
    again = fetch_resumable(df, ["k"], mended, result, store, retry_failed=True).collect()
    assert {r["k"]: r["n"] for r in again} == {**{f"key{i}": i for i in range(60)}, "bad": -1} and len(again) == 61
    assert fetch_resumable(df.limit(0), ["k"], mended, result, store).collect() == []


def test_leave_one_out_and_market_share(make):
    df = make("m string, n int", [("a", 1), ("a", 2), ("b", 7)])
    assert sorted(col(agg.leave_one_out_sum(df, ["n"], ["m"]), "oth_n")) == [0, 1, 2]
    assert sorted(col(agg.leave_one_out_sum(df, ["n"]), "oth_n")) == [3, 8, 9]
    assert sum(col(win.market_share(df), "shares")) == pytest.approx(1)


def test_percentile_positions_equal_rank(make):
    df = make("id int, t timestamp_ntz", [(i, f"2024-01-0{1 + i % 3} 11:00:{i % 7:02d}") for i in range(30)])
    pdf = df.toPandas()
    secs = pdf["t"].dt.second
    want = dict(zip(pdf["id"], secs.rank(method="min") / 30))
    out = win.time_of_day_percentile(df, "t").collect()
    assert {r["id"]: r["place_pct"] for r in out} == pytest.approx(want)
    assert out[0]["place_med"] == 39600 + secs.median()
    near = win.around_median(win.seconds_distribution(df, "t"), earlier_s=1)
    assert sorted(col(near, "place_sec")) == [39602, 39603]


def test_failing_keys_are_found_by_halves_over_several_tasks(spark, tmp_path):
    log = str(tmp_path / "calls")
    open(log, "w").close()
    df = spark.range(4000).select(F.col("id").alias("k"))

    def fetch(batch):
        import os
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {len(batch)}\n")
        if (batch["k"] % 1000 == 77).any():
            raise LookupError("none")
        return pd.DataFrame({"n": batch["k"] + 2 ** 60})

    result = T.StructType([T.StructField("n", T.LongType())])
    got = {r["k"]: (r["n"], r["error"]) for r in fetch_resumable(df, ["k"], fetch, result, str(tmp_path / "store"), batches=1).collect()}
    bad = {77, 1077, 2077, 3077}
    assert got == {k: (None, "LookupError: none") if k in bad else (k + 2 ** 60, None) for k in range(4000)}
    calls = open(log).read().splitlines()
    assert len(calls) < 200 and max(int(c.split()[1]) for c in calls) < 4000


def test_trend_without_spread(make):
    """One row, or rows of one ``x``, have no slope: NaN, as DuckDB's regr_slope has it."""
    df = make("g int, x double, y double", [(1, 2.0, 1.0), (2, 2.0, 1.0), (2, 2.0, 3.0), (3, 2.0, None), (4, 1.0, 1.0), (4, 2.0, 3.0)])
    got = {r["g"]: (str(r["slope"]), r["intercept"], r["n"]) for r in agg.trend(df, "x", "y", ["g"]).collect()}
    assert got == {1: ("nan", None, 1), 2: ("nan", None, 2), 3: ("None", None, 0), 4: ("2.0", -1.0, 2)}
