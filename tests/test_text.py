"""Chinese text rules."""

from __future__ import annotations


from mealops.functions import text as tx
from mealops.functions import timing as tm
from mealops.functions import weather as wx
from mealops.plans import restaurants as rs


def test_addresses(make):
    df = make("a string", [("南京路3楼",), ("天山路88号（A座)",), ("浦电路(B1",), ("长宁区天山路88号3号楼1502室",),
                           ("12一楼",), ("大厦B-2楼",), (None,), ("a(b(c",)])
    address, extra = tx.normalise_address("a")
    assert [tuple(r) for r in df.select(address, extra).collect()] == [
        ("南京路", None), ("天山路88号", "A座)"), ("浦电路", "B1"), ("长宁区天山路88号3号楼1502室", None),
        ("12", None), ("大厦", None), (None, None), ("a", "b")]


def test_phones(make):
    df = make("p string", [("021-5555转12, 13800000000",), ("021-1 021-2",), ("—13",), (None,), ("1,2转3,店77号",), ("1,2,021-3",)])
    got = [tuple(r) for r in tx.split_phones(df, "p").select("tel1", "int1", "tel2", "int2", "tel3").collect()]
    assert got == [("021-5555", "12", "", None, "13800000000"), ("021-1", None, "021-2", None, None),
                   ("", None, "13", None, None), (None,) * 5, ("1", None, "2", "3", "77"), ("1", None, "2", None, "021-3")]


BLOCK = "店\n{}标签:\n中餐\nx\n上海路1号\ny\n¥20-35\n口味:8.1\n环境:7\n服务:6.5\nz\n好\n多行\n尾"


def test_detail_blocks(make):
    df = make("id int, details string", [(1, BLOCK.format("详情\n")), (2, BLOCK.format("")), (3, "店\n无"), (4, None)])
    got = {r["id"]: r for r in tx.parse_details(df).collect()}
    assert sorted(got) == [1, 2]
    for r in got.values():
        assert (r["name"], r["tags"], r["from_addr_xms"], r["avgexp_lo"], r["avgexp_up"]) == ("店", "中餐", "上海路1号", 20.0, 35.0)
        assert (r["taste"], r["envir"], r["service"], r["comment"], r["remarks"]) == (8.1, 7.0, 6.5, "好", "多行\n尾")


def test_edit_distance_counts_characters(make):
    df = make("a string, b string", [("上海路1号", "上海路2号"), ("上海", "北京路"), ("", "路"), (None, "x")])
    long, short = tx.norm_edit_distance("a", "b")
    got = [tuple(r) for r in df.select(long, short, tx.match_rule(long, short)).collect()]
    assert got == [(0.2, 0.2, 1), (1.0, 1.5, 0), (1.0, None, 1), (None, None, 1)]


def test_daily_weather_row(make):
    df = make("d string, w string, t string", [("2015年07月01日", "多云 /小雨", "30℃ / 25℃"), ("bad", "小雨 /中雪", "x / 1℃")])
    df = tx.split_to(df, "w", ["day", "night"], pattern=" /")
    df = tx.split_to(df, "t", ["hi", "lo"], pattern=" / ")
    got = df.select(tm.parse_cn_date("d").cast("string"), tx.strip_label("hi", "℃").try_cast("double"),
                    tx.strip_label("lo", "℃").try_cast("double"), wx.condition_flag("day", wx.DAY_RAIN_TERMS),
                    wx.condition_flag("night", wx.NIGHT_RAIN_TERMS)).collect()
    assert [tuple(r) for r in got] == [("2015-07-01", 30.0, 25.0, False, True), (None, None, 1.0, True, True)]


def test_split_positions_and_stamps(make):
    df = make("s string", [("201507010930",), ("2015",), (None,)])
    got = tx.split_to(df, "s", ["y", "m", "d", "h", "n"], positions=[4, 6, 8, 10]).collect()
    assert [tuple(r)[1:] for r in got] == [("2015", "07", "01", "09", "30"), ("2015", None, None, None, None), (None,) * 5]
    assert [str(r[0]) for r in df.select(tm.parse_stamp("s")).collect()] == ["2015-07-01 09:30:00", "None", "None"]


def test_coordinates(make):
    df = make("c string", [("31.05,121.3",), ("x,1",), (None,)])
    got = tx.split_coords(df, "c", "lat", "lon")
    assert [tuple(r)[1:] for r in got.collect()] == [(31.05, 121.3), (None, 1.0), (None, None)]
    assert [r[0] for r in got.select(tx.coord_key("lat", "lon")).collect()] == ["31.05,121.3", None, None]


def test_suffixes_over_distinct_addresses(make):
    df = make("a string", [("一楼",), ("一楼",), ("二楼",), ("x",)])
    assert {r["ending"]: r["n"] for r in rs.suffix_profile(df, "a", 1).collect()} == {"楼": 2, "x": 1}


def test_master_fills_blank_phone_and_picks_nearest(make):
    raw = make("sup_id int, from_addr string, from_tel string, from_tel_alt string, details string",
               [(1, "上海路1号", "", "138", BLOCK.format("")), (1, "上海路1号", "138", "9", BLOCK.format("详情\n").replace("上海路1号", "远方")),
                (2, "远", None, "1", BLOCK.format(""))])
    got = {r["sup_id"]: r for r in rs.restaurant_master(raw).collect()}
    assert got[1]["from_tel"] == "138" and got[1]["from_addr_xms"] == "上海路1号" and got[1]["adist_long"] == 0.0
    assert got[2]["from_tel"] is None and got[2]["match_rule"] == 0


def test_addresses_attach_to_every_order(make):
    o = make("id int, from_addr string", [(1, "路3楼"), (2, "路3楼"), (3, None)])
    got = {r["id"]: r["cleaned"] for r in rs.clean_store_addresses(o).collect()}
    assert got == {1: "路", 2: "路", 3: None}


def test_master_moves_no_block_twice(spark):
    """Tags are looked up after the pick, by hashes; several tags of a block keep one row."""
    from pyspark.sql import functions as F

    from mealops.plans.restaurants import restaurant_master

    block = lambda name, addr: "\n".join([name, "标签:x", "t", "d2", addr, "d3", "¥1-2", "口味:5", "环境:4", "服务:3", "d7", "c", "r"])
    rows = [(1, "road 1", None, "9", block("near", "road 1")), (1, "road 1", None, "9", block("a", "road 1")),
            (1, "road 1", None, "9", block("far", "street 99")), (2, "road 2", "", "8", block("b", "road 2")), (3, "road 3", "7", "7", "short\nx")]
    raw = spark.createDataFrame(rows, "sup_id long, from_addr string, from_tel string, from_tel_alt string, details string")
    tags = raw.select("sup_id", "from_addr", "from_tel", "details", F.lit("T").alias("tag1"), F.lit(None).cast("string").alias("tag2"))
    tags = tags.filter("sup_id = 1").unionByName(tags.filter("sup_id = 1").withColumn("tag1", F.lit("U")))
    out = restaurant_master(raw, tags)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and not any("details" in line for line in plan.split("\n") if "Exchange hash" in line)
    got = {r["sup_id"]: (r["name"], r["from_tel"], r["tag1"], r["adist_long"], r["match_rule"]) for r in out.collect()}
    assert got == {1: ("a", None, "T", 0.0, 1), 2: ("b", "8", None, 0.0, 1)}
    assert out.columns[-3:] == ["adist_long", "adist_short", "match_rule"] and "tag2" in out.columns
