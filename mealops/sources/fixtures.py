"""Deterministic order, route, restaurant and weather tables derived from the test tables.

Every table is computed by Spark from ``events``/``orders``/… so that it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import plus_minutes

ORIGIN = "timestamp_ntz'2024-01-01 00:00:00'"


# declared schemas of the test tables in use: no footer-reading job per query
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def meal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One meal order per event, with its whole life cycle."""
    c = F.col
    base = table(spark, sf_dir, "events").select(
        c("event_id").alias("id"), "user_id",
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("place_tm"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(c("value") * 100).cast("long").alias("price"))
    dispatched = base.withColumn("dipatch_tm", plus_minutes("place_tm", 2 + c("k") % 10))
    left = dispatched.withColumn("leave_tm", plus_minutes("dipatch_tm", 10 + c("k") % 20))
    return left.select(
        "id", "user_id",
        ((c("user_id") * 3 + c("k") % 4) % 40).cast("long").alias("sup_id"),
        F.floor(c("user_id") / 8).cast("long").alias("rider_id"),
        "place_tm", plus_minutes("place_tm", 20 + c("k") % 60).alias("require_tm"), "dipatch_tm",
        plus_minutes("dipatch_tm", 1).alias("read_tm"),
        plus_minutes("dipatch_tm", 3).alias("receive_tm"),
        plus_minutes("dipatch_tm", 5 + c("k") % 5).alias("arrive_tm"), "leave_tm",
        plus_minutes("leave_tm", 5 + c("id") % 45).alias("finish_tm"), "price",
        (c("price") - (c("id") % 5) * 10).alias("paid"),
        (320 + (c("k") % 9) * 60).cast("long").alias("rider_income"),
        (5 + c("k") % 20).cast("int").alias("dish_longer"),
        (1 + c("k") % 6).cast("int").alias("menu_num"), "k")


def station_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour station readings: one per (station, half hour) that saw an event."""
    c = F.col
    seconds = F.timestamp_diff("SECOND", F.expr(ORIGIN), c("ts"))
    readings = (table(spark, sf_dir, "events")
                .select((c("user_id") % 3).cast("int").alias("station"),
                        F.floor(seconds / 1800).cast("long").alias("i"),
                        F.get_json_object("props", "$.k").cast("int").alias("k"))
                .groupBy("station", "i").agg(F.min("k").alias("k")))
    tm = F.expr(ORIGIN) + F.make_dt_interval(mins=(c("i") * 30).cast("int"))
    return readings.select(
        "station", tm.alias("tm"),
        ((F.floor(c("i") / 5) * 29 + c("station") * 13) % 100).cast("int").alias("mw"),
        F.when(c("k") % 10 == 3, c("k")).cast("int").alias("mw_1"),
        (50 + (c("i") * 7 + c("station") * 3) % 40).cast("int").alias("temp"))


def route_lookup(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Route shards: every 17th order is missing, every 50th is present twice."""
    c = F.col
    o = (orders if orders is not None else meal_orders(spark, sf_dir)).filter(c("id") % 17 != 0)
    copies = F.explode(F.when(c("id") % 50 == 0, F.array(F.lit(1), F.lit(2)))
                       .otherwise(F.array(F.lit(1))))
    lat = lambda key, n: (3105 + c(key) % n)
    lon = lambda key, n: (12125 + c(key) % n)

    def text(hundredths):
        return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."),
                        F.lpad((hundredths % 100).cast("string"), 2, "0"))

    return (o.select(
        "id", copies.alias("_copy"),
        F.concat_ws(",", text(lat("sup_id", 50)), text(lon("sup_id", 50))).alias("o_cords"),
        F.concat_ws(",", text(lat("user_id", 60)), text(lon("user_id", 60))).alias("d_cords"),
        (500 + (c("id") * 37) % 6000).cast("long").alias("dist"),
        (120 + (c("id") * 13) % 1500).cast("long").alias("time"))
        .drop("_copy"))


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per store that ever sold a meal."""
    c = F.col
    s = meal_orders(spark, sf_dir).select("sup_id").distinct()
    rating = lambda m: ((60 + (c("sup_id") * m) % 30) / 10.0)
    tags = F.array(*[F.lit(t) for t in ("中式快餐简餐", "日本菜", "寿司", "甜点饮品", "西餐")])
    return s.select(
        "sup_id", F.concat(F.lit("S"), c("sup_id").cast("string")).alias("name"),
        F.concat(F.lit("road "), c("sup_id").cast("string")).alias("from_addr"),
        F.when(c("sup_id") % 7 != 0, F.concat(F.lit("021-"), (5000 + c("sup_id")).cast("string")))
        .alias("from_tel"),
        F.get(tags, (c("sup_id") % 5).cast("int")).alias("tag1"),
        (20 + c("sup_id")).cast("double").alias("avgexp_lo"),
        (30 + c("sup_id")).cast("double").alias("avgexp_up"),
        F.when(c("sup_id") % 9 != 0, rating(3)).alias("taste"),
        rating(7).alias("envir"), rating(11).alias("service"))


def _branch(sup, branch) -> list:
    """Phone and address of a store's branch; every seventh store has no phone."""
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    return [F.when(sup % 7 != 0, text("021-", 5000 + sup + 100 * branch)).alias("from_tel"),
            F.concat(text("road ", sup), F.when(branch == 1, F.lit(" b")).otherwise(F.lit(""))).alias("from_addr")]


def with_branch(orders: DataFrame) -> DataFrame:
    """Orders with the phone and address of the branch they came from: every fifth store has two."""
    c = F.col
    return orders.select("*", *_branch(c("sup_id"), F.when(c("sup_id") % 5 == 0, c("k") % 2).otherwise(F.lit(0))))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restaurant master with one row per branch; second branches are rated on their own
    and some have no average expense."""
    c = F.col
    own = restaurants(spark, sf_dir).drop("from_tel", "from_addr").withColumn(
        "_b", F.explode(F.when(c("sup_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = c("_b") == 1
    return (own.select("*", *_branch(c("sup_id"), c("_b")))
            .withColumn("taste", F.when(second, (60 + (c("sup_id") * 13) % 30) / 10.0).otherwise(c("taste")))
            .withColumn("avgexp_lo", F.when(~(second & (c("sup_id") % 3 == 0)), c("avgexp_lo"))).drop("_b"))
