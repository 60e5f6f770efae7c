"""File readers and sinks (S*): the orders and tables derived from the input are written in the
reader's file format to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import active_at_ticks
from ..operators.windows import shift_rollup, shifts
from ..sources import readers, schemas
from ..sources.fixtures import meal_orders, restaurants, route_lookup, station_weather
from ..sources.sinks import shared_path, stage, write_table
from .base import query, sql

c = F.col


@query("s01_scan_orders", sql("""SELECT id, user_id, rider_id, sup_id, price, rider_income, place_tm, finish_tm, menu_num,
  CAST(NULL AS VARCHAR) AS from_tel FROM meal_orders""", "meal_orders"))
def _(spark, d):
    o, path = meal_orders(spark, d), shared_path(spark, "exports")
    o = o.select(*[(c(f.name) if f.name in o.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ORDERS])
    for half in (0, 1):
        write_table(o.filter(c("id") % 2 == half), f"{path}/part{half}.csv", fmt="csv")
    return readers.scan_orders(spark, f"{path}/part*.csv").select(
        "id", "user_id", "rider_id", "sup_id", "price", "rider_income", "place_tm", "finish_tm", "menu_num", "from_tel")


@query("s03_distinct_shards", sql("SELECT id, o_cords, d_cords, dist, time, CAST(NULL AS VARCHAR) AS dist_txt FROM dist", "dist"))
def _(spark, d):
    raw = route_lookup(spark, d).withColumn("dist_txt", F.lit("")).withColumn("time_txt", F.lit("x")).select(schemas.DIST.fieldNames())
    path = shared_path(spark, "shards")
    write_table(raw, f"{path}/dist1.csv", fmt="csv")
    write_table(raw.filter(c("id") % 3 == 0), f"{path}/dist2.csv", fmt="csv")
    return readers.scan_dist_shards(spark, f"{path}/dist*.csv").select("id", "o_cords", "d_cords", "dist", "time", "dist_txt")


@query("s04_csv_blank_null", sql("SELECT sup_id, from_tel, from_addr, taste FROM sup", "sup", rounds="taste"))
def _(spark, d):
    df = restaurants(spark, d).select("sup_id", "from_tel", "from_addr", "taste")
    return readers.read_csv_blank_null(spark, write_table(df, shared_path(spark, "stores.csv"), fmt="csv"), df.schema)


@query("s05_csv_typed", sql("""SELECT id, CASE WHEN id%7<>0 THEN price END AS price, CASE WHEN id%5<>0 THEN place_tm END AS place_tm
  FROM meal_orders""", "meal_orders"))
def _(spark, d):
    text = meal_orders(spark, d).select(
        c("id").cast("string").alias("_row"), c("id").cast("string").alias("id"),
        F.when(c("id") % 7 == 0, "n/a").otherwise(c("price").cast("string")).alias("price"),
        F.when(c("id") % 5 == 0, "never").otherwise(F.date_format("place_tm", "yyyy-MM-dd HH:mm:ss")).alias("place_tm"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.LongType()),
                           T.StructField("place_tm", T.TimestampNTZType())])
    return readers.read_csv_typed(spark, write_table(text, shared_path(spark, "typed.csv"), fmt="csv"), schema, row_names=True)


@query("s06_station_weather", sql("""SELECT strftime(tm, '%Y%m%d%H%M') AS ymdhm, CAST(temp AS VARCHAR) AS temp,
  CAST(mw AS VARCHAR) AS mw, CASE WHEN mw_1 IS NULL THEN '**' ELSE CAST(mw_1 AS VARCHAR) END AS mw_1, '**' AS mw_2
  FROM weather""", "weather"))
def _(spark, d):
    w = station_weather(spark, d)
    have = {"YR--MODAHRMN": F.date_format("tm", "yyyyMMddHHmm"), "TEMP": c("temp").cast("string"), "MW": c("mw").cast("string"),
            "MW_1": F.coalesce(c("mw_1").cast("string"), F.lit("**")), "MW_2": F.lit("**")}
    raw = w.select(*[have.get(n, F.lit("1")).alias(n) for n in schemas.STATION_RAW])
    got = readers.read_station_weather(spark, write_table(raw, shared_path(spark, "station.csv"), fmt="csv"))
    return got.select(c("`YR--MODAHRMN`").alias("ymdhm"), c("TEMP").alias("temp"), c("MW").alias("mw"),
                      c("MW_1").alias("mw_1"), c("MW_2").alias("mw_2"))


@query("s07_daily_weather", sql("""SELECT strftime(tm, '%Y年%m月%d日') AS day, '多云' AS sky,
  max(temp) || '℃ / ' || min(temp) || '℃' AS temps FROM weather GROUP BY 1""", "weather"))
def _(spark, d):
    day = F.date_format("tm", "yyyy年MM月dd日").alias("日期")
    w = station_weather(spark, d).groupBy(day).agg(F.lit("多云").alias("天气状况"), F.concat(
        F.max("temp").cast("string"), F.lit("℃ / "), F.min("temp").cast("string"), F.lit("℃")).alias("气温"))
    got = readers.read_daily_weather(spark, write_table(w, shared_path(spark, "daily.csv"), fmt="csv"))
    return got.select(c("日期").alias("day"), c("天气状况").alias("sky"), c("气温").alias("temps"))


@query("s08_roster", sql("SELECT tm, avai_n30, CAST(tm AS DATE) AS date FROM roster", "roster"))
def _(spark, d):
    ticks = active_at_ticks(shift_rollup(shifts(meal_orders(spark, d)))).select("tm", "avai_n30")
    return readers.read_roster(spark, write_table(ticks, shared_path(spark, "roster")))


@query("s09_partitioned_sink", sql("""SELECT CAST(place_tm AS DATE) AS place_date, count(*) AS n, CAST(sum(price) AS BIGINT) AS price
  FROM meal_orders GROUP BY 1""", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d).withColumn("place_date", F.to_date("place_tm")).select("id", "price", "place_date")
    kept = stage(o, shared_path(spark, "by-day"), ["place_date"])
    return kept.groupBy("place_date").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))
