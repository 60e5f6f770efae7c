"""Text and entity resolution (X*). Whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import restaurants as rs
from ..sources.fixtures import meal_orders, table
from .base import dist_of, query, sql

c = F.col


@query("x01_split_regex", sql("""SELECT doc_id, p[1] AS first, p[2] AS second, p[3] AS third FROM
  (SELECT doc_id, regexp_split_to_array(text, '[ ,]+') AS p FROM documents)"""))
def _(spark, d):
    return tx.split_to(table(spark, d, "documents"), "text", ["first", "second", "third"], pattern="[ ,]+").select(
        "doc_id", "first", "second", "third")


@query("x01_split_merge_tail", sql(r"""SELECT doc_id, p[1] AS head, p[2] AS body,
  CASE WHEN len(p)>2 THEN array_to_string(p[3:], chr(10)) END AS tail FROM
  (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)"""))
def _(spark, d):
    return tx.split_to(table(spark, d, "documents"), "text", ["head", "body", "tail"], pattern="\n",
                       merge_tail=True).select("doc_id", "head", "body", "tail")


@query("x01_split_positions", sql("""SELECT p_partkey, nullif(p_name[1:4],'') AS a, nullif(p_name[5:6],'') AS b,
  nullif(p_name[7:],'') AS rest FROM part"""))
def _(spark, d):
    return tx.split_to(table(spark, d, "part"), "p_name", ["a", "b", "rest"], positions=[4, 6]).select(
        "p_partkey", "a", "b", "rest")


@query("x02_suffix_profile", " UNION ALL ".join(
    f"SELECT {n} AS width, right(text, {n}) AS ending, count(*) AS n FROM (SELECT DISTINCT text FROM documents) GROUP BY 2"
    for n in (1, 2, 3)))
def _(spark, d):
    docs = table(spark, d, "documents")
    parts = [rs.suffix_profile(docs, "text", n).withColumn("width", F.lit(n)) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("width", "ending", "n")


_ENDS = ["3楼", "88号（A座)", "(B1", "一楼", "B-2楼", ""]
_ADDR = f"""a AS (SELECT p_partkey, p_name || list_extract({_ENDS}, CAST(p_partkey%6+1 AS INT)) AS addr FROM part)"""


def _addresses(spark, d):
    ends = F.get(F.array(*[F.lit(e) for e in _ENDS]), (c("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", ends).alias("addr"))


@query("x03_normalise_address", sql("""SELECT p_partkey, CASE WHEN regexp_matches(h, '[0-9一二三四]楼$')
  THEN regexp_replace(regexp_replace(h, '[0-9一二三四]楼$', ''), '[B-]+$', '') ELSE h END AS cleaned, p[2] AS supple
  FROM (SELECT p_partkey, p, p[1] AS h FROM (SELECT p_partkey, regexp_split_to_array(addr, '[(（]') AS p FROM a))""", ctes=_ADDR))
def _(spark, d):
    return rs.clean_store_addresses(_addresses(spark, d), "addr").select("p_partkey", "cleaned", "supple")


@query("x04_split_phones", sql("""SELECT c_custkey, t1[1] AS tel1, t1[2] AS int1, t2[1] AS tel2, t2[2] AS int2,
  CASE WHEN p3 IS NOT NULL AND c_custkey%5=2 THEN '77' ELSE p3 END AS tel3 FROM (SELECT c_custkey, string_split(p[1],'转') AS t1,
  string_split(p[2],'转') AS t2, p[3] AS p3 FROM (SELECT c_custkey, regexp_split_to_array(tel, '[, —]') AS p FROM t))""",
                              ctes="""t AS (SELECT c_custkey, CASE c_custkey%5
  WHEN 0 THEN '021-' || c_custkey || '转12, 13800000000' WHEN 1 THEN '021-1 021-' || c_custkey
  WHEN 2 THEN '13' || c_custkey || ',021-9转3,店77号' WHEN 3 THEN '—' || c_custkey END AS tel FROM customer)"""))
def _(spark, d):
    k = c("c_custkey").cast("string")
    tel = (F.when(c("c_custkey") % 5 == 0, F.concat(F.lit("021-"), k, F.lit("转12, 13800000000")))
           .when(c("c_custkey") % 5 == 1, F.concat(F.lit("021-1 021-"), k))
           .when(c("c_custkey") % 5 == 2, F.concat(F.lit("13"), k, F.lit(",021-9转3,店77号")))
           .when(c("c_custkey") % 5 == 3, F.concat(F.lit("—"), k)))
    return tx.split_phones(table(spark, d, "customer").select("c_custkey", tel.alias("tel")), "tel").drop("tel")


def _blocks(spark, d):
    """Scraped candidates: one block per (restaurant, page) pair seen in the line items."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), "p_name", "p_size", "p_brand")
    j = pairs.join(p, "l_partkey")
    s = lambda x: x.cast("string")
    noise = F.when(c("l_partkey") % 3 == 0, F.lit("详情\n")).otherwise("")
    block = F.concat(
        c("p_name"), F.lit("\n"), noise, F.lit("标签:x\n"), c("p_brand"), F.lit("\nd2\n"),
        F.lit("road "), s(c("l_partkey") % 100), F.lit(" no "), s(c("p_size")), F.lit("\nd3\n¥"),
        s(20 + c("p_size")), F.lit("-"), s(30 + c("p_size")), F.lit("\n口味:"), s(5 + c("p_size") % 5),
        F.lit(".5\n环境:"), s(4 + c("p_size") % 6), F.lit("\n服务:"), s(c("p_size") % 10), F.lit("\nd7\nc"),
        s(c("l_partkey")), F.lit("\nr1\nr2"))
    short = F.concat(c("p_name"), F.lit("\nnothing"))
    return j.select(
        c("l_suppkey").alias("sup_id"),
        F.concat(F.lit("road "), s(c("l_suppkey") % 100), F.lit(" no "), s(c("l_suppkey") % 50)).alias("from_addr"),
        F.when(c("l_suppkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("021-"), s(c("l_suppkey")))).alias("from_tel"),
        F.concat(F.lit("138"), s(c("l_suppkey"))).alias("from_tel_alt"), "l_partkey",
        F.when(c("l_partkey") % 11 == 0, short).otherwise(block).alias("details"))


_BLOCK = """b AS (SELECT DISTINCT l_suppkey AS sup_id, l_partkey, p_name AS name, p_brand AS tags, p_size,
  'road ' || l_suppkey%100 || ' no ' || l_suppkey%50 AS from_addr, 'road ' || l_partkey%100 || ' no ' || p_size AS from_addr_xms,
  CASE WHEN l_suppkey%2=0 THEN '138' || l_suppkey ELSE '021-' || l_suppkey END AS from_tel,
  (20+p_size)::DOUBLE AS avgexp_lo, (30+p_size)::DOUBLE AS avgexp_up, 5.5e0+p_size%5 AS taste, (4+p_size%6)::DOUBLE AS envir,
  (p_size%10)::DOUBLE AS service, 'c' || l_partkey AS comment, 'r1' || chr(10) || 'r2' AS remarks
  FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_partkey%11<>0)"""


@query("x05_parse_details", sql("""SELECT sup_id, l_partkey, name, tags, from_addr_xms, avgexp_lo, avgexp_up, taste, envir,
  service, comment, remarks FROM b""", ctes=_BLOCK))
def _(spark, d):
    return tx.parse_details(_blocks(spark, d)).select(
        "sup_id", "l_partkey", "name", "tags", "from_addr_xms", "avgexp_lo", "avgexp_up", "taste", "envir",
        "service", "comment", "remarks")


@query("x06_strip_label", sql("SELECT id, k%40::DOUBLE AS temp_max, k%31 AS day FROM meal_orders", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d)
    hot = F.concat(F.lit(" "), (c("k") % 40).cast("string"), F.lit("℃"))
    day = F.concat((c("k") % 31).cast("string"), F.lit("日"))
    return o.select("id", tx.strip_label(hot, "℃").cast("double").alias("temp_max"),
                    tx.strip_label(day, "日").cast("int").alias("day"))


@query("x07_norm_edit_distance", sql("""SELECT p_partkey, levenshtein(p_name, p_type)/greatest(length(p_name), length(p_type))::DOUBLE AS adist_long,
  levenshtein(p_name, p_type)/least(length(p_name), length(p_type))::DOUBLE AS adist_short FROM part""",
                                     rounds="adist_long adist_short"))
def _(spark, d):
    long, short = tx.norm_edit_distance("p_name", "p_type")
    return table(spark, d, "part").select("p_partkey", long.alias("adist_long"), short.alias("adist_short"))


@query("x08_match_rule", sql("""SELECT p_partkey, CASE WHEN dd/greatest(la,lb)>0.7e0 AND dd/least(la,lb)>=1 THEN 0 ELSE 1 END AS match_rule
  FROM (SELECT p_partkey, levenshtein(p_name, p_type)::DOUBLE AS dd, length(p_name) AS la, length(p_type) AS lb FROM part)"""))
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.match_rule(*tx.norm_edit_distance("p_name", "p_type")).alias("match_rule"))


@query("x09_restaurant_master", sql("""SELECT sup_id, from_tel, from_addr, from_addr_xms, adist_long, adist_short,
  CASE WHEN adist_long>0.7e0 AND adist_short>=1 THEN 0 ELSE 1 END AS match_rule, tag1 FROM (SELECT *, row_number() OVER (PARTITION BY sup_id, from_tel, from_addr
  ORDER BY adist_long, from_addr_xms) AS r FROM (SELECT b.*, levenshtein(from_addr, from_addr_xms)::DOUBLE/greatest(length(from_addr), length(from_addr_xms)) AS adist_long,
  levenshtein(from_addr, from_addr_xms)::DOUBLE/least(length(from_addr), length(from_addr_xms)) AS adist_short,
  CASE WHEN sup_id%3<>0 THEN 'T' || sup_id%3 END AS tag1 FROM b)) WHERE r=1""", ctes=_BLOCK, rounds="adist_long adist_short"))
def _(spark, d):
    raw = _blocks(spark, d).drop("l_partkey")
    tags = (raw.filter(c("sup_id") % 3 != 0)
            .withColumn("from_tel", tx.coalesce_blank("from_tel", "from_tel_alt"))
            .select("sup_id", "from_addr", "from_tel",
                    F.regexp_replace("details", "\n详情\n标签:", "\n标签:").alias("details"),
                    F.concat(F.lit("T"), (c("sup_id") % 3).cast("string")).alias("tag1")))
    return rs.restaurant_master(raw, tags).select("sup_id", "from_tel", "from_addr", "from_addr_xms",
                                                  "adist_long", "adist_short", "match_rule", "tag1")


@query("x09_store_list", sql("""SELECT DISTINCT sup_id, from_addr, from_tel, from_tel AS tel1 FROM (SELECT sup_id,
  'road ' || sup_id AS from_addr, '021-' || (5000+sup_id) AS from_tel FROM meal_orders)""", "meal_orders"))
def _(spark, d):
    o = meal_orders(spark, d).select(
        "sup_id", F.concat(F.lit("road "), c("sup_id").cast("string")).alias("from_addr"),
        F.concat(F.lit("021-"), (5000 + c("sup_id")).cast("string")).alias("from_tel"))
    return rs.store_list(o).select("sup_id", "from_addr", "from_tel", "tel1")


@query("x10_coordinates", sql("""SELECT id, o_cords AS back, CAST(split_part(o_cords,',',1) AS DOUBLE) AS o_lat,
  CAST(split_part(o_cords,',',2) AS DOUBLE) AS o_lon FROM dist""", "dist", rounds="o_lat o_lon"))
def _(spark, d):
    parts = tx.split_coords(dist_of(spark, d), "o_cords", "o_lat", "o_lon")
    text = lambda x: F.format_string("%.2f", c(x))
    return parts.select("id", tx.coord_key(text("o_lat"), text("o_lon")).alias("back"), "o_lat", "o_lon")
