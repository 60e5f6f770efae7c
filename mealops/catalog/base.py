"""Query registry and the shared frames with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import daypart, durations_min, half_hour_slot
from ..operators.windows import avg_on_hand
from ..operators.joins import left_lookup
from ..session import configure
from ..sources.fixtures import meal_orders, route_lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- shared CTEs -------------------------------------------------------------------------

CTES = {
    "meal_orders": """e AS (SELECT event_id AS id, user_id, date_trunc('second', ts) AS place_tm,
    CAST(json_extract(props,'$.k') AS INT) AS k, CAST(round(value*100) AS BIGINT) AS price FROM events),
  f AS (SELECT *, place_tm + to_minutes(2+k%10) AS dipatch_tm FROM e),
  g AS (SELECT *, dipatch_tm + to_minutes(10+k%20) AS leave_tm FROM f),
  meal_orders AS (SELECT id, user_id, (user_id*3+k%4)%40 AS sup_id, user_id//8 AS rider_id, place_tm,
    place_tm + to_minutes(20+k%60) AS require_tm, dipatch_tm, dipatch_tm + to_minutes(1) AS read_tm,
    dipatch_tm + to_minutes(3) AS receive_tm, dipatch_tm + to_minutes(5+k%5) AS arrive_tm, leave_tm,
    leave_tm + to_minutes(5+id%45) AS finish_tm, price, price-(id%5)*10 AS paid,
    CAST(320+(k%9)*60 AS BIGINT) AS rider_income, 5+k%20 AS dish_longer, 1+k%6 AS menu_num, k FROM g)""",
    "timed": """t0 AS (SELECT *, date_diff('second', require_tm, finish_tm)/60e0 AS delay,
    date_diff('second', place_tm, require_tm)/60e0 AS prereq,
    date_diff('second', dipatch_tm, leave_tm)/60e0 AS prepare,
    date_diff('second', leave_tm, finish_tm)/60e0 AS ride,
    date_diff('second', place_tm, dipatch_tm)/60e0 AS left1,
    CAST(place_tm AS DATE) AS place_date, CAST(require_tm AS DATE) AS require_date,
    hour(place_tm) + CASE WHEN minute(place_tm)<15 THEN 0e0 WHEN minute(place_tm)<45 THEN 0.5e0 ELSE 1e0 END AS place_tmref,
    hour(require_tm) + CASE WHEN minute(require_tm)<15 THEN 0e0 WHEN minute(require_tm)<45 THEN 0.5e0 ELSE 1e0 END AS require_tmref
    FROM meal_orders),
  timed AS (SELECT *, prereq - ride AS allow_cook,
    CASE WHEN require_tmref BETWEEN 11.5 AND 14.5 THEN 'lunch'
         WHEN require_tmref BETWEEN 17.5 AND 20.5 THEN 'dinner' ELSE 'other' END AS tmref_cat FROM t0)""",
    "weather": """wr AS (SELECT CAST(user_id % 3 AS INT) AS station,
    date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) // 1800 AS i,
    min(CAST(json_extract(props,'$.k') AS INT)) AS k FROM events GROUP BY 1, 2),
  weather AS (SELECT station, TIMESTAMP '2024-01-01' + to_minutes(i*30) AS tm,
    CAST(((i//5)*29 + station*13) % 100 AS INT) AS mw, CASE WHEN k%10=3 THEN k END AS mw_1,
    CAST(50 + (i*7 + station*3) % 40 AS INT) AS temp FROM wr)""",
    "weather_flagged": """weather_flagged AS (SELECT *,
    coalesce(mw BETWEEN 50 AND 99, false) OR coalesce(mw_1 BETWEEN 50 AND 99, false) AS precipitating,
    coalesce(mw BETWEEN 80 AND 99, false) OR coalesce(mw_1 BETWEEN 80 AND 99, false) AS shower FROM weather),
  wl AS (SELECT *,
    CASE WHEN precipitating IS DISTINCT FROM lag(precipitating) OVER w THEN 1 ELSE 0 END AS fp,
    CASE WHEN shower IS DISTINCT FROM lag(shower) OVER w THEN 1 ELSE 0 END AS fs
    FROM weather_flagged WINDOW w AS (PARTITION BY station ORDER BY tm)),
  wg AS (SELECT *, CAST(sum(fp) OVER w AS BIGINT) AS regime_pcp, CAST(sum(fs) OVER w AS BIGINT) AS regime_shw
    FROM wl WINDOW w AS (PARTITION BY station ORDER BY tm ROWS UNBOUNDED PRECEDING)),
  weather_slots AS (SELECT station, tm, temp, precipitating, shower, regime_pcp, regime_shw,
    CASE WHEN precipitating THEN min(tm) OVER (PARTITION BY station, regime_pcp) END AS pcp_begin,
    CASE WHEN shower THEN min(tm) OVER (PARTITION BY station, regime_shw) END AS shw_begin FROM wg)""",
    "dist": """dist_raw AS (SELECT o.id,
    (3105+sup_id%50)//100 || '.' || lpad(CAST((3105+sup_id%50)%100 AS VARCHAR),2,'0') || ',' ||
    (12125+sup_id%50)//100 || '.' || lpad(CAST((12125+sup_id%50)%100 AS VARCHAR),2,'0') AS o_cords,
    (3105+user_id%60)//100 || '.' || lpad(CAST((3105+user_id%60)%100 AS VARCHAR),2,'0') || ',' ||
    (12125+user_id%60)//100 || '.' || lpad(CAST((12125+user_id%60)%100 AS VARCHAR),2,'0') AS d_cords,
    500+(id*37)%6000 AS dist, 120+(id*13)%1500 AS time
    FROM meal_orders o, unnest(CASE WHEN o.id%50=0 THEN [1,2] ELSE [1] END) AS c(copy) WHERE id%17 <> 0),
  dist AS (SELECT DISTINCT * FROM dist_raw)""",
    "sup": """sup AS (SELECT sup_id, 'S' || sup_id AS name, 'road ' || sup_id AS from_addr,
    CASE WHEN sup_id%7<>0 THEN '021-' || (5000+sup_id) END AS from_tel,
    list_extract(['中式快餐简餐','日本菜','寿司','甜点饮品','西餐'], CAST(sup_id%5+1 AS INT)) AS tag1,
    CAST(20+sup_id AS DOUBLE) AS avgexp_lo, CAST(30+sup_id AS DOUBLE) AS avgexp_up,
    CASE WHEN sup_id%9<>0 THEN (60+(sup_id*3)%30)/10e0 END AS taste,
    (60+(sup_id*7)%30)/10e0 AS envir, (60+(sup_id*11)%30)/10e0 AS service
    FROM (SELECT DISTINCT sup_id FROM meal_orders))""",
    "branch": """branch AS (SELECT sup_id, CASE WHEN sup_id%7<>0 THEN '021-' || (5000+sup_id+100*b) END AS from_tel,
    'road ' || sup_id || CASE WHEN b=1 THEN ' b' ELSE '' END AS from_addr,
    CASE WHEN b=1 THEN (60+(sup_id*13)%30)/10e0 ELSE taste END AS taste, envir, service, avgexp_up,
    CASE WHEN NOT (b=1 AND sup_id%3=0) THEN avgexp_lo END AS avgexp_lo
    FROM sup, unnest(CASE WHEN sup_id%5=0 THEN [0,1] ELSE [0] END) AS t(b))""",
    "onhand": """ev AS (SELECT rider_id, id, 'arrive_tm' AS action, arrive_tm AS tm, 1 AS delta FROM meal_orders
    UNION ALL SELECT rider_id, id, 'finish_tm', finish_tm, -1 FROM meal_orders),
  ev2 AS (SELECT *, CAST(sum(delta) OVER w AS BIGINT) AS onhand, lead(tm) OVER w0 AS nxt,
    row_number() OVER w0 AS rn FROM ev
    WINDOW w AS (PARTITION BY rider_id ORDER BY tm, action, id ROWS UNBOUNDED PRECEDING),
           w0 AS (PARTITION BY rider_id ORDER BY tm, action, id)),
  ev3 AS (SELECT *, onhand * date_diff('second', tm, nxt) AS area FROM ev2),
  ev4 AS (SELECT *, sum(area) OVER (PARTITION BY rider_id ORDER BY tm, action, id ROWS UNBOUNDED PRECEDING) - area AS before FROM
    (SELECT * REPLACE (coalesce(area, 0) AS area) FROM ev3)),
  onhand AS (SELECT a.id, CAST(b.before - a.before AS BIGINT)/60e0 AS onhandXdur,
    CAST(b.before - a.before AS BIGINT) / nullif(date_diff('second', a.tm, b.tm), 0)::DOUBLE AS onhand
    FROM (SELECT * FROM ev4 WHERE action='arrive_tm') a JOIN (SELECT * FROM ev4 WHERE action='finish_tm') b ON a.id=b.id)""",
    "moving": """moving AS (SELECT o.*, d.dist, d.time/60e0 AS time, h.onhand,
    d.dist / nullif(date_diff('second', leave_tm, finish_tm), 0)::DOUBLE AS speed,
    date_diff('second', leave_tm, finish_tm)::DOUBLE / nullif(d.time/60e0, 0) AS bdunexp
    FROM timed o JOIN dist d USING (id) JOIN onhand h USING (id)
    WHERE dist < 14000 AND dist / nullif(date_diff('second', leave_tm, finish_tm), 0)::DOUBLE < 30 AND d.time > 0)""",
    "shifted": """sh0 AS (SELECT *, CAST(read_tm AS DATE) AS read_date FROM meal_orders),
  sh1 AS (SELECT *, coalesce(date_diff('second', lag(finish_tm) OVER (PARTITION BY rider_id, read_date ORDER BY read_tm, id), read_tm) > 3600, false) AS r_new_shift FROM sh0),
  shifted AS (SELECT *, CAST(sum(CAST(r_new_shift AS INT)) OVER (PARTITION BY rider_id, read_date ORDER BY read_tm, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r_shift FROM sh1),
  shift_table AS (SELECT rider_id, read_date, r_shift, min(read_tm) AS "begin", max(finish_tm) AS "end", count(*) AS r_inshift_n FROM shifted GROUP BY 1,2,3)""",
    "roster": """ticks AS (SELECT d.date, CAST(d.date AS TIMESTAMP) + to_minutes(m) AS tm
    FROM (SELECT DISTINCT read_date AS date FROM shift_table) d, range(570, 1351, 30) AS r(m)),
  roster AS (SELECT t.date, t.tm, count(s.rider_id) AS avai_n30 FROM ticks t LEFT JOIN shift_table s
    ON s.read_date = t.date AND s."begin" < t.tm AND t.tm + to_minutes(5) < s."end" GROUP BY 1, 2)""",
    "lagged": """lagged AS (SELECT *, lag(delay) OVER w AS delay_lag1, lag(require_tm) OVER w AS require_tm_lag1,
    lag(place_tm) OVER w AS place_tm_lag1, lag(prereq) OVER w AS prereq_lag1,
    row_number() OVER w AS occ, count(*) OVER (PARTITION BY user_id, sup_id) AS tt_order
    FROM timed WHERE tmref_cat='lunch' WINDOW w AS (PARTITION BY user_id, sup_id ORDER BY place_tm, id))""",
    "prev_store": """ps0 AS (SELECT *, lag(sup_id) OVER w AS ps, lag(id) OVER w AS pi FROM meal_orders
    WINDOW w AS (PARTITION BY user_id ORDER BY finish_tm, id)),
  ps1 AS (SELECT *, sum(CASE WHEN sup_id IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER
    (PARTITION BY user_id ORDER BY finish_tm, id ROWS UNBOUNDED PRECEDING) AS island FROM ps0),
  prev_store AS (SELECT * EXCLUDE (ps, pi, island),
    first_value(pi) OVER w AS alt_id, first_value(ps) OVER w AS alt_id_store FROM ps1
    WINDOW w AS (PARTITION BY user_id, island ORDER BY finish_tm, id))""",
}

NEEDS = {"timed": ["meal_orders"], "weather_flagged": ["weather"], "dist": ["meal_orders"],
         "sup": ["meal_orders"], "branch": ["sup"], "onhand": ["meal_orders"], "moving": ["timed", "dist", "onhand"],
         "shifted": ["meal_orders"], "roster": ["shifted"], "lagged": ["timed"],
         "prev_store": ["meal_orders"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for dep in NEEDS.get(n, []):
            add(dep)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def sql(body: str, needs: str = "", ctes: str = "", rounds: str = "", digits: int = 6) -> str:
    """Assemble oracle SQL: shared CTEs, extra CTEs, the select, rounding of its doubles."""
    parts = [CTES[n] for n in _closure(needs.split())]
    if ctes:
        parts.append(ctes)
    if rounds:
        reps = ", ".join(
            f"CASE WHEN abs(round({c},{digits})) = 0 THEN 0e0 ELSE round({c},{digits}) END AS {c}"
            for c in rounds.split())
        body = f"SELECT * REPLACE ({reps}) FROM ({body})"
    head = "WITH " + ",\n  ".join(parts) + "\n" if parts else ""
    return head + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, timestamps as naive: the form results are compared in."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(cols)


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Register a query (results rounded) and its oracle SQL."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(configure(spark), sf_dir), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


# --- shared frames -----------------------------------------------------------------------

def timed(spark: SparkSession, d: str) -> DataFrame:
    """Orders with minute durations, slots and daypart."""
    df = durations_min(meal_orders(spark, d))
    return (df.withColumn("place_date", F.to_date("place_tm"))
            .withColumn("require_date", F.to_date("require_tm"))
            .withColumn("place_tmref", half_hour_slot("place_tm"))
            .withColumn("require_tmref", half_hour_slot("require_tm"))
            .withColumn("tmref_cat", daypart("require_tmref")))


def dist_of(spark: SparkSession, d: str) -> DataFrame:
    return route_lookup(spark, d).distinct()


def moving(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """Timed orders (or ``orders``, with at least their columns) with route, load and speed
    columns after the validity filter."""
    from ..functions.numeric import speed_columns
    from ..functions.timing import seconds_between
    o = timed(spark, d) if orders is None else orders
    routes = dist_of(spark, d).select("id", "dist", (F.col("time") / 60.0).alias("time"))
    load = avg_on_hand(o).select("id", "onhand")
    df = o.join(routes, "id").join(load, "id")
    return speed_columns(df, seconds_between("leave_tm", "finish_tm"))
