"""Declared schemas of the logical tables (nothing is inferred at read time)."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _DBL, _STR = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# The 21 leading columns of an order export (money in cents).
ORDERS = _struct(
    ("id", _LONG), ("user_id", _LONG), ("rider_id", _LONG), ("sup_id", _LONG),
    ("price", _LONG), ("paid", _LONG), ("rider_income", _LONG),
    ("address", _STR), ("from_addr", _STR), ("from_tel", _STR),
    ("place_tm", _TS), ("dipatch_tm", _TS), ("read_tm", _TS), ("receive_tm", _TS),
    ("arrive_tm", _TS), ("leave_tm", _TS), ("finish_tm", _TS), ("require_tm", _TS),
    ("dish_longer", _INT), ("menu_num", _INT), ("distance", _LONG),
)

DIST = _struct(
    ("id", _LONG), ("o_cords", _STR), ("d_cords", _STR), ("dist", _LONG),
    ("dist_txt", _STR), ("time", _LONG), ("time_txt", _STR),
)

RESTAURANTS = _struct(
    ("sup_id", _LONG), ("from_tel", _STR), ("from_addr", _STR), ("name", _STR), ("tags", _STR),
    ("tag1", _STR), ("tag2", _STR), ("tag3", _STR), ("tag4", _STR),
    ("avgexp_lo", _DBL), ("avgexp_up", _DBL), ("taste", _DBL), ("envir", _DBL),
    ("service", _DBL), ("adist_long", _DBL), ("adist_short", _DBL), ("match_rule", _INT),
)

# Raw station column -> short name.
STATION_RENAMES = {
    "YR--MODAHRMN": "ymdhm", "DIR": "wind_dir", "SPD": "wind_spd", "CLG": "cloud_ceil",
    "SKC": "sky_cov", "L": "L_cloud", "M": "M_cloud", "H": "H_cloud", "VSB": "visib",
    "TEMP": "temp", "DEWP": "dewp", "SLP": "sealv_pres", "ALT": "alti", "STP": "station_pres",
    "MAX": "tmax", "MIN": "tmin", "PCP01": "precip_1h", "PCP06": "precip_6h",
    "PCP24": "precip_24h", "PCPXX": "precip_xxh", "SD": "snow_depth",
}

# Placeholder texts that mean "no reading", per column.
STATION_SENTINELS = {
    "precip_1h": ["*****"], "precip_6h": ["*****"], "precip_24h": ["*****", "T*****"],
    "precip_xxh": ["*****", "T*****", "T 0.00"], "visib": ["****"],
    "MW": ["**"], "MW_1": ["**"], "MW_2": ["**"], "tmax": ["***"], "tmin": ["***"],
}

# Raw column order of a station file (all text until cleaned).
STATION_RAW = ["YR--MODAHRMN", "DIR", "SPD", "CLG", "SKC", "L", "M", "H", "VSB", "MW", "MW_1",
               "MW_2", "TEMP", "DEWP", "SLP", "ALT", "STP", "MAX", "MIN", "PCP01", "PCP06",
               "PCP24", "PCPXX", "SD"]

DAILY_WEATHER = _struct(("日期", _STR), ("天气状况", _STR), ("气温", _STR))

ROSTER30 = _struct(("tm", _TS), ("avai_n30", _LONG))
