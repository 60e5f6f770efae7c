"""Orders, routes, restaurants, features and weather to the model table and its sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import map_slack
from ..functions.text import split_coords
from ..functions.timing import daypart
from ..operators.filters import CITY_BOX, SAMPLE_BOUNDS, analysis_sample, null_outside_box
from ..operators.joins import join_slot_weather, left_lookup

STATIONS = {"hq": 1, "pd": 2}
MOMENTS = {"p": ("place_date", "place_tmref"), "r": ("require_date", "require_tmref")}
WEATHER_COLUMNS = ["station", "tm", "temp", "precipitating", "shower", "pcp_begin", "shw_begin"]


def model_table(features: DataFrame, routes: DataFrame, stores: DataFrame, weather: DataFrame,
                store_keys: list[str] = ("sup_id", "from_tel", "from_addr")) -> DataFrame:
    """All orders with route (minutes), restaurant, features, weather at placing and required
    slots of both stations, slack and daypart.

    ``features`` are orders with the derived columns; ``weather`` is the slot table.
    Restaurants and weather slots are small next to orders, so adaptive execution turns
    those joins into broadcasts when their measured size allows it.
    """
    routed = left_lookup(features, routes.withColumn("time", F.col("time") / 60.0), "id")
    stored = left_lookup(routed, stores, list(store_keys), null_safe=len(store_keys) > 1)
    df = join_slot_weather(stored, weather.select(*WEATHER_COLUMNS), STATIONS, MOMENTS)
    df = map_slack(df).withColumn("tmref_cat", daypart("require_tmref"))
    return split_coords(split_coords(df, "o_cords", "o_lat", "o_lon"), "d_cords", "d_lat", "d_lon")


def sample(df: DataFrame, bounds: dict[str, tuple] = SAMPLE_BOUNDS) -> DataFrame:
    """The analysis sample with out-of-city coordinates blanked."""
    box = {f"{end}_{axis}": CITY_BOX[axis] for end in ("o", "d") for axis in ("lat", "lon")}
    return null_outside_box(analysis_sample(df, bounds), box)
