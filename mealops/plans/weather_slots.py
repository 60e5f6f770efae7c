"""Station readings to flagged slots with rain and shower episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import decimal_hour, parse_stamp
from ..functions.weather import weather_flags
from ..operators.filters import null_sentinels, rename_block
from ..operators.windows import episode_start, regimes
from ..sources import schemas


def clean_station(raw: DataFrame, station: int | str) -> DataFrame:
    """Raw text readings of one station to typed columns: names, sentinels, stamp."""
    named = null_sentinels(rename_block(raw, schemas.STATION_RENAMES), schemas.STATION_SENTINELS)
    numbers = ["wind_spd", "visib", "temp", "tmax", "tmin", "precip_1h", "precip_6h", "precip_24h", "precip_xxh"]
    return named.select(F.lit(station).alias("station"), parse_stamp("ymdhm").alias("tm"),
                        *[F.col(n).try_cast("double").alias(n) for n in numbers],
                        "MW", "MW_1", "MW_2")


def flagged_weather(readings: DataFrame) -> DataFrame:
    codes = [c for c in readings.columns if c.lower() in ("mw", "mw_1", "mw_2")]
    return readings.withColumns(weather_flags(*codes))


def weather_slots(readings: DataFrame, station: str = "station", tm: str = "tm") -> DataFrame:
    """Flags, wet/dry and shower regimes, episode starts and the decimal-hour slot."""
    out = flagged_weather(readings)
    for flag, regime, begin in (("precipitating", "regime_pcp", "pcp_begin"),
                                ("shower", "regime_shw", "shw_begin")):
        out = episode_start(regimes(out, station, tm, flag, regime), station, tm, regime, flag, begin)
    return (out.withColumn("date", F.to_date(tm))
            .withColumn("tmref", decimal_hour(F.hour(tm), F.minute(tm))))
