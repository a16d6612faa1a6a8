"""Spray suitability of one hour: a score, a yes/no and the reason shown to the farmer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcast.functions.text import fixed

# --- fixed values: thresholds and penalties -------------------------------------------------
START_SCORE = 95.0
WINDOW_SCORE = 65.0
MIN_WINDOW_HOURS = 2
WIND_HIGH_KMH, WIND_HIGH_PENALTY = 14.0, 50.0
WIND_LOW_KMH, WIND_LOW_PENALTY = 3.0, 15.0
RAIN_CHANCE_PCT, RAIN_PENALTY = 25.0, 60.0
HOT_C, HOT_PENALTY = 34.0, 45.0
COLD_C, COLD_PENALTY = 12.0, 20.0
HUMID_PCT, HUMID_PENALTY = 90.0, 15.0
HUMID_TEXT = "High humidity (dew dilution / delayed drying)"
HOT_TEXT = "High temperature (%s°C: droplet evaporation risk)"
RAIN_TEXT = "Rain probability (%s%% > 25%%: washout risk)"
WIND_TEXT = "High wind (%s km/h > 14 km/h: chemical drift risk)"
CALM_TEXT = "Calm air (sub-optimal canopy penetration)"
NO_LIMIT_TEXT = "None"


def _penalty(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def suitability(temp_c: Column, humidity_pct: Column, wind_kmh: Column, rain_chance_pct: Column) -> Column:
    score = (
        F.lit(START_SCORE)
        - _penalty(wind_kmh > WIND_HIGH_KMH, WIND_HIGH_PENALTY)
        - _penalty(wind_kmh < WIND_LOW_KMH, WIND_LOW_PENALTY)
        - _penalty(rain_chance_pct > RAIN_CHANCE_PCT, RAIN_PENALTY)
        - _penalty(temp_c > HOT_C, HOT_PENALTY)
        - _penalty(temp_c < COLD_C, COLD_PENALTY)
        - _penalty(humidity_pct > HUMID_PCT, HUMID_PENALTY)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def sprayable(temp_c: Column, wind_kmh: Column, rain_chance_pct: Column) -> Column:
    """Only strong wind, rain chance and heat block; calm or humid air merely costs points."""
    blocked = (wind_kmh > WIND_HIGH_KMH) | (rain_chance_pct > RAIN_CHANCE_PCT) | (temp_c > HOT_C)
    return ~F.coalesce(blocked, F.lit(False))


def limiting_reason(temp_c: Column, humidity_pct: Column, wind_kmh: Column, rain_chance_pct: Column) -> Column:
    """The reason found last wins, hence the reversed order of the cases."""
    return (
        F.when(humidity_pct > HUMID_PCT, F.lit(HUMID_TEXT))
        .when(temp_c > HOT_C, F.format_string(HOT_TEXT, fixed(temp_c, 1)))
        .when(rain_chance_pct > RAIN_CHANCE_PCT, F.format_string(RAIN_TEXT, fixed(rain_chance_pct, 0)))
        .when(wind_kmh > WIND_HIGH_KMH, F.format_string(WIND_TEXT, fixed(wind_kmh, 1)))
        .when(wind_kmh < WIND_LOW_KMH, F.lit(CALM_TEXT))
        .otherwise(F.lit(NO_LIMIT_TEXT))
    )


def in_window(temp_c: Column, humidity_pct: Column, wind_kmh: Column, rain_chance_pct: Column) -> Column:
    """An hour counts towards a window when it is sprayable and scores at least 65."""
    score = suitability(temp_c, humidity_pct, wind_kmh, rain_chance_pct)
    return sprayable(temp_c, wind_kmh, rain_chance_pct) & (score >= WINDOW_SCORE)
