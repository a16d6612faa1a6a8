"""Weather physics as column expressions. Null in, null out; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Tetens coefficients, standard lapse rate, guard rails -------------------
TETENS_E0 = 0.61078
TETENS_A = 17.27
TETENS_B = 237.3
LAPSE_C_PER_M = -0.0065
MAX_RESIDUAL_C = 12.0
CALM_WIND_KMH = 0.5
FULL_SUN_W_M2 = 1000.0
DAYS_PER_YEAR = 365.25
DEFAULT_DOMAIN_ELEVATION_M = 380.0


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value and keep null as null (greatest/least would skip the null)."""
    bounded = x
    if low is not None:
        bounded = F.when(bounded < low, F.lit(low)).otherwise(bounded)
    if high is not None:
        bounded = F.when(bounded > high, F.lit(high)).otherwise(bounded)
    return bounded


def saturation_vapour_pressure(temp_c: Column) -> Column:
    return F.lit(TETENS_E0) * F.exp(F.lit(TETENS_A) * temp_c / (temp_c + TETENS_B))


def vapour_pressure_deficit(temp_c: Column, humidity_pct: Column, humidity_floor: float = 1.0) -> Column:
    """Deficit in kPa. Training clips humidity to 1..100, the stress indices to 0..100."""
    saturated = saturation_vapour_pressure(temp_c)
    return clip(saturated - saturated * (clip(humidity_pct, humidity_floor, 100.0) / 100.0), low=0.0)


def lapse_delta(delta_elevation_m: Column) -> Column:
    return delta_elevation_m * F.lit(LAPSE_C_PER_M)


def hour_angle(timestamp: Column, with_minutes: bool = False) -> Column:
    hour = F.hour(timestamp).cast("double")
    if with_minutes:
        hour = hour + F.minute(timestamp) / 60.0
    return hour * F.lit(2.0 * math.pi / 24.0)


def year_angle(timestamp: Column) -> Column:
    return F.dayofyear(timestamp) * F.lit(2.0 * math.pi / DAYS_PER_YEAR)


def calendar_columns(timestamp: Column) -> dict[str, Column]:
    """Hour, day of year and their position on the day and year circles."""
    return {
        "hour": F.hour(timestamp),
        "day_of_year": F.dayofyear(timestamp),
        "hour_sin": F.sin(hour_angle(timestamp)),
        "hour_cos": F.cos(hour_angle(timestamp)),
        "doy_sin": F.sin(year_angle(timestamp)),
        "doy_cos": F.cos(year_angle(timestamp)),
    }


def nocturnal_inversion(delta_elevation_m: Column, wind_kmh: Column, solar_w_m2: Column) -> Column:
    """Cold-air pooling: depth below the domain mean, per unit of wind, without sun."""
    sunlight = clip(solar_w_m2 / FULL_SUN_W_M2, 0.0, 1.0)
    return clip(-delta_elevation_m, low=0.0) / clip(wind_kmh, low=CALM_WIND_KMH) * (1.0 - sunlight)


def night_soil_inversion(timestamp: Column, baseline_c: Column, soil_c: Column) -> Column:
    """Fleet variant: baseline minus soil temperature from 20:00 to 06:00, else zero."""
    night = (F.hour(timestamp) >= 20) | (F.hour(timestamp) <= 6)
    return F.when(night, baseline_c - soil_c).otherwise(F.lit(0.0))


def solar_heating(solar_w_m2: Column, hour_cos: Column) -> Column:
    return clip(solar_w_m2, low=0.0) / FULL_SUN_W_M2 * clip(-hour_cos, low=0.0)


def sloped_insolation(
    solar_w_m2: Column, slope_deg: Column, aspect_sin: Column, aspect_cos: Column,
    hour_sin: Column, hour_cos: Column,
) -> Column:
    facing = aspect_sin * hour_sin + aspect_cos * hour_cos
    return solar_w_m2 / FULL_SUN_W_M2 * (F.sin(F.radians(slope_deg)) * facing + 1.0)


def evaporative_demand(et0_mm: Column, vpd_kpa: Column, solar_w_m2: Column) -> Column:
    return et0_mm * vpd_kpa * (solar_w_m2 / FULL_SUN_W_M2)


def infiltration_potential(rain_mm: Column, slope_deg: Column) -> Column:
    return rain_mm / (slope_deg + 1.0)


def valley_dew(tpi_m: Column, humidity_pct: Column) -> Column:
    return clip(-tpi_m, low=0.0) * humidity_pct / 100.0


def ridge_wind(tpi_m: Column, wind_kmh: Column) -> Column:
    return clip(tpi_m, low=0.0) * wind_kmh / 10.0


def clamp_residual(residual_c: Column) -> Column:
    return clip(residual_c, -MAX_RESIDUAL_C, MAX_RESIDUAL_C)


def downscaled_temperature(baseline_c: Column, residual_c: Column) -> Column:
    return F.round(baseline_c + clamp_residual(residual_c), 2)


def confidence(residual_c: Column) -> Column:
    return F.round(clip(1.0 - F.abs(clamp_residual(residual_c)) / 30.0, 0.70, 0.99), 3)


def hourly_degree_share(temp_c: Column, base_c: float = 10.0) -> Column:
    return clip((temp_c - base_c) / 24.0, low=0.0)


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """(metres per degree of longitude, metres per degree of latitude), WGS-84 series."""
    lat = F.radians(latitude)
    per_lat = F.lit(111132.92) - 559.82 * F.cos(lat * 2.0) + 1.175 * F.cos(lat * 4.0)
    per_lon = 111412.84 * F.cos(lat) - 93.5 * F.cos(lat * 3.0)
    return F.abs(per_lon), F.abs(per_lat)


def aspect_components(aspect_deg: Column) -> tuple[Column, Column]:
    """Sine and cosine of a compass aspect; flat ground (null aspect) gives 0, 0."""
    flat = aspect_deg.isNull()
    return (
        F.when(flat, F.lit(0.0)).otherwise(F.sin(F.radians(aspect_deg))),
        F.when(flat, F.lit(0.0)).otherwise(F.cos(F.radians(aspect_deg))),
    )
