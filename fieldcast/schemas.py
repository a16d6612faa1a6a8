"""Explicit schemas of the landed documents and of the tables built from them."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, _D) for n in names]


# Service variable name -> column of the hourly table.
HOURLY_COLUMNS = {
    "temperature_2m": "temperature_2m_c",
    "relative_humidity_2m": "relative_humidity_2m_pct",
    "surface_pressure": "surface_pressure_hpa",
    "precipitation": "precipitation_mm",
    "wind_speed_10m": "wind_speed_10m_kmh",
    "wind_gusts_10m": "wind_gusts_10m_kmh",
    "direct_normal_irradiance": "solar_radiation_w_m2",
    "shortwave_radiation_instant": "shortwave_radiation_w_m2",
    "soil_temperature_0_to_7cm": "soil_temperature_0_to_7cm_c",
    "soil_moisture_0_to_7cm": "soil_moisture_0_to_7cm_m3m3",
    "et0_fao_evapotranspiration": "et0_evapotranspiration_mm",
}

# Only a forecast carries these.
FORECAST_COLUMNS = HOURLY_COLUMNS | {
    "precipitation_probability": "precipitation_probability_pct",
    "dew_point_2m": "dew_point_2m_c",
}

DAILY_COLUMNS = {
    "temperature_2m_max": "tmax_c",
    "temperature_2m_min": "tmin_c",
    "precipitation_sum": "precipitation_mm",
    "precipitation_probability_max": "rain_probability_pct",
    "weathercode": "weather_code",
}

OBS_HOURLY = T.StructType(
    [
        T.StructField("point_id", _S, False),
        T.StructField("zone_id", _S),
        *_doubles(["latitude", "longitude", "elevation_m"]),
        T.StructField("timestamp", T.TimestampType(), False),
        *_doubles(list(HOURLY_COLUMNS.values())),
    ]
)


def _series(columns: dict[str, str]) -> T.StructType:
    return T.StructType(
        [T.StructField("time", T.ArrayType(_S))]
        + [T.StructField(name, T.ArrayType(_D)) for name in columns]
    )


WEATHER_DOCUMENT = T.StructType(
    [
        T.StructField("point_id", _S),
        T.StructField("zone_id", _S),
        *_doubles(["latitude", "longitude", "elevation"]),
        T.StructField("hourly", _series(FORECAST_COLUMNS)),
        T.StructField("daily", _series(DAILY_COLUMNS)),
    ]
)

_BOX = T.StructType([T.StructField(n, _S) for n in ("west", "south", "east", "north")])

GRANULE_DOCUMENT = T.StructType(
    [
        T.StructField("dataset_id", _S),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, _S)
                        for n in ("identifier", "id", "summary", "updated", "enclosureLink", "searchLink")
                    ]
                    + [T.StructField("boundbox", T.ArrayType(_BOX))]
                )
            ),
        ),
    ]
)

ITEM_DOCUMENT = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", _S),
                        T.StructField("collection", _S),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", _S),
                                    T.StructField("coordinates", T.ArrayType(_D)),
                                ]
                            ),
                        ),
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField(n, _S)
                                    for n in ("datetime", "Online", "satellite", "attribution")
                                ]
                                + [T.StructField("soil_moisture_m3_m3", _D)]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)

TELEMETRY = T.StructType(
    [
        T.StructField("location_key", _S),
        T.StructField("satellite", _S),
        T.StructField("dataset_id", _S),
        T.StructField("timestamp", _S),
        *_doubles(["cloud_fraction_pct", "cloud_top_temp_c", "rainfall_rate_mmh"]),
    ]
)

POWER_DOCUMENT = T.StructType(
    [
        T.StructField("point_id", _S),
        T.StructField("date", _S),
        *_doubles(["t2m_c", "precip_corr_mm", "rh2m_pct", "solar_radiation_mj_m2"]),
    ]
)

# A bulletin extraction, as text-to-JSON services return it.
EXTRACTION = T.StructType(
    [T.StructField(n, _S) for n in ("district", "valid_from", "valid_to")]
    + _doubles(["min_temp_c", "max_temp_c", "rainfall_min_mm", "rainfall_max_mm"])
    + [T.StructField("rainfall_qualifier", _S), T.StructField("wind_speed_kmh", _D)]
    + [T.StructField(n, _S) for n in ("wind_direction", "weather_condition")]
    + [T.StructField("warnings", T.ArrayType(_S)), T.StructField("advisory_text", _S)]
)
