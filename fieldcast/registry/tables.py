"""The model's tables derived from the given ones, in Spark and, for checking, in SQL.

Each `*_SQL` text is a list of common table expressions that defines the table of the
same name as the function beside it.
"""

from __future__ import annotations

import math
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.session import settle


_PLANS: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Drop the plans kept, so that a table written anew is listed anew; called before each registered query."""
    _PLANS.clear()


def planned(build):
    """Keep the plan (never the rows) a function builds, for as long as one query is put together."""
    @wraps(build)
    def reuse(spark: SparkSession, *args) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, id(spark), *args)
        if key not in _PLANS:
            _PLANS[key] = build(spark, *args)
        return _PLANS[key]

    return reuse


def stored(build, spark: SparkSession, *args, drop: tuple[str, ...] = ()) -> DataFrame:
    """Write the rows of a planned function once; for as long as the query is put together, all that build on it read them.

    Without the columns to `drop`, which then are not worked out either.
    """
    rows = settle(build(spark, *args).drop(*drop))
    _PLANS[(build.__name__, spark.sparkContext.applicationId, id(spark), *args)] = rows
    return rows


@planned
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(rows: list[tuple]) -> str:
    """Rows as SQL literals; every fraction is a double."""
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


ZONES_SQL = f"""zones AS (SELECT * FROM (VALUES {values(catalogs.zone_rows())})
  AS z(zone_id, zone_no, zone_name, focus_domain, south, north, west, east, center_lat, center_lon))"""

# --- hourly observations: three users make a station, 36 stations a zone -------------------
OBS_SQL = f"""{ZONES_SQL},
readings AS (
  SELECT user_id // 3 AS point_no, date_trunc('hour', ts) AS timestamp, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(round(100 * value) AS BIGINT) % 4000 AS cents FROM events),
hours AS (
  SELECT point_no, timestamp, CAST(sum(event_id) AS BIGINT) AS event_no, CAST(sum(k) % 100 AS INTEGER) AS k, (sum(cents) // count(*)) / 100.0e0 AS warmth,
    CAST(sum(k) // count(*) AS DOUBLE) AS mean_k, sum(CASE WHEN event_id % 11 = 0 THEN CAST(k % 30 AS DOUBLE) ELSE 0.0e0 END) AS rain, CAST(sum(event_id % 25) // count(*) AS DOUBLE) AS wind,
    max(event_id % 25 + k % 7) AS gust, CAST(sum(k % 5) // count(*) AS DOUBLE) AS soil, CAST(sum(event_id % 35) // count(*) AS DOUBLE) AS moisture,
    CAST(sum(k % 6) // count(*) AS DOUBLE) AS thirst, CAST(sum((7 * k) % 100) // count(*) AS DOUBLE) AS chance
  FROM readings GROUP BY 1, 2),
placed AS (
  SELECT *, (point_no // 36) % 15 + 1 AS zone_no, point_no % 36 AS slot, hour(timestamp) AS h,
    300.0e0 + 20 * ((37 * point_no) % 23) AS elevation_m, 5.0e0 + warmth AS temperature_2m_c
  FROM hours),
obs AS (
  SELECT printf('GRID_%03d', point_no) AS point_id, zone_id, timestamp, point_no, event_no, k,
    round(south + 0.1e0 + 0.36e0 * (slot // 6) + 0.005e0 * ((point_no // 540) % 20), 4) AS latitude,
    round(west + 0.1e0 + 0.36e0 * (slot % 6), 4) AS longitude,
    elevation_m, temperature_2m_c,
    mean_k + 1.0e0 AS relative_humidity_2m_pct,
    1013.0e0 - elevation_m / 8.3e0 AS surface_pressure_hpa,
    rain AS precipitation_mm,
    wind AS wind_speed_10m_kmh,
    CAST(gust AS DOUBLE) AS wind_gusts_10m_kmh,
    round(greatest(0.0e0, 1000.0e0 * sin(pi() * (h - 6) / 12.0e0)), 3) AS solar_radiation_w_m2,
    0.9e0 * round(greatest(0.0e0, 1000.0e0 * sin(pi() * (h - 6) / 12.0e0)), 3) AS shortwave_radiation_w_m2,
    temperature_2m_c + soil - 2.0e0 AS soil_temperature_0_to_7cm_c,
    0.05e0 + moisture / 100.0e0 AS soil_moisture_0_to_7cm_m3m3,
    CASE WHEN h BETWEEN 6 AND 18 THEN 0.1e0 + thirst / 10.0e0 ELSE 0.0e0 END AS et0_evapotranspiration_mm,
    chance AS rain_probability_pct
  FROM placed JOIN zones USING (zone_no))"""


@planned
def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 3).alias("point_no"),
        F.date_trunc("hour", "ts").alias("timestamp"),
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    event, k, n = F.col("event_id"), F.col("k"), F.count(F.lit(1))
    cents = F.round(100 * F.col("value")).cast("bigint") % 4000
    mean = lambda x: F.floor(F.sum(x) / n).cast("double")
    # Every event of an hour counts: whole means of what is measured, sums of what falls.
    hours = events.groupBy("point_no", "timestamp").agg(
        F.sum(event).alias("event_no"), (F.sum(k) % 100).cast("int").alias("k"), (mean(cents) / 100.0).alias("warmth"), mean(k).alias("mean_k"),
        F.sum(F.when(event % 11 == 0, (k % 30).cast("double")).otherwise(0.0)).alias("rain"), mean(event % 25).alias("wind"), F.max(event % 25 + k % 7).alias("gust"),
        mean(k % 5).alias("soil"), mean(event % 35).alias("moisture"), mean(k % 6).alias("thirst"), mean((7 * k) % 100).alias("chance"),
    )
    placed = hours.withColumns({
        "zone_no": (F.floor(F.col("point_no") / 36) % 15 + 1).cast("int"), "slot": F.col("point_no") % 36, "h": F.hour("timestamp"), "elevation_m": 300.0 + 20.0 * ((37 * F.col("point_no")) % 23),
    })
    zones = catalogs.zones(spark).select("zone_no", "zone_id", "south", "west")
    h, temp = F.col("h"), 5.0 + F.col("warmth")
    sun = F.round(F.greatest(F.lit(0.0), 1000.0 * F.sin(F.lit(math.pi) * (h - 6) / 12.0)), 3)
    shift = 0.005 * (F.floor(F.col("point_no") / 540) % 20)
    return placed.join(F.broadcast(zones), "zone_no").select(
        F.format_string("GRID_%03d", "point_no").alias("point_id"),
        "zone_id", "timestamp", "point_no", "event_no", "k",
        F.round(F.col("south") + 0.1 + 0.36 * F.floor(F.col("slot") / 6) + shift, 4).alias("latitude"),
        F.round(F.col("west") + 0.1 + 0.36 * (F.col("slot") % 6), 4).alias("longitude"),
        "elevation_m",
        temp.alias("temperature_2m_c"),
        (F.col("mean_k") + 1.0).alias("relative_humidity_2m_pct"),
        (1013.0 - F.col("elevation_m") / 8.3).alias("surface_pressure_hpa"),
        F.col("rain").alias("precipitation_mm"),
        F.col("wind").alias("wind_speed_10m_kmh"),
        F.col("gust").cast("double").alias("wind_gusts_10m_kmh"),
        sun.alias("solar_radiation_w_m2"),
        (0.9 * sun).alias("shortwave_radiation_w_m2"),
        (temp + F.col("soil") - 2.0).alias("soil_temperature_0_to_7cm_c"),
        (0.05 + F.col("moisture") / 100.0).alias("soil_moisture_0_to_7cm_m3m3"),
        F.when(h.between(6, 18), 0.1 + F.col("thirst") / 10.0).otherwise(0.0).alias("et0_evapotranspiration_mm"),
        F.col("chance").alias("rain_probability_pct"),
    )


POINTS_SQL = f"""{OBS_SQL},
points AS (SELECT DISTINCT zone_id, point_id, point_no, latitude, longitude, elevation_m FROM obs)"""


@planned
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select(
        "zone_id", "point_id", "point_no", "latitude", "longitude", "elevation_m"
    ).distinct()


# --- baselines, used by many checks ---------------------------------------------------------
def loo_sql(source: str, columns: dict[str, str]) -> str:
    """Leave-one-out means as window expressions."""
    parts = [
        f"CASE WHEN count({c}) OVER hr > 1 THEN (sum({c}) OVER hr - {c}) / nullif(count({c}) OVER hr - 1, 0) ELSE {c} END AS {b}"
        for c, b in columns.items()
    ]
    return f"SELECT *, {', '.join(parts)} FROM {source} WINDOW hr AS (PARTITION BY zone_id, timestamp)"


BASED_SQL = f"""{OBS_SQL},
based AS ({loo_sql('obs', {'temperature_2m_c': 'baseline_temp_c'})})"""


# --- the series the stress indices read -----------------------------------------------------
SERIES_SQL = f"""{OBS_SQL},
series AS (
  SELECT zone_id, point_id, timestamp, event_no, temperature_2m_c + 0.3e0 * (event_no % 7 - 3) AS baseline_temp_c,
    temperature_2m_c AS downscaled_temp_1km_c, relative_humidity_2m_pct AS relative_humidity_pct,
    wind_speed_10m_kmh AS wind_speed_kmh, rain_probability_pct, precipitation_mm,
    soil_moisture_0_to_7cm_m3m3 AS soil_moisture_m3m3
  FROM obs)"""


@planned
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).select(
        "zone_id", "point_id", "timestamp", "event_no",
        (F.col("temperature_2m_c") + 0.3 * (F.col("event_no") % 7 - 3)).alias("baseline_temp_c"),
        F.col("temperature_2m_c").alias("downscaled_temp_1km_c"),
        F.col("relative_humidity_2m_pct").alias("relative_humidity_pct"),
        F.col("wind_speed_10m_kmh").alias("wind_speed_kmh"),
        "rain_probability_pct",
        "precipitation_mm",
        F.col("soil_moisture_0_to_7cm_m3m3").alias("soil_moisture_m3m3"),
    )


# --- daily records: a supplier is a station, a ship date a day ------------------------------
DAILY_SQL = """daily AS (
  SELECT printf('ST_%05d', l_suppkey) AS point_id, CAST(l_shipdate AS DATE) AS date,
    18.0e0 + max(l_quantity) * 0.6e0 AS tmax_c, 0.0e0 + min(l_quantity) * 0.35e0 AS tmin_c,
    round(max(l_discount) * 100) * 1.0e0 AS precipitation_mm, min(l_orderkey) AS order_no,
    arg_min(l_linestatus, l_orderkey * 100 + l_linenumber) AS status
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""


@planned
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        (18.0 + F.max("l_quantity") * 0.6).alias("tmax_c"),
        (0.0 + F.min("l_quantity") * 0.35).alias("tmin_c"),
        (F.round(F.max("l_discount") * 100) * 1.0).alias("precipitation_mm"),
        F.min("l_orderkey").alias("order_no"),
        F.min_by("l_linestatus", F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("status"),
    ).withColumn("point_id", F.format_string("ST_%05d", "l_suppkey")).drop("l_suppkey")


# --- locations: customers spread over northern India ----------------------------------------
CROP_OF_SEGMENT = [
    ("BUILDING", "Wheat"), ("AUTOMOBILE", "bajra "), ("MACHINERY", "COTTON"), ("HOUSEHOLD", "Mustard"),
    ("FURNITURE", "Millet"),
]
STAGES = ["Sowing", "Vegetative", "Flowering", "Maturity", "Tillering"]
LOCATIONS_SQL = f"""segment_crop AS (SELECT * FROM (VALUES {values(CROP_OF_SEGMENT)}) AS s(c_mktsegment, crop)),
locations AS (
  SELECT c_custkey AS ordinal, upper(split_part(c_name, '#', 1)) || '_' || printf('%05d', c_custkey) AS location_id,
    'Place ' || c_custkey % 700 AS name, 'गाँव ' || c_custkey AS name_hi,
    24 + (c_custkey % 1000) / 100.0e0 AS latitude, 73 + ((7 * c_custkey) % 800) / 100.0e0 AS longitude,
    200.0e0 + c_custkey % 400 AS elevation_m, coalesce(crop, 'Rice') AS crop,
    CASE c_custkey % 5 WHEN 0 THEN 'Sowing' WHEN 1 THEN 'Vegetative' WHEN 2 THEN 'Flowering' WHEN 3 THEN 'Maturity' ELSE 'Tillering' END AS crop_stage
  FROM customer LEFT JOIN segment_crop USING (c_mktsegment))"""


@planned
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = spark.createDataFrame(CROP_OF_SEGMENT, "c_mktsegment string, crop string")
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(F.broadcast(crops), "c_mktsegment", "left").select(
        key.alias("ordinal"),
        F.concat(F.upper(F.split("c_name", "#").getItem(0)), F.lit("_"), F.format_string("%05d", key)).alias("location_id"),
        F.concat(F.lit("Place "), (key % 700).cast("string")).alias("name"),
        F.concat(F.lit("गाँव "), key.cast("string")).alias("name_hi"),
        (24 + (key % 1000) / 100.0).alias("latitude"),
        (73 + ((7 * key) % 800) / 100.0).alias("longitude"),
        (200.0 + key % 400).alias("elevation_m"),
        F.coalesce("crop", F.lit("Rice")).alias("crop"),
        F.element_at(F.array(*[F.lit(s) for s in STAGES]), (key % 5 + 1).cast("int")).alias("crop_stage"),
    )


# --- elevation raster: 40 x 40 cells per tile of one degree ----------------------------------
#: Every third tile comes in two kinds that differ by seven metres.
DEM_SQL = """dem_cells AS (
  SELECT printf('T_%04d', p_partkey // 1600) AS tile, (p_partkey % 1600) // 40 AS row, p_partkey % 40 AS col,
    CASE WHEN p_partkey % 97 = 0 THEN -32768.0e0 ELSE 10.0e0 * p_size END AS z, p_partkey // 1600 AS tile_no
  FROM part),
dem AS (
  SELECT tile, CASE WHEN tile_no % 3 = 1 THEN 'cartodem_geotiff' ELSE 'srtm_hgt' END AS kind, row, col, z, -32768.0e0 AS nodata, tile_no FROM dem_cells
  UNION ALL SELECT tile, 'srtm_hgt', row, col, CASE WHEN z > -500 THEN z + 7 ELSE z END, -32768.0e0, tile_no FROM dem_cells WHERE tile_no % 3 = 1),
tiles AS (
  SELECT tile, kind, CASE WHEN kind = 'cartodem_geotiff' THEN 0 ELSE 1 END AS priority,
    73.0e0 + tile_no // 10 AS west, 24.0e0 + tile_no % 10 AS south,
    74.0e0 + tile_no // 10 AS east, 25.0e0 + tile_no % 10 AS north,
    max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, 1.0e0 / greatest(max(row), 1) AS px_lat, 1.0e0 / greatest(max(col), 1) AS px_lon,
    -32768.0e0 AS nodata
  FROM dem GROUP BY tile, kind, tile_no)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(
        F.floor(key / 1600).alias("tile_no"),
        F.format_string("T_%04d", F.floor(key / 1600)).alias("tile"),
        F.floor(key % 1600 / 40).alias("row"),
        (key % 40).alias("col"),
        F.when(key % 97 == 0, -32768.0).otherwise(10.0 * F.col("p_size")).alias("z"),
    )
    first, known = F.col("tile_no") % 3 == 1, F.col("z") > -500
    kinds = F.when(first, F.array(F.lit("cartodem_geotiff"), F.lit("srtm_hgt"))).otherwise(F.array(F.lit("srtm_hgt")))
    both = cells.withColumn("kind", F.explode(kinds))
    return both.withColumn("z", F.when((F.col("tile_no") % 3 == 1) & (F.col("kind") == "srtm_hgt") & known, F.col("z") + 7.0).otherwise(F.col("z")))


@planned
def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).drop("tile_no")


@planned
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("tile_no")
    return (
        _cells(spark, sf_dir)
        .groupBy("tile", "kind", "tile_no")
        .agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
        .select(
            "tile",
            "kind",
            F.when(F.col("kind") == "cartodem_geotiff", 0).otherwise(1).alias("priority"),
            (73.0 + F.floor(no / 10)).alias("west"),
            (24.0 + no % 10).alias("south"),
            (74.0 + F.floor(no / 10)).alias("east"),
            (25.0 + no % 10).alias("north"),
            (F.col("_r") + 1).alias("n_rows"),
            (F.col("_c") + 1).alias("n_cols"),
            (1.0 / F.greatest("_r", F.lit(1))).alias("px_lat"),
            (1.0 / F.greatest("_c", F.lit(1))).alias("px_lon"),
            F.lit(-32768.0).alias("nodata"),
        )
    )


# --- landed documents: one per station and day, as JSON text ----------------------------------
def weather_texts(spark: SparkSession, sf_dir: str, with_gusts: bool = True) -> DataFrame:
    """At most 24 readings per document. Every seventh station-day lacks its radiation series,
    every fifth lacks the gust series when `with_gusts` is off."""
    rows = obs(spark, sf_dir)
    from fieldcast.schemas import HOURLY_COLUMNS

    fields = [F.col(c).alias(v) for v, c in HOURLY_COLUMNS.items()]
    reading = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields,
        F.col("rain_probability_pct").alias("precipitation_probability"),
        (F.col("temperature_2m_c") - 8.0).alias("dew_point_2m"),
    )
    docs = rows.groupBy(
        "point_id", "zone_id", "latitude", "longitude", "elevation_m", "point_no", F.to_date("timestamp").alias("day")
    ).agg(F.sort_array(F.collect_list(reading)).alias("_r"))
    number = F.col("point_no") + F.dayofmonth("day")
    names = ["time", *HOURLY_COLUMNS, "precipitation_probability", "dew_point_2m"]
    arrays = {n: F.col(f"_r.{n}") for n in names}
    arrays["direct_normal_irradiance"] = F.when(number % 7 != 0, arrays["direct_normal_irradiance"])
    # A ragged series: the last reading of every third document is missing.
    ragged = F.slice(arrays["dew_point_2m"], 1, F.size("_r") - 1)
    arrays["dew_point_2m"] = F.when(number % 3 == 0, ragged).otherwise(arrays["dew_point_2m"])
    if not with_gusts:
        arrays["wind_gusts_10m"] = F.when(number % 5 != 0, arrays["wind_gusts_10m"])
    hourly = F.struct(*[v.alias(n) for n, v in arrays.items()])
    return docs.select(
        F.to_json(
            F.struct("point_id", "zone_id", "latitude", "longitude", F.col("elevation_m").alias("elevation"), hourly.alias("hourly"))
        ).alias("value")
    )


def daily_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily documents, one per station and month."""
    rows = daily(spark, sf_dir)
    day = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("time"),
        F.col("tmax_c").alias("temperature_2m_max"),
        F.col("tmin_c").alias("temperature_2m_min"),
        F.col("precipitation_mm").alias("precipitation_sum"),
        F.when(F.col("order_no") % 4 != 0, (F.col("order_no") % 101).cast("double")).alias("precipitation_probability_max"),
        F.when(F.col("order_no") % 3 != 0, (F.col("order_no") % 99).cast("double")).alias("weathercode"),
    )
    docs = rows.groupBy("point_id", F.date_trunc("month", "date").alias("_m")).agg(
        F.sort_array(F.collect_list(day)).alias("_d")
    )
    names = ["time", "temperature_2m_max", "temperature_2m_min", "precipitation_sum", "precipitation_probability_max", "weathercode"]
    parts = F.struct(*[F.col(f"_d.{n}").alias(n) for n in names])
    return docs.select(F.to_json(F.struct("point_id", parts.alias("daily")), {"ignoreNullFields": "false"}).alias("value"))


# --- bulletins: one sentence set per event ---------------------------------------------------
BULLETINS_SQL = r"""bulletins AS (
  SELECT event_id, concat_ws(chr(10),
    'District weather note', 'District: ' || event_type,
    'Valid: 0' || (1 + event_id % 9) || '-11-2027 to 1' || event_id % 9 || '-11-2027',
    'Sky: ' || CASE event_id % 3 WHEN 0 THEN 'Veiled sun' WHEN 1 THEN 'Clear' ELSE 'Rolling thunder' END || '.',
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE
      'Max Temp: ' || (28 + event_id % 9) || '-' || (30 + event_id % 9) || ' C, Min Temp: ' || (10 + event_id % 25) || '.5 C.' END,
    CASE event_id % 4 WHEN 0 THEN 'Rainfall: Nil.' WHEN 1 THEN 'Rainfall: ' || event_id % 40 || ' mm to ' || (20 + event_id % 40) || ' mm.'
      WHEN 2 THEN 'Rainfall: Light rainfall likely over the ridge.' ELSE NULL END,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Wind: ' || event_id % 30 || '-' || (10 + event_id % 30) || ' km/h North-Easterly.' END,
    CASE event_id % 6 WHEN 0 THEN 'Warnings: Nil' WHEN 1 THEN 'Warnings: Flash flood watch, No warning, Ground frost' WHEN 2 THEN 'Warning 1: Dense fog' || chr(10) || 'Warning 2: Strong gusts'
      ELSE NULL END,
    CASE WHEN event_id % 2 = 0 THEN 'Crop Advisory: Weed the rows of stage ' || event_id % 7 || '.' ELSE NULL END) AS raw_text
  FROM events)"""


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    lines = [
        F.lit("District weather note"),
        text("District: ", F.col("event_type")),
        text("Valid: 0", 1 + e % 9, "-11-2027 to 1", e % 9, "-11-2027"),
        text("Sky: ", F.when(e % 3 == 0, "Veiled sun").when(e % 3 == 1, "Clear").otherwise("Rolling thunder"), "."),
        F.when(e % 5 != 0, text("Max Temp: ", 28 + e % 9, "-", 30 + e % 9, " C, Min Temp: ", 10 + e % 25, ".5 C.")),
        F.when(e % 4 == 0, "Rainfall: Nil.")
        .when(e % 4 == 1, text("Rainfall: ", e % 40, " mm to ", 20 + e % 40, " mm."))
        .when(e % 4 == 2, "Rainfall: Light rainfall likely over the ridge."),
        F.when(e % 3 != 0, text("Wind: ", e % 30, "-", 10 + e % 30, " km/h North-Easterly.")),
        F.when(e % 6 == 0, "Warnings: Nil")
        .when(e % 6 == 1, "Warnings: Flash flood watch, No warning, Ground frost")
        .when(e % 6 == 2, "Warning 1: Dense fog\nWarning 2: Strong gusts"),
        F.when(e % 2 == 0, text("Crop Advisory: Weed the rows of stage ", e % 7, ".")),
    ]
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("\n", *lines).alias("raw_text"))
