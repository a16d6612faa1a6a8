"""Joins: per-hour and per-point attachment, zones, neighbours, lookups with defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast import catalogs
from fieldcast.functions import text
from fieldcast.operators import baselines, lookups, spatial, terrain
from fieldcast.plans import features, fleet, forecasts
from fieldcast.registry import tables as t
from fieldcast.registry.base import query

c = F.col


@query("j1_hourly_value_on_rows", "point_id:s timestamp:t mean_c:d",
       f"WITH {t.OBS_SQL}, m AS (SELECT zone_id, timestamp, avg(temperature_2m_c) AS mean_c FROM obs WHERE temperature_2m_c > 30 GROUP BY 1, 2) "
       "SELECT * FROM obs LEFT JOIN m USING (zone_id, timestamp)")
def _(spark, sf):
    rows = t.obs(spark, sf)
    means = baselines.hourly_mean(rows.filter("temperature_2m_c > 30"), "temperature_2m_c", "mean_c")
    return rows.join(means, features.DOMAIN_HOUR, "left")


@query("j2_point_terrain_with_defaults", "point_id:s timestamp:t topographic_position_index:d slope_magnitude_deg:d aspect_sin:d aspect_cos:d",
       f"""WITH {t.OBS_SQL} SELECT point_id, timestamp, CASE WHEN elevation_m < 450 THEN 0.0e0 ELSE elevation_m - 400 END AS topographic_position_index,
       CASE WHEN elevation_m < 450 THEN 0.5e0 ELSE point_no % 20 END AS slope_magnitude_deg, 0.0e0 AS aspect_sin, 1.0e0 AS aspect_cos FROM obs""")
def _(spark, sf):
    known = t.points(spark, sf).filter("elevation_m >= 450").withColumns(
        {
            "topographic_position_index": c("elevation_m") - 400.0, "slope_magnitude_deg": (c("point_no") % 20).cast("double"),
            "aspect_sin": F.lit(None).cast("double"), "aspect_cos": F.lit(None).cast("double"),
        }
    )
    return features.with_terrain(t.obs(spark, sf), known)


@query("j3_neighbours", "zone_id:s latitude:d longitude:d n_latitude:d n_longitude:d n_count:i distance_deg:d",
       f"""WITH {t.POINTS_SQL}, s AS (SELECT zone_id, latitude, longitude, count(*) AS n_count FROM points GROUP BY 1, 2, 3)
       SELECT a.*, b.latitude AS n_latitude, b.longitude AS n_longitude, b.n_count, sqrt((b.latitude - a.latitude) ** 2 + (b.longitude - a.longitude) ** 2) AS distance_deg
       FROM (SELECT zone_id, latitude, longitude FROM s) a JOIN s b ON a.zone_id = b.zone_id AND sqrt((b.latitude - a.latitude) ** 2 + (b.longitude - a.longitude) ** 2) > 0
         AND sqrt((b.latitude - a.latitude) ** 2 + (b.longitude - a.longitude) ** 2) <= 0.45e0""")
def _(spark, sf):
    return spatial.neighbours(t.points(spark, sf), 0.45, ["zone_id"])


ROUTE_SQL = f"""{t.LOCATIONS_SQL}, {t.ZONES_SQL},
boxed AS (SELECT location_id, min(zone_no) AS zone_no FROM locations JOIN zones ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east GROUP BY 1),
ranked AS (SELECT location_id, zone_no, row_number() OVER (PARTITION BY location_id ORDER BY (center_lat - latitude) * (center_lat - latitude) + (center_lon - longitude) * (center_lon - longitude), zone_no) AS r
  FROM locations CROSS JOIN zones),
routed AS (SELECT l.location_id, l.latitude, l.longitude, coalesce(b.zone_no, n.zone_no) AS zone_no, b.zone_no IS NOT NULL AS in_exact_bounds
  FROM locations l LEFT JOIN boxed b USING (location_id) JOIN (SELECT location_id, zone_no FROM ranked WHERE r = 1) n USING (location_id))"""


@query("j4_zone_box", "location_id:s zone_id:s", f"WITH {ROUTE_SQL} SELECT * FROM routed JOIN zones USING (zone_no) WHERE in_exact_bounds")
def _(spark, sf):
    return spatial.route(t.locations(spark, sf)).filter("in_exact_bounds")


@query("j5_nearest_centroid", "location_id:s zone_id:s in_exact_bounds:b", f"WITH {ROUTE_SQL} SELECT * FROM routed JOIN zones USING (zone_no)")
def _(spark, sf):
    return spatial.route(t.locations(spark, sf))


NOTICE_SQL = f"""CASE WHEN zone_id = 'ACZ_14' THEN '{catalogs.LIVE_NOTICE}' ELSE printf('{catalogs.OTHER_NOTICE}', zone_name) END AS deployment_notice"""


@query("d6_route_points", "location_id:s zone_id:s zone_name:s focus_domain:s in_exact_bounds:b is_live_deployment_zone:b deployment_notice:s",
       f"WITH {ROUTE_SQL} SELECT *, zone_id = 'ACZ_14' AS is_live_deployment_zone, {NOTICE_SQL} FROM routed JOIN zones USING (zone_no)")
def _(spark, sf):
    return spatial.route(t.locations(spark, sf))


@query("p18_live_zone_flag", "zone_id:s rows:i is_live_deployment_zone:b deployment_notice:s",
       f"WITH {t.OBS_SQL} SELECT zone_id, count(*) AS rows, zone_id = 'ACZ_14' AS is_live_deployment_zone, {NOTICE_SQL} FROM obs JOIN zones USING (zone_id) GROUP BY zone_id, zone_name")
def _(spark, sf):
    counts = t.obs(spark, sf).groupBy("zone_id").agg(F.count(F.lit(1)).alias("rows"))
    live = c("zone_id") == catalogs.LIVE_ZONE
    named = counts.join(F.broadcast(catalogs.zones(spark)), "zone_id")
    return named.withColumns({"is_live_deployment_zone": live, "deployment_notice": spatial.deployment_notice(live)})


@query("j6_point_in_tile", "location_id:s tile:s kind:s",
       f"""WITH {t.LOCATIONS_SQL}, {t.DEM_SQL}, hit AS (SELECT location_id, tile, kind, row_number() OVER (PARTITION BY location_id ORDER BY priority, tile, kind) AS r
       FROM locations JOIN tiles ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east) SELECT * FROM hit WHERE r = 1""")
def _(spark, sf):
    places = t.locations(spark, sf)
    return places.join(terrain.tile_for_points(places, t.tiles(spark, sf)), ["latitude", "longitude"])


@query("j7_tile_by_degree", "location_id:s tile:s kind:s",
       f"""WITH {t.LOCATIONS_SQL}, {t.DEM_SQL}, best AS (SELECT * FROM tiles QUALIFY row_number() OVER (PARTITION BY south, west ORDER BY priority, tile, kind) = 1)
       SELECT location_id, tile, kind FROM locations LEFT JOIN best ON floor(latitude) = south AND floor(longitude) = west""")
def _(spark, sf):
    return terrain.nearest_cell(t.locations(spark, sf), t.dem(spark, sf), t.tiles(spark, sf))


REQUESTS_SQL = """requests AS (SELECT c_custkey AS request_no, CASE c_custkey % 5 WHEN 0 THEN ' customer_' || printf('%05d', (c_custkey * 3) % 1500) || ' '
  WHEN 1 THEN 'PLACE ' || c_custkey % 900 WHEN 2 THEN 'गाँव ' || c_custkey WHEN 3 THEN 'customer' ELSE 'nowhere ' || c_custkey END AS identifier FROM customer)"""


def requests(spark, sf):
    key = c("c_custkey")
    word = (
        F.when(key % 5 == 0, F.format_string(" customer_%05d ", key * 3 % 1500))
        .when(key % 5 == 1, F.concat(F.lit("PLACE "), (key % 900).cast("string")))
        .when(key % 5 == 2, F.concat(F.lit("गाँव "), key.cast("string")))
        .when(key % 5 == 3, F.lit("customer"))
        .otherwise(F.concat(F.lit("nowhere "), key.cast("string")))
    )
    return t.table(spark, sf, "customer").select(key.alias("request_no"), word.alias("identifier"))


ALIAS_SQL = f"""{t.LOCATIONS_SQL},
alias AS (SELECT alias, arg_max(location_id, ordinal) AS location_id FROM (
  SELECT lower(location_id) AS alias, location_id, ordinal FROM locations UNION ALL SELECT lower(name), location_id, ordinal FROM locations
  UNION ALL SELECT name_hi, location_id, ordinal FROM locations UNION ALL SELECT lower(regexp_replace(location_id, '_[^_]*$', '')), location_id, ordinal FROM locations) GROUP BY 1),
{REQUESTS_SQL},
found AS (SELECT request_no, location_id, name, latitude FROM requests LEFT JOIN alias ON lower(trim(identifier)) = alias LEFT JOIN locations USING (location_id))"""


@query("j8_location_lookup", "request_no:i location_id:s name:s latitude:d", f"WITH {ALIAS_SQL} SELECT * FROM found")
def _(spark, sf):
    return lookups.find_locations(requests(spark, sf), t.locations(spark, sf))


CROP_SQL = f"""{t.LOCATIONS_SQL},
crops AS (SELECT * FROM (VALUES {t.values(catalogs.CROPS)}) AS c(crop_key, common_name, season, base_temp_c, optimal_temp_low_c, optimal_temp_high_c,
  critical_max_temp_c, optimal_vpd_low_kpa, optimal_vpd_high_kpa, advisory_notes)),
stages AS (SELECT * FROM (VALUES {t.values(catalogs.stage_rows())}) AS s(crop_key, stage, stage_ordinal, stage_water_demand, stage_critical_pest, stage_sensitivity)),
profiles AS (SELECT l.location_id, l.crop_stage, l.latitude, l.longitude, crops.*, coalesce(s.stage_water_demand, d.stage_water_demand) AS stage_water_demand,
  coalesce(s.stage_critical_pest, d.stage_critical_pest) AS stage_critical_pest, coalesce(s.stage_sensitivity, d.stage_sensitivity) AS stage_sensitivity,
  s.stage IS NOT NULL AS stage_matched
  FROM locations l JOIN crops ON crops.crop_key = coalesce((SELECT max(k.crop_key) FROM crops k WHERE k.crop_key = upper(trim(l.crop))), 'BAJRA')
  LEFT JOIN stages s ON s.crop_key = crops.crop_key AND s.stage = l.crop_stage JOIN stages d ON d.crop_key = crops.crop_key AND d.stage_ordinal = 3)"""
PROFILE = (
    "location_id:s crop_key:s common_name:s season:s base_temp_c:d critical_max_temp_c:d crop_stage:s stage_water_demand:s "
    "stage_critical_pest:s stage_sensitivity:s stage_matched:b"
)


@query("j9_crop_lookup", PROFILE, f"WITH {CROP_SQL} SELECT * FROM profiles")
def _(spark, sf):
    return lookups.crop_profiles(t.locations(spark, sf))


@query("d10_crop_profile",
       PROFILE + " optimal_temp_low_c:d optimal_temp_high_c:d optimal_vpd_low_kpa:d optimal_vpd_high_kpa:d advisory_notes:s disease:s condition:s",
       f"WITH {CROP_SQL}, triggers AS (SELECT * FROM (VALUES {t.values(catalogs.DISEASE_TRIGGERS)}) AS d(crop_key, disease, condition)) "
       "SELECT * FROM profiles LEFT JOIN triggers USING (crop_key)")
def _(spark, sf):
    return lookups.crop_triggers(lookups.crop_profiles(t.locations(spark, sf)))


BENCH_SQL = f"bench AS (SELECT 'ACZ_' || printf('%02d', no) AS zone_id, b, m, d FROM (VALUES {t.values(catalogs.ZONE_BENCHMARKS)}) AS q(no, b, m, d) WHERE no <> 99)"


@query("j10_zone_benchmark", "location_id:s zone_id:s baseline_rmse_c:d model_rmse_c:d error_reduction_pct:d",
       f"""WITH {ROUTE_SQL}, {BENCH_SQL}, z AS (SELECT location_id, CASE WHEN zone_no = 5 THEN 'ACZ_77' ELSE zone_id END AS zone_id FROM routed JOIN zones USING (zone_no))
       SELECT z.*, coalesce(b, 2.5e0) AS baseline_rmse_c, coalesce(m, 0.95e0) AS model_rmse_c, coalesce(d, 58.9e0) AS error_reduction_pct FROM z LEFT JOIN bench USING (zone_id)""")
def _(spark, sf):
    routed = spatial.route(t.locations(spark, sf)).select("location_id", "zone_no", "zone_id")
    unknown = routed.withColumn("zone_id", F.when(c("zone_no") == 5, "ACZ_77").otherwise(c("zone_id")))
    return lookups.with_benchmark(unknown)


@query("d7_zone_catalog", "zone_id:s zone_name:s center_lat:d center_lon:d stations:i baseline_rmse_c:d model_rmse_c:d error_reduction_pct:d is_live_deployment_zone:b",
       f"""WITH {ROUTE_SQL}, {BENCH_SQL}, n AS (SELECT zone_no, count(*) AS stations FROM routed GROUP BY 1)
       SELECT zones.*, coalesce(stations, 0) AS stations, b AS baseline_rmse_c, m AS model_rmse_c, d AS error_reduction_pct, zone_id = 'ACZ_14' AS is_live_deployment_zone
       FROM zones JOIN bench USING (zone_id) LEFT JOIN n USING (zone_no)""")
def _(spark, sf):
    placed = spatial.route(t.locations(spark, sf)).groupBy("zone_id").agg(F.count(F.lit(1)).alias("stations"))
    return forecasts.zone_catalog(spark).join(placed, "zone_id", "left").withColumn("stations", F.coalesce("stations", F.lit(0)))


@query("j11_archive_before_forecast", "point_id:s date:y tmax_c:d tmin_c:d precipitation_mm:d source:s",
       f"""WITH {t.DAILY_SQL}, a AS (SELECT *, 'archive' AS source FROM daily WHERE status = 'F'),
       f AS (SELECT point_id, date, tmax_c + 1 AS tmax_c, tmin_c, NULL AS precipitation_mm, 'forecast' AS source FROM daily WHERE precipitation_mm > 2),
       f2 AS (SELECT * FROM f WHERE tmin_c > 2)
       SELECT point_id, date, CASE WHEN a.source IS NULL THEN f2.tmax_c ELSE a.tmax_c END AS tmax_c, CASE WHEN a.source IS NULL THEN f2.tmin_c ELSE a.tmin_c END AS tmin_c,
         CASE WHEN a.source IS NULL THEN f2.precipitation_mm ELSE a.precipitation_mm END AS precipitation_mm, coalesce(a.source, f2.source) AS source
       FROM a FULL JOIN f2 USING (point_id, date)""")
def _(spark, sf):
    rows = t.daily(spark, sf)
    archive = rows.filter("status = 'F'").withColumn("source", F.lit("archive"))
    forecast = rows.filter("precipitation_mm > 2").withColumns(
        {
            "tmax_c": c("tmax_c") + 1, "tmin_c": F.when(c("tmin_c") > 2, c("tmin_c")),
            "precipitation_mm": F.lit(None).cast("double"), "source": F.lit("forecast"),
        }
    )
    return lookups.merge_daily(archive, forecast, ["point_id"])


TELEMETRY_SQL = """telemetry AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN printf('customer_%05d', s_suppkey) ELSE 'site' || s_suppkey END AS location_key,
  s_suppkey % 101 * 1.0e0 AS cloud_fraction_pct, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE -1.0e0 * (s_suppkey % 60) END AS cloud_top_temp_c, s_suppkey % 7 / 2.0e0 AS rainfall_rate_mmh FROM supplier)"""


def telemetry(spark, sf):
    from fieldcast.sources.satellites import telemetry_rows

    key = c("s_suppkey")
    cache = t.table(spark, sf, "supplier").select(
        F.when(key % 2 == 0, F.format_string("CUSTOMER_%05d", key)).otherwise(F.concat(F.lit("site"), key.cast("string"))).alias("location_key"),
        F.lit(None).cast("string").alias("satellite"), F.lit("3RIMG_L2B_CMK").alias("dataset_id"),
        F.lit("2026-09-01T06:00:00Z").alias("timestamp"), (key % 101 * 1.0).alias("cloud_fraction_pct"),
        F.when(key % 4 != 0, -1.0 * (key % 60)).alias("cloud_top_temp_c"), (key % 7 / 2.0).alias("rainfall_rate_mmh"),
    )
    return telemetry_rows(cache)


@query("j12_telemetry_lookup", "order_no:i cloud_fraction_pct:d cloud_top_temp_c:d rainfall_rate_mmh:d",
       f"""WITH {TELEMETRY_SQL}, asked AS (SELECT o_orderkey AS order_no, CASE WHEN o_orderkey % 2 = 0 THEN ' Customer_' || printf('%05d', o_custkey % 130) ELSE 'SITE' || o_custkey % 130 || '_001' END AS id FROM orders)
       SELECT order_no, coalesce(a.cloud_fraction_pct, b.cloud_fraction_pct) AS cloud_fraction_pct, CASE WHEN a.location_key IS NULL THEN b.cloud_top_temp_c ELSE a.cloud_top_temp_c END AS cloud_top_temp_c,
         coalesce(a.rainfall_rate_mmh, b.rainfall_rate_mmh) AS rainfall_rate_mmh
       FROM asked LEFT JOIN telemetry a ON a.location_key = lower(trim(id)) LEFT JOIN telemetry b ON b.location_key = split_part(lower(trim(id)), '_', 1)""")
def _(spark, sf):
    key, place = c("o_orderkey"), c("o_custkey") % 130
    name = F.when(key % 2 == 0, F.format_string(" Customer_%05d", place)).otherwise(F.concat(F.lit("SITE"), place.cast("string"), F.lit("_001")))
    asked = t.table(spark, sf, "orders").select(key.alias("order_no"), name.alias("id"))
    return lookups.with_telemetry(asked, telemetry(spark, sf), "id")


@query("d21_telemetry_by_name", "request_no:i location_id:s success:b cloud_fraction_pct:d attribution:s",
       f"""WITH {ALIAS_SQL}, {TELEMETRY_SQL}, f AS (SELECT request_no, found.location_id, coalesce(a.cloud_fraction_pct, b.cloud_fraction_pct) AS cloud_fraction_pct
       FROM found LEFT JOIN telemetry a ON a.location_key = lower(location_id) LEFT JOIN telemetry b ON b.location_key = split_part(lower(location_id), '_', 1))
       SELECT *, location_id IS NOT NULL AS success, CASE WHEN cloud_fraction_pct IS NOT NULL THEN '{catalogs.MOSDAC_ATTRIBUTION}' END AS attribution FROM f""")
def _(spark, sf):
    return fleet.telemetry_for(requests(spark, sf), t.locations(spark, sf), telemetry(spark, sf))


SCENES_SQL = """scenes AS (SELECT printf('SC_%07d', o_orderkey) AS scene_id, o_orderdate AS acquired, CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE 'Y' END AS online,
  70.0e0 + o_custkey % 20 AS west, 70.5e0 + o_custkey % 20 + (o_orderkey % 3) AS east, 20.0e0 + o_orderkey % 13 AS south, 20.4e0 + o_orderkey % 13 AS north FROM orders)"""


@query("j13_scene_overlap", "scene_id:s acquired:t west:d south:d",
       f"""WITH {SCENES_SQL} SELECT * FROM scenes WHERE west <= 77 AND east >= 75 AND south <= 28 AND north >= 26 AND online = 'Y' AND acquired >= TIMESTAMP '1996-01-01'
       AND acquired <= TIMESTAMP '2001-12-31'""")
def _(spark, sf):
    key = c("o_orderkey")
    scenes = t.table(spark, sf, "orders").select(
        F.format_string("SC_%07d", key).alias("scene_id"), c("o_orderdate").alias("acquired"), F.when(key % 4 == 0, "N").otherwise("Y").alias("online"),
        (70.0 + c("o_custkey") % 20).alias("west"), (70.5 + c("o_custkey") % 20 + key % 3).alias("east"),
        (20.0 + key % 13).alias("south"), (20.4 + key % 13).alias("north"),
    )
    return spatial.overlapping_scenes(scenes, (75.0, 26.0, 77.0, 28.0), "1996-01-01", "2001-12-31")


@query("j14_forecast_with_coarse_row", "point_id:s timestamp:t t_base:d downscaled_value:d t_proxy:d",
       f"""WITH {t.OBS_SQL} SELECT point_id, timestamp, temperature_2m_c AS t_base, temperature_2m_c + k / 100.0e0 AS downscaled_value,
       temperature_2m_c + -0.0065e0 * (elevation_m - 380) AS t_proxy FROM obs""")
def _(spark, sf):
    coarse = t.obs(spark, sf)
    served = coarse.withColumns(
        {"delta_elevation_m": c("elevation_m") - 380.0, "downscaled_value": c("temperature_2m_c") + c("k") / 100.0}
    )
    return fleet.serving_gap(served, coarse, features.POINT)


@query("j15_pending_points", "zone_id:s point_id:s",
       f"WITH {t.POINTS_SQL} SELECT zone_id, point_id FROM points WHERE point_id NOT IN (SELECT point_id FROM obs WHERE temperature_2m_c > 44.5e0)")
def _(spark, sf):
    landed = t.obs(spark, sf).filter("temperature_2m_c > 44.5")
    return lookups.pending(t.points(spark, sf), landed, features.POINT)


@query("j16_zone_model", "location_id:s model_path:s is_default_model:b",
       f"""WITH {ROUTE_SQL}, registry AS (SELECT DISTINCT zone_id, 'models/' || lower(zone_id) AS path FROM routed JOIN zones USING (zone_no) WHERE in_exact_bounds AND zone_no % 2 = 0)
       SELECT location_id, coalesce(path, 'models/acz_14') AS model_path, path IS NULL AS is_default_model FROM routed JOIN zones USING (zone_no) LEFT JOIN registry USING (zone_id)""")
def _(spark, sf):
    routed = spatial.route(t.locations(spark, sf))
    trained = routed.filter("in_exact_bounds and zone_no % 2 = 0").select("zone_id").distinct()
    registry = trained.withColumn("model_path", F.concat(F.lit("models/"), F.lower("zone_id")))
    return lookups.with_model(routed, registry, "models/acz_14")


ITEMS_SQL = """items AS (SELECT printf('IT_%06d', s_suppkey) AS item_id, CASE WHEN s_suppkey % 2 = 0 THEN 'EOS-04_SAR_SM' ELSE 'CartoSat-1_DEM' END AS collection,
  73.0e0 + s_suppkey % 8 AS longitude, 24.0e0 + s_suppkey % 10 AS latitude, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 30 / 100.0e0 END AS m FROM supplier)"""


def items(spark, sf):
    key = c("s_suppkey")
    return t.table(spark, sf, "supplier").select(
        F.format_string("IT_%06d", key).alias("item_id"), F.when(key % 2 == 0, "EOS-04_SAR_SM").otherwise("CartoSat-1_DEM").alias("collection"),
        (73.0 + key % 8).alias("longitude"), (24.0 + key % 10).alias("latitude"),
        F.when(key % 4 == 0, key % 30 / 100.0).alias("soil_moisture_m3_m3"),
    )


@query("d24_satellite_context", "location_id:s matched_items:i soil_moisture_m3_m3:d collections:s attribution:s",
       f"""WITH {t.LOCATIONS_SQL}, {ITEMS_SQL}, n AS (SELECT location_id, count(*) AS matched_items, avg(m) AS soil_moisture_m3_m3, string_agg(DISTINCT collection, ',' ORDER BY collection) AS collections
       FROM locations l JOIN items i ON l.latitude BETWEEN i.latitude - 0.25e0 AND i.latitude + 0.25e0 AND l.longitude BETWEEN i.longitude - 0.25e0 AND i.longitude + 0.25e0 GROUP BY 1)
       SELECT location_id, coalesce(matched_items, 0) AS matched_items, soil_moisture_m3_m3, collections, '{catalogs.BHOONIDHI_ATTRIBUTION}' AS attribution FROM locations LEFT JOIN n USING (location_id)""")
def _(spark, sf):
    return fleet.satellite_context(t.locations(spark, sf), items(spark, sf), ["location_id"])


@query("p16_normalised_names", "c_custkey:i zone_key:s title:s source:s",
       """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ACZ_' || printf('%02d', c_custkey % 15) WHEN 1 THEN 'ACZ_' || printf('%02d', c_custkey % 15) ELSE 'ACZ_X' || c_custkey % 15 END AS zone_key,
       'Village ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title, 'IMD_' || c_mktsegment AS source FROM customer""")
def _(spark, sf):
    key = c("c_custkey")
    raw = (
        F.when(key % 3 == 0, (key % 15).cast("string")).when(key % 3 == 1, F.format_string(" acz_%02d", key % 15))
        .otherwise(F.concat(F.lit("x"), (key % 15).cast("string")))
    )
    return t.table(spark, sf, "customer").select(
        "c_custkey", text.zone_key(raw).alias("zone_key"),
        text.title_case(F.concat(F.lit(" village "), c("c_mktsegment"), F.lit(" "))).alias("title"),
        F.upper(text.strip(F.concat(F.lit(" imd_"), c("c_mktsegment")))).alias("source"),
    )
