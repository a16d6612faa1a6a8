"""Scans and sinks. Landed documents are rebuilt from the given tables as JSON text."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fieldcast.plans import extraction
from fieldcast.registry import tables as t
from fieldcast.registry.base import query
from fieldcast.schemas import HOURLY_COLUMNS, OBS_HOURLY
from fieldcast.session import shared_folder, spread
from fieldcast.sources import bulletins, files, rasters, satellites, weather

c = F.col
ID = "point_id:s timestamp:t"
WEATHER = " ".join(f"{x}:d" for x in HOURLY_COLUMNS.values())
NUMBER = "(point_no + day(timestamp))"


def solar_gap(fallback: str) -> str:
    return f"* REPLACE (CASE WHEN {NUMBER} % 7 = 0 THEN {fallback} ELSE solar_radiation_w_m2 END AS solar_radiation_w_m2)"


@query("s1_archive_documents", f"{ID} zone_id:s latitude:d longitude:d elevation_m:d {WEATHER}",
       f"WITH {t.OBS_SQL} SELECT {solar_gap('NULL')} FROM obs")
def _(spark, sf):
    docs, _ = weather.split_empty(weather.parse_documents(t.weather_texts(spark, sf)))
    return weather.archive_rows(docs)


@query("s2_gust_fallback", f"{ID} wind_gusts_10m_kmh:d",
       f"WITH {t.OBS_SQL} SELECT * REPLACE (CASE WHEN {NUMBER} % 5 = 0 THEN wind_speed_10m_kmh ELSE wind_gusts_10m_kmh END AS wind_gusts_10m_kmh) FROM obs")
def _(spark, sf):
    return weather.archive_rows(weather.parse_documents(t.weather_texts(spark, sf, with_gusts=False)))


@query("s3_forecast_documents", f"{ID} elevation_m:d solar_radiation_w_m2:d precipitation_probability_pct:d dew_point_2m_c:d",
       f"""WITH {t.OBS_SQL}, f AS (SELECT {solar_gap('shortwave_radiation_w_m2')}, row_number() OVER (PARTITION BY zone_id, point_id, CAST(timestamp AS DATE) ORDER BY timestamp DESC) AS from_end FROM obs)
       SELECT *, rain_probability_pct AS precipitation_probability_pct, CASE WHEN {NUMBER} % 3 = 0 AND from_end = 1 THEN NULL ELSE temperature_2m_c - 8 END AS dew_point_2m_c FROM f""")
def _(spark, sf):
    return weather.forecast_rows(weather.parse_documents(t.weather_texts(spark, sf)))


@query("s4_daily_documents", "point_id:s date:y tmax_c:d tmin_c:d precipitation_mm:d rain_probability_pct:i weather_code:i",
       f"""WITH {t.DAILY_SQL} SELECT *, CASE WHEN order_no % 4 = 0 THEN 0 ELSE order_no % 101 END AS rain_probability_pct,
       CASE WHEN order_no % 3 = 0 THEN 0 ELSE order_no % 99 END AS weather_code FROM daily""")
def _(spark, sf):
    return weather.daily_rows(weather.parse_documents(t.daily_texts(spark, sf)))


@query("s5_climate_history", "point_id:s date:y tmax_c:d tmin_c:d precipitation_mm:d source:s", f"WITH {t.DAILY_SQL} SELECT *, 'archive' AS source FROM daily")
def _(spark, sf):
    return weather.climate_rows(weather.parse_documents(t.daily_texts(spark, sf)))


@query("s6_first_existing_table", "event_type:s rows:i", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def _(spark, sf):
    found = files.read_first(spark, [f"{sf}/events_clean.parquet", f"{sf}/events_patched.csv", f"{sf}/events.parquet"])
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


ROUND_TRIP = f"{ID} zone_id:s latitude:d elevation_m:d {WEATHER}"


def table_rows(spark, sf):
    return t.obs(spark, sf).select(*[f.name for f in OBS_HOURLY])


@query("s7_csv_scan", ROUND_TRIP, f"WITH {t.OBS_SQL} SELECT * FROM obs")
def _(spark, sf):
    path = shared_folder(spark) + ".csv"
    files.write_csv(table_rows(spark, sf), path)
    return files.read_first(spark, [path + ".absent", path])


@query("s8_zone_parquet_sink", ROUND_TRIP, f"WITH {t.OBS_SQL} SELECT * FROM obs")
def _(spark, sf):
    path = shared_folder(spark)
    files.write_zones(table_rows(spark, sf), path)
    return spark.read.parquet(path)


@query("s9_csv_sink", "zone_id:s rows:i rain_mm:d", f"WITH {t.OBS_SQL} SELECT zone_id, count(*) AS rows, sum(precipitation_mm) AS rain_mm FROM obs GROUP BY 1")
def _(spark, sf):
    path = shared_folder(spark)
    files.write_csv(table_rows(spark, sf), path)
    back = files.read_csv(spark, path, OBS_HOURLY)
    return back.groupBy("zone_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("precipitation_mm").alias("rain_mm"))


@query("s10_json_sink", ROUND_TRIP, f"WITH {t.OBS_SQL} SELECT * FROM obs")
def _(spark, sf):
    path = shared_folder(spark)
    files.write_json(table_rows(spark, sf), path)
    return spark.read.schema(OBS_HOURLY).json(path)


SQUARE = "grid AS (SELECT tile, kind, i // 40 AS row, i % 40 AS col FROM (SELECT DISTINCT tile, kind FROM dem) CROSS JOIN (SELECT unnest(range(1600)) AS i))"


def squares(spark, sf):
    """Every cell of the 40 x 40 squares, those without data as nodata, with its two bytes in hex."""
    cells = t.dem(spark, sf)
    square = cells.select("tile", "kind").distinct().select("tile", "kind", F.explode(F.expr("sequence(0L, 1599L)")).alias("_i"))
    square = square.select("tile", "kind", F.floor(c("_i") / 40).alias("row"), (c("_i") % 40).alias("col"))
    filled = square.join(cells, ["tile", "kind", "row", "col"], "left").withColumn("z", F.coalesce("z", F.lit(-32768.0)))
    return filled.withColumn("h", F.lpad(F.hex(F.pmod(c("z").cast("int"), F.lit(65536))), 4, "0"))


def packed(spark, sf):
    """Tiles of 40 x 40 cells as big-endian 16-bit numbers."""
    cells = squares(spark, sf).groupBy("tile", "kind").agg(F.sort_array(F.collect_list(F.struct("row", "col", "h"))).alias("_c"))
    return cells.select("tile", "kind", F.array_join(F.transform("_c", lambda x: x["h"]), "").alias("h"))


@query("s12_raster_cells", "tile:s kind:s row:i col:i z:d",
       f"WITH {t.DEM_SQL}, {SQUARE} SELECT tile, kind, row, col, coalesce(z, -32768.0e0) AS z FROM grid LEFT JOIN dem USING (tile, kind, row, col) WHERE kind = 'srtm_hgt'")
def _(spark, sf):
    raw = packed(spark, sf).filter("kind = 'srtm_hgt'")
    return rasters.decode_tiles(raw.select("tile", "kind", F.unhex("h").alias("content")))


def tagged(spark, sf):
    """The tiles as big-endian GeoTIFF files: one strip, cells of 1/39 degree, the corner as a tie point, nodata as text."""
    def entry(tag: int, kind: int, count: int, value: str) -> str:
        return f"{tag:04X}{kind:04X}{count:08X}{value}"

    # Eleven entries end at 8 + 2 + 132 + 4; scale, tie point, keys and nodata follow, then the cells.
    scale_at, tie_at, keys_at, text_at, cells_at = 146, 170, 218, 234, 242
    rows = [
        entry(256, 3, 1, "00280000"), entry(257, 3, 1, "00280000"), entry(258, 3, 1, "00100000"), entry(259, 3, 1, "00010000"), entry(273, 4, 1, f"{cells_at:08X}"),
        entry(279, 4, 1, f"{3200:08X}"), entry(339, 3, 1, "00020000"), entry(33550, 12, 3, f"{scale_at:08X}"), entry(33922, 12, 6, f"{tie_at:08X}"),
        entry(34735, 3, 8, f"{keys_at:08X}"), entry(42113, 2, 7, f"{text_at:08X}"),
    ]
    number = lambda v: struct.pack(">d", v).hex().upper()
    before = "4D4D002A00000008" + f"{len(rows):04X}" + "".join(rows) + "00000000" + number(1 / 39) * 2 + number(0.0) * 4
    after = number(0.0) + "00010001000000010400000000010002" + "-32768\0".encode().hex().upper() + "00"
    # Corners are whole degrees on a small sheet, so their eight bytes come from a table.
    bytes_of = F.create_map(*[F.lit(x) for v in range(-180, 181) for x in (float(v), number(float(v)))])
    placed = packed(spark, sf).join(t.tiles(spark, sf).select("tile", "kind", "west", "north"), ["tile", "kind"]).filter("kind = 'cartodem_geotiff'")
    content = F.concat(F.lit(before), bytes_of[c("west")], bytes_of[c("north")], F.lit(after), c("h"))
    return placed.select("tile", "kind", F.concat(F.lit("/dem/"), "tile", F.lit(".tif")).alias("path"), F.unhex(content).alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))


@query("s12_geotiff_cells", "tile:s kind:s row:i col:i z:d",
       f"WITH {t.DEM_SQL}, {SQUARE} SELECT tile, kind, row, col, coalesce(z, -32768.0e0) AS z FROM grid LEFT JOIN dem USING (tile, kind, row, col) WHERE kind = 'cartodem_geotiff'")
def _(spark, sf):
    return rasters.decode_tiles(tagged(spark, sf))


@query("s13_geotiff_catalogue", "tile:s kind:s priority:i west:d north:d east:d south:d n_rows:i n_cols:i px_lat:d nodata:d",
       f"""WITH {t.DEM_SQL} SELECT tile, kind, 0 AS priority, west, north, west + 40 / 39.0e0 AS east, north - 40 / 39.0e0 AS south, 40 AS n_rows, 40 AS n_cols, 1 / 39.0e0 AS px_lat, -32768.0e0 AS nodata
       FROM tiles WHERE kind = 'cartodem_geotiff'""")
def _(spark, sf):
    return rasters.catalogue(tagged(spark, sf))


PATHS_SQL = """paths AS (SELECT p_partkey, '/dem/' || CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'S' END || printf('%02dE%03d', p_size, p_partkey % 180) || '_' || p_partkey ||
  CASE p_partkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.hgt' WHEN 2 THEN '.HGT' ELSE '.txt' END AS path, CASE p_partkey % 5 WHEN 0 THEN 25934402 WHEN 1 THEN 2884803 ELSE 2884802 END AS length FROM part)"""


@query("s13_tile_catalogue", "tile:s kind:s priority:i south:d west:d north:d east:d n_rows:i px_lat:d",
       f"""WITH {PATHS_SQL} SELECT regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS tile, 'srtm_hgt' AS kind, 1 AS priority, s AS south, w AS west, s + 1 AS north, w + 1 AS east, side AS n_rows, 1.0e0 / (side - 1) AS px_lat
       FROM (SELECT paths.*, CASE WHEN p_partkey % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END * p_size AS s, 1.0e0 * (p_partkey % 180) AS w, CASE WHEN length >= 25934402 THEN 3601 ELSE 1201 END AS side
       FROM paths JOIN part USING (p_partkey)) WHERE p_partkey % 4 IN (1, 2) AND length % 2 = 0""")
def _(spark, sf):
    key = c("p_partkey")
    name = F.format_string("%s%02dE%03d_%d", F.when(key % 2 == 0, "N").otherwise("S"), c("p_size"), key % 180, key)
    suffix = F.when(key % 4 == 0, ".tif").when(key % 4 == 1, ".hgt").when(key % 4 == 2, ".HGT").otherwise(".txt")
    size = F.when(key % 5 == 0, 25934402).when(key % 5 == 1, 2884803).otherwise(2884802)
    listing = t.table(spark, sf, "part").select(F.concat(F.lit("/dem/"), name, suffix).alias("path"), size.alias("length"))
    return rasters.catalogue(listing)


#: The entities of the given pages.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def _clean_sql(block: str) -> str:
    """The strings between the tags of a block, each without white space around it."""
    body = "s"
    for entity, char in ENTITIES:
        body = f"replace({body}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    strings = f"list_transform(string_split_regex({block}, '<[^>]*>'), lambda s: regexp_replace({body}, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_filter({strings}, lambda s: s <> ''), ' ')"


def _paragraph_sql(tags: str, least: int) -> str:
    """Blocks up to the next tag of a block. The given pages have none within another."""
    ends = "|".join(sorted(bulletins.BLOCKS | {"html"}))
    marked = f"regexp_replace(page, '(?i)(</?(?:{ends})\\b)', chr(1) || '\\1', 'g')"
    pieces = f"list_filter(string_split({marked}, chr(1)), lambda b: regexp_matches(b, '(?is)^<(?:{tags})(?:\\s[^>]*)?>'))"
    return f"list_filter(list_transform({pieces}, lambda b: {_clean_sql('b')}), lambda x: length(x) >= {least})"


@query("s14_bulletin_pages", "page_id:i raw_text:s source:s source_status:s district:s",
       rf"""WITH p AS (SELECT page_id, url, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS page FROM pages),
       found AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN {_paragraph_sql('p|td|li', 31)} ELSE {_paragraph_sql('p|td', 60)} END AS parts FROM p)
       SELECT page_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10) || chr(10)) END AS raw_text, 'IMD_AGROMET_BULLETIN' AS source,
       CASE WHEN len(parts) > 0 THEN 'live' ELSE 'empty' END AS source_status, url AS district FROM found""")
def _(spark, sf):
    # Every third page carries a marked bulletin container around its body.
    wrapped = F.concat(F.lit("<p>outside the bulletin, long enough to be taken for a paragraph of it</p><div class='x bulletin-content'>"), c("html"),
                       F.lit("</div><p>after the bulletin, long enough to be taken for a paragraph of it too</p>"))
    pages = spread(t.table(spark, sf, "pages")).withColumn("html", F.when(c("page_id") % 3 == 0, wrapped).otherwise(c("html")))
    rows = bulletins.from_pages(pages, "html", " imd_agromet_bulletin ", {"district": c("url"), "language": F.lit("en")})
    return rows.withColumn("district", c("metadata")["district"])


@query("s15_json_bulletins", "event_id:i raw_text:s source:s station:s source_status:s",
       """SELECT event_id, '{"station":"S' || user_id || '","condition":"' || event_type || '","code":' || event_id % 100 || '}' AS raw_text, 'IMD_NOWCAST' AS source,
       'S' || user_id AS station, 'live' AS source_status FROM events""")
def _(spark, sf):
    replies = t.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("S"), c("user_id").cast("string")).alias("station"), c("event_type").alias("condition"), (c("event_id") % 100).alias("code")
    )
    return bulletins.from_replies(replies, ["station", "condition", "code"], "imd_nowcast", {"station_id": c("station")})


GRANULE = """SELECT s_suppkey, '3RIMG_' || s_suppkey AS identifier, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2026-09-01 00:00:00' + to_hours(CAST(s_suppkey % 500 AS INTEGER)) END AS updated,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 70.0e0 + s_suppkey % 20 END AS west FROM supplier"""


def granule_texts(spark, sf):
    key = c("s_suppkey")
    stamp = F.date_format(F.timestamp_add("HOUR", (key % 500).cast("int"), F.lit("2026-09-01 00:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    west = (70.0 + key % 20).cast("string")
    box = F.struct(west.alias("west"), F.lit("20.0").alias("south"), F.lit("95.0").alias("east"), F.lit("30.0").alias("north"))
    other = F.struct(F.lit("1").alias("west"), F.lit("2").alias("south"), F.lit("3").alias("east"), F.lit("4").alias("north"))
    entry = F.struct(
        F.concat(F.lit("3RIMG_"), key.cast("string")).alias("identifier"), key.cast("string").alias("id"),
        F.when(key % 5 == 0, "yesterday").otherwise(stamp).alias("updated"),
        F.when(key % 3 != 0, F.array(box, other)).otherwise(F.array().cast("array<struct<west:string,south:string,east:string,north:string>>")).alias("boundbox"),
    )
    doc = F.struct(F.lit("3RIMG_L2B_CMK").alias("dataset_id"), F.array(entry).alias("entries"))
    return t.table(spark, sf, "supplier").select(F.to_json(doc).alias("value"))


@query("s16_granules", "identifier:s granule_id:s dataset_id:s summary:s updated:t west:d",
       f"SELECT identifier, CAST(s_suppkey AS VARCHAR) AS granule_id, '3RIMG_L2B_CMK' AS dataset_id, '' AS summary, updated, west FROM ({GRANULE})")
def _(spark, sf):
    return satellites.parse_granules(granule_texts(spark, sf))


@query("s17_catalogue_items", "item_id:s collection:s longitude:d latitude:d acquired:t online:s satellite:s",
       """SELECT 'IT_' || s_suppkey AS item_id, 'EOS-04_SAR' AS collection, 73.0e0 + s_suppkey % 8 AS longitude, 24.0e0 + s_suppkey % 10 AS latitude,
       TIMESTAMP '2026-01-01 00:30:00' + to_days(CAST(s_suppkey % 200 AS INTEGER)) AS acquired, CASE WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END AS online, 'EOS-04' AS satellite FROM supplier""")
def _(spark, sf):
    key = c("s_suppkey")
    stamp = F.date_format(F.timestamp_add("DAY", (key % 200).cast("int"), F.lit("2026-01-01 00:30:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
    feature = F.struct(
        F.concat(F.lit("IT_"), key.cast("string")).alias("id"), F.lit("EOS-04_SAR").alias("collection"),
        F.struct(F.lit("Point").alias("type"), F.array(73.0 + key % 8, 24.0 + key % 10).alias("coordinates")).alias("geometry"),
        F.struct(F.concat(stamp, F.lit("+00:00")).alias("datetime"), F.when(key % 2 == 0, "Y").otherwise("N").alias("Online")).alias("properties"),
    )
    texts = t.table(spark, sf, "supplier").select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))
    return satellites.parse_items(texts)


@query("s18_telemetry_cache", "location_key:s cloud_fraction_pct:d cloud_top_temp_c:d satellite:s source_status:s",
       """SELECT CASE WHEN s_suppkey % 2 = 0 THEN printf('customer_%05d', s_suppkey) ELSE 'site' || s_suppkey END AS location_key, s_suppkey % 101 AS cloud_fraction_pct,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE -1.0e0 * (s_suppkey % 60) END AS cloud_top_temp_c, 'INSAT-3DR' AS satellite, 'cached' AS source_status FROM supplier""")
def _(spark, sf):
    from fieldcast.registry.join_queries import telemetry

    return telemetry(spark, sf)


# --- extraction ------------------------------------------------------------------------
EXTRACTED = (
    "district:s valid_from:s valid_to:s min_temp_c:d max_temp_c:d rainfall_min_mm:d rainfall_max_mm:d rainfall_qualifier:s wind_speed_kmh:d "
    "wind_direction:s weather_condition:s warnings:s advisory_text:s source_hash:s errors:s"
)
EXTRACTED_SQL = r"""SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS district, '0' || (1 + event_id % 9) || '-11-2027' AS valid_from,
  '1' || event_id % 9 || '-11-2027' AS valid_to, CASE WHEN event_id % 5 > 0 THEN 10.5e0 + event_id % 25 END AS min_temp_c, CASE WHEN event_id % 5 > 0 THEN 30 + event_id % 9 END AS max_temp_c,
  CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id % 40 END AS rainfall_min_mm, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 + event_id % 40 END AS rainfall_max_mm,
  CASE WHEN event_id % 4 = 2 THEN 'Light rainfall' END AS rainfall_qualifier, CASE WHEN event_id % 3 > 0 THEN 10 + event_id % 30 END AS wind_speed_kmh,
  CASE WHEN event_id % 3 > 0 THEN 'North-Easterly' END AS wind_direction, CASE event_id % 3 WHEN 0 THEN 'Veiled sun' WHEN 1 THEN 'Clear' ELSE 'Rolling thunder' END AS weather_condition,
  CASE event_id % 6 WHEN 1 THEN 'Flash flood watch|Ground frost' WHEN 2 THEN 'Dense fog|Strong gusts' ELSE '' END AS warnings,
  CASE WHEN event_id % 2 = 0 THEN 'Weed the rows of stage ' || event_id % 7 || '.' END AS advisory_text, substr(sha256(raw_text), 1, 16) AS source_hash,
  CASE WHEN event_id % 5 > 0 AND 10.5e0 + event_id % 25 > 30 + event_id % 9 THEN 'min_temp_c above max_temp_c' ELSE '' END AS errors
  FROM bulletins JOIN events USING (event_id)"""


def flat(rows):
    return rows.withColumns({"warnings": F.array_join("warnings", "|"), "errors": F.array_join("errors", ";")})


@query("d19_extract_bulletin", f"event_id:i {EXTRACTED}", f"WITH {t.BULLETINS_SQL} {EXTRACTED_SQL}")
def _(spark, sf):
    return flat(extraction.extract_bulletins(spread(t.bulletins(spark, sf))))


@query("d20_validate_extraction", "event_id:i min_temp_c:d max_temp_c:d warnings:s source_hash:s errors:s",
       f"""WITH {t.BULLETINS_SQL} SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id % 80 - 10 END AS min_temp_c, CASE WHEN event_id % 7 > 0 THEN 40 END AS max_temp_c,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Squall' END AS warnings, substr(sha256(raw_text), 1, 16) AS source_hash,
       CASE WHEN event_id % 7 = 0 THEN 'malformed JSON' ELSE concat_ws(';', CASE WHEN event_id % 80 - 10 > 60 THEN 'min_temp_c out of range' END,
         CASE WHEN event_id % 80 - 10 > 40 THEN 'min_temp_c above max_temp_c' END) END AS errors FROM bulletins""")
def _(spark, sf):
    e = c("event_id")
    body = F.concat(
        F.lit('{"district": "x", "min_temp_c": '), (e % 80 - 10).cast("string"), F.lit(', "max_temp_c": 40, "warnings": ["Nil", " Squall "]}')
    )
    reply = F.when(e % 7 == 0, F.lit("```json\n{broken\n```")).when(e % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return flat(extraction.validate_extractions(spread(t.bulletins(spark, sf)).withColumn("reply", reply)))
