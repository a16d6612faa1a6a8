"""Raster and lattice terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.operators import spatial, terrain
from fieldcast.operators.quality import first_known_elevation, valid_elevation
from fieldcast.plans import advisory
from fieldcast.registry import tables as t
from fieldcast.registry.aggregate_queries import PAIRS_SQL
from fieldcast.registry.base import query

c = F.col
PLACES = "latitude:d longitude:d"
RADII = (3000.0, 9000.0)

FRACTIONS_SQL = """sites AS (SELECT DISTINCT latitude, longitude FROM locations),
hit AS (SELECT * FROM (SELECT sites.*, tiles.*, row_number() OVER (PARTITION BY latitude, longitude ORDER BY priority, tile, kind) AS pick
  FROM sites JOIN tiles ON latitude BETWEEN south AND north AND longitude BETWEEN west AND east) WHERE pick = 1),
frac AS (SELECT *, (north - latitude) / px_lat - 0.5e0 AS row_f, (longitude - west) / px_lon - 0.5e0 AS col_f,
  px_lon * abs(111412.84e0 * cos(radians(latitude)) - 93.5e0 * cos(3 * radians(latitude))) AS dx_m,
  px_lat * abs(111132.92e0 - 559.82e0 * cos(2 * radians(latitude)) + 1.175e0 * cos(4 * radians(latitude))) AS dy_m FROM hit)"""
SITES_SQL = f"{t.LOCATIONS_SQL}, {t.DEM_SQL}, {FRACTIONS_SQL}"


def sites(spark, sf):
    return terrain.row_col(terrain.tile_for_points(t.locations(spark, sf), t.tiles(spark, sf)))


@query("r1_row_and_column", f"{PLACES} tile:s kind:s row_f:d col_f:d", f"WITH {SITES_SQL} SELECT * FROM frac")
def _(spark, sf):
    return sites(spark, sf)


@query("r2_filled_cells", "tile:s kind:s row:i col:i z_clean:d",
       f"""WITH {t.DEM_SQL} SELECT tile, kind, row, col, coalesce(CASE WHEN z BETWEEN -500 AND 9000 THEN z END, avg(CASE WHEN z BETWEEN -500 AND 9000 THEN z END)
       OVER (PARTITION BY tile, kind, row // 10, col // 10)) AS z_clean FROM dem""")
def _(spark, sf):
    cells = t.dem(spark, sf).withColumns({"wr": F.floor(c("row") / 10), "wc": F.floor(c("col") / 10)})
    return terrain.fill_window(cells, [*terrain.TILE, "wr", "wc"])


BOUND = "least(n_{a} - 2, greatest(0, CAST(floor({b}_f) AS BIGINT)))"


@query("r3_bilinear_elevation", f"{PLACES} elevation_m:d",
       f"""WITH {SITES_SQL}, k AS (SELECT *, {BOUND.format(a='rows', b='row')} AS r0, {BOUND.format(a='cols', b='col')} AS c0 FROM frac),
       w AS (SELECT *, least(1.0e0, greatest(0.0e0, row_f - r0)) AS fr, least(1.0e0, greatest(0.0e0, col_f - c0)) AS fc FROM k)
       , known AS (SELECT * REPLACE (CASE WHEN z BETWEEN -500 AND 9000 THEN z END AS z) FROM dem)
       SELECT latitude, longitude, (a.z * (1 - fc) + b.z * fc) * (1 - fr) + (d.z * (1 - fc) + e.z * fc) * fr AS elevation_m FROM w
       JOIN known a ON a.tile = w.tile AND a.kind = w.kind AND a.row = r0 AND a.col = c0 JOIN known b ON b.tile = w.tile AND b.kind = w.kind AND b.row = r0 AND b.col = c0 + 1
       JOIN known d ON d.tile = w.tile AND d.kind = w.kind AND d.row = r0 + 1 AND d.col = c0 JOIN known e ON e.tile = w.tile AND e.kind = w.kind AND e.row = r0 + 1 AND e.col = c0 + 1""")
def _(spark, sf):
    return terrain.bilinear(t.locations(spark, sf), t.dem(spark, sf), t.tiles(spark, sf))


def neighbours9(value: str = "z") -> str:
    """The eight cells around a cell as z00 .. z22."""
    parts = []
    for i in range(3):
        for j in range(3):
            parts.append(f"max({value}) FILTER (n.row = d.row + {i - 1} AND n.col = d.col + {j - 1}) AS z{i}{j}")
    return ", ".join(parts)


HORN_SQL = f"""{t.DEM_SQL}, known AS (SELECT * FROM dem WHERE z BETWEEN -500 AND 9000),
nine AS (SELECT d.tile, d.kind, d.row, d.col, count(*) AS cells, {neighbours9('n.z')} FROM known d JOIN known n ON n.tile = d.tile AND n.kind = d.kind AND n.row BETWEEN d.row - 1 AND d.row + 1
  AND n.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 9),
slopes AS (SELECT *, ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / 240.0e0 AS dz_east, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / 240.0e0 AS dz_south FROM nine)"""
ASPECT = "CASE WHEN NOT (abs({e}) < 1e-12 AND abs({s}) < 1e-12) THEN (degrees(atan2(-({e}), {s})) + 360) % 360 END"


@query("r4_horn_slope", "tile:s kind:s row:i col:i slope_deg:d",
       f"WITH {HORN_SQL} SELECT *, degrees(atan(sqrt(dz_east ** 2 + dz_south ** 2))) AS slope_deg FROM slopes")
def _(spark, sf):
    return terrain.horn_grid(t.dem(spark, sf), 30.0, 30.0)


@query("r5_downslope_aspect", "tile:s kind:s row:i col:i aspect_deg:d",
       f"WITH {HORN_SQL} SELECT *, {ASPECT.format(e='dz_east', s='dz_south')} AS aspect_deg FROM slopes")
def _(spark, sf):
    return terrain.horn_grid(t.dem(spark, sf), 30.0, 30.0)


@query("r6_topographic_position", "tile:s kind:s row:i col:i tpi_m:d",
       f"""WITH {t.DEM_SQL} SELECT d.tile, d.kind, d.row, d.col, any_value(CASE WHEN d.z BETWEEN -500 AND 9000 THEN d.z END) - avg(CASE WHEN n.z BETWEEN -500 AND 9000 THEN n.z END) AS tpi_m FROM dem d JOIN dem n ON n.tile = d.tile AND n.kind = d.kind
       AND n.row BETWEEN d.row - 3 AND d.row + 3 AND n.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return terrain.tpi_grid(t.dem(spark, sf), 3)


def _limits() -> str:
    """Window and box limits per axis, as the sampler defines them."""
    steps = []
    for axis, size, metres in (("row", "n_rows", "dy_m"), ("col", "n_cols", "dx_m")):
        pad = f"(CAST(ceil({RADII[1]}e0 / {metres}) AS BIGINT) + 2)"
        mid = f"CAST(round_even({axis}_f, 0) AS BIGINT)"
        steps.append(f"greatest(0, {mid} - {pad}) AS {axis}_lo0, least({size}, {mid} + {pad} + 1) AS {axis}_hi0")
    return ", ".join(steps)


def _boxes(i: int, radius: float) -> str:
    parts = []
    for axis, size, metres in (("row", "n_rows", "dy_m"), ("col", "n_cols", "dx_m")):
        reach = f"CAST(greatest(1, round_even({radius}e0 / {metres}, 0)) AS BIGINT)"
        parts.append(f"greatest(0, {axis}_mid - {reach}) AS {axis}_lo{i}, least({size}, {axis}_mid + {reach} + 1) AS {axis}_hi{i}")
    return ", ".join(parts)


def _inside(i: int) -> str:
    return f"row >= row_lo{i} AND row < row_hi{i} AND col >= col_lo{i} AND col < col_hi{i}"


def _at(r: str, col: str) -> str:
    return f"max(zc) FILTER (row = {r} AND col = {col})"


def sample_sql(head: str = SITES_SQL) -> str:
    nine = {f"z{i}{j}": _at(f"row_k + {i - 1}", f"col_k + {j - 1}") for i in range(3) for j in range(3)}
    corners = {f"q{i}{j}": _at(f"r0 + {i}", f"c0 + {j}") for i in range(2) for j in range(2)}
    cells = ", ".join(f"{v} AS {k}" for k, v in {**nine, **corners}.items())
    return f"""{head},
w0 AS (SELECT *, {_limits()} FROM frac WHERE n_rows >= 3 AND n_cols >= 3),
w1 AS (SELECT *, CAST(round_even(row_f - row_lo0, 0) AS BIGINT) + row_lo0 AS row_mid, CAST(round_even(col_f - col_lo0, 0) AS BIGINT) + col_lo0 AS col_mid,
  {BOUND.format(a='rows', b='row')} AS r0, {BOUND.format(a='cols', b='col')} AS c0 FROM w0),
w2 AS (SELECT *, least(n_rows - 2, greatest(1, row_mid)) AS row_k, least(n_cols - 2, greatest(1, col_mid)) AS col_k, least(1.0e0, greatest(0.0e0, row_f - r0)) AS fr,
  least(1.0e0, greatest(0.0e0, col_f - c0)) AS fc, {_boxes(1, RADII[0])}, {_boxes(2, RADII[1])} FROM w1),
cells AS (SELECT w2.*, dem.row, dem.col, CASE WHEN dem.z BETWEEN -500 AND 9000 THEN dem.z END AS zv FROM w2 JOIN dem ON dem.tile = w2.tile AND dem.kind = w2.kind AND {_inside(0)}),
clean AS (SELECT *, coalesce(zv, avg(zv) OVER (PARTITION BY latitude, longitude)) AS zc FROM cells),
facts AS (SELECT latitude, longitude, tile, kind, any_value(dx_m) AS dx, any_value(dy_m) AS dy, any_value(fr) AS fr, any_value(fc) AS fc, {cells},
  avg(zc) FILTER ({_inside(1)}) AS m1, avg(zc) FILTER ({_inside(2)}) AS m2 FROM clean GROUP BY latitude, longitude, tile, kind),
grads AS (SELECT *, (q00 * (1 - fc) + q01 * fc) * (1 - fr) + (q10 * (1 - fc) + q11 * fc) * fr AS elevation_m,
  ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / (8 * dx) AS e, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / (8 * dy) AS s FROM facts),
terrain AS (SELECT latitude, longitude, tile, kind AS source, elevation_m, degrees(atan(sqrt(e * e + s * s))) AS slope_magnitude_deg, {ASPECT.format(e='e', s='s')} AS aspect_deg,
  elevation_m - m1 AS tpi_3000m, elevation_m - m2 AS tpi_9000m FROM grads)"""


SAMPLE = "elevation_m:d slope_magnitude_deg:d aspect_deg:d aspect_sin:d aspect_cos:d tpi_3000m:d tpi_9000m:d source:s note:s"
SAMPLED_SQL = """sampled AS (SELECT l.location_id, l.latitude, l.longitude, t.elevation_m, t.slope_magnitude_deg, t.aspect_deg, t.tpi_3000m, t.tpi_9000m,
  CASE WHEN t.slope_magnitude_deg IS NULL THEN NULL WHEN t.aspect_deg IS NULL THEN 0 ELSE sin(radians(t.aspect_deg)) END AS aspect_sin,
  CASE WHEN t.slope_magnitude_deg IS NULL THEN NULL WHEN t.aspect_deg IS NULL THEN 0 ELSE cos(radians(t.aspect_deg)) END AS aspect_cos, coalesce(h.kind, 'none') AS source,
  CASE WHEN h.tile IS NULL THEN 'outside every elevation tile' WHEN t.slope_magnitude_deg IS NULL THEN 'no full ring of cells around this place'
    WHEN t.aspect_deg IS NULL THEN 'level ground has no aspect' ELSE '' END AS note
  FROM locations l LEFT JOIN terrain t USING (latitude, longitude) LEFT JOIN hit h USING (latitude, longitude))"""


def sampled(spark, sf):
    return terrain.sample_terrain(t.locations(spark, sf), t.dem(spark, sf), t.tiles(spark, sf), RADII)


@query("r7_terrain_sample", f"location_id:s {SAMPLE}", f"WITH {sample_sql()}, {SAMPLED_SQL} SELECT * FROM sampled")
def _(spark, sf):
    return sampled(spark, sf)


@query("r8_nearest_cell", "location_id:s tile:s kind:s row:d col:d elevation_m:d",
       f"""WITH {t.LOCATIONS_SQL}, {t.DEM_SQL}, p AS (SELECT location_id, tile, kind, least(n_rows - 1, greatest(0, CAST(trunc((1 - (latitude - floor(latitude))) * (n_rows - 1)) AS BIGINT))) AS row,
       least(n_cols - 1, greatest(0, CAST(trunc((longitude - floor(longitude)) * (n_cols - 1)) AS BIGINT))) AS col
       FROM locations LEFT JOIN (SELECT * FROM tiles QUALIFY row_number() OVER (PARTITION BY south, west ORDER BY priority, tile, kind) = 1) ON floor(latitude) = south AND floor(longitude) = west)
       SELECT p.location_id, p.tile, p.kind, CASE WHEN p.tile IS NOT NULL THEN p.row END AS row, CASE WHEN p.tile IS NOT NULL THEN p.col END AS col, CASE WHEN z > -500 AND z < 9000 THEN z END AS elevation_m
       FROM p LEFT JOIN dem ON dem.tile = p.tile AND dem.kind = p.kind AND dem.row = p.row AND dem.col = p.col""")
def _(spark, sf):
    found = terrain.nearest_cell(t.locations(spark, sf).drop("elevation_m"), t.dem(spark, sf), t.tiles(spark, sf))
    covered = c("tile").isNotNull()
    return found.withColumns({"row": F.when(covered, c("row")), "col": F.when(covered, c("col"))})


def lattice_sql(radius: str) -> str:
    return f"""{PAIRS_SQL.format(radius=radius)},
lattice AS (SELECT p.zone_id, p.point_id, p.latitude, p.longitude, CASE WHEN neighbours IS NULL THEN 0 ELSE p.elevation_m - mean_neighbour_elevation_m END AS topographic_position_index,
  CASE WHEN neighbours IS NULL THEN 0.5e0 ELSE degrees(atan(sqrt(gradient_ns ** 2 + gradient_ew ** 2))) END AS slope_magnitude_deg,
  CASE WHEN neighbours IS NULL THEN 0 ELSE sin(atan2(gradient_ns, gradient_ew)) END AS aspect_sin,
  CASE WHEN neighbours IS NULL THEN 1 ELSE cos(atan2(gradient_ns, gradient_ew)) END AS aspect_cos
  FROM points p LEFT JOIN around USING (zone_id, point_id))"""


LATTICE = "topographic_position_index:d slope_magnitude_deg:d aspect_sin:d aspect_cos:d"


@query("r9_lattice_terrain", f"point_id:s {LATTICE}", f"WITH {t.POINTS_SQL}, {lattice_sql('0.45e0')} SELECT * FROM lattice")
def _(spark, sf):
    return spatial.lattice_terrain(t.points(spark, sf), spatial.FLEET_RADIUS_DEG, ["zone_id"])


PLACED_SQL = sample_sql() + f""", {SAMPLED_SQL},
points AS (SELECT 'ALL' AS zone_id, location_id AS point_id, latitude, longitude, elevation_m FROM locations)"""


@query("r10_terrain_with_fallback", f"point_id:s terrain_source:s {LATTICE}",
       f"""WITH {PLACED_SQL}, {lattice_sql('0.28e0')}
       SELECT l.point_id, CASE WHEN s.slope_magnitude_deg IS NULL THEN 'lattice' ELSE s.source END AS terrain_source,
         CASE WHEN s.slope_magnitude_deg IS NULL THEN l.topographic_position_index ELSE s.tpi_9000m END AS topographic_position_index, coalesce(s.slope_magnitude_deg, l.slope_magnitude_deg) AS slope_magnitude_deg,
         CASE WHEN s.slope_magnitude_deg IS NULL THEN l.aspect_sin ELSE s.aspect_sin END AS aspect_sin, CASE WHEN s.slope_magnitude_deg IS NULL THEN l.aspect_cos ELSE s.aspect_cos END AS aspect_cos
       FROM lattice l JOIN sampled s ON s.location_id = l.point_id""")
def _(spark, sf):
    points = t.locations(spark, sf).select(
        F.lit("ALL").alias("zone_id"), c("location_id").alias("point_id"), "latitude", "longitude", "elevation_m"
    )
    raster = terrain.sample_terrain(points, t.dem(spark, sf), t.tiles(spark, sf), RADII)
    lattice = spatial.lattice_terrain(points, 0.28, ["zone_id"])
    return terrain.with_lattice_fallback(raster, lattice, ["zone_id", "point_id"])


SOIL = "elevation_m:d slope_magnitude_deg:d aspect_deg:d tpi_300m:d soil_moisture_m3m3:d moisture_status:s"
SOIL_SQL = f"""soil AS (SELECT location_id, round(coalesce(elevation_m, 300) + 1e-9, 1) AS elevation_m, round(coalesce(slope_magnitude_deg, 0) + 1e-9, 2) AS slope_magnitude_deg,
  round(coalesce(aspect_deg, 0) + 1e-9, 1) AS aspect_deg, round(coalesce(tpi_3000m, 0) + 1e-9, 2) AS tpi_300m, m AS soil_moisture_m3m3,
  CASE WHEN m < 0.12e0 THEN '{advisory.DRY_TEXT}' WHEN m < 0.22e0 THEN '{advisory.MOIST_TEXT}' WHEN m >= 0.22e0 THEN '{advisory.WET_TEXT}' END AS moisture_status
  FROM (SELECT *, CASE WHEN ordinal % 6 > 0 THEN 0.05e0 + ordinal % 25 / 100.0e0 END AS m FROM sampled JOIN (SELECT location_id, ordinal FROM locations) USING (location_id)))"""


def soil(spark, sf):
    rows = sampled(spark, sf)
    nudged = rows.withColumns({x: c(x) + 1e-9 for x in ("elevation_m", "slope_magnitude_deg", "aspect_deg", "tpi_3000m")})
    moist = nudged.withColumnRenamed("tpi_3000m", "tpi_300m").withColumn("m", F.when(c("ordinal") % 6 > 0, 0.05 + c("ordinal") % 25 / 100.0))
    return advisory.soil_context(moist, "m")


@query("r11_soil_and_terrain", f"location_id:s {SOIL}", f"WITH {sample_sql()}, {SAMPLED_SQL}, {SOIL_SQL} SELECT * FROM soil")
def _(spark, sf):
    return soil(spark, sf)


@query("d11_soil_context", f"location_id:s {SOIL}", f"WITH {sample_sql()}, {SAMPLED_SQL}, {SOIL_SQL} SELECT * FROM soil")
def _(spark, sf):
    return soil(spark, sf)


@query("p20_valid_elevation", "tile:s kind:s row:i col:i elevation_m:d",
       f"WITH {t.DEM_SQL} SELECT *, CASE WHEN z - 60 BETWEEN -500 AND 9000 AND z <> nodata THEN z - 60 END AS elevation_m FROM dem")
def _(spark, sf):
    return t.dem(spark, sf).withColumn("elevation_m", valid_elevation(c("z") - 60.0, F.lit(-32828.0)))


@query("p21_first_known_elevation", "location_id:s elevation_m:d with_constant:d",
       f"""WITH {t.LOCATIONS_SQL}, p AS (SELECT location_id, CASE WHEN ordinal % 3 = 0 THEN elevation_m WHEN ordinal % 3 = 1 THEN 500.0e0 END AS elevation_m FROM locations)
       SELECT *, coalesce(elevation_m, 400.0e0) AS with_constant FROM p""")
def _(spark, sf):
    document = F.when(c("ordinal") % 3 == 0, c("elevation_m"))
    service = F.when(c("ordinal") % 3 == 1, F.lit(500.0))
    return t.locations(spark, sf).select(
        "location_id", first_known_elevation(document, service).alias("elevation_m"),
        first_known_elevation(document, service, 400.0).alias("with_constant"),
    )
