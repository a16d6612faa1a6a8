"""Zone routing, regular lattices, neighbourhoods and footprint matching.

Range conditions are turned into equality on grid cells before they are checked exactly,
so no plan here needs a nested-loop join. A crowded cell is dealt out as pairs of lots of its
two sides, so no join key holds more than a bounded number of rows of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast import catalogs

# --- fixed values ----------------------------------------------------------------------
METRES_PER_DEGREE_NS = 111000.0
METRES_PER_DEGREE_EW = 100000.0
TRAINING_RADIUS_DEG = 0.28
FLEET_RADIUS_DEG = 0.45
LATTICE_INSET_DEG = 0.1
#: Rows of one side that may share a cell before it is cut into lots.
CROWD = 2000
#: Sides of footprint cells are powers of two of a degree between these.
FINEST, COARSEST = -10, 9
NO_NEIGHBOURS = {"tpi": 0.0, "slope": 0.5, "aspect_sin": 0.0, "aspect_cos": 1.0}


def zone_number(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """(zone number, inside a box?): first box in catalogue order, else the nearest centroid.

    The catalogue has fifteen rows, so both tests are plain expressions without a join.
    """
    boxes, distances = [], []
    for _, no, _, _, south, north, west, east, lat, lon in catalogs.zone_rows():
        inside = latitude.between(south, north) & longitude.between(west, east)
        boxes.append(F.when(inside, F.lit(no)))
        gap = (F.lit(lat) - latitude) * (F.lit(lat) - latitude) + (F.lit(lon) - longitude) * (
            F.lit(lon) - longitude
        )
        distances.append(F.struct(gap.alias("gap"), F.lit(no).alias("no")))
    boxed = F.coalesce(*boxes)
    nearest = F.array_min(F.array(*distances)).getField("no")
    return F.coalesce(boxed, nearest), boxed.isNotNull()


def route(points: DataFrame) -> DataFrame:
    """Add zone number, id, name, focus, exactness, live flag and deployment notice."""
    number, exact = zone_number(F.col("latitude"), F.col("longitude"))
    live = F.col("zone_id") == catalogs.LIVE_ZONE
    zones = catalogs.zones(points.sparkSession).select("zone_no", "zone_id", "zone_name", "focus_domain")
    return (
        points.withColumns({"zone_no": number, "in_exact_bounds": exact})
        .join(F.broadcast(zones), "zone_no", "left")
        .withColumns({"is_live_deployment_zone": live, "deployment_notice": deployment_notice(live)})
    )


def deployment_notice(live: Column) -> Column:
    return F.when(live, F.lit(catalogs.LIVE_NOTICE)).otherwise(
        F.format_string(catalogs.OTHER_NOTICE, F.col("zone_name"))
    )


def box_lattice(boxes: DataFrame, key: list[str], step_deg: float) -> DataFrame:
    """Regular points over south..north and west..east, both ends included, row-major ids."""
    def steps(low: str, high: str) -> Column:
        return F.ceil((F.col(high) + step_deg / 2 - F.col(low)) / step_deg).cast("int")

    rows = boxes.withColumns({"_rows": steps("south", "north"), "_cols": steps("west", "east")})
    grid = rows.withColumn("_row", F.explode(F.expr("sequence(0, _rows - 1)"))).withColumn(
        "_col", F.explode(F.expr("sequence(0, _cols - 1)"))
    )
    return grid.select(
        *key,
        F.format_string("GRID_%03d", F.col("_row") * F.col("_cols") + F.col("_col") + 1).alias("point_id"),
        F.round(F.col("south") + F.col("_row") * F.lit(step_deg), 4).alias("latitude"),
        F.round(F.col("west") + F.col("_col") * F.lit(step_deg), 4).alias("longitude"),
    )


def zone_lattice(requests: DataFrame) -> DataFrame:
    """`points_count` evenly spread points per zone: a square lattice cut after that many.

    A zone that is not in the catalogue has no box: its points keep null coordinates.
    """
    zones = catalogs.zones(requests.sparkSession).select(
        "zone_id", "zone_name", "south", "north", "west", "east"
    )
    sized = requests.join(F.broadcast(zones), "zone_id", "left").withColumn(
        "_side", F.ceil(F.sqrt("points_count")).cast("int")
    )
    grid = sized.withColumn("_no", F.explode(F.expr("sequence(0, int(points_count) - 1)")))

    def place(low: str, high: str, index: Column) -> Column:
        gap = (F.col(high) - F.col(low) - 2 * LATTICE_INSET_DEG) / F.greatest(F.col("_side") - 1, F.lit(1))
        return F.round(F.col(low) + LATTICE_INSET_DEG + index * gap, 4)

    return grid.select(
        F.format_string("%s_PT_%03d", F.col("zone_id"), F.col("_no") + 1).alias("point_id"),
        place("south", "north", F.floor(F.col("_no") / F.col("_side"))).alias("latitude"),
        place("west", "east", F.col("_no") % F.col("_side")).alias("longitude"),
        "zone_id",
        "zone_name",
    )


def _cell(value: str, size: float) -> Column:
    return F.floor(F.col(value) / size)


def _around(value: str, size: float) -> Column:
    cell = _cell(value, size)
    return F.explode(F.array(cell - 1, cell, cell + 1))


def meet_in_cells(left: DataFrame, right: DataFrame, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """Inner join on cells in which a crowded cell becomes many keys.

    Where a cell has more than `crowd` rows on a side, that side falls into lots and the other is
    copied to each: every pair still meets once, in a key of about `crowd` rows a side. Only the
    crowded cells are listed, of which there are few.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    lots = sizes.select(*keys, *[F.ceil(F.col(n) / crowd).cast("int").alias(m) for n, m in (("_l", "_lots_l"), ("_r", "_lots_r"))]).filter("_lots_l > 1 or _lots_r > 1")

    def dealt(side: DataFrame, own: str, own_lots: str, other: str, other_lots: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.coalesce(own_lots, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other_lots, F.lit(1)) - 1))
        return side.join(lots, keys, "left").withColumn(own, mine).withColumn(other, copies).drop("_lots_l", "_lots_r")

    a, b = dealt(left, "_i", "_lots_l", "_j", "_lots_r"), dealt(right, "_j", "_lots_r", "_i", "_lots_l")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def _within(left: DataFrame, right: DataFrame, domain: list[str], radius: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of different coordinates at most `radius` degrees apart; `right` columns start with n_."""
    near = right.withColumns({"_row": _cell("n_latitude", radius), "_col": _cell("n_longitude", radius)})
    asked = left.withColumn("_row", _around("latitude", radius)).withColumn("_col", _around("longitude", radius))
    d_lat = F.col("n_latitude") - F.col("latitude")
    d_lon = F.col("n_longitude") - F.col("longitude")
    pairs = meet_in_cells(asked, near, [*domain, "_row", "_col"], crowd).withColumns(
        {"d_lat": d_lat, "d_lon": d_lon, "distance_deg": F.sqrt(d_lat * d_lat + d_lon * d_lon)}
    )
    return pairs.filter((F.col("distance_deg") > 0) & (F.col("distance_deg") <= radius)).drop("_row", "_col")


def _sites(points: DataFrame, domain: list[str]) -> DataFrame:
    """One row per coordinate: how many points share it and the sum of their elevations."""
    return points.groupBy(*domain, "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("n_count"), F.sum("elevation_m").alias("n_sum")
    )


def neighbours(points: DataFrame, radius: float, domain: list[str] | None = None, crowd: int = CROWD) -> DataFrame:
    """Pairs of different coordinates within `radius` degrees.

    The neighbouring side carries the number of points there and their elevation sum, so
    points piled on one coordinate appear once instead of pairing with each other's neighbours.
    """
    domain = domain or []
    sites = _sites(points, domain)
    other = sites.withColumnsRenamed({"latitude": "n_latitude", "longitude": "n_longitude"})
    return _within(sites.drop("n_count", "n_sum"), other, domain, radius, crowd)


def _pull(delta: str, metres: float) -> Column:
    """Signed inverse distance in one direction, guarded near zero."""
    return F.signum(delta) / F.greatest(F.lit(1e-5), F.abs(F.col(delta) * metres))


def neighbourhood(points: DataFrame, radius: float, domain: list[str] | None = None, crowd: int = CROWD) -> DataFrame:
    """Mean neighbour elevation and mean N-S / E-W gradients of each point.

    Points that share a coordinate are first merged into one site with a count and an
    elevation sum. All three means are linear in those, so a pile of points at one place
    meets its neighbours as a single row and no pair of points is ever formed.
    """
    domain = domain or []
    pairs = neighbours(points, radius, domain, crowd).withColumns(
        {"_ns": _pull("d_lat", METRES_PER_DEGREE_NS), "_ew": _pull("d_lon", METRES_PER_DEGREE_EW)}
    )
    count, total = F.col("n_count"), F.col("n_sum")
    around = pairs.groupBy(*domain, "latitude", "longitude").agg(
        F.sum(count).alias("neighbours"),
        F.sum(total).alias("_z"),
        F.sum(total * F.col("_ns")).alias("_z_ns"),
        F.sum(count * F.col("_ns")).alias("_n_ns"),
        F.sum(total * F.col("_ew")).alias("_z_ew"),
        F.sum(count * F.col("_ew")).alias("_n_ew"),
    )
    own = F.col("elevation_m")
    return (
        points.join(around, [*domain, "latitude", "longitude"], "left")
        .withColumns(
            {
                "neighbours": F.coalesce("neighbours", F.lit(0)),
                "mean_neighbour_elevation_m": F.col("_z") / F.col("neighbours"),
                "gradient_ns": (F.col("_z_ns") - own * F.col("_n_ns")) / F.col("neighbours"),
                "gradient_ew": (F.col("_z_ew") - own * F.col("_n_ew")) / F.col("neighbours"),
            }
        )
        .drop("_z", "_z_ns", "_n_ns", "_z_ew", "_n_ew")
    )


def lattice_terrain(points: DataFrame, radius: float, domain: list[str] | None = None) -> DataFrame:
    """Terrain estimated from neighbouring points; a lonely point gets the neutral values.

    `lattice_angle` is the uphill direction counted from east, not a compass aspect.
    """
    near = neighbourhood(points, radius, domain)
    alone = F.col("neighbours") == 0
    ns, ew = F.col("gradient_ns"), F.col("gradient_ew")
    angle = F.atan2(ns, ew)

    def pick(key: str, value: Column) -> Column:
        return F.when(alone, F.lit(NO_NEIGHBOURS[key])).otherwise(value)

    return near.withColumns(
        {
            "topographic_position_index": pick("tpi", F.col("elevation_m") - F.col("mean_neighbour_elevation_m")),
            "slope_magnitude_deg": pick("slope", F.degrees(F.atan(F.sqrt(ns * ns + ew * ew)))),
            "lattice_angle": angle,
            "aspect_sin": pick("aspect_sin", F.sin(angle)),
            "aspect_cos": pick("aspect_cos", F.cos(angle)),
        }
    )


def _level(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The finest cell size, as a power of two of a degree, that no side of a footprint exceeds."""
    side = F.greatest(east - west, north - south, F.lit(2.0**FINEST))
    return F.least(F.ceil(F.log2(side)).cast("int"), F.lit(COARSEST))


def covering(points: DataFrame, boxes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Join points to the boxes (west, south, east, north) that cover them, edges included.

    A box lies in cells of about its own size, at most four of them, so a large footprint is not
    cut into many cells and a small one does not meet points far away. Points ask the cell they lie
    in once for every size that occurs; sizes are a bounded number. Rows without all their
    coordinates match nothing.
    """
    edges = [F.col(e) for e in ("west", "south", "east", "north")]
    sized = boxes.withColumn("_size", _level(*edges)).filter("_size is not null and west <= east and south <= north")
    levels = sorted(r[0] for r in sized.select("_size").distinct().collect())
    step = F.pow(F.lit(2.0), F.col("_size"))

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / step), F.floor(high / step)))

    covers = sized.withColumn("_row", cells(edges[1], edges[3])).withColumn("_col", cells(edges[0], edges[2]))
    asked = points.withColumn("_size", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    asked = asked.withColumns({"_row": F.floor(F.col("latitude") / step), "_col": F.floor(F.col("longitude") / step)})
    hit = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(
        F.col("west"), F.col("east")
    )
    return meet_in_cells(asked, covers, ["_size", "_row", "_col"], crowd).filter(hit).drop("_size", "_row", "_col")


def overlapping_scenes(
    scenes: DataFrame,
    box: tuple[float, float, float, float],
    start: str | None = None,
    end: str | None = None,
    online_only: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """All scenes that touch a box (west, south, east, north) and a time span.

    With `limit` the newest so many, a top-k report planned as TakeOrderedAndProject.
    """
    west, south, east, north = box
    found = scenes.filter(
        (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    )
    if start:
        found = found.filter(F.col("acquired") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        found = found.filter(F.col("acquired") <= F.lit(end).cast("timestamp_ntz"))
    if online_only:
        found = found.filter(F.col("online") == "Y")
    return found if limit is None else found.orderBy(F.desc("acquired"), "scene_id").limit(limit)


def bounding_box(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(by or [])).agg(
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
    )
