"""Terrain from elevation rasters held as a long table (tile, kind, row, col, z); row 0 is north.

A tile may come in several kinds; it is always known by its name and kind. Everything a
sample needs is linear in cells and in sums of rectangles. Sums run inside blocks of
cells, and only in blocks that a sample reads, so a few stations in a large tile touch a few
blocks of it; one join and one aggregation then serve the elevation, the slope kernel and every
neighbourhood mean, whatever the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcast.functions.physics import aspect_components, metres_per_degree
from fieldcast.operators.quality import valid_elevation
from fieldcast.operators.spatial import covering

TILE = ["tile", "kind"]
#: Cells along the side of a block of running sums.
BLOCK = 64
TPI_RADII_M = (300.0, 2000.0)
FLAT = 1e-12
NODATA = -32768.0
# Horn kernel: (row offset, col offset, weight of the eastward, weight of the southward change).
HORN = [
    (-1, -1, -1.0, -1.0), (-1, 0, 0.0, -2.0), (-1, 1, 1.0, -1.0),
    (0, -1, -2.0, 0.0), (0, 1, 2.0, 0.0),
    (1, -1, -1.0, 1.0), (1, 0, 0.0, 2.0), (1, 1, 1.0, 1.0),
]


def slope_and_aspect(dz_east: Column, dz_south: Column) -> tuple[Column, Column]:
    """Slope in degrees and downslope compass aspect; level ground has no aspect."""
    dz_north = -dz_south
    flat = (F.abs(dz_east) < FLAT) & (F.abs(dz_north) < FLAT)
    slope = F.degrees(F.atan(F.sqrt(dz_east * dz_east + dz_north * dz_north)))
    aspect = F.pmod(F.degrees(F.atan2(-dz_east, -dz_north)), F.lit(360.0))
    return slope, F.when(~flat, aspect)


def known_height(dem: DataFrame) -> Column:
    """The height of a cell, null where it is the tile's nodata value or impossible."""
    return valid_elevation(F.col("z"), F.col("nodata") if "nodata" in dem.columns else F.lit(NODATA))


def horn_grid(dem: DataFrame, dx_m: float, dy_m: float) -> DataFrame:
    """Slope and aspect of every cell that has all eight neighbours with known heights."""
    dem = dem.withColumn("z", known_height(dem))
    along = W.partitionBy(*TILE, "row").orderBy("col")
    across = W.partitionBy(*TILE, "col").orderBy("row")
    west, east = F.lag("z").over(along), F.lead("z").over(along)
    whole = (F.lag("col").over(along) == F.col("col") - 1) & (F.lead("col").over(along) == F.col("col") + 1)
    rows = dem.withColumns(
        {"_d": F.when(whole, east - west), "_s": F.when(whole, west + 2.0 * F.col("z") + east)}
    )
    stacked = (F.lag("row").over(across) == F.col("row") - 1) & (F.lead("row").over(across) == F.col("row") + 1)
    kernels = rows.withColumns(
        {
            "dz_east": F.when(
                stacked, (F.lag("_d").over(across) + 2.0 * F.col("_d") + F.lead("_d").over(across)) / (8.0 * dx_m)
            ),
            "dz_south": F.when(stacked, (F.lead("_s").over(across) - F.lag("_s").over(across)) / (8.0 * dy_m)),
        }
    ).filter("z is not null and dz_east is not null and dz_south is not null")
    slope, aspect = slope_and_aspect(F.col("dz_east"), F.col("dz_south"))
    return kernels.withColumns({"slope_deg": slope, "aspect_deg": aspect}).drop("_d", "_s")


def _sliding(value: str, spec: W, radius: int) -> Column:
    """Sum over -radius..radius as a difference of two running sums (constant work per cell)."""
    upto = F.sum(value).over(spec.rangeBetween(W.unboundedPreceding, radius))
    before = F.sum(value).over(spec.rangeBetween(W.unboundedPreceding, -radius - 1))
    return upto - F.coalesce(before, F.lit(0.0))


def tpi_grid(dem: DataFrame, radius: int) -> DataFrame:
    """Elevation minus the mean of the known heights in the square around each cell, clipped at the tile edge."""
    dem = dem.withColumn("z", known_height(dem))
    along = W.partitionBy(*TILE, "row").orderBy("col")
    across = W.partitionBy(*TILE, "col").orderBy("row")
    rows = dem.withColumns({"_one": F.col("z").isNotNull().cast("double"), "_k": F.coalesce("z", F.lit(0.0))}).withColumns(
        {"_z": _sliding("_k", along, radius), "_n": _sliding("_one", along, radius)}
    )
    boxes = rows.withColumns({"_zz": _sliding("_z", across, radius), "_nn": _sliding("_n", across, radius)})
    return boxes.withColumn("tpi_m", F.col("z") - F.col("_zz") / F.nullif(F.col("_nn"), F.lit(0.0))).drop("_one", "_k", "_z", "_n", "_zz", "_nn")


def fill_window(dem: DataFrame, by: list[str], nodata: float = -32768.0) -> DataFrame:
    """Replace invalid cells by the mean of the valid cells of their group."""
    clean = dem.withColumn("_ok", valid_elevation(F.col("z"), F.lit(nodata)))
    means = clean.groupBy(*by).agg(F.avg("_ok").alias("_mean"))
    return clean.join(means, by).withColumn("z_clean", F.coalesce("_ok", "_mean")).drop("_ok", "_mean")


def block_sums(cells: DataFrame) -> DataFrame:
    """Per cell (tile, kind, row, col, z, nodata): value, validity and sums over the rectangle from its block's north-west corner."""
    block = [*TILE, "_brow", "_bcol"]
    valid = valid_elevation(F.col("z"), F.col("nodata"))
    placed = cells.withColumns({"_brow": F.floor(F.col("row") / BLOCK), "_bcol": F.floor(F.col("col") / BLOCK), "_v": F.coalesce(valid, F.lit(0.0)), "_k": valid.isNotNull().cast("double")})
    # Dealt by block once; both windows then find their rows in place.
    dealt = placed.repartition(*block)
    along = W.partitionBy(*block, "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*block, "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumns({"_rv": F.sum("_v").over(along), "_rk": F.sum("_k").over(along)})
    return rows.select(
        *TILE, "row", "col", F.col("_v").alias("value"), F.col("_k").alias("known"), F.sum("_rv").over(across).alias("sum_value"), F.sum("_rk").over(across).alias("sum_known"),
    )


def tile_for_points(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """The preferred tile of each distinct coordinate (lowest `priority`, then name and kind)."""
    sites = points.select("latitude", "longitude").distinct()
    fields = [c for c in tiles.columns if c not in ("priority", *TILE)]
    record = F.struct("priority", *TILE, *fields)
    best = covering(sites, tiles).groupBy("latitude", "longitude").agg(F.min(record).alias("_best"))
    return best.select("latitude", "longitude", "_best.*")


def row_col(sites: DataFrame) -> DataFrame:
    """Fractional cell position of a coordinate inside its tile."""
    return sites.withColumns(
        {
            "row_f": (F.col("north") - F.col("latitude")) / F.col("px_lat") - 0.5,
            "col_f": (F.col("longitude") - F.col("west")) / F.col("px_lon") - 0.5,
        }
    )


def _bounded(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def _geometry(sites: DataFrame, radii: tuple[float, float]) -> DataFrame:
    """Window, kernel cell, bilinear corner and box limits of each site, in tile cells."""
    per_lon, per_lat = metres_per_degree(F.col("latitude"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sites = sites.withColumns({"dx_m": F.col("px_lon") * per_lon, "dy_m": F.col("px_lat") * per_lat})
    axes = [("row", "n_rows", "dy_m"), ("col", "n_cols", "dx_m")]
    for axis, size, metres in axes:
        at, n = F.col(f"{axis}_f"), F.col(size)
        pad = F.ceil(max(radii) / F.greatest(F.col(metres), F.lit(1e-6))) + 2
        centre = F.rint(at).cast("bigint")
        sites = sites.withColumn(f"{axis}_lo0", F.greatest(zero, centre - pad)).withColumn(
            f"{axis}_hi0", F.least(n, centre + pad + 1)
        )
        # Rounding happens relative to the window, as half-way cases depend on it.
        mid = F.rint(at - F.col(f"{axis}_lo0")).cast("bigint") + F.col(f"{axis}_lo0")
        corner = _bounded(F.floor(at), zero, n - 2)
        sites = sites.withColumns(
            {
                f"{axis}_mid": mid,
                f"{axis}_kernel": _bounded(mid, one, n - 2),
                f"{axis}_corner": corner,
                f"{axis}_share": F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - corner)),
            }
        )
        for i, radius in enumerate(radii, 1):
            reach = F.greatest(
                F.lit(1.0), F.rint(radius / F.greatest(F.col(metres), F.lit(1e-6)))
            ).cast("bigint")
            sites = sites.withColumns(
                {
                    f"{axis}_lo{i}": F.greatest(zero, F.col(f"{axis}_mid") - reach),
                    f"{axis}_hi{i}": F.least(n, F.col(f"{axis}_mid") + reach + 1),
                }
            )
    return sites


def _lookups(boxes: int) -> Column:
    """Cells a site reads, each with its weight in every result, as one array expression."""
    names = ["w_z", "w_east", "w_south"] + [f"w_box{i}" for i in range(boxes)]

    def cell(row: str, col: str, **weights: object) -> str:
        values = ", ".join(f"'{n}', double({weights.get(n, 0.0)})" for n in names)
        return f"named_struct('row', {row}, 'col', {col}, {values})"

    shares = {0: "(1 - {a}_share)", 1: "{a}_share"}
    cells = [
        cell(f"row_corner + {i}", f"col_corner + {j}", w_z=f"{shares[i].format(a='row')} * {shares[j].format(a='col')}")
        for i in (0, 1)
        for j in (0, 1)
    ]
    for dr, dc, east, south in HORN:
        cells.append(cell(f"row_kernel + {dr}", f"col_kernel + {dc}", w_east=east, w_south=south))
    parts = [f"array({', '.join(cells)})"]
    for i in range(boxes):
        # A rectangle is the sum of its pieces in each block it meets; of a piece's four corners those outside the block count nothing.
        def ends(axis: str) -> str:
            low, high = f"greatest({axis}_lo{i}, b * {BLOCK})", f"least({axis}_hi{i}, b * {BLOCK} + {BLOCK})"
            corners = f"array(named_struct('at', {high} - 1, 'w', 1.0D), named_struct('at', {low} - 1, 'w', -1.0D))"
            blocks = f"sequence({axis}_lo{i} div {BLOCK}, ({axis}_hi{i} - 1) div {BLOCK})"
            return f"flatten(transform({blocks}, b -> filter({corners}, x -> x.at >= b * {BLOCK})))"

        pair = cell("r.at", "c.at", **{f"w_box{i}": "r.w * c.w"})
        parts.append(f"flatten(transform({ends('row')}, r -> transform({ends('col')}, c -> {pair})))")
    return F.expr(f"concat({', '.join(parts)})")


def sample_terrain(
    points: DataFrame, dem: DataFrame, tiles: DataFrame, radii: tuple[float, float] = TPI_RADII_M
) -> DataFrame:
    """Add elevation, slope, aspect and two position indices to points (latitude, longitude).

    Points that share a coordinate are sampled once. No covering tile leaves nulls, with
    source `none` and a note; no value is ever made up.
    """
    boxes = len(radii) + 1
    located = _geometry(row_col(tile_for_points(points, tiles)), radii)
    sizes = [((F.col(f"row_hi{i}") - F.col(f"row_lo{i}")) * (F.col(f"col_hi{i}") - F.col(f"col_lo{i}"))).alias(f"_cells{i}") for i in range(boxes)]
    site = ["latitude", "longitude", *TILE, "dx_m", "dy_m", *[f"_cells{i}" for i in range(boxes)]]
    # A tile too small for the kernel keeps its site, with nothing to read.
    wanted = F.when((F.col("n_rows") >= 3) & (F.col("n_cols") >= 3), _lookups(boxes))
    asked = located.select("*", *sizes).select(*site, F.explode_outer(wanted).alias("_cell")).select(*site, "_cell.*")
    asked = asked.withColumns({"_brow": F.floor(F.col("row") / BLOCK), "_bcol": F.floor(F.col("col") / BLOCK)})
    block = [*TILE, "_brow", "_bcol"]
    cells = dem.drop("nodata").withColumns({"_brow": F.floor(F.col("row") / BLOCK), "_bcol": F.floor(F.col("col") / BLOCK)})
    needed = cells.join(asked.select(*block).distinct(), block, "left_semi").join(tiles.select(*TILE, "nodata"), TILE).drop("_brow", "_bcol")
    read = asked.join(block_sums(needed), [*TILE, "row", "col"], "left")
    gap = 1.0 - F.col("known")
    sums = []
    for name in ("z", "east", "south"):
        sums.append(F.sum(F.col(f"w_{name}") * F.col("value")).alias(f"_{name}"))
        sums.append(F.sum(F.col(f"w_{name}") * gap).alias(f"_{name}_gap"))
    for i in range(boxes):
        weight = F.col(f"w_box{i}")
        sums.append(F.sum(weight * F.col("sum_value")).alias(f"_sum{i}"))
        sums.append(F.sum(weight * F.col("sum_known")).alias(f"_known{i}"))
    facts = read.groupBy(*site).agg(*sums)
    # Invalid cells count with the mean of the valid cells of the widest window.
    mean = F.when(F.col("_known0") > 0.5, F.col("_sum0") / F.nullif(F.col("_known0"), F.lit(0.0)))

    def whole(name: str) -> Column:
        return F.col(f"_{name}") + F.when(F.abs(F.col(f"_{name}_gap")) < 1e-12, F.lit(0.0)).otherwise(
            F.col(f"_{name}_gap") * F.col("_mean")
        )

    facts = facts.withColumn("_mean", mean).withColumns(
        {
            "elevation_m": F.when(F.col("_known0") > 0.5, whole("z")),
            # Sums of whole-metre cells stay exact; only then are they divided.
            "dz_east": F.when(F.col("_known0") > 0.5, whole("east")) / (8.0 * F.col("dx_m")),
            "dz_south": F.when(F.col("_known0") > 0.5, whole("south")) / (8.0 * F.col("dy_m")),
        }
    )
    slope, aspect = slope_and_aspect(F.col("dz_east"), F.col("dz_south"))
    around = {
        f"tpi_{int(radius)}m": F.col("elevation_m")
        - (F.col(f"_sum{i}") + (F.col(f"_cells{i}") - F.col(f"_known{i}")) * F.col("_mean"))
        / F.nullif(F.col(f"_cells{i}"), F.lit(0.0))
        for i, radius in enumerate(radii, 1)
    }
    facts = facts.withColumns({"slope_magnitude_deg": slope, "aspect_deg": aspect, **around})
    facts = facts.select(
        *site[:3], F.col("kind").alias("source"), "elevation_m", "slope_magnitude_deg", "aspect_deg", *around
    )
    own = points.drop("elevation_m")
    sampled = own.join(facts, ["latitude", "longitude"], "left")
    sine, cosine = aspect_components(F.col("aspect_deg"))
    measured = F.col("slope_magnitude_deg").isNotNull()
    note = (
        F.when(F.col("tile").isNull(), "outside every elevation tile")
        .when(~measured, "no full ring of cells around this place")
        .when(F.col("aspect_deg").isNull(), "level ground has no aspect")
        .otherwise("")
    )
    return sampled.withColumns(
        {
            "aspect_sin": F.when(measured, sine),
            "aspect_cos": F.when(measured, cosine),
            "source": F.coalesce("source", F.lit("none")),
            "note": note,
        }
    )


def rounded(samples: DataFrame) -> DataFrame:
    """Display precision of a terrain sample."""
    digits = {"elevation_m": 2, "slope_magnitude_deg": 4, "aspect_deg": 2, "aspect_sin": 6, "aspect_cos": 6}
    digits |= {c: 3 for c in samples.columns if c.startswith("tpi_")}
    return samples.withColumns({c: F.round(c, d) for c, d in digits.items()})


def bilinear(points: DataFrame, dem: DataFrame, tiles: DataFrame) -> DataFrame:
    """Elevation alone: four cells per distinct coordinate, weights kept within 0..1; null if one of them is unknown."""
    dem = dem.withColumn("z", known_height(dem))
    sites = row_col(tile_for_points(points, tiles))
    for axis, size in (("row", "n_rows"), ("col", "n_cols")):
        corner = _bounded(F.floor(f"{axis}_f"), F.lit(0).cast("bigint"), F.col(size) - 2)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"{axis}_f") - F.col(f"{axis}_corner")))
        sites = sites.withColumn(f"{axis}_corner", corner).withColumn(f"{axis}_share", share)
    corners = F.array(
        *[
            F.struct(
                (F.col("row_corner") + dr).alias("row"),
                (F.col("col_corner") + dc).alias("col"),
                (
                    (F.col("row_share") if dr else 1.0 - F.col("row_share"))
                    * (F.col("col_share") if dc else 1.0 - F.col("col_share"))
                ).alias("weight"),
            )
            for dr in (0, 1)
            for dc in (0, 1)
        ]
    )
    asked = sites.select("latitude", "longitude", *TILE, F.explode(corners).alias("_c")).select("latitude", "longitude", *TILE, "_c.*")
    return (
        asked.join(dem, [*TILE, "row", "col"])
        .groupBy("latitude", "longitude", *TILE)
        .agg(F.when(F.count("z") == F.count(F.lit(1)), F.sum(F.col("weight") * F.col("z"))).alias("elevation_m"))
    )


def nearest_cell(points: DataFrame, dem: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cell under a point by truncation; impossible heights are null.

    The tile is the preferred one (lowest priority, then name and kind) of the point's whole degree.
    """
    ranked = F.struct("priority", *TILE, "n_rows", "n_cols")
    square = tiles.groupBy(F.floor("south").alias("_lat"), F.floor("west").alias("_lon")).agg(F.min(ranked).alias("_t")).select(
        "_lat", "_lon", "_t.tile", "_t.kind", "_t.n_rows", "_t.n_cols"
    )
    asked = points.withColumns({"_lat": F.floor("latitude"), "_lon": F.floor("longitude")}).join(
        square, ["_lat", "_lon"], "left"
    )
    zero = F.lit(0).cast("bigint")
    down = ((1.0 - (F.col("latitude") - F.col("_lat"))) * (F.col("n_rows") - 1)).cast("bigint")
    over = ((F.col("longitude") - F.col("_lon")) * (F.col("n_cols") - 1)).cast("bigint")
    placed = asked.withColumns(
        {"row": _bounded(down, zero, F.col("n_rows") - 1), "col": _bounded(over, zero, F.col("n_cols") - 1)}
    )
    height = F.when((F.col("z") > -500) & (F.col("z") < 9000), F.col("z"))
    return (
        placed.join(dem, [*TILE, "row", "col"], "left")
        .withColumn("elevation_m", height)
        .drop("_lat", "_lon", "n_rows", "n_cols", "z")
    )


def with_lattice_fallback(raster: DataFrame, lattice: DataFrame, key: list[str]) -> DataFrame:
    """Raster terrain where measured, lattice terrain elsewhere. A measured zero stays."""
    fields = ["topographic_position_index", "slope_magnitude_deg", "aspect_sin", "aspect_cos"]
    other = lattice.select(*key, *[F.col(f).alias(f"_l_{f}") for f in fields])
    measured = F.col("slope_magnitude_deg").isNotNull()
    tpi = [c for c in raster.columns if c.startswith("tpi_")][-1]
    base = raster.withColumnRenamed(tpi, "topographic_position_index")
    return (
        base.join(other, key, "left")
        .withColumn("terrain_source", F.when(measured, F.col("source")).otherwise("lattice"))
        .withColumns(
            {f: F.when(measured, F.col(f)).otherwise(F.col(f"_l_{f}")) for f in fields if f != "slope_magnitude_deg"}
        )
        .withColumn("slope_magnitude_deg", F.coalesce("slope_magnitude_deg", "_l_slope_magnitude_deg"))
        .drop(*[f"_l_{f}" for f in fields])
    )


def tile_report(tiles: DataFrame) -> DataFrame:
    """Coverage and pixel size of the tiles, per kind."""
    per_lon, per_lat = metres_per_degree((F.col("south") + F.col("north")) / 2.0)
    return (
        tiles.withColumns({"_x": F.col("px_lon") * per_lon, "_y": F.col("px_lat") * per_lat})
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("tile_count"),
            F.min("west").alias("west"),
            F.min("south").alias("south"),
            F.max("east").alias("east"),
            F.max("north").alias("north"),
            F.avg("_x").alias("mean_pixel_lon_m"),
            F.avg("_y").alias("mean_pixel_lat_m"),
        )
    )
