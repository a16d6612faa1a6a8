"""GeoTIFF files written here byte by byte, and terrain from tiles of several kinds."""

import struct
import zlib

import numpy as np
import pytest

from fieldcast.operators import terrain
from fieldcast.sources import rasters


def lzw(data: bytes) -> bytes:
    """Dictionary codes of growing width; the table starts anew before it is full."""
    table, width, bits, out = {bytes([k]): k for k in range(256)}, 9, [256], []
    codes, held = [(256, 9)], b""
    following = 258
    for byte in data:
        longer = held + bytes([byte])
        if longer in table:
            held = longer
            continue
        codes.append((table[held], width))
        table[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            codes.append((256, width))
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        held = bytes([byte])
    if held:
        codes.append((table[held], width))
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes.append((257, width))
    text = "".join(format(c, f"0{w}b") for c, w in codes)
    del bits, out
    return int(text + "0" * (-len(text) % 8), 2).to_bytes(-(-len(text) // 8), "big")


def runs(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        n = 1
        while at + n < len(data) and n < 128 and data[at + n] == data[at]:
            n += 1
        out += bytes([257 - n, data[at]]) if n > 1 else bytes([0, data[at]])
        at += n
    return out


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: runs}


def tiff(grid, order=">", big=False, compression=1, predictor=1, block=None, rows_per_strip=None, west=75.0, north=27.0, px=0.1, point=False, model=2, nodata="-32768", transform=False):
    """A GeoTIFF of one sample; `block` makes tiles instead of strips."""
    n_rows, n_cols = grid.shape
    form = {"u": 1, "i": 2, "f": 3}[grid.dtype.kind]
    if block:
        high = wide = block
        full = np.zeros((-(-n_rows // block) * block, -(-n_cols // block) * block), grid.dtype)
        full[:n_rows, :n_cols] = grid
        pieces = [full[r : r + block, c : c + block] for r in range(0, full.shape[0], block) for c in range(0, full.shape[1], block)]
    else:
        high, wide = rows_per_strip or n_rows, n_cols
        pieces = [grid[r : r + high] for r in range(0, n_rows, high)]
    packed = []
    for piece in pieces:
        if predictor == 2:
            piece = np.concatenate([piece[:, :1], np.diff(piece, axis=1)], axis=1).astype(grid.dtype)
        raw = piece.astype(grid.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            planes = np.frombuffer(piece.astype(grid.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(piece.shape[0], wide, -1).transpose(0, 2, 1).reshape(piece.shape[0], -1)
            raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
        packed.append(PACK[compression](raw))
    keys = [1, 1, 0, 2, 1024, 0, 1, model, 1025, 0, 1, 2 if point else 1]
    shift = px / 2 if point else 0.0
    tags = [(256, "H", [n_cols]), (257, "H", [n_rows]), (258, "H", [grid.dtype.itemsize * 8]), (259, "H", [compression]), (317, "H", [predictor]), (339, "H", [form]), (34735, "H", keys)]
    tags += [(34264, "d", [px, 0, 0, west, 0, -px, 0, north] + [0.0] * 8)] if transform else [(33550, "d", [px, px, 0.0]), (33922, "d", [0, 0, 0, west + shift, north - shift, 0])]
    tags += [(42113, "s", [nodata.encode() + b"\0"])] if nodata else []
    names = (322, 323, 324, 325) if block else (None, 278, 273, 279)
    tags += [(322, "H", [wide])] if block else []
    tags += [(names[1], "H", [high]), (names[2], "I", [0] * len(packed)), (names[3], "I", [len(p) for p in packed])]
    letters = {"H": 3, "d": 12, "s": 2, "I": 4}
    entry, count, offset, start = (20, "Q", "Q", 16) if big else (12, "H", "I", 8)
    place = start + struct.calcsize(count) + entry * len(tags) + struct.calcsize(offset)
    extra, directory = b"", b""
    cells_at = place + sum(len(struct.pack(f"{order}{len(v[0]) if k == 's' else len(v)}{k}", *v)) + 8 for _, k, v in tags)
    starts = np.cumsum([cells_at] + [len(p) for p in packed])[:-1].tolist()
    for tag, kind, value in sorted(tags):
        value = starts if tag == names[2] else value
        n = len(value[0]) if kind == "s" else len(value)
        data = struct.pack(f"{order}{n}{kind}", *value)
        if len(data) <= struct.calcsize(offset):
            data = data.ljust(struct.calcsize(offset), b"\0")
        else:
            extra, data = extra + data, struct.pack(order + offset, place + len(extra))
        directory += struct.pack(order + "HH" + offset, tag, letters[kind], n) + data
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    front = head + struct.pack(order + count, len(tags)) + directory + struct.pack(order + offset, 0) + extra
    return front.ljust(cells_at, b"\0") + b"".join(packed)


GRID = (np.arange(37 * 53).reshape(37, 53) * 31 % 2900 - 100).astype("i2")
FORMS = [
    dict(), dict(order="<", rows_per_strip=5), dict(compression=8, predictor=2), dict(compression=5), dict(compression=5, predictor=2, order="<", block=16), dict(compression=32773, block=16),
    dict(big=True, compression=8, block=32), dict(big=True, order="<", rows_per_strip=7, transform=True),
]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("kind", ["i2", "u2", "f4", "i4", "f8"])
def test_every_form_is_read(form, kind):
    grid = np.abs(GRID).astype(kind)
    content = tiff(grid, **form)
    head = rasters.header(content)
    assert (head["n_rows"], head["n_cols"], head["nodata"]) == (37, 53, -32768.0)
    assert (head["west"], head["north"], head["px_lat"]) == pytest.approx((75.0, 27.0, 0.1)) and head["east"] == pytest.approx(80.3) and head["south"] == pytest.approx(23.3)
    out = np.full(grid.shape, np.nan)
    for row, col, cells in rasters.blocks(content, head):
        out[row : row + cells.shape[0], col : col + cells.shape[1]] = cells
    assert (out == grid).all()


def test_float_predictor_and_point_rasters():
    grid = np.random.default_rng(2).normal(300, 80, GRID.shape).astype("f4")
    content = tiff(grid, compression=8, predictor=3, point=True, nodata=None)
    head = rasters.header(content)
    assert head["nodata"] is None and (head["west"], head["north"]) == pytest.approx((75.0, 27.0))
    assert (np.concatenate([cells for _, _, cells in rasters.blocks(content, head)]) == grid).all()


def test_long_lzw_tables():
    data = np.random.default_rng(3).integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert rasters.unpack_lzw(lzw(data)) == data


def test_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "N26E075.tif").write_bytes(tiff(GRID, compression=8, px=1 / 53))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "N26E075.hgt").write_bytes((np.arange(441).reshape(21, 21) % 90).astype(">i2").tobytes())
    (tmp_path / "flat.TIFF").write_bytes(tiff(GRID, model=1))
    (tmp_path / "cut.tiff").write_bytes(tiff(GRID)[:60])
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "notes.hgt").write_bytes(b"xyz")
    listed = {(r["tile"], r["kind"]): r for r in rasters.list_tiles(spark, str(tmp_path)).collect()}
    assert set(listed) == {("N26E075", "cartodem_geotiff"), ("N26E075", "srtm_hgt")}
    assert (listed["N26E075", "cartodem_geotiff"]["n_rows"], listed["N26E075", "cartodem_geotiff"]["south"]) == (37, pytest.approx(27 - 37 / 53))
    cells = rasters.read_cells(spark, str(tmp_path))
    found = {(r["kind"], r["row"], r["col"]): r["z"] for r in cells.filter("tile = 'N26E075'").collect()}
    assert len(found) == GRID.size + 441 and all(found["cartodem_geotiff", i, j] == GRID[i, j] for i, j in [(0, 0), (36, 52), (20, 11)])
    files = rasters._files(spark, str(tmp_path))
    reasons = {r["tile"]: r["reason"] for r in rasters.unreadable(files).collect()}
    # Spark lists no file without bytes.
    assert set(reasons) == {"flat", "cut", "notes"} and "projected" in reasons["flat"]


def test_two_kinds_of_one_tile_give_one_value(spark):
    cells = [("T", kind, i, j, 700.0 + 3 * i + 5 * j + extra) for kind, extra in (("cartodem_geotiff", 0.0), ("srtm_hgt", 50.0)) for i in range(40) for j in range(40)]
    dem = spark.createDataFrame(cells, "tile string, kind string, row bigint, col bigint, z double")
    tile = [("T", kind, rank, 73.0, 24.0, 74.0, 25.0, 40, 40, 1 / 39, 1 / 39, -32768.0) for kind, rank in (("srtm_hgt", 1), ("cartodem_geotiff", 0))]
    tiles = spark.createDataFrame(tile, "tile string, kind string, priority int, west double, south double, east double, north double, n_rows bigint, n_cols bigint, px_lon double, px_lat double, nodata double")
    points = spark.createDataFrame([("a", 24.5, 73.5)], "name string, latitude double, longitude double")
    row = terrain.sample_terrain(points, dem, tiles, (3000.0, 9000.0)).collect()
    only = terrain.sample_terrain(points, dem.filter("kind = 'cartodem_geotiff'"), tiles.filter("priority = 0"), (3000.0, 9000.0)).collect()
    assert len(row) == 1 and row == only and row[0]["source"] == "cartodem_geotiff"
    cell = terrain.nearest_cell(points, dem, tiles).collect()
    assert [(r["kind"], r["row"], r["col"], r["elevation_m"]) for r in cell] == [("cartodem_geotiff", 19, 19, 700.0 + 8 * 19)]


def test_one_station_reads_a_few_blocks(spark):
    """A tile of 600 x 600 cells: what is summed is what the windows touch."""
    side = 600
    cells = spark.range(side * side).selectExpr("'T' AS tile", "'k' AS kind", f"id div {side} AS row", f"id % {side} AS col", f"CAST((id * 7919) % 1000 AS DOUBLE) AS z")
    px = 1 / (side - 1)
    tile = [("T", "k", 0, 73.0, 24.0, 74.0, 25.0, side, side, px, px, -32768.0)]
    tiles = spark.createDataFrame(tile, "tile string, kind string, priority int, west double, south double, east double, north double, n_rows bigint, n_cols bigint, px_lon double, px_lat double, nodata double")
    points = spark.createDataFrame([("a", 24.51, 73.47), ("edge", 24.0, 74.0)], "name string, latitude double, longitude double")
    sampled = terrain.sample_terrain(points, cells, tiles, (2000.0, 20000.0))
    got = {r["name"]: r for r in sampled.collect()}
    grid = (np.arange(side * side) * 7919 % 1000).reshape(side, side).astype(float)
    for name, lat, lon in (("a", 24.51, 73.47), ("edge", 24.0, 74.0)):
        y, x = (25.0 - lat) / px - 0.5, (lon - 73.0) / px - 0.5
        dy, dx = px * abs(111132.92 - 559.82 * np.cos(2 * np.radians(lat)) + 1.175 * np.cos(4 * np.radians(lat))), px * abs(111412.84 * np.cos(np.radians(lat)) - 93.5 * np.cos(3 * np.radians(lat)))
        a, b = round(20000 / dy), round(20000 / dx)
        pad_y, pad_x = int(np.ceil(20000 / dy)) + 2, int(np.ceil(20000 / dx)) + 2
        low_y, low_x = max(0, round(y) - pad_y), max(0, round(x) - pad_x)
        cy, cx = round(y - low_y) + low_y, round(x - low_x) + low_x
        mean = grid[max(0, cy - a) : cy + a + 1, max(0, cx - b) : cx + b + 1].mean()
        assert got[name]["elevation_m"] - got[name]["tpi_20000m"] == pytest.approx(mean)
    plan = sampled._jdf.queryExecution().optimizedPlan().toString()
    assert "_brow" in plan and "LeftSemi" in plan
