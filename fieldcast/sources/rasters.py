"""Elevation tiles on disk: a catalogue from names and headers, and a scan into the long table (tile, kind, row, col, z).

Raw tiles (.hgt) tell their place by their name and their size by their length. GeoTIFF
tiles tell everything by their tags, which are read; nothing is guessed from a length.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------
HGT_NODATA = -32768.0
KINDS = [("cartodem_geotiff", r"(?i)\.tiff?$", 0), ("srtm_hgt", r"(?i)\.hgt$", 1)]
#: Bytes and struct letter of each value type of a tag.
TAG_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, GDAL_NODATA = 33550, 33922, 34264, 34735, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PIXEL_IS_POINT = 1024, 1025, 2, 2


def corner(name: Column) -> tuple[Column, Column]:
    """(south, west) of a tile name such as N26E075; null if it is no such name."""
    upper = F.upper(name)
    pattern = r"^([NS])(\d{2})([EW])(\d{3})"

    def part(letter: int, digits: int, positive: str) -> Column:
        number = F.regexp_extract(upper, pattern, digits).try_cast("double")
        return F.when(F.regexp_extract(upper, pattern, letter) == positive, number).otherwise(-number)

    return part(1, 2, "N"), part(3, 4, "E")


def raw_side(length: Column) -> Column:
    """Cells along the edge of a square raw tile of two bytes a cell; null for any other length."""
    side = F.round(F.sqrt(length / 2)).cast("bigint")
    return F.when((side >= 2) & (side * side * 2 == length), side)


# --- GeoTIFF -----------------------------------------------------------------------------
def tags(content: bytes | memoryview) -> tuple[str, dict[int, tuple]]:
    """Byte order and first directory of a TIFF, classic or big: tag -> values."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    if order is None:
        raise ValueError("no TIFF")
    version = struct.unpack_from(order + "H", content, 2)[0]
    if version == 42:
        at, count, entry, inline, offset = struct.unpack_from(order + "I", content, 4)[0], "H", 12, 4, "I"
    elif version == 43:
        at, count, entry, inline, offset = struct.unpack_from(order + "Q", content, 8)[0], "Q", 20, 8, "Q"
    else:
        raise ValueError("no TIFF")
    n = struct.unpack_from(order + count, content, at)[0]
    at += struct.calcsize(count)
    found = {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", content, at + k * entry)
        values = struct.unpack_from(order + offset, content, at + k * entry + 4)[0]
        if kind not in TAG_TYPES:
            continue
        size, letter = TAG_TYPES[kind]
        place = at + k * entry + 4 + struct.calcsize(offset)
        if size * values > inline:
            place = struct.unpack_from(order + offset, content, place)[0]
        found[tag] = struct.unpack_from(f"{order}{values}{letter}", content, place)
    return order, found


def header(content: bytes | memoryview) -> dict:
    """Extent, cell size, shape and nodata value of a GeoTIFF in degrees; ValueError if its tags do not give them."""
    order, found = tags(content)
    if WIDTH not in found or HEIGHT not in found:
        raise ValueError("no image size")
    keys = found.get(GEO_KEYS, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if geo.get(MODEL_TYPE, GEOGRAPHIC) != GEOGRAPHIC:
        raise ValueError("projected, not in degrees")
    if PIXEL_SCALE in found and TIE_POINT in found:
        px_lon, px_lat = found[PIXEL_SCALE][:2]
        col, row, _, lon, lat, _ = found[TIE_POINT][:6]
        west, north = lon - col * px_lon, lat + row * px_lat
    elif TRANSFORM in found:
        m = found[TRANSFORM]
        if m[1] or m[4]:
            raise ValueError("rotated")
        px_lon, px_lat, west, north = m[0], -m[5], m[3], m[7]
    else:
        raise ValueError("no place on the ground")
    if px_lon <= 0 or px_lat <= 0:
        raise ValueError("cells without size")
    if geo.get(RASTER_TYPE) == PIXEL_IS_POINT:
        west, north = west - px_lon / 2, north + px_lat / 2
    n_cols, n_rows = int(found[WIDTH][0]), int(found[HEIGHT][0])
    nodata = None
    if GDAL_NODATA in found:
        try:
            nodata = float(found[GDAL_NODATA][0].split(b"\0")[0])
        except ValueError:
            nodata = None
    return {"west": west, "north": north, "east": west + n_cols * px_lon, "south": north - n_rows * px_lat, "px_lon": px_lon, "px_lat": px_lat, "n_rows": n_rows, "n_cols": n_cols,
            "nodata": nodata, "order": order, "tags": found}


def unpack_bits(data: bytes) -> bytes:
    """Byte runs: n below 128 copies n + 1 bytes, above it repeats one byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Variable-width dictionary codes, high bit first; 256 starts the table anew, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, held, bits, before, out = list(first), 9, 0, 0, None, []
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, None
            continue
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        # The width grows one code early.
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def blocks(content: bytes | memoryview, head: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, cells) of every strip or tile of the first sample; ValueError for a form that is not read."""
    found, order = head["tags"], head["order"]
    form, bits, samples = found.get(FORMAT, (1,))[0], found.get(BITS, (1,))[0], found.get(SAMPLES, (1,))[0]
    letter = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((form, bits))
    compression, predictor = found.get(COMPRESSION, (1,))[0], found.get(PREDICTOR, (1,))[0]
    if letter is None or compression not in UNPACK or predictor not in (1, 2, 3) or samples != 1:
        raise ValueError(f"form {form}, {bits} bits, {samples} samples, compression {compression} or predictor {predictor} is not read")
    kind = np.dtype(order + letter)
    rows, cols = head["n_rows"], head["n_cols"]
    if TILES in found:
        high, wide, starts, sizes = found[TILE_HEIGHT][0], found[TILE_WIDTH][0], found[TILES], found[TILE_BYTES]
    else:
        high, wide, starts = min(found.get(ROWS_PER_STRIP, (rows,))[0], rows), cols, found[STRIPS]
        sizes = found.get(STRIP_BYTES) or (rows * cols * kind.itemsize,)
    across = -(-cols // wide)
    for k, (start, size) in enumerate(zip(starts, sizes)):
        row, col = k // across * high, k % across * wide
        if row >= rows:
            break
        if not size:
            continue  # a block that was never written
        raw = UNPACK[compression](bytes(content[start : start + size]))
        height = high if TILES in found else min(high, rows - row)
        if predictor == 3:
            # Bytes of each row lie by significance, as differences.
            planes = np.cumsum(np.frombuffer(raw, np.uint8, height * wide * kind.itemsize).reshape(height, -1), axis=1, dtype=np.uint8)
            cells = np.ascontiguousarray(planes.reshape(height, kind.itemsize, wide).transpose(0, 2, 1)).view(np.dtype(">" + letter)).reshape(height, wide)
        else:
            cells = np.frombuffer(raw, kind, height * wide).reshape(height, wide)
            if predictor == 2:
                cells = np.cumsum(cells.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        yield row, col, cells[: rows - row, : cols - col]


_HEAD = "path string, length bigint, south double, west double, north double, east double, n_rows bigint, n_cols bigint, px_lat double, px_lon double, nodata double, reason string"


def headers(files: DataFrame) -> DataFrame:
    """What the tags of GeoTIFF files (path, length, content) say; `reason` where they do not say enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _HEAD.split(", ")]
        for batch in batches:
            rows = []
            for path, length, content in zip(batch["path"], batch["length"], batch["content"]):
                try:
                    rows.append(header(content) | {"path": path, "length": length, "reason": None})
                except (ValueError, struct.error, IndexError, TypeError) as wrong:
                    rows.append({"path": path, "length": length, "reason": str(wrong)[:200]})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "length", "content").mapInPandas(run, _HEAD)


# --- catalogue ---------------------------------------------------------------------------
TILE_NAME = r"([^/]+)\.[^./]+$"


def _named(files: DataFrame) -> DataFrame:
    """Files with the kind and preference that their suffix gives, and the tile's name."""
    kind, priority = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern, rank in reversed(KINDS):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
        priority = F.when(F.col("path").rlike(pattern), rank).otherwise(priority)
    return files.withColumns({"kind": kind, "priority": priority, "tile": F.regexp_extract("path", TILE_NAME, 1)}).filter("kind is not null")


GEOMETRY = ["south", "west", "north", "east", "n_rows", "n_cols", "px_lat", "px_lon", "nodata"]


def raw_catalogue(files: DataFrame) -> DataFrame:
    """Raw tiles among files (path, length): extent by name, cells by length; those of an impossible name or length are left out."""
    south, west = corner(F.col("tile"))
    side = raw_side(F.col("length"))
    found = _named(files).filter(F.col("kind") == KINDS[1][0]).withColumns({"south": south, "west": west, "n_rows": side, "n_cols": side}).filter("south is not null and n_rows is not null")
    return found.withColumns({
        "north": F.col("south") + 1.0, "east": F.col("west") + 1.0, "px_lat": 1.0 / (F.col("n_rows") - 1), "px_lon": 1.0 / (F.col("n_cols") - 1), "nodata": F.lit(HGT_NODATA),
    })


def catalogue(files: DataFrame) -> DataFrame:
    """Tiles among files (path, length, content): kind and preference by suffix, geometry of raw tiles by name and length, of GeoTIFFs by their tags.

    Files that cannot be read are left out here and in the scan; `unreadable` has them. Without
    the contents only raw tiles are listed.
    """
    listed = raw_catalogue(files)
    columns = ["path", "length", "kind", "priority", "tile", *GEOMETRY]
    if "content" not in files.columns:
        return listed.select(*columns)
    tagged = _named(headers(files.filter(F.col("path").rlike(KINDS[0][1]))).filter("reason is null").drop("reason"))
    return tagged.select(*columns).unionByName(listed.select(*columns))


def unreadable(files: DataFrame) -> DataFrame:
    """Tiles among files (path, length, perhaps content) that are left out, and why."""
    raw = files.withColumn("tile", F.regexp_extract("path", TILE_NAME, 1)).filter(F.col("path").rlike(KINDS[1][1]))
    reason = F.when(raw_side(F.col("length")).isNull(), "length is no square of two-byte cells").when(corner(F.col("tile"))[0].isNull(), "name gives no corner")
    out = raw.select("path", "tile", "length", reason.alias("reason"))
    if "content" in files.columns:
        tagged = headers(files.filter(F.col("path").rlike(KINDS[0][1])))
        out = out.unionByName(tagged.select("path", F.regexp_extract("path", TILE_NAME, 1).alias("tile"), "length", "reason"))
    return out.filter("reason is not null")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def list_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue of a folder tree. Raw tiles are listed without reading them."""
    raw = raw_catalogue(_files(spark, folder).select("path", "length"))
    tagged = _named(headers(_files(spark, folder).filter(F.col("path").rlike(KINDS[0][1])))).filter("reason is null")
    columns = ["path", "length", "kind", "priority", "tile", *GEOMETRY]
    return tagged.select(*columns).unionByName(raw.select(*columns))


# --- cells -------------------------------------------------------------------------------
_CELLS = "tile string, kind string, row bigint, col bigint, z double"


def _table(tile: str, kind: str, row: int, col: int, cells: np.ndarray) -> pa.RecordBatch:
    high, wide = cells.shape
    n = high * wide
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(tile), n), pa.repeat(pa.scalar(kind), n), pa.array(np.repeat(np.arange(row, row + high), wide)), pa.array(np.tile(np.arange(col, col + wide), high)),
         pa.array(cells.astype("float64").ravel())], ["tile", "kind", "row", "col", "z"],
    )


def decode_tiles(files: DataFrame) -> DataFrame:
    """Tiles (tile, kind, content) to cells; row 0 is the northern edge.

    Raw tiles are big-endian 16-bit numbers in a square; GeoTIFFs are read by their tags: strips or
    blocks, plain, LZW, deflate or byte runs, with predictors, numbers of 8 to 64 bits. A cell that is not
    a number is null. A task holds one file at a time and streams it out block by block; files
    that cannot be read give no cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                if kind == KINDS[1][0]:
                    side = math.isqrt(len(raw) // 2)
                    if side >= 2 and side * side * 2 == len(raw):
                        grid = np.frombuffer(raw, ">i2").reshape(side, side)
                        yield from (_table(tile, kind, row, 0, grid[row : row + 64]) for row in range(0, side, 64))
                    continue
                try:
                    for row, col, cells in blocks(raw, header(raw)):
                        made = _table(tile, kind, row, col, cells)
                        yield made.set_column(4, "z", pa.array(made.column(4).to_numpy(), from_pandas=True))
                except (ValueError, struct.error, IndexError, TypeError, KeyError, zlib.error):
                    continue

    return files.select("tile", "kind", "content").mapInArrow(run, _CELLS)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every tile of a folder tree."""
    return decode_tiles(_named(_files(spark, folder)))


def read_hgt(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every raw tile of a folder tree."""
    return decode_tiles(_named(_files(spark, folder)).filter(F.col("kind") == KINDS[1][0]))
