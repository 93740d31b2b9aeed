"""One-band TIFF rasters with a geographic grid: strips or tiles; plain, deflated, LZW or run-length packed, with or without a predictor; whole numbers
or floats.

A folder of files is one raster: their headers are read first and give one grid, which all must fit (the same cell size, origins a whole number of
cells apart). Then a file is cut into its strips or tiles where it is read, those outside the box asked for are left out undecoded, and the others are
dealt to all tasks, so one large file is decoded by many. Where files overlap, the cells of each are there; ``raster.mosaic`` lays them over each other.

A raster is written in tiles that tasks encode; only their lengths and, one by one, their bytes come to the driver, as a file has one writer.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.operators.raster import Grid
from wayfield.session import discard, materialize
from wayfield.sources.files import write_parts

#: The format's tags that are read or written, and its value types (size, code).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATED, RUNS = (1,), (5,), (8, 32946), (32773,)
#: LZW codes: the first two after the bytes are "start anew" and "end".
CLEAR, END = 256, 257
TILE = 256
MAX_FILE_BYTES = 4_000_000_000


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first image's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in TYPES:
            form = f"{order}{n}{TYPES[kind]}"
            size = struct.calcsize(form)
            place = struct.unpack(order + "I", entry[8:])[0]
            out[tag] = struct.unpack(form, entry[8 : 8 + size] if size <= 4 else data[place : place + size])
    return order, out


def grid_of(tags: dict[int, tuple]) -> tuple[Grid, float | None]:
    """The grid, rows running down, and the nodata value."""
    dx, dy = tags.get(SCALE, (1.0, 1.0))[:2]
    col, row, _, x, y = tags.get(TIEPOINT, (0.0,) * 6)[:5]
    nodata = b"".join(tags[NODATA]).strip(b"\0 ") if NODATA in tags else b""
    return Grid(x - col * dx, y + row * dy, dx, -dy, tags[HEIGHT][0], tags[WIDTH][0]), float(nodata) if nodata else None


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code gets one bit longer one entry before it must."""
    out, table, width = bytearray(), [], 9
    bits = held = 0
    last = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def unpacked_runs(data: bytes) -> bytes:
    """Counted literals and repeated bytes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def block_of(raw: bytes, compression: int, predictor: int, kind: np.dtype, wide: int) -> np.ndarray:
    """The pixels of one strip or tile, rows of ``wide``."""
    if compression in DEFLATED:
        raw = zlib.decompress(raw)
    elif compression in LZW:
        raw = unpacked_lzw(raw)
    elif compression in RUNS:
        raw = unpacked_runs(raw)
    size = kind.itemsize
    raw = raw[: len(raw) // (wide * size) * wide * size]
    if predictor == 3:  # bytes of a row by place, high ones first, each as its difference from the one before
        rows = np.cumsum(np.frombuffer(raw, np.uint8).reshape(-1, wide * size), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(rows.reshape(-1, size, wide).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, wide)
    block = np.frombuffer(raw, kind).reshape(-1, wide)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def layout_of(order: str, tags: dict[int, tuple]) -> tuple[int, int, str, int, int, list[tuple[int, int, int, int]]]:
    """(compression, predictor, pixel type, width and height of a block, [(first row, first column, place, bytes)]) of a file."""
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    form = {1: "u", 2: "i", 3: "f"}.get(tags.get(FORMAT, (1,))[0])
    if tags.get(SAMPLES, (1,))[0] != 1 or compression not in PLAIN + LZW + DEFLATED + RUNS or predictor not in (1, 2, 3) or form is None or tags[BITS][0] % 8 or (predictor == 3 and form != "f") or (predictor == 2 and form == "f"):
        raise ValueError("only one band of whole bytes, plain, deflated, LZW or run-length packed, is read")
    height, width = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_AT in tags
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
    across = -(-width // wide)
    places = zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)
    return compression, predictor, f"{order}{form}{tags[BITS][0] // 8}", wide, high, [(i // across * high, i % across * wide, at, n) for i, (at, n) in enumerate(places)]


def pixels_of(data: bytes) -> np.ndarray:
    """All pixels of a file."""
    order, tags = tags_of(data)
    compression, predictor, form, wide, high, blocks = layout_of(order, tags)
    out = np.zeros((tags[HEIGHT][0], tags[WIDTH][0]), dtype=np.dtype(form))
    for row, col, at, n in blocks:
        part = out[row : row + high, col : col + wide]
        part[:] = block_of(data[at : at + n], compression, predictor, np.dtype(form), wide)[: part.shape[0], : part.shape[1]]
    return out


def one_grid(headers: DataFrame) -> Grid | None:
    """The grid that all files (x0, y0, dx, dy, n_rows, n_cols) lie on; an error where one does not fit."""
    x1, y1 = F.col("x0") + F.col("dx") * F.col("n_cols"), F.col("y0") + F.col("dy") * F.col("n_rows")
    r = headers.agg(*(f(c).alias(f"{c}_{n}") for c in ("x0", "y0", "dx", "dy") for n, f in (("min", F.min), ("max", F.max))), F.max(x1).alias("x1"), F.min(y1).alias("y1")).first()
    if r.x0_min is None:
        return None
    dx, dy = r.dx_min, r.dy_min
    apart = lambda v, v0, d: F.abs((F.col(v) - v0) / d - F.round((F.col(v) - v0) / d))
    off = headers.filter((apart("x0", r.x0_min, dx) > 1e-3) | (apart("y0", r.y0_max, dy) > 1e-3))
    if abs(r.dx_max - dx) > 1e-9 * abs(dx) or abs(r.dy_max - dy) > 1e-9 * abs(dy) or not off.isEmpty():
        raise ValueError("files of one raster have cells of one size, and origins a whole number of cells apart")
    return Grid(r.x0_min, r.y0_max, dx, dy, round((r.y1 - r.y0_max) / dy), round((r.x1 - r.x0_min) / dx))


def read_tiff(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, Grid]:
    """Cells (row_no, col, value) that have data, and the grid of all files together. With ``box`` (x0, y0, x1, y1) cells whose centre is in it; strips
    and tiles beyond it are not decoded. A file is read whole (2 GB at most), twice: for its header and for its blocks."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grid_of(tags_of(x)[1])[0] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x0": pa.array([g.x0 for g in got], pa.float64()), "y0": pa.array([g.y0 for g in got], pa.float64()), "dx": pa.array([g.dx for g in got], pa.float64()), "dy": pa.array([g.dy for g in got], pa.float64()), "n_rows": pa.array([g.n_rows for g in got], pa.int64()), "n_cols": pa.array([g.n_cols for g in got], pa.int64())})

    found = materialize(files.mapInArrow(headers, "x0 double, y0 double, dx double, dy double, n_rows long, n_cols long"), "tiff-headers")
    grid = one_grid(found)
    discard(found)
    if grid is None:
        raise ValueError("no file there")
    if box is None:
        first, last = (0, 0), (grid.n_rows, grid.n_cols)
    else:  # the first and last cells whose centres are inside
        col, row = sorted((x - grid.x0) / grid.dx - 0.5 for x in (box[0], box[2])), sorted((y - grid.y0) / grid.dy - 0.5 for y in (box[1], box[3]))
        first, last = (math.ceil(row[0]), math.ceil(col[0])), (math.floor(row[1]) + 1, math.floor(col[1]) + 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                order, tags = tags_of(data)
                own, nodata = grid_of(tags)
                down, right = round((own.y0 - grid.y0) / grid.dy), round((own.x0 - grid.x0) / grid.dx)
                compression, predictor, form, wide, high, places = layout_of(order, tags)
                for row, col, at, n in places:
                    rows, cols = min(high, own.n_rows - row), min(wide, own.n_cols - col)
                    row, col = row + down, col + right
                    if row < last[0] and row + rows > first[0] and col < last[1] and col + cols > first[1]:
                        head = json.dumps([row, col, rows, cols, wide, compression, predictor, form, nodata])
                        yield pa.RecordBatch.from_pydict({"head": [head], "content": pa.array([data[at : at + n]], pa.binary())})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row0, col0, rows, cols, wide, compression, predictor, form, nodata = json.loads(head)
                some = block_of(content, compression, predictor, np.dtype(form), wide)[:rows, :cols].astype(np.float64)
                row, col = np.nonzero(~np.isnan(some) & (True if nodata is None else some != nodata))
                value, row, col = some[row, col], row + row0, col + col0
                keep = (row >= first[0]) & (row < last[0]) & (col >= first[1]) & (col < last[1])
                yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(col[keep]), pa.array(value[keep])], names=["row_no", "col", "value"])

    dealt = files.mapInArrow(blocks, "head string, content binary").repartition(spark.sparkContext.defaultParallelism, "head")
    return dealt.mapInArrow(cells, "row_no long, col long, value double"), grid


def header(grid: Grid, nodata: float, tile: int, lengths: list[int]) -> bytes:
    """What stands before the tiles of a file of deflated doubles, with a predictor; rows run down."""
    text = f"{nodata!r}\0".encode()
    n = len(lengths)
    entries = [
        (WIDTH, 4, [grid.n_cols]), (HEIGHT, 4, [grid.n_rows]), (BITS, 3, [64]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [3]),
        (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_AT, 4, [0] * n), (TILE_BYTES, 4, lengths), (FORMAT, 3, [3]),
        (SCALE, 12, [abs(grid.dx), abs(grid.dy), 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]), (NODATA, 2, [bytes([c]) for c in text]),
    ]
    table_bytes = 2 + 12 * len(entries) + 4
    sizes = [struct.calcsize(f"<{len(content)}{TYPES[kind]}") for _, kind, content in entries]
    at = 8 + table_bytes + sum(x + x % 2 for x in sizes if x > 4)
    starts = [at + x for x in accumulate([0, *lengths[:-1]])] if n else []
    if at + sum(lengths) > MAX_FILE_BYTES:
        raise ValueError(f"the file would be over {MAX_FILE_BYTES} bytes; write several")
    table, extra = struct.pack("<H", len(entries)), b""
    for tag, kind, content in entries:
        content = starts if tag == TILE_AT else content
        packed = struct.pack(f"<{len(content)}{TYPES[kind]}", *content)
        if len(packed) > 4:
            place = struct.pack("<I", 8 + table_bytes + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, kind, len(content)) + place
    return b"II*\0" + struct.pack("<I", 8) + table + struct.pack("<I", 0) + extra


def packed_tile(values: np.ndarray) -> bytes:
    """A tile of doubles, differenced by bytes and deflated."""
    places = values.astype(">f8").view(np.uint8).reshape(len(values), -1, 8).transpose(0, 2, 1).reshape(len(values), -1)
    return zlib.compress(np.concatenate([places[:, :1], np.diff(places, axis=1)], axis=1).astype(np.uint8).tobytes())


def tiles(cells: DataFrame, grid: Grid, nodata: float = -9999.0, tile: int = TILE) -> DataFrame:
    """(tile_no, content) of all tiles of a grid whose rows run down, those without any cell too: encoded where their cells meet."""
    across = -(-grid.n_cols // tile)
    spark = cells.sparkSession

    def pack(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        no = key[0].as_py()
        values = np.full((tile, tile), nodata)
        known = table.filter(pa.compute.is_valid(table.column("value")))
        values[known.column("row_no").to_numpy() - no // across * tile, known.column("col").to_numpy() - no % across * tile] = known.column("value").to_numpy()
        return pa.table({"tile_no": pa.array([no], pa.int64()), "content": pa.array([packed_tile(values)], pa.binary())})

    every = spark.range(across * -(-grid.n_rows // tile)).select(F.col("id").alias("tile_no"), F.lit(0).cast("long").alias("row_no"), F.lit(0).cast("long").alias("col"), F.lit(None).cast("double").alias("value"))
    inside = cells.filter(grid.inside(F.col("row_no"), F.col("col"))).select(F.expr(f"(row_no div {tile}) * {across}L + (col div {tile})").alias("tile_no"), F.col("row_no").cast("long").alias("row_no"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    return every.unionByName(inside).groupBy("tile_no").applyInArrow(pack, "tile_no long, content binary")


def write_tiff(cells: DataFrame, grid: Grid, path: str, nodata: float = -9999.0, tile: int = TILE) -> None:
    """One tiled file of at most MAX_FILE_BYTES. Tiles are encoded by tasks and pass the driver one by one."""
    if grid.dy > 0:  # rows that run up are turned round
        cells = cells.withColumn("row_no", F.lit(grid.n_rows - 1) - F.col("row_no"))
        grid = Grid(grid.x0, grid.y0 + grid.dy * grid.n_rows, grid.dx, -grid.dy, grid.n_rows, grid.n_cols, grid.srid)
    packed = materialize(tiles(cells, grid, nodata, tile), "tiff-tiles")
    lengths = [r.n for r in packed.select("tile_no", F.length("content").alias("n")).orderBy("tile_no").collect()]  # a number for each tile
    parts = chain([header(grid, nodata, tile, lengths)], (bytes(r.content) for r in packed.orderBy("tile_no").select("content").toLocalIterator()))
    write_parts(cells.sparkSession, path, parts)
    discard(packed)
