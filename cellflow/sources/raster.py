"""Rasters as cells: GeoTIFF files are read block by block (strips or tiles) and written by the tile.

A file's header says where its blocks are; the table of blocks is dealt evenly to tasks, and each reads the bytes of its own blocks alone. So a
large file is many tasks, no file is held whole, and a lost executor's blocks are read again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the TIFF format: tags, sizes of value types, and numpy kinds by sample format.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "strip_rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata"}
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
FORMATS = {1: "u", 2: "i", 3: "f"}
NONE, DEFLATE, DEFLATE_OLD = 1, 8, 32946
BLOCK = "file string, offset long, bytes long, iy0 int, ix0 int, rows int, cols int, stored_cols int, order string, kind string, compression int, predictor int, samples int, x0 double, y0 double, dx double, dy double, nodata double"


def header(f) -> dict:
    """The first directory's tags of an open TIFF file (classic or big)."""
    order = {b"II": "<", b"MM": ">"}.get(f.read(2))
    if order is None:
        raise ValueError("not a TIFF file")
    version = struct.unpack(order + "H", f.read(2))[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    word, count_kind, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    f.seek(8 if big else 4)
    f.seek(struct.unpack(order + word, f.read(struct.calcsize(word)))[0])
    n = struct.unpack(order + count_kind, f.read(struct.calcsize(count_kind)))[0]
    raw, out = f.read(n * entry), {"order": order}
    for k in range(n):
        part = raw[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", part[:4])
        if tag not in TAGS or kind not in KINDS:
            continue
        count = struct.unpack(order + word, part[4 : 4 + struct.calcsize(word)])[0]
        size, value = struct.calcsize("=" + KINDS[kind]) * count, part[4 + struct.calcsize(word) :]
        if size > len(value):
            f.seek(struct.unpack(order + word, value)[0])
            value = f.read(size)
        out[TAGS[tag]] = value[:size].split(b"\0")[0].decode() if kind == 2 else struct.unpack(order + KINDS[kind] * count, value[:size])
    return out


def blocks_of(name: str, h: dict) -> list[tuple]:
    """A row for each block: where it is in the file and in the grid, and how to read it."""
    one = lambda key, default: h[key][0] if key in h else default
    width, height, samples = one("width", 0), one("height", 0), one("samples", 1)
    compression = one("compression", NONE)
    if compression not in (NONE, DEFLATE, DEFLATE_OLD):
        raise ValueError(f"{name}: compression {compression} is not read; rewrite the file uncompressed or deflated")
    bits, form = one("bits", 1), one("format", 1)
    if bits % 8 or form not in FORMATS:
        raise ValueError(f"{name}: samples of {bits} bits are not read")
    bw, bh = one("tile_width", width), one("tile_height", min(one("strip_rows", height), height))
    across = -(-width // bw)
    scale, tie = h.get("scale", (1.0, 1.0, 0.0)), h.get("tie", (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    # Centre of the first cell; y falls with iy.
    x0, y0 = tie[3] + (0.5 - tie[0]) * scale[0], tie[4] - (0.5 - tie[1]) * scale[1]
    nodata = float(h["nodata"]) if h.get("nodata", "").strip() else None
    out = []
    for k, (offset, count) in enumerate(zip(h["offsets"], h["counts"], strict=True)):
        iy, ix = k // across * bh, k % across * bw
        if count and iy < height:
            out.append((name, offset, count, iy, ix, min(bh, height - iy), min(bw, width - ix), bw, h["order"], f"{FORMATS[form]}{bits // 8}", compression, one("predictor", 1), samples, x0, y0, scale[0], scale[1], nodata))
    return out


def decode(raw: bytes, b) -> np.ndarray:
    """A block's values (rows, cols) of the first band as doubles; NaN where there is no data."""
    if b.compression != NONE:
        raw = zlib.decompress(raw)
    kind = np.dtype(b.order + b.kind)
    rows = len(raw) // (kind.itemsize * b.stored_cols * b.samples)
    if b.predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1)
        planes = np.cumsum(planes.reshape(rows, -1, b.samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(rows, -1).view(np.dtype(">" + b.kind))
    else:
        values = np.frombuffer(raw, kind, rows * b.stored_cols * b.samples).reshape(rows, -1)
        if b.predictor == 2:
            values = np.cumsum(values.reshape(rows, -1, b.samples), axis=1, dtype=kind.newbyteorder("=")).reshape(rows, -1)
    out = values.reshape(rows, b.stored_cols, b.samples)[: b.rows, : b.cols, 0].astype(float)
    return np.where(out == b.nodata, np.nan, out) if b.nodata == b.nodata and b.nodata is not None else out


def raster_blocks(spark: SparkSession, files: list[str] | DataFrame) -> DataFrame:
    """The table of blocks of GeoTIFF files (URIs, or a frame with the column file): only headers are read."""
    names = spark.createDataFrame([(f,) for f in files], "file string") if isinstance(files, list) else files.select("file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as f:
                    yield pd.DataFrame(blocks_of(name, header(f)), columns=[c.split()[0] for c in BLOCK.split(", ")])

    return names.mapInPandas(run, BLOCK)


def read_rasters(spark: SparkSession, files: list[str] | DataFrame, tasks: int | None = None) -> DataFrame:
    """(file, iy, ix, x, y, v): the cells with data of the first band of GeoTIFF files, uncompressed or deflated, of whole bytes a sample.

    Other compressions are an error that names the file. A file without blocks gives no rows.
    """
    blocks = raster_blocks(spark, files)
    dealt = blocks.repartitionByRange(tasks or 2 * spark.sparkContext.defaultParallelism, F.xxhash64("file", "offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples():
                fs, path = pafs.FileSystem.from_uri(b.file)
                with fs.open_input_file(path) as f:
                    v = decode(f.read_at(b.bytes, b.offset), b)
                y, x = np.nonzero(np.isfinite(v))
                iy, ix = y + b.iy0, x + b.ix0
                yield pd.DataFrame({"file": b.file, "iy": iy.astype(np.int32), "ix": ix.astype(np.int32), "x": b.x0 + ix * b.dx, "y": b.y0 - iy * b.dy, "v": v[y, x]})

    return dealt.mapInPandas(run, "file string, iy int, ix int, x double, y double, v double")


def tiff_bytes(values: np.ndarray, x0: float, y0: float, step: float, nodata: float = -9999.0, strip_rows: int = 64) -> bytes:
    """A deflated GeoTIFF of doubles; x0, y0: centre of the first cell; NaN is written as nodata."""
    v = np.where(np.isfinite(values), values, nodata).astype("<f8")
    height, width = v.shape
    strips = [zlib.compress(v[k : k + strip_rows].tobytes(), 6) for k in range(0, height, strip_rows)]
    text = f"{nodata:g}\0".encode()
    entries = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (64,)), (259, 3, (DEFLATE,)), (262, 3, (1,)), (273, 4, None), (277, 3, (1,)), (278, 4, (strip_rows,)), (279, 4, tuple(map(len, strips))), (339, 3, (3,)), (33550, 12, (step, step, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0 - step / 2, y0 + step / 2, 0.0)), (42113, 2, text)]
    size = lambda kind, values: len(values) * struct.calcsize("=" + KINDS[kind])
    begin = 8 + 2 + 12 * len(entries) + 4
    extra = sum(s for tag, kind, x in entries if (s := len(strips) * 4 if x is None else size(kind, x)) > 4)
    at, offsets = begin + extra, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    table, more = b"", b""
    for tag, kind, x in entries:
        x = tuple(offsets) if x is None else x
        data = x if kind == 2 else struct.pack("<" + KINDS[kind] * len(x), *x)
        if len(data) <= 4:
            table += struct.pack("<HHI", tag, kind, len(x)) + data.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, kind, len(x), begin + len(more))
            more += data
    return b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries)) + table + struct.pack("<I", 0) + more + b"".join(strips)


def write_rasters(cells: DataFrame, path: str, key: str, v: str | Column, origin: tuple[float, float], step: float, side: int = 1024) -> DataFrame:
    """Write cells (key, iy, ix, v) as GeoTIFF tiles of at most side x side cells, a file for each key and tile that has a cell; returns the
    table (file, key, cells). origin: centre of cell (0, 0). A tile is one group, whose size is bounded; files are renamed when complete."""
    value = F.col(v) if isinstance(v, str) else v
    tiled = cells.select(F.col(key).cast("string").alias("key"), (F.col("iy") - F.col("iy") % side).alias("iy0"), (F.col("ix") - F.col("ix") % side).alias("ix0"), "iy", "ix", value.cast("double").alias("v"))

    def write(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid

        name, iy0, ix0 = group
        grid = np.full((int(pdf["iy"].max()) - iy0 + 1, int(pdf["ix"].max()) - ix0 + 1), np.nan)
        grid[pdf["iy"] - iy0, pdf["ix"] - ix0] = pdf["v"]
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        file = f"{name}-{iy0}-{ix0}.tif"
        temp = f"{root}/.tmp-{uuid.uuid4().hex}-{file}"
        with fs.open_output_stream(temp) as f:
            f.write(tiff_bytes(grid, origin[0] + ix0 * step, origin[1] - iy0 * step, step))
        fs.move(temp, f"{root}/{file}")
        return pd.DataFrame({"file": [f"{path}/{file}"], "key": [name], "cells": [int(pdf["v"].notna().sum())]})

    return tiled.groupBy("key", "iy0", "ix0").applyInPandas(write, "file string, key string, cells long")
