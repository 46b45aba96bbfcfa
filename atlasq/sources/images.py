"""Plain images: PNG files to pixel tables and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import Extent
from ..functions.projection import View

#: The first bytes of a PNG file, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PIXEL = "x int, y int, r int, g int, b int, a int"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(a: np.ndarray, level: int = 6) -> bytes:
    """PNG of bytes (rows, columns, 4); each row is stored as its difference to the row above, which packs smooth pictures well."""
    rows = np.ascontiguousarray(a, np.uint8).reshape(a.shape[0], -1)
    above = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    body = np.concatenate([np.full((len(rows), 1), 2, np.uint8), rows - above], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, level)) + _chunk(b"IEND", b"")


def _unfiltered(body: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from their differences; step is the distance to the same byte of the pixel before."""
    raw = np.frombuffer(body, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.int64)
    for y in range(height):
        kind, line, up = int(raw[y, 0]), raw[y, 1:].astype(np.int64), out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.int64)
            padded[:stride] = line
            out[y + 1] = (np.cumsum(padded.reshape(-1, step), axis=0) & 255).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = (line + up) & 255
        elif kind in (3, 4):
            own = out[y + 1]
            for x in range(0, stride, step):
                left = own[x - step : x] if x else np.zeros(step, np.int64)
                corner = up[x - step : x] if x else np.zeros(step, np.int64)
                u = up[x : x + step]
                if kind == 3:
                    guess = (left + u) >> 1
                else:
                    p = left + u - corner
                    a, b, c = np.abs(p - left), np.abs(p - u), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, u, corner))
                own[x : x + step] = (line[x : x + step] + guess) & 255
        else:
            raise ValueError(f"no row filter {kind}")
    return out[1:].astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """Bytes (rows, columns, 4) of a PNG that isn't interlaced: grey, colour or palette, with or without alpha; of 16 bits the upper eight."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, palette, clear = 8, [], None, None
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced or colour not in SAMPLES:
                raise ValueError("interlaced images aren't read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    samples = SAMPLES[colour]
    bits = depth * samples
    stride = (width * bits + 7) // 8
    rows = _unfiltered(zlib.decompress(b"".join(data)), height, stride, max(1, bits // 8))
    if depth < 8:
        rows = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth) @ (1 << np.arange(depth)[::-1])
        if colour == 0:
            rows = rows * 255 // ((1 << depth) - 1)
        v = rows.reshape(height, width, 1)
    else:
        v = rows.reshape(height, width, samples, depth // 8)[..., 0]
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = palette[v[..., 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[v[..., 0]]
        return out
    out[..., :3] = v[..., :3] if samples >= 3 else v[..., :1]
    if samples in (2, 4):
        out[..., 3] = v[..., -1]
    return out


def pixels(df: DataFrame, column: str = "content", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """x, y, r, g, b, a of the images in a binary column; where they have columns named tile_x and tile_y, pixels lie at those tiles' places.

    window (first column, first row, columns, rows) reads a part of each image.
    """
    tiles = {"tile_x", "tile_y"} <= set(df.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, raw in enumerate(frame[column]):
                a = decode(bytes(raw))
                x0, y0, w, h = window or (0, 0, a.shape[1], a.shape[0])
                part = a[y0 : y0 + h, x0 : x0 + w]
                y, x = np.mgrid[0 : part.shape[0], 0 : part.shape[1]]
                ox, oy = (int(frame["tile_x"].iloc[i]) * a.shape[1], int(frame["tile_y"].iloc[i]) * a.shape[0]) if tiles else (0, 0)
                flat = part.reshape(-1, 4).astype(np.int32)
                yield pd.DataFrame({"x": x.ravel() + x0 + ox, "y": y.ravel() + y0 + oy, **{c: flat[:, k] for k, c in enumerate("rgba")}})

    return df.select(column, *(["tile_x", "tile_y"] if tiles else [])).mapInPandas(run, PIXEL)


def read(spark: SparkSession, path: str, extent: Extent | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[View | None, DataFrame]:
    """The pixels of an image file and, given its extent, the view between its pixels and the world."""
    files = spark.read.format("binaryFile").load(path)
    if extent is None:
        return None, pixels(files, window=window)
    head = bytes(files.select(F.substring("content", 17, 8).alias("head")).first()["head"])
    width, height = struct.unpack(">II", head)
    return View(width, height, extent), pixels(files, window=window)


def to_png(df: DataFrame, size: int = 256) -> DataFrame:
    """tile_x, tile_y, content: PNG images of so many pixels a side; pixels that the table lacks are clear."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((size, size, 4), np.uint8)
        a[frame["y"].to_numpy() % size, frame["x"].to_numpy() % size] = frame[list("rgba")].to_numpy()
        return pd.DataFrame({"tile_x": frame["tile_x"].iloc[:1], "tile_y": frame["tile_y"].iloc[:1], "content": [encode(a)]})

    placed = df.select("x", "y", *"rgba", F.floor(F.col("x") / size).cast("int").alias("tile_x"), F.floor(F.col("y") / size).cast("int").alias("tile_y"))
    return placed.groupBy("tile_x", "tile_y").applyInPandas(run, "tile_x int, tile_y int, content binary")
