"""Pixels as raw arrays in binary columns: cropping, pasting, colour conversion, quality.

RGBA frames are height * width * 4 bytes by row; NV12 frames are a full plane
of luma and a half-height plane of interleaved chroma.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = "width int, height int, pixels binary"
CHANNELS = 4  # bytes of a pixel


def image(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 4)


@F.pandas_udf(T.BinaryType())
def crop(pixels: pd.Series, width: pd.Series, left: pd.Series, top: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    """The w x h part at (left, top) of RGBA images of the given width."""
    out = []
    for raw, wide, x, y, dx, dy in zip(pixels, width, left, top, w, h, strict=True):
        whole = np.frombuffer(raw, np.uint8).reshape(-1, int(wide), 4)
        out.append(whole[int(y) : int(y + dy), int(x) : int(x + dx)].tobytes())
    return pd.Series(out)


def pasted(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., width, height, pixels): tiles (x, y, width, height, pixels) of one frame put together."""
    fields = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def paste(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y, w, h = (table.column(c).to_numpy() for c in ("x", "y", "width", "height"))
        canvas = np.zeros((int((y + h).max()), int((x + w).max()), 4), np.uint8)
        for i, raw in enumerate(table.column("pixels")):
            canvas[y[i] : y[i] + h[i], x[i] : x[i] + w[i]] = image(raw.as_buffer(), int(w[i]), int(h[i]))
        values = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        size = {"width": pa.array([canvas.shape[1]], pa.int32()), "height": pa.array([canvas.shape[0]], pa.int32())}
        return pa.table(values | size | {"pixels": pa.array([canvas.tobytes()], pa.binary())})

    return tiles.select(*keys, "x", "y", "width", "height", "pixels").groupBy(*keys).applyInArrow(paste, f"{fields}, {IMAGE}")


# BT.709 weights and the limited range of luma.
_WR, _WB, _BLACK, _WHITE = 0.2126, 0.0722, 16, 235


def _matrix() -> np.ndarray:
    wg = 1 - _WR - _WB
    rows = [[1, 0, 2 * (1 - _WR)], [1, -2 * _WB * (1 - _WB) / wg, -2 * _WR * (1 - _WR) / wg], [1, 2 * (1 - _WB), 0]]
    return np.array(rows) * 255 / (_WHITE - _BLACK)


def rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """Red, green and blue of one pixel as column expressions: clamped and cut to whole numbers."""
    m = _matrix()
    return [F.floor(F.least(F.greatest(m[i, 0] * (y - 16) + m[i, 1] * (u - 128) + m[i, 2] * (v - 128), F.lit(0.0)), F.lit(255.0))).cast("int") for i in range(3)]


def nv12_to_rgba(raw: bytes, width: int, height: int) -> bytes:
    plane = np.frombuffer(raw, np.uint8).reshape(height * 3 // 2, width)
    chroma = plane[height:].reshape(height // 2, width // 2, 2).repeat(2, axis=0).repeat(2, axis=1)
    yuv = np.concatenate((plane[:height, :, None], chroma), axis=2).astype(np.float64) - np.array([16, 128, 128])
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = np.clip(yuv @ _matrix().T, 0, 255)
    return out.tobytes()


@F.pandas_udf(T.BinaryType())
def to_rgba(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """RGBA images of NV12 frames with even sides."""
    return pd.Series([nv12_to_rgba(p, int(w), int(h)) for p, w, h in zip(pixels, width, height, strict=True)])


@F.pandas_udf(T.BinaryType())
def without_alpha(pixels: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(p, np.uint8).reshape(-1, 4)[:, :3].tobytes() for p in pixels])


@F.pandas_udf(T.DoubleType())
def squared_error(one: pd.Series, two: pd.Series) -> pd.Series:
    """Mean squared difference of two images of a size."""
    return pd.Series([float(((np.frombuffer(a, np.uint8).astype(float) - np.frombuffer(b, np.uint8)) ** 2).mean()) for a, b in zip(one, two, strict=True)])


def psnr(error: Column) -> Column:
    """Decibels of a mean squared error; null where images are equal."""
    return F.when(error > 0, 10 * F.log10(255.0 * 255.0 / error))


# The window's side and the constants that keep quotients finite.
SSIM_SIDE, _C1, _C2 = 8, (0.01 * 255) ** 2, (0.03 * 255) ** 2


def _window_sums(plane: np.ndarray, side: int) -> np.ndarray:
    """Sums of every side x side window, from a summed-area table: whole numbers stay exact."""
    table = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), plane.dtype)
    table[1:, 1:] = plane.cumsum(axis=0).cumsum(axis=1)
    return table[side:, side:] - table[:-side, side:] - table[side:, :-side] + table[:-side, :-side]


def structural_similarity(one: np.ndarray, two: np.ndarray, side: int = SSIM_SIDE) -> float:
    """Mean structural similarity of two planes of bytes over all windows; smaller planes are one window."""
    side = min(side, *one.shape)
    a, b, n = one.astype(np.int64), two.astype(np.int64), side * side
    sa, sb, saa, sbb, sab = (_window_sums(p, side) for p in (a, b, a * a, b * b, a * b))
    va, vb, both = ((n * x - y * z) / (n * n) for x, y, z in ((saa, sa, sa), (sbb, sb, sb), (sab, sa, sb)))
    ma, mb = sa / n, sb / n
    return float((((2 * ma * mb + _C1) * (2 * both + _C2)) / ((ma * ma + mb * mb + _C1) * (va + vb + _C2))).mean())


@F.pandas_udf(T.DoubleType())
def plane_ssim(one: pd.Series, two: pd.Series, width: pd.Series) -> pd.Series:
    """Structural similarity of two planes of bytes, given as arrays of numbers by row."""
    planes = zip(*(([np.asarray(v, np.uint8) for v in c]) for c in (one, two)), width, strict=True)
    return pd.Series([structural_similarity(a.reshape(-1, int(w)), b.reshape(-1, int(w))) for a, b, w in planes], dtype=float)


@F.pandas_udf(T.DoubleType())
def ssim(one: pd.Series, two: pd.Series, width: pd.Series) -> pd.Series:
    """Structural similarity of two RGBA images of a size and width: the mean over red, green and blue."""
    out = []
    for a, b, w in zip(one, two, width, strict=True):
        p, q = (np.frombuffer(x, np.uint8).reshape(-1, int(w), CHANNELS) for x in (a, b))
        out.append(sum(structural_similarity(p[..., c], q[..., c]) for c in range(3)) / 3)
    return pd.Series(out, dtype=float)


def synthetic(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames with width, height and pixels of value (x, y, frame, 255), all mod 256."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros((height, width, 4), np.uint8)
        base[..., 0], base[..., 1], base[..., 3] = np.arange(width) % 256, (np.arange(height) % 256)[:, None], 255
        for batch in batches:
            out = []
            for frame in batch.column(batch.schema.names.index("frame")).to_pylist():
                base[..., 2] = frame % 256
                out.append(base.tobytes())
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(out, pa.binary())], names=[*batch.schema.names, "width", "height", "pixels"])

    return frames.mapInArrow(draw, f"{fields}, {IMAGE}")


_CUT = "video string, first_frame int, gop int, frame int, tile_no int, x int, y int, width int, height int, pixels binary"


def cut(frames: DataFrame) -> DataFrame:
    """A row for each tile of frames (video, first_frame, gop, frame, width, pixels, tiles): a frame goes to Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                *own, width, pixels, tiles = (row.column(c)[0].as_py() for c in range(7))
                raw = np.frombuffer(pixels, np.uint8).reshape(-1, width, 4)
                out = [(*own, t["tile_no"], t["x"], t["y"], t["width"], t["height"], raw[t["y"] : t["y"] + t["height"], t["x"] : t["x"] + t["width"]].tobytes()) for t in tiles]
                fields = [c.split() for c in _CUT.split(", ")]
                kind = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(x, kind[k]) for x, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return frames.mapInArrow(run, _CUT)
