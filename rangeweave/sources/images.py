"""PNG images without an image library: decoded in tasks and cut into tiles; patches of columns with their pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeweave.functions.grid_index import GridSpec
from rangeweave.operators.patches import ACROSS, UP
from rangeweave.session import ship

#: Edge of an image tile in pixels; columns whose samples a task works out at once.
TILE, AT_ONCE = 128, 64
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(content: bytes) -> np.ndarray:
    """[height, width, 3] of an 8-bit PNG without interlacing: grey, colour or palette, with alpha (left out) or without."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">2I5B", body)
            if depth != 8 or interlaced or colour not in _CHANNELS:
                raise ValueError("only 8-bit PNG images without interlacing are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    n = _CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width, n), dtype=np.uint8)
    above = np.zeros((width, n), dtype=np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(lines[y, 0], lines[y, 1:].reshape(width, n), above)
    if colour == 3:
        return palette[out[..., 0]]
    return out[..., :3] if n >= 3 else np.repeat(out[..., :1], 3, axis=2)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of pixels [width, channels] from its filtered bytes and the row above."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    out, left, corner = np.empty_like(line), np.zeros(line.shape[1], dtype=np.int32), np.zeros(line.shape[1], dtype=np.int32)
    for x in range(len(line)):
        up = above[x].astype(np.int32)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[x] = left = (line[x] + guess) & 255
        corner = up
    return out


def tiles(images: DataFrame, edge: int = TILE) -> DataFrame:
    """frame, tx, ty, width, height (of the tile), rgb: images (frame, content) in square tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, content in zip(b.column("frame").to_pylist(), b.column("content").to_pylist(), strict=True):
                image = decode_png(content)
                rows = []
                for ty in range(-(-image.shape[0] // edge)):
                    for tx in range(-(-image.shape[1] // edge)):
                        part = image[ty * edge : (ty + 1) * edge, tx * edge : (tx + 1) * edge]
                        rows.append((frame, tx, ty, part.shape[1], part.shape[0], part.tobytes()))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int32()] * 5, pa.binary()), strict=True)], ["frame", "tx", "ty", "width", "height", "rgb"])

    ship(images.sparkSession)
    return images.select(F.col("frame").cast("int").alias("frame"), "content").mapInArrow(run, "frame int, tx int, ty int, width int, height int, rgb binary")


def _half_up(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def face(i: np.ndarray, j: np.ndarray, matrix: list[float], spec: GridSpec, across: int, up: int) -> tuple[np.ndarray, ...]:
    """w, h (pixel), depth of the samples [column, across, up] of columns' faces, as patches.samples; depth 0 or less: behind the camera."""
    m = np.array(matrix).reshape(3, 4)
    x = (i - spec.n0 // 2) * spec.res - spec.res / 2
    y = ((j - spec.n1 // 2) * spec.res - spec.res / 2)[:, None] + (np.arange(across) + 0.5) * (spec.res / across)
    z = (np.arange(up) + 0.5) * (spec.n2 * spec.res / up) - spec.n2 * spec.res / 2
    u, v, d = (r[0] * x[:, None, None] + r[1] * y[:, :, None] + r[2] * z + r[3] for r in m)
    safe = np.where(d > 0, d, 1.0)
    return _half_up(u / safe), _half_up(v / safe), d


def patches(columns: DataFrame, images: DataFrame, pixels: DataFrame, matrix: list[float], spec: GridSpec, width: int, height: int, across: int = ACROSS, up: int = UP, edge: int = TILE) -> DataFrame:
    """frame, i, j, content: of each column (frame, i, j) the bytes [across][up][red, green, blue, depth error].

    images: tiles of the frames' images (width x height pixels); pixels: frame, w, h, depth of a depth image. A
    sample outside the image or behind the camera is black, with the error byte 255; so are the errors where no depth is
    known. A sample of row h has the image's row h - 1 from the top (row 0 for h = 0): images are addressed from the bottom up.
    Columns go to the tiles that their faces touch; what the tiles give is put together by column.
    """
    kind = "frame int, i int, j int"

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame, i, j = (b.column(c).to_numpy().astype(np.int64) for c in ("frame", "i", "j"))
            rows = [np.stack([frame, i, j, 0 * i - 1, 0 * i - 1], axis=1)]  # every column once, in no tile
            for at in range(0, len(i), AT_ONCE):
                s = slice(at, at + AT_ONCE)
                w, h, d = face(i[s], j[s], matrix, spec, across, up)
                seen = (d > 0) & (w >= 0) & (w < width) & (h >= 0) & (h < height)
                row = np.broadcast_to(np.arange(at, at + len(w))[:, None, None], w.shape)[seen]
                met = np.unique(np.stack([row, w[seen] // edge, np.maximum(h[seen] - 1, 0) // edge], axis=1), axis=0)
                rows.append(np.concatenate([np.stack([frame, i, j], axis=1)[met[:, 0]], met[:, 1:]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in np.concatenate(rows).T], ["frame", "i", "j", "tx", "ty"])

    def cut(key: tuple, asking: pa.Table, image: pa.Table) -> pa.Table:
        frame, tx, ty = (k.as_py() for k in key)
        out = []
        i, j = (asking.column(c).to_numpy().astype(np.int64) for c in ("i", "j"))
        if tx < 0 or not image.num_rows:
            out = [(a, b, b"", b"") for a, b in zip(i.tolist(), j.tolist(), strict=True)] if tx < 0 else []
        else:
            t = image.to_pylist()[0]
            rgb = np.frombuffer(t["rgb"], np.uint8).reshape(t["height"], t["width"], 3)
            depth = np.zeros((edge + 1, edge))
            if t["ws"]:
                depth[np.array(t["hs"]) - ty * edge, np.array(t["ws"]) - tx * edge] = t["ds"]
            for at in range(0, len(i), AT_ONCE):
                w, h, d = face(i[at : at + AT_ONCE], j[at : at + AT_ONCE], matrix, spec, across, up)
                top = np.maximum(h - 1, 0)
                mine = (d > 0) & (w >= 0) & (w < width) & (h >= 0) & (h < height) & (w // edge == tx) & (top // edge == ty)
                for n in range(len(w)):
                    ok = mine[n]
                    a, b = w[n][ok] - tx * edge, h[n][ok] - ty * edge
                    known = depth[b, a]
                    error = np.where(known < 1e-3, 255, np.clip(_half_up((known - d[n][ok]) * 100) + 127, 0, 255)).astype(np.uint8)
                    out.append((int(i[at + n]), int(j[at + n]), np.flatnonzero(ok).astype("<i4").tobytes(), np.concatenate([rgb[top[n][ok] - ty * edge, a], error[:, None]], axis=1).tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array([frame] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["frame", "i", "j", "at", "bytes"])

    def whole(key: tuple, parts: pa.Table) -> pa.Table:
        patch = np.zeros((across * up, 4), dtype=np.uint8)
        patch[:, 3] = 255
        for at, raw in zip(parts.column("at").to_pylist(), parts.column("bytes").to_pylist(), strict=True):
            patch[np.frombuffer(at, "<i4")] = np.frombuffer(raw, np.uint8).reshape(-1, 4)
        return pa.table([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([patch.tobytes()], pa.binary())], names=["frame", "i", "j", "content"])

    ship(columns.sparkSession)
    own = columns.select(*(F.col(c).cast("int").alias(c) for c in ("frame", "i", "j"))).distinct()
    asking = own.mapInArrow(touched, f"{kind}, tx int, ty int")
    # A pixel's depth belongs to the tile of the image row that goes with it.
    known = pixels.select("frame", F.expr(f"CAST(w div {edge} AS INT)").alias("tx"), F.expr(f"CAST(greatest(h - 1, 0) div {edge} AS INT)").alias("ty"), "w", "h", "depth")
    known = known.groupBy("frame", "tx", "ty").agg(*(F.collect_list(c).alias(n) for c, n in (("w", "ws"), ("h", "hs"), ("depth", "ds"))))
    image = images.join(known, ["frame", "tx", "ty"], "left")
    parts = asking.groupBy("frame", "tx", "ty").cogroup(image.groupBy("frame", "tx", "ty")).applyInArrow(cut, f"{kind}, at binary, bytes binary")
    return parts.groupBy("frame", "i", "j").applyInArrow(whole, f"{kind}, content binary")
