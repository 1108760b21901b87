"""Pyramids as one OME-TIFF file: channels are pages, their smaller levels sub-images of them.

Levels are made and deflated by the executors; the driver receives one tile at a time, in the order of the
file, and writes it. A table of offsets is all that it keeps."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import level_count
from ..operators import tiles
from ..sources import tiff
from .pyramid import next_level

#: OME names of sample types (fixed values).
TYPES = {"u1": "uint8", "u2": "uint16", "u4": "uint32", "i1": "int8", "i2": "int16", "i4": "int32", "f4": "float", "f8": "double"}


def checked_path(path: str, overwrite: bool = False) -> str:
    """The path, if it is one of an OME-TIFF that may be written."""
    if not path.endswith((".ome.tif", ".ome.tiff")):
        raise ValueError("an OME-TIFF ends with .ome.tif or .ome.tiff")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    return path


def ome_xml(height: int, width: int, names: list[str], dtype: str, pixel_size: float) -> str:
    channels = "".join(f'<Channel ID="Channel:0:{k}" Name={quoteattr(n)} SamplesPerPixel="1"/>' for k, n in enumerate(names))
    pixels = f'<Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="{TYPES[dtype]}" SizeX="{width}" SizeY="{height}" SizeC="{len(names)}" SizeZ="1" SizeT="1" PhysicalSizeX="{pixel_size}" PhysicalSizeXUnit="µm" PhysicalSizeY="{pixel_size}" PhysicalSizeYUnit="µm">'
    planes = "".join(f'<TiffData IFD="{k}" FirstC="{k}" FirstZ="0" FirstT="0" PlaneCount="1"/>' for k in range(len(names)))
    return f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0">{pixels}{channels}{planes}</Pixels></Image></OME>'


def _packed(dtype: str, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [zlib.compress(np.frombuffer(d).reshape(tile, tile).astype("<" + dtype).tobytes()) for d in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], names=["level", "channel", "ty", "tx", "data"])

    return run


def write_ome_tiff(pixels: DataFrame, path: str, height: int, width: int, names: list[str] | None = None, pixel_size: float = 1.0, factor: int = 2, mask: bool = False, tile: int = 1024, dtype: str = "u2", most: int = 1024, overwrite: bool = False) -> None:
    """Write pixels (channel, y, x, v) as a pyramid; a level is made of the one under it.

    factor is a whole number below the shorter side, tile a multiple of 16. Names count only if there
    is one for each channel."""
    if factor != int(factor) or not 1 < factor < min(height, width):
        raise ValueError("factor must be a whole number between 1 and the shorter side")
    if tile % 16:
        raise ValueError("tile must be a multiple of 16")
    checked_path(path, overwrite)
    found = sorted(r[0] for r in pixels.select("channel").distinct().collect())  # channels of one image
    names = names if names and len(names) == len(found) else [f"Channel {k + 1}" for k in range(len(found))]
    levels = level_count(max(height, width), factor, most)
    rows, at, sizes = None, pixels, [(height, width)]
    for k in range(levels):
        if k:
            at = next_level(at, factor, mask)
            sizes.append((-(-sizes[-1][0] // factor), -(-sizes[-1][1] // factor)))
        part = tiles.pack(at, tile).select(F.lit(k).alias("level"), "channel", "ty", "tx", "data")
        rows = part if rows is None else rows.unionByName(part)
    ready = rows.mapInArrow(_packed(dtype, tile), "level int, channel int, ty int, tx int, data binary").orderBy("level", "channel", "ty", "tx")
    where: dict[tuple[int, int, int, int], tuple[int, int]] = {}
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
        for r in ready.toLocalIterator():
            where[r.level, r.channel, r.ty, r.tx] = (f.tell(), len(r.data))
            f.write(r.data)

        def page(level: int, channel: int, subs: list[int]) -> int:
            """Write a page's table and what it points to; the place of the table."""
            h, w = sizes[level]
            spots = [where.get((level, channel, ty, tx), (0, 0)) for ty in range(-(-h // tile)) for tx in range(-(-w // tile))]
            per_cm = 1e4 / (pixel_size * factor**level)
            ratio = (round(per_cm * 10000), 10000)
            kinds = {"u": 1, "i": 2, "f": 3}
            tags: list[tuple[int, int, bytes, int]] = []

            def put(tag: int, kind: int, values) -> None:
                raw = values if kind == 2 else struct.pack("<" + {3: "H", 4: "I", 5: "I", 16: "Q", 18: "Q"}[kind] * len(values), *values)
                tags.append((tag, kind, raw, len(raw) if kind == 2 else len(values) // (2 if kind == 5 else 1)))

            for tag, value in ((tiff.WIDTH, w), (tiff.HEIGHT, h), (tiff.TILE_WIDTH, tile), (tiff.TILE_HEIGHT, tile), (254, int(level > 0))):
                put(tag, 4, [value])
            for tag, value in ((tiff.BITS, 8 * int(dtype[1:])), (tiff.COMPRESSION, 8), (tiff.PHOTOMETRIC, 1), (tiff.SAMPLES, 1), (tiff.PLANAR, 1), (tiff.RESOLUTION_UNIT, 3), (tiff.FORMAT, kinds[dtype[0]])):
                put(tag, 3, [value])
            put(tiff.X_RESOLUTION, 5, ratio)
            put(tiff.Y_RESOLUTION, 5, ratio)
            put(tiff.OFFSETS, 16, [s[0] for s in spots])
            put(tiff.COUNTS, 16, [s[1] for s in spots])
            put(tiff.SOFTWARE, 2, b"rasterloom\0")
            if not level and channel == found[0]:
                put(tiff.DESCRIPTION, 2, ome_xml(height, width, names, dtype, pixel_size).encode() + b"\0")
            if subs:
                put(tiff.SUB_IMAGES, 18, subs)
            entries = []
            for tag, kind, raw, n in sorted(tags):
                value = raw.ljust(8, b"\0")
                if len(raw) > 8:
                    value = struct.pack("<Q", f.tell())
                    f.write(raw)
                entries.append(struct.pack("<HHQ", tag, kind, n) + value)
            place = f.tell()
            f.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
            return place

        before = 8  # where the place of the next page is written
        for channel in found:
            subs = [page(level, channel, []) for level in range(1, levels)]
            place = page(0, channel, subs)
            end = f.tell()
            f.seek(before)
            f.write(struct.pack("<Q", place))
            f.seek(end)
            before = end - 8
