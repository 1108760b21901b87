"""Tiled TIFF and BigTIFF files as tile rows, by a Python data source: a partition reads some tiles.

Pages are channels; a page's sub-images, or further pages of the same number, are its levels. Tiles are
plain or deflated, with whole numbers or floats. `spark.read.format("tiled_tiff").load(path)`."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "level int, channel int, ty int, tx int, h int, w int, data binary"
# Fixed values of the format: tags, and the struct code of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
SAMPLES, X_RESOLUTION, Y_RESOLUTION, PLANAR, RESOLUTION_UNIT, SOFTWARE = 277, 282, 283, 284, 296, 305
TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, SUB_IMAGES, FORMAT = 322, 323, 324, 325, 330, 339
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATED = 1, (8, 32946)


@dataclass
class Page:
    tags: dict[int, tuple]
    places: dict[int, int] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def dtype(self) -> str:
        bits = self.one(BITS, 8)
        return {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)] + str(bits // 8)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.one(HEIGHT) // self.one(TILE_HEIGHT)), -(-self.one(WIDTH) // self.one(TILE_WIDTH))


class TiffFile:
    """The pages of a file; only their tables are read."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.read(16)
            self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
            kind = struct.unpack(f"{self.order or '<'}H", head[2:4])[0]
            if self.order is None or kind not in (42, 43):
                raise ValueError(f"{path} is no TIFF file")
            self.big = kind == 43
            first = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
            self.pages: list[list[Page]] = []
            while first:
                page, first = self._page(f, first)
                self.pages.append([page, *(self._page(f, at)[0] for at in page.tags.get(SUB_IMAGES, ()))])

    def _page(self, f, at: int) -> tuple[Page, int]:
        count, word, entry = ("Q", "Q", 20) if self.big else ("H", "I", 12)
        f.seek(at)
        n = struct.unpack(self.order + count, f.read(struct.calcsize(count)))[0]
        raw = f.read(n * entry)
        after = struct.unpack(self.order + word, f.read(struct.calcsize(word)))[0]
        page = Page({})
        room = struct.calcsize(word)
        for k in range(n):
            one = raw[k * entry : (k + 1) * entry]
            tag, kind, many = struct.unpack(self.order + "HH" + word, one[: entry - room])
            code = CODES.get(kind)
            if code is None:
                continue
            form = f"{self.order}{many}s" if code == "s" else self.order + code * many
            size = struct.calcsize(form)
            value = one[entry - room :]
            if size > room:
                f.seek(struct.unpack(self.order + word, value)[0])
                value = f.read(size)
            page.tags[tag] = struct.unpack(form, value[:size])
            page.places[tag] = at + struct.calcsize(count) + k * entry
        return page, after

    @property
    def levels(self) -> list[list[Page]]:
        """Per level the pages of all channels; files of several series of equal size have these as levels."""
        if len(self.pages) > 1 and len(self.pages[0]) == 1:
            sizes = list(dict.fromkeys((p[0].one(HEIGHT), p[0].one(WIDTH)) for p in self.pages))
            return [[p[0] for p in self.pages if (p[0].one(HEIGHT), p[0].one(WIDTH)) == s] for s in sizes]
        return [[p[k] for p in self.pages] for k in range(min(map(len, self.pages)))]

    def text(self, tag: int) -> str | None:
        value = self.pages[0][0].one(tag)
        return value.rstrip(b"\0").decode("utf-8", "replace") if value is not None else None


@dataclass
class _Tiles(InputPartition):
    path: str
    order: str
    dtype: str
    compression: int
    samples: int
    wanted: list[tuple[int, int, int, int, int, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.many = options["path"], int(options.get("tilesPerPartition", 64))

    def partitions(self) -> list[InputPartition]:
        file = TiffFile(self.path)
        out = []
        for level, pages in enumerate(file.levels):
            for channel, page in enumerate(pages):
                if TILE_WIDTH not in page.tags:
                    raise ValueError("only tiled files are read")
                if page.one(COMPRESSION, PLAIN) not in (PLAIN, *DEFLATED):
                    raise ValueError(f"compression {page.one(COMPRESSION)} is not known")
                rows, columns = page.grid
                samples = page.one(SAMPLES, 1)
                planes = samples if page.one(PLANAR, 1) == 2 else 1
                h, w = page.one(TILE_HEIGHT), page.one(TILE_WIDTH)
                every = [(level, channel * samples + p, ty, tx, h, w, page.tags[OFFSETS][i], page.tags[COUNTS][i]) for p in range(planes) for ty in range(rows) for tx in range(columns) for i in ((p * rows + ty) * columns + tx,)]
                for at in range(0, len(every), self.many):
                    out.append(_Tiles(self.path, file.order, page.dtype, page.one(COMPRESSION, PLAIN), samples if planes == 1 else 1, every[at : at + self.many]))
        return out

    def read(self, part: _Tiles) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            for level, channel, ty, tx, h, w, offset, count in part.wanted:
                if not count:
                    continue  # a tile that was never written is empty
                f.seek(offset)
                raw = f.read(count)
                if part.compression in DEFLATED:
                    raw = zlib.decompress(raw)
                values = np.frombuffer(raw, dtype=part.order + part.dtype).reshape(h, w, part.samples)
                for k in range(part.samples):
                    yield level, channel + k, ty, tx, h, w, values[:, :, k].astype("<f8").tobytes()


class TiledTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tiff(spark: SparkSession, path: str, tiles_per_partition: int = 64) -> DataFrame:
    """(level, channel, ty, tx, h, w, data) of a file that every executor can open."""
    spark.dataSource.register(TiledTiff)
    return spark.read.format("tiled_tiff").option("tilesPerPartition", tiles_per_partition).load(path)


def tiff_levels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slide, level, channels, height, width, tile_h, tile_w, dtype) of files, from their tables."""
    rows = []
    for path in paths:
        for level, pages in enumerate(TiffFile(path).levels):
            p = pages[0]
            rows.append((path, level, len(pages) * p.one(SAMPLES, 1), p.one(HEIGHT), p.one(WIDTH), p.one(TILE_HEIGHT), p.one(TILE_WIDTH), p.dtype))
    return spark.createDataFrame(rows, "slide string, level int, channels int, height int, width int, tile_h int, tile_w int, dtype string")


def tiff_tags(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(slide, photometric, x_resolution, y_resolution, unit, software, xml): what a copy of a file carries over."""
    rows = []
    for path in paths:
        file = TiffFile(path)
        page = file.pages[0][0]
        ratio = lambda t: page.tags[t][0] / page.tags[t][1] if t in page.tags and page.tags[t][1] else None  # noqa: B023, E731
        rows.append((path, page.one(PHOTOMETRIC), ratio(X_RESOLUTION), ratio(Y_RESOLUTION), page.one(RESOLUTION_UNIT), file.text(SOFTWARE), file.text(DESCRIPTION)))
    return spark.createDataFrame(rows, "slide string, photometric int, x_resolution double, y_resolution double, unit int, software string, xml string")


def replace_description(path: str, text: str) -> None:
    """Put another description into a file: it is added at the end, and the first page's entry points to it."""
    file = TiffFile(path)
    at = file.pages[0][0].places.get(DESCRIPTION)
    if at is None:
        raise ValueError("the file has no description to replace")
    raw = text.encode() + b"\0"
    raw += b"\0" * (9 - len(raw) if len(raw) < 9 else 0)  # short text would have to lie in the entry itself
    word = "Q" if file.big else "I"
    with open(path, "r+b") as f:
        f.seek(0, 2)
        end = f.tell()
        f.write(raw)
        f.seek(at + 4)
        f.write(struct.pack(file.order + word * 2, len(raw), end))


def replace_in_description(path: str, old: str, new: str) -> int:
    """How often a piece of a file's description was replaced; a file without it is left alone."""
    text = TiffFile(path).text(DESCRIPTION) or ""
    found = text.count(old)
    if found:
        replace_description(path, text.replace(old, new))
    return found
