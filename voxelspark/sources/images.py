"""Image files as data sources: raw frames, TGA and BMP, and tiles of them, read a file to a task and written a file to a frame.

``spark.read.format("rawframe" | "tga" | "bmp")`` gives a row for each pixel.  Frame numbers and tile places come from file names:
the last number before the extension is the frame, and in ``..._<tx>_<ty>.<ext>`` the last two are the tile.  Filters on
``frame``, ``tx`` and ``ty`` leave whole files out where Spark pushes them down (``spark.sql.python.filterPushdown.enabled``); with
a schema given to the reader only its columns are made."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "path string, frame int, tx int, ty int, x int, y int, r int, g int, b int, a int, depth float"
#: Fixed value: the first bytes of a raw frame.
RAW_MAGIC = b"V6F0"
#: Pixels of a batch.
BATCH = 1 << 16


@dataclass
class Image:
    """Colours (height, width, 4) in rows from the top, and depths of the same shape or none."""

    rgba: np.ndarray
    depth: np.ndarray | None = None


# --- raw frames --------------------------------------------------------------------------------------------------------


def raw_image(name: str, data: bytes) -> Image:
    if data[:4] != RAW_MAGIC or len(data) < 12:
        raise ValueError(f"{name}: not a raw frame")
    width, height = struct.unpack("<II", data[4:12])
    n = width * height
    if len(data) != 12 + 8 * n:
        raise ValueError(f"{name}: {len(data)} bytes, not {12 + 8 * n}")
    colours = np.frombuffer(data, np.uint8, 4 * n, 12).reshape(height, width, 4)
    return Image(colours, np.frombuffer(data, "<f4", n, 12 + 4 * n).reshape(height, width))


def raw_bytes(image: Image) -> bytes:
    height, width = image.rgba.shape[:2]
    depth = np.zeros((height, width), "<f4") if image.depth is None else image.depth.astype("<f4")
    return RAW_MAGIC + struct.pack("<II", width, height) + image.rgba.astype(np.uint8).tobytes() + depth.tobytes()


# --- TGA ---------------------------------------------------------------------------------------------------------------

#: Fixed values of the format: kinds of images, and the bit that tells of runs.
_MAPPED, _TRUE, _GREY, _RUNS = 1, 2, 3, 8


def _unpacked(body: bytes, count: int, step: int, name: str) -> np.ndarray:
    """``count`` pixels of ``step`` bytes from runs: a count, then one pixel to repeat or so many pixels."""
    out, at, have = [], 0, 0
    while have < count:
        if at >= len(body):
            raise ValueError(f"{name}: cut short")
        n = (body[at] & 127) + 1
        if body[at] & 128:
            out.append(body[at + 1 : at + 1 + step] * n)
            at += 1 + step
        else:
            out.append(body[at + 1 : at + 1 + n * step])
            at += 1 + n * step
        have += n
    return np.frombuffer(b"".join(out)[: count * step], np.uint8)


def _colours(pixels: np.ndarray, bits: int, alpha_bits: int) -> np.ndarray:
    """RGBA of pixels (n, bytes) of 15, 16, 24 or 32 bits, blue first."""
    if bits in (15, 16):
        v = pixels[:, 0].astype(np.int32) | pixels[:, 1].astype(np.int32) << 8
        five = lambda s: ((v >> s & 31) * 255 + 15) // 31
        alpha = np.where(v >> 15, 255, 0) if bits == 16 and alpha_bits else np.full(len(v), 255)
        return np.stack([five(10), five(5), five(0), alpha], axis=1).astype(np.uint8)
    alpha = pixels[:, 3] if bits == 32 else np.full(len(pixels), 255, np.uint8)
    return np.stack([pixels[:, 2], pixels[:, 1], pixels[:, 0], alpha], axis=1)


def tga_image(name: str, data: bytes) -> Image:
    """Colour-mapped, true-colour and grey images, plain or in runs, from any corner."""
    if len(data) < 18:
        raise ValueError(f"{name}: cut short")
    skip, _, kind, first, entries, entry_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    base, count, alpha_bits = kind & ~_RUNS, width * height, flags & 15
    fits = {_MAPPED: (8, 16), _TRUE: (15, 16, 24, 32), _GREY: (8, 16)}.get(base)
    if fits is None or bits not in fits or (base == _MAPPED and entry_bits not in (15, 16, 24, 32)):
        raise ValueError(f"{name}: kind {kind} of {bits} bits is not read")
    at, step = 18 + skip, (bits + 7) // 8
    map_bytes = entries * ((entry_bits + 7) // 8)
    palette = _colours(np.frombuffer(data, np.uint8, map_bytes, at).reshape(entries, -1), entry_bits, alpha_bits) if entries and base == _MAPPED else None
    body = data[at + map_bytes :]
    raw = _unpacked(body, count, step, name) if kind & _RUNS else np.frombuffer(body[: count * step], np.uint8)
    if len(raw) != count * step:
        raise ValueError(f"{name}: cut short")
    pixels = raw.reshape(count, step)
    if base == _GREY:
        grey, alpha = pixels[:, 0], pixels[:, 1] if step == 2 else np.full(count, 255, np.uint8)
        rgba = np.stack([grey, grey, grey, alpha], axis=1)
    elif base == _MAPPED:
        index = pixels[:, 0].astype(np.int64) | (pixels[:, 1].astype(np.int64) << 8 if step == 2 else 0)
        if palette is None or (count and not 0 <= index.min() - first <= index.max() - first < entries):
            raise ValueError(f"{name}: a colour that its map lacks")
        rgba = palette[index - first]
    else:
        rgba = _colours(pixels, bits, alpha_bits)
    rgba = rgba.reshape(height, width, 4)
    rgba = rgba if flags & 0x20 else rgba[::-1]
    return Image(rgba[:, ::-1] if flags & 0x10 else rgba)


def tga_bytes(image: Image) -> bytes:
    """32-bit true colour, rows from the top."""
    height, width = image.rgba.shape[:2]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, _TRUE, 0, 0, 0, 0, 0, width, height, 32, 0x28) + image.rgba[:, :, [2, 1, 0, 3]].astype(np.uint8).tobytes()


# --- BMP ---------------------------------------------------------------------------------------------------------------


def bmp_image(name: str, data: bytes) -> Image:
    """Uncompressed images of 24 bits, or of 32 without use of the fourth."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError(f"{name}: not a BMP file")
    (start,), (width, height) = struct.unpack("<I", data[10:14]), struct.unpack("<ii", data[18:26])
    bits, packed = struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[30:34])[0]
    if bits not in (24, 32) or packed:
        raise ValueError(f"{name}: {bits} bits, packed {packed} is not read")
    step, rows = bits // 8, abs(height)
    line = (width * step + 3) // 4 * 4
    pixels = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)[:, : width * step].reshape(rows, width, step)
    rgba = np.concatenate([pixels[:, :, [2, 1, 0]], np.full((rows, width, 1), 255, np.uint8)], axis=2)
    return Image(rgba[::-1] if height > 0 else rgba)


def bmp_bytes(image: Image) -> bytes:
    height, width = image.rgba.shape[:2]
    line = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, line), np.uint8)
    body[:, : width * 3] = image.rgba[::-1, :, [2, 1, 0]].reshape(height, width * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


CODECS = {"rawframe": (raw_image, raw_bytes, "frm"), "tga": (tga_image, tga_bytes, "tga"), "bmp": (bmp_image, bmp_bytes, "bmp")}


# --- the sources -------------------------------------------------------------------------------------------------------


@dataclass
class ImageFile(InputPartition):
    path: str | None
    frame: int | None = None
    tx: int | None = None
    ty: int | None = None


def numbers_of(path: str) -> tuple[int | None, int | None, int | None]:
    """(frame, tx, ty) that a file's name tells."""
    name = path.rpartition("/")[2].rpartition(".")[0]
    last = re.search(r"(\d+)\D*$", name)
    tile = re.search(r"_(\d+)_(\d+)$", name)
    return (int(last[1]) if last and not tile else None, *((int(tile[1]), int(tile[2])) if tile else (None, None)))


class ImageReader(DataSourceReader):
    def __init__(self, kind: str, options, columns: list[str]):
        self.kind, self.path, self.columns = kind, options["path"], columns
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership of numbers that file names tell choose the files; all else stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("frame",), ("tx",), ("ty",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        found = [ImageFile(x.path, *numbers_of(x.path)) for x in sorted(files, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", ".")) and (info.is_file or x.extension == CODECS[self.kind][2])]
        return [x for x in found if all(getattr(x, c) in v for c, v in self.wanted.items())] or [ImageFile(None)]

    def read(self, partition: ImageFile) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.path) as file:
            image = CODECS[self.kind][0](partition.path, file.read())
        height, width = image.rgba.shape[:2]
        for lo in range(0, width * height, BATCH):
            at = np.arange(lo, min(lo + BATCH, width * height))
            y, x = np.divmod(at, max(width, 1))
            made = []
            for c in self.columns:
                if c in "xyrgba":
                    v = {"x": x, "y": y}[c] if c in "xy" else image.rgba[y, x, "rgba".index(c)]
                    made.append(pa.array(v.astype(np.int32)))
                elif c == "depth":
                    made.append(pa.nulls(len(at), pa.float32()) if image.depth is None else pa.array(image.depth[y, x].astype(np.float32)))
                else:
                    made.append(pa.array([getattr(partition, c)] * len(at), pa.string() if c == "path" else pa.int32()))
            yield pa.RecordBatch.from_arrays(made, self.columns)


@dataclass
class Written(WriterCommitMessage):
    files: int


class ImageWriter(DataSourceArrowWriter):
    """A file for each frame; its rows must come together.  A file gets its name when it is whole, so a task that runs again
    replaces what it wrote."""

    def __init__(self, kind: str, options, names: list[str]):
        self.kind, self.path, self.names = kind, options["path"], names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        keys = ("tx", "ty") if "tx" in self.names else ("frame",)
        now: tuple | None = None
        waiting: list[pa.Table] = []
        files = 0

        def put() -> int:
            if now is None:
                return 0
            rows = {c: np.concatenate([t[c].to_numpy() for t in waiting]) for c in self.names if c not in keys}
            shape = (int(rows["y"].max()) + 1, int(rows["x"].max()) + 1)
            rgba, depth = np.zeros((*shape, 4), np.uint8), np.zeros(shape, np.float32)
            for i, c in enumerate("rgba"):
                rgba[rows["y"], rows["x"], i] = rows[c] if c in rows else 255
            if "depth" in rows:
                depth[rows["y"], rows["x"]] = rows["depth"]
            name = "tile_" + "_".join(f"{k:05d}" for k in now) if len(keys) == 2 else f"frame-{now[0]:08d}"
            draft = f"{root}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(CODECS[self.kind][1](Image(rgba, depth)))
            fs.move(draft, f"{root}/{name}.{CODECS[self.kind][2]}")
            return 1

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            key = list(zip(*(table[c].to_pylist() for c in keys), strict=True))
            cuts = [0] + [k for k in range(1, len(key)) if key[k] != key[k - 1]] + [len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key[a] != now:
                    files += put()
                    now, waiting = key[a], []
                waiting.append(table.slice(a, b - a))
        return Written(files + put())

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        fs.open_output_stream(f"{root}/_SUCCESS").close()


def _source(kind: str) -> type[DataSource]:
    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown := [c for c in schema.names if c not in known]:
            raise ValueError(f"images have no columns {unknown}")
        return ImageReader(kind, self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(kind, self.options, schema.names)

    return type(f"{kind.title()}Source", (DataSource,), {"name": classmethod(lambda cls: kind), "schema": schema, "reader": reader, "writer": writer, "__module__": __name__})


RawframeSource, TgaSource, BmpSource = (_source(k) for k in ("rawframe", "tga", "bmp"))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets filters reach them."""
    for source in (RawframeSource, TgaSource, BmpSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_images(spark: SparkSession, path: str, kind: str, columns: str | None = None) -> DataFrame:
    """Pixels of all files of a kind below ``path``; ``columns`` (a schema) names those that are made."""
    register(spark)
    reader = spark.read.format(kind)
    return (reader.schema(columns) if columns else reader).load(path)


def write_images(pixels: DataFrame, path: str, kind: str) -> None:
    """A file for each ``frame``, or each tile (``tx``, ``ty``): its pixels ``x, y, r, g, b`` and maybe ``a`` and ``depth`` meet in one task,
    which sorts a run of frames and holds one at a time."""
    register(pixels.sparkSession)
    keys = ["tx", "ty"] if "tx" in pixels.columns else ["frame"]
    names = [c for c in (*keys, "x", "y", "r", "g", "b", "a", "depth") if c in pixels.columns]
    pixels.select(*names).repartition(*keys).sortWithinPartitions(*keys).write.format(kind).mode("append").save(path)
