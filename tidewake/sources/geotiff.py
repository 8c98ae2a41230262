"""Bands of (Geo)TIFF files and SAFE products as tables: files, their strips or tiles, decoded blocks, pixels; and a writer.

Only what a query needs is read: a file's directory for :func:`headers` and :func:`chunks`, and byte ranges of the strips and tiles
that are left after filters for :func:`blocks`.  Strips are rows, so one file is read by as many tasks as it has strips.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.blocks import pixels_of
from tidewake.scratch import saved
from tidewake.sources.ais import read_manifest

# ---- fixed values of the formats (TIFF 6.0, BigTIFF, GeoTIFF 1.1)

SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODE = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANES, SOFTWARE, DATETIME, PREDICTOR = 256, 257, 258, 259, 270, 273, 277, 278, 279, 284, 305, 306, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, ITEMS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42112, 42113
RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1025, 2048, 3072
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946

Read = Callable[[int, int], bytes]  # (offset, number of bytes)


# ---- a file's directory


def _reader(path: str) -> Read:
    """Byte ranges of a file in any store that Arrow knows by its URI."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        store, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(path)
    file = store.open_input_file(at)
    return lambda offset, n: file.read_at(n, offset)


def directory(read: Read) -> tuple[str, dict[int, Any]]:
    """(byte order, values by tag) of a file's first directory; numbers are tuples, texts are strings."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + "Q", start[8:16])[0] if big else struct.unpack(order + "I", start[4:8])[0]
    head, entry, room, number = (8, 20, 8, "Q") if big else (2, 12, 4, "I")
    n = struct.unpack(order + ("Q" if big else "H"), read(at, head))[0]
    raw, out = read(at + head, n * entry), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{number}", raw, k * entry)
        size = SIZE.get(kind, 0) * count
        value = raw[(k + 1) * entry - room : (k + 1) * entry]
        if size > room:
            value = read(struct.unpack(order + number, value)[0], size)
        if kind == 2:
            out[tag] = value[:size].split(b"\0")[0].decode("utf-8", "replace")
        elif kind in CODE:
            out[tag] = struct.unpack(f"{order}{count}{CODE[kind]}", value[:size])
    return order, out


def _affine(tags: dict[int, Any], keys: dict[int, int]) -> tuple[float, ...] | None:
    """(a, b, c, d, e, f) from corners of pixels (x, y) to coordinates; points of pixel centres are moved by half a pixel."""
    if MATRIX in tags:
        m = tags[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINTS][:5]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        return None
    half = 0.5 if keys.get(RASTER_TYPE) == 2 else 0.0
    return a, b, c - half * (a + b), d, e, f - half * (d + e)


def described(read: Read) -> dict[str, Any]:
    """What a file says of itself, and how its chunks are coded."""
    order, t = directory(read)
    one = lambda tag, default=None: t[tag][0] if tag in t else default
    keys = {k: v for k, at, _, v in zip(*[iter(t.get(GEO_KEYS, ())[4:])] * 4) if at == 0}
    epsg = next((keys[k] for k in (PROJECTED, GEOGRAPHIC) if 0 < keys.get(k, 0) < 32767), None)
    tags = {name: t[tag] for name, tag in (("TIFFTAG_DATETIME", DATETIME), ("TIFFTAG_SOFTWARE", SOFTWARE), ("TIFFTAG_IMAGEDESCRIPTION", DESCRIPTION)) if tag in t}
    tags |= {name: text for attributes, text in re.findall(r"<Item ([^>]*)>([^<]*)</Item>", t.get(ITEMS, "")) if "sample=" not in attributes for name in re.findall(r'name="([^"]*)"', attributes)}
    if RASTER_TYPE in keys:
        tags["AREA_OR_POINT"] = "Point" if keys[RASTER_TYPE] == 2 else "Area"
    bits, width, height, bands = set(t.get(BITS, (1,))), one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None or len(bits) > 1 or (b := bits.pop()) % 8 or f"{kind}{b // 8}" not in ("u1", "i1", "u2", "i2", "f2", "u4", "i4", "f4", "u8", "i8", "f8"):
        raise ValueError("samples of this kind are not read")
    if (compression := one(COMPRESSION, NONE)) not in (NONE, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {compression} is not read")
    tiled = TILE_OFFSETS in t
    h, w = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, height), height), width)
    offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t[COUNTS])
    affine, no_data = _affine(t, keys), t.get(NO_DATA)
    return {"width": width, "height": height, "bands": bands, "dtype": f"{order}{kind}{b // 8}", "epsg": epsg, "affine": dict(zip("abcdef", map(float, affine))) if affine else None, "tags": tags, "acquired": tags.get("TIFFTAG_DATETIME"), "no_data": float(no_data) if no_data else None, "h": h, "w": w, "tiled": tiled, "compression": compression, "predictor": one(PREDICTOR, 1), "apart": one(PLANES, 1) == 2, "offsets": offsets, "counts": counts}


# ---- decoding


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    out, table, width, code_at, last = [], [], 9, 0, None
    bits, held = 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def decoded(raw: bytes, dtype: str, rows: int, columns: int, samples: int, compression: int, predictor: int) -> np.ndarray:
    """A chunk's samples as (rows, columns, samples)."""
    data = {NONE: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}[compression](raw)
    kind, need = np.dtype(dtype), rows * columns * samples * np.dtype(dtype).itemsize
    if len(data) < need:
        raise ValueError(f"{len(data)} bytes instead of {need}")
    if predictor == 3:  # bytes of a row by their rank in the number, highest first, as differences
        planes = np.cumsum(np.frombuffer(data, np.uint8, need).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        swapped = planes.reshape(rows, kind.itemsize, columns * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(swapped).view(kind.newbyteorder(">")).reshape(rows, columns, samples)
    out = np.frombuffer(data, kind, rows * columns * samples).reshape(rows, columns, samples)
    return np.cumsum(out, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else out


# ---- tables

_AFFINE = "affine struct<a:double,b:double,c:double,d:double,e:double,f:double>"
_CODING = "dtype string, rows int, columns int, samples int, compression int, predictor int, no_data double"


def files(spark: SparkSession, path: str | list[str], pattern: str = "*.tif*", content: bool = False) -> DataFrame:
    """``(path, length[, content])`` of files at and below ``path``.

    Without ``content`` nothing but their listing is read, and tasks later read byte ranges by URI.  With it Spark reads whole files of up
    to 2 GB, for stores that only Spark can open.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", *(["content"] if content else []))


def _each_file(batch: pa.RecordBatch) -> Iterator[tuple[str, dict[str, Any] | None, str | None, bytes | None]]:
    """(path, description, error, content) of each file of a batch."""
    has = "content" in batch.schema.names
    for i, path in enumerate(batch.column("path").to_pylist()):
        content = batch.column("content")[i].as_py() if has else None
        try:
            yield path, described((lambda at, n: content[at : at + n]) if has else _reader(path)), None, content
        except (ValueError, KeyError, struct.error, OSError) as e:
            yield path, None, f"{type(e).__name__}: {e}", content


def headers(found: DataFrame) -> DataFrame:
    """One row per file: ``path, width, height, bands, dtype, epsg, affine, tags, acquired, no_data, n_chunks, error``.

    A file that is no TIFF or is coded in a way that isn't read has an ``error`` and NULLs.
    """
    ddl = f"path string, width int, height int, bands int, dtype string, epsg int, {_AFFINE}, tags map<string,string>, acquired string, no_data double, n_chunks int, error string"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.struct([(k, pa.float64()) for k in "abcdef"]), pa.map_(pa.string(), pa.string()), pa.string(), pa.float64(), pa.int32(), pa.string()]
    names = re.findall(r"(?:^|, )(\w+) ", ddl)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [({k: (list(v.items()) if k == "tags" else v) for k, v in d.items()} | {"n_chunks": len(d["counts"])} if d else {}) | {"path": path, "error": error} for path, d, error, _ in _each_file(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return found.mapInArrow(told, ddl)


def chunks(found: DataFrame) -> DataFrame:
    """One row per strip or tile of readable files, not decoded: ``path, band`` (0: all bands, side by side), ``y0, x0, h, w, offset, bytes``,
    the file's ``affine``, how it is coded, and with content also ``raw``.  Filter it, and only what is left will be read.
    """
    has = "content" in found.columns
    ddl = f"path string, band int, y0 int, x0 int, h int, w int, offset long, bytes long, {_AFFINE}, {_CODING}" + ", raw binary" * has
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "struct": pa.struct([(k, pa.float64()) for k in "abcdef"])}
    columns = [(n, types[t]) for n, t in re.findall(r"(?:^|, )(\w+) (\w+)", ddl)]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, d, _, content in _each_file(batch):
                if not d:
                    continue
                across, down = -(-d["width"] // d["w"]), -(-d["height"] // d["h"])
                rows = []
                for k, (offset, n) in enumerate(zip(d["offsets"], d["counts"])):
                    band, at = divmod(k, across * down)
                    y0, x0 = at // across * d["h"], at % across * d["w"]
                    h, w = min(d["h"], d["height"] - y0), min(d["w"], d["width"] - x0)
                    rows.append((path, band + 1 if d["apart"] else 0, y0, x0, h, w, offset, n, d["affine"], d["dtype"], d["h"] if d["tiled"] else h, d["w"], 1 if d["apart"] else d["bands"], d["compression"], d["predictor"], d["no_data"], *([content[offset : offset + n]] if has else [])))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], [c for c, _ in columns])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], [c for c, _ in columns])

    return found.mapInArrow(told, ddl)


def in_window(found: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """Chunks (or blocks) that meet the half-open window of pixels."""
    return found.where((F.col("y0") < y1) & (F.col("y0") + F.col("h") > y0) & (F.col("x0") < x1) & (F.col("x0") + F.col("w") > x0))


def in_box(found: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Chunks whose own box, in the coordinates of their file, meets the closed box; those without an affine go."""
    a = {k: F.col(f"affine.{k}") for k in "abcdef"}
    corners = [(x, y) for x in (F.col("x0"), F.col("x0") + F.col("w")) for y in (F.col("y0"), F.col("y0") + F.col("h"))]
    xs, ys = [a["a"] * x + a["b"] * y + a["c"] for x, y in corners], [a["d"] * x + a["e"] * y + a["f"] for x, y in corners]
    return found.where((F.least(*xs) <= max_x) & (F.greatest(*xs) >= min_x) & (F.least(*ys) <= max_y) & (F.greatest(*ys) >= min_y))


def blocks(found: DataFrame, bands: Iterable[int] = (1, 2), tasks: int | None = None) -> DataFrame:
    """Decoded chunks: ``path, band, y0, x0, h, w, v`` (array<float>, row by row), ``error``.

    Samples become floats; those equal to the file's no-data value become NaN.  A chunk that can't be read or decoded has an ``error`` and
    no ``v``.  Chunks are dealt to ``tasks`` tasks (by default as many as shuffles have); each is decoded on its own.
    """
    wanted = tuple(bands)
    spark = found.sparkSession
    dealt = found.where(F.col("band").isin(0, *wanted)).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "y0", "x0", "band")
    has = "raw" in found.columns
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("band", "y0", "x0", "h", "w")), ("v", pa.list_(pa.float32())), ("error", pa.string())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                at = (r["path"], r["band"], r["y0"], r["x0"], r["h"], r["w"])
                try:
                    if not r["bytes"]:  # left out by the writer
                        part = np.full((r["rows"], r["columns"], r["samples"]), np.nan if r["no_data"] is None else r["no_data"])
                    else:
                        if not has and r["path"] != last:
                            last, read = r["path"], _reader(r["path"])
                        part = decoded(r["raw"] if has else read(r["offset"], r["bytes"]), r["dtype"], r["rows"], r["columns"], r["samples"], r["compression"], r["predictor"])
                except (ValueError, zlib.error, IndexError, OSError) as e:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, None, f"{type(e).__name__}: {e}")))], schema)
                    continue
                rows = []
                for k in range(r["samples"]):
                    band = r["band"] or k + 1
                    if band in wanted:
                        v = part[: r["h"], : r["w"], k].astype(np.float32)
                        if r["no_data"] is not None:
                            v = np.where(v == np.float32(r["no_data"]), np.float32(np.nan), v)
                        rows.append((r["path"], band, *at[2:], v.ravel(), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return dealt.mapInArrow(decode, "path string, band int, y0 int, x0 int, h int, w int, v array<float>, error string")


def pixels(decoded_blocks: DataFrame, key: str = "path") -> DataFrame:
    """``(key, band, y, x, v)`` of all pixels that have data."""
    return pixels_of(decoded_blocks.where("error is null"), key, "band")


def observation(flat: DataFrame, key: str = "path") -> DataFrame:
    """``(key, y, x, vv, vh)``: the first band as vv, the second, where there is one, as vh."""
    return flat.groupBy(key, "y", "x").agg(F.max(F.when(F.col("band") == 1, F.col("v"))).alias("vv"), F.max(F.when(F.col("band") == 2, F.col("v"))).alias("vh"))


def read(spark: SparkSession, path: str, content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(headers, chunks) of all TIFF files at and below ``path``."""
    found = files(spark, path, content=content)
    return headers(found), chunks(found)


def products(spark: SparkSession, path: str) -> DataFrame:
    """SAFE products at and below ``path``: ``product, vv, vh`` (paths of files), ``product_type, start_time, stop_time, orbit_direction, error``.

    Measurements are files below ``measurement`` whose names hold the polarisation, lower case before upper case, then the first by name.
    Products without a vv file have an error; without a manifest, NULLs.
    """
    found = files(spark, path).select("path", F.regexp_extract("path", r"^(.*)/measurement/[^/]*\.tiff?$", 1).alias("product"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).where("product <> ''")
    first = lambda p: F.min_by(F.when(F.col("name").contains(p) | F.col("name").contains(p.upper()), F.col("path")), F.when(F.col("name").contains(p), F.struct(F.lit(0), "name")).when(F.col("name").contains(p.upper()), F.struct(F.lit(1), "name")))
    bands = found.groupBy("product").agg(first("vv").alias("vv"), first("vh").alias("vh"))
    manifests = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.safe").load(path).select("path")
    told = read_manifest(spark, [r.path for r in manifests.collect()]) if not manifests.isEmpty() else None
    known = ["product_type", "start_time", "stop_time", "orbit_direction"]
    if told is None:
        out = bands.withColumns({c: F.lit(None).cast("string") for c in known})
    else:
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        same = told.select(plain(F.regexp_replace("path", r"/manifest\.safe$", "")).alias("at"), *known)
        out = bands.join(same, plain("product") == F.col("at"), "full").withColumn("product", F.coalesce("product", "at")).drop("at")
    return out.withColumn("error", F.when(F.col("vv").isNull(), "no VV measurement"))


def product_pixels(found: DataFrame) -> DataFrame:
    """``(product, band, y, x, v)`` of the measurements of :func:`products`; vv is band 1, vh band 2, each the first band of its file."""
    each = found.where("error is null").select("product", F.inline(F.array(F.struct(F.col("vv").alias("path"), F.lit(1).alias("as")), F.struct(F.col("vh").alias("path"), F.lit(2).alias("as"))))).where("path is not null")
    flat = blocks(chunks(each.select("path")), [1])
    return pixels(flat.drop("band").join(each.withColumnRenamed("as", "band"), "path"), "product")


# ---- writing


def _encoded(block: np.ndarray, predictor: int, compression: int) -> bytes:
    """A (rows, columns) block of little-endian floats; predictor 3 or 1."""
    data = block.astype("<f4")
    if predictor == 3:
        planes = np.ascontiguousarray(data.astype(">f4")).view(np.uint8).reshape(*data.shape, 4).transpose(0, 2, 1).reshape(len(data), -1)
        raw = np.diff(planes, axis=1, prepend=np.zeros((len(data), 1), np.uint8)).astype(np.uint8).tobytes()
    else:
        raw = data.tobytes()
    return zlib.compress(raw, 6) if compression == DEFLATE else raw


def _head(entries: list[tuple[int, int, Any]], sizes: list[int], at_tag: int) -> bytes:
    """Header and directory of a file whose chunks follow in order; BigTIFF if 32 bits don't reach."""
    for big in (False, True):
        room, number, entry, first = (8, "Q", 20, 16) if big else (4, "I", 12, 8)
        chunk_kind = 16 if big else 4
        told = sorted([*entries, (at_tag, chunk_kind, [0] * len(sizes)), (at_tag + (1 if at_tag == TILE_OFFSETS else COUNTS - OFFSETS), chunk_kind, sizes)])
        packed = [(t, k, len(v), v if k == 2 else struct.pack(f"<{len(v)}{CODE[k]}", *v)) for t, k, v in told]
        begin = first + (8 if big else 2) + len(packed) * entry + (8 if big else 4)
        total = begin + sum(len(p) for *_, p in packed if len(p) > room)
        if big or total + sum(sizes) < 1 << 32:
            break
    offsets = struct.pack(f"<{len(sizes)}{number}", *(np.cumsum([total, *sizes])[:-1].tolist() if sizes else []))
    packed = [(t, k, n, offsets if t == at_tag else p) for t, k, n, p in packed]
    out, far, at = [b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) if big else b"II" + struct.pack("<HI", 42, 8), struct.pack("<Q" if big else "<H", len(packed))], [], begin
    for t, k, n, p in packed:
        if len(p) > room:
            value = struct.pack("<" + number, at)
            far.append(p)
            at += len(p)
        else:
            value = p.ljust(room, b"\0")
        out.append(struct.pack(f"<HH{number}", t, k, n) + value)
    return b"".join([*out, struct.pack("<" + number, 0), *far])


def write(table: DataFrame, folder: str, height: int, width: int, side: int, affine: tuple[float, ...] | None = None, epsg: int | None = None, bands: int = 1, acquired: str | None = None, compression: int = DEFLATE, predictor: int = 3, name: str = "scene_{}.tif") -> DataFrame:
    """Blocks ``(scene_id, band, y0, x0, h, w, v)`` on a grid of ``side`` (a multiple of 16) as tiled float files, one per scene, in ``folder``.

    Returns ``(scene_id, path, bytes)`` of what was written.  Blocks are compressed where they are; a scene's blocks then stream past one
    task that holds its directory and one block.  Blocks that are missing take no room in the file and are read as no data.  A file gets its
    name when it is whole, so tasks that run again leave no halves.
    """
    across, down = -(-width // side), -(-height // side)
    n = across * down * bands
    entries: list[tuple[int, int, Any]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [compression]), (262, 3, [1]), (SAMPLES, 3, [bands]), (PLANES, 3, [2]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [side]), (TILE_HEIGHT, 4, [side]), (FORMAT, 3, [3] * bands), (NO_DATA, 2, b"nan\0")]
    entries += [(DATETIME, 2, acquired.encode() + b"\0")] if acquired else []
    if affine:
        a, b, c, d, e, f = affine
        entries += [(MATRIX, 12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1])]
    if epsg:
        kind = GEOGRAPHIC if 4000 <= epsg < 5000 else PROJECTED
        entries += [(GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if kind == GEOGRAPHIC else 1, RASTER_TYPE, 0, 1, 1, kind, 0, 1, epsg])]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = [], []
            for band, y0, x0, h, w, v in zip(*(batch.column(c) for c in ("band", "y0", "x0", "h", "w", "v"))):
                whole = np.full((side, side), np.nan, np.float32)
                whole[: h.as_py(), : w.as_py()] = v.values.to_numpy(zero_copy_only=False).reshape(h.as_py(), w.as_py())
                at.append(((band.as_py() - 1) * down + y0.as_py() // side) * across + x0.as_py() // side)
                raw.append(_encoded(whole, predictor, compression))
            yield pa.RecordBatch.from_arrays([batch.column("scene_id"), pa.array(at, pa.int32()), pa.array(raw, pa.binary())], ["scene_id", "at", "raw"])

    kind = table.schema["scene_id"].dataType.simpleString()
    parts = saved(table.select("scene_id", "band", "y0", "x0", "h", "w", "v").mapInArrow(packed, f"scene_id {kind}, at int, raw binary"), "chunks")
    sizes = parts.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.octet_length("raw").alias("n")))).alias("m"))
    sizes = sizes.select("scene_id", F.lit(-1).alias("at"), F.lit(None).cast("binary").alias("raw"), F.expr(f"transform(sequence(0, {n - 1}), k -> coalesce(m[k], 0))").alias("sizes"))
    rows = parts.withColumn("sizes", F.lit(None).cast("array<int>")).unionByName(sizes).repartition("scene_id").sortWithinPartitions("scene_id", "at")
    schema = pa.schema([("scene_id", pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.string()), ("path", pa.string()), ("bytes", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("file:", "/")) else fs.FileSystem.from_uri(folder)
        out, scene, written = None, None, 0

        def done() -> pa.RecordBatch:
            out.close()
            store.move(f"{base}/{name.format(scene)}.{attempt}", f"{base}/{name.format(scene)}")
            return pa.RecordBatch.from_pylist([{"scene_id": scene, "path": f"{folder}/{name.format(scene)}", "bytes": written}], schema)

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for key, at, raw, counts in zip(*(batch.column(c) for c in ("scene_id", "at", "raw", "sizes"))):
                if at.as_py() < 0:
                    if out:
                        yield done()
                    scene = key.as_py()
                    store.create_dir(f"{base}/{name.format(scene)}".rsplit("/", 1)[0], recursive=True)
                    out, head = store.open_output_stream(f"{base}/{name.format(scene)}.{attempt}"), _head(entries, counts.as_py(), TILE_OFFSETS)
                    out.write(head)
                    written = len(head)
                else:
                    out.write(raw.as_py())
                    written += len(raw.as_py())
        if out:
            yield done()

    return rows.mapInArrow(put, f"scene_id {kind}, path string, bytes long")
