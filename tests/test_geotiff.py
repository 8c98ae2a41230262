"""Files are made here byte by byte, apart from the library's own writer."""

import struct
import zlib

import numpy as np
import pytest

from tidewake.operators import blocks as grid
from tidewake.sources import geotiff

KIND = {"u1": (1, 8), "u2": (1, 16), "i2": (2, 16), "i4": (2, 32), "f4": (3, 32), "f8": (3, 64)}


def lzw(data):
    """Codes as the format has them: 9 bits first, one wider as soon as the next code would need it."""
    table, out, width, word = {bytes([k]): k for k in range(256)}, [], 9, b""
    bits = [(256, 9)]
    n = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        bits.append((table[word], width))
        table[word + bytes([b])] = n
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        if n == 4094:
            bits.append((256, width))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([b])
    if word:
        bits.append((table[word], width))
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
    bits.append((257, width))
    text = "".join(format(c, f"0{w}b") for c, w in bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def tiff(a, order="<", compression=1, predictor=1, rows=3, tile=None, apart=False, big=False, extra=()):
    """A file of (bands, height, width) numbers, in strips of ``rows`` or square tiles."""
    bands, h, w = a.shape
    kind = a.dtype.str[1:]
    planes = [a[k : k + 1] for k in range(bands)] if apart else [a]
    chunks = []
    for p in planes:
        p = p.transpose(1, 2, 0).astype(order + kind)
        for y in range(0, h, tile or rows):
            for x in range(0, w, tile or w):
                part = p[y : y + (tile or rows), x : x + (tile or w)]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1])).astype(order + kind)
                raw = part.tobytes()
                if predictor == 3:
                    n, m, s = part.shape
                    bytes_ = np.ascontiguousarray(part.astype(">" + kind)).view(np.uint8).reshape(n, m * s, -1).transpose(0, 2, 1).reshape(n, -1, s)
                    raw = np.diff(bytes_, axis=1, prepend=np.zeros((n, 1, s), np.uint8)).astype(np.uint8).tobytes()
                chunks.append({1: bytes, 5: lzw, 8: zlib.compress}[compression](raw))
    fmt, bits = KIND[kind]
    tags = {256: (3, [w]), 257: (3, [h]), 258: (3, [bits] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [fmt] * bands)} | dict(extra)
    tags |= {322: (3, [tile]), 323: (3, [tile])} if tile else {278: (3, [rows])}
    first, room, number = (16, 8, "Q") if big else (8, 4, "I")
    body = bytearray(b"".join(chunks))
    at = np.cumsum([first, *map(len, chunks)]).tolist()
    tags |= {324 if tile else 273: (16 if big else 4, at[:-1]), 325 if tile else 279: (16 if big else 4, [len(c) for c in chunks])}
    entries = []
    for t, (k, v) in sorted(tags.items()):
        raw = v if k == 2 else struct.pack(f"{order}{len(v)}{geotiff.CODE[k]}", *v)
        if len(raw) > room:
            entries.append(struct.pack(f"{order}HH{number}{number}", t, k, len(v), first + len(body)))
            body += raw
        else:
            entries.append(struct.pack(f"{order}HH{number}", t, k, len(v)) + raw.ljust(room, b"\0"))
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, first + len(body)) if big else struct.pack(order + "HI", 42, first + len(body)))
    return start + bytes(body) + struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + bytes(8)


def numbers(kind, bands, h, w, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(bands, h, w)) * 100).astype(kind) if kind[0] == "f" else np.cumsum(rng.integers(0, 3, (bands, h, w)), axis=2).astype(kind)


CASES = [(kind, order, compression, predictor, tile, apart, big) for k, (kind, predictor) in enumerate([("u1", 2), ("u2", 1), ("u2", 2), ("i2", 2), ("i4", 2), ("f4", 1), ("f4", 3), ("f8", 3)]) for j, compression in enumerate((1, 5, 8)) for order, tile, apart, big in [[("<", None, False, False), (">", 16, False, True)], [(">", None, True, False), ("<", 16, True, True)]][(k + j) % 2]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tiff")
    for i, (kind, order, compression, predictor, tile, apart, big) in enumerate(CASES):
        (at / f"c{i:03}.tif").write_bytes(tiff(numbers(kind, 2, 37, 41, i), order, compression, predictor, 5, tile, apart, big))
    return at


@pytest.mark.parametrize("content", [False, True])
def test_all_codings_give_the_numbers_that_were_written(spark, folder, content):
    heads, found = geotiff.read(spark, str(folder), content)
    rows = {r.path.rsplit("/", 1)[1]: r for r in heads.collect()}
    assert len(rows) == len(CASES) and all((r.width, r.height, r.bands, r.error) == (41, 37, 2, None) for r in rows.values())
    got = {f"c{i:03}.tif": np.full((2, 37, 41), np.nan) for i in range(len(CASES))}
    for r in geotiff.blocks(found).collect():
        assert r.error is None
        got[r.path.rsplit("/", 1)[1]][r.band - 1, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.v).reshape(r.h, r.w)
    for i, (kind, *_) in enumerate(CASES):
        assert np.array_equal(got[f"c{i:03}.tif"], numbers(kind, 2, 37, 41, i).astype(np.float32)), CASES[i]


def test_lzw_of_long_and_repetitive_data():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"a" * 100_000, rng.integers(0, 256, 60_000, np.uint8).tobytes(), rng.integers(0, 2, 60_000, np.uint8).tobytes()):
        assert geotiff.unpacked_lzw(lzw(data)) == data


def test_georeference_tags_and_damage(spark, tmp_path):
    a = numbers("f4", 1, 6, 4)
    a[0, 2, 1] = -9999
    keys = lambda point, kind, code: (34735, (3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, point, kind, 0, 1, code]))
    items = b'<GDALMetadata><Item name="pass">DESC</Item><Item name="gain" sample="0">2</Item></GDALMetadata>\0'
    extra = [(33550, (12, [10.0, 20.0, 0.0])), (33922, (12, [0, 0, 0, 500_000.0, 1_660_000.0, 0])), keys(1, 3072, 32643), (306, (2, b"2026:01:02 03:04:05\0")), (42112, (2, items)), (42113, (2, b"-9999\0"))]
    (tmp_path / "area.tif").write_bytes(tiff(a, extra=extra))
    (tmp_path / "point.tif").write_bytes(tiff(a, extra=[*extra[:2], keys(2, 2048, 4326)]))
    (tmp_path / "plain.tiff").write_bytes(tiff(numbers("u1", 3, 6, 4)))
    (tmp_path / "text.tif").write_bytes(b"no tiff")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "jpeg.tif").write_bytes(tiff(a, extra=[(259, (3, [7]))]))
    whole = tiff(a, compression=8)
    (tmp_path / "cut.tif").write_bytes(whole[:8] + b"\0" * 20 + whole[28:])
    heads, found = geotiff.read(spark, f"file:{tmp_path}")
    h = {r.path.rsplit("/", 1)[1]: r for r in heads.collect()}
    assert tuple(h["area.tif"].affine) == (10, 0, 500_000, 0, -20, 1_660_000) and h["area.tif"].epsg == 32643 and h["area.tif"].acquired == "2026:01:02 03:04:05"
    assert h["area.tif"].tags == {"TIFFTAG_DATETIME": "2026:01:02 03:04:05", "pass": "DESC", "AREA_OR_POINT": "Area"} and h["area.tif"].n_chunks == 2
    assert tuple(h["point.tif"].affine) == (10, 0, 499_995, 0, -20, 1_660_010) and h["point.tif"].epsg == 4326
    assert h["plain.tiff"].affine is None and h["plain.tiff"].epsg is None and h["plain.tiff"].bands == 3
    assert {n for n, r in h.items() if r.error} == {"text.tif", "jpeg.tif"}  # Spark passes over empty files
    rows = geotiff.blocks(found).collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"cut.tif"}
    flat = [r for r in geotiff.pixels(geotiff.blocks(found)).collect() if r.path.endswith("area.tif")]
    assert len(flat) == 23 and all(r.v == a[0, r.y, r.x] for r in flat)
    seen = {(r.y, r.x): (r.vv, r.vh) for r in geotiff.observation(geotiff.pixels(geotiff.blocks(found))).where("path like '%plain%'").collect()}
    b = numbers("u1", 3, 6, 4)
    assert seen == {(y, x): (b[0, y, x], b[1, y, x]) for y in range(6) for x in range(4)}


def test_filters_leave_strips_unread(spark, tmp_path):
    a = numbers("f4", 1, 40, 8)
    raw = tiff(a, rows=2, extra=[(33550, (12, [1.0, 1.0, 0.0])), (33922, (12, [0, 0, 0, 100.0, 50.0, 0]))])
    (tmp_path / "a.tif").write_bytes(raw)
    _, found = geotiff.read(spark, str(tmp_path))
    assert found.count() == 20
    assert sorted(r.y0 for r in geotiff.in_window(found, 3, 0, 9, 8).collect()) == [2, 4, 6, 8]
    assert sorted(r.y0 for r in geotiff.in_box(found, 101, 38.5, 102, 41.5).collect()) == [8, 10] and geotiff.in_box(found, 0, 0, 99, 99).count() == 0
    # bytes of all other strips are destroyed: what is read is right, as they are never touched
    left = geotiff.in_window(found, 10, 0, 14, 8)
    keep = {r.offset: r.bytes for r in left.collect()}
    broken = bytearray(raw)
    for r in found.collect():
        if r.offset not in keep:
            broken[r.offset : r.offset + r.bytes] = b"\xff" * r.bytes
    (tmp_path / "a.tif").write_bytes(bytes(broken))
    got = {(r.y, r.x): r.v for r in geotiff.pixels(geotiff.blocks(left)).collect()}
    assert got == {(y, x): a[0, y, x] for y in range(10, 14) for x in range(8)}


def test_safe_products(spark, tmp_path):
    vv, vh, other = numbers("u2", 1, 6, 4, 1), numbers("u2", 1, 6, 4, 2), numbers("u2", 1, 6, 4, 3)
    for name, parts in {"A.SAFE": {"s1-vv-b.tiff": vv, "s1-vv-c.tiff": other, "s1-VV-a.tiff": other, "s1-vh-a.tiff": vh}, "B.SAFE": {"x-VV.tiff": vv}, "C.SAFE": {"x-vh.tiff": vh}}.items():
        (tmp_path / name / "measurement").mkdir(parents=True)
        for file, a in parts.items():
            (tmp_path / name / "measurement" / file).write_bytes(tiff(a))
    (tmp_path / "A.SAFE" / "manifest.safe").write_text("<x><s1:productType>GRD</s1:productType><safe:startTime>2026-01-02T03:04:05</safe:startTime><s1:orbitDirection>ASCENDING</s1:orbitDirection></x>")
    (tmp_path / "D.SAFE").mkdir()
    (tmp_path / "D.SAFE" / "manifest.safe").write_text("<x/>")
    found = geotiff.products(spark, str(tmp_path))
    rows = {r["product"].rsplit("/", 1)[1]: r for r in found.collect()}
    assert rows["A.SAFE"].vv.endswith("s1-vv-b.tiff") and rows["A.SAFE"].vh.endswith("s1-vh-a.tiff") and (rows["A.SAFE"].product_type, rows["A.SAFE"].start_time, rows["A.SAFE"].orbit_direction) == ("GRD", "2026-01-02T03:04:05", "ASCENDING")
    assert rows["B.SAFE"].vv.endswith("x-VV.tiff") and rows["B.SAFE"].vh is None and rows["B.SAFE"].product_type is None
    assert {n for n, r in rows.items() if r.error} == {"C.SAFE", "D.SAFE"}
    flat = geotiff.product_pixels(found)
    got = {(r["product"].rsplit("/", 1)[1], r.band, r.y, r.x): r.v for r in flat.collect()}
    assert got == {(p, k, y, x): a[0, y, x] for p, k, a in (("A.SAFE", 1, vv), ("A.SAFE", 2, vh), ("B.SAFE", 1, vv)) for y in range(6) for x in range(4)}


@pytest.mark.parametrize("compression,predictor", [(8, 3), (8, 1), (1, 1)])
def test_written_files_come_back(spark, tmp_path, compression, predictor):
    rng = np.random.default_rng(5)
    rows = [(s, y, x, float(np.float32(rng.normal()))) for s in (1, 2, 7) for y in range(50) for x in range(70) if rng.random() < 0.6 and not (s == 2 and y < 32)]
    flat = spark.createDataFrame(rows, "scene_id long, y int, x int, v double")
    made = grid.blocks_of(flat, 50, 70, 32)
    wrote = geotiff.write(made, f"{tmp_path}/out", 50, 70, 32, (0.5, 0.0, 10.0, 0.0, -0.5, 20.0), 4326, acquired="2026:01:01 00:00:00", compression=compression, predictor=predictor).collect()
    assert sorted(r.scene_id for r in wrote) == [1, 2, 7] and all((tmp_path / "out" / f"scene_{r.scene_id}.tif").stat().st_size == r.bytes for r in wrote)
    heads, found = geotiff.read(spark, f"{tmp_path}/out")
    assert all((r.width, r.height, tuple(r.affine), r.epsg, r.acquired) == (70, 50, (0.5, 0, 10, 0, -0.5, 20), 4326, "2026:01:01 00:00:00") for r in heads.collect())
    got = sorted((int(r.path.rsplit("_", 1)[1][:-4]), r.y, r.x, r.v) for r in geotiff.pixels(geotiff.blocks(found)).collect())
    assert got == sorted(rows)
    assert len(list((tmp_path / "out").iterdir())) == 3
