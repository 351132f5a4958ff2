"""Shapefiles: the shapes and the attribute table, read and written.

A shapefile holds one kind of shape and at most 2 GB, so it is one task's work to
read; records are encoded by all tasks and pass through the driver when written.
Rings of a polygon record are told apart by their direction: outer ones run
clockwise, holes the other way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.runtime import Scratch
from cartoframe.sources import files, tables

# Fixed values of the format: its mark and version, and the numbers of shapes (with z and m: 10 and 20 more).
MARK, VERSION = 9994, 1000
KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
_RING = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
_PARTS = pa.list_(pa.list_(_RING))
LAYER = "feature_id long, gtype string, tags map<string,string>, coords array<struct<lon:double,lat:double>>, parts array<array<array<struct<lon:double,lat:double>>>>"


def _signed(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def shapes(data: bytes) -> Iterator[tuple[str | None, list | None, list | None]]:
    """(gtype, coords, parts) of every record; nulls for a null shape."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != MARK:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        (size,) = struct.unpack(">i", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + 2 * size]
        at += 8 + 2 * size
        kind = struct.unpack("<i", body[:4])[0] % 10 if len(body) >= 4 else 0
        if kind == 0:
            yield None, None, None
        elif kind == 1:
            yield "Point", [struct.unpack("<2d", body[4:20])], None
        elif kind == 8:
            (n,) = struct.unpack("<i", body[36:40])
            flat = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            yield "MultiPoint", list(zip(flat[::2], flat[1::2], strict=True)), None
        elif kind in (3, 5):
            k, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{k}i", body[44 : 44 + 4 * k]), n]
            flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * k : 44 + 4 * k + 16 * n])
            points = list(zip(flat[::2], flat[1::2], strict=True))
            lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind == 3:
                yield ("LineString", lines[0], None) if len(lines) == 1 else ("MultiLineString", lines[0], [[line] for line in lines])
            else:
                parts = [[ring] for ring in lines if _signed(ring) <= 0]
                for hole in (ring for ring in lines if _signed(ring) > 0):
                    owner = next((p for p in parts if _inside(hole[0], p[0])), None)
                    parts.append([hole]) if owner is None else owner.append(hole)
                yield ("Polygon" if len(parts) == 1 else "MultiPolygon"), parts[0][0], parts
        else:
            raise ValueError(f"shape {kind}")


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:], strict=False):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            odd = not odd
    return odd


def attributes(data: bytes) -> Iterator[dict[str, str]]:
    """Rows of an attribute table as texts; deleted rows as empty ones, so that rows keep their numbers."""
    n, head, size = struct.unpack("<iHH", data[4:12])
    names, at = [], 32
    while data[at] != 0x0D:
        names.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        out, at = {}, 1
        for name, width in names:
            value = row[at : at + width].decode("utf-8", "replace").strip(" \0")
            at += width
            if value and row[:1] != b"*":
                out[name] = value
        yield out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """feature_id (the record's number), gtype, tags, coords, parts of a shapefile (path: its .shp); attributes from the .dbf beside it, if there is one."""
    base = path.removesuffix(".shp")
    names = [f"{base}.shp"]
    fs, at = files.place(spark, f"{base}.dbf")
    if fs.exists(at):
        names.append(f"{base}.dbf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {p[-4:]: c for batch in batches for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        if ".shp" not in found:
            return
        rows = attributes(found[".dbf"]) if ".dbf" in found else iter(())
        point = lambda line: [{"lon": x, "lat": y} for x, y in line]
        held = [(i, kind, list(next(rows, {}).items()), coords and point(coords), parts and [[point(r) for r in part] for part in parts]) for i, (kind, coords, parts) in enumerate(shapes(found[".shp"]), 1)]
        for k in range(0, len(held), 5000):
            columns = zip(*held[k : k + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), _RING, _PARTS), strict=True)], ["feature_id", "gtype", "tags", "coords", "parts"])

    return spark.read.format("binaryFile").load(names).select("path", "content").coalesce(1).mapInArrow(run, LAYER)


def _record(kind: str, coords: list, parts: list | None) -> tuple[int, bytes, list[tuple[float, float]]]:
    """(number of the shape, content, its points)"""
    at = lambda line: [(p["lon"], p["lat"]) for p in line]
    if kind == "Point":
        p = at(coords)[0]
        return 1, struct.pack("<i2d", 1, *p), [p]
    if kind == "MultiPoint":
        points = at(coords)
        return 8, struct.pack("<i4di", 8, *_box(points), len(points)) + b"".join(struct.pack("<2d", *p) for p in points), points
    if kind in ("Polygon", "MultiPolygon"):
        lines = []
        for part in parts or [[coords]]:
            for i, ring in enumerate(map(at, part)):
                ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                lines.append(ring if (_signed(ring) < 0) == (i == 0) else ring[::-1])
        number = 5
    else:
        lines, number = [at(line) for part in parts for line in part] if parts else [at(coords)], 3
    points = [p for line in lines for p in line]
    starts = [sum(len(x) for x in lines[:i]) for i in range(len(lines))]
    return number, struct.pack("<i4d2i", number, *_box(points), len(lines), len(points)) + struct.pack(f"<{len(lines)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points), points


def _box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def write_shapefile(df: DataFrame, path: str, columns: tuple[str, ...] = ()) -> dict[str, int]:
    """path_points, path_lines, path_polygons (.shp, .shx, .dbf) of a layer (gtype, coords, parts if it has them, tags); the number of shapes of each.

    columns: the tags that become attributes (names cut to 10 bytes, values to 254).
    Features without geometry are in none.
    """
    made = {}
    whole = df if "parts" in df.columns else df.withColumn("parts", F.lit(None).cast("array<array<array<struct<lon:double,lat:double>>>>"))
    for kind, own in tables.split_by_geometry(whole.where(F.col("coords").isNotNull())).items():
        if kind != "others":
            made[kind] = _write(own, f"{path.removesuffix('.shp')}_{kind}", columns)
    return made


def _write(df: DataFrame, base: str, columns: tuple[str, ...]) -> int:
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, coords, parts, tags in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                number, content, points = _record(kind, coords, parts)
                own = dict(tags or ())
                values = b" " + b"".join((own.get(c) or "").encode()[:254].decode("utf-8", "ignore").encode().ljust(254) for c in columns)
                rows.append((number, content, values, *_box(points)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), *[pa.float64()] * 4), strict=True)], ["number", "content", "attributes", "x0", "y0", "x1", "y1"])

    records = df.select("gtype", "coords", "parts", "tags").mapInArrow(run, "number int, content binary, attributes binary, x0 double, y0 double, x1 double, y1 double")
    records = Scratch(spark, "shapes").table(records)
    n, size, x0, y0, x1, y1, number = records.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content") + 8), F.lit(0)), F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.max("number")).first()
    if not n:
        return 0
    if size + 100 >= 1 << 31:
        raise ValueError(f"{size} bytes of shapes; a shapefile holds less than 2 GB")
    if records.select("number").distinct().count() > 1:
        raise ValueError("points and multipoints cannot be in one shapefile")
    head = lambda length: struct.pack(">7i", MARK, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i8d", VERSION, number, x0, y0, x1, y1, 0, 0, 0, 0)
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([254]) + bytes(15) for c in columns)
    width = 1 + 254 * len(columns)
    with files.create(spark, f"{base}.shp") as shp, files.create(spark, f"{base}.shx") as shx, files.create(spark, f"{base}.dbf") as dbf:
        shp.write(bytearray(head(100 + size)))
        shx.write(bytearray(head(100 + 8 * n)))
        dbf.write(bytearray(struct.pack("<4BiHH20x", 3, 95, 7, 26, n, 33 + len(fields), width) + fields + b"\r"))
        at = 100
        for i, row in enumerate(records.toLocalIterator(), 1):
            words = len(row.content) // 2
            shp.write(bytearray(struct.pack(">2i", i, words)) + row.content)
            shx.write(bytearray(struct.pack(">2i", at // 2, words)))
            dbf.write(bytearray(row.attributes))
            at += 8 + 2 * words
    return n
