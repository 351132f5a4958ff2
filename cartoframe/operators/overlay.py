"""Buffer, union, dissolve, intersection and difference of any polygons, and simplification that keeps them valid.

Geometry is `parts`: polygons, each an array of closed rings, the outer one first
and its holes after it.  Layers with `coords` (one ring) or `rings` are brought to
it by parts_of().  Boolean operations work on the plane of longitude and latitude,
buffers in metres on a plane around the middle of each feature.

Pairs come from a join on cells of the level of each box, so features meet only
where their boxes do; a group that is to be dissolved is dissolved by cells first.
The kernel runs in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoframe.functions import geo as G
from cartoframe.functions import rings as R
from cartoframe.operators.spatial import FINEST, LEVELS, _simplify

RING = "array<struct<lon:double,lat:double>>"
PARTS = f"array<array<{RING}>>"
_PARTS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))))
_POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_PARTS = pa.list_(pa.list_(pa.list_(_POINT)))


def parts_of(df: DataFrame) -> DataFrame:
    """The layer with `parts`, made from `coords` where it has none; what is no closed ring has none."""
    if "parts" in df.columns:
        return df
    return df.withColumn("parts", F.when(G.is_closed(F.col("coords")), F.array(F.array("coords"))))


def _box(parts: Column) -> Column:
    return G.bbox(F.flatten(F.flatten(parts)))


def _array(ring) -> np.ndarray:
    return np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)


def _shape(parts) -> R.Shape:
    return [_array(ring) for part in parts if part is not None for ring in part if ring is not None and len(ring) >= 3]


def _rows(parts: list[list[np.ndarray]]) -> list:
    return [[[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in part] for part in parts]


def area_of(parts: Column) -> Column:
    """Area in square degrees."""
    return G.parts_area(parts)


def area_km2(parts: Column) -> Column:
    """Area in square kilometres, each ring scaled at its middle latitude."""
    return G.parts_area(parts, G.area_m2) / 1e6


def _celled(df: DataFrame, name: str, box: Column) -> DataFrame:
    """Rows as a struct `name`, once for each cell of their box's level."""
    b = box
    extent = F.greatest(F.col("b.max_lon") - F.col("b.min_lon"), F.col("b.max_lat") - F.col("b.min_lat"))
    out = df.where("parts is not null and size(parts) > 0").select(F.struct(*df.columns).alias(name), b.alias("b"))
    return out.withColumn("z", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / FINEST)))).cast("int"))


def _span(low: str, high: str) -> Column:
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), "z") * FINEST)).cast("long")
    return F.explode(F.sequence(at(low), at(high)))


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): structs of the rows whose boxes meet.  A pair is found once, at the coarser of its two levels."""
    a, b = _celled(left, "a", _box(F.col("parts"))), _celled(right, "b_row", _box(F.col("parts")))
    a = a.withColumnRenamed("b", "box").withColumnRenamed("z", "za")
    b = b.withColumnRenamed("b", "box").withColumnRenamed("z", "zb")
    levels = sorted({r[0] for r in a.select("za").distinct().union(b.select("zb").distinct()).collect()})  # LEVELS at most

    def spread(df: DataFrame, own: str, prefix: str) -> DataFrame:
        up = df.withColumn("z", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda z: z >= F.col(own)))).withColumn("b", F.col("box"))
        up = up.withColumn("x", _span("b.min_lon", "b.max_lon")).withColumn("y", _span("b.min_lat", "b.max_lat"))
        return up.drop("b").withColumnRenamed("box", f"{prefix}box")

    met = spread(a, "za", "a_").join(spread(b, "zb", "b_"), ["z", "x", "y"]).where(F.col("z") == F.greatest("za", "zb"))
    overlap = (F.col("a_box.min_lon") <= F.col("b_box.max_lon")) & (F.col("b_box.min_lon") <= F.col("a_box.max_lon")) & (F.col("a_box.min_lat") <= F.col("b_box.max_lat")) & (F.col("b_box.min_lat") <= F.col("a_box.max_lat"))
    # of the cells in which two boxes meet, the one of the larger of their lower corners
    first = lambda c: F.floor(F.greatest(F.col(f"a_box.{c}"), F.col(f"b_box.{c}")) / (F.pow(F.lit(2.0), "z") * FINEST)).cast("long")
    return met.where(overlap & (F.col("x") == first("min_lon")) & (F.col("y") == first("min_lat"))).select("a", F.col("b_row").alias("b"))


def _with_result(df: DataFrame, f, drop: bool) -> DataFrame:
    """The batch's rows with `result` (parts) = f(row's columns as lists); rows without a result go, if `drop`."""
    schema = T.StructType([*df.schema.fields, T.StructField("result", _PARTS_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            stay = [i for i, x in enumerate(out) if x] if drop else list(range(len(out)))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(stay, pa.int64())).columns, pa.array([out[i] for i in stay], _PARTS)], [*batch.schema.names, "result"])

    return df.mapInArrow(run, schema)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, parts: the common area of each two features that have one (boundaries that only touch have none)."""
    met = meeting(parts_of(left), parts_of(right))

    def common(batch: pa.RecordBatch) -> list:
        a, b = (batch.column(batch.schema.get_field_index(c)).field("parts").to_pylist() for c in "ab")
        return [_rows(R.intersection([_shape(x), _shape(y)])) for x, y in zip(a, b, strict=True)]

    return _with_result(met, common, True).withColumnRenamed("result", "parts")


#: What a subject's geometry has to do with a reference area's.
PREDICATES = ("intersects", "within", "contains")


def _geometry(kind: str | None, coords, parts) -> tuple[list[np.ndarray], R.Shape]:
    """(lines, areas) of a feature; points are lines of one point."""
    if parts:
        return [], _shape(parts)
    if not coords:
        return [], []
    line = _array(coords)
    closed = len(line) >= 4 and (line[0] == line[-1]).all()
    if kind == "Polygon" or (kind is None and closed):
        return [], [line]
    return ([p[None] for p in line] if kind in ("Point", "MultiPoint") else [line]), []


def related(subject: tuple, reference: tuple, predicate: str) -> bool:
    """Whether a feature intersects, is within, or contains another; boundaries belong to areas."""
    if predicate == "contains":
        return related(reference, subject, "within")
    lines, areas = subject
    other_lines, other = reference
    if predicate == "within":
        if not other:
            return False
        if areas:
            whole = R.area(R.union([areas]))
            return abs(R.area(R.intersection([areas, other])) - whole) <= 1e-9 * max(whole, 1e-12)
        return bool(lines) and all(R.covers(other, line) for line in lines)
    if areas and other:
        return R.touches(areas, other)
    if areas:
        return any(R.meets(areas, line) for line in other_lines)
    if other:
        return any(R.meets(other, line) for line in lines)
    return any(R.lines_meet(a, b) for a in lines for b in other_lines)


def spatial_join(subjects: DataFrame, references: DataFrame, *, key: str, order: str, predicate: str = "intersects", how: str = "left", prefix: str = "ref_") -> DataFrame:
    """Subjects (points, lines, areas; coords and gtype, or parts) with the attributes of the first reference, by `order`, that fits the predicate, and their number.

    Pairs come from the cells of both boxes; `left` keeps subjects without a match.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"predicate: {', '.join(PREDICATES)}, not {predicate}")
    if how not in ("left", "inner"):
        raise ValueError(f"how: left or inner, not {how}")
    attributes = [c for c in references.columns if c not in ("coords", "parts", "gtype")]

    def boxed(df: DataFrame, *more: str) -> DataFrame:
        kind = F.col("gtype") if "gtype" in df.columns else F.lit(None).cast("string")
        parts = F.col("parts") if "parts" in df.columns else F.lit(None).cast(PARTS)
        line = F.when(F.size("coords") > 0, F.array(F.array("coords"))) if "coords" in df.columns else F.lit(None).cast(PARTS)
        coords = F.col("coords") if "coords" in df.columns else F.lit(None).cast(RING)
        return df.select(*more, kind.alias("kind"), coords.alias("line"), parts.alias("areas"), F.coalesce(parts, line).alias("parts"))

    met = meeting(boxed(subjects, key), boxed(references, *attributes))

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            geometry = lambda x: list(zip(*(x.field(c).to_pylist() for c in ("kind", "line", "areas")), strict=True))
            keep = [related(_geometry(*x), _geometry(*y), predicate) for x, y in zip(geometry(a), geometry(b), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = met.mapInArrow(fits, met.schema).select(F.col(f"a.{key}").alias(key), F.struct(*[F.col(f"b.{c}").alias(c) for c in attributes]).alias("r"))
    best = found.groupBy(key).agg(F.min_by("r", f"r.{order}").alias("r"), F.count(F.lit(1)).alias("n"))
    out = subjects.join(best, key, how)
    return out.select(*subjects.columns, *[F.col(f"r.{c}").alias(f"{prefix}{c}") for c in attributes], F.coalesce("n", F.lit(0)).alias(f"{prefix}joined_count"))


def clip(df: DataFrame, parts: list) -> DataFrame:
    """Features cut to a polygon (parts as nested lists of (lon, lat)); those outside go."""
    shape = [np.array(ring, float) for part in parts for ring in part]
    whole = parts_of(df)

    def cut(batch: pa.RecordBatch) -> list:
        return [None if x is None else _rows(R.intersection([_shape(x), shape])) for x in batch.column(batch.schema.get_field_index("parts")).to_pylist()]

    return _with_result(whole, cut, True).drop("parts").withColumnRenamed("result", "parts")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` with `parts` less everything of `right`; what nothing is left of goes.  Others that meet one feature are gathered with it."""
    whole = parts_of(left)
    met = meeting(whole.select(key, "parts"), parts_of(right).select("parts")).groupBy(F.col(f"a.{key}").alias("__k")).agg(F.collect_list("b.parts").alias("__others"))
    joined = whole.join(met, whole[key] == met["__k"], "left").drop("__k")
    # few rows with much work each: not to be put together in one task
    joined = joined.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    def rest(batch: pa.RecordBatch) -> list:
        own, others = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("parts", "__others"))
        return [x if x is None or not o else _rows(R.difference(_shape(x), [_shape(y) for y in o])) for x, o in zip(own, others, strict=True)]

    return _with_result(joined, rest, True).drop("parts", "__others").withColumnRenamed("result", "parts")


def dissolve(df: DataFrame, group: Column, cell_deg: float = 1.0) -> DataFrame:
    """group, dissolved_count, parts: the union of each group's areas, by cells of the features' corners first."""
    whole = parts_of(df).where("parts is not null and size(parts) > 0").select(group.cast("string").alias("group"), "parts")
    box = _box(F.col("parts"))
    celled = whole.withColumn("x", F.floor(box["min_lon"] / cell_deg)).withColumn("y", F.floor(box["min_lat"] / cell_deg))

    def merge(table: pa.Table) -> pa.Table:
        made = R.union([_shape(p) for p in table.column("parts").to_pylist()])
        return pa.table({"group": table.column("group").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "parts": pa.array([_rows(made)], _PARTS)})

    schema = f"group string, n long, parts {PARTS}"
    some = celled.withColumn("n", F.lit(1).cast("long")).groupBy("group", "x", "y").applyInArrow(merge, schema)
    return some.groupBy("group").applyInArrow(merge, schema).withColumnRenamed("n", "dissolved_count")


def union_layers(*layers: DataFrame) -> DataFrame:
    """One row: merged_count and the union of all areas of all layers."""
    out = None
    for x in layers:
        own = parts_of(x).select("parts")
        out = own if out is None else out.union(own)
    return dissolve(out, F.lit("")).select(F.col("dissolved_count").alias("merged_count"), "parts")


def buffer(df: DataFrame, distance: float, unit: str = "m", sides: int = 32) -> DataFrame:
    """The layer with `buffer`: everything within the distance of each feature.

    Points, lines and areas by gtype (without that column: areas if closed, else
    lines).  Circles have `sides` corners.  Features without geometry get none.
    """
    metres = G.to_metres(distance, unit)
    if metres <= 0:
        raise ValueError("the distance must be above 0")
    names = df.columns

    def grow(batch: pa.RecordBatch) -> list:
        column = lambda c: batch.column(names.index(c)).to_pylist() if c in names else [None] * batch.num_rows
        out = []
        for kind, coords, parts in zip(column("gtype"), column("coords"), column("parts"), strict=True):
            areas = _shape(parts) if parts else []
            lines = []
            if not areas and coords:
                line = _array(coords)
                closed = len(line) >= 4 and (line[0] == line[-1]).all()
                if kind == "Polygon" or (kind is None and closed):
                    areas = [line]
                elif kind == "MultiPoint":
                    lines = [p[None] for p in line]
                else:
                    lines = [line]
            every = [*lines, *areas]
            if not every:
                out.append(None)
                continue
            points = np.vstack(every)
            middle = (points.min(0) + points.max(0)) / 2
            scale = np.array([G.M_PER_DEGREE * max(0.01, math.cos(math.radians(middle[1]))), G.M_PER_DEGREE])
            plane = lambda x, m=middle, s=scale: (x - m) * s
            made = R.buffer([plane(x) for x in lines], [plane(x) for x in areas], metres, sides)
            out.append(_rows([[ring / scale + middle for ring in part] for part in made]))
        return out

    return _with_result(df, grow, False).withColumnRenamed("result", "buffer")


def simplify(df: DataFrame, tolerance_m: float) -> DataFrame:
    """Areas with fewer points, none moved, and still valid: where a ring would cross itself, its tolerance is halved until it does not; rings that would collapse stay as they are."""
    whole = parts_of(df)

    def slim(ring: np.ndarray, scale: np.ndarray) -> np.ndarray:
        tolerance = tolerance_m
        for _ in range(12):
            # from the point farthest from the first on: both ends of a ring are one point
            far = int(np.hypot(*((ring - ring[0]) * scale).T).argmax())
            one, two = ring[: far + 1], ring[far:]
            keep = np.concatenate([_simplify(one * scale, tolerance), _simplify(two * scale, tolerance)[1:]]) if 0 < far < len(ring) - 1 else _simplify(ring * scale, tolerance)
            out = ring[keep]
            if len(out) >= 4 and not R.crosses_itself(out):
                return out
            tolerance /= 2
        return ring

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
            if not parts:
                out.append(parts)
                continue
            made = []
            for part in parts:
                rings = [_array(r) for r in part]
                scale = np.array([G.M_PER_DEGREE * math.cos(math.radians(float(rings[0][:, 1].mean()))), G.M_PER_DEGREE])
                made.append([slim(r, scale) for r in rings])
            out.append(_rows(made))
        return out

    return _with_result(whole, run, False).drop("parts").withColumnRenamed("result", "parts")
