"""Protocol-buffer map extracts as element tables, and back.

A file is a row of blocks, each announced by a head that names its kind.  The text
reader cuts files at that name, so an extract of any size is read in splits, on any
file system, by as many tasks as it has splits: what follows a name is the length
of a block and the block itself.  Elements are osm_type, id, version, lon, lat,
tags, node_refs, members; what does not apply is null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.operators.filters import tag_query
from cartoframe.sources import files

ELEMENTS = "osm_type string, id long, version int, lon double, lat double, tags map<string,string>, node_refs array<long>, members array<struct<type:string,ref:long,role:string>>"


def _varint(data: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, i
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def _packed(data: bytes, signed: bool = False, delta: bool = False) -> list[int]:
    out, i, last = [], 0, 0
    while i < len(data):
        v, i = _varint(data, i)
        if signed:
            v = (v >> 1) ^ -(v & 1)
        last = last + v if delta else v
        out.append(last)
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


#: The kind of blocks that hold elements, as it stands in their heads.
DATA = b"OSMData"


def blob(record: bytes) -> bytes | None:
    """The block of what stands between two names of its kind: the rest of the head (field 2 if any, then 3, the length), the block, the next head's beginning.

    None for the beginning of a file, which is the head of another kind of block.
    """
    i = 0
    while i < len(record):
        key, at = _varint(record, i)
        if key == 0x12:
            n, at = _varint(record, at)
            i = at + n
        elif key == 0x18:
            size, at = _varint(record, at)
            if at + size > len(record):
                raise ValueError(f"a block of {size} bytes is cut after {len(record) - at}")
            return record[at : at + size]
        elif i == 0 and record[0] == 0 and b"OSMHeader" in record[:64]:
            return None
        else:
            break
    if not record:
        return None
    raise ValueError("not a map extract")


def inflate(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    raise ValueError("a block that is neither raw nor deflated")


def elements(block: bytes) -> Iterator[tuple]:
    """Rows of ELEMENTS of one block."""
    strings: list[str] = []
    groups: list[bytes] = []
    granularity, lat0, lon0 = 100, 0, 0
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            granularity = v
        elif k == 19:
            lat0 = _signed(v)
        elif k == 20:
            lon0 = _signed(v)
    place = lambda lon, lat: ((lon0 + granularity * lon) * 1e-9, (lat0 + granularity * lat) * 1e-9)

    def tags(f: dict) -> dict:
        return {strings[a]: strings[b] for a, b in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")), strict=True)}

    def version(f: dict) -> int | None:
        return dict(fields(f[4])).get(1) if 4 in f else None

    zigzag = lambda v: (v >> 1) ^ -(v & 1)
    for group in groups:
        for k, v in fields(group):
            f = dict(fields(v))
            if k == 1:
                yield ("node", zigzag(f[1]), version(f), *place(zigzag(f[9]), zigzag(f[8])), tags(f), None, None)
            elif k == 2:
                ids, lats, lons = (_packed(f.get(n, b""), True, True) for n in (1, 8, 9))
                pairs, at = _packed(f.get(10, b"")), 0
                versions = _packed(dict(fields(f[5])).get(1, b"")) if 5 in f else []
                for i, (node, lat, lon) in enumerate(zip(ids, lats, lons, strict=True)):
                    own = {}
                    while at < len(pairs) and pairs[at]:
                        own[strings[pairs[at]]] = strings[pairs[at + 1]]
                        at += 2
                    at += 1
                    yield ("node", node, (versions[i] or None) if i < len(versions) else None, *place(lon, lat), own, None, None)
            elif k == 3:
                yield ("way", _signed(f[1]), version(f), None, None, tags(f), _packed(f.get(8, b""), True, True), None)
            elif k == 4:
                kinds = ("node", "way", "relation")
                roles, refs, types = _packed(f.get(8, b"")), _packed(f.get(9, b""), True, True), _packed(f.get(10, b""))
                yield ("relation", _signed(f[1]), version(f), None, None, tags(f), None, [{"type": kinds[t], "ref": r, "role": strings[o]} for o, r, t in zip(roles, refs, types, strict=True)])


_NAMES = [f.split(" ")[0] for f in ELEMENTS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))]


def read_pbf(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All elements of extracts, in splits of spark.sql.files.maxPartitionBytes; a file that cannot be read is an error.  `partitions` deals the blocks of small files out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(0):
                block = blob(record.as_py())
                rows = list(elements(inflate(block))) if block is not None else []
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) if x is not None else None for x in c] if pa.types.is_map(k) else list(c), k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    records = spark.read.option("lineSep", DATA.decode()).text(path).select(F.col("value").cast("binary").alias("record"))
    return (records.repartition(partitions) if partitions else records).mapInArrow(decode, ELEMENTS)


# --- writing -----------------------------------------------------------------------------------------


def _number(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def _field(n: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(n << 3) + _number(value & (1 << 64) - 1)
    return _number(n << 3 | 2) + _number(len(value)) + value


def _numbers(values, signed: bool = False, delta: bool = False) -> bytes:
    out, last = [], 0
    for v in values:
        step, last = (v - last, v) if delta else (v, last)
        out.append(_number((step << 1 ^ step >> 63) & (1 << 64) - 1 if signed else step))
    return b"".join(out)


def encode_block(rows: list[tuple]) -> bytes:
    """A block of elements (rows of ELEMENTS), still without its head."""
    strings: dict[str, int] = {"": 0}
    name = lambda s: strings.setdefault(s, len(strings))
    unit = lambda degrees: round(degrees * 1e7)
    groups = []
    nodes = [r for r in rows if r[0] == "node"]
    if nodes:
        keys = [v for r in nodes for v in (*(name(x) for kv in sorted((r[5] or {}).items()) for x in kv), 0)]
        info = _field(5, _field(1, _numbers([max(0, r[2] or 0) for r in nodes]))) if any(r[2] for r in nodes) else b""
        dense = _field(1, _numbers([r[1] for r in nodes], True, True)) + info + _field(8, _numbers([unit(r[4]) for r in nodes], True, True)) + _field(9, _numbers([unit(r[3]) for r in nodes], True, True)) + _field(10, _numbers(keys))
        groups.append(_field(2, dense))
    kinds = ("node", "way", "relation")
    for number, kind in ((3, "way"), (4, "relation")):
        own = []
        for r in rows:
            if r[0] != kind:
                continue
            tags = sorted((r[5] or {}).items())
            one = _field(1, r[1]) + _field(2, _numbers([name(k) for k, _ in tags])) + _field(3, _numbers([name(v) for _, v in tags]))
            one += _field(4, _field(1, r[2])) if r[2] else b""
            if kind == "way":
                one += _field(8, _numbers(r[6] or [], True, True))
            else:
                members = r[7] or []
                one += _field(8, _numbers([name(m["role"] or "") for m in members])) + _field(9, _numbers([m["ref"] for m in members], True, True)) + _field(10, _numbers([kinds.index(m["type"]) for m in members]))
            own.append(_field(number, one))
        if own:
            groups.append(b"".join(own))
    table = b"".join(_field(1, s.encode()) for s in strings)
    return _field(1, table) + b"".join(_field(2, g) for g in groups)


def _framed(kind: bytes, content: bytes) -> bytes:
    packed = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind) + _field(3, len(packed))
    return struct.pack(">I", len(head)) + head + packed


def write_pbf(df: DataFrame, path: str, block: int = 8000) -> None:
    """One extract of the elements, sorted by type and id.  Blocks are made by all tasks and pass through the driver one by one."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in _NAMES]
            columns[5] = [None if x is None else dict(x) for x in columns[5]]
            held += zip(*columns, strict=True)
            while len(held) >= block:
                yield pa.RecordBatch.from_arrays([pa.array([_framed(DATA, encode_block(held[:block]))], pa.binary())], ["block"])
                held = held[block:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_framed(DATA, encode_block(held))], pa.binary())], ["block"])

    rank = F.array_position(F.array(*map(F.lit, ("node", "way", "relation"))), F.col("osm_type"))
    blocks = df.select(*_NAMES).orderBy(rank, "id").mapInArrow(encode, "block binary")
    with files.create(df.sparkSession, path) as out:
        out.write(bytearray(_framed(b"OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes"))))
        for row in blocks.toLocalIterator():
            out.write(row.block)


# What belongs to each category, as terms of element types, key and values.
CATEGORIES = {
    "water": "nwr/natural=water nwr/waterway=river,stream,canal,drain,ditch nwr/water",
    "protected_areas": "r/boundary=national_park,protected_area nwr/leisure=nature_reserve",
    "parks": "nwr/leisure=park,playground,pitch,sports_centre,stadium,garden",
    "forests": "nwr/natural=wood nwr/landuse=forest",
    "roads_routable": "nwr/highway",
    "turn_restrictions": "r/type=restriction",
    "railways_routable": "nwr/railway=rail,light_rail,subway,tram,narrow_gauge,funicular,monorail",
    "cycle_routes": "r/route=bicycle,mtb",
    "hiking_routes": "r/route=hiking,foot",
    "food": "nwr/amenity=restaurant,cafe,bar,pub,fast_food,biergarten,food_court,ice_cream",
    "healthcare": "nwr/amenity=hospital,clinic,pharmacy,doctors,dentist,veterinary nwr/healthcare",
    "education": "nwr/amenity=school,university,college,kindergarten,library,childcare,music_school,driving_school,language_school",
    "government": "nwr/amenity=townhall,courthouse,police,fire_station,post_office,embassy,public_building nwr/office=government",
    "public_transport": "nwr/public_transport nwr/amenity=bus_station,ferry_terminal nwr/highway=bus_stop nwr/railway=station,halt,tram_stop,subway_entrance",
    "culture": "nwr/tourism=museum,gallery,artwork,attraction,viewpoint nwr/amenity=arts_centre,theatre,community_centre,planetarium nwr/historic",
    "religion": "nwr/amenity=place_of_worship",
    "sports": "nwr/leisure=sports_centre,stadium,pitch,fitness_centre,swimming_pool,ice_rink,track,golf_course,sports_hall",
    "shopping": "nwr/shop",
    "accommodation": "nwr/tourism=hotel,motel,hostel,guest_house,chalet,apartment,camp_site,caravan_site,alpine_hut,wilderness_hut",
    "finance": "nwr/amenity=bank,atm,bureau_de_change",
    "fuel_charging": "nwr/amenity=fuel,charging_station",
    "parking": "nwr/amenity=parking,bicycle_parking,motorcycle_parking",
    "entertainment": "nwr/amenity=cinema,theatre,nightclub,casino,events_venue nwr/leisure=escape_game,amusement_arcade,bowling_alley",
    "toilets": "nwr/amenity=toilets,shower,drinking_water",
    "emergency": "nwr/emergency nwr/amenity=fire_station,police",
}


def in_category(name: str, tags: str = "tags", kind: str = "osm_type"):
    return tag_query(CATEGORIES[name], tags, kind)


def categorised(df: DataFrame, names: tuple[str, ...] = tuple(CATEGORIES)) -> DataFrame:
    """One scan for many categories: a row for each category that an element is in."""
    return df.withColumn("category", F.explode(F.array_compact(F.array(*[F.when(in_category(n), n) for n in names]))))
