"""Change files: read as tables, cut by region, and published with their state.

A replication folder holds one compressed change file a sequence, under the nine
digits of its number in threes, and a state file with the last one.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.sources import files

CHANGES = "sequence long, seq_pos long, op string, osm_type string, osm_id long, version int, changeset long, timestamp string, user string, visible boolean, lon double, lat double, tags map<string,string>, node_refs array<long>, members array<struct<type:string,ref:long,role:string>>"
_NAMES = [c.split(" ")[0] for c in CHANGES.split(", ")]
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(_MEMBER)]
_SEQUENCE = re.compile(r"(\d{3})/(\d{3})/(\d{3})\.osc(?:\.gz)?$|(\d+)\.osc(?:\.gz)?$")
_ELEMENTS = ("node", "way", "relation")


def sequence_of(path: str) -> int | None:
    m = _SEQUENCE.search(path)
    return int("".join(x for x in m.groups() if x)) if m else None


def parse(content: bytes, sequence: int | None) -> Iterator[tuple]:
    """Rows of CHANGES of one change file, in its order."""
    stream = io.BytesIO(content)
    source = gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream
    op, position, number = None, 0, lambda e, k, kind: None if e.get(k) is None else kind(e.get(k))
    root = None
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        if root is None:
            root = e
        if e.tag in ("create", "modify", "delete"):
            op = e.tag if event == "start" else None
            if event == "end":
                root.clear()
        elif event == "end" and e.tag in _ELEMENTS and op:
            tags = [(t.get("k"), t.get("v")) for t in e.findall("tag")]
            refs = [int(n.get("ref")) for n in e.findall("nd")] if e.tag == "way" else None
            members = [{"type": m.get("type"), "ref": int(m.get("ref")), "role": m.get("role") or ""} for m in e.findall("member")] if e.tag == "relation" else None
            yield (sequence, position, op, e.tag, int(e.get("id")), number(e, "version", int), number(e, "changeset", int), e.get("timestamp"), e.get("user"), op != "delete" and e.get("visible") != "false", number(e, "lon", float), number(e, "lat", float), tags, refs, members)
            position += 1
            e.clear()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Change files (.osc, .osc.gz), one task a file: a sequence is a day at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple] = []
                for row in parse(content.as_py(), sequence_of(name)):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.osc*").load(path).select("path", "content").mapInArrow(run, CHANGES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def element_xml(r) -> str:
    attributes = {"id": r.osm_id, "version": r.version, "timestamp": r.timestamp, "changeset": r.changeset, "user": r.user, "lat": r.lat, "lon": r.lon}
    head = f"<{r.osm_type}" + "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items() if v is not None)
    inner = [f"<nd ref=\"{n}\"/>" for n in r.node_refs or ()] + [f"<member type={quoteattr(m['type'])} ref=\"{m['ref']}\" role={quoteattr(m['role'] or '')}/>" for m in r.members or ()]
    inner += [f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in sorted((r.tags or {}).items())]
    return f"{head}>{''.join(inner)}</{r.osm_type}>" if inner else f"{head}/>"


def sequence_path(sequence: int) -> str:
    if sequence < 0:
        raise ValueError(f"a sequence is not below 0: {sequence}")
    digits = f"{sequence:09d}"
    return f"{digits[:3]}/{digits[3:6]}/{digits[6:]}"


def state_text(sequence: int, timestamp: str) -> str:
    """A state file: a properties file, whose colons are escaped."""
    return f"sequenceNumber={sequence}\ntimestamp={timestamp.replace(':', chr(92) + ':')}\n"


def read_state(spark: SparkSession, root: str) -> tuple[int | None, str]:
    """(last sequence, timestamp) of a replication folder; no sequence if nothing was published."""
    text = files.read_text(spark, f"{root}/state.txt") or ""
    found = dict(line.strip().split("=", 1) for line in text.splitlines() if "=" in line)
    number = found.get("sequenceNumber", "").strip()
    return int(number) if number.isdigit() else None, found.get("timestamp", "").strip().replace("\\:", ":")


def publish(changes: DataFrame, root: str, sequence: int, timestamp: str) -> None:
    """Writes one sequence's change file, its state, and then the folder's: a reader that follows the state never sees half a sequence.

    Publishing a sequence again replaces its file; one that skips a number is an
    error.  Rows pass through the driver in order of seq_pos.
    """
    spark = changes.sparkSession
    last, _ = read_state(spark, root)
    if last is not None and sequence > last + 1:
        raise ValueError(f"sequence {sequence} after {last} leaves a gap")
    place = f"{root}/{sequence_path(sequence)}"
    with files.create(spark, f"{place}.osc.gz", gzip=True) as out:
        put = lambda text: out.write(bytearray(text.encode()))
        put('<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6">\n')
        op, held = None, []
        for row in changes.select(*_NAMES).orderBy("seq_pos", "osm_type", "osm_id").toLocalIterator():
            if row.op != op:
                held.append((f"</{op}>\n" if op else "") + f"<{row.op}>\n")
                op = row.op
            held.append(element_xml(row) + "\n")
            if len(held) >= 1000:
                put("".join(held))
                held = []
        put("".join(held) + (f"</{op}>\n" if op else "") + "</osmChange>\n")
    for path in (f"{place}.state.txt", f"{root}/state.txt"):
        if path.endswith(f"{root}/state.txt") and last is not None and last > sequence:
            continue
        with files.create(spark, path) as out:
            out.write(bytearray(state_text(sequence, timestamp).encode()))


def publish_regions(changes: DataFrame, areas: DataFrame, places: DataFrame, root: str, sequence: int, timestamp: str) -> dict[str, int]:
    """Cuts a sequence to regions and publishes it under root/<region>-updates; returns the rows of each.

    areas: region, coords; places: osm_type, osm_id, lon, lat of elements that a
    change does not place itself (ways, relations, deletions).  A change in several
    regions goes to each, one without a place to none.  Every region gets the
    sequence, an empty file too, so that none has a gap.
    """
    from cartoframe.streaming.changes import cut_by_region

    known = places.select("osm_type", "osm_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    placed = changes.join(known, ["osm_type", "osm_id"], "left").withColumn("own_lon", F.col("lon")).withColumn("own_lat", F.col("lat")).withColumn("lon", F.coalesce("lon", "x")).withColumn("lat", F.coalesce("lat", "y")).drop("x", "y")
    cut = cut_by_region(placed, areas).withColumn("lon", F.col("own_lon")).withColumn("lat", F.col("own_lat")).drop("own_lon", "own_lat").persist()
    out = {}
    for (region,) in sorted(areas.select("region").distinct().collect()):
        own = cut.where(F.col("region") == region)
        publish(own, f"{root}/{region}-updates", sequence, timestamp)
        out[region] = own.count()
    cut.unpersist()
    return out
