"""Pages to look at layers with: maps, atlases, and an index of regions.

A page is a small text; the features it shows are files beside it, written by all
tasks and joined, so a page does not grow with its layers.
"""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.operators import aggregate as A
from cartoframe.sources import files, geojson


@dataclass(frozen=True)
class Style:
    color: str = "#3366cc"
    width: float = 2.0
    fill: float = 0.2


_HEAD = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css"><script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{{height:100%;margin:0}}table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:2px 6px}}</style></head><body>
"""

_SCRIPT = """<div id="map"></div><script>
const map = L.map("map").setView([{lat}, {lon}], {zoom});
L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png", {{attribution: "&copy; OpenStreetMap contributors"}}).addTo(map);
const control = L.control.layers(null, {{}}).addTo(map);
const layers = {layers};
for (const one of layers) fetch(one.file).then(r => r.json()).then(data => {{
  const added = L.geoJSON(data, {{style: () => one.style, pointToLayer: (f, at) => L.circleMarker(at, one.style), onEachFeature: (f, l) => {{
    const box = document.createElement("table");
    for (const [k, v] of Object.entries(f.properties || {{}})) {{ const row = box.insertRow(); row.insertCell().textContent = k; row.insertCell().textContent = v; }}
    l.bindPopup(box); }} }}).addTo(map);
  control.addOverlay(added, one.name); }});
</script></body></html>
"""


def _write(spark, path: str, text: str) -> None:
    with files.create(spark, path) as out:
        out.write(bytearray(text.encode()))


def render_map(layers: dict[str, DataFrame], folder: str, title: str = "Map", styles: dict[str, Style] | None = None, centre: tuple[float, float] | None = None, zoom: int | None = None) -> str:
    """folder/index.html over the layers (feature_id, gtype, tags, coords, lon, lat), one file each; returns its path.  Centre and zoom are those of all layers, if not given."""
    spark = next(iter(layers.values())).sparkSession
    shown = []
    for k, (name, df) in enumerate(layers.items()):
        geojson.write_collection(df, f"{folder}/layer{k}.geojson")
        s = (styles or {}).get(name, Style())
        shown.append({"name": name, "file": f"layer{k}.geojson", "style": {"color": s.color, "weight": s.width, "fillOpacity": s.fill, "radius": 4}})
    if centre is None or zoom is None:
        row = A.bounds_and_zoom(A.merge_layers(*[df.select("lon", "lat") for df in layers.values()])).first()
        centre, zoom = centre or (row.centre_lon or 0.0, row.centre_lat or 0.0), row.zoom if zoom is None else zoom
    page = _HEAD.format(title=html.escape(title)) + _SCRIPT.format(lon=centre[0], lat=centre[1], zoom=zoom, layers=json.dumps(shown).replace("</", "<\\/"))
    _write(spark, f"{folder}/index.html", page)
    return f"{folder}/index.html"


def _table(df: DataFrame) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    rows = ("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.toLocalIterator())
    return f"<table><tr>{head}</tr>{''.join(rows)}</table>"


def render_atlas(cities: DataFrame, ranked: DataFrame, folder: str, title: str = "Atlas", about: str = "") -> str:
    """A map of the cities (city_id, name, region, score, lon, lat) by score, with the ranking of their regions and what the scores mean."""
    spark = cities.sparkSession
    color = lambda least, most: cities.where((F.col("score") >= least) & (F.col("score") < most)).select(F.col("city_id").cast("string").alias("feature_id"), F.lit("Point").alias("gtype"), F.create_map(*[x for c in ("name", "region", "score") for x in (F.lit(c), F.col(c).cast("string"))]).alias("tags"), F.array(F.struct("lon", "lat")).alias("coords"), "lon", "lat")
    steps = {"below 25": (0.0, 25.0, "#d7191c"), "25 to 50": (25.0, 50.0, "#fdae61"), "50 to 75": (50.0, 75.0, "#a6d96a"), "75 and more": (75.0, 1e9, "#1a9641")}
    render_map({name: color(a, b) for name, (a, b, _) in steps.items()}, folder, title, {name: Style(c) for name, (_, _, c) in steps.items()})
    page = _HEAD.format(title=html.escape(title)) + f"<h1>{html.escape(title)}</h1><p><a href=\"index.html\">Map</a></p>{_table(ranked)}<h2>About</h2><p>{html.escape(about)}</p></body></html>"
    _write(spark, f"{folder}/atlas.html", page)
    return f"{folder}/atlas.html"


def render_regions(layers: DataFrame, folder: str, region: str = "region", title: str = "Regions") -> list[str]:
    """A map for every region and an index of them; a region is a job, as its files are its own."""
    spark = layers.sparkSession
    sizes = layers.groupBy(region).agg(F.count(F.lit(1)).alias("features")).orderBy(region)
    made = []
    for row in sizes.collect():  # one row for each page
        name = "".join(c if c.isalnum() else "-" for c in str(row[region]))
        render_map({str(row[region]): layers.where(F.col(region).eqNullSafe(F.lit(row[region]))).drop(region)}, f"{folder}/{name}", str(row[region]))
        made.append((str(row[region]), name, row.features))
    items = "".join(f'<li><a href="{n}/index.html">{html.escape(r)}</a> ({k})</li>' for r, n, k in made)
    _write(spark, f"{folder}/index.html", _HEAD.format(title=html.escape(title)) + f"<h1>{html.escape(title)}</h1><ul>{items}</ul></body></html>")
    return [n for _, n, _ in made]
