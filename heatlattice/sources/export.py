"""Writers: CSV, guarded CSV, GeoJSON, JSON records, a self-contained HTML map, map frames."""

from __future__ import annotations

import json
import re
import tempfile
import webbrowser
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.geo import polygon_metrics, wkt_polygons
from ..functions.numeric import formula_guard, hover_text, map_zoom
from ..operators.classify import NONE
from ..storage import shared_dir

_NESTED = ("struct", "array", "map")
#: Map colours by label (fixed values).
COLOURS = {
    "no pattern detected": "lightgray",
    "new hotspot": "mediumturquoise",
    "new coldspot": "#87CEEB",
    "sporadic hotspot": "lightsalmon",
    "sporadic coldspot": "#B0E0E6",
    "consecutive hotspot": "orangered",
    "consecutive coldspot": "#4682B4",
    "persistent hotspot": "saddlebrown",
    "persistent coldspot": "#000080",
    "intensifying hotspot": "purple",
    "intensifying coldspot": "#483D8B",
    "diminishing hotspot": "orange",
    "diminishing coldspot": "#1E90FF",
    "historical hotspot": "#8B4513",
    "historical coldspot": "#00008B",
    "oscilating hotspot": "#FF8C00",
    "oscilating coldspot": "#0000CD",
}
#: Keys that a script could take for object machinery (fixed values), and folders that no file may be saved in.
UNSAFE_KEYS = ["__proto__", "constructor", "prototype"]
SYSTEM_FOLDERS = ["/etc", "/var", "/usr", "/bin", "/sbin", "/boot", "/sys", "/proc"]
#: Regions that a page for a browser may hold.
PAGE = 20_000


def without_unsafe_keys(column: Column, kind: DataType) -> Column:
    """column without the unsafe keys at any depth of structs, arrays and maps."""
    if isinstance(kind, StructType):
        fields = [without_unsafe_keys(column[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in UNSAFE_KEYS]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType | MapType):
        return F.transform(column, lambda x: without_unsafe_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        out = F.map_filter(column, lambda k, v: ~k.cast("string").isin(UNSAFE_KEYS))
        return F.transform_values(out, lambda k, v: without_unsafe_keys(v, kind.valueType)) if isinstance(kind.valueType, StructType | ArrayType | MapType) else out
    return column


def _properties(df: DataFrame, *left_out: str) -> Column:
    return F.struct(*(without_unsafe_keys(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in (*left_out, *UNSAFE_KEYS)))


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(_NESTED) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def guarded(df: DataFrame, numeric_safe: bool = False) -> DataFrame:
    """All columns as text that no spreadsheet takes for a formula."""
    return flat(df).select(*(formula_guard(F.col(c).cast("string"), numeric_safe).alias(c) for c in df.columns))


def write_guarded_csv(df: DataFrame, path: str, numeric_safe: bool = False) -> None:
    guarded(df, numeric_safe).write.mode("overwrite").option("header", True).csv(path)


def polygons_of(df: DataFrame, geometry: str = "geometry") -> Column:
    """Polygons of rings of vertices, of WKT or of an array of the vertices of one ring."""
    return F.when(F.col(geometry).isNotNull(), F.array(F.array(F.col(geometry)))) if dict(df.dtypes)[geometry].startswith("array") else wkt_polygons(F.col(geometry))


def geojson(df: DataFrame, geometry: str = "geometry") -> Column:
    """The geometry as GeoJSON text, holes and several polygons included; null for none."""
    rings = F.transform(polygons_of(df, geometry), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    kind = F.lit("") if dict(df.dtypes)[geometry].startswith("array") else F.upper(F.regexp_extract(geometry, r"(?i)^\s*([A-Z]+)", 1))
    first = F.get(rings, F.lit(0))
    shape = lambda name, body: F.to_json(F.struct(F.lit(name).alias("type"), body.alias("coordinates")))
    points = F.flatten(F.flatten(rings))
    return (
        F.when(F.size(points) == 0, shape("Polygon", F.array().cast("array<string>")))
        .when((kind == "POINT") | (F.size(points) == 1), shape("Point", F.get(points, F.lit(0))))
        .when(kind == "LINESTRING", shape("LineString", points))
        .when(kind == "MULTIPOINT", shape("MultiPoint", points))
        .when(kind == "MULTILINESTRING", shape("MultiLineString", F.flatten(rings)))
        .when(kind == "MULTIPOLYGON", shape("MultiPolygon", rings))
        .when(F.col(geometry).isNotNull(), shape("Polygon", first))
    )


def features(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature text for each row."""
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geojson(df, geometry), F.lit("null")), F.lit(',"properties":'), F.to_json(_properties(df, geometry)), F.lit("}")).alias("feature"))


def records(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(_properties(df)).alias("record"))


def map_frame(df: DataFrame, region: str, geometry: str = "geometry") -> DataFrame:
    """region, classification, colour, hover, centre and bounds, for any renderer."""
    colours = F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair))
    return df.select(region, "classification", F.coalesce(F.try_element_at(colours, F.col("classification")), F.lit(COLOURS[NONE])).alias("colour"), hover_text(F.col(region), F.col("classification"), F.col("tau"), F.col("p_value")).alias("hover"), polygon_metrics(polygons_of(df, geometry)).alias("m")).select(region, "classification", "colour", "hover", "m.*")


def map_view(frame: DataFrame) -> DataFrame:
    """One row: centre of all centroids, total bounds, zoom."""
    view = frame.agg(F.avg("cx").alias("lon"), F.avg("cy").alias("lat"), *(f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))))
    return view.withColumn("zoom", map_zoom(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))))


def legend(frame: DataFrame) -> DataFrame:
    return frame.select("classification", "colour").distinct().orderBy("classification")


def check_path(path: str) -> Path:
    """The absolute path if it may be written, else ValueError."""
    if not path or not isinstance(path, str):
        raise ValueError("a file path is needed")
    for form in (path, str(Path(path).resolve())):
        if any(form == s or form.startswith(s + "/") for s in SYSTEM_FOLDERS):
            raise ValueError("system folders cannot be written")
    if ".." in Path(path).parts:
        raise ValueError("the path must not go up")
    if not path.endswith(".html"):
        raise ValueError("the file must end in .html")
    return Path(path).resolve()


_STYLE = """body{font-family:sans-serif;margin:1em}svg{border:1px solid #ccc;width:100%;height:75vh;cursor:grab}
li{list-style:none}li span{display:inline-block;width:1em;height:1em;margin-right:.5em}.off{display:none}.hit{stroke:#000;stroke-width:4}"""
#: Wheel and drag move the map, check boxes choose labels, a text finds regions, and a file of features replaces the data.
_SCRIPT = """
const map=document.querySelector('svg'),hidden=new Set();let box=[0,0,1000,1000],held=null;
const view=()=>map.setAttribute('viewBox',box.join(' '));
const at=e=>{const r=map.getBoundingClientRect(),s=Math.min(r.width,r.height);return[box[0]+box[2]*(.5+(e.clientX-r.left-r.width/2)/s),box[1]+box[3]*(.5+(e.clientY-r.top-r.height/2)/s)]};
map.addEventListener('wheel',e=>{e.preventDefault();const f=e.deltaY>0?1.25:.8,[x,y]=at(e);box=[x-(x-box[0])*f,y-(y-box[1])*f,box[2]*f,box[3]*f];view()},{passive:false});
map.addEventListener('pointerdown',e=>held=at(e));window.addEventListener('pointerup',()=>held=null);
map.addEventListener('pointermove',e=>{if(!held)return;const[x,y]=at(e);box[0]+=held[0]-x;box[1]+=held[1]-y;view()});
document.getElementById('whole').onclick=()=>{box=[0,0,1000,1000];view()};
function refresh(){const find=document.getElementById('find').value.toLowerCase();let n=0;
 for(const s of map.children){const off=hidden.has(s.dataset.label);s.classList.toggle('off',off);n+=!off;
  s.classList.toggle('hit',!!find&&(s.dataset.region||'').toLowerCase().includes(find))}
 document.getElementById('count').textContent=n+' regions'}
function legend(){const list=document.getElementById('labels'),have=new Set([...map.children].map(s=>s.dataset.label));list.textContent='';
 for(const x of[...have].sort()){const li=document.createElement('li'),tick=document.createElement('input'),key=document.createElement('span');
  tick.type='checkbox';tick.checked=!hidden.has(x);tick.onchange=()=>{tick.checked?hidden.delete(x):hidden.add(x);refresh()};
  key.style.background=colours[x]||'lightgray';li.append(tick,key,x);list.append(li)}refresh()}
function draw(features){const ns='http://www.w3.org/2000/svg',polygons=g=>!g?[]:g.type==='Point'?[[[g.coordinates]]]:g.type==='Polygon'?[g.coordinates]:g.coordinates;
 const all=features.flatMap(f=>polygons(f.geometry).flat(2)),xs=all.map(p=>p[0]),ys=all.map(p=>p[1]);map.textContent='';if(!all.length)return legend();
 const low=v=>v.reduce((a,b)=>Math.min(a,b)),high=v=>v.reduce((a,b)=>Math.max(a,b)),x0=low(xs),y0=low(ys),span=Math.max(high(xs)-x0,high(ys)-y0)||1;
 const place=p=>[1000*(p[0]-x0)/span,1000-1000*(p[1]-y0)/span];
 for(const f of features){const own=f.properties||{},point=f.geometry&&f.geometry.type==='Point',s=document.createElementNS(ns,point?'circle':'path');
  if(point){const[x,y]=place(f.geometry.coordinates);s.setAttribute('cx',x);s.setAttribute('cy',y);s.setAttribute('r',6)}
  else{s.setAttribute('fill-rule','evenodd');s.setAttribute('d',polygons(f.geometry).flat(1).map(r=>'M'+r.map(place).join('L')+'Z').join(''))}
  s.dataset.label=own.classification||'no pattern detected';s.dataset.region=String(Object.values(own)[0]??'');s.setAttribute('fill',colours[s.dataset.label]||'lightgray');
  const tip=document.createElementNS(ns,'title');tip.textContent=Object.entries(own).filter(e=>typeof e[1]!=='object').map(e=>e.join(': ')).join(', ');s.append(tip);map.append(s)}legend()}
document.getElementById('file').onchange=e=>{const f=e.target.files[0];if(f)f.text().then(t=>{let made;
 try{made=JSON.parse(t)}catch{made=t.split('\\n').filter(x=>x.trim()).map(x=>JSON.parse(x))}draw(made.features||made)})};
document.getElementById('find').oninput=refresh;legend();view();
"""


def _page(title: str, rows: list[dict], shapes: list[str], interactive: bool = True) -> str:
    plain = lambda x: re.sub("(?i)</script>", r"<\\/script>", json.dumps(x, default=str))
    keys = "".join(f'<li><span style="background:{c}"></span>{escape(x)}</li>' for x, c in sorted(COLOURS.items()) if any(r["classification"] == x for r in rows))
    tools = '<p><input type="file" id="file" accept=".json,.geojson"> <input id="find" placeholder="find a region"> <button id="whole">whole map</button> <span id="count"></span></p>' if interactive else ""
    script = f"<script>const colours={plain(COLOURS)};{_SCRIPT}</script>" if interactive else ""
    return f"""<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head>
<body><h1>{escape(title)}</h1>{tools}<svg viewBox="0 0 1000 1000">{"".join(shapes)}</svg><ul id="labels">{keys}</ul>
<script type="application/json" id="data">{plain(rows)}</script>{script}</body></html>"""


def _shapes(rows: list[dict], polygons: list[list | None]) -> list[str]:
    points = [p for shape in polygons for rings in shape or () for ring in rings for p in ring]
    if not points:
        return []
    x0, y0 = min(p["x"] for p in points), min(p["y"] for p in points)
    span = max(max(p["x"] for p in points) - x0, max(p["y"] for p in points) - y0) or 1.0
    place = lambda p: f"{1000 * (p['x'] - x0) / span:.2f} {1000 - 1000 * (p['y'] - y0) / span:.2f}"
    out = []
    for row, shape in zip(rows, polygons, strict=True):
        rings = [ring for rings in shape or () for ring in rings if ring]
        named = f'fill="{row["colour"]}" data-label="{escape(row["classification"] or "")}" data-region="{escape(str(row["region"]))}"'
        tip = f"<title>{escape(row['hover'].replace('<br>', ' '))}</title>"
        if len(rings) == 1 and len(rings[0]) == 1:
            x, y = place(rings[0][0]).split()
            out.append(f'<circle cx="{x}" cy="{y}" r="6" {named}>{tip}</circle>')
        elif rings:
            path = "".join("M" + "L".join(map(place, ring)) + "Z" for ring in rings)
            out.append(f'<path d="{path}" fill-rule="evenodd" stroke="#fff" {named}>{tip}</path>')
    return out


class TooManyRegions(ValueError):
    """More regions than one page can hold."""


def render(df: DataFrame | None, title: str = "Emerging hot spots", region: str | None = None, interactive: bool = True, most: int = PAGE) -> str:
    """An HTML page with a map of df's regions; without geometry, with their rows alone. More than `most` regions are too
    many for one page and raise ValueError: `tiles.write_tiled_map` writes maps of any size."""
    if df is None or not df.columns:
        return _page(title, [], [], interactive)
    region = region or df.columns[0]
    facts = F.struct(region, "classification", "tau", "p_value").alias("r")
    shown = df.select(facts, (polygons_of(df) if "geometry" in df.columns else F.lit(None)).alias("shape"), hover_text(F.col(region).cast("string"), F.col("classification"), F.col("tau"), F.col("p_value")).alias("hover"))
    got = shown.limit(most + 1).collect()
    if len(got) > most:
        raise TooManyRegions(f"a page holds at most {most} regions; tiles.write_tiled_map writes maps of any size")
    rows = [x["r"].asDict() for x in got]
    marked = [r | {"region": r[region], "hover": x["hover"] or "", "colour": COLOURS.get(r["classification"], COLOURS[NONE])} for r, x in zip(rows, got, strict=True)]
    return _page(title, rows, _shapes(marked, [x["shape"] for x in got]), interactive)


def plot_map(df: DataFrame, title: str = "Emerging hot spots", region: str | None = None, lib: str = "svg") -> str:
    """A page: `svg` stands still; `plotly`, `folium` and `html` name one and the same interactive page of our own."""
    if lib not in ("svg", "html", "plotly", "folium"):
        raise ValueError("lib must be 'svg', 'html', 'plotly' or 'folium'")
    return render(df, title, region, lib != "svg")


def save_visualization(path: str, df: DataFrame | None = None, include_data: bool = True, most: int = PAGE) -> str:
    """A page at path. Beyond `most` regions its tiles lie in a folder beside it, which tasks write: path must then be in
    a folder that driver and executors share."""
    target = check_path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        target.write_text(render(df if include_data else None, most=most), encoding="utf-8")
    except TooManyRegions:
        from .tiles import write_tiled_map

        write_tiled_map(df, str(target))
    return str(target)


def launch_visualization(df: DataFrame | None = None, auto_open: bool = True, most: int = PAGE) -> str:
    """A page in a folder of its own, opened in a browser; beyond `most` regions in a folder of spark.checkpoint.dir, with
    its tiles, as far as that names a mounted folder."""
    path = Path(tempfile.mkdtemp(prefix="heatlattice-map-")) / "map.html"
    try:
        path.write_text(render(df, most=most), encoding="utf-8")
    except TooManyRegions:
        from .tiles import write_tiled_map

        path = Path(re.sub("^file:/+", "/", shared_dir(df.sparkSession))) / path.parent.name / "map.html"
        write_tiled_map(df, str(path))
    if auto_open:
        webbrowser.open(path.as_uri())
    return str(path)


launch_viewer = launch_visualization
