"""Maps of any number of regions: a quadtree of tiles that tasks write, and a page that loads what is in view.

Places are integers on a grid of 2^28 steps along the longer side of the map; level z cuts it into 4^z tiles. A region's
home is the deepest level at which it is no wider than a tile, so it lies in four tiles at most. It is kept

* whole (to a step of the grid) at its home, in the tiles' `own` files, which deeper views load, too,
* outlined at the levels above, in their `over` files: corners go to the nearest of 2^10 steps a tile. As equal corners go
  to equal places, borders that regions share stay shared; corners that repeat or lie on a line are left out,
* as part of a dot where it is no wider than a 64th of a tile: the regions of a label in such a cell are one dot with
  their number. Only the six levels above home can hold its outline, so a region has 28 shapes at most.

Files are parts of tiles: a tile with much text is dealt to parts by region, so no file grows with a hot place. Regions
without a geometry have no place and are counted alone. Equal rows stay as many regions; no row, no tile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import hover_text
from ..operators.classify import NONE
from ..storage import discard, staged
from .export import COLOURS, polygons_of
from .shapefile_source import _opened

#: Bits of the grid, of an outline's steps in a tile, and of a tile's cells.
GRID, STEPS, CELLS = 28, 10, 6
#: Regions a tile of the deepest level has on average, levels at most, and characters of a file on average.
DEPTH, LEVELS, FILE = 256, 16, 1 << 19
_TILE = "struct<name:string,parts:int,rows:array<struct<r:string,l:string,t:string,g:array<array<array<int>>>,d:array<int>,n:bigint>>>"


def _ends(polygons: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(F.flatten(F.flatten(polygons)), lambda p: p[axis])
    return F.array_min(values), F.array_max(values)


def _bound(value: Column, use) -> Column:
    """use(value), value being computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def outline(ring: Column) -> Column:
    """ring (array<struct<x, y>> of whole numbers) without corners that repeat or lie on the line of their neighbours."""
    turn = lambda a, p, b: (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])
    new = lambda r: F.filter(r, lambda p, i: (i == 0) | (F.get(r, i - 1) != p))
    bends = lambda r: F.filter(r, lambda p, i: (i == 0) | (i == F.size(r) - 1) | turn(F.get(r, i - 1), p, F.get(r, i + 1)))
    return _bound(_bound(ring, new), bends)


def placed(df: DataFrame, region: str, geometry: str = "geometry") -> tuple[DataFrame, dict]:
    """Regions on the grid (r, label, tip, shape, w, s, e, n, bits: the side is at most 2^bits steps), written once, and the
    map's figures: x0, y0, span, regions, placeless, levels."""
    tip = hover_text(F.col(region).cast("string"), F.col("classification"), F.col("tau"), F.col("p_value"))
    rows = df.select(F.col(region).cast("string").alias("r"), F.coalesce("classification", F.lit(NONE)).alias("label"), F.replace(tip, F.lit("<br>"), F.lit(" ")).alias("tip"), polygons_of(df, geometry).alias("shape"))
    (left, right), (low, high) = _ends(F.col("shape"), "x"), _ends(F.col("shape"), "y")
    rows = staged(rows.select("*", left.alias("left"), right.alias("right"), low.alias("low"), high.alias("high")), "places")
    has = F.col("left").isNotNull()
    b = rows.agg(F.min("left").alias("x0"), F.min("low").alias("y0"), F.max("right").alias("x1"), F.max("high").alias("y1"), F.count_if(has).alias("regions"), F.count_if(~has).alias("placeless")).first()
    span = max(b["x1"] - b["x0"], b["y1"] - b["y0"]) or 1.0 if b["regions"] else 1.0
    levels = sum(DEPTH << 2 * z < b["regions"] for z in range(LEVELS))
    figures = {"x0": b["x0"] or 0.0, "y0": b["y0"] or 0.0, "span": span, "regions": b["regions"], "placeless": b["placeless"], "levels": levels}
    at = lambda v, c: F.floor((v - F.lit(figures[c])) / F.lit(span) * float(1 << GRID)).cast("long")
    whole = F.transform("shape", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(at(p["x"], "x0").alias("x"), at(p["y"], "y0").alias("y")))))
    grid = rows.where(has).select("r", "label", "tip", whole.alias("shape"), at(F.col("left"), "x0").alias("w"), at(F.col("low"), "y0").alias("s"), at(F.col("right"), "x0").alias("e"), at(F.col("high"), "y0").alias("n"))
    side = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    out = staged(grid.withColumn("bits", F.when(side < 2, 0).otherwise(F.length(F.bin(side - 1)))), "grid")
    discard(rows)
    return out, figures


def _shift(value: Column, bits: Column) -> Column:
    """value (not negative) div 2^bits, bits being a column."""
    return F.call_function("shiftright", value, bits)


def _tile(value: Column) -> Column:
    """The tile of a place at the row's level; the far border belongs to the last tile."""
    return F.least(_shift(value, F.lit(GRID) - F.col("level")), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1).cast("int")


def features(grid: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, kind, key, text): the JSON rows of each tile, shapes of regions and dots of many."""
    grid = grid.withColumn("home", F.least(F.lit(levels), GRID - F.col("bits")))
    dots_end = F.least(GRID - CELLS - F.col("bits"), F.col("home") - 1)
    first = F.greatest(dots_end + 1, F.lit(0))
    span = lambda low, high: F.explode(F.sequence(_tile(F.col(low)), _tile(F.col(high))))
    shapes = grid.select("*", F.explode(F.sequence(first, F.col("home"))).alias("level")).select("*", span("w", "e").alias("x")).select("*", span("s", "n").alias("y"))
    own = F.col("level") == F.col("home")
    # Steps are 2^fine grid steps wide; a whole shape keeps the grid's own.
    fine = F.when(own, 0).otherwise(GRID - STEPS - F.col("level"))
    half = F.when(own, 0).otherwise(F.call_function("shiftleft", F.lit(1), GRID - STEPS - 1 - F.col("level")))
    step = lambda v, tile: (_shift(v + half, fine) - F.call_function("shiftleft", tile.cast("long"), GRID - F.col("level") - fine)).cast("int")
    local = lambda ring: F.transform(ring, lambda p: F.struct(step(p["x"], F.col("x")).cast("long").alias("x"), step(p["y"], F.col("y")).cast("long").alias("y")))
    rings = F.transform(F.flatten("shape"), lambda ring: F.transform(outline(local(ring)), lambda p: F.array(p["x"], p["y"])))
    text = F.to_json(F.struct("r", F.col("label").alias("l"), F.col("tip").alias("t"), rings.alias("g")))
    drawn = shapes.select("level", "x", "y", F.when(own, "own").otherwise("over").alias("kind"), F.xxhash64("r").alias("key"), text.alias("text"))

    small = grid.where(dots_end >= 0).select("label", F.expr("(w + e) div 2").alias("cx"), F.expr("(s + n) div 2").alias("cy"), F.explode(F.sequence(F.lit(0), dots_end)).alias("level"))
    # Cells are counted in the whole map; the far border belongs to the last.
    cell = lambda c: F.least(_shift(F.col(c), GRID - CELLS - F.col("level")), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") + CELLS) - 1)
    cells = small.select("level", "label", cell("cx").alias("i"), cell("cy").alias("j")).groupBy("level", "i", "j", "label").agg(F.count("*").alias("many"))
    inside = 1 << CELLS
    dot = F.to_json(F.struct(F.col("label").alias("l"), F.array(F.col("i") % inside, F.col("j") % inside).alias("d"), F.col("many").alias("n")))
    dots = cells.select("level", F.expr(f"cast(i div {inside} as int)").alias("x"), F.expr(f"cast(j div {inside} as int)").alias("y"), F.lit("over").alias("kind"), F.xxhash64("i", "j", "label").alias("key"), dot.alias("text"))
    return drawn.unionByName(dots)


def files(rows: DataFrame, most: int = FILE) -> DataFrame:
    """(name, body): each part of a tile as a script that hands its rows to the page. rows are read twice: stage them."""
    tile = ["level", "x", "y", "kind"]
    large = rows.groupBy(tile).agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") > most).select(*tile, F.expr(f"cast((chars + {most - 1}) div {most} as int)").alias("parts"))
    dealt = rows.join(large, tile, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("cast(pmod(key, parts) as int)"))
    # Parts that got no row are written empty where they are the first, which tells how many there are.
    firsts = large.select(*tile, "parts", F.lit(0).alias("part"), F.lit(None).cast("string").alias("text"))
    grouped = dealt.select(*tile, "parts", "part", "text").unionByName(firsts).groupBy(*tile, "parts", "part").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    name = F.format_string("%d/%d/%d.%s.%d", "level", "x", "y", "kind", "part")
    body = F.concat(F.lit('tile({"name":"'), name, F.lit('","parts":'), F.col("parts").cast("string"), F.lit(',"rows":['), F.concat_ws(",\n", "texts"), F.lit("]});\n"))
    return grouped.select(name.alias("name"), body.alias("body"))


def _write(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files go to a name of the attempt first, so one that ends half way, or two at a time, leave no half file."""
    system, root = _opened(folder)
    for batch in batches:
        for name, body in zip(batch["name"], batch["body"], strict=True):
            path = f"{root}/{name}.js"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            unfinished = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(unfinished) as out:
                out.write(body.encode())
            system.move(unfinished, path)
        yield pd.DataFrame({"files": [len(batch)], "bytes": [int(batch["body"].str.len().sum())]})


_STYLE = "body{font-family:sans-serif;margin:1em}svg{border:1px solid #ccc;width:100%;height:80vh;cursor:grab}li{list-style:none;display:inline-block;margin-right:1em}li span{display:inline-block;width:1em;height:1em;margin-right:.5em}"
#: The page keeps the tiles it has loaded, and draws what the view's level and all above it have there.
_SCRIPT = """
const svg=document.querySelector('svg'),side=2**about.grid,tiles=new Map(),hidden=new Set();let box=[0,0,side,side],held=null,due=0;
function tile(t){tiles.set(t.name,t);if(t.name.endsWith('.0'))for(let k=1;k<t.parts;k++)load(t.name.slice(0,-1)+k);later()}
function load(name){if(tiles.has(name))return;tiles.set(name,null);const s=document.createElement('script');s.src=about.folder+'/'+name+'.js';s.onerror=s.onload=()=>s.remove();document.head.append(s)}
const later=()=>{clearTimeout(due);due=setTimeout(draw,30)};
const inView=z=>{const n=2**z,w=side/n,from=v=>Math.max(0,Math.floor(v/w)),to=v=>Math.min(n-1,Math.floor(v/w)),out=[];
 for(let x=from(box[0]);x<=to(box[0]+box[2]);x++)for(let y=from(side-box[1]-box[3]);y<=to(side-box[1]);y++)out.push([x,y]);return out};
function draw(){const z=Math.max(0,Math.min(about.levels,Math.ceil(Math.log2(side/box[2])))),names=[];
 for(let l=0;l<=z;l++)for(const[x,y]of inView(l)){names.push([l,x,y,'own']);if(l===z)names.push([l,x,y,'over'])}
 svg.setAttribute('viewBox',box.join(' '));svg.textContent='';const seen=new Set(),ns='http://www.w3.org/2000/svg';let n=0;
 for(const[l,x,y,kind]of names){const first=l+'/'+x+'/'+y+'.'+kind+'.';load(first+0);const parts=(tiles.get(first+0)||{parts:0}).parts;
  const wide=side/2**l,unit=kind==='own'?1:wide/2**about.steps,px=p=>x*wide+p[0]*unit,py=p=>side-(y*wide+p[1]*unit);
  for(let k=0;k<parts;k++){const t=tiles.get(first+k);if(!t)continue;
   t.rows.forEach((f,i)=>{if(hidden.has(f.l))return;const id=JSON.stringify([f.r,f.g&&f.g.map(r=>r.map(p=>[px(p),py(p)]))]);if(!f.d){if(seen.has(id))return;seen.add(id)}
    const cell=wide/2**about.cells,one=!f.d&&f.g.length===1&&f.g[0].length===1,s=document.createElementNS(ns,f.d?'rect':one?'circle':'path');
    if(f.d){const w=cell*Math.min(1,.4+.15*Math.log10(f.n+1));s.setAttribute('x',x*wide+f.d[0]*cell+(cell-w)/2);s.setAttribute('y',side-(y*wide+f.d[1]*cell)-(cell+w)/2);s.setAttribute('width',w);s.setAttribute('height',w)}
    else if(one){s.setAttribute('cx',px(f.g[0][0]));s.setAttribute('cy',py(f.g[0][0]));s.setAttribute('r',box[2]/200)}
    else{s.setAttribute('fill-rule','evenodd');s.setAttribute('stroke','#fff');s.setAttribute('stroke-width',box[2]/2000);s.setAttribute('d',f.g.map(r=>'M'+r.map(p=>px(p)+' '+py(p)).join('L')+'Z').join(''))}
    s.setAttribute('fill',colours[f.l]||'lightgray');const tip=document.createElementNS(ns,'title');tip.textContent=f.d?f.n+' x '+f.l:f.t;s.append(tip);svg.append(s);n++})}}
 document.getElementById('count').textContent=about.regions+' regions, '+n+' shapes in view, level '+z}
const at=e=>{const r=svg.getBoundingClientRect(),s=Math.min(r.width,r.height);return[box[0]+box[2]*(.5+(e.clientX-r.left-r.width/2)/s),box[1]+box[3]*(.5+(e.clientY-r.top-r.height/2)/s)]};
svg.addEventListener('wheel',e=>{e.preventDefault();const f=e.deltaY>0?1.25:.8,[x,y]=at(e);box=[x-(x-box[0])*f,y-(y-box[1])*f,box[2]*f,box[3]*f];later()},{passive:false});
svg.addEventListener('pointerdown',e=>held=at(e));window.addEventListener('pointerup',()=>held=null);
svg.addEventListener('pointermove',e=>{if(!held)return;const[x,y]=at(e);box[0]+=held[0]-x;box[1]+=held[1]-y;later()});
document.getElementById('whole').onclick=()=>{box=[0,0,side,side];later()};
for(const x of Object.keys(colours).sort()){const li=document.createElement('li'),tick=document.createElement('input'),key=document.createElement('span');
 tick.type='checkbox';tick.checked=true;tick.onchange=()=>{tick.checked?hidden.delete(x):hidden.add(x);later()};key.style.background=colours[x];li.append(tick,key,x);document.getElementById('labels').append(li)}
draw();
"""


def page(title: str, figures: dict, folder: str) -> str:
    """The page that loads the tiles in folder, as a browser finds it from the page."""
    about = figures | {"grid": GRID, "steps": STEPS, "cells": CELLS, "folder": folder}
    plain = lambda x: json.dumps(x).replace("<", "\\u003c")
    return f"""<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head>
<body><h1>{escape(title)}</h1><p><button id="whole">whole map</button> <span id="count"></span></p><svg></svg><ul id="labels"></ul>
<script>const about={plain(about)},colours={plain(COLOURS)};{_SCRIPT}</script></body></html>"""


def write_tiles(df: DataFrame, folder: str, region: str | None = None, geometry: str = "geometry") -> dict:
    """Write df's tiles (classification, tau, p_value beside region and geometry) to a folder that all tasks and the driver
    share, at a path that `pyarrow.fs` opens; returns the map's figures and how many files and characters were written."""
    grid, figures = placed(df, region or df.columns[0], geometry)
    rows = staged(features(grid, figures["levels"]), "features")
    wrote = files(rows).mapInPandas(lambda batches: _write(folder, batches), "files bigint, bytes bigint").agg(F.sum("files").alias("files"), F.sum("bytes").alias("chars")).first()
    discard(grid, rows)
    return figures | {"files": wrote["files"] or 0, "chars": wrote["chars"] or 0}


def write_tiled_map(df: DataFrame, path: str, title: str = "Emerging hot spots", region: str | None = None, geometry: str = "geometry") -> dict:
    """A page at path (ending in .html) and its tiles in the folder of that name with .tiles in place of .html."""
    if not path.endswith(".html"):
        raise ValueError("the file must end in .html")
    folder = path[: -len(".html")] + ".tiles"
    figures = write_tiles(df, folder, region, geometry)
    system, target = _opened(path)
    system.create_dir(target.rpartition("/")[0] or "/", recursive=True)
    with system.open_output_stream(target) as out:
        out.write(page(title, figures, folder.rpartition("/")[2]).encode())
    return figures


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all tiles of a folder: level, x, y, kind, r, l, t, g, d, n."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.js")
    made = text.select(F.from_json(F.regexp_extract("value", r"(?s)^tile\((.*)\);\s*$", 1), _TILE).alias("f")).select("f.name", F.explode("f.rows").alias("row"))
    at = F.split("name", r"[/.]")
    return made.select(at[0].cast("int").alias("level"), at[1].cast("int").alias("x"), at[2].cast("int").alias("y"), at[3].alias("kind"), "row.*")
