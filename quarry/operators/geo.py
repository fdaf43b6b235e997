"""Joins of geometry: containers of points and holes, chains of ways."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import geo as g
from .kept import kept
from .ordering import Key, ranked

#: Boxes that are looked at first, and how many times as many are up to the end of each next round.
FIRST, MORE = 64, 4
#: Boxes of a round up to which their cells are sent to all tasks.
SENT = 4096


def smallest_around(probes: DataFrame, boxes: DataFrame, by: list[str], probe: str, box: str, cell: float, holds: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """``by``, ``probe``, ``box`` of the probes (``by``, probe, x, y) that a box (``by``, box, area, x0, y0, x1, y1) holds: the one of least area.

    Boxes are put in the order of area and ``box`` and taken in rounds, the smallest first, each as large as all before it some times over;
    a probe that found one leaves. So a point under many boxes is compared with the smallest of them only, and the pairs stay near the
    number of points. ``holds`` keeps of some pairs those that pass an exact test.
    """
    boxes = ranked(boxes.where("x0 <= x1 and y0 <= y1"), [Key("area"), Key(box)], "_place")
    boxes = kept(boxes.select(*by, box, "_place", "x0", "y0", "x1", "y1"))
    total, low, high = boxes.count(), 0, FIRST
    left, found = kept(probes.where("x is not null and y is not null")), None
    while found is None or low < total:
        some = boxes.where((F.col("_place") > low) & (F.col("_place") <= high))
        best = kept(holds(in_boxes(left, some, by, cell, high - low <= SENT)).groupBy(*by, probe).agg(F.min("_place").alias("_place")))
        found, low, high = best if found is None else found.unionAll(best), high, high * MORE
        if low < total:
            left = kept(left.join(best.select(*by, probe), [*by, probe], "left_anti"))
            if left.isEmpty():
                break
    return found.join(boxes.select("_place", box), "_place").select(*by, probe, box)


def smallest_container(points: DataFrame, boxes: DataFrame, point: str, box: str, cell: float) -> DataFrame:
    """``box`` of each point (x, y): the smallest of the boxes (x0, y0, x1, y1) around it, or null."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = smallest_around(points.select(point, "x", "y"), boxes.select(box, "x0", "y0", "x1", "y1", area.alias("area")), [], point, box, cell)
    return points.select(point).join(best, point, "left").select(point, box)


#: Cells of its grid that a box may span on each axis before it is entered into the next grid, with cells twice as wide.
RING_SPAN = 8


def in_boxes(points: DataFrame, boxes: DataFrame, by: list[str], cell: float, sent: bool = False) -> DataFrame:
    """The rows of ``points`` (``by``, x, y, ...) beside those of ``boxes`` (``by``, x0, y0, x1, y1, ...) that hold them.

    Boxes are entered into the cells they touch of a grid for their size, so one of any size has few rows; points are entered into their
    cell of each grid there is. Both sides should carry numbers and no geometry. ``sent`` boxes are few and go to all tasks.
    """
    ends = points.agg(F.min("x").alias("px0"), F.max("x").alias("px1"), F.min("y").alias("py0"), F.max("y").alias("py1"))
    b = boxes.crossJoin(F.broadcast(ends)).where("x0 <= px1 and x1 >= px0 and y0 <= py1 and y1 >= py0")
    b = b.withColumns({"_west": F.greatest("x0", "px0"), "_east": F.least("x1", "px1"), "_south": F.greatest("y0", "py0"), "_north": F.least("y1", "py1")}).drop("px0", "px1", "py0", "py1")
    wide = F.greatest(F.col("_east") - F.col("_west"), F.col("_north") - F.col("_south")) / (cell * RING_SPAN)
    b = b.withColumn("_w", cell * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(wide, F.lit(1.0))))))
    grid = lambda v: F.floor(F.col(v) / F.col("_w")).cast("long")
    p = points.crossJoin(F.broadcast(b.select("_w").distinct())).withColumns({"_cx": grid("x"), "_cy": grid("y")})
    b = b.withColumn("_cx", F.explode(F.sequence(grid("_west"), grid("_east")))).withColumn("_cy", F.explode(F.sequence(grid("_south"), grid("_north")))).drop("_west", "_east", "_south", "_north")
    return p.join(F.broadcast(b) if sent else b, [*by, "_w", "_cx", "_cy"]).where("x between x0 and x1 and y between y0 and y1").drop("_w", "_cx", "_cy")


def _ring_boxes(rings: DataFrame, by: list[str], ring_id: str) -> DataFrame:
    box = g.bounds(F.col("ring"))
    return rings.select(*by, ring_id, F.abs(g.signed_area(F.col("ring"))).alias("area"), box.alias("_b")).select(*by, ring_id, "area", *[F.col(f"_b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _inside(pairs: DataFrame, rings: DataFrame, by: list[str], ring_id: str) -> DataFrame:
    """The pairs (``by``, ring_id, x, y, ...) that pass the even-odd test; each meets its ring once."""
    pairs = pairs.drop("x0", "y0", "x1", "y1")
    return pairs.join(rings.select(*by, ring_id, "ring"), [*by, ring_id]).where(g.contains(F.col("ring"), F.col("x"), F.col("y"))).drop("ring")


def ring_pairs(probes: DataFrame, rings: DataFrame, by: list[str], ring_id: str, cell: float) -> DataFrame:
    """``probes`` (``by``, x, y, ...) beside ``ring_id`` and ``area`` of each ring (``by``, ring_id, ring) around them.

    Pairs of numbers are found on the grid; each meets its ring once, for the even-odd test.
    """
    return _inside(in_boxes(probes, _ring_boxes(rings, by, ring_id), by, cell), rings, by, ring_id)


def smallest_ring(probes: DataFrame, rings: DataFrame, by: list[str], probe: str, ring_id: str, cell: float) -> DataFrame:
    """``by``, ``probe``, ``ring_id`` of the smallest ring around each probe, of equal ones the first; probes in none are left out."""
    return smallest_around(probes, _ring_boxes(rings, by, ring_id), by, probe, ring_id, cell, lambda pairs: _inside(pairs, rings, by, ring_id))


def holes_to_shells(holes: DataFrame, shells: DataFrame, hole: str, shell: str, cell: float) -> DataFrame:
    """``shell`` of each hole: the smallest ring whose box and even-odd test hold its first position; orphans have null."""
    first = holes.select(hole, F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))
    best = smallest_ring(first, shells.select(shell, "ring"), [], hole, shell, cell)
    return holes.select(hole).join(best, hole, "left").select(hole, shell)


def polygons(rings: DataFrame, record: str, order: str, cell: float, by_depth: bool = False) -> DataFrame:
    """record, place, rings: the polygons of each record, shell first and its holes after it, all in the order of the rings.

    Rings (record, order, ring) are closed; those without area are left out. Clockwise ones are shells, the others holes; a record with
    none clockwise was written the other way round and has shells only. With ``by_depth`` their direction counts for nothing: a ring
    inside an even number of others is a shell, else a hole. A hole belongs to the smallest shell around its first position, of equal
    ones to the first; a hole in none is a polygon of its own, after the others. ``order`` tells the rings of a record apart.
    """
    r = rings.select(F.col(record).alias("_r"), F.col(order).alias("_o"), g.closed(F.col("ring")).alias("ring")).where("ring is not null")
    r = kept(r.withColumn("_a", g.signed_area(F.col("ring"))).where("_a <> 0"))
    first = lambda df, *more: df.select("_r", F.col("_o").alias("_h"), F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"), *more)
    if by_depth:
        around = ring_pairs(first(r), r.select("_r", "_o", "ring"), ["_r"], "_o", cell).where("_h <> _o").groupBy("_r", "_h").agg(F.count("*").alias("_n"))
        r = r.join(around.withColumnRenamed("_h", "_o"), ["_r", "_o"], "left").withColumn("_shell", F.coalesce("_n", F.lit(0)) % 2 == 0)
        r = r.withColumn("_depth", F.coalesce("_n", F.lit(0))).drop("_n")
    else:
        usual = r.groupBy("_r").agg(F.min("_a").alias("_least"))
        r = r.join(usual, "_r").withColumn("_shell", (F.col("_a") < 0) | (F.col("_least") > 0)).withColumn("_depth", F.lit(0)).drop("_least")
    shells, holes = r.where("_shell"), r.where("not _shell")
    best = smallest_ring(first(holes), shells.select("_r", "_o", "ring"), ["_r"], "_h", "_o", cell).select("_r", F.col("_h").alias("_o"), F.col("_o").alias("_in"))
    member = r.join(best, ["_r", "_o"], "left").withColumn("_orphan", ~F.col("_shell") & F.col("_in").isNull()).withColumn("_in", F.coalesce("_in", "_o"))
    out = member.groupBy("_r", "_in").agg(F.bool_or("_orphan").alias("_orphan"), F.array_sort(F.collect_list(F.struct((F.col("_o") != F.col("_in")).alias("hole"), "_o", "ring"))).alias("_all"))
    return out.select(F.col("_r").alias(record), F.struct(F.col("_orphan").alias("orphan"), F.col("_in").alias("shell")).alias("place"), F.col("_all.ring").alias("rings"), F.slice(F.col("_all._o"), 2, 1 << 30).alias("holes"))


def gathered(parts: DataFrame, record: str, place: str, kind: str, shape: str) -> DataFrame:
    """record, kind, parts: one geometry a record. One part stays what it is, parts of one kind become its Multi form, others a collection."""
    g_all = parts.where(F.col(shape).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(kind).alias("kind"), F.col(shape).alias("shape")))).alias("_all"))
    return g_all.select(record, g.multi_kind(F.col("_all.kind")).alias("kind"), F.col("_all.shape").alias("parts"))


def exploded(features: DataFrame, kind: str, parts: str) -> DataFrame:
    """A row per part of a geometry, with the single kind; other columns are repeated. Features without geometry stay, with nulls.

    ``kind`` is null, a single kind with one part, or a Multi form. Parts of a collection have kinds of their own: give those as structs
    (kind, shape), and each row gets its part's.
    """
    own = [F.col(f"`{c}`") for c in features.columns if c not in (kind, parts)]
    mixed = features.schema[parts].dataType.elementType
    rows = features.select(*own, F.col(kind).alias("_k"), F.posexplode_outer(parts).alias("part", "_p"))
    if isinstance(mixed, StructType) and set(mixed.names) == {"kind", "shape"}:
        return rows.select(*own, "part", F.col("_p.kind").alias(kind), F.col("_p.shape").alias(parts))
    return rows.select(*own, "part", F.regexp_replace("_k", "^Multi", "").alias(kind), F.col("_p").alias(parts))


def chained(ways: DataFrame, relation: str, order: str, nodes: str) -> DataFrame:
    """relation, ring (node list): member ways joined end to end into closed rings, reversed as needed; null if one does not close.

    One relation's ways are a group of their own size; the ends are indexed, so a relation takes time in proportion to its nodes.
    """

    def chain(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column(order).to_pylist(), t.column(nodes).to_pylist(), strict=True))
        lines = [line for _, line in rows if line]
        ends: dict[int, set[int]] = {}
        for i, line in enumerate(lines):
            for e in {line[0], line[-1]}:
                ends.setdefault(e, set()).add(i)
        used, rings = [False] * len(lines), []
        for i, line in enumerate(lines):
            if used[i]:
                continue
            used[i], ring = True, list(line)
            while ring[0] != ring[-1]:
                after = min((k for k in ends[ring[-1]] if not used[k]), default=None)
                if after is None:
                    break
                used[after] = True
                more = lines[after] if lines[after][0] == ring[-1] else lines[after][::-1]
                ring += more[1:]
            rings.append(ring if ring[0] == ring[-1] and len(ring) > 3 else None)
        key = t.column(relation)[0].as_py()
        return pa.table({relation: pa.array([key] * len(rings), t.schema.field(relation).type), "ring": pa.array(rings, pa.list_(pa.int64()))})

    kind = ways.schema[relation].dataType.simpleString()
    return ways.groupBy(relation).applyInArrow(chain, f"{relation} {kind}, ring array<bigint>")


def parse_wkt(df: DataFrame, wkt: str) -> DataFrame:
    """kind, wkt (printed again): points, lines, polygons, their Multi forms and collections; an SRID is left out, M is dropped."""
    from ..sources.wkt import parse, text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [parse(x) for x in b.column(b.schema.get_field_index(wkt)).to_pylist()]
            cols = [*b.columns, pa.array([o and o[0] for o in out], pa.string()), pa.array([o and text(o) for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "kind", "text"])

    return df.mapInArrow(read, StructType([*df.schema.fields, StructField("kind", StringType()), StructField("text", StringType())]))


def by_kind(features: DataFrame, kind: str, order: str) -> DataFrame:
    """``layer``: features of one kind go together; those without geometry go with the kind seen first."""
    first = features.where(F.col(kind).isNotNull()).agg(F.min_by(kind, order).alias("_f"))
    return features.crossJoin(F.broadcast(first)).withColumn("layer", F.coalesce(kind, "_f")).drop("_f")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


#: Headers of columns with a place, the more certain ones first, without case and punctuation.
WKT_NAMES = "wktgeo wkt geom geometry thegeom wktgeom wktgeometry geometrywkt shape geometria".split()
LON_NAMES = "longitude lon lng long lons longitud longitudine lond xcoord xcoordinate x easting lonx".split()
LAT_NAMES = "latitude lat lats latitud latitudine latd ycoord ycoordinate y northing laty".split()
HEIGHT_NAMES = "elevation elev altitude alt z height ele".split()


def place_columns(names: list[str]) -> dict[str, str]:
    """Which columns hold places: {"wkt": name}, or {"lon": name, "lat": name} and perhaps "height"; empty if none do."""
    keys = ["".join(c for c in n.lower() if c.isalnum()) for n in names]
    first = lambda wanted: next((names[keys.index(w)] for w in wanted if w in keys), None)
    if (wkt := first(WKT_NAMES)) is not None:
        return {"wkt": wkt}
    lon, lat, height = first(LON_NAMES), first(LAT_NAMES), first(HEIGHT_NAMES)
    if lon is None or lat is None:
        return {}
    return {"lon": lon, "lat": lat} | ({"height": height} if height is not None else {})


def placed_rows(rows: DataFrame) -> DataFrame:
    """Rows of text, as from a CSV file, as features: ``kind``, ``text`` (printed again) and the columns that hold no place.

    Coordinates may have a decimal comma; a row without a place, or with one out of this world, has nulls. Without such columns it is an error.
    """
    found = place_columns(rows.columns)
    if not found:
        raise ValueError(f"no columns with places: {', '.join(rows.columns[:8])}")
    used = [found["wkt"]] if "wkt" in found else [found["lon"], found["lat"]]
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in used]
    if "wkt" in found:
        text = F.trim(F.col(f"`{found['wkt']}`").cast("string"))
        return parse_wkt(rows.select(*rest, F.when(text != "", text).alias("_wkt")), "_wkt").drop("_wkt")
    number = lambda c: g.coordinate(F.col(f"`{found[c]}`").cast("string"))
    x, y = number("lon"), number("lat")
    fine = x.isNotNull() & y.isNotNull() & g.plausible(x, y)
    parts = [g.degrees_text(x), g.degrees_text(y)]
    flat = F.concat(F.lit("POINT ("), F.concat_ws(" ", *parts), F.lit(")"))
    if "height" in found:
        z = number("height")
        flat = F.when(z.isNotNull(), F.concat(F.lit("POINT Z ("), F.concat_ws(" ", *parts, g.degrees_text(z)), F.lit(")"))).otherwise(flat)
    return rows.select(*rest, F.when(fine, "POINT").alias("kind"), F.when(fine, flat).alias("text"))
