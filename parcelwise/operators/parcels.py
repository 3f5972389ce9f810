"""Parcels against polygons: assignment to areas, clipping, cells by largest code, built-up flags, features."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.selectors import any_prefix
from . import lines, planar, recipes, spatial, subdivide
from .lines import along
from .network import kept

RINGS = "array<array<struct<x double, y double>>>"


def assigned(segments: DataFrame, areas: DataFrame, segment: str, area_id: str, weight: str, main: str, side: float) -> DataFrame:
    """(segment, area_id, piece_area, weight, <main>_MAIN): segments cut by coarse areas.

    A segment's weight is shared over its pieces by their area; pieces carry the area's value.
    Segments outside all areas have no piece.
    """
    pieces = spatial.overlay(segments, areas, segment, area_id, side)
    total = pieces.groupBy(segment).agg(F.sum("piece_area").alias("__t"))
    shared = pieces.join(total, segment).join(segments.select(segment, F.col(weight).alias("__w")), segment)
    out = shared.withColumn(weight, F.col("__w") * F.try_divide(F.col("piece_area"), F.col("__t"))).drop("__w", "__t")
    return out.join(areas.select(area_id, F.col(main).alias(f"{main}_MAIN")), area_id)


def clipped(layer: DataFrame, study: DataFrame, key: str, study_id: str, side: float) -> DataFrame:
    """(key, piece_area): what of each polygon lies in the study area's polygons, which don't overlap."""
    return spatial.overlay(layer, study, key, study_id, side).groupBy(key).agg(F.sum("piece_area").alias("piece_area"))


def clipped_points(points: DataFrame, study: DataFrame, key: str, study_id: str, side: float) -> DataFrame:
    """The points in the study area."""
    return points.join(spatial.points_in_polygons(points, study, key, study_id, side).select(key).distinct(), key, "left_semi")


def clipped_polygons(layer: DataFrame, study: DataFrame, key: str, study_id: str, side: float, rings: str = "rings") -> DataFrame:
    """(key, study_id, part, area, rings): the pieces of each polygon in each of the study's, with their shapes.

    Pairs come from bins of bounding boxes; a piece is a face of both polygons' edges, cut where
    they meet. Concave polygons, holes and shared borders are right. Repeated rows count once.
    """

    def boxed(df: DataFrame, k: str, tag: str) -> DataFrame:
        once = df.select(F.col(k).alias(f"{tag}_id"), F.col(rings).alias(tag), F.xxhash64(rings).alias(f"{tag}h")).dropDuplicates([f"{tag}_id", f"{tag}h"])
        c = lambda f, a: f(F.transform(F.flatten(tag), lambda p: p[a]))
        box = once.where(F.size(F.flatten(tag)) > 2).withColumns({f"{tag}{n}{m}": c(f, n) for n in "xy" for m, f in ((0, F.array_min), (1, F.array_max))})
        span = lambda n: F.sequence(F.floor(F.col(f"{tag}{n}0") / side), F.floor(F.col(f"{tag}{n}1") / side))
        return box.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))

    # Boxes alone are binned; the shapes join the pairs that are left.
    a, b = boxed(layer, key, "a"), boxed(study, study_id, "b")
    pairs = a.drop("a").join(b.drop("b"), ["bx", "by"]).where("ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1")
    pairs = pairs.where((F.col("bx") == F.floor(F.greatest("ax0", "bx0") / side)) & (F.col("by") == F.floor(F.greatest("ay0", "by0") / side))).select("a_id", "ah", "b_id", "bh")
    shapes = lambda df, k, tag: df.select(F.col(k).alias(f"{tag}_id"), F.xxhash64(rings).alias(f"{tag}h"), F.col(rings).alias(tag)).dropDuplicates([f"{tag}_id", f"{tag}h"])
    both = pairs.join(shapes(layer, key, "a"), ["a_id", "ah"]).join(shapes(study, study_id, "b"), ["b_id", "bh"]).select("a_id", "b_id", "a", "b")
    kinds = layer.schema[key].dataType.simpleString(), study.schema[study_id].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows, cut_ = [], []
            for k, (x, y) in enumerate(zip(planar.polygons_of(batch.column(2)), planar.polygons_of(batch.column(3)), strict=True)):
                found = sorted(planar.shared(x, y), key=lambda p: p[0].min(0).tolist())
                rows += [(k, n, planar.area_of(p)) for n, p in enumerate(found)]
                cut_ += [planar.points_in(p) for p in found]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array(cut_, planar.SHAPE)], [key, study_id, "part", "area", "rings"])

    return both.mapInArrow(cut, f"{key} {kinds[0]}, {study_id} {kinds[1]}, part int, area double, rings {RINGS}")


def clipped_lines(paths: DataFrame, study: DataFrame, key: str, study_id: str, side: float, pts: str = "pts") -> DataFrame:
    """(key, piece, pts): what of each line (key, pts) lies in the study area's polygons, in order.

    Edges are cut at the polygons' borders, and pieces stay whose middle is inside; pieces that
    follow each other are one line again. Repeated keys are one line only if their rows are equal.
    """
    once = paths.select(F.col(key).alias("line"), F.col(pts).alias("pts")).dropDuplicates(["line"])
    e = planar.rounded(lines.edges(once, "line")).select(F.struct("line", "seq").alias("eid"), "x1", "y1", "x2", "y2")
    border = planar.rounded(spatial.edges_of(study, study_id)).select(F.struct(study_id, "r", "i").alias("fid"), "x1", "y1", "x2", "y2")
    parts = kept(planar.pieces(e, planar.meetings(e, border, side).select("eid", "px", "py")).withColumn("spot", F.struct("eid", "part")))
    middles = parts.select("spot", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    inside = parts.join(spatial.points_in_polygons(middles, study, "spot", study_id, side).select("spot").distinct(), "spot", "left_semi")
    along_line = W.partitionBy("eid.line").orderBy("eid.seq", "part")
    fresh = F.coalesce((F.lag("x2").over(along_line) != F.col("x1")) | (F.lag("y2").over(along_line) != F.col("y1")), F.lit(True))
    runs = inside.withColumn("fresh", fresh.cast("int")).withColumn("piece", F.sum("fresh").over(along_line) - 1)
    step = F.struct("eid.seq", "part", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("q"))
    joined = runs.groupBy(F.col("eid.line").alias(key), "piece").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return joined.select(key, F.col("piece").cast("int").alias("piece"), F.concat(F.transform("s", lambda v: v["p"]), F.array(F.element_at("s", -1)["q"])).alias("pts"))


def clipped_features(features: DataFrame, study: DataFrame, study_id: str, side: float) -> DataFrame:
    """Features (id, kind, tags, geometry of type and parts) cut to the study area's polygons (rings), which don't overlap.

    Points stay or go; lines and polygons are cut, and become multiple where they fall apart. What
    lies outside has no row. Ids are unique within a kind.
    """
    key = F.struct("id", "kind")
    rows = features.select(key.alias("key"), "tags", "geometry.parts")
    pt = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    each = rows.select("key", F.posexplode("parts").alias("n", "part")).withColumn("spot", F.struct("key", "n"))
    kind = F.col("key.kind")
    points = each.where(kind.endswith("Point")).withColumn("p", F.element_at(F.element_at("part", 1), 1)).select("spot", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    at = clipped_points(points, study, "spot", study_id, side).select("spot", F.array(F.array(pt({"x": F.col("x"), "y": F.col("y")}))).alias("part"), F.lit(0).alias("m"))
    paths = each.where(kind.endswith("LineString")).select("spot", F.element_at("part", 1).alias("pts"))
    ways = clipped_lines(paths, study, "spot", study_id, side).select("spot", F.array("pts").alias("part"), F.col("piece").alias("m"))
    areas = each.where(kind.endswith("Polygon")).select("spot", F.col("part").alias("rings"))
    cut = clipped_polygons(areas, study, "spot", study_id, side)
    cut = cut.select("spot", F.col("rings").alias("part"), F.struct(study_id, "part").alias("piece"))
    ring = F.transform("part", lambda r: F.concat(F.transform(r, pt), F.array(pt(F.element_at(r, 1)))))
    number = F.row_number().over(W.partitionBy("spot").orderBy("piece")).cast("int")
    found = at.unionByName(ways).unionByName(cut.select("spot", ring.alias("part"), number.alias("m")))
    whole = found.groupBy("spot.key").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot.n", "m", "part"))), lambda s: s["part"]).alias("parts"))
    single = F.regexp_replace(F.col("key.kind"), "^Multi", "")
    name = F.when((F.size("parts") > 1) | F.col("key.kind").startswith("Multi"), F.concat(F.lit("Multi"), single)).otherwise(single)
    out = whole.join(features.select(key.alias("key"), "tags"), "key")
    return out.select("key.id", name.alias("kind"), "tags", F.struct(name.alias("type"), "parts").alias("geometry"))


def rectangle(x: Column, y: Column, w: Column | float, h: Column | float) -> Column:
    """Rings of a rectangle, counter-clockwise."""
    corner = lambda i, j: F.struct((x + i * w).cast("double").alias("x"), (y + j * h).cast("double").alias("y"))
    return F.array(F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))))


def rasterised(polygons: DataFrame, key: str, code: str, size: float) -> DataFrame:
    """(i, j, code): for each cell of a grid through the origin the code of the largest combined area in it.

    Ties go to the least code; cells that no polygon meets are absent. i grows with y, j with x.
    """
    pts = F.flatten("rings")
    span = lambda a: F.sequence(F.floor(F.array_min(F.transform(pts, lambda p: p[a])) / size), F.floor(F.array_max(F.transform(pts, lambda p: p[a])) / size))
    cells = polygons.select(F.explode(span("x")).alias("j"), "rings").select("j", F.explode(span("y")).alias("i")).distinct()
    boxes = cells.select(F.struct("i", "j").alias("cell"), rectangle(F.col("j") * size, F.col("i") * size, size, size).alias("rings"))
    pieces = spatial.overlay(polygons, boxes, key, "cell", size * 4).join(polygons.select(key, code), key)
    sums = pieces.groupBy("cell", code).agg(F.round(F.sum("piece_area"), 9).alias("a"))
    best = sums.groupBy("cell").agg(F.min(F.struct((-F.col("a")).alias("a"), F.col(code).alias("c"))).alias("b"))
    return best.select("cell.i", "cell.j", F.col("b.c").alias(code))


def _edges_near(points: DataFrame, polygons: DataFrame, key: str, polygon: str, distance: float) -> DataFrame:
    """(key, polygon, d): points (x, y) and the edges of polygons within ``distance``, d metres off.

    Points and edges meet in bins that edges, widened by the distance, lie in.
    """
    side = 4 * distance
    edges = spatial.edges_of(polygons, polygon).drop("r", "i")
    span = lambda a: F.sequence(F.floor((F.least(f"{a}1", f"{a}2") - distance) / side), F.floor((F.greatest(f"{a}1", f"{a}2") + distance) / side))
    binned = edges.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))
    spots = points.select(key, "x", "y", spatial.bin_of(F.col("x"), side).alias("bx"), spatial.bin_of(F.col("y"), side).alias("by"))
    return spots.join(binned, ["bx", "by"]).withColumn("d", along(F.col("x"), F.col("y"))[1]).where(F.col("d") <= distance).select(key, polygon, "d")


def _places(points: DataFrame) -> DataFrame:
    """(place, x, y): each place of the points once; place is the struct of both."""
    return points.select("x", "y").distinct().select(F.struct("x", "y").alias("place"), "x", "y")


def _shapes(polygons: DataFrame, polygon: str) -> DataFrame:
    """(polygon, rings): each shape once, with the least id of its polygons."""
    once = polygons.groupBy(spatial.shape_id("rings").alias("s")).agg(F.min(polygon).alias(polygon), F.any_value("rings").alias("rings"))
    return once.select(F.struct(polygon, "s").alias(polygon), "rings")


def built_up(points: DataFrame, polygons: DataFrame, key: str, polygon: str, distance: float) -> DataFrame:
    """(key, builtup 0/1): points (x, y), as of road pieces, in a polygon or within ``distance`` of its edge.

    Points of one place and polygons of one shape meet once.
    """
    spots, shapes = _places(points), _shapes(polygons, polygon)
    near = _edges_near(spots, shapes, "place", polygon, distance).select("place")
    found = near.union(spatial.points_in_polygons(spots, shapes, "place", polygon, 4 * distance).select("place")).distinct().select("place.x", "place.y")
    hit = points.select(key, "x", "y").join(found, ["x", "y"]).select(key).distinct().withColumn("builtup", F.lit(1))
    return points.select(key).join(hit, key, "left").fillna(0, ["builtup"])


def split_built_up(pieces: DataFrame, polygons: DataFrame, key: str, polygon: str, distance: float) -> DataFrame:
    """(key, bit, x1, y1, x2, y2, builtup): road pieces (key, x1..y2) cut at the border of the polygons' buffer, each bit in or out.

    The places where a piece is ``distance`` away from a polygon's edge are worked out for the edge's
    two sides and ends; between two of them the middle tells. Neighbouring bits of one
    kind are one. Pieces without length have no row.
    """
    side = 4 * distance
    rows = pieces.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).where("x1 != x2 or y1 != y2")
    edges = spatial.edges_of(polygons, polygon).select(*(F.col(c).cast("double").alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")))
    span = lambda p, n, pad: F.sequence(F.floor((F.least(f"{p}{n}1", f"{p}{n}2") - pad) / side), F.floor((F.greatest(f"{p}{n}1", f"{p}{n}2") + pad) / side))
    binned = lambda d, p, pad: d.withColumn("bx", F.explode(span(p, "x", pad))).withColumn("by", F.explode(span(p, "y", pad)))
    met = binned(rows, "", 0.0).join(binned(edges, "e", distance), ["bx", "by"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ux, uy = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    length = F.hypot(ux, uy)
    # Signed distance from the edge's line at the piece's start, and its growth along the piece.
    start, growth = (ux * (F.col("y1") - F.col("ey1")) - uy * (F.col("x1") - F.col("ex1"))), ux * dy - uy * dx
    places = [F.try_divide(s * distance * length - start, growth) for s in (1, -1)]
    for n in ("1", "2"):
        px, py = F.col("x1") - F.col(f"ex{n}"), F.col("y1") - F.col(f"ey{n}")
        a, b, c = dx * dx + dy * dy, dx * px + dy * py, px * px + py * py - distance**2
        root = F.when(b * b - a * c >= 0, F.sqrt(F.greatest(b * b - a * c, F.lit(0.0))))
        places += [(-b + s * root) / a for s in (1, -1)]
    inner = F.filter(F.array_compact(F.array(*places)), lambda t: (t > 1e-9) & (t < 1 - 1e-9))
    at = met.select("key", F.explode(inner).alias("t")).groupBy("key").agg(F.collect_set(F.round("t", 9)).alias("ts"))
    none = F.array().cast("array<double>")
    cut = rows.join(at, "key", "left").withColumn("ts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", none)))))
    bits = cut.select("*", F.posexplode(F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("a"), F.slice("ts", F.lit(2), F.size("ts") - 1).alias("b"))).alias("bit", "s"))
    bits = kept(bits.select("key", "bit", "x1", "y1", "x2", "y2", F.col("s.a").alias("a"), F.col("s.b").alias("b")))
    mid = (F.col("a") + F.col("b")) / 2
    flags = built_up(bits.select(F.struct("key", "bit").alias("spot"), (F.col("x1") + mid * dx).alias("x"), (F.col("y1") + mid * dy).alias("y")), polygons, "spot", polygon, distance)
    told = bits.join(flags.select("spot.key", "spot.bit", "builtup"), ["key", "bit"])
    order = W.partitionBy("key").orderBy("bit")
    runs = told.withColumn("new", F.coalesce(F.lag("builtup").over(order) != F.col("builtup"), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order) - 1)
    whole = runs.groupBy("key", "run", "builtup", "x1", "y1", "x2", "y2").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    on = lambda t, o, d: F.when(F.col(t) == 1, F.col(f"{o}2")).otherwise(F.col(f"{o}1") + F.col(t) * d)
    return whole.select(F.col("key").alias(key), F.col("run").cast("int").alias("bit"), on("a", "x", dx).alias("x1"), on("a", "y", dy).alias("y1"), on("b", "x", dx).alias("x2"), on("b", "y", dy).alias("y2"), "builtup")


def nearest_polygon(points: DataFrame, polygons: DataFrame, key: str, polygon: str, distance: float = 10.0) -> DataFrame:
    """(key, polygon, distance): the nearest polygon within ``distance`` of each point; inside is 0.

    Distances equal to a billionth are ties, which go to the least id; points without one have no row.
    Points of one place and polygons of one shape meet once.
    """
    spots, shapes = _places(points), _shapes(polygons, polygon)
    inside = spatial.points_in_polygons(spots, shapes, "place", polygon, 4 * distance).select("place", polygon, F.lit(0.0).alias("d"))
    near = _edges_near(spots, shapes, "place", polygon, distance).unionByName(inside)
    found = near.groupBy("place").agg(F.min(F.struct(F.round("d", 9).alias("d"), F.col(f"{polygon}.{polygon}").alias("p"))).alias("b"))
    best = points.select(key, "x", "y").join(found.select("place.x", "place.y", "b"), ["x", "y"]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.p").alias(polygon), F.col("b.d").alias("distance"))


def building_proximity(targets: DataFrame, buildings: DataFrame, sd: float, key: str = "id", size: str = "AREA", shape: str = "WAG") -> DataFrame:
    """FFpbsize_* and FFpbwag_* (sum, mean, median) of buildings (px, py) within 5 sd of each target.

    Targets of one place meet the buildings once, and buildings of one place and value are one with their number;
    medians are exact, by values and numbers.
    """
    spots = targets.select("x", "y").distinct()
    out = None
    for n, c in (("size", size), ("wag", shape)):
        some = buildings.select("px", "py", F.col(c).alias("v")).where("v is not null").groupBy("px", "py", "v").agg(F.count(F.lit(1)).alias("n"))
        values = spatial.within_range(spots, some, 5 * sd).groupBy("x", "y", "v").agg(F.sum("n").alias("n"))
        whole = F.sum(F.col("v") * F.col("n"))
        part = values.groupBy("x", "y").agg(whole.alias(f"FFpb{n}_sum"), F.try_divide(whole, F.sum("n")).alias(f"FFpb{n}_mean"), F.percentile("v", 0.5, F.col("n")).alias(f"FFpb{n}_median"))
        out = part if out is None else out.join(part, ["x", "y"], "full")
    return targets.select(key, "x", "y").join(out, ["x", "y"]).drop("x", "y")


def points_of(segments: DataFrame, most_area: float, most_wagner: float, least_area: float | None = None, segment: str = "seg_id") -> DataFrame:
    """(point, x, y, WT_AREA): inner points of the parts of each segment (rings), with the area that each stands for."""
    parts = subdivide.subdivide(segments, segment, "rings", most_area, most_wagner, least_area)
    return parts.select(F.struct(segment, "part").alias("point"), "x", "y", F.col("area").alias("WT_AREA"))


def calculate(segments: DataFrame, layers: dict[str, DataFrame], config: dict, segment: str = "seg_id") -> DataFrame:
    """The feature table of ``segments`` (seg_id, area, rings, x, y): the recipes that ``config`` names, under one id; absent features are 0.

    config: {"side": bin side, and any of
    "points": {"most_area", "most_wagner", "least_area"} (what lies around is measured at inner points of a
    segment's parts and averaged by their area; without it, at the segment's x, y),
    "buildings": {} (layer building: id, AREA, WAG, rings; sums are per area of the segment),
    "building_proximity": {"sd": metres} (building as well, with px, py),
    "landuse": {"codes": [...]} (layer ua: id, code, rings),
    "landuse_proximity": {"codes": [...], "sd", "resolution"} (ua as well),
    "poi": {"groups": {group: [subtype, ...]}} (layer poi: id, subtype, x, y),
    "poi_proximity": {"groups": ..., "sd": metres} (poi as well),
    "transport": {"speeds", "builtup": [code prefixes], "near", "tolerance"} (layers transport: line, class, level, oneway, pts; ua),
    "barrier": {"cell", "radius"} (layer barrier: id, repellence, pts),
    "dem": {"size", "smoothing"} (layer dem: i, j, value, through the origin)}.
    """
    side, parts, around = config["side"], [], []
    pieces = lambda layer: spatial.overlay(segments, layer, segment, "id", side)
    if "buildings" in config:
        found = recipes.buildings(pieces(layers["building"]).join(layers["building"].select("id", "AREA", "WAG"), "id"), segment)
        parts.append(found.join(segments.select(segment, "area"), segment).withColumn("FFcbsize_sum", F.try_divide("FFcbsize_sum", "area")).drop("area"))
    if "landuse" in config:
        parts.append(recipes.land_use(pieces(layers["ua"]).join(layers["ua"].select("id", "code"), "id"), config["landuse"]["codes"], segment))
    if "poi" in config:
        inside = spatial.points_in_polygons(layers["poi"], segments, "id", segment, side)
        parts.append(recipes.poi_use(inside.join(layers["poi"].select("id", "subtype"), "id").join(segments.select(segment, "area"), segment), config["poi"]["groups"], segment))
    near = {"building_proximity", "poi_proximity", "landuse_proximity", "transport", "barrier", "dem"} & config.keys()
    if near:
        points = kept(points_of(segments, **config["points"], segment=segment)) if "points" in config else segments.select(F.struct(segment).alias("point"), "x", "y", F.lit(1.0).alias("WT_AREA"))
        at = points.select("point", "x", "y")
        cell = lambda size: (F.floor(F.col("y") / size), F.floor(F.col("x") / size))
        if "building_proximity" in near:
            around.append(building_proximity(at, layers["building"].select("AREA", "WAG", "px", "py"), config["building_proximity"]["sd"], "point"))
        if "poi_proximity" in near:
            spots = layers["poi"].select("subtype", F.col("x").alias("px"), F.col("y").alias("py"))
            around.append(recipes.poi_proximity(at, spots, config["poi_proximity"]["groups"], config["poi_proximity"]["sd"], "point"))
        if "landuse_proximity" in near:
            c = config["landuse_proximity"]
            cells = kept(rasterised(layers["ua"], "id", "code", c["resolution"]))
            around.append(sampled(at, recipes.neighbourhood_land_use(cells, c["codes"], c["sd"], c["resolution"]), *cell(c["resolution"])))
        if "barrier" in near:
            c = config["barrier"]
            lengths = lines.density(lines.edges(layers["barrier"], "id"), layers["barrier"].select(F.col("id").alias("line"), F.col("repellence").alias("weight")), c["cell"], c["radius"])
            around.append(sampled(at, lengths.withColumnRenamed("value", "FFrepel"), *cell(c["cell"])))
        if "dem" in near:
            c = config["dem"]
            around.append(sampled(at, recipes.terrain(layers["dem"], c["size"], c["smoothing"]), *cell(c["size"])))
        if "transport" in near:
            from . import access

            c = config["transport"]
            built = layers["ua"].where(any_prefix(F.col("code"), c["builtup"])).select("id", "rings")
            roads = kept(access.road_network(layers["transport"], built, c["speeds"], side, c.get("near", 20.0)))
            origins = at.select(F.col("point").alias("id"), "x", "y")
            around.append(access.access(origins, access.representative_targets(origins), roads, c.get("tolerance", 200.0)).withColumnRenamed("id", "point"))
        features = [f for p in around for f in p.columns if f != "point"]
        whole = recipes.widened(points, around, "point").withColumn(segment, F.col(f"point.{segment}"))
        parts.append(recipes.to_segments(whole, features, segment))
    return recipes.widened(segments, parts, segment)


def sampled(points: DataFrame, cells: DataFrame, i: Column, j: Column) -> DataFrame:
    """(point, features): all values of the cell (i, j) that each point lies in; points without one have no row."""
    at = points.select("point", i.alias("i"), j.alias("j"))
    return at.join(cells, ["i", "j"]).drop("i", "j")


def coded(segments: DataFrame, land_use: DataFrame, segment: str, code: str, side: float, inhabited: list[str], least_area: float) -> DataFrame:
    """(segment, area, code): segments over ``least_area`` whose inner point (x, y) lies in land use of an inhabited code prefix.

    Of several such polygons the one of least code counts.
    """
    lived_in = land_use.where(any_prefix(F.col(code), inhabited)) if inhabited else land_use.limit(0)
    within = spatial.points_in_polygons(segments, lived_in, segment, "id", side).join(lived_in.select("id", code), "id")
    return segments.where(F.col("area") > least_area).select(segment, "area").join(within.groupBy(segment).agg(F.min(code).alias(code)), segment)
