"""Classes, symbols, bands and scores as column expressions: the first rule that fits decides, nulls fit none."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags, symbols, boxes and bands as the sport's tools use them.
GREEN_USE = ("forest", "grass", "meadow", "farmland", "orchard")
WATER = ("water", "river", "lake", "pond")
PARKS, WOODS = ("park", "garden"), ("forest", "grass", "wood")
CLOSED = ("private", "military", "no")
BUSY_ROADS = ("motorway", "trunk", "primary")
TERRAIN = (
    (101, 103, "contour"), (104, 106, "depression"), (107, 115, "cliff"), (201, 213, "rock"), (301, 303, "water_area"), (304, 308, "water_line"), (401, 403, "open"),
    (406, 406, "forest_slow"), (408, 408, "forest_med"), (410, 412, "forest_dense"), (501, 501, "road"), (502, 503, "track"), (504, 504, "path"), (521, 526, "built"),
)
#: Country, least and greatest latitude, least and greatest longitude, in order of priority.
COUNTRIES = (("CH", 45.8, 47.8, 5.9, 10.5), ("EE", 57.5, 59.7, 21.5, 28.2), ("FI", 59.8, 70.1, 19.1, 31.6), ("ES", 27.0, 43.8, -18.5, 4.3), ("NO", 57.8, 71.2, 4.5, 31.1))
COLOURS = ("blanc", "jaune", "orange", "vert", "bleu", "violet", "rouge", "marron", "noir")
AGES = (10, 12, 14, 16, 18, 20, 21, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80)
SPRINT_EVENTS = ("sprint", "sprinten", "sprintti", "city", "urban", "natt")
SPRINT_COURSES = ("sprint", "sp", "city", "urban", "natt", "night")
#: Words of a layer's file name, as patterns.
LAYERS = {
    "forbidden": "forbid|private|interdit|no[-_ ]pass|outofbounds|impass",
    "water": "water|lake|river|pond|marsh|wet|eau|mare|bassin",
    "cliffs": "cliff|rock|falaise|roc|escarp",
    "vegetation": "forest|wood|veg|bush|green|vegetation|bois|foret|sous[-_ ]bois",
    "roads_tracks": "road|path|track|trail|chemin|route|sentier|piste|voie|ruelle",
}
#: Below the bound, the factor; above the last of them, there is no penalty in the tables.
SLOPES = ((5, 1.0), (10, 0.9), (15, 0.8), (20, 0.7), (25, 0.6), (30, 0.5), (100, 0.4))
HEIGHTS = ((0.5, 1.0), (1.0, 0.95), (2.0, 0.85), (5.0, 0.7), (10.0, 0.5), (100.0, 0.4))
LENGTH_BANDS = ((0.05, 100), (0.10, 90), (0.15, 80), (0.20, 70), (0.30, 60))
CLIMB_BANDS = ((0.10, 100), (0.20, 85), (0.30, 70))


def first(rules: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    out = F.lit(otherwise)
    for test, value in reversed(list(rules)):
        out = F.when(test, value).otherwise(out)
    return out


def _tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def osm_category(tags: Column) -> Column:
    """One of eight classes of a map<string, string> of tags, or null."""
    has = lambda k: _tag(tags, k).isNotNull()
    one = lambda k, values: F.coalesce(_tag(tags, k).isin(*values), F.lit(False))
    return first([
        (has("highway"), "roads"), (has("building"), "buildings"), (one("landuse", GREEN_USE), "green_areas"), (has("landuse"), "landuse"), (one("natural", WATER) | has("water"), "water"),
        (one("leisure", PARKS) | one("natural", WOODS), "green_areas"), (has("amenity"), "amenities"), (has("barrier"), "barriers"), (one("access", CLOSED), "restricted"),
    ])


def osm_geometry(kind: Column, tags: Column) -> Column:
    """Point for nodes; Polygon for ways that are areas, else LineString; null for the rest."""
    return first([(kind == "node", "Point"), ((kind == "way") & F.coalesce(_tag(tags, "area") == "yes", F.lit(False)), "Polygon"), (kind == "way", "LineString")])


def osm_symbol(tags: Column) -> Column:
    """The map symbol of a point feature; 530 where no rule fits."""
    one = lambda k, *values: F.coalesce(_tag(tags, k).isin(*values), F.lit(False))
    return first([
        (one("historic", "monument", "statue", "memorial", "wayside_cross", "wayside_shrine"), 526),
        (one("historic", "ruins"), 523),
        (one("amenity", "shelter") | one("man_made", "tower", "chimney", "water_tower"), 522),
        (one("man_made", "column", "monument", "flagpole") | one("tourism", "artwork") | one("leisure", "sculpture"), 526),
        (one("amenity", "fountain", "drinking_water") | one("leisure", "fountain"), 530),
        (one("amenity", "bench", "waste_basket") | one("leisure", "picnic_table"), 531),
        (one("highway", "steps"), 524),
    ], 530)


def safety_metres(tags: Column) -> Column:
    """Metres to keep from busy roads and closed places; null elsewhere."""
    one = lambda k, values: F.coalesce(_tag(tags, k).isin(*values), F.lit(False))
    return first([(one("highway", BUSY_ROADS), 50), (osm_category(tags) == "restricted", 5)])


def terrain(symbol: Column) -> Column:
    """One of 14 classes; symbols above 10,000 hold three digits more."""
    n = F.when(symbol > 10000, F.floor(symbol / 1000)).otherwise(F.floor(symbol))
    return first([(n.between(a, b), name) for a, b, name in TERRAIN])


def country(lng: Column, lat: Column) -> Column:
    return first([(lat.between(a, b) & lng.between(x, y), c) for c, a, b, x, y in COUNTRIES])


def colour_of(name: Column) -> Column:
    """The first colour word of a name, or null."""
    return F.nullif(F.lower(F.regexp_extract(name, rf"(?i)\b({'|'.join(COLOURS)})\b", 1)), F.lit(""))


def category_of(name: Column) -> Column:
    """The first age class of a name in capitals, else its colour with a capital, else null."""
    age = F.nullif(F.upper(F.regexp_extract(name, rf"(?i)\b((?:H|D|W|M)(?:{'|'.join(map(str, AGES))})[EAB]?)\b", 1)), F.lit(""))
    return F.coalesce(age, F.initcap(colour_of(name)))


def age_and_sex(category: Column) -> tuple[Column, Column]:
    """Age and code (0 men, 1 women, 2 open) of an age class; 21 and 0 where it says nothing."""
    c = F.upper(F.trim(F.coalesce(category, F.lit(""))))
    fits = c.rlike("^[HDWM][0-9]+[EAB]?$")
    mixed = c.isin("OPEN", "MIXTE", *[x.upper() for x in COLOURS])
    age = F.when(fits, F.regexp_extract(c, "^[HDWM]([0-9]+)", 1).try_cast("int")).otherwise(21)
    return age, first([(mixed, 2), (fits & F.substring(c, 1, 1).isin("D", "W"), 1)], 0)


def is_sprint_event(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(SPRINT_EVENTS))


def is_sprint_course(name: Column, metres: Column) -> Column:
    """By a word of the name, or by a length of 5000 m at most; no length is none."""
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(SPRINT_COURSES)) | F.coalesce((metres != 0) & (metres <= 5000), F.lit(False))


def layer_flags(path: Column) -> dict[str, Column]:
    """What a layer's file name says of its theme."""
    base = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), "([^/]*)$", 1))
    return {k: base.rlike(p) for k, p in LAYERS.items()}


def _banded(v: Column, bands: tuple, otherwise: float = 1.0) -> Column:
    return F.when(v >= 0, first([(v < top, float(x)) for top, x in bands], otherwise)).otherwise(otherwise)


def speed_factor(slope: Column, height: Column, on_path: Column, is_open: Column) -> Column:
    """Speed as a part of that on flat open ground; slope in percent, height of vegetation in metres."""
    return _banded(slope, SLOPES) * _banded(height, HEIGHTS) * F.when(on_path, 1.3).otherwise(1.0) * F.when(is_open, 1.0).otherwise(0.8)


def runnability(slope: Column, height: Column, on_path: Column, is_open: Column) -> Column:
    """0 to 1; bonuses don't lift it above 1."""
    return F.least(F.lit(1.0), _banded(slope, SLOPES) * _banded(height, HEIGHTS) * F.when(on_path, 1.2).otherwise(1.0) * F.when(is_open, 1.1).otherwise(1.0))


def target_score(actual: Column, target: Column, bands: tuple, otherwise: int) -> Column:
    """Points for a ratio to a target near 1; 50 without a target."""
    r = actual / F.when(target != 0, target)
    return F.when(r.isNull(), 50).otherwise(first([((r >= 1 - b) & (r <= 1 + b), p) for b, p in bands], otherwise))


def letter(total: Column) -> Column:
    return first([(total >= 90, "A"), (total >= 80, "B"), (total >= 70, "C"), (total >= 60, "D")], "F")


def route_quality(direct: Column, route: Column, on_path: Column) -> Column:
    r = route / F.when(direct != 0, direct)
    return F.when(r.isNull(), "poor").otherwise(first([((r < 1.1) & on_path, "excellent"), (r < 1.3, "good"), (r < 1.5, "fair")], "poor"))


def route_choices(metres: Column, on_path: Column, ground: Column) -> Column:
    """1 to 4: long legs, paths and easy ground each add a choice."""
    more = [metres > 200, on_path, ground.isin("light_forest", "flat_grass")]
    return F.least(F.lit(4), reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in more], F.lit(1)))


def navigation(quality: Column, choices: Column) -> Column:
    return first([((quality == "excellent") & (choices <= 2), "easy"), ((quality == "good") & (choices <= 3), "medium")], "hard")


def epsg(name: Column) -> Column:
    """The code of a coordinate system by its name; null where it says none."""
    c = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    zone = F.coalesce(F.nullif(F.regexp_extract(c, r"zone\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"utm\s*(\d+)", 1), F.lit(""))).try_cast("int")
    plain = F.nullif(F.regexp_extract(c, r"epsg[:\s]*(\d+)", 1), F.lit("")).try_cast("int")
    return first([
        (has("lambert 93", "lambert-93"), 2154), (has("lambert 92", "lambert-92"), 2152), (has("lambert ii"), 27572), (has("lambert") & has("72"), 27572), (has("lambert") & has("84"), 27584),
        (has("wgs84", "4326"), 4326), (has("mercator", "3857"), 3857), (has("utm") & zone.isNotNull(), zone + F.when(has("south"), 32700).otherwise(32600)),
    ], plain)
