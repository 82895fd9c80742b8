"""Colours of map images as rows (patch_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import first

# Colour centres, with the tolerance of each channel, or with the cost of the ground.
CLASSES = {
    "brown_relief": ((180, 120, 60), 30), "green_dense": ((80, 140, 80), 35), "green_light": ((160, 210, 160), 35), "yellow_open": ((255, 240, 130), 40),
    "blue_water": ((80, 150, 220), 40), "black_detail": ((50, 50, 50), 40), "white_forest": ((240, 240, 240), 20),
}
FOREST = (
    ((34, 139, 34), "dense_forest", 0.3), ((50, 205, 50), "light_forest", 0.5), ((144, 238, 144), "clear_forest", 0.7), ((255, 255, 224), "open", 0.9), ((255, 255, 0), "rough_open", 0.8),
    ((0, 0, 255), "water", 0.1), ((173, 216, 230), "stream", 0.3), ((0, 0, 0), "path", 1.0), ((128, 128, 128), "road", 1.0), ((255, 255, 255), "white", 0.9), ((100, 100, 100), "building", 0.1), ((150, 150, 150), "wall", 0.1),
)
SPRINT = (((50, 50, 50), "building", 0.1), ((200, 200, 200), "pavement", 0.9), ((255, 255, 255), "open", 0.9), ((0, 0, 0), "fence", 0.1), ((139, 69, 19), "stair", 0.5))


def _channels() -> list[Column]:
    return [F.col(c) for c in "rgb"]


def colour_class() -> Column:
    """The first class whose centre each channel is nearer to than the tolerance; null if none is."""
    return first([(F.greatest(*[F.abs(x - v) for x, v in zip(_channels(), centre, strict=True)]) < t, name) for name, (centre, t) in CLASSES.items()])


def nearest_colour(palette: tuple = FOREST) -> Column:
    """(name, cost) of the nearest centre; of equals the first of the palette."""
    far = [sum(((x - v) * (x - v) for x, v in zip(_channels(), centre, strict=True)), F.lit(0)) for centre, _, _ in palette]
    best = F.array_min(F.array(*[F.struct(m.alias("m"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(cost).alias("cost")) for k, (m, (_, name, cost)) in enumerate(zip(far, palette, strict=True))]))
    return F.struct(best["name"].alias("name"), best["cost"].alias("cost"))


def class_shares(pixels: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Per patch: the share of each class among all pixels, and among those of the centre (x0 <= x < x1, y0 <= y < y1); a
    patch without pixels there has zeros. One pass: sums are combined before the shuffle."""
    p = pixels.select("patch_id", colour_class().alias("c"), ((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).alias("mid"))
    every = [(F.count_if(F.coalesce(F.col("c") == k, F.lit(False))) / F.count("*")).alias(k) for k in CLASSES]
    middle = [F.coalesce(F.try_divide(F.count_if(F.col("mid") & F.coalesce(F.col("c") == k, F.lit(False))), F.count_if("mid")), F.lit(0.0)).alias(f"mid_{k}") for k in CLASSES]
    return p.groupBy("patch_id").agg(*every, *middle)


def usable(bright: int, dark: int, water: int) -> Column:
    """Whether a pixel is on open map: not margin, border, water or forbidden green."""
    r, g, b = _channels()
    margin, border = F.least(r, g, b) >= bright, F.greatest(r, g, b) <= dark
    wet = (b >= water) & (b > r * 1.5) & (b > g * 1.2)
    closed = (g > r) & (g > b) & g.between(80, 160) & (r < 130) & (b < 100)
    return ~(margin | border | wet | closed)


def empty_patches(pixels: DataFrame, white: int = 230, most: float = 0.92) -> DataFrame:
    """Patches of which more than a share is nearly white."""
    share = F.avg((F.least(*_channels()) > white).cast("int"))
    return pixels.groupBy("patch_id").agg(share.alias("white")).where(F.col("white") > most)


def texture(grey: DataFrame, size: int, edge: float = 20.0) -> DataFrame:
    """Per patch (patch_id, x, y, v; absent pixels are white): edges, the share of pixels whose gradient exceeds a bound; corners, the
    share whose response, from gradients averaged over 5 x 5 with mirrored borders, exceeds a hundredth of the patch's largest;
    entropy of grey levels, 1 at most. Averages are taken along rows, then along columns; a row or column is a window."""
    every = grey.select("patch_id").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    f = every.join(grey, ["patch_id", "x", "y"], "left").select("patch_id", "x", "y", F.coalesce("v", F.lit(255.0)).alias("v"))

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy("patch_id", across).orderBy(along)
        before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    d = f.withColumns({"gx": slope("x", "y"), "gy": slope("y", "x")})
    d = d.withColumns({"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")})

    def box(along: str, across: str, c: str) -> Column:
        """Sum of five values along an axis; beyond a border the values before it count again, from the border inwards."""
        w = Window.partitionBy("patch_id", across).orderBy(along)
        inner = F.sum(c).over(w.rowsBetween(-2, 2))
        at = lambda k: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if k == 0 else F.nth_value(c, k + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        p = F.col(along)
        low = F.when(p == 0, at(0) + at(1)).when(p == 1, at(0)).otherwise(0.0)
        high = F.when(p == size - 1, at(size - 1) + at(size - 2)).when(p == size - 2, at(size - 1)).otherwise(0.0)
        return inner + low + high

    for along, across in (("x", "y"), ("y", "x")):
        d = d.withColumns({c: box(along, across, c) for c in ("xx", "yy", "xy")})
    xx, yy, xy = (F.col(c) / 25 for c in ("xx", "yy", "xy"))
    d = d.withColumn("r", xx * yy - xy * xy - 0.05 * (xx + yy) * (xx + yy))
    top = d.groupBy("patch_id").agg(F.max("r").alias("top"), F.avg((F.hypot("gx", "gy") > edge).cast("int")).alias("edges"))
    corners = d.join(top, "patch_id").groupBy("patch_id", "edges").agg(F.avg(((F.col("top") > 0) & (F.col("r") > F.col("top") * 0.01)).cast("int")).alias("corners"))
    levels = f.groupBy("patch_id", F.floor(F.col("v") + 1e-6).alias("level")).agg((F.count("*") / (size * size)).alias("p"))
    entropy = levels.groupBy("patch_id").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(256.0))).alias("entropy"))
    return corners.join(entropy, "patch_id")


#: Shares of a window that it must cover to count.
COVERED = 0.75


def _moving(df: DataFrame, along: str, across: str, reach: int, names: dict[str, str]) -> DataFrame:
    """df with sums of columns over the blocks from `reach` before to before `reach` after, along an axis; a window's rows are one row of blocks of one image."""
    w = Window.partitionBy("image", across).orderBy(along).rangeBetween(-reach, reach - 1)
    return df.withColumns({new: F.sum(old).over(w) for new, old in names.items()})


def window_features(pixels: DataFrame, step: int, half: int, middle: int, edge: float = 20.0) -> DataFrame:
    """(image, cx, cy, n, every class's share, mid_ and its share in the middle, edges) of the windows of 2 * half pixels about each point of a grid of `step` pixels over
    each image's extent (image, x, y, r, g, b; of pixels at one place the least counts); half and middle are multiples of step. Windows of which less than COVERED is
    there are left out, absent pixels count in no share; edges are the share of pixels whose grey differs from a neighbour's by more than a bound.

    Overlapping windows repeat no pixel: pixels are counted by blocks of the grid, combined before the shuffle, and windows are moving sums of blocks along
    rows, then along columns."""
    one = pixels.groupBy("image", "x", "y").agg(F.min(F.struct("r", "g", "b")).alias("c")).select("image", "x", "y", "c.*")
    one = one.withColumn("v", (F.col("r") + F.col("g") + F.col("b")) / 3)

    def differs(along: str, across: str) -> Column:
        w = Window.partitionBy("image", across).orderBy(along)
        near = lambda f: F.when(F.abs(f(along).over(w) - F.col(along)) == 1, F.abs(f("v").over(w) - F.col("v")) > edge)
        return F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False))

    one = one.withColumn("edge", differs("x", "y") | differs("y", "x")).withColumn("k", colour_class())
    block = lambda c: F.floor(F.col(c) / step).cast("int")
    counts = [F.count("*").alias("n"), F.count_if("edge").alias("edges"), *[F.count_if(F.coalesce(F.col("k") == k, F.lit(False))).alias(k) for k in CLASSES]]
    blocks = one.groupBy("image", block("x").alias("bx"), block("y").alias("by")).agg(*counts)
    names = ["n", "edges", *CLASSES]
    extent = blocks.groupBy("image").agg(*[f(c).alias(f"{n}_{c}") for c in ("bx", "by") for n, f in (("lo", F.min), ("hi", F.max))])
    grid = extent.select("image", F.explode(F.sequence("lo_bx", F.col("hi_bx") + 1)).alias("bx"), "lo_by", "hi_by").select("image", "bx", F.explode(F.sequence("lo_by", F.col("hi_by") + 1)).alias("by"))
    full = grid.join(blocks, ["image", "bx", "by"], "left").fillna(0, names)
    wide, small = half // step, middle // step
    rows = _moving(full, "bx", "by", wide, {f"w_{c}": c for c in names})
    rows = _moving(rows, "bx", "by", small, {f"m_{c}": c for c in names})
    sums = _moving(rows, "by", "bx", wide, {f"w_{c}": f"w_{c}" for c in names})
    sums = _moving(sums, "by", "bx", small, {f"m_{c}": f"m_{c}" for c in names})
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0))
    return sums.where(F.col("w_n") >= COVERED * 4 * half * half).select(
        "image", (F.col("bx") * step).alias("cx"), (F.col("by") * step).alias("cy"), F.col("w_n").alias("n"), *[share(f"w_{k}", "w_n").alias(k) for k in CLASSES],
        *[share(f"m_{k}", "m_n").alias(f"mid_{k}") for k in CLASSES], share("w_edges", "w_n").alias("edges"),
    )


#: What a window's score is learned from.
WINDOW_FEATURES = (*CLASSES, *(f"mid_{k}" for k in CLASSES), "edges")
