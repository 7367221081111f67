"""Raster jobs over pixel and cell tables that hold many images: statistics, filters, resampling, gain maps.

Pixels are rows (image_id, y, x, ...).  Windows partition by image and row or column, so an image's work splits
over its rows; per-image numbers are aggregates that come back by join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import (
    P3_TO_2020,
    REC709_TO_P3,
    REC2020_TO_P3,
    WHITE_NITS,
    apply_matrix,
    bt709_to_linear,
    clamp,
    clamp_finite,
    exp2,
    finite,
    hlg_signal,
    known_transfer,
    linear_by_transfer,
    linear_to_pq,
    lit,
    outside_709,
    p3_luminance,
    smoothstep,
    split_multiply32,
    srgb_to_linear,
)

from . import hashes
from .audit import floor_rank
from .tiles import box_kernel, by_tile

EPSILON = 1e-6
SAMPLE_CAP = 200_000
MAX_GRID_EDGE = 3072
GUIDE_EPSILON = 5e-3


def positive(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c) & (c > 0), c).otherwise(lit(0))


def luminance() -> Column:
    return p3_luminance(positive("r"), positive("g"), positive("b"))


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def luminance_samples(pixels: DataFrame) -> DataFrame:
    """(image_id, lum) of every step-th pixel in row order with positive light, the step keeping about 200000 an image."""
    j = pixels.join(image_sizes(pixels), "image_id")
    step = F.greatest(F.lit(1), F.floor(F.col("w") * F.col("h") / SAMPLE_CAP)).cast("long")
    index = F.col("y") * F.col("w") + F.col("x")
    return j.filter(index % step == 0).select("image_id", luminance().alias("lum")).filter("lum > 0")


def scene_statistics(pixels: DataFrame) -> DataFrame:
    """Trimmed log average and high percentiles of each image."""
    s = luminance_samples(pixels)
    q = floor_rank(s, "lum", (0.001, 0.999, 0.995, 0.9999), ["image_id"])
    named = {0.001: "low", 0.999: "high", 0.995: "p995", 0.9999: "p9999"}
    wide = q.groupBy("image_id").agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(n) for p, n in named.items()])
    trimmed = F.greatest(clamp(F.col("lum"), F.col("low"), F.col("high")), lit(EPSILON))
    logs = s.join(wide, "image_id").groupBy("image_id").agg(F.count("*").alias("samples"), F.exp(F.avg(F.log(trimmed))).alias("log_average"))
    return logs.join(wide.select("image_id", "p995", "p9999"), "image_id")


def grid_size(w: Column, h: Column) -> tuple[Column, Column]:
    scale = F.greatest(F.lit(2), F.ceil(w / MAX_GRID_EDGE), F.ceil(h / MAX_GRID_EDGE))
    return F.ceil(w / scale), F.ceil(h / scale)


def cell_of(x: Column, extent: Column, divisions: Column) -> Column:
    """The cell whose edges floor(i * extent / divisions) enclose x."""
    return F.floor(((x + 1) * divisions - 1) / extent)


def cell_means(pixels: DataFrame, value: Column | None = None) -> DataFrame:
    """Mean and peak of each cell of the image's grid; luminance unless a value is given."""
    v = luminance() if value is None else value
    j = pixels.join(image_sizes(pixels), "image_id")
    gw, gh = grid_size(F.col("w"), F.col("h"))
    return j.groupBy("image_id", cell_of(F.col("y"), F.col("h"), gh).alias("gy"), cell_of(F.col("x"), F.col("w"), gw).alias("gx")).agg(
        F.avg(v).alias("cell_mean"), F.max(v).alias("cell_peak")
    )


#: Points at which a gain's distribution is reported, and what counts as nothing beside a ceiling.
GAIN_POINTS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999, 1.0)
EPSILON = 1e-6


def gain_distribution(cells: DataFrame, rule: str, limits: DataFrame | None = None, points: Sequence[float] = GAIN_POINTS) -> DataFrame:
    """By image: shares of stored gain above 0.5, 1 and 2 stops, the clipped share, and floor-rank percentiles.

    cells(image_id, v) in stops.  What counts as clipped follows the renderer that made the map: `photographic` maps never
    clip; `display` ones at limits.ceiling less EPSILON, where there is a ceiling; `external` ones at limits.gain_max, where
    it is above limits.gain_min.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    v = F.col("v")
    if rule == "photographic":
        rows, clipped = cells, F.lit(False)
    elif rule == "display":
        rows = cells.join(limits.select("image_id", "ceiling"), "image_id", "left")
        clipped = (F.col("ceiling") > EPSILON) & (v >= F.col("ceiling") - EPSILON)
    elif rule == "external":
        rows = cells.join(limits.select("image_id", "gain_min", "gain_max"), "image_id", "left")
        clipped = (v >= F.col("gain_max")) & (F.col("gain_max") > F.col("gain_min"))
    else:
        raise ValueError(f"no such rule: {rule}")
    base = rows.groupBy("image_id").agg(
        share(v > 0.5).alias("over_half"), share(v > 1).alias("over_one"), share(v > 2).alias("over_two"), share(clipped).alias("clipped")
    )
    ranked = floor_rank(cells, "v", points, ["image_id"]).groupBy("image_id")
    q = ranked.agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"q{k}") for k, p in enumerate(points)])
    return base.join(q, "image_id")


def wide_gamut(pixels: DataFrame, threshold: float = 0.02) -> DataFrame:
    r, g, b = positive("r"), positive("g"), positive("b")
    lit_px = p3_luminance(r, g, b) >= threshold
    return pixels.groupBy("image_id").agg(F.count_if(lit_px).alias("eligible"), F.count_if(lit_px & outside_709(r, g, b)).alias("wide"))


def light_levels(pixels: DataFrame, nits: float = 203.0, most: int = 10_000) -> DataFrame:
    """MaxCLL, the brightest channel, and MaxFALL, the mean Rec.2020 luminance, in whole nits, rounded up and clamped.

    Channels below zero count as zero.  `most` is the container's limit, 10,000 or 65,535.
    """
    wide = [F.greatest(c, lit(0)) for c in apply_matrix(P3_TO_2020, F.col("r"), F.col("g"), F.col("b"))]
    luma = 0.2627 * wide[0] + 0.6780 * wide[1] + 0.0593 * wide[2]
    level = lambda c: F.least(F.ceil(c * nits), F.lit(most)).cast("long")
    return pixels.groupBy("image_id").agg(level(F.max(F.greatest(*wide))).alias("max_cll"), level(F.avg(luma)).alias("max_fall"))


def histogram(pixels: DataFrame, low: float = 0.0, high: float = 1.0, bins: int = 256) -> DataFrame:
    """(image_id, channel, bin, n) of luma and the three colours over a linear range; values outside count at the ends."""
    channels = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("v")) for n, c in (("luma", luminance()), ("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")))])).alias("e")
    at = clamp(F.floor((F.col("e.v") - low) / (high - low) * (bins - 1) + 0.5), 0.0, float(bins - 1)).cast("int")
    return pixels.select("image_id", channels).groupBy("image_id", F.col("e.channel").alias("channel"), at.alias("bin")).agg(F.count("*").alias("n"))


def clipping(pixels: DataFrame, cold: float = 0.0, hot: float = 1.0) -> DataFrame:
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return pixels.groupBy("image_id").agg(F.avg((top >= hot).cast("double")).alias("hot"), F.avg((low <= cold).cast("double")).alias("cold"))


def box_means(cells: DataFrame, values: dict[str, str], radius: int | Column) -> DataFrame:
    """Means over a square window cut off at the edges, {value: out}, in one exchange however many values there are.

    radius: one for all, or a column with each image's own.  See tiles.py: the radius does not change the cost of a cell.
    """
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    return by_tile(cells, radius, list(values), list(values.values()), box_kernel())


def box_mean(cells: DataFrame, value: str, radius: int | Column, out: str) -> DataFrame:
    """Mean over a square window cut off at the edges."""
    return box_means(cells, {value: out}, radius)


def with_grid_sizes(cells: DataFrame) -> DataFrame:
    """Cells with their grid's size, `grid_w` and `grid_h`."""
    sizes = cells.groupBy("image_id").agg((F.max("gx") + 1).alias("grid_w"), (F.max("gy") + 1).alias("grid_h"))
    return cells.join(sizes, "image_id")


def guide_radius(short: Column) -> Column:
    """The guided filter's radius for a grid's shorter side."""
    return clamp(F.floor(short / 96), F.lit(4), F.lit(8))


def guided_filter(cells: DataFrame, radius: int | Column | None = None) -> DataFrame:
    """Edge-keeping smoothing of gain by guide, never above global_gain: adds `filtered`.

    Without a radius, each image has the one of its own grid.
    """
    if radius is None:
        sized = with_grid_sizes(cells).withColumn("_radius", guide_radius(F.least("grid_w", "grid_h"))).drop("grid_w", "grid_h")
        return guided_filter(sized, F.col("_radius")).drop("_radius")
    x = cells.withColumn("_ii", F.col("guide") * F.col("guide")).withColumn("_ip", F.col("guide") * F.col("gain"))
    x = box_means(x, {"guide": "_mi", "gain": "_mp", "_ii": "_mii", "_ip": "_mip"}, radius)
    variance = F.greatest(lit(0), F.col("_mii") - F.col("_mi") * F.col("_mi"))
    x = x.withColumn("_a", (F.col("_mip") - F.col("_mi") * F.col("_mp")) / (variance + GUIDE_EPSILON))
    x = x.withColumn("_b", F.col("_mp") - F.col("_a") * F.col("_mi"))
    x = box_means(x, {"_a": "_ma", "_b": "_mb"}, radius)
    smooth = clamp(F.col("_ma") * F.col("guide") + F.col("_mb"), lit(0), F.col("global_gain"))
    return x.withColumn("filtered", F.when(F.col("global_gain") <= 0, lit(0)).otherwise(smooth)).drop("_ii", "_ip", "_mi", "_mp", "_mii", "_mip", "_a", "_b", "_ma", "_mb")


def local_contrast(cells: DataFrame, exposure: float = 1.0) -> DataFrame:
    """Mean of the eight neighbours (fewer at edges) and the peak's contrast to it, in stops."""
    row = Window.partitionBy("image_id", "gy").orderBy("gx").rangeBetween(-1, 1)
    column = Window.partitionBy("image_id", "gx").orderBy("gy").rangeBetween(-1, 1)
    x = cells.withColumn("_s", F.sum("cell_mean").over(row)).withColumn("_n", F.count(F.lit(1)).over(row))
    s, n = F.sum("_s").over(column) - F.col("cell_mean"), F.sum("_n").over(column) - 1
    x = x.withColumn("environment", F.coalesce(F.try_divide(s, n), F.col("cell_mean")) * exposure)
    return x.withColumn("contrast", F.log2((F.col("cell_peak") * exposure + EPSILON) / (F.col("environment") + EPSILON))).drop("_s", "_n")


def highlight_candidates(cells: DataFrame, exposure: float = 1.0, iso_confidence: float = 0.7) -> DataFrame:
    """Cells that stand out: (image_id, gy, gx, peak, quality, contrast)."""
    x = local_contrast(cells, exposure).withColumn("peak", F.col("cell_peak") * exposure)
    quality = smoothstep(1.0, 4.0, F.col("peak")) * smoothstep(0.4, 2.5, F.col("contrast")) * iso_confidence
    return x.filter("peak > 1").filter("contrast >= 0.4").withColumn("quality", quality).filter("quality >= 0.05").select("image_id", "gy", "gx", "peak", "quality", "contrast")


def highlight_components(candidates: DataFrame) -> DataFrame:
    """Eight-connected components of the candidates: (image_id, root, cells, peak, quality), root being the first cell."""
    from .corpus import components

    # a node is its cell's key itself, so image ids may be of any type
    place = F.struct("image_id", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"))
    nodes = candidates.withColumn("node", place)
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    near = nodes.select("image_id", F.col("node").alias("a"), "gy", "gx", steps).select("image_id", "a", (F.col("gy") + F.col("s.dy")).alias("gy"), (F.col("gx") + F.col("s.dx")).alias("gx"))
    edges = near.join(nodes.select("image_id", "gy", "gx", F.col("node").alias("b")), ["image_id", "gy", "gx"]).select("a", "b")
    roots = components(nodes.select("node"), edges, "node")
    return nodes.join(roots, "node").groupBy("image_id", "root").agg(F.count("*").alias("cells"), F.max("peak").alias("peak"), F.max("quality").alias("quality"))


def best_highlight(found: DataFrame) -> DataFrame:
    """The brightest component of each image with two cells or more and enough quality, and its merit."""
    merit = clamp(F.col("quality") * (0.6 + 0.4 * smoothstep(1.0, 8.0, F.col("cells").cast("double"))), 0.0, 1.0)
    ok = found.filter("cells >= 2 AND quality >= 0.10").withColumn("merit", merit)
    first = (-F.col("root.gy")).alias("gy"), (-F.col("root.gx")).alias("gx")
    best = ok.groupBy("image_id").agg(F.max(F.struct("peak", *first, "merit")).alias("b"))
    return best.select("image_id", F.col("b.peak").alias("peak"), F.col("b.merit").alias("merit"))


def with_neighbours(grid: DataFrame, values: Sequence[str]) -> DataFrame:
    """Cells with the values of their right, lower and diagonal neighbours (right, lower, corner); null where there is none."""
    row = Window.partitionBy("image_id", "gy").orderBy("gx")
    column = Window.partitionBy("image_id", "gx").orderBy("gy")
    cells = grid.select("image_id", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.struct(*values).alias("here"))
    # the next cell of the table is the neighbour only where none is missing between
    right = cells.withColumn("right", F.when(F.lead("gx").over(row) == F.col("gx") + 1, F.lead("here").over(row)))
    below = F.lead("gy").over(column) == F.col("gy") + 1
    return right.withColumn("lower", F.when(below, F.lead("here").over(column))).withColumn("corner", F.when(below, F.lead("right").over(column)))


def bilinear_values(at: DataFrame, grid: DataFrame, values: Sequence[str], sizes: tuple[Column, Column, Column, Column]) -> DataFrame:
    """The rows of at(image_id, y, x, ..) with the values of a grid read between cells at pixel centres.

    sizes: width and height of grid and image, constants or columns of at.  The neighbours are put beside each cell
    on the grid, the small side, so a pixel meets one row of it.  A pixel that needs a cell that is not there gets null.
    """
    grid_w, grid_h, image_w, image_h = sizes
    place = lambda x, g, n: clamp((x + 0.5) * g / n - 0.5, lit(0), (g - 1).cast("double"))
    x = at.withColumns({"_px": place(F.col("x"), grid_w, image_w), "_py": place(F.col("y"), grid_h, image_h)})
    x = x.withColumns({"_gx": F.floor("_px"), "_gy": F.floor("_py")})
    near = with_neighbours(grid, values).select(F.col("image_id").alias("_i"), F.col("gy").alias("_gy2"), F.col("gx").alias("_gx2"), "here", "right", "lower", "corner")
    j = x.join(near, (F.col("image_id") == F.col("_i")) & (F.col("_gy") == F.col("_gy2")) & (F.col("_gx") == F.col("_gx2")), "left")
    tx, ty = F.col("_px") - F.col("_gx"), F.col("_py") - F.col("_gy")
    def blend(v: str) -> Column:
        # beyond the last cell there is no neighbour, and none is needed
        here, right, lower, corner = (F.col(f"{side}.{v}") for side in ("here", "right", "lower", "corner"))
        top = F.when(tx == 0, here).otherwise(here * (1 - tx) + right * tx)
        low = F.when(tx == 0, lower).otherwise(lower * (1 - tx) + corner * tx)
        return F.when(ty == 0, top).otherwise(top * (1 - ty) + low * ty).alias(v)

    return j.select(*at.columns, *[blend(v) for v in values])


def bilinear_lookup(at: DataFrame, grid: DataFrame, value: str, sizes: tuple[Column, Column, Column, Column]) -> DataFrame:
    """(image_id, y, x, value) of a grid read between cells at pixel centres."""
    return bilinear_values(at.select("image_id", "y", "x"), grid, [value], sizes)


def resample_to(pixels: DataFrame, targets: DataFrame, values: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """(image_id, y, x, values) at each image's target size: targets(image_id, tw, th).

    A side over twice its target is halved by box means until it is not; several halvings are one weighted mean, a
    pixel's weight being the product of 1 / (pixels in its box) of each.  Then cells are read between half-pixel centres.
    """
    sizes = image_sizes(pixels).join(targets, "image_id")

    def halvings(side: str, target: str) -> Column:
        start = F.struct(F.col(side).cast("long").alias("n"), F.lit(0).alias("k"))
        over = lambda s: (s["n"] > 1) & (s["n"] > F.col(target) * 2)
        step = lambda s, _: F.struct(F.when(over(s), F.ceil(s["n"] / 2)).otherwise(s["n"]).alias("n"), (s["k"] + over(s).cast("int")).alias("k"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step)

    def weight(at: str, side: str, k: Column) -> Column:
        def level(w, j):
            extent, node = F.ceil(F.col(side) / F.pow(lit(2), j)), F.floor(F.col(at) / F.pow(lit(2), j + 1))
            return w / F.least(lit(2), extent - 2 * node)

        # most sides are not halved at all, and then nothing is worked out
        return F.when(k == 0, lit(1)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lit(1), level))

    s = sizes.withColumns({"_hx": halvings("w", "tw"), "_hy": halvings("h", "th")})
    j = pixels.join(s, "image_id").withColumn("_weight", weight("x", "w", F.col("_hx.k")) * weight("y", "h", F.col("_hy.k")))
    cell = lambda at, k: F.floor(F.col(at) / F.pow(lit(2), k))
    small = j.groupBy("image_id", cell("y", F.col("_hy.k")).alias("gy"), cell("x", F.col("_hx.k")).alias("gx")).agg(*[F.sum(F.col(v) * F.col("_weight")).alias(v) for v in values])
    spots = s.select("image_id", F.col("_hx.n").alias("_w"), F.col("_hy.n").alias("_h"), "tw", "th", F.explode(F.sequence(F.lit(0), F.col("th").cast("int") - 1)).alias("y"))
    spots = spots.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tw").cast("int") - 1)))
    read = bilinear_values(spots, small, values, (F.col("_w"), F.col("_h"), F.col("tw"), F.col("th")))
    return read.select("image_id", "y", "x", *values)


def reorient(pixels: DataFrame, orientation: Column) -> DataFrame:
    """Pixels at the places that EXIF orientation 1..8 asks for; any other orientation, and none, leaves them."""
    j = pixels.join(image_sizes(pixels), "image_id").withColumn("_o", orientation)
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")
    pick = lambda *v: F.get(F.array(*v), F.when(F.col("_o").between(1, 8), F.col("_o") - 1).otherwise(0).cast("int"))
    nx = pick(x, w - 1 - x, w - 1 - x, x, y, h - 1 - y, h - 1 - y, y)
    ny = pick(y, y, h - 1 - y, h - 1 - y, x, x, w - 1 - x, w - 1 - x)
    return j.select("image_id", ny.alias("y"), nx.alias("x"), *[c for c in pixels.columns if c not in ("image_id", "x", "y")])


def halve(pixels: DataFrame, values: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Half size by the mean of 2 x 2 boxes, fewer at an odd edge."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*[F.avg(v).alias(v) for v in values])


def area_average(pixels: DataFrame, value: str, out_w: int, out_h: int) -> DataFrame:
    """Mean over fractional boxes: each pixel shares itself out among the cells that it overlaps."""
    j = pixels.join(image_sizes(pixels), "image_id")

    def shares(at: str, extent: str, n: int) -> Column:
        low, high = F.col(at) * n / F.col(extent), (F.col(at) + 1) * n / F.col(extent)
        first = F.floor(low).cast("int")
        last = F.greatest(first, (F.ceil(high) - 1).cast("int"))
        return F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), (F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))).alias("part")))

    x = j.withColumn("_sx", shares("x", "w", out_w)).withColumn("_sy", shares("y", "h", out_h))
    x = x.withColumn("_ex", F.explode("_sx")).withColumn("_ey", F.explode("_sy"))
    share = F.col("_ex.part") * F.col("_ey.part")
    return x.groupBy("image_id", F.col("_ey.k").alias("gy"), F.col("_ex.k").alias("gx")).agg((F.sum(F.col(value) * share) / F.sum(share)).alias("v"))


#: The colours of a 2 x 2 pattern in reading order.
BAYER = {"RGGB": ("R", "Gr", "Gb", "B"), "BGGR": ("B", "Gb", "Gr", "R"), "GRBG": ("Gr", "R", "B", "Gb"), "GBRG": ("Gb", "B", "R", "Gr")}


def bayer_role(pattern: Column, y: Column, x: Column) -> Column:
    """R, Gr, Gb or B of a site; null for an unknown pattern."""
    at = ((y % 2) * 2 + x % 2).cast("int")
    role = F.lit(None).cast("string")
    for name, roles in BAYER.items():
        role = F.when(pattern == name, F.get(F.array(*[F.lit(r) for r in roles]), at)).otherwise(role)
    return role


def rejected_mosaics(mosaic: DataFrame, patterns: DataFrame) -> DataFrame:
    """(image_id, reason) of the mosaics that cannot be packed."""
    j = image_sizes(mosaic).join(patterns, "image_id", "left")
    known = F.coalesce(F.col("pattern").isin(*BAYER), F.lit(False))
    reason = F.when(~known, "unknown pattern").when((F.col("w") % 2 != 0) | (F.col("h") % 2 != 0), "odd size")
    return j.select("image_id", reason.alias("reason")).filter("reason IS NOT NULL")


def bayer_pack(mosaic: DataFrame, patterns: DataFrame) -> DataFrame:
    """Half-size planes R, Gr, Gb and B by each image's pattern(image_id, pattern); see rejected_mosaics() for the rest."""
    good = patterns.join(rejected_mosaics(mosaic, patterns), "image_id", "left_anti")
    m = mosaic.join(good, "image_id").select(
        "image_id", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), bayer_role(F.col("pattern"), F.col("y"), F.col("x")).alias("role"), "v"
    )
    return m.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("role") == r, F.col("v"))).alias(r) for r in ("R", "Gr", "Gb", "B")])


def repair_sites(mosaic: DataFrame, levels: DataFrame) -> DataFrame:
    """Dead and hot sites replaced by the upper median of their four same-colour neighbours, rounded half away from zero.

    mosaic(image_id, y, x, v); levels(image_id, black, white).  A dead site is within two of black and its neighbours'
    median over black + 2 % of white; a hot one has 99.5 % of white and the median is under 80 %.  Two sites along each
    edge stay as they are, and sites with fewer than three neighbours.  Neighbours are read as they were, so one repair does
    not feed another.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    near = []
    for at, w in (("x", row), ("y", column)):
        for step, f in ((-2, F.lag), (2, F.lead)):
            # the next sites of the table are two away only where none is missing between
            near.append(F.coalesce(*[F.when(f(at, k).over(w) == F.col(at) + step, f("v", k).over(w)) for k in (1, 2)]))
    x = mosaic.withColumn("_near", F.array_sort(F.array_compact(F.array(*near))))
    bounds = image_sizes(mosaic).join(levels.select("image_id", F.col("black").alias("_black"), F.col("white").alias("_white")), "image_id")
    x = x.join(bounds.select("image_id", F.col("w").alias("_w"), F.col("h").alias("_h"), "_black", "_white"), "image_id", "left")
    inner = (F.col("x") >= 2) & (F.col("y") >= 2) & (F.col("x") < F.col("_w") - 2) & (F.col("y") < F.col("_h") - 2)
    x = x.withColumn("_m", F.when(inner & (F.size("_near") >= 3), F.element_at("_near", (F.floor(F.size("_near") / 2) + 1).cast("int"))))
    dead = (F.col("v") <= F.col("_black") + 2) & (F.col("_m") > F.col("_black") + F.col("_white") * 0.02)
    hot = (F.col("v") >= F.col("_white") * 0.995) & (F.col("_m") < F.col("_white") * 0.8)
    bad = F.coalesce(dead | hot, F.lit(False))
    return x.withColumn("repaired", bad).withColumn("v", F.when(bad, round_away(F.col("_m"))).otherwise(F.col("v"))).drop("_near", "_m", "_w", "_h", "_black", "_white")


def once(v: Column, f) -> Column:
    """f(v) with v worked out once, however often f uses it."""
    return F.transform(F.array(v), f)[0]


def hash32(v: Column) -> Column:
    """A 32-bit integer hash on BIGINT, with multiplications in halves."""
    v = once(v, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))
    v = once(v, lambda x: split_multiply32(x, 0x7FEB352D))
    v = once(v, lambda x: x.bitwiseXOR(F.shiftright(x, 15)))
    v = once(v, lambda x: split_multiply32(x, 0x846CA68B))
    return once(v, lambda x: x.bitwiseXOR(F.shiftright(x, 16)))


def dither01(x: Column, y: Column, channel: int, salt: int) -> Column:
    """Uniform in [0, 1) from a position."""
    fixed = (channel * 0xC2B2AE3D & 0xFFFFFFFF) ^ (salt * 0x27D4EB2F & 0xFFFFFFFF)
    seed = split_multiply32(x.cast("long"), 0x9E3779B1).bitwiseXOR(split_multiply32(y.cast("long"), 0x85EBCA77)).bitwiseXOR(F.lit(fixed))
    return F.shiftright(hash32(seed), 8) / lit(16777216)


def round_away(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def quantize_dithered(v: Column, x: Column, y: Column, most: int = 255, channel: int = 0) -> Column:
    """Integer code with triangular dither; 0, 1 and the first code stay where they are."""
    noise = dither01(x, y, channel, 0) + dither01(x, y, channel, 1) - 1.0

    def coded(s: Column) -> Column:
        plain = round_away(s["code"] * most)
        dithered = clamp(once(s["code"] * most + s["noise"], round_away), 0.0, float(most))
        return F.when(s["code"] <= 0, lit(0)).when(s["code"] >= 1, lit(most)).when(plain <= 1, plain).otherwise(dithered).cast("int")

    return once(F.struct(clamp_finite(v, 0.0, 1.0, 0.0).alias("code"), noise.alias("noise")), coded)


GAMMAS = (0.40, 0.50, 0.60, 0.75, 0.90, 1.00, 1.20, 1.50, 2.00)


def choose_gamma(cells: DataFrame) -> DataFrame:
    """The gamma with the least weighted 8-bit round-trip error of each image; 1.0 unless another is over 1 % better.

    v: normalised gain.  At most 65536 cells an image count, evenly spread over its cells in order.
    """
    w = Window.partitionBy("image_id")
    x = cells.withColumn("_k", F.row_number().over(w.orderBy("gy", "gx")) - 1).withColumn("_n", F.count("*").over(w))
    m = F.least(F.col("_n"), F.lit(65536))
    slot = F.floor(F.col("_k") * m / F.col("_n"))
    centre = F.floor((2 * slot + 1) * F.col("_n") / (2 * m))
    nearby = F.floor((2 * (slot + 1) + 1) * F.col("_n") / (2 * m))
    x = x.filter((F.col("_n") <= 65536) | (F.col("_k") == centre) | (F.col("_k") == nearby))
    q = clamp_finite(F.col("v"), 0.0, 1.0, 0.0)
    weight = 1.0 + 0.15 / (q + 0.05)

    def error(g: float) -> Column:
        back = F.pow(round_away(F.pow(q, lit(g)) * 255) / 255, lit(1 / g))
        return F.sum(weight * (back - q) * (back - q))

    sums = x.groupBy("image_id").agg(*[error(g).alias(f"e{k}") for k, g in enumerate(GAMMAS)])
    best = F.array_min(F.array(*[F.struct(F.col(f"e{k}").alias("e"), F.lit(k).alias("k"), lit(g).alias("g")) for k, g in enumerate(GAMMAS)]))
    s = sums.select("image_id", best.alias("b"), F.col(f"e{GAMMAS.index(1.0)}").alias("unity"))
    return s.select("image_id", F.when(F.col("unity") <= F.col("b.e") * 1.01 + 1e-12, lit(1)).otherwise(F.col("b.g")).alias("gamma"))


def tone_parameters(contrast: float = 1.0, toe_end: float = 0.02, toe_ratio: float = 0.8, shoulder_start: float = 0.5) -> dict[str, float]:
    toe_out = toe_ratio * contrast * toe_end
    return {"contrast": contrast, "toe_end": toe_end, "toe_out": toe_out, "shoulder_out": shoulder_start, "shoulder_in": toe_end + (shoulder_start - toe_out) / contrast}


def tone_curve(v: Column, peak: Column | float, p: dict[str, float]) -> Column:
    """Cubic toe, straight middle, exponential shoulder towards the peak."""
    peak = peak if isinstance(peak, Column) else lit(peak)
    c, t, o = p["contrast"], p["toe_end"], p["toe_out"]
    a, b = (3 * o - c * t) / t**2, (c * t - 2 * o) / t**3
    room = peak - p["shoulder_out"]
    shoulder = peak - room * F.exp(F.greatest(-c * (v - p["shoulder_in"]) / room, lit(-80)))
    return (
        F.when(v.isNull() | F.isnan(v) | (v <= 0), lit(0)).when(v == float("inf"), peak)
        .when(v <= t, F.greatest(lit(0), a * v * v + b * v * v * v)).when(v <= p["shoulder_in"], o + c * (v - t)).otherwise(shoulder)
    )


def inverse_tone(target: Column, p: dict[str, float], steps: int = 64, top: float = 1e4) -> Column:
    """Scene light that the SDR curve sends to the target, by bisection."""
    start = F.struct(lit(0).alias("low"), lit(top).alias("high"))

    def halve_interval(s, _):
        mid = (s["low"] + s["high"]) / 2
        below = tone_curve(mid, 1.0, p) < target
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve_interval)
    return F.when(target <= 0, lit(0)).otherwise((found["low"] + found["high"]) / 2)


def tone_table(spark, samples: int, curve: dict[str, float], headroom_stops: float) -> DataFrame:
    """(k, sdr, scene, gain_stops) of the sampled curve: each SDR level, the scene light behind it, and its gain at the headroom."""
    if not 2 <= samples <= 4096:
        raise ValueError("2 to 4096 samples")
    peak = 2.0 ** max(0.0, headroom_stops)
    t = spark.range(samples).select(F.col("id").alias("k"), (F.col("id") / (samples - 1)).alias("sdr"))
    t = t.withColumn("scene", inverse_tone(F.least("sdr", lit(0.9995)), curve))
    if peak <= max(curve["shoulder_out"] + EPSILON, 1.0):
        return t.withColumn("gain_stops", lit(0))
    base = F.greatest(tone_curve(F.col("scene"), 1.0, curve), lit(EPSILON))
    gain = F.greatest(lit(0), F.log2(F.greatest(tone_curve(F.col("scene"), peak, curve), base) / base))
    return t.withColumn("gain_stops", F.when(F.col("sdr") <= 0, lit(0)).otherwise(gain))


def _light(c: str, code: str, weight: Column, m: dict[str, float]) -> Column:
    gain = m["min"] + (m["max"] - m["min"]) * F.pow(clamp_finite(F.col(code), 0.0, 1.0, 0.0), lit(1 / max(m["gamma"], 1e-6)))
    return (F.col(c) + m["base_offset"]) * exp2(gain * weight) - m["alternate_offset"]


def reconstruct(
    pixels: DataFrame, codes: DataFrame, headrooms: Sequence[float], metadata: dict[str, float] | Sequence[dict[str, float]],
    sizes: tuple[Column, Column, Column, Column], channels: Sequence[str] = ("code",),
) -> DataFrame:
    """HDR planes at display headrooms: (.., headroom, hdr_r, hdr_g, hdr_b, clamped), with the input's columns.

    Codes are read between cells once, then decoded at each headroom; negative results are clamped and counted.
    channels: one column of codes for all colours, or three with a metadata each.
    """
    each = [metadata] * 3 if isinstance(metadata, dict) else list(metadata)
    names = list(channels) * (3 if len(channels) == 1 else 1)
    m = each[0]
    span = m["alternate"] - m["base"]
    at = bilinear_values(pixels, codes, channels, sizes).withColumn("headroom", F.explode(F.array(*[lit(h) for h in headrooms])))
    weight = clamp((F.col("headroom") - m["base"]) / span, 0.0, 1.0) if abs(span) >= 1e-8 else lit(0)
    raw = {f"hdr_{c}": _light(c, code, weight, k) for c, code, k in zip("rgb", names, each, strict=True)}
    x = at.withColumns(raw)
    clamped = sum(((F.col(v) < 0).cast("int") for v in raw), F.lit(0))
    return x.select(*pixels.columns, "headroom", *[F.greatest(lit(0), F.col(v)).alias(v) for v in raw], clamped.alias("clamped"))


def reconstruction_error(rebuilt: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Per headroom: pixels, pixels with a clamped value, clamped values, and mean, mean squared and greatest error against the reference columns."""
    x = rebuilt.select("headroom", "clamped", F.posexplode(F.array(*[F.abs(F.col(f"hdr_{c}") - F.col(r)) for c, r in zip("rgb", reference, strict=True)])).alias("k", "e"))
    first = F.col("k") == 0
    return x.groupBy("headroom").agg(
        F.count_if(first).alias("pixels"), F.count_if(first & (F.col("clamped") > 0)).alias("clamped_pixels"), F.sum(F.when(first, F.col("clamped")).otherwise(0)).alias("clamped_values"),
        F.avg("e").alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.max("e").alias("worst"),
    )


def to_linear_p3(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """Linear Display P3 of encoded pixels by each image's codes: colours(image_id, primaries, transfer); adds error.

    Unstated codes (0, 2) count as sRGB and Rec. 709; any other unknown code, and none, is an error row without colour.
    """
    j = pixels.join(colours, "image_id", "left")
    light = [linear_by_transfer(F.col("transfer"), F.col(c)) for c in "rgb"]
    j = j.withColumns({f"_{c}": v for c, v in zip("rgb", light, strict=True)})
    wide, narrow = apply_matrix(REC2020_TO_P3, *(F.col(f"_{c}") for c in "rgb")), apply_matrix(REC709_TO_P3, *(F.col(f"_{c}") for c in "rgb"))
    p = F.col("primaries")
    out = {
        c: F.when(p == 12, F.greatest(lit(0), F.col(f"_{c}"))).when(p == 9, F.greatest(lit(0), w)).when(p.isin(0, 1, 2), F.greatest(lit(0), n))
        for c, w, n in zip("rgb", wide, narrow, strict=True)
    }
    error = F.when(~F.coalesce(known_transfer(F.col("transfer")), F.lit(False)), "unknown transfer").when(~F.coalesce(p.isin(0, 1, 2, 9, 12), F.lit(False)), "unknown primaries")
    kept = [c for c in pixels.columns if c not in "rgb"]
    return j.select(*kept, *[F.when(error.isNull(), v).alias(c) for c, v in out.items()], error.alias("error"))


def decode_gain(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds log2_gain and reason to cells(image_id, .., code in 0..1) by metadata(image_id, form, headroom, gain_min, gain_max, gamma).

    form: iso (stored range and gamma), legacy (Rec. 709 curve, headroom 1 to 32), v1 (sRGB curve, headroom over 1).
    """
    j = cells.join(metadata, "image_id", "left")
    code, head = clamp(F.col("code"), 0.0, 1.0), F.col("headroom")
    iso = F.col("gain_min") + (F.col("gain_max") - F.col("gain_min")) * F.pow(code, 1.0 / F.col("gamma"))
    reason = (
        F.when(F.col("form").isNull() | ~F.col("form").isin("iso", "legacy", "v1"), "unknown form")
        .when((F.col("form") == "legacy") & ~F.coalesce(head.between(1, 32), F.lit(False)), "headroom out of range")
        .when((F.col("form") == "v1") & ~F.coalesce(finite(head) & (head > 1), F.lit(False)), "headroom out of range")
        .when((F.col("form") == "iso") & ~F.coalesce((F.col("gamma") > 0) & (F.col("gain_max") >= F.col("gain_min")), F.lit(False)), "metadata")
    )
    by_head = lambda light: F.log2(1 + (head - 1) * light)
    value = F.when(F.col("form") == "iso", iso).when(F.col("form") == "legacy", by_head(bt709_to_linear(code))).otherwise(by_head(srgb_to_linear(code)))
    return j.select(*cells.columns, F.when(reason.isNull(), value).alias("log2_gain"), reason.alias("reason"))


def gain_mask(hdr: Column, base: Column, stops: float, offset: float = 1 / 64) -> Column:
    """How much gain lies between two planes, as a share of a range of stops."""
    return clamp(F.log2((hdr + offset) / (base + offset)) / stops, 0.0, 1.0)


def bt2100_codes(pixels: DataFrame, transfer: str = "pq", bits: int = 10) -> DataFrame:
    """Dithered code planes in Rec. 2020 of light relative to diffuse white (203 nits), by PQ or by HLG for a 1000-nit display."""
    encode = {"pq": lambda v: linear_to_pq(clamp(v * WHITE_NITS, 0.0, 10_000.0)), "hlg": hlg_signal}[transfer]
    planes = apply_matrix(P3_TO_2020, F.col("r"), F.col("g"), F.col("b"))
    most = (1 << bits) - 1
    return pixels.select("image_id", "y", "x", *[quantize_dithered(encode(F.greatest(v, lit(0))), F.col("x"), F.col("y"), most, k).alias(n) for k, (n, v) in enumerate(zip("rgb", planes, strict=True))])


def area_hashes(pixels: DataFrame, value: str = "luma") -> DataFrame:
    """(image_id, phash, dhash): 64-bit hashes of a grey image.

    phash: area mean to 32 x 32, the 8 x 8 lowest DCT frequencies, each at least the median of the 63 that are not
    constant; dhash: area mean to 9 x 8, each right neighbour at least its left one.  Bits go from the top.
    """
    return hashes.area_hashes(pixels, image_sizes(pixels), value)
