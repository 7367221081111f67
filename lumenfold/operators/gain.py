"""Gain-map jobs over many images: exposure, headroom, photographic and display-referred rendering, external grids.

Images are keyed rows; per-image choices are one-row-per-image tables that come back to cells and pixels by join.
Radii depend on the image's size, so images are handled in groups of one radius; there are at most a few dozen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.session import ensure_checkpoint_dir
from lumenfold.functions.expr import clamp, clamp_finite, exp2, finite, lit, p3_luminance, smoothstep

from . import raster as R
from .audit import floor_rank

EPS = 1e-6


@dataclass(frozen=True)
class Look:
    """Defaults of the rendering look."""

    contrast: float = 1.08
    vibrance: float = 0.12
    headroom_max: float = 4.0
    pop: float = 0.0
    toe_end: float = 0.08
    toe_ratio: float = 2 / 3
    shoulder_start: float = 0.48
    positive_limit: float = 1.5
    diffuse_floor: float = 0.35

    @property
    def curve(self) -> dict[str, float]:
        return R.tone_parameters(self.contrast, self.toe_end, self.toe_ratio, self.shoulder_start)


def ev100(iso: Column, seconds: Column, aperture: Column) -> Column:
    """Exposure value at ISO 100; null unless all three are positive numbers."""
    ok = sum(((finite(c) & (c > 0)).cast("int") for c in (iso, seconds, aperture)), F.lit(0)) == 3
    return F.when(ok, F.log2(aperture * aperture / seconds) - F.log2(iso / 100.0))


def middle_grey(ev: Column) -> Column:
    return F.when(ev.isNull(), lit(0.18)).otherwise(0.10 + 0.08 * smoothstep(5.0, 10.0, ev))


def highlight_limit(p995: Column, peak: Column, curve: dict[str, float]) -> Column:
    """The exposure that puts the bright end at 95 % of the peak; no limit where the curve has no shoulder there."""
    target = peak * 0.95
    room = peak - curve["shoulder_out"]
    scene = curve["shoulder_in"] - room / curve["contrast"] * F.log((peak - target) / room)
    usable = (p995 > 0) & (peak > curve["shoulder_out"] + EPS) & (target > curve["shoulder_out"]) & (scene > 0)
    return F.when(usable, F.log2(scene / p995)).otherwise(lit(float("inf")))


def content_headroom(stats: DataFrame, bright: DataFrame, exposure: Column, iso: Column, look: Look) -> DataFrame:
    """(image_id, content_stops) from percentiles and the share of pixels over diffuse white.

    stats: image_id, p9999 and the columns that exposure and iso use; bright: image_id, bright_fraction.
    """
    high = F.col("p9999") * exposure
    merit = smoothstep(1.0, 4.0, high)
    area = F.least(lit(1), (0.6 + 0.2 * look.pop) + 0.4 * smoothstep(0.0, 0.02, F.col("bright_fraction")))
    noise = F.when(finite(iso) & (iso > 0), 1 - 0.6 * smoothstep(800.0, 25600.0, iso)).otherwise(lit(0.9))
    stops = clamp((F.log2(high) + 0.2 + 0.25 * look.pop) * merit * area * noise, 0.0, look.headroom_max)
    return stats.join(bright, "image_id").select("image_id", F.when(high > 1, stops).otherwise(lit(0)).alias("content_stops"))


def choose_headroom(content: DataFrame, local: DataFrame, look: Look) -> DataFrame:
    """(image_id, headroom): the greater of the percentiles' and the best local highlight's evidence."""
    j = content.join(local, "image_id", "left")
    spot = (F.log2("peak") + 0.2 + 0.25 * look.pop) * F.col("merit")
    use = (F.col("peak") > 1) & (F.col("merit") > 0)
    best = clamp(F.greatest("content_stops", spot), 0.0, look.headroom_max)
    return j.select("image_id", F.when(F.coalesce(use, F.lit(False)), best).otherwise(F.col("content_stops")).alias("headroom"))


def choose_exposure(stats: DataFrame, headroom: Column, ev: Column, look: Look, bias: float = 0.0) -> DataFrame:
    """(image_id, exposure_ev) from the log average, the highlight limit and the low-light cap."""
    base = clamp_finite(F.log2(middle_grey(ev) / F.greatest(F.col("log_average"), lit(EPS))), -6.0, 6.0, 0.0)
    limited = F.least(base, highlight_limit(F.col("p995"), exp2(headroom), look.curve))
    dim = F.when(ev < 8, F.least(limited, lit(look.positive_limit))).otherwise(limited)
    return stats.select("image_id", clamp_finite(clamp_finite(dim, -6.0, 6.0, 0.0) + bias, -10.0, 10.0, 0.0).alias("exposure_ev"))


def bright_fraction(pixels: DataFrame, exposure: Column) -> DataFrame:
    s = R.luminance_samples(pixels)
    return s.groupBy("image_id").agg(F.avg((F.col("lum") * exposure > 1).cast("double")).alias("bright_fraction"))


def analyse(pixels: DataFrame, capture: DataFrame, look: Look = Look(), bias: float = 0.0) -> DataFrame:
    """(image_id, exposure_ev, headroom) of automatic development; capture: image_id, iso, seconds, aperture."""
    ensure_checkpoint_dir(pixels.sparkSession)
    # One row an image, and the cells, are small next to the pixels and used several times.
    stats = R.scene_statistics(pixels).join(capture, "image_id", "left").checkpoint()
    ev = ev100(F.col("iso"), F.col("seconds"), F.col("aperture"))
    cells = R.cell_means(pixels).checkpoint()
    provisional = stats.withColumn("_ev", clamp_finite(F.log2(middle_grey(ev) / F.greatest(F.col("log_average"), lit(EPS))), -6.0, 6.0, 0.0))

    def headroom_at(images: DataFrame, exposure: str) -> DataFrame:
        scaled = pixels.join(images.select("image_id", exp2(F.col(exposure)).alias("_x")), "image_id")
        lit_px = scaled.select("image_id", "y", "x", *[(F.col(c) * F.col("_x")).alias(c) for c in ("r", "g", "b")])
        bright = bright_fraction(lit_px, lit(1))
        content = content_headroom(images, bright, exp2(F.col(exposure)), F.col("iso"), look)
        shone = cells.join(images.select("image_id", exp2(F.col(exposure)).alias("_x")), "image_id")
        shone = shone.select("image_id", "gy", "gx", (F.col("cell_mean") * F.col("_x")).alias("cell_mean"), (F.col("cell_peak") * F.col("_x")).alias("cell_peak"))
        local = R.best_highlight(R.highlight_components(R.highlight_candidates(shone).checkpoint()))
        return choose_headroom(content, local, look)

    first = headroom_at(provisional, "_ev").checkpoint()
    exposed = provisional.join(first, "image_id")
    chosen = choose_exposure(exposed, F.col("headroom"), ev, look, bias)
    final = stats.join(chosen, "image_id").checkpoint()
    return final.select("image_id", "exposure_ev").join(headroom_at(final, "exposure_ev"), "image_id")


def photographic_gain(pixels: DataFrame, images: DataFrame, look: Look = Look(), strength: float = 1.0) -> DataFrame:
    """Gain cells of scene-referred images of any sizes: (image_id, gy, gx, sdr, gain, code, gain_max, gamma, local).

    images: image_id, exposure_ev, headroom, iso.  The filters' radii follow each image's own grid (see radii_of).
    """
    curve = look.curve
    environment, guide = F.col("_environment"), F.col("_guide")
    floor = min(1.0, max(0.0, look.diffuse_floor + 0.2 * look.pop))
    ensure_checkpoint_dir(pixels.sparkSession)
    # one row an image: its development and its grid's size
    gw, gh = R.grid_size(F.col("w"), F.col("h"))
    sized = R.image_sizes(pixels).select("image_id", gw.alias("grid_w"), gh.alias("grid_h")).join(images, "image_id")
    x = R.cell_means(pixels).join(sized, "image_id")
    for name, radius in zip(("_environment", "_guide"), radii_of(F.col("grid_w"), F.col("grid_h")), strict=True):
        x = x.withColumn(name, radius)
    x = x.withColumn("scene", F.col("cell_mean") * exp2(F.col("exposure_ev")))
    x = x.withColumn("sdr", R.tone_curve(F.col("scene"), 1.0, curve)).withColumn("_hdr", R.tone_curve(F.col("scene"), exp2(F.col("headroom")), curve))
    raised = F.greatest(lit(0), F.log2((F.col("_hdr") + EPS) / (F.col("sdr") + EPS)))
    x = x.withColumn("global_gain", F.when(F.col("scene") <= curve["shoulder_in"], lit(0)).otherwise(raised))
    x = x.withColumn("_log", F.log2(F.col("scene") + EPS)).withColumn("_log2", F.col("_log") * F.col("_log"))
    x = R.box_means(x, {"_log": "_near", "_log2": "_near2", "sdr": "local"}, environment)
    contrast = F.log2((F.col("scene") + EPS) / (exp2(F.col("_near")) + EPS))
    absolute = smoothstep(0.7, 1.5, F.col("sdr") * exp2(F.col("global_gain")))
    weight = floor + (1 - floor) * smoothstep(1.0, 2.5, contrast) * absolute
    iso = F.when(finite(F.col("iso")) & (F.col("iso") > 0), smoothstep(800.0, 25600.0, F.col("iso"))).otherwise(lit(0.35))
    noise = iso * (1 - smoothstep(0.03, 0.2, F.col("sdr"))) * smoothstep(0.005, 0.07, F.greatest(lit(0), F.col("_near2") - F.col("_near") * F.col("_near")))
    x = x.withColumn("gain", clamp(weight * (1 - noise), 0.0, 1.0) * F.col("global_gain"))
    x = R.guided_filter(x.select("image_id", "gy", "gx", "sdr", F.col("sdr").alias("guide"), "gain", "global_gain", "headroom", "local", "_guide"), guide)
    support = smoothstep(curve["shoulder_out"] * 0.45, curve["shoulder_out"] * 1.05, F.col("sdr"))
    x = x.select("image_id", "gy", "gx", "sdr", (F.greatest(lit(0), F.col("filtered")) * support).alias("gain"), (F.col("headroom") * min(strength, 1.0)).alias("_target"), "local")
    # each choice below reads the cells again, and the filters before must not run again for it
    x = x.checkpoint()

    # the field's own peak becomes the headroom, so its shape stays
    def scaled(gain: str) -> Column:
        return F.when(F.col("_target") <= EPS, lit(0)).when(F.col("_peak") > EPS, F.col(gain) * F.col("_target") / F.col("_peak")).otherwise(F.col(gain))

    # scaling keeps the order of gains, so the greatest one is the scaled peak
    peaks = x.groupBy("image_id").agg(F.max("gain").alias("_peak"), F.max("_target").alias("_target"))
    peaks = peaks.select("image_id", "_peak", (F.round(scaled("_peak") * 1e6) / 1e6).alias("gain_max"))
    x = x.join(peaks, "image_id").withColumn("gain", scaled("gain"))
    x = x.withColumn("v", F.when(F.col("gain_max") > EPS, clamp(F.col("gain") / F.col("gain_max"), 0.0, 1.0)).otherwise(lit(0)))
    x = x.join(R.choose_gamma(x.select("image_id", "gy", "gx", "v")), "image_id")
    x = x.withColumn("code", R.quantize_dithered(F.pow("v", F.col("gamma")), F.col("gx"), F.col("gy")) / 255.0)
    return x.select("image_id", "gy", "gx", "sdr", "gain", "code", "gain_max", "gamma", "local")


def radii_of(grid_w: Column, grid_h: Column) -> tuple[Column, Column]:
    """Environment and guide radius for a grid size."""
    short = F.least(grid_w, grid_h)
    return clamp(F.floor(short * 3 / 100), F.lit(4), F.lit(64)), R.guide_radius(short)


def render_base(pixels: DataFrame, images: DataFrame, cells: DataFrame, look: Look = Look(), strength: float = 1.0) -> DataFrame:
    """Full-size SDR base of scene-referred images of any sizes with clarity, common chroma and gamut limit; hdr and sdr luminance."""
    curve = look.curve
    # one row an image: its sizes, its development, and what its cells agree on
    meta = cells.groupBy("image_id").agg(
        F.max("gain_max").alias("gain_max"), F.max("gamma").alias("gamma"), (F.max("gx") + 1).alias("_gw"), (F.max("gy") + 1).alias("_gh")
    ).join(R.image_sizes(pixels), "image_id").join(images, "image_id")
    at = pixels.join(meta, "image_id")
    x = R.bilinear_values(at, cells, ["local", "code"], (F.col("_gw"), F.col("_gh"), F.col("w"), F.col("h"))).drop("_gw", "_gh", "w", "h")
    for c in ("r", "g", "b"):
        x = x.withColumn(c, R.positive(c) * exp2(F.col("exposure_ev")))
    x = x.withColumn("scene", p3_luminance(F.col("r"), F.col("g"), F.col("b"))).withColumn("_t", R.tone_curve(F.col("scene"), 1.0, curve))
    detail = clamp(F.log2((F.col("_t") + EPS) / (F.col("local") + EPS)), -1.5, 1.5)
    mask = smoothstep(0.025, 0.16, F.col("_t")) * (1 - 0.65 * smoothstep(0.78, 1.0, F.col("_t")))
    amount = 0.08 + 0.06 * look.pop
    x = x.withColumn("sdr", clamp(F.col("_t") * exp2(detail * amount * mask), 0.0, 1.0))
    x = x.withColumn("hdr", F.col("sdr") * exp2(F.col("gain_max") * F.pow(clamp(F.col("code"), 0.0, 1.0), 1.0 / F.col("gamma"))))
    x = x.withColumn("_peak", exp2(F.col("headroom") * min(strength, 1.0)))
    return _common_chroma(x, look).select("image_id", "y", "x", "r", "g", "b", "sdr", "hdr", "scene")


def _common_chroma(x: DataFrame, look: Look) -> DataFrame:
    y = F.col("scene")
    chroma = [F.col(c) - y for c in ("r", "g", "b")]
    saturation = F.greatest(*[F.abs(c) for c in chroma]) / F.greatest(y, lit(EPS))
    vivid = 1 + look.vibrance * (1 - smoothstep(0.15, 1.0, saturation))
    start = F.greatest(lit(0.72), F.col("_peak") * 0.7)
    t = clamp((F.col("hdr") - start) / (F.col("_peak") - start), 0.0, 1.0)
    white = t * t * (3 - 2 * t) * (0.45 - 0.17 * look.pop)
    x = x.withColumn("_k", vivid * (1 - white)).withColumn("_sr", F.try_divide(F.col("sdr"), y)).withColumn("_hr", F.try_divide(F.col("hdr"), y))
    limits = []
    for c in ("r", "g", "b"):
        v = (F.col(c) - y) * F.col("_k")
        limits.append(
            F.when(v < 0, -y / v).when(v > 0, F.least(
                F.when(F.col("_sr") > EPS, (1 / F.col("_sr") - y) / v).otherwise(lit(1)), F.when(F.col("_hr") > EPS, (F.col("_peak") / F.col("_hr") - y) / v).otherwise(lit(1)),
            )).otherwise(lit(1))
        )
    x = x.withColumn("_a", clamp(F.least(lit(1), *limits), 0.0, 1.0))
    for c in ("r", "g", "b"):
        x = x.withColumn(f"_{c}", y + F.col("_a") * (F.col(c) - y) * F.col("_k"))
    x = x.withColumn("_y", p3_luminance(F.col("_r"), F.col("_g"), F.col("_b")))
    ok = (y > EPS) & (F.col("sdr") > 0) & (F.col("_y") > EPS)
    for c in ("r", "g", "b"):
        x = x.withColumn(c, F.when(ok, clamp(F.col(f"_{c}") * F.try_divide(F.col("sdr"), F.col("_y")), 0.0, 1.0)).otherwise(lit(0)))
    return x


def render_statistics(rendered: DataFrame, images: DataFrame, look: Look = Look()) -> DataFrame:
    """Rendered peak, use of the headroom and the greatest relative difference below the knee, per image."""
    below = F.when(F.col("scene") <= look.curve["shoulder_in"], F.abs(F.col("hdr") - F.col("sdr")) / F.greatest(F.col("sdr"), lit(EPS)))
    g = rendered.groupBy("image_id").agg(F.greatest(lit(1), F.max("hdr")).alias("rendered_peak"), F.coalesce(F.max(below), lit(0)).alias("below_knee_difference"))
    target = exp2(F.col("headroom"))
    use = F.when(target > 1, clamp((F.col("rendered_peak") - 1) / (target - 1), 0.0, 1.0)).otherwise(lit(0))
    return g.join(images.select("image_id", "headroom"), "image_id").select("image_id", "rendered_peak", use.alias("headroom_utilisation"), "below_knee_difference")


def shoulder_log2(u: Column, knee: float, ceiling: Column) -> Column:
    span = ceiling - knee
    return F.when(u <= knee, u).otherwise(ceiling - span * F.exp(F.greatest(-(u - knee) / span, lit(-80))))


def ceiling_for(target: Column, peak: Column, knee: float) -> Column:
    """The shoulder's ceiling that lands the peak on the target: doublings, then halvings."""
    gap = F.aggregate(F.sequence(F.lit(1), F.lit(60)), lit(1.0), lambda g, _: F.when(shoulder_log2(peak, knee, knee + g) < target, g * 2).otherwise(g))
    start = F.struct(lit(knee + 1e-4).alias("low"), (gap + knee).alias("high"))

    def narrow(s, _):
        mid = (s["low"] + s["high"]) / 2
        below = shoulder_log2(peak, knee, mid) < target
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    return R.once(F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, narrow), lambda s: (s["low"] + s["high"]) / 2)


def unit_cube(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Colours above 1 moved towards their own luminance until they fit."""
    peak, y = F.greatest(r, g, b), p3_luminance(r, g, b)
    t = clamp(F.try_divide(1 - y, peak - y), 0.0, 1.0)
    fit = lambda c: F.when(peak <= 1, clamp(c, 0.0, 1.0)).when(y >= 1, lit(1)).otherwise(clamp(y + t * (c - y), 0.0, 1.0))
    return fit(r), fit(g), fit(b)


def display_sdr(pixels: DataFrame, images: DataFrame, look: Look = Look()) -> DataFrame:
    """SDR input: unchanged at unity, rolled off (never turned to gain) where the exposure brightens it."""
    import math

    knee = math.log2(min(0.75, max(0.18, look.shoulder_start)))
    solved = images.select("image_id", exp2(F.col("exposure_ev")).alias("_x"), F.when(F.col("exposure_ev") > 1e-6, ceiling_for(lit(0), F.col("exposure_ev"), knee)).alias("_top"))
    x = pixels.join(solved, "image_id")
    for c in ("r", "g", "b"):
        x = x.withColumn(c, R.positive(c) * F.col("_x"))
    x = x.withColumn("_y", p3_luminance(F.col("r"), F.col("g"), F.col("b")))
    rolled = F.least(lit(1), exp2(shoulder_log2(F.log2(F.greatest(F.col("_y"), lit(1e-12))), knee, F.col("_top"))))
    x = x.withColumn("_k", F.when(F.col("_top").isNotNull() & (F.col("_y") > EPS), rolled / F.greatest(F.col("_y"), lit(1e-12))).otherwise(lit(1)))
    fitted = unit_cube(*[F.col(c) * F.col("_k") for c in ("r", "g", "b")])
    return x.select("image_id", "y", "x", *[v.alias(c) for c, v in zip(("r", "g", "b"), fitted, strict=True)])


def display_hdr(pixels: DataFrame, images: DataFrame, look: Look = Look()) -> tuple[DataFrame, DataFrame]:
    """HDR input split into an SDR base and gain cells.

    images: image_id, available (stops that the input declares), output (stops that the result may hold).
    """
    import math

    level = min(0.75, max(0.18, look.shoulder_start))
    knee = math.log2(level)
    split = F.col("available") > EPS
    solved = images.select(
        "image_id", "available", "output",
        F.when(split, ceiling_for(lit(0), F.col("available"), knee)).alias("_sdr_top"),
        F.when(split & (F.col("output") < F.col("available") - EPS), ceiling_for(F.col("output"), F.col("available"), knee)).alias("_hdr_top"),
    )
    x = pixels.join(solved, "image_id").withColumn("_y", R.luminance())
    log = F.log2(F.greatest(F.col("_y"), lit(1e-12)))
    x = x.withColumn("sdr", F.when(F.col("_sdr_top").isNull(), F.least(lit(1), F.col("_y"))).otherwise(F.least(lit(1), exp2(shoulder_log2(log, knee, F.col("_sdr_top"))))))
    x = x.withColumn("hdr", F.when(F.col("_hdr_top").isNull(), F.col("_y")).otherwise(exp2(shoulder_log2(log, knee, F.col("_hdr_top")))))
    raised = F.least(F.greatest(lit(0), F.log2((F.col("hdr") + EPS) / (F.col("sdr") + EPS))), F.col("output")) * smoothstep(level * 0.45, level * 1.05, F.col("sdr"))
    x = x.withColumn("gain", F.when((F.col("_y") <= EPS) | (F.col("sdr") <= level), lit(0)).otherwise(raised))
    k = F.when(F.col("_y") > EPS, F.col("sdr") / F.greatest(F.col("_y"), lit(1e-12))).otherwise(lit(1))
    base = x.select("image_id", "y", "x", *[v.alias(c) for c, v in zip(("r", "g", "b"), unit_cube(*[R.positive(c) * k for c in ("r", "g", "b")]), strict=True)])
    return base, R.cell_means(x, F.col("gain")).select("image_id", "gy", "gx", F.col("cell_mean").alias("gain"))


def external_gain(cells: DataFrame, metadata: DataFrame, strength: float = 1.0, limit: float | None = None) -> DataFrame:
    """Stored log2 gain cells re-encoded at a strength and a headroom cap: (image_id, gy, gx, stops, code).

    metadata: image_id, gain_min, gain_max, gamma.
    """
    top = F.col("gain_max") * strength if limit is None else F.least(F.col("gain_max") * strength, lit(limit))
    x = cells.join(metadata, "image_id").withColumn("_top", top).withColumn("_low", F.least(F.col("gain_min") * strength, top))
    stops = clamp(F.col("v") * strength, F.col("_low"), F.col("_top"))
    span = F.col("_top") - F.col("_low")
    code = F.when(F.abs(span) < 1e-8, lit(0)).otherwise(F.pow(clamp(F.try_divide(stops - F.col("_low"), span), 0.0, 1.0), F.greatest(F.col("gamma"), lit(EPS))))
    return x.select("image_id", "gy", "gx", stops.alias("stops"), code.alias("code"))


def lift_grid(codes: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, gy, gx, code): code grids coarser than the renderer's own for an image raised to it; finer ones stay.

    images: image_id, w, h.  Stored codes are resampled, as a decoder reads them, and not log gains.
    """
    have = codes.groupBy("image_id").agg((F.max("gx") + 1).alias("_gw"), (F.max("gy") + 1).alias("_gh"))
    gw, gh = R.grid_size(F.col("w"), F.col("h"))
    target = have.join(images, "image_id").select("image_id", F.greatest(gw, F.col("_gw")).alias("tw"), F.greatest(gh, F.col("_gh")).alias("th"))
    lifted = R.resample_to(codes.select("image_id", F.col("gy").alias("y"), F.col("gx").alias("x"), "code"), target, ["code"])
    return lifted.select("image_id", F.col("y").alias("gy"), F.col("x").alias("gx"), "code")


def route(images: DataFrame) -> DataFrame:
    """Adds renderer by input domain; an unknown domain is an error row."""
    return images.withColumn(
        "renderer", F.when(F.col("domain") == "display_sdr", "sdr_split").when(F.col("domain") == "display_hdr", "hdr_split").when(F.col("domain") == "scene", "photographic")
    ).withColumn("error", F.when(F.col("renderer").isNull(), "unknown domain"))


def render_all(pixels: DataFrame, images: DataFrame, look: Look = Look()) -> tuple[DataFrame, DataFrame]:
    """Every image by the renderer of its domain: (base pixels, gain cells), each with `renderer`; unknown domains give no rows.

    images: image_id, domain, exposure_ev, headroom (stops to render for), available (stops that an HDR input declares),
    iso.  Images may be of any sizes, side by side.
    """
    routed = route(images)
    of = lambda name: routed.filter(F.col("renderer") == name)
    mine = lambda name: pixels.join(of(name).select("image_id"), "image_id", "left_semi")
    sdr = display_sdr(mine("sdr_split"), of("sdr_split").select("image_id", "exposure_ev"), look)
    hdr_base, hdr_gain = display_hdr(mine("hdr_split"), of("hdr_split").select("image_id", "available", F.col("headroom").alias("output")), look)
    scenes = of("photographic").select("image_id", "exposure_ev", "headroom", "iso")
    ensure_checkpoint_dir(pixels.sparkSession)
    cells = photographic_gain(mine("photographic"), scenes, look).checkpoint()  # read twice; small next to the pixels
    scene_base = render_base(mine("photographic"), scenes.drop("iso"), cells, look)
    plane = lambda df, name: df.select("image_id", "y", "x", "r", "g", "b", F.lit(name).alias("renderer"))
    gains = lambda df, name: df.select("image_id", "gy", "gx", "gain", F.lit(name).alias("renderer"))
    flat = R.cell_means(sdr, lit(0)).withColumn("gain", lit(0))
    base = plane(sdr, "sdr_split").unionByName(plane(hdr_base, "hdr_split")).unionByName(plane(scene_base, "photographic"))
    return base, gains(flat, "sdr_split").unionByName(gains(hdr_gain, "hdr_split")).unionByName(gains(cells, "photographic"))


def linearise(mosaic: DataFrame, lut: DataFrame, white: float | Column) -> DataFrame:
    """Sensor values through a look-up table, linear between its samples; lut(k, v) holds a fixed few thousand rows."""
    white = white if isinstance(white, Column) else lit(white)
    last = lut.agg(F.max("k").alias("last"))
    x = mosaic.crossJoin(F.broadcast(last)).withColumn("_p", clamp(F.col("v") / white, 0.0, 1.0) * F.col("last"))
    x = x.withColumn("_k", F.floor("_p")).withColumn("_k1", F.least(F.col("_k") + 1, F.col("last")))
    a = F.broadcast(lut.select(F.col("k").cast("long").alias("_k"), F.col("v").alias("_a")))
    b = F.broadcast(lut.select(F.col("k").cast("long").alias("_k1"), F.col("v").alias("_b")))
    x = x.join(a, "_k").join(b, "_k1")
    part = F.col("_p") - F.col("_k")
    return x.withColumn("v", F.col("_a") * (1 - part) + F.col("_b") * part).select(*mosaic.columns)


def shade(mosaic: DataFrame, shading: DataFrame, roles: tuple[int, int, int, int] = (0, 1, 1, 2), pattern: str | None = None) -> DataFrame:
    """Lens shading: a gain by normalised place and colour, read between the map's nodes; shading(channel, y, x, gain).

    The colour of a site follows from roles, or from each row's pattern column where one is named (R 0, greens 1, B 2).
    """
    size = shading.agg((F.max("x") + 1).alias("mw"), (F.max("y") + 1).alias("mh"))
    j = mosaic.join(R.image_sizes(mosaic), "image_id").crossJoin(F.broadcast(size))
    channel = F.element_at(F.array(*[F.lit(r) for r in roles]), ((F.col("y") % 2) * 2 + F.col("x") % 2 + 1).cast("int"))
    if pattern:
        role = R.bayer_role(F.col(pattern), F.col("y"), F.col("x"))
        channel = F.when(role == "R", 0).when(role == "B", 2).when(role.isNotNull(), 1)
    place = lambda at, n, m: F.when(F.col(n) > 1, F.col(at) / (F.col(n) - 1)).otherwise(lit(0)) * (F.col(m) - 1)
    j = j.withColumn("channel", channel).withColumn("_fx", place("x", "w", "mw")).withColumn("_fy", place("y", "h", "mh"))
    j = j.withColumn("_x0", F.floor("_fx")).withColumn("_y0", F.floor("_fy"))
    tx, ty = F.col("_fx") - F.col("_x0"), F.col("_fy") - F.col("_y0")
    # each node of the map, a fixed few thousand rows, with its right, lower and diagonal neighbours; the last ones are their own
    nodes = shading.select("channel", F.col("x").cast("long").alias("_x0"), F.col("y").cast("long").alias("_y0"), F.col("gain").alias("g00"))
    for name, dx, dy in (("g10", 1, 0), ("g01", 0, 1), ("g11", 1, 1)):
        near = shading.select(F.col("channel").alias("_c"), F.col("x").cast("long").alias("_nx"), F.col("y").cast("long").alias("_ny"), F.col("gain").alias(name))
        at = nodes.crossJoin(F.broadcast(size))
        on = (F.col("channel") == F.col("_c")) & (F.least(F.col("_x0") + dx, F.col("mw") - 1) == F.col("_nx")) & (F.least(F.col("_y0") + dy, F.col("mh") - 1) == F.col("_ny"))
        nodes = at.join(F.broadcast(near), on).drop("_c", "_nx", "_ny", "mw", "mh")
    j = j.join(F.broadcast(nodes), ["channel", "_x0", "_y0"])
    blend = (F.col("g00") * (1 - tx) + F.col("g10") * tx) * (1 - ty) + (F.col("g01") * (1 - tx) + F.col("g11") * tx) * ty
    return j.select("image_id", "y", "x", (F.col("v") * blend).alias("v"))


def calibrate(mosaic: DataFrame, lut: DataFrame, shading: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, y, x, v): look-up table, site repair, lens shading, then values over each image's own white level.

    images: image_id, pattern, black, white, digital_gain; images that bayer rules reject give no rows.
    """
    good = images.join(R.rejected_mosaics(mosaic, images.select("image_id", "pattern")), "image_id", "left_anti")
    x = linearise(mosaic.join(good.select("image_id", F.col("white").alias("_white")), "image_id"), lut, F.col("_white"))
    x = R.repair_sites(x.select("image_id", "y", "x", "v"), good.select("image_id", "black", "white")).select("image_id", "y", "x", "v").join(good.select("image_id", "pattern"), "image_id")
    x = shade(x, shading, pattern="pattern").join(good, "image_id")
    v = F.greatest(lit(0), F.col("v") - F.col("black")) / (F.col("white") - F.col("black")) * F.col("digital_gain")
    return x.select("image_id", "y", "x", v.alias("v"))


def weight_summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id").agg(F.avg("gain").alias("mean_gain")).join(floor_rank(cells, "gain", (0.95,), ["image_id"]).select("image_id", F.col("v").alias("p95_gain")), "image_id")
