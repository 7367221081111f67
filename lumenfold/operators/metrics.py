"""Label and evaluation metrics over prediction and target cells, epochs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.expr import clamp, exp2, finite, lit, safe_rate

from .audit import floor_rank
from .labels import XMP_SOURCE
from .ranking import with_rank
from .selection import FEW, gathered_quantile, largest_group, quantiles


#: Stops of a fixed target scale, the gain of a highlight on it, and what still counts as no gain.
FIXED_STOPS = 3.0
HIGHLIGHT = 1 / 3
NO_GAIN = 1e-6


def grid_stats(cells: DataFrame, by: Sequence[str] = ("image_id",), value: str = "v") -> DataFrame:
    q = quantiles(cells, value, (0.5, 0.95), by)
    mean = cells.groupBy(*by).agg(F.avg(F.when(finite(F.col(value)), F.col(value))).alias("v_mean"))
    return q.join(mean, list(by)).select(*by, "v_min", "v_mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "v_max")


def target_saturation(cells: DataFrame, images: DataFrame) -> DataFrame:
    """By label subset, target mode and split: how many targets lie above their scale, and the mean of the clipped ones.

    cells(image_id, v) in stops; images(image_id, split, headroom_source, max_log2_gain).  The scale is three stops, or
    in mode per_image the image's own declared maximum; images without a positive finite one are not in that mode.
    An image with one cell above its scale is saturated.
    """
    own = F.col("max_log2_gain").cast("double")
    scaled = cells.join(images.select("image_id", own.alias("_own")), "image_id")
    stats = []
    for mode, scale in (("fixed_3stops", lit(FIXED_STOPS)), ("per_image", F.col("_own"))):
        x = F.when(scale > 0, F.col("v") / F.when(scale > 0, scale))
        stats += [F.count_if(x > 1).alias(f"hit_{mode}"), F.sum(clamp(x, 0.0, 1.0)).alias(f"sum_{mode}")]
    per_image = scaled.groupBy("image_id").agg(F.count("*").alias("n"), *stats)
    usable = finite(own) & (own > 0)
    modes = F.array(
        F.struct(F.lit("fixed_3stops").alias("mode"), F.col("hit_fixed_3stops").alias("hit"), F.col("sum_fixed_3stops").alias("sum")),
        F.when(usable, F.struct(F.lit("per_image").alias("mode"), F.col("hit_per_image").alias("hit"), F.col("sum_per_image").alias("sum"))),
    )
    subsets = F.array(F.lit("all"), F.when(F.col("headroom_source") == XMP_SOURCE, F.lit("xmp")))
    rows = images.join(per_image, "image_id", "left").select(
        "split", own.alias("own"), F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.array_compact(subsets)).alias("subset"), F.array_compact(modes).alias("modes")
    ).select("split", "subset", "own", "n", F.explode("modes").alias("m"))
    return rows.groupBy("subset", F.col("m.mode").alias("mode"), "split").agg(
        F.count("*").alias("samples"), F.sum("n").alias("pixels"), F.coalesce(safe_rate(F.sum("m.sum"), F.sum("n")), lit(0)).alias("target_mean"),
        F.count_if(F.col("m.hit") > 0).alias("saturated_samples"), safe_rate(F.count_if(F.col("m.hit") > 0), F.count("*")).alias("saturated_sample_fraction"),
        F.count_if(F.col("own") > FIXED_STOPS).alias("above_3_stops"), safe_rate(F.count_if(F.col("own") > FIXED_STOPS), F.count("*")).alias("above_3_stops_fraction"),
        F.coalesce(F.sum("m.hit"), F.lit(0)).alias("saturated_pixels"), F.coalesce(safe_rate(F.sum("m.hit"), F.sum("n")), lit(0)).alias("saturated_pixel_fraction"),
    )


def baseline_mae(cells: DataFrame, train_mean: DataFrame) -> DataFrame:
    """MAE of the model and of three constants, the spread of per-sample MAE, and the gain over the training mean."""
    j = cells.crossJoin(F.broadcast(train_mean))
    per = j.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("prediction") - F.col("target"))).alias("model"), F.sum(F.abs("target")).alias("zero"),
        F.sum(F.abs(lit(0.5) - F.col("target"))).alias("half"), F.sum(F.abs(F.col("train_mean") - F.col("target"))).alias("mean"),
    )
    rate = lambda c: F.sum(c) / F.sum("n")
    out = per.agg(
        F.sum("n").alias("cells"), rate("model").alias("mae"), rate("zero").alias("mae_zero"), rate("half").alias("mae_half"), rate("mean").alias("mae_mean"),
        F.avg(F.col("model") / F.col("n")).alias("sample_mae"), F.min(F.col("model") / F.col("n")).alias("sample_min"), F.max(F.col("model") / F.col("n")).alias("sample_max"),
    )
    return out.withColumn("improvement", F.try_divide(F.col("mae_mean") - F.col("mae"), F.col("mae_mean")))


def bucketed_errors(cells: DataFrame) -> DataFrame:
    """Errors in stops for all cells, for each source and for three bands of the target (below 1, below 2, and the rest).

    cells(sample_id, source, prediction, target).  Buckets of whole images also have the mean error of their images' mean
    and 95th percentile gain; a band without cells has no error.
    """
    e = F.abs(F.col("prediction") - F.col("target"))
    band = F.when(F.col("target") < 1, 0).when(F.col("target") < 2, 1).otherwise(2)
    in_band = [f(F.when(band == k, e)).alias(f"{name}{k}") for k in range(3) for f, name in ((F.sum, "e"), (F.count, "n"))]
    per = cells.groupBy("sample_id", "source").agg(
        F.sum(e).alias("e"), F.count("*").alias("n"), F.abs(F.avg("prediction") - F.avg("target")).alias("mean_error"), *in_band
    )
    if largest_group(cells, ["sample_id"]) <= FEW:
        # samples of a few cells are gathered beside their sums, so the cells are dealt once
        high = cells.groupBy("sample_id").agg(F.abs(gathered_quantile("prediction", 0.95) - gathered_quantile("target", 0.95)).alias("p95_error"))
    else:
        sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("prediction", "target")])).alias("s")
        top = quantiles(cells.select("sample_id", sides).select("sample_id", "s.*"), "v", (0.95,), ("sample_id", "side"))
        high = top.groupBy("sample_id").agg(
            F.abs(F.sum(F.when(F.col("side") == "prediction", F.col("q")[0])) - F.sum(F.when(F.col("side") == "target", F.col("q")[0]))).alias("p95_error")
        )
    whole = [F.struct(b.alias("bucket"), F.lit(True).alias("whole"), F.col("e").alias("e"), F.col("n").alias("n")) for b in (F.lit("all"), F.col("source"))]
    bands = [
        F.struct(F.lit(b).alias("bucket"), F.lit(False).alias("whole"), F.coalesce(f"e{k}", lit(0)).alias("e"), F.col(f"n{k}").alias("n"))
        for k, b in enumerate(("low_0_to_1_stop", "hdr_1_to_2_stops", "hdr_2_to_3_stops"))
    ]
    rows = per.join(high, "sample_id").select("mean_error", "p95_error", F.explode(F.array(*whole, *bands)).alias("b"))
    return rows.groupBy(F.col("b.bucket").alias("bucket")).agg(
        F.sum("b.n").alias("pixels"), F.try_divide(F.sum("b.e"), F.sum("b.n")).alias("pixel_mae"),
        F.when(F.max("b.whole"), F.count("*")).alias("samples"), F.avg(F.when(F.col("b.whole"), F.col("mean_error"))).alias("image_mean_mae"),
        F.avg(F.when(F.col("b.whole"), F.col("p95_error"))).alias("image_p95_mae"),
    )


def constant_baseline(cells: DataFrame, train_mean: DataFrame) -> DataFrame:
    """MAE of the model and of the training mean, and the share of the latter that the model saves."""
    e = lambda a: F.avg(F.abs(F.col(a) - F.col("target")))
    out = cells.crossJoin(F.broadcast(train_mean)).agg(e("prediction").alias("mae"), e("train_mean").alias("constant_mae"))
    return out.withColumn("improvement", F.try_divide(F.col("constant_mae") - F.col("mae"), F.col("constant_mae")))


def loss_parts(cells: DataFrame, highlight_weight: float = 0.0, fixed: bool = True, beta: float = 0.05) -> DataFrame:
    """The training loss and its parts, each a mean over images of a mean over the image's cells that have the part.

    cells(sample_id, gy, gx, prediction, target).  Reconstruction is smooth L1 weighted by 1 + highlight_weight * target^2;
    gradient is the mean over the axes that have neighbouring cells of the error of their differences; the loss is
    reconstruction + 0.2 gradient + 0.1 error of the image's mean.  With `fixed`, highlight errors are in stops.
    """
    p, t = F.col("prediction"), F.col("target")
    d = F.abs(p - t)
    smooth = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    weight = 1 + lit(highlight_weight) * t * t
    per = cells.groupBy("sample_id").agg(
        (F.sum(smooth * weight) / F.sum(weight)).alias("reconstruction"), F.abs(F.avg(p) - F.avg(t)).alias("global_mean"), F.avg(d).alias("mae"),
        F.avg(F.when(t >= HIGHLIGHT, d)).alias("highlight"), F.avg(F.when(t <= NO_GAIN, (p >= HIGHLIGHT).cast("double"))).alias("false_high"),
    )
    steps = gradient_errors(cells.withColumnRenamed("sample_id", "image_id"))
    axes = F.array_compact(F.array("horizontal", "vertical"))
    gradient = F.when(F.size(axes) > 0, F.aggregate(axes, lit(0), lambda a, b: a + b) / F.size(axes))
    j = per.join(steps.select(F.col("image_id").alias("sample_id"), gradient.alias("gradient")), "sample_id")
    mean = lambda c: F.coalesce(F.avg(c), lit(0))
    out = j.agg(
        F.count("*").alias("images"), *[mean(c).alias(c) for c in ("reconstruction", "gradient", "global_mean", "mae")],
        (mean("highlight") * (FIXED_STOPS if fixed else 1.0)).alias("highlight_mae"), mean("false_high").alias("false_high_rate"),
        F.count("highlight").alias("highlight_images"), F.count("false_high").alias("zero_target_images"),
    )
    return out.withColumn("loss", F.col("reconstruction") + 0.2 * F.col("gradient") + 0.1 * F.col("global_mean"))


def weighted_metrics(rows: DataFrame, metrics: dict[str, str], *by: str) -> DataFrame:
    """sum(value * weight) / sum(weight) for each metric with its own weight column."""
    return rows.groupBy(*by).agg(*[safe_rate(F.sum(F.col(v) * F.col(w)), F.sum(F.when(F.col(v).isNotNull(), F.col(w)))).alias(v) for v, w in metrics.items()])


def ordinal_rank(df: DataFrame, value: str, order: str, by: Sequence[str], name: str) -> DataFrame:
    """1-based rank by value; ties keep the input order.  A group of any size is dealt by ranges."""
    return with_rank(df, list(by), [value, order], name)


def correlations(df: DataFrame, x: str, y: str, order: str, by: Sequence[str]) -> DataFrame:
    """Pearson, and Spearman on ordinal ranks; null with fewer than three rows or a constant side."""
    ranked = ordinal_rank(ordinal_rank(df, x, order, by, "_rx"), y, order, by, "_ry")
    usable = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # corr() itself fails on a constant side where divisions by zero are errors
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(usable, corr(x, y)).alias("pearson"), F.when(usable, corr("_rx", "_ry")).alias("spearman"))


def quartile_residuals(df: DataFrame, field: str, residual: Column, by: Sequence[str]) -> DataFrame:
    """Four half-open buckets between a group's least value, quartiles and greatest, the last one closed.

    Each bucket has its bounds, rows, and the mean and mean size of the residual; empty ones are there with no rows.
    Rows whose field or residual is not finite do not count.
    """
    rows = df.withColumn("_r", residual).filter(finite(F.col(field)) & finite(F.col("_r")))
    found = quantiles(rows, field, (0.25, 0.5, 0.75), by).select(*by, F.concat(F.array("v_min"), F.col("q"), F.array("v_max")).alias("_q"))
    f, q = F.col(field), F.col("_q")
    bucket = F.when(f < q[1], 0).when(f < q[2], 1).when(f < q[3], 2).otherwise(3)
    counted = rows.join(found, list(by)).groupBy(*by, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("_r").alias("mean_residual"), F.avg(F.abs("_r")).alias("mean_abs_residual")
    )
    every = found.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), q[k].alias("low"), q[k + 1].alias("high")) for k in range(4)])).alias("b"))
    return every.select(*by, "b.*").join(counted, [*by, "bucket"], "left").fillna(0, ["n"])


def best_epochs(epochs: DataFrame) -> DataFrame:
    """The epoch with the least MAE of each run; the first of equal ones."""
    best = epochs.groupBy("architecture", "run_dir").agg(F.min(F.struct("mae", "epoch")).alias("b"))
    return best.select("architecture", "run_dir", F.col("b.epoch").alias("best_epoch"), F.col("b.mae").alias("best_mae"))


def architecture_summary(epochs: DataFrame) -> DataFrame:
    return best_epochs(epochs).groupBy("architecture").agg(
        F.count("*").alias("runs"), F.avg("best_mae").alias("mean_mae"), F.coalesce(F.stddev_samp("best_mae"), lit(0)).alias("std_mae"), F.min("best_mae").alias("best_mae")
    )


def round_trip_error(cells: DataFrame, metadata: DataFrame, codes: float = 255.0) -> DataFrame:
    """Worst error of the values through 8-bit gamma codes of the declared range, against half a code's step and 2e-5.

    cells(image_id, v); metadata(image_id, gain_min, gain_max, gamma).
    """
    j = cells.join(metadata, "image_id")
    span = F.col("gain_max") - F.col("gain_min")
    code = F.rint(F.pow(clamp(F.try_divide(F.col("v") - F.col("gain_min"), span), 0.0, 1.0), F.col("gamma")) * codes) / codes
    error = F.abs(F.col("gain_min") + span * F.pow(code, 1 / F.col("gamma")) - F.col("v"))
    out = j.groupBy("image_id").agg(F.max(error).alias("max_error"), (F.max(span) / (2 * codes) + 2e-5).alias("allowed"))
    return out.withColumn("ok", F.col("max_error") <= F.col("allowed") + 1e-7)


def report_summary(files: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long summary of the successful files' metrics: n, min, floor-rank p50 and p95, max, mean."""
    long = files.filter("success").select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("e"))
    long = long.select(*by, "e.metric", "e.x")
    keys = [*by, "metric"]
    base = long.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("x_mean"))
    ranks = floor_rank(long, "x", (0.5, 0.95), keys).groupBy(*keys).agg(F.max(F.when(F.col("p") == 0.5, F.col("v"))).alias("p50"), F.max(F.when(F.col("p") == 0.95, F.col("v"))).alias("p95"))
    return base.join(ranks, keys)


#: Metrics of a run-report summary: name, and where read_reports() has it.
REPORT_METRICS = (
    ("decode_ms", "decode_ms"), ("process_ms", "process_ms"), ("encode_ms", "encode_ms"), ("total_ms", "total_ms"), ("headroom_stops", "render.headroom_stops"),
    ("rendered_peak", "render.rendered_peak"), ("wide_gamut_fraction", "render.wide_gamut_fraction"), ("gain_max_stops", "gain_map.max_stops"),
)


def run_summary(files: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Of the files of run reports (read_reports()): (counts: files_ok and files_err; summary of each metric that occurs).

    A file without success is an error and gives no metrics; stages that a file lacks count as 0 in its total.
    """
    counts = files.groupBy(*by).agg(F.count_if("success").alias("files_ok"), F.count_if(~F.coalesce("success", F.lit(False))).alias("files_err"))
    flat = files.select(*by, "success", *[F.col(where).alias(name) for name, where in REPORT_METRICS])
    return counts, report_summary(flat, [name for name, _ in REPORT_METRICS], by).filter("n > 0")


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean total time of two report sets and their ratio."""
    total = F.avg(F.col("decode_ms") + F.col("process_ms") + F.col("encode_ms"))
    return a.filter("success").agg(total.alias("before")).crossJoin(b.filter("success").agg(total.alias("after"))).withColumn("speedup", F.try_divide("before", "after"))


def group_weighted_mae(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean over capture groups of the mean over the group's images of each image's MAE."""
    image = cells.groupBy("sample_id").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"))
    return image.join(groups, "sample_id").groupBy("group_id").agg(F.avg("mae").alias("mae")).agg(F.count("*").alias("groups"), F.avg("mae").alias("mae"))


def prediction_interval(cells: DataFrame, denominator: int = 1_000_000) -> DataFrame:
    """Each image's range of predictions as outward-rounded rationals, never empty; why an image is refused, if it is."""
    g = cells.groupBy("sample_id").agg(F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    n_low = F.floor(F.col("low") * denominator)
    n_high = F.greatest(F.ceil(F.col("high") * denominator), n_low + 1)
    reason = F.when(F.abs("low") > 64, "range").when(F.abs("high") > 64, "range").when(F.col("high") < 0, "negative")
    return g.select("sample_id", n_low.alias("low_numerator"), n_high.alias("high_numerator"), F.lit(denominator).alias("denominator"), reason.alias("refused"))


def gradient_errors(cells: DataFrame) -> DataFrame:
    """Mean error of horizontal and vertical differences; both neighbours must be there."""
    out = cells
    for name, by, at in (("horizontal", "gy", "gx"), ("vertical", "gx", "gy")):
        w = Window.partitionBy("image_id", by).orderBy(at)
        near = (F.col(at) - F.lag(at).over(w)) == 1
        step = (F.col("prediction") - F.lag("prediction").over(w)) - (F.col("target") - F.lag("target").over(w))
        out = out.withColumn(name, F.when(near, F.abs(step)))
    return out.groupBy("image_id").agg(F.avg("horizontal").alias("horizontal"), F.avg("vertical").alias("vertical"))


def decoded_gain(code: Column, low: Column, high: Column, gamma: Column) -> Column:
    return low + (high - low) * F.pow(clamp(code, 0.0, 1.0), 1.0 / gamma)


def headroom_weight(display: Column, base: Column, alternate: Column) -> Column:
    return F.when(F.abs(alternate - base) < 1e-8, lit(0)).otherwise(clamp((display - base) / (alternate - base), 0.0, 1.0))


def gained(base: Column, log_gain: Column, weight: Column, base_offset: float, alternate_offset: float) -> Column:
    return (base + base_offset) * exp2(log_gain * weight) - alternate_offset
