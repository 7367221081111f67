"""Readers of manifests, splits, groups, run reports, histories, payload tables and calibration text, all with fixed schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

SAMPLE_SCHEMA = """sample_id string, source_sha256 string, source_bytes long, make string, model string, software string, capture_month string,
 primary_size array<int>, primary_mode string, primary_decode string, primary_bit_depth int, proxy_size array<int>, color_profile string,
 gain_map_present boolean, gain_map_size array<int>, gain_map_mode string, gain_map_version int, sky_matte_present boolean, iso int,
 exposure_seconds double, f_number double, exposure_bias_ev double, focal_length_mm double, primary_metadata_sha256 string,
 focal_length_35mm int, apple_maker_hdr_headroom double, apple_maker_hdr_gain double, gain_map_headroom_xmp double,
 canonical_headroom double, canonical_max_log2_gain double, headroom_source string, per_image_eligible boolean, degenerate_gain_label boolean"""
#: The versions of run reports that are read, and the fields that a report's writer gives each file.
REPORT_VERSIONS = (7, 8)
_LOOK = "struct<exposure_ev: double, ev100: double, target_middle_gray: double>"
_RENDER = """struct<headroom_stops: double, headroom_linear: double, rendered_peak: double, headroom_utilization: double, below_knee_relative_difference_max: double,
 wide_gamut_fraction: double, wide_gamut_pixels: long, wide_gamut_eligible_pixels: long, wide_gamut_luminance_threshold: double>"""
_GAIN_MAP = """struct<gamma: double, min_stops: double, max_stops: double,
 percentiles_stops: struct<p50: double, p75: double, p90: double, p95: double, p99: double, p99_9: double, p99_99: double, max: double>,
 fraction_gt_0_5: double, fraction_gt_1_0: double, fraction_gt_2_0: double, clipped_fraction: double, local_weight_mean: double, local_weight_p95: double>"""
FILE_FIELDS = f"""input: string, output: string, success: boolean, skipped: boolean, self_verified: boolean, message: string,
 sensor_width: int, sensor_height: int, target_width: int, target_height: int, decoded_width: int, decoded_height: int,
 requested_crop_width: int, requested_crop_height: int, delivered_crop_width: int, delivered_crop_height: int,
 target_dimensions_applied: boolean, default_crop_present: boolean, decode_degraded: boolean, input_domain: string, input_headroom: double,
 decode_degradation_reasons: array<string>, width: int, height: int, exposure_ev: double, headroom_stops: double, gain_min: double, gain_max: double,
 decode_ms: double, process_ms: double, encode_ms: double, look: {_LOOK}, render: {_RENDER}, gain_map: {_GAIN_MAP}"""
REPORT_SCHEMA = f"schema int, tool string, settings map<string,string>, raw_processing map<string,string>, files array<struct<{FILE_FIELDS}>>"
HISTORY_SCHEMA = "epoch int, train struct<loss: double, mae: double>, validation struct<loss: double, mae: double>"

#: File extensions of raw and raster images.
RAW_EXTENSIONS = (
    "3fr", "ari", "arw", "bay", "cap", "cr2", "cr3", "crw", "dcr", "dcs", "dng", "erf", "fff", "iiq", "k25",
    "kdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw",
)
#: What the names of own outputs end in, before their extension.
MARKER = "-hdr"
RASTER_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "avif")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of samples with a gain map; a repeated id is an error that names it.  A folder with commits gives its current manifest."""
    commit = versions.latest(spark, path)
    lines = [f"{path}/{p}" for p in commit["tables"]["manifest"]["parts"]] if commit and "manifest" in commit["tables"] else path
    rows = spark.read.schema(SAMPLE_SCHEMA).json(lines).filter("sample_id IS NOT NULL AND gain_map_present")
    twice = rows.groupBy("sample_id").count().filter("count > 1").orderBy("sample_id").limit(1).collect()
    if twice:
        raise ValueError(f"sample id occurs {twice[0]['count']} times: {twice[0]['sample_id']}")
    return rows


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split) of split files; an id in two splits is an error."""
    rows = spark.read.schema("split string, sample_ids array<string>").option("multiLine", True).json(path).select(F.explode("sample_ids").alias("sample_id"), "split")
    twice = rows.groupBy("sample_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"sample id in several splits: {twice[0]['sample_id']}")
    return rows


def read_groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(group_id, split, sample_id) of group files; with lines, each line is a document of its own."""
    schema = "groups array<struct<group_id: string, split: string, size: int, members: array<string>, models: map<string,long>>>"
    groups = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode("groups").alias("g"))
    return groups.select("g.group_id", "g.split", F.explode("g.members").alias("sample_id"))


def _report_documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(report, json, r) of each report file, or of each of its lines: r is null where it is no JSON object."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("json"))
    return raw.withColumn("r", F.from_json("json", REPORT_SCHEMA, {"mode": "PERMISSIVE"}))


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per file of every archived run report, with the report's own path; total_ms is the sum of its stages.

    With lines, each line is a report.  Reports of versions 7 and 8 are read; what cannot be read is a row of report_problems().
    """
    known = _report_documents(spark, path, lines).filter(F.col("r.schema").isin(*REPORT_VERSIONS))
    rows = known.select("report", "r.schema", "r.tool", "r.settings", F.explode("r.files").alias("f")).select("report", "schema", "tool", "settings", "f.*")
    return rows.withColumn("total_ms", sum((F.coalesce(c, F.lit(0.0)) for c in ("decode_ms", "process_ms", "encode_ms")), F.lit(0.0)))


def report_problems(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(report, file, reason, field): reports that are no report, of an unknown version or without files, and unknown fields.

    file is the file's number in the report, null for the report itself; a report with unknown fields is read all the same.
    """
    docs = _report_documents(spark, path, lines)
    known_file = _top_level(FILE_FIELDS)
    names = F.json_object_keys("json")
    problem = lambda reason, field=None: F.struct(F.lit(reason).alias("reason"), (F.lit(None).cast("string") if field is None else field).alias("field"))
    bad = F.when(names.isNull(), problem("not a report")).when(F.col("r.schema").isNull(), problem("no version")).when(
        ~F.col("r.schema").isin(*REPORT_VERSIONS), problem("unknown version", F.col("r.schema").cast("string"))).when(F.col("r.files").isNull(), problem("no files"))
    whole = docs.select("report", F.lit(None).cast("int").alias("file"), bad.alias("p")).filter("p is not null").select("report", "file", "p.*")
    top = [c.split()[0] for c in ("schema int", "tool string", "settings map", "raw_processing map", "files array")]
    extra = docs.select("report", F.lit(None).cast("int").alias("file"), F.lit("unknown field").alias("reason"), F.explode(F.array_except(names, F.array(*map(F.lit, top)))).alias("field"))
    files = docs.select("report", F.posexplode(F.from_json(F.get_json_object("json", "$.files"), "array<string>")).alias("file", "one"))
    inner = files.select("report", "file", F.lit("unknown field").alias("reason"), F.explode(F.array_except(F.json_object_keys("one"), F.array(*map(F.lit, known_file)))).alias("field"))
    return whole.unionByName(extra).unionByName(inner)


def _top_level(fields: str) -> list[str]:
    """The fields of a struct's text, without those inside them."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(fields + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[at:k].strip())
            at = k + 1
    return [f.split(":")[0] for f in out]


def read_histories(spark: SparkSession, root: str) -> DataFrame:
    """Epochs of all runs under a folder with each run's configuration."""
    folder = lambda name: F.regexp_extract("_metadata.file_path", rf"([^/]+)/{name}$", 1)
    epochs = spark.read.schema(HISTORY_SCHEMA).json(f"{root}/*/history.jsonl").select(folder("history.jsonl").alias("run_dir"), "epoch", "train", "validation")
    config = spark.read.schema("architecture string, seed int").option("multiLine", True).json(f"{root}/*/config.json").select(folder("config.json").alias("run_dir"), "architecture", "seed")
    return epochs.join(config, "run_dir", "left")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, corpus, payload) of a tab-separated table with hex payloads."""
    return spark.read.schema("sample_id string, corpus string, hex string").csv(path, sep="\t").select("sample_id", "corpus", F.unhex("hex").alias("payload"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, v) of whitespace-separated numbers of each text file, comments stripped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"#[^\n]*", " ").alias("t"))
    return text.select("path", F.posexplode(F.regexp_extract_all("t", F.lit(r"(\S+)"))).alias("k", "s")).select("path", "k", F.col("s").try_cast("double").alias("v"))


def lut_table(numbers: DataFrame) -> DataFrame:
    """(path, k, v) of a look-up table file: its first number must be the count of the rest; see lut_problems()."""
    good = _lut_checks(numbers).filter("reason IS NULL").select("path")
    return numbers.filter("k > 0").join(good, "path").select("path", (F.col("k") - 1).alias("k"), "v")


def _lut_checks(numbers: DataFrame) -> DataFrame:
    count = numbers.groupBy("path").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("n"), (F.count("*") - 1).alias("have"), F.count_if(F.col("v").isNull()).alias("bad"))
    reason = F.when(F.col("bad") > 0, "not a number").when(F.col("n") < 2, "fewer than two samples").when(F.col("n") != F.col("have"), "count")
    return count.select("path", reason.alias("reason"))


def lut_problems(numbers: DataFrame) -> DataFrame:
    """(path, reason) of look-up table files that are not used: a word that is no number, a wrong count, too few samples."""
    return _lut_checks(numbers).filter("reason IS NOT NULL")


def shading_table(numbers: DataFrame) -> DataFrame:
    """(path, channel, y, x, gain) of a lens-shading file: width, height, channels, then the gains; see shading_problems()."""
    good = _shading_checks(numbers).filter("reason IS NULL")
    j = numbers.filter("k >= 3").join(good, "path").withColumn("i", F.col("k") - 3)
    return j.selectExpr("path", "i % c AS channel", "(i DIV c) DIV w AS y", "(i DIV c) % w AS x", "v AS gain")


def _shading_checks(numbers: DataFrame) -> DataFrame:
    first = [F.max(F.when(F.col("k") == k, F.col("v"))).cast("long").alias(n) for k, n in enumerate(("w", "h", "c"))]
    head = numbers.groupBy("path").agg(*first, (F.count("*") - 3).alias("have"), F.count_if(F.col("v").isNull()).alias("bad"))
    sized = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("c") > 0)
    reason = F.when(F.col("bad") > 0, "not a number").when(~F.coalesce(sized, F.lit(False)), "size").when(F.col("w") * F.col("h") * F.col("c") != F.col("have"), "count")
    return head.withColumn("reason", reason)


def shading_problems(numbers: DataFrame) -> DataFrame:
    """(path, reason) of lens-shading files that are not used: a word that is no number, no sizes, a wrong count."""
    return _shading_checks(numbers).filter("reason IS NOT NULL").select("path", "reason")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def discover(spark: SparkSession, root: str, recursive: bool = True, output_dir: str | None = None, marker: str = MARKER) -> DataFrame:
    """Image files under a folder: path, length, modification time; the contents are never read.

    Own outputs (names that end in the marker) are skipped where the output folder is the input folder, and an output folder inside
    the input folder is skipped as a whole.  No image at all is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length", "modificationTime")
    files = files.filter(extension(F.col("path")).isin(*RAW_EXTENSIONS, *RASTER_EXTENSIONS))
    if output_dir is not None:
        plain = lambda p: p.rstrip("/")
        if plain(output_dir) == plain(root):
            files = files.filter(~F.lower("path").rlike(re.escape(marker.lower()) + r"\.[^./]+$"))
        elif plain(output_dir).startswith(plain(root) + "/"):
            files = files.filter(~F.col("path").contains(plain(output_dir).removeprefix("file:") + "/"))
    if files.isEmpty():
        raise ValueError(f"no supported images under {root}")
    return files.orderBy("path")


def output_path(path: Column, root: str, output_dir: str, suffix: str, marker: str = MARKER) -> Column:
    """The output's path: the input's place under the root, without its extension, with the marker and the new one."""
    relative = F.regexp_replace(F.regexp_replace(path, r"^(file:)?/*", "/"), "^" + "/" + root.removeprefix("file:").strip("/") + "/", "")
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit(marker + suffix))


def asset_inventory(spark: SparkSession, root: str, contracts: dict[str, tuple[str, str]]) -> DataFrame:
    """(contract, sample_id) of the files that each contract's folder and suffix name, from one listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    hits = [
        F.when((folder == directory) & F.col("path").endswith(suffix), F.struct(F.lit(contract).alias("contract"), F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("sample_id")))
        for contract, (directory, suffix) in contracts.items()
    ]
    return files.select(F.explode(F.array_compact(F.array(*hits))).alias("a")).select("a.*")
